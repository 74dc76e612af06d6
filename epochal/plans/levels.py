"""The two analysis levels as plans: a configuration in, a lazy DataFrame out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.functions.dist import t_two_sided
from epochal.operators import decode, design, group, metrics

METHODS = ("diagLinear", "linear", "quadratic", "diagQuadratic", "mahalanobis")


@dataclass(frozen=True)
class FirstLevel:
    """Settings of a decoding analysis of one recording; ``classes`` are lists of event codes."""

    classes: dict[int, list[int]]
    folds: int = 10
    method: str = "linear"
    whiten: bool = False
    balance: bool = True

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        if len(self.classes) < 2:
            raise ValueError("at least two classes are needed")
        if twice := design.overlapping_codes(self.classes):
            raise ValueError(f"codes in more than one class: {twice}")


def first_level(trials: DataFrame, plan: FirstLevel) -> DataFrame:
    """(fold, auc) of trials(trial_id, event_code, x)."""
    own = design.label_classes(trials, plan.classes).where("class > 0")
    if plan.balance:
        own = design.balance(own, "class").drop("k")
    own = design.folds(own, plan.folds)
    if plan.method == "diagLinear" and len(plan.classes) == 2 and not plan.whiten:
        return decode.diagonal_auc(own.withColumn("class", (F.col("class") == max(plan.classes)).cast("int")), plan.folds)
    scores = decode.decode_folds(own, {"diagLinear": "diaglinear", "diagQuadratic": "diagquadratic"}.get(plan.method, plan.method), plan.whiten)
    return metrics.auc_multiclass(scores, sorted(plan.classes), ["fold"]).select("fold", "auc")


@dataclass(frozen=True)
class GroupLevel:
    """Settings of a group analysis; ``correction`` is none, fdr_bh, fdr_by or cluster."""

    chance: float = 0.5
    q: float = 0.05
    correction: str = "fdr_by"
    threshold: float = 2.0
    replicates: int = 1000
    by: list[str] = field(default_factory=lambda: ["sample"])


def group_level(values: DataFrame, plan: GroupLevel) -> DataFrame:
    """Statistics of values(subject, sample, value): t and p for each sample, or clusters with their chance."""
    if plan.correction == "cluster":
        centred = values.withColumn("value", F.col("value") - plan.chance)
        found = group.runs_over(group.one_sample_t(centred, ["sample"]), [], "sample", "t", plan.threshold)
        null = group.permutation_masses(centred, plan.replicates, plan.threshold).where("rep > 0").select(F.col("mass").alias("null_mass"))
        keys = [c for c in found.columns]
        return found.join(F.broadcast(null), how="cross").groupBy(*keys).agg(F.avg((F.col("null_mass") > F.col("mass")).cast("double")).alias("p"))  # replicates: a setting, not data
    t = group.one_sample_t(values, plan.by, plan.chance).where("t is not null").withColumn("p", t_two_sided("t", F.col("df").cast("double")))
    if plan.correction == "none":
        return t.withColumn("h", F.col("p") <= plan.q)
    return group.fdr(t.withColumn("family", F.lit("all")), ["family"], plan.q, plan.correction == "fdr_by", plan.by[0])
