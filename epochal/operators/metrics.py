"""Scores of classifiers: rank AUC, confusion, balanced accuracy and signal detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.operators import ordered


def auc(scores: DataFrame, by: list[str], label: str = "label", score: str = "score", positive: int = 1) -> DataFrame:
    """Area under the curve per group; null where a group has one class only.

    Scores are counted by value and class, so ties share their places and no group is sorted in one task: the area
    is, summed over values, the positives there times the negatives below and half of those level with them.
    """
    is_p = (F.col(label) == positive).cast("double")
    counts = scores.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(is_p).alias("pos"), F.sum(1 - is_p).alias("neg"))
    placed = ordered.running(counts, by, score, ["neg"])
    sums = placed.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("s"))
    return sums.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("s") / (F.col("p") * F.col("n"))).alias("auc"))


def auc_multiclass(scores: DataFrame, classes: list[int], by: list[str]) -> DataFrame:
    """Mean AUC over all ordered class pairs; ``scores`` has label, class and score (a row for each class's score).

    The pair (a, b) ranks the trials of a and b by a's score.
    """
    own = scores.where(F.col("label").isin(classes) & F.col("class").isin(classes))
    pairs = own.withColumn("other", F.explode(F.array(*[F.lit(c) for c in classes]))).where("other <> class and (label = class or label = other)")
    pairs = pairs.withColumn("hit", (F.col("label") == F.col("class")).cast("int"))
    return auc(pairs, [*by, "class", "other"], "hit").groupBy(*by).agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_pairs"))


def assigned_class(scores: DataFrame, trial: str = "trial_id") -> DataFrame:
    """(trial, label, assigned): the class with the highest score; the first of ties."""
    best = F.max_by("class", F.struct("score", (-F.col("class")).alias("first")))
    return scores.groupBy(trial, "label").agg(best.alias("assigned"))


def confusion(assigned: DataFrame, by: list[str] | None = None) -> DataFrame:
    return assigned.groupBy(*(by or []), "label", "assigned").agg(F.count(F.lit(1)).alias("n"))


def balanced_accuracy(assigned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean over classes of the share that is right."""
    by = by or []
    recall = assigned.groupBy(*by, "label").agg(F.avg((F.col("label") == F.col("assigned")).cast("double")).alias("recall"))
    return recall.groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def detection(assigned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """hr, far, mr, cr, hr_far with label 1 as signal (null without such trials); and the cells corrected for d' (.5 to each if any is 0)."""
    by = by or []
    s, y = F.col("label") == 1, F.col("assigned") == 1
    count = lambda c: F.sum(c.cast("double"))
    cells = assigned.groupBy(*by).agg(count(s & y).alias("hit"), count(s & ~y).alias("miss"), count(~s & y).alias("fa"), count(~s & ~y).alias("rejected"))
    add = F.when(F.least("hit", "miss", "fa", "rejected") == 0, 0.5).otherwise(0.0)
    rate = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    out = cells.withColumns({"hr": rate("hit", "miss"), "far": rate("fa", "rejected"), "mr": rate("miss", "hit"), "cr": rate("rejected", "fa")}).withColumn("hr_far", F.col("hr") - F.col("far"))
    return out.withColumns({"hr_corrected": F.try_divide(F.col("hit") + add, F.col("hit") + F.col("miss") + 2 * add), "far_corrected": F.try_divide(F.col("fa") + add, F.col("fa") + F.col("rejected") + 2 * add)})
