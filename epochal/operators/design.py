"""Design of first-level analyses: classes, balancing, bins and folds.

All order is deterministic: a trial's place comes from a linear congruential step of its id, so repeated
runs, and any partitioning, give the same design.  Windows partition by class or code, never globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_A, _C, _M = 1103515245, 12345, 2147483648


def shuffle_key(trial: str = "trial_id") -> Column:
    """A reproducible pseudo-random key of a trial id."""
    return (F.col(trial).cast("long") * _A + _C) % _M


def parse_class_spec(spec: str) -> list[tuple[int, int, int, int]]:
    """``'1,2;8,9'`` per class -> (class, set, position, code); classes are separated by ``|``, sets (train; test) by ``;``."""
    rows = []
    for k, one in enumerate(spec.split("|"), 1):
        sets = one.split(";")
        for s in (1, 2):
            codes = sets[min(s, len(sets)) - 1]
            rows += [(k, s, p, int(c)) for p, c in enumerate(codes.split(","), 1)]
    return rows


def class_table(spark, spec: str) -> DataFrame:
    return spark.createDataFrame(parse_class_spec(spec), "class int, set int, pos int, code int")


def label_classes(trials: DataFrame, classes: dict[int, list[int]]) -> DataFrame:
    """Adds ``class`` (0 for codes in none; a later class wins)."""
    out: Column = F.lit(0)
    for k, codes in sorted(classes.items()):
        out = F.when(F.col("event_code").isin([int(c) for c in codes]), F.lit(k)).otherwise(out)
    return trials.withColumn("class", out.cast("int"))


def overlapping_codes(classes: dict[int, list[int]]) -> list[int]:
    seen: dict[int, int] = {}
    for k, codes in classes.items():
        for c in set(codes):
            seen[c] = seen.get(c, 0) + 1
    return sorted(c for c, n in seen.items() if n > 1)


def balance(trials: DataFrame, by: str = "event_code") -> DataFrame:
    """Keeps, of every group, as many trials as the smallest group has (first in shuffled order)."""
    counts = trials.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    least = counts.agg(F.min("n").alias("least"))  # one row
    order = Window.partitionBy(by).orderBy(shuffle_key(), "trial_id")
    return trials.withColumn("k", F.row_number().over(order)).join(F.broadcast(least), F.col("k") <= F.col("least")).drop("least")


def bins(trials: DataFrame, classes: dict[int, list[int]], value: str = "value") -> DataFrame:
    """Averages the k-th trials of every code of a class: (class, bin, t_idx, n_trials, value).

    A code that a class names r times is dealt to its r places by stride; a class has as many bins as its
    scarcest place has trials.
    """
    spark = trials.sparkSession
    rows = [(k, c, p, codes.count(c), codes[:p].count(c)) for k, codes in classes.items() for p, c in enumerate(codes)]
    spec = F.broadcast(spark.createDataFrame(rows, "class int, event_code int, place int, repeats int, nth int"))  # the class specification
    order = Window.partitionBy("event_code").orderBy("trial_id")
    ids = trials.select("trial_id", "event_code").distinct().withColumn("k", F.row_number().over(order) - 1)
    dealt = ids.join(spec, "event_code").where(F.col("k") % F.col("repeats") == F.col("nth")).withColumn("bin", F.expr("k div repeats"))
    places = len(spec.take(1)) and {k: len(codes) for k, codes in classes.items()}
    n_bins = dealt.groupBy("class", "place").agg(F.count(F.lit(1)).alias("n")).groupBy("class").agg(F.min("n").alias("n_bins"), F.count(F.lit(1)).alias("n_places"))
    whole: Column = F.lit(False)
    for k, n in (places or {}).items():
        whole = whole | ((F.col("class") == k) & (F.col("n_places") == n))
    kept = dealt.join(F.broadcast(n_bins.where(whole)), "class").where("bin < n_bins")  # a row for each class
    return trials.join(kept.select("trial_id", "event_code", "class", "bin"), ["trial_id", "event_code"]).groupBy("class", "bin", "t_idx").agg(F.count(F.lit(1)).alias("n_trials"), F.avg(value).alias("value"))


def unpack_bins(binned: DataFrame, members: str = "trial_ids") -> DataFrame:
    """A row for each original trial of a bin."""
    return binned.select("*", F.explode(members).alias("trial_id")).drop(members)


def restrict_training(trials: DataFrame, most: int, n_classes: int) -> DataFrame:
    """The first floor(most / n_classes) trials of each class in shuffled order."""
    order = Window.partitionBy("class").orderBy(shuffle_key(), "trial_id")
    return trials.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most // n_classes).drop("k")


def folds(trials: DataFrame, k: int, by: str = "class") -> DataFrame:
    """Adds ``fold`` 1..k: contiguous runs of each class in shuffled order, with borders round(f n / k)."""
    order = Window.partitionBy(by).orderBy(shuffle_key(), "trial_id")
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    ranked = trials.withColumn("r", F.row_number().over(order)).withColumn("n", n)
    fold = F.lit(0)
    for f in range(1, k + 1):
        fold = F.when((F.col("r") > F.round(F.lit(float(f - 1)) * F.col("n") / k)) & (F.col("r") <= F.round(F.lit(float(f)) * F.col("n") / k)), f).otherwise(fold)
    return ranked.withColumn("fold", fold.cast("int")).drop("r", "n")


def fold_roles(trials: DataFrame, train: dict[int, list[int]], test: dict[int, list[int]], k: int) -> DataFrame:
    """(trial_id, class, fold, role): which trials train and which test each fold, for classes of event codes that may differ between the two.

    Codes of both sides, of training only and of testing only are dealt into k folds apart, so that their shares stay the
    same in each.  A trial tests its own fold if its code tests, and trains all others if its code trains.  k is
    lowered to the smallest of these parts; a class without trials on either side stops the job.  Without folds (k = 1) all
    trials take both roles.
    """
    sides = lambda c: (set(train.get(c, [])), set(test.get(c, [])))
    parts = [(c, part, codes) for c in sorted({*train, *test}) for a, b in [sides(c)] for part, codes in (("common", a & b), ("train", a - b), ("test", b - a)) if codes]
    own = F.explode(F.filter(F.array(*[F.when(F.col("event_code").isin(sorted(codes)), F.struct(F.lit(c).alias("class"), F.lit(part).alias("part"))) for c, part, codes in parts]), lambda x: x.isNotNull())).alias("p")
    dealt = trials.select("trial_id", own).select("trial_id", "p.class", "p.part")
    sizes = dealt.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {(r["class"], r["part"]): r["n"] for r in sizes.collect()}  # three rows a class at most
    for c in {*train, *test}:
        for side in ("train", "test"):
            if not any(counts.get((c, part)) for part in ("common", side)):
                raise ValueError(f"no trials to {side} class {c}")
    k = min([k, *counts.values()]) if k > 1 else 1
    if k == 1:
        roles = F.when(F.col("part") == "common", F.array(F.lit("train"), F.lit("test"))).otherwise(F.array("part"))
        return dealt.select("trial_id", "class", F.lit(1).alias("fold"), F.explode(roles).alias("role"))
    group = Window.partitionBy("class", "part")
    placed = dealt.withColumns({"r": F.row_number().over(group.orderBy(shuffle_key(), "trial_id")), "n": F.count(F.lit(1)).over(group)})
    borders = F.array(*[F.round(F.lit(float(f)) * F.col("n") / k) for f in range(1, k + 1)])
    placed = placed.withColumn("own", (F.size(F.filter(borders, lambda b: b < F.col("r"))) + 1).cast("int"))
    roles = placed.select("trial_id", "class", "part", "own", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold"))
    role = F.when(F.col("fold") == F.col("own"), F.when(F.col("part") != "train", "test")).when(F.col("part") != "test", "train")
    return roles.select("trial_id", "class", "fold", role.alias("role")).where("role is not null")


def smallest_subset(trials: DataFrame, train: list[int], test: list[int], k: int) -> DataFrame:
    """One row: k lowered to the smallest non-empty one of the common, train-only and test-only subsets."""
    both = sorted(set(train) & set(test))
    part = F.when(F.col("event_code").isin(both), "common").when(F.col("event_code").isin(train), "train").when(F.col("event_code").isin(test), "test")
    counted = trials.withColumn("part", part).where("part is not null").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.least(F.lit(k).cast("long"), F.min("n")).alias("n_folds"))
