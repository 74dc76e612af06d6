"""Result tables: averages over folds and runs, masks, cluster tables, tuning curves, regions, event-related means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.operators.group import label_grid


def average(results: DataFrame, over: list[str], value: str = "value") -> DataFrame:
    """Unweighted mean over folds, iterations or training subjects (the columns ``over`` go)."""
    keep = [c for c in results.columns if c not in over and c != value]
    return results.groupBy(*keep).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def average_by_test_subject(results: DataFrame, name: str, pattern: str) -> DataFrame:
    """Mean over training subjects: the test subject is the first group of ``pattern`` in a result's name; others go."""
    own = results.withColumn("subject", F.regexp_extract(name, pattern, 1)).where("subject <> ''")
    return own.groupBy("subject").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def first_fold_trials(folds: DataFrame) -> DataFrame:
    """(n_train, n_test) of fold 1."""
    first = F.col("fold") == 1
    return folds.agg(F.sum((~first).cast("long")).alias("n_train"), F.sum(first.cast("long")).alias("n_test"))


def drop_unbalanced(trials: DataFrame, codes: list[int], kept: DataFrame) -> DataFrame:
    """Trials whose code is in the class specification stay only if balancing kept them; other codes stay."""
    inside = F.col("event_code").isin(codes)
    gone = trials.where(inside).join(kept.select("trial_id"), "trial_id", "left_anti").select("trial_id")
    return trials.join(gone, "trial_id", "left_anti")


def masked(stats: DataFrame, mask: Column) -> DataFrame:
    """Outside the mask p is 1 and the sign 0."""
    return stats.withColumns({"p": F.when(mask, F.col("p")).otherwise(1.0), "sign": F.when(mask, F.col("sign")).otherwise(0)})


def next_run(runs: DataFrame, column: str = "iteration") -> DataFrame:
    """One row: the smallest number from 1 that no run has."""
    own = runs.select(F.col(column).cast("long").alias("n")).distinct()
    after = own.select((F.col("n") + 1).alias("n")).unionByName(own.sparkSession.range(1, 2).select(F.col("id").alias("n"))).where("n >= 1")
    return after.join(own, "n", "left_anti").agg(F.min("n").alias("next"))


def p_clusters(stats: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """(by, sign, first, last, size, p): runs of neighbouring samples with p below q, by sign; p is the mean of theirs."""
    by = by or []
    own = stats.where((F.col("p") < q) & (F.col("sign") != 0))
    island = F.col("t") - F.row_number().over(Window.partitionBy(*by, "sign").orderBy("t"))
    return own.withColumn("_island", island).groupBy(*by, "sign", "_island").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("size"), F.avg("p").alias("p")).drop("_island")


def tuning_slopes(curves: DataFrame, key: str, x: str = "x") -> DataFrame:
    """(key, slope, level) of the line through the first half of each curve folded at its middle.

    Curves with an even number of channels get their last channel in front first.
    """
    c = F.when(F.size(x) % 2 == 0, F.concat(F.array(F.element_at(x, -1)), x)).otherwise(F.col(x))
    folded = F.zip_with("c", F.reverse("c"), lambda a, b: (a + b) / 2)
    half = curves.select(key, c.alias("c")).select(key, F.posexplode(F.slice(folded, F.lit(1), F.floor(F.size("c") / 2).cast("int") + 1)).alias("p", "v"))
    return half.groupBy(key).agg(F.regr_slope("v", F.col("p") + 1).alias("slope"), F.regr_intercept("v", F.col("p") + 1).alias("level"))


def gaussian_fit(curves: DataFrame, key: str, x: str = "x", share: float = 0.3) -> DataFrame:
    """(key, sigma, mu, height): a parabola through the log of the points above ``share`` of the maximum.

    Null where fewer than three points are that high or the parabola opens upwards.
    """
    points = curves.select(key, F.posexplode(x).alias("p", "v"), F.array_max(x).alias("most")).where(F.col("v") > share * F.col("most"))
    u, y = F.col("p").cast("double") + 1, F.log("v")
    names = {f"s{k}": F.sum(F.pow(u, F.lit(float(k)))) for k in range(5)} | {f"t{k}": F.sum(y * F.pow(u, F.lit(float(k)))) for k in range(3)}
    m = points.groupBy(key).agg(*[v.alias(k) for k, v in names.items()])
    s, t = [F.col(f"s{k}") for k in range(5)], [F.col(f"t{k}") for k in range(3)]

    def det(a: list[list[Column]]) -> Column:
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    rows = [[s[0], s[1], s[2]], [s[1], s[2], s[3]], [s[2], s[3], s[4]]]
    swap = lambda k: [[t[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]
    whole = F.when((s[0] >= 3) & (F.abs(det(rows)) > 1e-9), det(rows))
    m = m.select(key, *[(det(swap(k)) / whole).alias(f"c{k}") for k in range(3)])
    sigma2 = F.when(F.col("c2") < 0, -1 / (2 * F.col("c2")))
    mu = F.col("c1") * sigma2
    return m.select(key, F.sqrt(sigma2).alias("sigma"), mu.alias("mu"), F.exp(F.col("c0") + mu * mu / (2 * sigma2)).alias("height"))


def windowed(curves: DataFrame, windows: list[tuple[int, int]], by: list[str], t: str = "t_idx") -> DataFrame:
    """(by, window, value): means over closed windows of time."""
    which = F.explode(F.array_compact(F.array(*[F.when(F.col(t).between(lo, hi), F.lit(k)) for k, (lo, hi) in enumerate(windows, 1)])))
    return curves.withColumn("window", which).groupBy(*by, "window").agg(F.avg("value").alias("value"))


def regions(maps: DataFrame) -> DataFrame:
    """(map, region, cells, value): means of maps(map, row, col, value, mask) over the 8-connected regions of the mask.

    A map is a time by time or time by frequency grid of one analysis, so a task labels it whole.
    """

    def label(own: pd.DataFrame) -> pd.DataFrame:
        grid = own.pivot(index="row", columns="col", values="mask").sort_index().sort_index(axis=1)
        found = label_grid(grid.to_numpy(dtype=float) > 0)
        at = np.argwhere(found > 0)
        return pd.DataFrame({"map": own["map"].iloc[0], "row": grid.index.to_numpy()[at[:, 0]], "col": grid.columns.to_numpy()[at[:, 1]], "region": found[at[:, 0], at[:, 1]]})

    own = maps.select(F.col("map").cast("string").alias("map"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value", F.col("mask").cast("int").alias("mask"))
    labels = own.groupBy("map").applyInPandas(label, "map string, row long, col long, region int")
    return labels.join(own, ["map", "row", "col"]).groupBy("map", "region").agg(F.count(F.lit(1)).alias("cells"), F.avg("value").alias("value"))


def event_related(data: DataFrame, electrodes: list[str], method: str, conditions: list, arithmetic: str) -> DataFrame:
    """(subject, t_idx, cond, value) of data(subject, cond, label, t_idx, value): electrodes first, then conditions.

    Electrodes are averaged or, in pairs, subtracted; conditions are kept, averaged or subtracted.  Values that
    are all below a thousandth are volts and become microvolts.
    """
    sign = {e: 1.0 if method == "average" or k == 0 else -1.0 for k, e in enumerate(electrodes)}
    weight = F.lit(0.0)
    for e, s in sign.items():
        weight = F.when(F.col("label") == e, F.lit(s / (len(electrodes) if method == "average" else 1))).otherwise(weight)
    own = data.where(F.col("label").isin(electrodes) & F.col("cond").isin(conditions)).groupBy("subject", "cond", "t_idx").agg(F.sum(F.col("value") * weight).alias("value"))
    if arithmetic == "average":
        own = own.groupBy("subject", "t_idx").agg(F.avg("value").alias("value")).withColumn("cond", F.lit("average"))
    elif arithmetic == "subtract":
        a, b = conditions
        of = lambda c: F.max(F.when(F.col("cond") == c, F.col("value")))
        own = own.groupBy("subject", "t_idx").agg((of(a) - of(b)).alias("value")).withColumn("cond", F.lit("difference"))
    most = F.broadcast(own.agg(F.max("value").alias("_most")))  # one row
    scale = F.when(F.col("_most") < 1e-3, 1e6).otherwise(1.0)
    return own.join(most, how="cross").select("subject", "t_idx", F.col("cond").cast("string").alias("cond"), (F.col("value") * scale).alias("value"))


def corrected_rates(rates: DataFrame, method: str) -> DataFrame:
    """Hit and false alarm rates away from 0 and 1: (p_hit, p_fa) of rows with n_signal and n_noise.

    ``arbitrary``: .00001 and .99999; ``loglinear``: half a count to every cell; ``extremes``: half a count where
    a rate is 0 or 1.
    """

    def fix(p: str, n: str) -> Column:
        c, k = F.col(p), F.col(n).cast("double")
        if method == "loglinear":
            return (c * k + 0.5) / (k + 1)
        low, high = {"arbitrary": (F.lit(0.00001), F.lit(0.99999)), "extremes": (0.5 / k, (k - 0.5) / k)}[method]
        return F.when(c == 0, low).when(c == 1, high).otherwise(c)

    return rates.withColumns({"p_hit": fix("p_hit", "n_signal"), "p_fa": fix("p_fa", "n_noise")})


def first_score(scores: DataFrame, by: list[str]) -> DataFrame:
    """Where test trials have no class to be right about: the mean of the first class's score, and the number of trials."""
    first = scores.where("class = 1")
    return first.groupBy(*by).agg(F.avg("score").alias("value"), F.count(F.lit(1)).alias("n"))


def halves(trials: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Test trials in two halves that share the one at the midpoint: (.., half)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ranked = trials.withColumn("_k", place).withColumn("_m", F.floor(n / 2) + n % 2)
    return ranked.withColumn("half", F.explode(F.array_compact(F.array(F.when(F.col("_k") <= F.col("_m"), 1), F.when(F.col("_k") >= F.col("_m"), 2))))).drop("_k", "_m")
