"""Group statistics: means, t tests, false discovery, clusters, permutation, latency, reductions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.functions.dist import normal_quantile, t_two_sided
from epochal.operators import ordered


def mean_se(data: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return data.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n"))


def one_sample_t(data: DataFrame, by: list[str], chance: float = 0.0, value: str = "value") -> DataFrame:
    """t of the mean against chance, with df; null where the deviation is 0 or n < 2."""
    n, sd = F.count(value), F.stddev_samp(value)
    return data.groupBy(*by).agg(F.avg(value).alias("mean"), (n - 1).alias("df"), F.when((n > 1) & (sd > 0), (F.avg(value) - chance) / (sd / F.sqrt(n))).alias("t"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Differences a - b of the subjects that both have."""
    return a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys).select(*keys, (F.col("a") - F.col("b")).alias(value))


def two_sample_t(data: DataFrame, by: list[str], group: str, first: str, second: str, equal: bool = True, value: str = "value") -> DataFrame:
    """t and df of two independent groups, pooled or Welch."""
    of = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    s = data.groupBy(*by).agg(*[of(f, g).alias(f"{name}{k}") for k, g in ((1, first), (2, second)) for name, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    n1, n2, v1, v2 = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("v1"), F.col("v2")
    if equal:
        df = n1 + n2 - 2
        se = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, df) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    else:
        se = F.sqrt(v1 / n1 + v2 / n2)
        df = F.pow(v1 / n1 + v2 / n2, F.lit(2.0)) / (F.pow(v1 / n1, F.lit(2.0)) / (n1 - 1) + F.pow(v2 / n2, F.lit(2.0)) / (n2 - 1))
    return s.select(*by, F.try_divide(F.col("m1") - F.col("m2"), se).alias("t"), df.alias("df"))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + .. + 1/n: summed up to 64 terms, beyond them by the asymptotic series (exact in double precision)."""
    few = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(n.cast("long"), F.lit(64).cast("long"))), F.lit(0.0), lambda s, k: s + 1.0 / k)
    x = n.cast("double")
    return F.when(n <= 64, few).otherwise(F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x))


def fdr(p_values: DataFrame, family: list[str], q: float = 0.05, dependent: bool = True, key: str = "key") -> DataFrame:
    """Step-up false discovery: adds rank, crit (per family) and h; ``dependent`` divides by the harmonic sum.

    p values are counted by value, and of equal ones the last place decides; ranks among equal ones follow ``key``.
    """
    place = ordered.placed(p_values, family, "p")
    own = place.withColumn("_c", harmonic(F.col("n_all")) if dependent else F.lit(1.0))
    bound = (F.col("n_before") + F.col("n")) * F.lit(q) / (F.col("n_all") * F.col("_c"))
    crit = own.groupBy(*family).agg(F.max(F.when(F.col("p") <= bound, F.col("p"))).alias("crit"))
    same = p_values.join(place.select(*family, F.col("p"), "n_before"), [*family, "p"]).join(crit, family)
    within = Window.partitionBy(*family, "p").orderBy(key)
    return same.withColumn("rank", F.col("n_before") + F.row_number().over(within)).withColumn("h", F.coalesce(F.col("p") <= F.col("crit"), F.lit(False))).drop("n_before")


def runs_over(data: DataFrame, by: list[str], t: str, value: str, threshold: float) -> DataFrame:
    """One-dimensional clusters of neighbouring samples whose |value| exceeds the threshold, by sign.

    (by, sign, first, last, size, mass, peak_t): mass is the sum of |value|, the peak the first largest.
    """
    sign = F.when(F.col(value) > threshold, 1).when(F.col(value) < -threshold, -1).otherwise(0)
    signed = data.withColumn("sign", sign).where("sign <> 0")
    island = F.col(t) - F.row_number().over(Window.partitionBy(*by, "sign").orderBy(t))
    return signed.withColumn("island", island).groupBy(*by, "sign", "island").agg(
        F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("size"), F.sum(F.abs(value)).alias("mass"), F.max_by(t, F.struct(F.abs(F.round(value, 9)), -F.col(t))).alias("peak_t")
    ).drop("island")


def replicate_hash(replicate: Column, subject: Column) -> Column:
    """((replicate * 7919 + subject * 104729) * 1103515245 + 12345) mod 2 ** 31, reduced at each step: no number of a subject or replicate overflows."""
    low = lambda x: F.pmod(x.cast("long"), F.lit(1 << 31).cast("long"))
    return low(low(low(replicate) * 7919 + low(subject) * 104729) * 1103515245 + 12345)


def replicate_sign(replicate: Column, subject: Column) -> Column:
    """+1 or -1, a fixed function of replicate and subject (replicate 0 changes nothing)."""
    return F.when((replicate == 0) | (F.floor(replicate_hash(replicate, subject) / 65536) % 2 == 0), F.lit(1.0)).otherwise(F.lit(-1.0))


def permutation_masses(data: DataFrame, replicates: int, threshold: float) -> DataFrame:
    """(rep, mass): the largest cluster mass of each sign-flipped replicate; data(subject, sample, value) are differences.

    Each sample meets each replicate once; the t values of a replicate are plain sums by (rep, sample).
    """
    reps = data.sparkSession.range(replicates + 1).select(F.col("id").alias("rep"))
    flipped = data.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("value", F.col("value") * replicate_sign(F.col("rep").cast("long"), F.col("subject").cast("long")))
    masses = runs_over(one_sample_t(flipped, ["rep", "sample"]), ["rep"], "sample", "t", threshold)
    return reps.join(masses.groupBy("rep").agg(F.max("mass").alias("mass")), "rep", "left").select("rep", F.coalesce("mass", F.lit(0.0)).alias("mass"))


def permutation_p(masses: DataFrame) -> DataFrame:
    """Share of replicates whose mass is strictly larger than that of replicate 0."""
    observed = masses.where("rep = 0").select(F.col("mass").alias("observed"))
    return masses.where("rep > 0").join(F.broadcast(observed), how="cross").agg(F.avg((F.col("mass") > F.col("observed")).cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))


def label_grid(mask: np.ndarray) -> np.ndarray:
    """Eight-connected components of a boolean grid, numbered by their first cell in column order."""
    out, n = np.zeros(mask.shape, dtype=int), 0
    for j in range(mask.shape[1]):
        for i in range(mask.shape[0]):
            if mask[i, j] and not out[i, j]:
                n += 1
                todo = [(i, j)]
                out[i, j] = n
                while todo:
                    a, b = todo.pop()
                    for x in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                        for y in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                            if mask[x, y] and not out[x, y]:
                                out[x, y] = n
                                todo.append((x, y))
    return out


def symmetrise(matrix: DataFrame, by: list[str]) -> DataFrame:
    """Mean of (i, j) and (j, i); matrix(by, row, col, value)."""
    other = matrix.select(*by, F.col("col").alias("row"), F.col("row").alias("col"), F.col("value").alias("other"))
    return matrix.join(other, [*by, "row", "col"]).select(*by, "row", "col", ((F.col("value") + F.col("other")) / 2.0).alias("value"))


def reduce_matrix(matrix: DataFrame, by: list[str], how: str) -> DataFrame:
    """``avtrain`` (mean over col), ``avtest`` (mean over row) or ``diag``."""
    if how == "diag":
        return matrix.where("row = col").select(*by, F.col("row").alias("t"), "value")
    keep = {"avtrain": "row", "avtest": "col"}[how]
    return matrix.groupBy(*by, F.col(keep).alias("t")).agg(F.avg("value").alias("value"))


def onset(curves: DataFrame, by: list[str], share: float = 0.5) -> DataFrame:
    """First t at which a curve reaches ``share`` of its maximum: (by, peak, onset_t)."""
    peak = F.max("value").over(Window.partitionBy(*by))
    return curves.withColumn("peak", peak).where(F.col("value") >= F.col("peak") * share).groupBy(*by).agg(F.max("peak").alias("peak"), F.min("t").alias("onset_t"))


def jackknife(curves: DataFrame, subject: str = "subject") -> DataFrame:
    """Leave-one-out means: (subject, t, value)."""
    w = Window.partitionBy("t")
    return curves.withColumn("value", (F.sum("value").over(w) - F.col("value")) / F.nullif(F.count(F.lit(1)).over(w) - 1, F.lit(0)))


def correlate(pairs: DataFrame, by: list[str], x: str, y: str, kind: str = "pearson") -> DataFrame:
    """(by, r, fisher_z) of Pearson's or Spearman's correlation."""
    if kind == "spearman":
        pairs = ordered.with_average_rank(ordered.with_average_rank(pairs, by, x, "_x"), by, y, "_y")
        x, y = "_x", "_y"
    return pairs.groupBy(*by).agg(F.corr(x, y).alias("r")).withColumn("fisher_z", F.when(F.abs("r") < 1, 0.5 * F.log((1 + F.col("r")) / (1 - F.col("r")))))


def correlation_test(pairs: DataFrame, by: list[str], x: str, y: str, kind: str = "pearson", level: float = 0.05) -> DataFrame:
    """(by, r, df, t, p, low, high): a correlation, its t test and the confidence interval by Fisher's z."""
    r = correlate(pairs, by, x, y, kind).drop("fisher_z").join(pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg((F.count(F.lit(1)) - 2).alias("df")), by)
    r = r.withColumn("t", F.col("r") * F.sqrt(F.col("df") / (1 - F.col("r") * F.col("r"))))
    reach = float(normal_quantile(np.array([1 - level / 2]))[0]) / F.sqrt(F.col("df") - 1)
    return r.withColumns({"p": t_two_sided("t", F.col("df").cast("double")), "low": F.tanh(F.atanh("r") - reach), "high": F.tanh(F.atanh("r") + reach)})


def matched_correlation(first: DataFrame, second: DataFrame, by: list[str], least: float = 0.8, kind: str = "pearson") -> DataFrame:
    """(by, r, fisher_z, n, few): correlation over the trials that both score tables(by, trial_id, event_code, score) have.

    ``few`` marks a group with less than ``least`` of the first table's trials.  Event codes that disagree stop the job: the
    tables are not of the same trials.
    """
    keys = [*by, "trial_id"]
    both = first.join(second.select(*keys, F.col("event_code").alias("_code"), F.col("score").alias("_y")), keys)
    same = F.when(F.col("event_code") == F.col("_code"), F.col("score")).otherwise(F.raise_error(F.lit("the event codes of the trials don't match")).cast("double"))
    pairs = both.select(*by, same.alias("_x"), "_y")
    sizes = first.groupBy(*by).agg(F.count(F.lit(1)).alias("_total")).join(pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    return correlate(pairs, by, "_x", "_y", kind).join(sizes, by).select(*by, "r", "fisher_z", "n", (F.col("n") < F.col("_total") * least).alias("few"))


def snap_limits(data: DataFrame, low: float, high: float, t: str = "t") -> DataFrame:
    """Both ends move to the nearest value of the axis, then count as inside."""
    near = lambda x: F.min_by(t, F.struct(F.abs(F.col(t) - x), F.col(t)))
    ends = data.select(t).distinct().agg(near(low).alias("_low"), near(high).alias("_high"))  # one row
    return data.join(F.broadcast(ends), F.col(t).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def select_subjects(data: DataFrame, patterns: list[str], invert: bool = False, subject: str = "subject") -> DataFrame:
    """Subjects whose name contains one of the patterns (inverted: none of them); no pattern keeps all."""
    if not patterns:
        return data
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col(subject).contains(p)
    return data.where(~hit if invert else hit)


def concat_stats(tables: list[DataFrame]) -> DataFrame:
    """Union over the columns that all have, differences (names with ``-``) last by ``place``."""
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    out = tables[0].select(*common)
    for t in tables[1:]:
        out = out.unionByName(t.select(*common))
    return out.withColumn("place", F.col("cond").contains("-").cast("int"))


def randomisation_p(values: DataFrame, by: list[str]) -> DataFrame:
    """Share of permutations (rep > 0) with a value of at least the observed one (rep 0)."""
    observed = values.where("rep = 0").select(*by, F.col("value").alias("observed"))
    return values.where("rep > 0").join(observed, by).groupBy(*by).agg(F.avg((F.col("value") >= F.col("observed")).cast("double")).alias("p"))


def first_peak(matrix: DataFrame, by: list[str]) -> DataFrame:
    """(by, row, col, value) of the largest cell; of ties the first in column order."""
    best = F.max_by(F.struct("row", "col", "value"), F.struct(F.round("value", 9), -F.col("col"), -F.col("row")))
    return matrix.groupBy(*by).agg(best.alias("b")).select(*by, "b.row", "b.col", "b.value")


def pair_differences(data: DataFrame, key: str, value: str) -> DataFrame:
    """All differences below the diagonal of a small table of means: (i, j, value), i > j."""
    other = F.broadcast(data.select(F.col(key).alias("j"), F.col(value).alias("_v")))  # one mean for each unit of a dimension
    return data.select(F.col(key).alias("i"), F.col(value)).join(other, F.col("i") > F.col("j")).select("i", "j", (F.col(value) - F.col("_v")).alias("value"))


def nearest_level(data: DataFrame, wanted: float, column: str) -> DataFrame:
    """Rows at the level that equals ``wanted`` in two decimals, else at the nearest one (the lower of two)."""
    level = data.select(column).distinct().agg(F.min_by(column, F.struct(F.abs(F.round(column, 2) - round(wanted, 2)), F.col(column))).alias("_level"))  # one row
    return data.join(F.broadcast(level), F.col(column) == F.col("_level")).drop("_level")
