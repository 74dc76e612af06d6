"""Vectors, matrices and series in long form: products, norms, smoothing, indices, regression on lagged references.

A matrix is (row, col, value), a series (by, t_idx, value).  Sums of products are made by Spark; only systems
of as many unknowns as there are channels or lags are solved on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.operators import arrays
from epochal.operators.group import replicate_hash


def with_vector(data: DataFrame, vector: DataFrame, on: list[str], how: str = "add") -> DataFrame:
    """Adds a vector(on, v), a row for each value of a dimension, to all rows, or multiplies by it."""
    v = F.col("_v")
    both = data.join(F.broadcast(vector.select(*on, F.col("value").alias("_v"))), on)  # a dimension: channels, samples or conditions
    return both.withColumn("value", F.col("value") + v if how == "add" else F.col("value") * v).drop("_v")


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, value) of the product: partial sums by cell after an equi-join on the inner index."""
    right = b.select(F.col("row").alias("_k"), F.col("col").alias("_c"), F.col("value").alias("_b"))
    both = a.join(right, F.col("col") == F.col("_k"))
    return both.groupBy("row", F.col("_c").alias("col")).agg(F.sum(F.col("value") * F.col("_b")).alias("value"))


def full_from_lower(lower: DataFrame) -> DataFrame:
    """The symmetric matrix of a lower triangle."""
    return lower.unionByName(lower.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))


def channel_products(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, i, j, value): products of two channel sets, sample by sample."""
    a = left.select(key, F.col("t_idx").alias("i"), F.col("value").alias("_a"))
    b = right.select(key, F.col("t_idx").alias("j"), F.col("value").alias("_b"))
    return a.join(b, key).select(key, "i", "j", (F.col("_a") * F.col("_b")).alias("value"))


def chunk_index(data: DataFrame, scale: int, by: list[str]) -> DataFrame:
    """(by, chunk, card, low, high, mean, ssq) of stretches of ``scale`` samples; the last may be shorter."""
    v = F.col("value")
    return data.groupBy(*by, F.expr(f"(t_idx - 1) div {scale} + 1").alias("chunk")).agg(F.count(v).alias("card"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.sum(v * v).alias("ssq"))


def boxcar(data: DataFrame, width: int, by: list[str]) -> DataFrame:
    """Causal boxcar around the mean of the first width + 1 samples, so that a series starts near its own level."""
    w = Window.partitionBy(*by)
    level = F.avg(F.when(F.col("t_idx") <= width + 1, F.col("value"))).over(w)
    frame = w.orderBy("t_idx").rowsBetween(-(width - 1), 0)
    return data.withColumn("_level", level).withColumn("value", F.col("_level") + F.sum(F.col("value") - F.col("_level")).over(frame) / width).drop("_level")


def boxcars(data: DataFrame, widths: list[int], by: list[str]) -> DataFrame:
    """A row for each width and sample: (by, t_idx, width, value)."""
    out = None
    for n in widths:
        own = boxcar(data, n, by).withColumn("width", F.lit(n))
        out = own if out is None else out.unionByName(own)
    return out


def two_clusters(data: DataFrame, by: list[str]) -> DataFrame:
    """(by, low, high, n_low, bound): the split of the sorted values that leaves the least sum of squares.

    Values are counted first, so sorting and running sums go over distinct values.
    """
    value = data.groupBy(*by, F.round("value", 9).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("k"))
    w = Window.partitionBy(*by)
    run = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    v, k = F.col("v"), F.col("k")
    sums = value.withColumns({"n1": F.sum(k).over(run), "s1": F.sum(k * v).over(run), "n": F.sum(k).over(w), "s": F.sum(k * v).over(w), "q": F.sum(k * v * v).over(w)})
    n2, s2 = F.col("n") - F.col("n1"), F.col("s") - F.col("s1")
    cut = sums.where("n1 < n").withColumn("cost", F.round(F.col("q") - F.col("s1") * F.col("s1") / F.col("n1") - s2 * s2 / n2, 9))
    best = F.min_by(F.struct((F.col("s1") / F.col("n1")).alias("low"), (s2 / n2).alias("high"), F.col("n1").cast("long").alias("n_low"), v.alias("bound")), F.struct("cost", "v"))
    return cut.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


PLACES = 62
"""Samples whose presence one number holds."""


def padded_trials(data: DataFrame, most: int, by: list[str]) -> DataFrame:
    """Every trial on the samples 1..most: missing ones are 0 with weight 0, later ones go.

    What a trial has is kept as bits, a number for PLACES samples, so samples themselves are neither shuffled nor joined.
    """
    at = F.col("t_idx")
    own = data.select(*by, at.cast("int").alias("t_idx"), "value", F.lit(1).alias("weight"))
    inside = F.coalesce(at.between(1, most), F.lit(False)) & ~F.array_contains(F.array(*[F.col(b).isNull() for b in by]), True)
    held = own.select(*by, F.when(inside, F.floor((at - 1) / PLACES)).otherwise(-1).cast("int").alias("_word"), F.when(inside, F.expr(f"shiftleft(1L, pmod(t_idx - 1, {PLACES}))")).otherwise(0).alias("_bits"))
    words = held.groupBy(*by, "_word").agg(F.bit_or("_bits").alias("_bits")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_held"))
    gaps = F.expr(f"filter(sequence(1, {int(most)}), t -> shiftright(coalesce(_held[cast(floor((t - 1) / {PLACES}) as int)], 0L), (t - 1) % {PLACES}) % 2 = 0)")
    missing = words.select(*by, F.explode(gaps).alias("t_idx"), F.lit(0.0).alias("value"), F.lit(0).alias("weight"))
    return own.where(inside).withColumn("value", F.coalesce("value", F.lit(0.0))).unionByName(missing)


def weighted_trials(padded: DataFrame) -> DataFrame:
    """The inverse of ``padded_trials``: samples with a weight."""
    return padded.where("weight > 0").drop("weight")


def resonator(frequencies: DataFrame, quality: float) -> DataFrame:
    """Adds the coefficients b0, a1, a2 of a second-order peak filter at each share ``w`` of half the sampling rate."""
    gain = 1 / (1 + F.tan(F.col("w") / quality * F.pi() / 2))
    return frequencies.withColumn("_g", gain).select("w", (1 - F.col("_g")).alias("b0"), (-2 * F.col("_g") * F.cos(F.col("w") * F.pi())).alias("a1"), (2 * F.col("_g") - 1).alias("a2"))


def weighted_products(vectors: DataFrame, x: str = "x", weights: str = "w") -> DataFrame:
    """(i, j, sum, weight) for i <= j: products of weighted channels and of their weights."""
    left = vectors.select(F.arrays_zip(F.col(x).alias("x"), F.col(weights).alias("w")).alias("z")).select("z", F.posexplode("z").alias("i", "a"))
    pairs = left.select("i", "a", F.posexplode(F.expr("slice(z, i + 1, size(z))")).alias("k", "b"))
    xa, wa, xb, wb = F.col("a.x"), F.col("a.w"), F.col("b.x"), F.col("b.w")
    return pairs.groupBy((F.col("i") + 1).alias("i"), (F.col("i") + F.col("k") + 1).alias("j")).agg(F.sum(xa * wa * xb * wb).alias("sum"), F.sum(wa * wb).alias("weight"))


def shifted_products(data: DataFrame, shifts: list[int], by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(lag, sum, n): products of x with y moved by each shift, over the samples that have all shifts."""
    w = Window.partitionBy(*by).orderBy("t_idx")
    moved = data.withColumns({f"_y{s}": F.lead(y, s).over(w) for s in shifts}).where(" and ".join(f"_y{s} is not null" for s in shifts))
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("lag"), (F.col(x) * F.col(f"_y{s}")).alias("v")) for s in shifts]))
    return moved.select(parts.alias("p")).groupBy("p.lag").agg(F.sum("p.v").alias("sum"), F.count(F.lit(1)).alias("n"))


def drawn(replicate: Column, k: Column, n: Column) -> Column:
    """The k-th draw (from 0) of a replicate among n places, from a fixed arithmetic sequence: 1..n."""
    return F.floor(replicate_hash(replicate, k) / 65536).cast("long") % n + 1


def bootstrap(data: DataFrame, statistic: str, replicates: int = 100, by: list[str] = ["t_idx"], trial: str = "trial_id") -> DataFrame:  # noqa: B006
    """(by, value, sd): ``mean`` or ``rms`` over trials and its deviation over resampled trials, around the value itself.

    Trials are numbered once; a replicate is a count of how often each trial is drawn, so a resampled mean is a
    weighted one and no data are copied.
    """
    ids = data.select(trial).distinct()
    n = ids.count()
    width = max(1, n // 4096)
    order = Window.partitionBy("_part").orderBy(trial)
    part = ids.withColumn("_part", F.pmod(F.xxhash64(trial), F.lit(width)))
    if width == 1:
        numbered = part.withColumn("place", F.row_number().over(order))
    else:  # numbers within parts, parts one after another
        sizes = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = part.groupBy("_part").agg(F.count(F.lit(1)).alias("k")).withColumn("_before", F.coalesce(F.sum("k").over(sizes), F.lit(0)))  # a row for each part
        numbered = part.join(F.broadcast(before), "_part").withColumn("place", F.row_number().over(order) + F.col("_before"))
    draws = data.sparkSession.range(replicates * n).select(F.expr(f"id div {n}").alias("rep"), (F.col("id") % n).alias("_k"))
    weights = draws.select("rep", drawn(F.col("rep"), F.col("_k"), F.lit(n)).alias("place")).groupBy("rep", "place").agg(F.count(F.lit(1)).alias("w"))
    x = F.col("value") * F.col("value") if statistic == "rms" else F.col("value")
    finish = F.sqrt if statistic == "rms" else (lambda c: c)
    own = data.join(weights.join(numbered.select(trial, "place"), "place").select(trial, "rep", "w"), trial)
    each = own.groupBy(*by, "rep").agg(finish(F.sum(x * F.col("w")) / F.sum("w")).alias("_r"))
    whole = data.groupBy(*by).agg(finish(F.avg(x)).alias("value"))
    return each.join(whole, by).groupBy(*by, "value").agg(F.sqrt(F.avg((F.col("_r") - F.col("value")) * (F.col("_r") - F.col("value")))).alias("sd"))


def line_fit(data: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """(by, slope, level, r2) of the least-squares line."""
    return data.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("level"), F.regr_r2(y, x).alias("r2"))


def multiple_regression(data: DataFrame, predictors: list[str], target: str) -> np.ndarray:
    """Coefficients, the constant first: normal equations from one aggregate, directions below 1e-7 of the largest left out."""
    names = [F.lit(1.0), *(F.col(p) for p in predictors), F.col(target)]
    sums = data.agg(*[F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    n = len(names)
    m = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], dtype=float)
    return np.linalg.pinv(m[:-1, :-1], rcond=1e-7, hermitian=True) @ m[:-1, -1]


def without_reference(data: DataFrame, shifts: list[int], by: list[str], x: str = "x", reference: str = "y") -> DataFrame:
    """x less its regression on the shifted reference: (by, t_idx, value) of the samples that have all shifts."""
    w = Window.partitionBy(*by).orderBy("t_idx")
    names = [f"_y{k}" for k in range(len(shifts))]
    moved = data.withColumns({n: F.lead(reference, s).over(w) if s >= 0 else F.lag(reference, -s).over(w) for n, s in zip(names, shifts, strict=True)}).where(" and ".join(f"{n} is not null" for n in names))
    c = multiple_regression(moved, names, x)
    fit = F.lit(float(c[0]))
    for k, n in zip(c[1:], names, strict=True):
        fit = fit + float(k) * F.col(n)
    return moved.select(*by, "t_idx", (F.col(x) - fit).alias("value"))


def sensor_noise_filters(covariance: np.ndarray, neighbours: int) -> np.ndarray:
    """Filters (columns) that replace each channel by its regression on its most correlated ``neighbours``."""
    n = len(covariance)
    scale = np.sqrt(np.maximum(np.diag(covariance), 1e-300))
    likeness = np.abs(covariance / np.outer(scale, scale))
    np.fill_diagonal(likeness, -1)
    out = np.zeros((n, n))
    for k in range(n):
        near = np.sort(np.argsort(-likeness[k], kind="stable")[:neighbours])
        out[near, k] = np.linalg.pinv(covariance[np.ix_(near, near)], rcond=1e-7, hermitian=True) @ covariance[near, k]
    return out


def without_sensor_noise(vectors: DataFrame, neighbours: int = 10, x: str = "x") -> DataFrame:
    """Channels rebuilt from their neighbours: what only one sensor sees goes."""
    return arrays.apply_filters(vectors, sensor_noise_filters(arrays.covariance(vectors, x)[0], neighbours), x)


def repeated_components(trials: DataFrame, by: str = "event_code", x: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """Filters by falling share of the power that is common to a condition's trials: covariance of the conditions' means against all."""
    means = trials.select(by, F.posexplode(x).alias("p", "v")).groupBy(by, "p").agg(F.avg("v").alias("v"))
    rows = means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda e: e["v"]).alias(x))  # a row for each condition
    return arrays.source_separation(arrays.covariance(trials, x)[0], arrays.covariance(rows, x)[0])
