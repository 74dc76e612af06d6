"""Channel and sample arithmetic: references, power, statistics at a scale, shifts, sparse filters, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rereference(data: DataFrame, sample: list[str], value: str = "value", weight: str | None = None) -> DataFrame:
    """Each channel minus the (weighted) mean over the channels of its sample."""
    w = F.col(weight) if weight else F.lit(1.0)
    own = Window.partitionBy(*sample)
    return data.withColumn(value, F.col(value) - F.try_divide(F.sum(F.col(value) * w).over(own), F.sum(w).over(own)))


def power(data: DataFrame, by: list[str], value: str = "value", weight: str | None = None) -> DataFrame:
    """(by, power, weight, rms): weighted sum of squares, total weight and root mean square."""
    w = F.col(weight) if weight else F.lit(1.0)
    out = data.groupBy(*by).agg(F.sum(F.col(value) * F.col(value) * w).alias("power"), F.sum(w).alias("weight"))
    return out.withColumn("rms", F.sqrt(F.try_divide("power", "weight")))


def fold(data: DataFrame, length: int, at: str = "i") -> DataFrame:
    """A running sample number becomes epoch and sample in it, both from 0."""
    return data.withColumns({"epoch": F.floor(F.col(at) / length).cast("long"), "t": F.pmod(F.col(at), F.lit(length)).cast("long")}).drop(at)


def statistics_at_scale(data: DataFrame, scale: int, by: list[str], t: str = "t_idx", value: str = "value") -> DataFrame:
    """(by, bin, least, most, mean, sd) over runs of ``scale`` samples; t counts from 1."""
    bins = data.withColumn("bin", F.floor((F.col(t) - 1) / scale).cast("long"))
    return bins.groupBy(*by, "bin").agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def statistics_by_dimension(data: DataFrame, dimensions: list[str], value: str = "value") -> DataFrame:
    """Least, most, mean and population variance along each dimension in one pass (the other dimensions are null)."""
    sets = data.groupingSets([[d] for d in dimensions], *dimensions)
    return sets.agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def sparse_filter(data: DataFrame, taps: dict[int, float], by: list[str], t: str = "t_idx", value: str = "value") -> DataFrame:
    """Convolution with an impulse response that is zero but at a few delays; samples before the first are 0."""
    w = Window.partitionBy(*by).orderBy(t)
    total: Column = F.lit(0.0)
    for delay, gain in sorted(taps.items()):
        total = total + gain * F.coalesce(F.lag(value, delay).over(w), F.lit(0.0))
    return data.withColumn(value, total)


def resample_linear(data: DataFrame, step: float, by: list[str], t: str = "t_idx", value: str = "value") -> DataFrame:
    """(by, j, value): values at the places 1 + j * step between the first and the last sample, by linear interpolation.

    Each sample makes the places up to the next one itself, so nothing is joined.
    """
    following = F.lead(value).over(Window.partitionBy(*by).orderBy(t))
    i = F.col(t) - 1
    last = F.when(F.col("_next").isNull(), F.floor(i / step + F.lit(1e-9))).otherwise(F.ceil((i + 1) / step - F.lit(1e-9)) - 1)
    first = F.ceil(i / step - F.lit(1e-9))
    places = data.withColumn("_next", following).withColumns({"_first": first.cast("long"), "_last": last.cast("long")}).where("_first <= _last")
    out = places.withColumn("j", F.explode(F.sequence("_first", "_last")))
    share = F.col("j") * step - i
    return out.select(*by, "j", F.when(F.col("_next").isNull(), F.col(value)).otherwise(F.col(value) + share * (F.col("_next") - F.col(value))).alias("value"))


def outlier_trials(data: DataFrame, criterion: float, trial: str = "trial_id", t: str = "t_idx", value: str = "value") -> DataFrame:
    """(trial, deviation, outlier): squared distance from the mean trial over the mean of all trials' distances."""
    mean = data.groupBy(t).agg(F.avg(value).alias("_mean"))
    own = data.join(mean, t).groupBy(trial).agg(F.sum((F.col(value) - F.col("_mean")) * (F.col(value) - F.col("_mean"))).alias("_d"))
    scale = own.agg(F.avg("_d").alias("_scale"))  # one row
    scaled = own.join(F.broadcast(scale), how="cross").withColumn("deviation", F.try_divide("_d", "_scale"))
    return scaled.select(trial, "deviation", (F.col("deviation") > criterion).alias("outlier"))


def interpolate_channels(data: DataFrame, bad: list[int], neighbours: DataFrame, by: list[str]) -> DataFrame:
    """Bad channels as means of their good neighbours, weighted by 1 / distance; neighbours(chan, near, distance)."""
    pairs = neighbours.where(F.col("chan").isin(bad) & ~F.col("near").isin(bad)).where("distance > 0")
    good = data.where(~F.col("chan").isin(bad))
    made = good.withColumnRenamed("chan", "near").join(pairs, "near").groupBy(*by, "chan")
    made = made.agg((F.sum(F.col("value") / F.col("distance")) / F.sum(1 / F.col("distance"))).alias("value"))
    return good.select(*by, "chan", "value").unionByName(made)


def morton(row: Column, col: Column, bits: int = 16) -> Column:
    """The place of a cell in Z order: the bits of row and col in turn."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        bit = lambda x: F.shiftright(x.cast("long"), k).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(bit(col), 2 * k)).bitwiseOR(F.shiftleft(bit(row), 2 * k + 1))
    return out


def peak_sign(data: DataFrame, by: list[str], t: str = "t_idx", value: str = "value") -> DataFrame:
    """(by, sign) of the value of largest magnitude; of ties the first."""
    return data.groupBy(*by).agg(F.signum(F.max_by(value, F.struct(F.abs(value), -F.col(t)))).alias("sign"))


def cross_correlation(data: DataFrame, lags: list[int], by: list[str], x: str = "x", y: str = "y", t: str = "t") -> DataFrame:
    """(by, lag, r, n): correlation of x with y that many samples later."""
    w = Window.partitionBy(*by).orderBy(t)
    later = [F.struct(F.lit(s).alias("lag"), F.lead(y, s).over(w).alias("later")) for s in lags]
    long = data.select(*by, x, F.array(*later).alias("_l")).select(*by, x, F.inline("_l")).where("later is not null")
    return long.groupBy(*by, "lag").agg(F.corr(x, "later").alias("r"), F.count(F.lit(1)).alias("n"))


def relative_shift(data: DataFrame, shift: int, by: list[str], x: str = "x", y: str = "y", t: str = "t") -> DataFrame:
    """x and the y of ``shift`` samples later, where both are."""
    return data.withColumn(y, F.lead(y, shift).over(Window.partitionBy(*by).orderBy(t))).where(F.col(y).isNotNull())


def discriminability(data: DataFrame, by: list[str], label: str, first: int, second: int, value: str = "value") -> DataFrame:
    """(by, d): distance of two classes' means in units of the root of their mean variance."""
    of = lambda f, k: f(F.when(F.col(label) == k, F.col(value)))
    m = data.groupBy(*by).agg(of(F.avg, first).alias("m1"), of(F.avg, second).alias("m2"), of(F.var_samp, first).alias("v1"), of(F.var_samp, second).alias("v2"))
    return m.select(*by, F.try_divide(F.abs(F.col("m1") - F.col("m2")), F.sqrt((F.col("v1") + F.col("v2")) / 2)).alias("d"))


def trends(data: DataFrame, width: int, step: int, slope: float, fit: float, by: list[str], t: str = "t_idx", value: str = "value") -> DataFrame:
    """(by, start, slope, r2, rejected): linear trends in sliding windows of ``width`` samples, ``step`` apart."""
    w = Window.partitionBy(*by).orderBy(t).rowsBetween(0, width - 1)
    own = data.withColumns({"slope": F.regr_slope(value, t).over(w), "r2": F.regr_r2(value, t).over(w), "_n": F.count(F.lit(1)).over(w)})
    own = own.where((F.col("_n") == width) & ((F.col(t) - 1) % step == 0))
    return own.select(*by, F.col(t).alias("start"), "slope", "r2", ((F.abs(F.col("slope")) >= slope) & (F.col("r2") >= fit)).alias("rejected"))


def spatial_difference(data: DataFrame, front: list[int], back: list[int], by: list[str]) -> DataFrame:
    """(by, difference): |mean of the front channels| minus |mean of the back channels|, both over all their samples."""
    mean = lambda channels: F.avg(F.when(F.col("chan").isin(channels), F.col("value")))
    return data.groupBy(*by).agg((F.abs(mean(front)) - F.abs(mean(back))).alias("difference"))


def standardise(data: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """z scores with the sample deviation; nulls and NaN take no part and stay null."""
    x = F.nullif(F.col(value), F.lit(float("nan")))
    w = Window.partitionBy(*by)
    return data.withColumn("z", F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w)))


def explained(pairs: DataFrame, by: list[str], observed: str, fitted: str) -> DataFrame:
    """(by, r2, rmse): explained share, 0 at least, and root mean square error; pairs with a null drop out."""
    y, f = F.col(observed), F.col(fitted)
    own = pairs.where(y.isNotNull() & f.isNotNull()).groupBy(*by).agg(F.avg((y - f) * (y - f)).alias("_e"), F.var_pop(y).alias("_v"))
    return own.select(*by, F.greatest(F.lit(0.0), 1 - F.try_divide("_e", "_v")).alias("r2"), F.sqrt("_e").alias("rmse"))


def joint_density(pairs: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], n: int) -> DataFrame:
    """(bx, by, n): counts in n by n equal cells; values outside fall into cells 0 and n + 1."""
    cell = lambda c, r: F.expr(f"width_bucket({c}, {float(r[0])}D, {float(r[1])}D, {n})")
    return pairs.groupBy(cell(x, x_range).alias("bx"), cell(y, y_range).alias("by")).agg(F.count(F.lit(1)).alias("n"))
