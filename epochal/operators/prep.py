"""Preparation of epoched data, natively: selection, baselines, averages, subtraction, epochs and artifacts.

Data are long: (trial_id, event_code, t_idx, value), with further axes as further columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUNDLES = {"ALL": None, "ALL_NOSELECTION": None}


def parse_bundle(text: str | int | None, bundles: list[str] = ["ALL"]) -> str | list[str]:  # noqa: B006
    """A bundle's name, a number into ``bundles`` (not above 0: ALL_NOSELECTION), or a list of labels."""
    if text is None or text == "":
        return bundles[0]
    try:
        n = int(text)
        return bundles[n - 1] if n > 0 else "ALL_NOSELECTION"
    except ValueError:
        labels = [t.strip() for t in str(text).split(",")]
        return labels if len(labels) > 1 else labels[0]


def select_time(data: DataFrame, low: float, high: float, t: str = "t_idx") -> DataFrame:
    """Strictly between the limits."""
    return data.where((F.col(t) > low) & (F.col(t) < high))


def select_trials(data: DataFrame, index: DataFrame) -> DataFrame:
    """The trials of index(place, trial_id), repeats included; ``place`` is what to order them by."""
    return data.join(index, "trial_id")


def nearest(axis: DataFrame, targets: DataFrame, at: str = "t") -> DataFrame:
    """For every target(target) the axis value nearest to it; the lower of ties; beyond the ends the end.

    Targets are a stated list: it is broadcast, and each task keeps one candidate for each target.
    """
    best = F.min_by(at, F.struct(F.abs(F.col(at) - F.col("target")), F.col(at)))
    return axis.select(at).join(F.broadcast(targets.select("target").distinct()), how="cross").groupBy("target").agg(best.alias("nearest"))


_METHODS = ("absolute", "relative", "relchange", "vssum", "db")


def baseline(data: DataFrame, first: int, last: int, method: str = "absolute", by: list[str] = ["trial_id"], t: str = "t_idx", value: str = "value") -> DataFrame:  # noqa: B006
    """Replaces values by their relation to the mean over first <= t <= last of their own series (null where it would divide by 0)."""
    if method not in _METHODS:
        raise ValueError(f"unknown baseline method {method!r}")
    base = F.avg(F.when(F.col(t).between(first, last), F.col(value))).over(Window.partitionBy(*by))
    x = F.col(value)
    return data.withColumn("base", base).withColumn(value, {"absolute": x - F.col("base"), "relative": F.try_divide(x, F.col("base")), "relchange": F.try_divide(x - F.col("base"), F.col("base")), "vssum": F.try_divide(x - F.col("base"), x + F.col("base")), "db": 10 * F.log10(F.try_divide(x, F.col("base")))}[method]).drop("base")


def erp(data: DataFrame, by: list[str]) -> DataFrame:
    """Mean over trials at every sample."""
    return data.groupBy(*by, "t_idx").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


def subtract_evoked(data: DataFrame, by: str = "event_code") -> DataFrame:
    """Single trials less the mean of their class; trials of no class are dropped before."""
    return data.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(by, "t_idx")))


def subtract_pairs(data: DataFrame, first: int, second: int) -> DataFrame:
    """The k-th trial of one condition less the k-th of another, as far as both go: (k, t_idx, value)."""
    ranked = data.select("trial_id", "event_code").where(F.col("event_code").isin(first, second)).distinct().withColumn("k", F.row_number().over(Window.partitionBy("event_code").orderBy("trial_id")))
    own = data.join(ranked, ["trial_id", "event_code"])
    a = own.where(F.col("event_code") == first).select("k", "t_idx", F.col("value").alias("a"))
    b = own.where(F.col("event_code") == second).select("k", "t_idx", F.col("value").alias("b"))
    return a.join(b, ["k", "t_idx"]).select("k", "t_idx", (F.col("a") - F.col("b")).alias("value"))


def average_timebin(data: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Means of n samples around centres ceil((n + 1) / 2), + n, ...: (by, bin, value)."""
    return data.withColumn("bin", F.expr(f"(t_idx - 1) div {n} + 1")).groupBy(*by, "bin").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")).where(F.col("n") == n).drop("n")


def detrend(data: DataFrame, by: list[str] = ["trial_id"]) -> DataFrame:  # noqa: B006
    """Removes the least-squares line of each series."""
    w = Window.partitionBy(*by)
    n, st, sv = F.count(F.lit(1)).over(w), F.sum(F.col("t_idx").cast("double")).over(w), F.sum("value").over(w)
    stt, stv = F.sum(F.col("t_idx").cast("double") * F.col("t_idx")).over(w), F.sum(F.col("t_idx") * F.col("value")).over(w)
    slope = (n * stv - st * sv) / (n * stt - st * st)
    return data.withColumn("slope", slope).withColumn("level", (sv - F.col("slope") * st) / n).withColumn("value", F.col("value") - F.col("level") - F.col("slope") * F.col("t_idx")).drop("slope", "level")


def flatlines(data: DataFrame, by: list[str], least: int, jitter: float) -> DataFrame:
    """Runs of at least ``least`` steps in which neighbours differ by less than ``jitter``: (by, first, last, steps)."""
    w = Window.partitionBy(*by).orderBy("t_idx")
    flat = data.withColumn("still", F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)) < jitter, F.lit(False)))
    island = F.col("t_idx") - F.row_number().over(Window.partitionBy(*by, "still").orderBy("t_idx"))
    return flat.withColumn("island", island).where("still").groupBy(*by, "island").agg(F.min("t_idx").alias("first"), F.max("t_idx").alias("last"), F.count(F.lit(1)).alias("steps")).where(F.col("steps") >= least).drop("island")


def step_artifacts(data: DataFrame, by: list[str], half: int, threshold: float) -> DataFrame:
    """Series with a difference of two adjacent half-window means above the threshold: (by, largest)."""
    w = Window.partitionBy(*by).orderBy("t_idx")
    before, after = F.avg("value").over(w.rowsBetween(-half, -1)), F.avg("value").over(w.rowsBetween(0, half - 1))
    whole = (F.count(F.lit(1)).over(w.rowsBetween(-half, -1)) == half) & (F.count(F.lit(1)).over(w.rowsBetween(0, half - 1)) == half)
    return data.withColumn("step", F.when(whole, F.abs(after - before))).groupBy(*by).agg(F.max("step").alias("largest")).where(F.col("largest") > threshold)


def artifact_z(data: DataFrame) -> DataFrame:
    """(trial_id, z_sum): per channel z (mean and population SD over all trials), summed over the trial's channels."""
    stats = data.groupBy("t_idx").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return data.join(F.broadcast(stats), "t_idx").groupBy("trial_id").agg(F.sum(F.try_divide(F.col("value") - F.col("m"), F.col("s"))).alias("z_sum"))  # a row for each channel


def cut_epochs(events: DataFrame, samples: DataFrame, before: int, after: int, bucket: int) -> DataFrame:
    """Samples with before <= sample time - event time <= after, per event; a range join on buckets of time.

    Both have subject and time_ms; each event is sent to the buckets that its window touches, so the join
    is on equal (subject, bucket) and no subject's samples meet all its events.
    """
    lo, hi = F.expr(f"(time_ms + {before}) div {bucket}"), F.expr(f"(time_ms + {after}) div {bucket}")
    wide = events.withColumn("bucket", F.explode(F.sequence(lo, hi))).withColumnRenamed("time_ms", "event_ms")
    own = samples.withColumn("bucket", F.expr(f"time_ms div {bucket}"))
    return wide.join(own, ["subject", "bucket"]).withColumn("offset_ms", F.col("time_ms") - F.col("event_ms")).where(F.col("offset_ms").between(before, after)).drop("bucket")


def reject_intervals(samples: DataFrame, bad: DataFrame, bucket: int) -> DataFrame:
    """Samples in none of bad(subject, start_ms, stop_ms), ends included."""
    wide = bad.withColumn("bucket", F.explode(F.sequence(F.expr(f"start_ms div {bucket}"), F.expr(f"stop_ms div {bucket}"))))
    own = samples.withColumn("bucket", F.expr(f"time_ms div {bucket}"))
    hit = (own["subject"] == wide["subject"]) & (own["bucket"] == wide["bucket"]) & own["time_ms"].between(wide["start_ms"], wide["stop_ms"])
    return own.join(wide, hit, "left_anti").drop("bucket")


