"""Operators on whole trials: high-frequency bursts of muscles, and splines through few points.

A trial is a row (trial, chan, x) with an array of samples, so Python works on one bounded array; what compares trials
with each other (means and deviations of a channel, sums over channels, runs of samples) is Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.functions import filters
from epochal.operators.group import runs_over
from epochal.operators.recordings import Recursive, convolved


def mapped(trials: DataFrame, change: Callable[[np.ndarray], np.ndarray], x: str = "x") -> DataFrame:
    """The trials with each array changed; null arrays stay null."""
    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == x else f.dataType.simpleString()}" for f in trials.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if v is None else change(np.array(v, dtype=float)).tolist() for v in batch.column(x).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())) if c == x else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return trials.mapInArrow(work, schema)


@lru_cache(maxsize=32)
def _model(b: tuple[float, ...], a: tuple[float, ...], size: int) -> Recursive:
    return Recursive(np.array(b), np.array(a), size)


def zero_phase(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The recursive filter forwards and backwards, from steady states, over the array and its odd reflection."""
    n = min(3 * (len(a) - 1), len(x) - 1)
    y = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]]) if n > 0 else x
    model = _model(tuple(b), tuple(a), 1 << (len(y) - 1).bit_length())  # one serves all arrays up to its size
    for _ in range(2):
        y = (convolved(y - y[0], model.impulse[: len(y)])[: len(y)] + y[0] * model.b.sum() / model.a.sum())[::-1]
    return y[n : n + len(x)]


def envelope(x: np.ndarray) -> np.ndarray:
    """The magnitude of the analytic signal."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * gain))


def moving_mean(x: np.ndarray, width: int) -> np.ndarray:
    """The mean of ``width`` samples around each one, of as many as there are at the ends."""
    width = max(1, width)
    sums = np.convolve(x, np.ones(width))
    counts = np.convolve(np.ones(len(x)), np.ones(width))
    first = width // 2
    return (sums / counts)[first : first + len(x)]


def _activity(trials: DataFrame, rate: float, low: float = 110.0, high: float = 140.0, order: int = 6, seconds: float = 0.2) -> DataFrame:
    """(trial, z): as ``muscle_activity``, an array for each trial; its channels meet as arrays, so no sample travels by itself."""
    if low >= rate / 2:
        raise ValueError("the sampling rate is too low for this band")
    b, a = filters.butterworth(order, 2 * low / rate, 2 * min(high, np.floor(rate / 2) - 1) / rate)
    width = int(round(seconds * rate))
    smooth = mapped(trials.select("trial", "chan", "x"), lambda x: moving_mean(envelope(zero_phase(x, b, a)), width))
    facts = smooth.select("chan", F.explode("x").alias("v")).groupBy("chan").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    z = smooth.join(F.broadcast(facts), "chan").select("trial", F.transform("x", lambda v: F.try_divide(v - F.col("m"), F.col("s"))).alias("z"))  # a row for each channel
    none = F.array().cast("array<struct<s: double, n: bigint>>")
    one = lambda v: F.struct(F.coalesce(v, F.lit(0.0)).alias("s"), F.when(v.isNull(), 0).otherwise(1).cast("bigint").alias("n"))
    sums = lambda acc, v: F.zip_with(acc, v, lambda p, q: F.when(p.isNull(), one(q)).otherwise(F.struct((p["s"] + F.coalesce(q, F.lit(0.0))).alias("s"), (p["n"] + F.when(q.isNull(), 0).otherwise(1)).alias("n"))))
    met = z.groupBy("trial").agg(F.collect_list("z").alias("z")).select("trial", F.aggregate("z", none, sums).alias("z"))
    return met.select("trial", F.transform("z", lambda v: F.when(v["n"] > 0, v["s"] / F.sqrt(v["n"]))).alias("z"))


def muscle_activity(trials: DataFrame, rate: float, low: float = 110.0, high: float = 140.0, order: int = 6, seconds: float = 0.2) -> DataFrame:
    """(trial, t, z): band-passed envelopes, smoothed, as z scores of their channel, summed over channels by the root of their number.

    Bands are cut at half the sampling rate; a band that lies beyond it is an error.  t counts from 0.
    """
    return _activity(trials, rate, low, high, order, seconds).select("trial", F.posexplode("z").alias("t", "z"))


def muscle_artifacts(trials: DataFrame, rate: float, cutoff: float, padding: int = 0, **band: float) -> DataFrame:
    """(trial, first, last, peak_t): runs of samples whose summed z exceeds the cutoff, but for ``padding`` samples at either end of a trial."""
    z = _activity(trials, rate, **band).select("trial", F.size("z").alias("_n"), F.posexplode("z").alias("t", "z"))
    z = z.where((F.col("t") >= padding) & (F.col("t") < F.col("_n") - padding)).drop("_n")
    return runs_over(z, ["trial"], "t", "z", cutoff).where("sign > 0").select("trial", "first", "last", "peak_t")


def without_muscle(trials: DataFrame, rate: float, cutoff: float, padding: int = 0, **band: float) -> DataFrame:
    """The trials without an artifact."""
    return trials.join(muscle_artifacts(trials, rate, cutoff, padding, **band).select("trial").distinct(), "trial", "left_anti")


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The interpolating cubic spline whose third derivative is continuous at the second knots from either end."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m, r = np.zeros((n, n)), np.zeros(n)
    for k in range(1, n - 1):
        m[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        r[k] = 6 * (d[k] - d[k - 1])
    m[0, :3] = h[1], -(h[0] + h[1]), h[0]
    m[-1, -3:] = h[-1], -(h[-1] + h[-2]), h[-2]
    c = np.linalg.solve(m, r)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u, v = at - x[k], x[k + 1] - at
    return (c[k] * v**3 + c[k + 1] * u**3) / (6 * h[k]) + (y[k] / h[k] - c[k] * h[k] / 6) * v + (y[k + 1] / h[k] - c[k + 1] * h[k] / 6) * u


def spline(trials: DataFrame, rate: float, first: int, last: int, frequency: float = 8.0, x: str = "x") -> DataFrame:
    """Each trial's array replaced by a spline through one sample every 1 / ``frequency`` seconds, laid so that the peak is one of them.

    The peak is the first largest value in samples first..last (from 0), or the smallest if that is larger in magnitude; ends
    are continued by a quarter of a second of reflection.
    """
    pad, step = int(round(rate / 4)), rate / frequency

    def change(y: np.ndarray) -> np.ndarray:
        own = y[first : last + 1]
        peak = first + int(own.argmax() if own.max() > abs(own.min()) else own.argmin())
        whole = np.pad(y, pad, mode="symmetric")
        knots = np.floor(np.arange(0, len(whole), step) + 0.5).astype(int)
        knots = knots - (knots[np.abs(knots - (peak + pad)).argmin()] - (peak + pad))
        knots = knots[(knots >= 0) & (knots < len(whole))]
        return cubic_spline(knots.astype(float), whole[knots], np.arange(len(whole), dtype=float))[pad : pad + len(y)]

    return mapped(trials, change, x)
