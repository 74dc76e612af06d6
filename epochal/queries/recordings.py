"""Queries over long recordings: the embeddings row after row as one channel, or as 64 channels of one sample each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.functions import filters
from epochal.operators import recordings
from epochal.registry import entry, rounded
from epochal.sources.adapters import samples

TAPS = filters.fir(40, [0, 0.2, 0.3, 1], [1, 1, 0, 0])
B, A = filters.butterworth(1, 0.2, 0.5)
RATE, STEP, SIZE = 250.0, 25, 4096
HANN = recordings.tapers([6.0, 10.0, 20.0, 30.0], RATE, multitaper=False)
SLEPIAN = recordings.tapers([40.0, 60.0, 90.0], RATE, multitaper=True)


def one_channel(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select(F.lit("all").alias("rec"), (F.col("trial_id") * 64 + F.col("t_idx") - 1).alias("t"), "value")


def channels(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select(F.col("t_idx").alias("chan"), F.col("trial_id").alias("t"), "value")


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(repr(float(v)) if isinstance(v, float) else str(v) for v in row) + ")" for row in rows)


LINE = "r AS (SELECT vec_id * 64 + i - 1 AS t, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, generate_series(1, 64) AS g(i))"
KERNEL = f"h(k, w) AS ({_values(list(enumerate(map(float, TAPS))))})"


@entry("fir_filter", f"WITH {LINE}, {KERNEL}, o AS (SELECT r.t + k AS t, sum(w * x) AS y FROM r, h GROUP BY 1) SELECT 'all' AS rec, r.t, {rounded('y', 'value')} FROM r JOIN o USING (t)")
def _(spark, d):
    return recordings.fir(one_channel(spark, d), TAPS, ["rec"], SIZE)


@entry(
    "fir_zero_phase",
    f"""WITH {LINE}, e AS (SELECT max(t) AS hi, arg_min(x, t) AS first, arg_max(x, t) AS last FROM r),
l AS (SELECT t, x FROM r UNION ALL SELECT -t, 2 * first - x FROM r, e WHERE t BETWEEN 1 AND 41 UNION ALL SELECT 2 * hi - t, 2 * last - x FROM r, e WHERE t BETWEEN hi - 41 AND hi - 1), {KERNEL},
f AS (SELECT l.t + k AS t, sum(w * x) AS y FROM l, h GROUP BY 1), b AS (SELECT f.t - k AS t, sum(w * y) AS y FROM f, h GROUP BY 1)
SELECT 'all' AS rec, r.t, {rounded('y', 'value')} FROM r JOIN b USING (t)""",
)
def _(spark, d):
    return recordings.fir_zero_phase(one_channel(spark, d), TAPS, ["rec"], SIZE)


def _recursion(name: str, source: str, edge: str) -> str:
    """The second-order recursion in direct form from the row after -1 on; ``edge`` is what stands before the first."""
    b, a = [float(v) for v in B], [float(v) for v in A]
    step = f"({b[0]!r} * s.x + {b[1]!r} * z.x1 + {b[2]!r} * z.x2 - ({a[1]!r}) * z.y1 - ({a[2]!r}) * z.y2)"
    return f"""{name}0 AS (SELECT chan, n, x FROM {source}),
{name}(chan, n, x1, x2, y1, y2) AS (SELECT chan, CAST(-1 AS BIGINT), {edge}, {edge}, {edge} * {sum(b) / sum(a)!r}, {edge} * {sum(b) / sum(a)!r} FROM {name}0 WHERE n = 0
UNION ALL SELECT s.chan, s.n, s.x, z.x1, {step}, z.y1 FROM {name} z JOIN {name}0 s ON s.chan = z.chan AND s.n = z.n + 1)"""


MANY = "r AS (SELECT i AS chan, vec_id AS t, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, generate_series(1, 64) AS g(i))"


@entry("iir_filter", f"WITH RECURSIVE {MANY}, q AS (SELECT chan, t AS n, x FROM r), {_recursion('z', 'q', 'CAST(0 AS DOUBLE)')} SELECT chan, n AS t, {rounded('y1', 'value')} FROM z WHERE n >= 0")
def _(spark, d):
    return recordings.iir(channels(spark, d), B, A, ["chan"], 128)


@entry(
    "iir_zero_phase",
    f"""WITH RECURSIVE {MANY}, e AS (SELECT chan, max(t) AS hi, arg_min(x, t) AS first, arg_max(x, t) AS last FROM r GROUP BY 1),
l AS (SELECT chan, t, x FROM r UNION ALL SELECT chan, -t, 2 * first - x FROM r JOIN e USING (chan) WHERE t BETWEEN 1 AND 6 UNION ALL SELECT chan, 2 * hi - t, 2 * last - x FROM r JOIN e USING (chan) WHERE t BETWEEN hi - 6 AND hi - 1),
q AS (SELECT chan, t + 6 AS n, x FROM l), {_recursion('z', 'q', 'x')},
p AS (SELECT chan, max(n) OVER (PARTITION BY chan) - n AS n, y1 AS x FROM z WHERE n >= 0), {_recursion('y', 'p', 'x')}
SELECT y.chan, hi + 6 - n AS t, {rounded('y1', 'value')} FROM y JOIN e ON e.chan = y.chan WHERE n >= 6 AND n <= hi + 6""",
)
def _(spark, d):
    return recordings.iir_zero_phase(channels(spark, d), B, A, ["chan"], 128)


def _power_sql(windows: dict[float, np.ndarray]) -> str:
    rows = [(f, k, j, own.shape[1], float(v)) for f, own in windows.items() for k, taper in enumerate(own) for j, v in enumerate(taper)]
    turn = f"2 * pi() * freq / {RATE} * (j - (n - 1) / 2.0)"
    return f"""WITH {LINE}, e AS (SELECT max(t) + 1 AS len FROM r), h(freq, k, j, n, w) AS ({_values(rows)}),
p AS (SELECT DISTINCT freq, k, n, t FROM h, r, e WHERE t % {STEP} = 0 AND t + 1 >= n / 2.0 AND t + 1 < len - n / 2.0),
s AS (SELECT freq, p.k, p.n, p.t, sum(w * x * cos({turn})) AS re, sum(w * x * sin({turn})) AS im FROM p JOIN h USING (freq, k, n) JOIN r ON r.t = p.t - (n + 1) // 2 + 1 + j GROUP BY ALL)
SELECT 'all' AS rec, CAST(freq AS DOUBLE) AS freq, t, {rounded('avg(re * re + im * im) * 2 / any_value(n)', 'power')} FROM s GROUP BY freq, t"""


@entry("sliding_hann_power", _power_sql(HANN))
def _(spark, d):
    return recordings.sliding_power(one_channel(spark, d), ["rec"], RATE, HANN, STEP, SIZE)


@entry("sliding_multitaper_power", _power_sql(SLEPIAN))
def _(spark, d):
    return recordings.sliding_power(one_channel(spark, d), ["rec"], RATE, SLEPIAN, STEP, SIZE)
