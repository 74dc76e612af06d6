"""Queries of the operators on vectors, matrices and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.operators import arrays, linear
from epochal.registry import MATRIX, SAMPLES, entry, rounded
from epochal.sources.adapters import epochs, samples, table

_R, _S = rounded, SAMPLES
_ROWS = f"{_S}, r AS (SELECT trial_id, event_code, (t_idx - 1) % 4 + 1 AS chan, (t_idx - 1) // 4 + 1 AS t, value FROM s)"


def _channels(spark: SparkSession, d: str) -> DataFrame:
    """Each trial as 16 samples of 4 channels."""
    return samples(spark, d).select("trial_id", "event_code", ((F.col("t_idx") - 1) % 4 + 1).alias("chan"), F.expr("(t_idx - 1) div 4 + 1").alias("t"), "value")


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_linenumber").alias("row"), (F.col("p_size") % 7 + 1).alias("col")).agg(F.avg("l_discount").alias("value"))


def _norm(name: str, by: list[str]) -> None:
    @entry(name, f"WITH {_ROWS} SELECT trial_id, chan, t, {_R('CASE WHEN m > 0 THEN value / m ELSE 0 END', 'value')} FROM (SELECT *, sqrt(avg(value * value) OVER (PARTITION BY {', '.join(by)})) AS m FROM r)")
    def _(spark, d):
        return arrays.normalise(_channels(spark, d), by).select("trial_id", "chan", "t", "value")


_norm("array_normrow", ["trial_id", "t"])
_norm("array_normpage", ["trial_id"])
_norm("array_normpagecol", ["trial_id", "chan"])


@entry("array_demean2", f"WITH {_ROWS} SELECT trial_id, chan, t, {_R('value - avg(value) OVER (PARTITION BY trial_id, chan)', 'value')} FROM r")
def _(spark, d):
    return arrays.weighted_demean(_channels(spark, d), ["trial_id", "chan"]).select("trial_id", "chan", "t", "value")


def _vector(how: str, sign: str) -> None:
    @entry(f"array_vec{how}", f"WITH {_S}, v AS (SELECT t_idx, avg(value) AS v FROM s WHERE event_code = 0 GROUP BY 1) SELECT trial_id, s.t_idx, {_R(f'value {sign} v', 'value')} FROM s JOIN v ON s.t_idx = v.t_idx")
    def _(spark, d):
        s = samples(spark, d)
        mean = s.where("event_code = 0").groupBy("t_idx").agg(F.avg("value").alias("value"))
        return linear.with_vector(s, mean, ["t_idx"], how).select("trial_id", "t_idx", "value")


_vector("add", "+")
_vector("mult", "*")


@entry("array_mmat", f"WITH {MATRIX} SELECT a.\"row\", b.col, {_R('sum(a.value * b.value)', 'value')} FROM m a JOIN m b ON a.col = b.\"row\" GROUP BY 1, 2")
def _(spark, d):
    return linear.matrix_product(_matrix(spark, d), _matrix(spark, d))


@entry("array_lower_to_full", f"WITH {MATRIX} SELECT \"row\", col, {_R('value', 'value')} FROM m WHERE \"row\" >= col UNION ALL SELECT col, \"row\", {_R('value', 'value')} FROM m WHERE \"row\" > col")
def _(spark, d):
    return linear.full_from_lower(_matrix(spark, d).where("row >= col"))


@entry("array_xprod2", f"WITH {_S} SELECT a.trial_id, a.t_idx AS i, b.t_idx AS j, {_R('a.value * b.value', 'value')} FROM s a JOIN s b ON a.trial_id = b.trial_id WHERE a.t_idx <= 4 AND b.t_idx > 60")
def _(spark, d):
    s = samples(spark, d)
    return linear.channel_products(s.where("t_idx <= 4"), s.where("t_idx > 60"), "trial_id")


@entry("array_chunk_index", f"WITH {_S} SELECT trial_id, (t_idx - 1) // 10 + 1 AS chunk, count(*) AS card, {_R('min(value)', 'low')}, {_R('max(value)', 'high')}, {_R('avg(value)', 'mean')}, {_R('sum(value * value)', 'ssq')} FROM s GROUP BY 1, 2")
def _(spark, d):
    return linear.chunk_index(samples(spark, d), 10, ["trial_id"])


def _boxcar_sql(n: int) -> str:
    return f"SELECT trial_id, t_idx, {n} AS width, {_R(f'l + sum(value - l) OVER (PARTITION BY trial_id ORDER BY t_idx ROWS {n - 1} PRECEDING) / {n}', 'value')} FROM (SELECT *, avg(value) FILTER (t_idx <= {n + 1}) OVER (PARTITION BY trial_id) AS l FROM s)"


@entry("smooth_from_level", f"WITH {_S} {_boxcar_sql(5)}")
def _(spark, d):
    return linear.boxcars(samples(spark, d), [5], ["trial_id"]).select("trial_id", "t_idx", "width", "value")


@entry("array_multismooth", f"WITH {_S} " + " UNION ALL ".join(_boxcar_sql(n) for n in (2, 4, 8)))
def _(spark, d):
    return linear.boxcars(samples(spark, d), [2, 4, 8], ["trial_id"]).select("trial_id", "t_idx", "width", "value")


@entry(
    "array_two_clusters",
    f"""WITH v AS (SELECT l_suppkey AS g, ROUND(l_extendedprice, 9) AS v, CAST(count(*) AS DOUBLE) AS k FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(k) OVER w AS n1, sum(k * v) OVER w AS s1, sum(k) OVER p AS n, sum(k * v) OVER p AS s, sum(k * v * v) OVER p AS q FROM v WINDOW p AS (PARTITION BY g), w AS (PARTITION BY g ORDER BY v ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, ROUND(q - s1 * s1 / n1 - (s - s1) * (s - s1) / (n - n1), 9) AS cost FROM r WHERE n1 < n) SELECT g, {_R('s1 / n1', 'low')}, {_R('(s - s1) / (n - n1)', 'high')}, n1::BIGINT AS n_low, {_R('v', 'bound')} FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY cost, v) = 1""",
)
def _(spark, d):
    return linear.two_clusters(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("value")), ["g"])


def _ragged(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).where("t_idx <= 40 + trial_id % 25")


_RAGGED = f"{_S}, q AS (SELECT * FROM s WHERE t_idx <= 40 + trial_id % 25)"


@entry("trials_padded", f"WITH {_RAGGED} SELECT x.trial_id, x.t_idx, {_R('COALESCE(q.value, 0)', 'value')}, CASE WHEN q.value IS NULL THEN 0 ELSE 1 END AS weight FROM (SELECT vec_id AS trial_id, t_idx FROM embeddings, generate_series(1, 60) AS g(t_idx)) x LEFT JOIN q ON x.trial_id = q.trial_id AND x.t_idx = q.t_idx")
def _(spark, d):
    return linear.padded_trials(_ragged(spark, d), 60, ["trial_id"])


@entry("trials_unpadded", f"WITH {_RAGGED} SELECT trial_id, t_idx, {_R('value', 'value')} FROM q WHERE t_idx <= 60")
def _(spark, d):
    return linear.weighted_trials(linear.padded_trials(_ragged(spark, d), 60, ["trial_id"]))


@entry("peak_filter", f"WITH f AS (SELECT i / 20.0 AS w, 1 / (1 + tan(i / 20.0 / 4.0 * pi() / 2)) AS g FROM generate_series(1, 19) AS s(i)) SELECT {_R('w', 'w')}, {_R('1 - g', 'b0')}, {_R('-2 * g * cos(w * pi())', 'a1')}, {_R('2 * g - 1', 'a2')} FROM f")
def _(spark, d):
    return linear.resonator(spark.range(1, 20).select((F.col("id") / F.lit(20.0)).alias("w")), 4.0)


@entry("array_cov_weighted", f"WITH {_S}, q AS (SELECT *, CASE WHEN abs(value) > 0.2 THEN 0.5 ELSE 1.0 END AS w FROM s WHERE t_idx <= 12) SELECT a.t_idx AS i, b.t_idx AS j, {_R('sum(a.value * a.w * b.value * b.w)', 'sum')}, {_R('sum(a.w * b.w)', 'weight')} FROM q a JOIN q b ON a.trial_id = b.trial_id AND a.t_idx <= b.t_idx GROUP BY 1, 2")
def _(spark, d):
    first = epochs(spark, d).withColumn("x", F.slice("x", 1, 12))
    return linear.weighted_products(first.withColumn("w", F.transform("x", lambda v: F.when(F.abs(v) > 0.2, 0.5).otherwise(1.0))))


_XY = f"{_S}, q AS (SELECT a.trial_id, a.t_idx, a.value AS x, b.value AS y FROM s a JOIN s b ON a.trial_id = b.trial_id AND b.t_idx = 65 - a.t_idx)"


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return epochs(spark, d).select("trial_id", F.posexplode(F.arrays_zip("x", F.reverse("x").alias("y"))).alias("p", "z")).select("trial_id", (F.col("p") + 1).alias("t_idx"), "z.x", "z.y")


@entry("array_tsxcov", f"WITH {_XY}, m AS (SELECT *, lead(y, 1) OVER w AS y1, lead(y, 3) OVER w AS y3 FROM q WINDOW w AS (PARTITION BY trial_id ORDER BY t_idx)), k AS (SELECT * FROM m WHERE y3 IS NOT NULL) SELECT lag, {_R('sum(v)', 'sum')}, count(*) AS n FROM (SELECT 0 AS lag, x * y AS v FROM k UNION ALL SELECT 1, x * y1 FROM k UNION ALL SELECT 3, x * y3 FROM k) GROUP BY 1")
def _(spark, d):
    return linear.shifted_products(_signals(spark, d), [0, 1, 3], ["trial_id"])


def _bootstrap_query(name: str, statistic: str, where: str) -> None:
    x, last = ("value * value", "sqrt") if statistic == "rms" else ("value", "")
    draw = "((r * 7919 + k * 104729) * 1103515245 + 12345) % 2147483648 // 65536 % n + 1"

    @entry(
        name,
        f"""WITH {_S}, q AS (SELECT * FROM s WHERE {where}), i AS (SELECT trial_id, row_number() OVER (ORDER BY trial_id) AS place FROM (SELECT DISTINCT trial_id FROM q)), n AS (SELECT count(*) AS n FROM i),
w AS (SELECT r, {draw} AS place, count(*) AS w FROM n, generate_series(0, 49) AS a(r), generate_series(0, 100000) AS b(k) WHERE k < n GROUP BY 1, 2),
e AS (SELECT t_idx, r, {last}(sum({x} * w) / sum(w)) AS v FROM q JOIN i ON q.trial_id = i.trial_id JOIN w ON w.place = i.place GROUP BY 1, 2), a AS (SELECT t_idx, {last}(avg({x})) AS value FROM q GROUP BY 1)
SELECT a.t_idx, {_R('a.value', 'value')}, {_R('sqrt(avg((v - a.value) * (v - a.value)))', 'sd')} FROM a JOIN e ON a.t_idx = e.t_idx GROUP BY a.t_idx, a.value""",
    )
    def _(spark, d):
        return linear.bootstrap(samples(spark, d).where(where), statistic, 50)


_bootstrap_query("bootstrap_mean", "mean", "event_code = 1")
_bootstrap_query("bootstrap_rms", "rms", "event_code = 1")


@entry("line_fit", f"SELECT l_returnflag, {_R('regr_slope(l_extendedprice, l_quantity)', 'slope')}, {_R('regr_intercept(l_extendedprice, l_quantity)', 'level')}, {_R('regr_r2(l_extendedprice, l_quantity)', 'r2')} FROM lineitem GROUP BY 1")
def _(spark, d):
    return linear.line_fit(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


@entry(
    "reference_regression",
    f"""WITH {_XY}, m AS (SELECT *, lag(y, 1) OVER (PARTITION BY trial_id ORDER BY t_idx) AS z FROM q), k AS (SELECT * FROM m WHERE z IS NOT NULL),
c AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz, covar_pop(y, z) AS yz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz FROM k),
b AS (SELECT *, (xy * zz - xz * yz) / (yy * zz - yz * yz) AS b1, (xz * yy - xy * yz) / (yy * zz - yz * yz) AS b2 FROM c)
SELECT trial_id, t_idx, {_R('x - mx - b1 * (y - my) - b2 * (z - mz)', 'value')} FROM k, b""",
)
def _(spark, d):
    return linear.without_reference(_signals(spark, d), [0, -1], ["trial_id"])


@entry("sensor_noise_suppression")
def _(spark, d):
    return linear.without_sensor_noise(epochs(spark, d), 8).select("trial_id", F.posexplode("x").alias("chan", "value"))


@entry("repeated_components")
def _(spark, d):
    trials = epochs(spark, d)
    filters, _ = linear.repeated_components(trials)
    return arrays.apply_filters(trials, filters[:, :2]).select("trial_id", F.posexplode("x").alias("component", "value")).groupBy("component").agg(F.avg(F.col("value") * F.col("value")).alias("power"))
