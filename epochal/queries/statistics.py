"""Queries of robust scale, scores, densities, moments, distances and dissimilarities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.operators import arrays, group, scale
from epochal.registry import MATRIX, SAMPLES, entry, rounded, t_two_sided_sql
from epochal.sources.adapters import samples, table

_R, _S = rounded, SAMPLES
_V = "v AS (SELECT l_suppkey AS g, l_extendedprice AS value, l_quantity AS y, l_discount AS w FROM lineitem)"
_MED = f"{_V}, m AS (SELECT g, median(value) AS m, count(*) AS n FROM v GROUP BY 1), d AS (SELECT v.*, m, n, abs(value - m) AS d FROM v JOIN m ON v.g = m.g)"


def _values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("y"), F.col("l_discount").alias("w"))


@entry("mean_deviation", f"WITH {_MED} SELECT g, {_R('avg(d)', 'adm')} FROM d GROUP BY 1")
def _(spark, d):
    return scale.mean_deviation(_values(spark, d), ["g"])


_MADC = "1.4826 * median(d) * CASE WHEN n > 9 THEN n / (n - 0.8) ELSE [1.0, 1.196, 1.495, 1.363, 1.206, 1.2, 1.14, 1.129, 1.107][n] END"


@entry("median_deviation", f"WITH {_MED} SELECT g, {_R('max(m)', 'location')}, {_R(f'CASE WHEN median(d) = 0 THEN max(m) ELSE {_MADC} END', 'scale')} FROM d GROUP BY g, n")
def _(spark, d):
    return scale.median_deviation(_values(spark, d), ["g"])


@entry("median_deviation_small", f"WITH v AS (SELECT l_orderkey AS g, l_extendedprice AS value FROM lineitem), m AS (SELECT g, median(value) AS m, count(*) AS n FROM v GROUP BY 1), d AS (SELECT v.*, m, n, abs(value - m) AS d FROM v JOIN m ON v.g = m.g) SELECT g, {_R('max(m)', 'location')}, ROUND(CASE WHEN median(d) = 0 THEN max(m) ELSE {_MADC} END, 3) + 0.0 AS scale FROM d GROUP BY g, n")
def _(spark, d):
    return scale.median_deviation(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_extendedprice").alias("value")), ["g"]).withColumn("scale", F.round("scale", 3))


@entry("robust_scores", f"WITH {_MED}, k AS (SELECT g, {_MADC} AS s FROM d GROUP BY g, n) SELECT d.g, {_R('(value - m) / s', 'value')} FROM d JOIN k ON d.g = k.g")
def _(spark, d):
    return scale.robust_scores(_values(spark, d), ["g"]).select("g", "value")


@entry("matrix_scores", f"WITH {MATRIX} SELECT \"row\", col, {_R('(value - (SELECT avg(value) FROM m)) / (SELECT stddev_samp(value) FROM m)', 'value')} FROM m")
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return scale.whole_scores(rows.groupBy(F.col("l_linenumber").alias("row"), (F.col("p_size") % 7 + 1).alias("col")).agg(F.avg("l_discount").alias("value")))


@entry("column_centred", f"WITH {_S} SELECT trial_id, t_idx, {_R('value - avg(value) OVER (PARTITION BY t_idx)', 'value')} FROM s")
def _(spark, d):
    return arrays.weighted_demean(samples(spark, d), ["t_idx"]).select("trial_id", "t_idx", "value")


@entry(
    "histogram",
    f"""WITH o AS (SELECT count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem), k AS (SELECT *, CAST(ROUND(1 + log2(n)) AS INT) AS k FROM o), w AS (SELECT *, (hi - lo) / k AS w FROM k),
c AS (SELECT least(CAST(floor((l_extendedprice - lo) / w) AS INT), k - 1) + 1 AS bin, count(*) AS c FROM lineitem, w GROUP BY 1), g AS (SELECT bin, lo + (bin - 0.5) * w AS x, m, v FROM w, generate_series(1, 64) AS s(bin) WHERE bin <= k)
SELECT g.bin, {_R('x', 'centre')}, COALESCE(c, 0) AS n, {_R('exp(-(x - m) * (x - m) / (2 * v)) / sqrt(2 * pi() * v)', 'density')} FROM g LEFT JOIN c ON g.bin = c.bin""",
)
def _(spark, d):
    return scale.histogram(table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("value")))


@entry("conditional", f"WITH {_V}, o AS (SELECT corr(value, y) AS r, stddev_samp(value) AS sx, stddev_samp(y) AS sy FROM v) SELECT g, {_R('r * sx * y / sy', 'x_given_y')}, {_R('r * sy * value / sx', 'y_given_x')}, {_R('((1 - r * r) * sy) ** 2', 'var_y')} FROM v, o")
def _(spark, d):
    return scale.conditional(_values(spark, d), "value", "y").select("g", "x_given_y", "y_given_x", "var_y")


@entry("weighted_covariance", f"WITH v AS (SELECT l_suppkey AS g, l_tax AS x, l_discount AS y, l_quantity AS w FROM lineitem), s AS (SELECT g, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy FROM v GROUP BY 1) SELECT g, {_R('sx / n', 'mean_x')}, {_R('sy / n', 'mean_y')}, {_R('(sxx - sx * sx / n) / (n - 1)', 'xx')}, {_R('(sxy - sx * sy / n) / (n - 1)', 'xy')}, {_R('(syy - sy * sy / n) / (n - 1)', 'yy')} FROM s")
def _(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_tax").alias("x"), F.col("l_discount").alias("y"), F.col("l_quantity").alias("w"))
    return scale.weighted_covariance(v, ["g"], "x", "y", "w")


@entry("mahalanobis", f"WITH {_V}, m AS (SELECT g, avg(value) AS mx, avg(y) AS my, var_samp(value) AS xx, covar_samp(value, y) AS xy, var_samp(y) AS yy FROM v GROUP BY 1) SELECT v.g, {_R('value', 'value')}, {_R('y', 'y')}, {_R('(yy * (value - mx) ** 2 - 2 * xy * (value - mx) * (y - my) + xx * (y - my) ** 2) / (xx * yy - xy * xy)', 'distance')} FROM v JOIN m ON v.g = m.g")
def _(spark, d):
    return scale.mahalanobis(_values(spark, d), ["g"], "value", "y").select("g", "value", "y", "distance")


@entry(
    "densest_half",
    f"""WITH e AS (SELECT user_id AS g, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) // 2 + 1 AS h FROM events),
r AS (SELECT a.g, a.i, a.h, avg(b.value) AS mean, var_samp(b.value) AS variance, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND b.i BETWEEN a.i AND a.i + a.h - 1 GROUP BY 1, 2, 3)
SELECT g, h, {_R("mean * h", "total")}, ROUND(variance, 3) + 0.0 AS variance FROM r WHERE n = h QUALIFY row_number() OVER (PARTITION BY g ORDER BY ROUND(variance, 6), i) = 1""",
)
def _(spark, d):
    return scale.densest_half(table(spark, d, "events").select(F.col("user_id").alias("g"), "value"), ["g"]).select("g", "h", (F.col("mean") * F.col("h")).alias("total"), F.round("variance", 3).alias("variance"))


@entry(
    "outliers",
    f"""WITH {_MED}, k AS (SELECT g, median(d) AS mad, list_sort(list(value)) AS s, max(n) AS n FROM d GROUP BY 1), q AS (SELECT g, mad, s, n, CAST(floor(n / 4 + 5 / 12.0) AS BIGINT) AS j, n / 4 + 5 / 12.0 - floor(n / 4 + 5 / 12.0) AS f FROM k),
b AS (SELECT g, mad, (1 - f) * s[j] + f * s[j + 1] AS lo, (1 - f) * s[n - j + 1] + f * s[n - j] AS hi FROM q)
SELECT d.g, {_R('value', 'value')}, d * 0.6745 > 2.2414 * mad AS deviation, value < lo - 1.5 * (hi - lo) OR value > hi + 1.5 * (hi - lo) AS box, d * 0.6745 > 2.2414 * mad AND (value < lo - 1.5 * (hi - lo) OR value > hi + 1.5 * (hi - lo)) AS "both" FROM d JOIN b ON d.g = b.g""",
)
def _(spark, d):
    return scale.outliers(_values(spark, d), ["g"]).select("g", "value", "deviation", "box", "both")


@entry("dissimilarities", f"WITH r AS (SELECT max(c_acctbal) - min(c_acctbal) AS r FROM customer) SELECT q.c_custkey AS i, p.c_custkey AS j, {_R('(abs(p.c_acctbal - q.c_acctbal) / r + (p.c_mktsegment <> q.c_mktsegment)::INT + (p.c_nationkey <> q.c_nationkey)::INT) / 3', 'value')} FROM customer p, customer q, r WHERE q.c_custkey % 100 = 0 AND p.c_custkey <> q.c_custkey")
def _(spark, d):
    c = table(spark, d, "customer")
    return scale.dissimilarities(c, c.where("c_custkey % 100 = 0"), "c_custkey", ["c_acctbal"], ["c_mktsegment", "c_nationkey"])


def _huber(rounds: int) -> str:
    steps = "".join(f", s{k + 1} AS (SELECT s{k}.g, max(s{k}.loc) + max(sc) * sum(CASE WHEN abs((value - loc) / sc) <= 1.5 THEN (value - loc) / sc ELSE sign(value - loc) * 1.5 END) / sum((abs((value - loc) / sc) <= 1.5)::INT) AS loc, max(sc) AS sc FROM v JOIN s{k} ON v.g = s{k}.g GROUP BY 1)" for k in range(rounds))
    return f"WITH {_MED}, s0 AS (SELECT g, max(m) AS loc, {_MADC} AS sc FROM d GROUP BY g, n){steps} SELECT g, {_R('loc', 'location')} FROM s{rounds}"


@entry("huber_location", _huber(3))
def _(spark, d):
    return scale.huber_location(_values(spark, d), ["g"], rounds=3)


def _correlation_query(kind: str, x: str, y: str) -> None:
    @entry(
        f"correlation_test_{kind}",
        f"""WITH v AS (SELECT l_returnflag AS g, {x} AS x, {y} AS y FROM lineitem), c AS (SELECT g, corr(x, y) AS r, count(*) - 2 AS df FROM v GROUP BY 1), t AS (SELECT *, r * sqrt(df / (1 - r * r)) AS t FROM c)
SELECT g, {_R('r', 'r')}, df, {_R('t', 't')}, {_R(t_two_sided_sql('t', 'df'), 'p')}, {_R('tanh(atanh(r) - 1.959963984540054 / sqrt(df - 1))', 'low')}, {_R('tanh(atanh(r) + 1.959963984540054 / sqrt(df - 1))', 'high')} FROM t""",
    )
    def _(spark, d):
        pairs = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_tax").alias("x"), F.col("l_extendedprice").alias("y"))
        return group.correlation_test(pairs, ["g"], "x", "y", kind)


_RANK = lambda c: f"rank() OVER (PARTITION BY l_returnflag ORDER BY {c}) + (count(*) OVER (PARTITION BY l_returnflag, {c}) - 1) / 2.0"
_correlation_query("pearson", "l_tax", "l_extendedprice")
_correlation_query("spearman", _RANK("l_tax"), _RANK("l_extendedprice"))
