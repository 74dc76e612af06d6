"""Queries of the circular operators: differences, medians and their tests, two factors, von Mises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.operators import circ
from epochal.registry import chi2_upper_sql, entry, f_upper_sql, normal_sql, rounded
from epochal.sources.adapters import table

_R = rounded


def _angles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("h"), (2 * F.pi() * F.dayofyear("o_orderdate") / F.lit(366.0)).alias("alpha"), F.col("o_orderkey").alias("k"))


def _narrow(spark: SparkSession, d: str) -> DataFrame:
    return _angles(spark, d).withColumn("alpha", F.col("alpha") * 183.0 / F.pi() / 200.0)


_A = "a AS (SELECT o_orderpriority AS g, o_orderstatus AS h, 2 * pi() * dayofyear(o_orderdate) / 366.0 AS alpha, o_orderkey AS k FROM orders)"
_N = "a AS (SELECT o_orderpriority AS g, o_orderstatus AS h, dayofyear(o_orderdate) / 200.0 AS alpha, o_orderkey AS k FROM orders)"
_WRAP = "(({x}) - 2 * pi() * floor(({x}) / (2 * pi())))"


def _wrap(x: str) -> str:
    return _WRAP.format(x=x)


@entry("circ_dist", f"WITH {_A} SELECT k, {_R('atan2(sin(alpha - 1.5), cos(alpha - 1.5))', 'value')} FROM a")
def _(spark, d):
    return _angles(spark, d).withColumn("to", F.lit(1.5)).select("k", circ.difference("alpha", "to").alias("value"))


@entry("circ_dist2", f"WITH {_A}, m AS (SELECT g, atan2(sum(sin(alpha)), sum(cos(alpha))) AS alpha FROM a GROUP BY 1) SELECT x.g AS i, y.g AS j, {_R('atan2(sin(x.alpha - y.alpha), cos(x.alpha - y.alpha))', 'value')} FROM m x, m y")
def _(spark, d):
    means = circ.describe(_angles(spark, d), ["g"]).select("g", F.col("mu").alias("alpha"))
    return circ.differences(means, means, "g")


@entry("circ_axial", f"WITH {_A} SELECT k, {_R(_wrap('alpha * 3'), 'value')}, {_R('degrees(alpha)', 'degrees')}, {_R('radians(degrees(alpha) / 2)', 'radians')} FROM a")
def _(spark, d):
    return _angles(spark, d).select("k", circ.axial("alpha", 3).alias("value"), F.degrees("alpha").alias("degrees"), F.radians(F.degrees("alpha") / 2).alias("radians"))


_KAPPA = "CASE WHEN r < 0.53 THEN 2 * r + pow(r, 3) + 5 * pow(r, 5) / 6 WHEN r < 0.85 THEN -0.4 + 1.39 * r + 0.43 / (1 - r) ELSE 1 / (pow(r, 3) - 4 * r * r + 3 * r) END"


@entry("circ_vmpar", f"WITH {_N}, m AS (SELECT g, sqrt(sum(sin(alpha)) ** 2 + sum(cos(alpha)) ** 2) / count(*) AS r, atan2(sum(sin(alpha)), sum(cos(alpha))) AS mu FROM a GROUP BY 1) SELECT g, {_R('mu', 'mu')}, {_R(_KAPPA, 'kappa')} FROM m")
def _(spark, d):
    return circ.von_mises(_narrow(spark, d), ["g"])


@entry("circ_vmpdf", f"WITH {_N}, m AS (SELECT g, sqrt(sum(sin(alpha)) ** 2 + sum(cos(alpha)) ** 2) / count(*) AS r, atan2(sum(sin(alpha)), sum(cos(alpha))) AS mu FROM a GROUP BY 1), q AS (SELECT g, mu, {_KAPPA} AS kappa FROM m), i AS (SELECT *, (SELECT sum(exp(2 * jj * ln(kappa / 2) - 2 * lgamma(jj + 1.0))) FROM generate_series(0, 60) AS series(jj)) AS i0 FROM q) SELECT k, {_R('exp(kappa * cos(alpha - mu)) / (2 * pi() * i0)', 'density')} FROM a JOIN i USING (g)")
def _(spark, d):
    data = _narrow(spark, d)
    return circ.von_mises_density(data.join(F.broadcast(circ.von_mises(data, ["g"])), "g")).select("k", "density")  # a row for each group


def _median_sql(by: str) -> str:
    """med(by, med): the two-candidate rule, on angles counted by value."""
    w = _wrap("y.v - x.v")
    return f"""v AS (SELECT {by}, ROUND({_wrap("alpha")}, 9) AS v, count(*) AS k FROM a GROUP BY 1, 2),
u AS (SELECT x.{by}, x.v, x.k, abs(sum(CASE WHEN {w} < 1e-8 OR abs({w} - pi()) < 1e-8 THEN 0 WHEN {w} < pi() THEN y.k ELSE -y.k END)) AS d, sum(y.k) AS n FROM v x JOIN v y ON x.{by} = y.{by} GROUP BY 1, 2, 3),
f AS (SELECT *, COALESCE(sum(k) OVER (PARTITION BY {by} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT * FROM u QUALIFY d = min(d) OVER (PARTITION BY {by}))),
c AS (SELECT {by}, v, least(k, CASE WHEN n % 2 = 1 THEN 1 ELSE 2 END - before) AS take FROM f),
mm AS (SELECT {by}, atan2(sum(take * sin(v)), sum(take * cos(v))) AS md FROM c WHERE take > 0 GROUP BY 1),
mu AS (SELECT {by}, atan2(sum(sin(alpha)), sum(cos(alpha))) AS mu FROM a GROUP BY 1),
med AS (SELECT {by}, CASE WHEN abs(atan2(sin(mu - md), cos(mu - md))) > pi() / 2 THEN {_wrap("md + pi()")} ELSE md END AS med FROM mm JOIN mu USING ({by}))"""


@entry("circ_median", f"WITH {_A}, {_median_sql('g')} SELECT g, {_R('med', 'median')} FROM med")
def _(spark, d):
    return circ.median(_angles(spark, d), ["g"])


@entry("circ_medtest", f"WITH {_A}, x AS (SELECT g, atan2(sin(alpha - 1.5), cos(alpha - 1.5)) AS d FROM a), c AS (SELECT g, count(*) FILTER (d < 0) AS below, count(*) FILTER (d > 0) AS above, count(*) AS n FROM x GROUP BY 1) SELECT g, below, above, CASE WHEN below = above THEN 1.0 ELSE ROUND((SELECT sum(exp(lgamma(n + 1.0) - lgamma(jj + 1.0) - lgamma(n - jj + 1.0) - n * ln(2.0))) FROM generate_series(0, 100000) AS series(jj) WHERE jj <= n AND (jj <= least(below, above) OR jj >= greatest(below, above))), 6) + 0.0 END AS p FROM c")
def _(spark, d):
    return circ.median_test(_angles(spark, d), ["g"], 1.5)


@entry(
    "circ_symtest",
    f"""WITH {_A}, {_median_sql('g')}, x AS (SELECT a.g, ROUND(atan2(sin(alpha - med), cos(alpha - med)), 9) AS d FROM a JOIN med ON a.g = med.g),
r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY g, abs(d)) AS k FROM x WHERE d <> 0),
s AS (SELECT g, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, CAST(count(*) AS DOUBLE) AS n, sum(CAST(k AS DOUBLE) * k - 1) AS ties FROM r GROUP BY 1),
z AS (SELECT g, w, (w - n * (n + 1) / 4 - 0.5 * sign(w - n * (n + 1) / 4)) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s) SELECT g, {_R('w', 'w')}, {_R('z', 'z')}, {_R('2 * (1 - ' + normal_sql('abs(z)') + ')', 'p')} FROM z""",
)
def _(spark, d):
    return circ.symmetry_test(_angles(spark, d), ["g"])


@entry(
    "circ_cmtest",
    f"""WITH b AS (SELECT 1 AS one, o_orderpriority AS g, 2 * pi() * dayofyear(o_orderdate) / 366.0 AS alpha FROM orders), a AS (SELECT * FROM b), {_median_sql('one')},
x AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (atan2(sin(alpha - med), cos(alpha - med)) < 0) AS DOUBLE) AS m, max(med) AS median FROM b, med GROUP BY 1),
t AS (SELECT sum(n) AS n, sum(m) AS m, sum(m * m / n) AS q, count(*) - 1 AS df, max(median) AS median FROM x), p AS (SELECT n * n / (m * (n - m)) * q - n * m / (n - m) AS statistic, CAST(df AS DOUBLE) AS df, median FROM t)
SELECT {_R('statistic', 'statistic')}, df, {_R('median', 'median')}, {_R(chi2_upper_sql('statistic', 'df'), 'p')} FROM p""",
)
def _(spark, d):
    return circ.common_median_test(_angles(spark, d), "g")


def _two_way_sql(angles: str, concentrated: bool) -> str:
    effects = "('first', e1, p - 1), ('second', e2, q - 1), ('interaction', e3, (p - 1) * (q - 1))"
    head = f"""WITH {angles}, c AS (SELECT g, h, count(*) AS n, sum(cos(alpha)) AS c, sum(sin(alpha)) AS s FROM a GROUP BY 1, 2),
l AS (SELECT (SELECT sum((c * c + s * s) / n) FROM c) AS cc, (SELECT sum((x.c * x.c + x.s * x.s) / x.n) FROM (SELECT sum(c) AS c, sum(s) AS s, sum(n) AS n FROM c GROUP BY g) x) AS pp, (SELECT sum((x.c * x.c + x.s * x.s) / x.n) FROM (SELECT sum(c) AS c, sum(s) AS s, sum(n) AS n FROM c GROUP BY h) x) AS qq,
 (SELECT (sum(c) ** 2 + sum(s) ** 2) / sum(n) FROM c) AS tt, (SELECT CAST(sum(n) AS DOUBLE) FROM c) AS n, (SELECT CAST(count(DISTINCT g) AS DOUBLE) FROM c) AS p, (SELECT CAST(count(DISTINCT h) AS DOUBLE) FROM c) AS q),
k AS (SELECT *, sqrt(tt / n) AS r, pp - tt AS e1, qq - tt AS e2, cc - pp - qq + tt AS e3 FROM l), b AS (SELECT *, {_KAPPA} AS kappa FROM k)"""
    if concentrated:
        return f"""{head}, w AS (SELECT *, p * q * (n / (p * q) - 1) AS rdf, 1 / (1 - 1 / (5 * kappa) - 1 / (10 * kappa * kappa)) AS beta FROM b),
f AS (SELECT effect, CASE WHEN effect = 'interaction' THEN 1 ELSE beta END * e / df1 / ((n - cc) / rdf) AS statistic, df1, rdf AS df2 FROM w, LATERAL (VALUES {effects}) AS x(effect, e, df1))
SELECT effect, {_R('statistic', 'statistic')}, df1, {_R('df2', 'df2')}, {_R(f_upper_sql('statistic', 'df1', 'df2'), 'p')} FROM f"""
    bessel = lambda order: f"(SELECT sum(exp((2 * jj + {order}) * ln(kappa / 2) - lgamma(jj + 1.0) - lgamma(jj + 1.0 + {order}))) FROM generate_series(0, 60) AS series(jj))"
    return f"""{head}, w AS (SELECT *, 2 / (1 - pow({bessel(1)} / {bessel(0)}, 2)) AS f FROM b),
f AS (SELECT effect, f * e AS statistic, df * CASE WHEN effect = 'interaction' THEN 1 ELSE 2 END AS df1 FROM w, LATERAL (VALUES {effects}) AS x(effect, e, df))
SELECT effect, {_R('statistic', 'statistic')}, df1, CAST(NULL AS DOUBLE) AS df2, {_R(chi2_upper_sql('statistic', 'df1'), 'p')} FROM f"""


@entry("circ_hktest", _two_way_sql(_A, False))
def _(spark, d):
    return circ.two_way(_angles(spark, d), "g", "h")


@entry("circ_hktest_concentrated", _two_way_sql("a AS (SELECT o_orderpriority AS g, o_orderstatus AS h, dayofyear(o_orderdate) / 400.0 AS alpha FROM orders)", True))
def _(spark, d):
    return circ.two_way(_narrow(spark, d).withColumn("alpha", F.col("alpha") / 2), "g", "h")
