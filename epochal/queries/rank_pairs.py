"""Queries of statistics over all pairs of a group's values."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.operators import pairs
from epochal.registry import entry, rounded
from epochal.sources.adapters import table


@entry(
    "kendall_tau",
    f"""WITH c AS (SELECT o_orderstatus AS status, dayofweek(o_orderdate) AS x, CAST(round(o_totalprice / 4000) AS BIGINT) AS y, count(*) AS c FROM orders GROUP BY 1, 2, 3),
p AS (SELECT a.status, sum(CAST(a.c AS DOUBLE) * b.c * sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(CAST(a.c AS DOUBLE) * b.c * (a.x <> b.x)::INT) AS nx, sum(CAST(a.c AS DOUBLE) * b.c * (a.y <> b.y)::INT) AS ny FROM c a JOIN c b ON a.status = b.status GROUP BY 1),
n AS (SELECT status, sum(c) AS n FROM c GROUP BY 1)
SELECT status, CAST(n AS BIGINT) AS n, {rounded('CASE WHEN nx > 0 AND ny > 0 THEN s / (sqrt(nx) * sqrt(ny)) END', 'tau')} FROM n JOIN p USING (status)""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.dayofweek("o_orderdate").alias("x"), F.round(F.col("o_totalprice") / 4000).cast("long").alias("y"))
    return pairs.kendall(orders, ["status"], "x", "y")


@entry(
    "medcouple_skewness",
    f"""WITH e AS (SELECT event_type, value AS v, median(value) OVER (PARTITION BY event_type) AS m FROM events),
k AS (SELECT event_type, count(*) AS k FROM e WHERE v = m GROUP BY 1),
h AS (SELECT a.event_type, ((a.v - a.m) - (a.m - b.v)) / (a.v - b.v) AS h FROM e a JOIN e b ON a.event_type = b.event_type AND a.v >= a.m AND b.v <= b.m AND a.v <> b.v
UNION ALL SELECT event_type, CASE WHEN i < j THEN -1.0 WHEN i = j THEN 0.0 ELSE 1.0 END FROM k, generate_series(1, k) AS p(i), generate_series(1, k) AS q(j))
SELECT event_type, {rounded('median(h)', 'medcouple')} FROM h GROUP BY 1""",
)
def _(spark, d):
    return pairs.medcouple(table(spark, d, "events"), ["event_type"], "value")
