"""Queries of cluster permutation over grids and neighbour graphs, paired and with shuffled groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.operators import clusters
from epochal.registry import entry, rounded, t_two_sided_sql
from epochal.sources.adapters import table

REPLICATES, P_CELL = 40, 0.2


def week_maps(spark: SparkSession, d: str) -> DataFrame:
    """(subject, row, col, cell, value): each user's mean value by weekday and part of the day, minus 50."""
    at = F.col("ts").cast("timestamp")
    cells = table(spark, d, "events").groupBy(F.col("user_id").alias("subject"), F.dayofweek(at).cast("long").alias("row"), F.floor(F.hour(at) / 3).cast("long").alias("col"))
    return cells.agg((F.avg("value") - 50).alias("value")).withColumn("cell", F.col("col") * 100 + F.col("row"))


def hour_ring(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(subject, cell, value, first) by hour, and a graph in which an hour's neighbours are two and three hours away, across midnight too."""
    hours = table(spark, d, "events").groupBy(F.col("user_id").alias("subject"), F.hour(F.col("ts").cast("timestamp")).cast("long").alias("cell")).agg(F.avg("value").alias("value"))
    edges = hours.select("cell").distinct().select("cell", F.explode(F.array(*[F.pmod(F.col("cell") + k, F.lit(24)) for k in (-3, -2, 2, 3)])).alias("near"))
    return hours.withColumn("first", F.col("subject") % 2 == 0), edges


HASH = "(((rep * 7919 + subject * 104729) * 1103515245 + 12345) % 2147483648)"
WEEK = "c AS (SELECT user_id AS subject, dayofweek(ts) + 1 AS r, hour(ts) // 3 AS q, q * 100 + r AS cell, avg(value) - 50 AS value FROM events GROUP BY 1, 2, 3)"
GRID = "e AS (SELECT DISTINCT a.cell, b.cell AS near FROM (SELECT DISTINCT r, q, cell FROM c) a JOIN (SELECT DISTINCT r, q, cell FROM c) b ON abs(a.r - b.r) <= 1 AND abs(a.q - b.q) <= 1 AND a.cell <> b.cell)"
RING = "c AS (SELECT user_id AS subject, hour(ts) AS cell, avg(value) AS value FROM events GROUP BY 1, 2), e AS (SELECT DISTINCT cell, (cell + k + 24) % 24 AS near FROM c, (VALUES (-3), (-2), (2), (3)) AS v(k))"
FLIPPED = f"""f AS (SELECT rep, subject, cell, CASE WHEN rep = 0 OR floor({HASH} / 65536.0) % 2 = 0 THEN 1.0 ELSE -1.0 END * value AS value FROM c, generate_series(0, {REPLICATES}) AS g(rep)),
s AS (SELECT rep, cell, count(*) - 1 AS df, avg(value) / (stddev_samp(value) / sqrt(count(*))) AS t FROM f GROUP BY 1, 2 HAVING count(*) > 1 AND stddev_samp(value) > 0)"""
SHUFFLED = f"""u AS (SELECT DISTINCT subject FROM c), o AS (SELECT rep, subject, row_number() OVER (PARTITION BY rep ORDER BY {HASH} * {HASH} % 2147483647, subject) AS place FROM u, generate_series(0, {REPLICATES}) AS g(rep)),
w AS (SELECT rep, cell, value, CASE WHEN rep = 0 THEN subject % 2 = 0 ELSE place <= (SELECT count(*) FROM u WHERE subject % 2 = 0) END AS a FROM c JOIN o USING (subject)),
m AS (SELECT rep, cell, avg(value) FILTER (a) - avg(value) FILTER (NOT a) AS d, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb, var_samp(value) FILTER (a) AS va, var_samp(value) FILTER (NOT a) AS vb FROM w GROUP BY 1, 2),
s AS (SELECT rep, cell, na + nb - 2 AS df, d / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)) AS t FROM m WHERE na > 1 AND nb > 1)"""


def _test(maps: str, stats: str, least: int, p: str, tail: str) -> str:
    level = 0.05 / 2 if tail == "both" else 0.05
    return f"""WITH RECURSIVE {maps}, {stats},
k AS (SELECT rep, cell, CAST(sign(t) AS INT) AS sign, t FROM s WHERE {p} < {P_CELL} AND t <> 0),
z(rep, sign, cell, top) AS (SELECT rep, sign, cell, cell FROM k UNION SELECT k.rep, k.sign, k.cell, z.top FROM z JOIN e ON e.cell = z.cell JOIN k ON k.rep = z.rep AND k.sign = z.sign AND k.cell = e.near),
b AS (SELECT rep, sign, cell, min(top) AS cluster FROM z GROUP BY ALL),
l AS (SELECT rep, sign, cluster, count(*) AS size, abs(sum(t)) AS mass FROM b JOIN k USING (rep, sign, cell) GROUP BY ALL HAVING count(*) >= {least}),
h AS (SELECT rep, max(ROUND(mass, 9)) AS most FROM l WHERE rep > 0 GROUP BY 1)
SELECT sign, cluster, size, {rounded('mass', 'mass')}, {rounded(f'(SELECT count(*) FROM h WHERE most > ROUND(l.mass, 9)) / {float(REPLICATES)}', 'p')}, (SELECT count(*) FROM h WHERE most > ROUND(l.mass, 9)) / {float(REPLICATES)} < {level} AS significant FROM l WHERE rep = 0"""


TWO_SIDED = t_two_sided_sql("s.t", "s.df")
UPPER = f"(CASE WHEN s.t > 0 THEN {TWO_SIDED} / 2 ELSE 1 - {TWO_SIDED} / 2 END)"


@entry("cluster_test_grid", _test(f"{WEEK}, {GRID}", FLIPPED, 1, TWO_SIDED, "both"))
def _(spark, d):
    maps = week_maps(spark, d)
    return clusters.permutation_test(maps, clusters.grid_edges(maps), REPLICATES, P_CELL)


@entry("cluster_test_masked", _test(f"{WEEK.replace('GROUP BY 1, 2, 3', 'GROUP BY 1, 2, 3 HAVING r BETWEEN 2 AND 6')}, {GRID}", FLIPPED, 1, UPPER, "right"))
def _(spark, d):
    maps = week_maps(spark, d)
    return clusters.permutation_test(maps, clusters.grid_edges(maps), REPLICATES, P_CELL, tail="right", mask=maps.where("row between 2 and 6"))


@entry("cluster_test_graph_unpaired", _test(RING, SHUFFLED, 2, TWO_SIDED, "both"))
def _(spark, d):
    hours, edges = hour_ring(spark, d)
    return clusters.permutation_test(hours, edges, REPLICATES, P_CELL, paired=False, least=2)
