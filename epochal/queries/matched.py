"""Queries of fold roles and of scores that are matched by trial."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.operators import design, group
from epochal.registry import KEY, entry, rounded
from epochal.sources.adapters import epochs, table

TRAIN, TEST, FOLDS = {1: [0, 1], 2: [2, 3, 4]}, {1: [1, 5], 2: [3, 4, 6, 7]}, 4


@entry(
    "fold_roles",
    f"""WITH c(class, part, code) AS (VALUES (1, 'common', 1), (1, 'train', 0), (1, 'test', 5), (2, 'common', 3), (2, 'common', 4), (2, 'train', 2), (2, 'test', 6), (2, 'test', 7)),
d AS (SELECT vec_id, class, part, row_number() OVER (PARTITION BY class, part ORDER BY {KEY}) AS r, count(*) OVER (PARTITION BY class, part) AS n FROM embeddings JOIN c ON label = code),
o AS (SELECT *, (SELECT min(f) FROM generate_series(1, {FOLDS}) AS g(f) WHERE r <= ROUND(CAST(f AS DOUBLE) * n / {FOLDS})) AS own FROM d)
SELECT vec_id AS trial_id, class, fold, CASE WHEN fold = own THEN 'test' ELSE 'train' END AS role FROM o, generate_series(1, {FOLDS}) AS h(fold) WHERE (fold = own AND part <> 'train') OR (fold <> own AND part <> 'test')""",
)
def _(spark, d):
    return design.fold_roles(epochs(spark, d), TRAIN, TEST, FOLDS)


@entry(
    "confidence_matched",
    f"""WITH l AS (SELECT o_orderpriority AS cond, o_custkey % 40 AS subject, CAST(o_totalprice AS DOUBLE) AS x, CAST(dayofyear(o_orderdate) AS DOUBLE) AS y, dayofweek(o_orderdate) AS code FROM orders)
SELECT cond, subject, {rounded('CASE WHEN NOT isnan(corr(x, y) FILTER (code <= 4)) THEN corr(x, y) FILTER (code <= 4) END', 'r')}, count(*) FILTER (code <= 4) AS n, count(*) FILTER (code <= 4) < 0.8 * count(*) AS few FROM l GROUP BY 1, 2 HAVING count(*) FILTER (code <= 4) > 0""",
)
def _(spark, d):
    at = F.col("o_orderdate")
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("cond"), (F.col("o_custkey") % 40).alias("subject"), F.col("o_orderkey").alias("trial_id"), (F.dayofweek(at) - 1).alias("event_code"), F.col("o_totalprice").cast("double").alias("price"), F.dayofyear(at).cast("double").alias("day"))
    scores = lambda c: t.select("cond", "subject", "trial_id", "event_code", F.col(c).alias("score"))
    return group.matched_correlation(scores("price"), scores("day").where("event_code <= 4"), ["cond", "subject"]).select("cond", "subject", "r", "n", "few")
