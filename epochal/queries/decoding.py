"""Queries of the decoders that SQL can follow: two channels, whose covariances it inverts in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.operators import decode, design, metrics
from epochal.registry import KEY, entry, rounded
from epochal.sources.adapters import epochs

_R = rounded


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two classes in five folds; x are channels 1 and 2 at four times."""
    trials = epochs(spark, d).where("event_code in (0, 1)").withColumn("class", F.col("event_code"))
    dealt = design.folds(design.balance(trials, "class"), 5)
    times = F.posexplode(F.array(*[F.slice("x", 2 * t + 1, 2) for t in range(4)])).alias("p", "v")
    return dealt.select("trial_id", "class", "fold", "x", times).select("trial_id", "class", "fold", (F.col("p") + 1).alias("t_idx"), F.col("v").alias("x"))


_FOLDS = f"""b AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY {KEY}) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label IN (0, 1)),
m AS (SELECT min(n) AS n FROM b),
f AS (SELECT b.vec_id, b.label, b.embedding, (SELECT min(k) FROM generate_series(1, 5) AS g(k) WHERE b.r <= ROUND(CAST(k * m.n AS DOUBLE) / 5)) AS fold FROM b, m WHERE b.r <= m.n),
x AS (SELECT vec_id, label, fold, t, CAST(embedding[2 * t - 1] AS DOUBLE) AS a, CAST(embedding[2 * t] AS DOUBLE) AS b FROM f, generate_series(1, 4) AS g(t)),
c AS (SELECT k AS fold, t, label, CAST(count(*) AS DOUBLE) AS n, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) * count(*) AS aa, covar_pop(a, b) * count(*) AS ab, covar_pop(b, b) * count(*) AS bb FROM x, generate_series(1, 5) AS g(k) WHERE x.fold <> k GROUP BY 1, 2, 3),
p AS (SELECT fold, t, sum(n) AS total, sum(aa) / (sum(n) - 2) AS aa, sum(ab) / (sum(n) - 2) AS ab, sum(bb) / (sum(n) - 2) AS bb FROM c GROUP BY 1, 2)"""

_AUC = "rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0"


def _kind(kind: str) -> None:
    pooled = kind in ("linear", "diaglinear")
    of = lambda e: (f"p.{e}" if pooled else f"c.{e} / (c.n - 1)") if e != "ab" or not kind.startswith("diag") else "0.0"
    value = "-0.5 * (bb * u * u - 2 * ab * u * v + aa * v * v) / det"
    if kind != "mahalanobis":
        value += " + ln(n / total)" + ("" if pooled else " - 0.5 * ln(det)")

    @entry(
        f"two_channels_{kind}",
        f"""WITH {_FOLDS}, w AS (SELECT c.fold, c.label AS class, c.n, p.total, c.ma, c.mb, {of('aa')} AS aa, {of('ab')} AS ab, {of('bb')} AS bb FROM c JOIN p ON c.fold = p.fold AND c.t = p.t WHERE c.t = 1),
q AS (SELECT x.fold, vec_id, x.label, class, a - ma AS u, b - mb AS v, n, total, aa, ab, bb, aa * bb - ab * ab AS det FROM x JOIN w ON x.fold = w.fold WHERE x.t = 1),
l AS (SELECT fold, vec_id, label, sum(CASE WHEN class = 1 THEN 1 ELSE -1 END * ({value})) AS d FROM q GROUP BY 1, 2, 3)
SELECT 's1' AS subject, fold, vec_id AS trial_id, label, {_R('1 / (1 + exp(-d))', 'score')} FROM l""",
    )
    def _(spark, d):
        return decode.decode_folds(_pairs(spark, d).where("t_idx = 1"), kind).where("class = 1").select("subject", "fold", "trial_id", "label", "score")


for _k in ("linear", "diaglinear", "quadratic", "diagquadratic", "mahalanobis"):
    _kind(_k)


@entry(
    "generalisation",
    f"""WITH {_FOLDS}, w AS (SELECT p.fold, p.t, (bb * da - ab * db) / (aa * bb - ab * ab) AS wa, (aa * db - ab * da) / (aa * bb - ab * ab) AS wb, lv FROM p JOIN
 (SELECT fold, t, max(CASE WHEN label = 1 THEN ma END) - max(CASE WHEN label = 0 THEN ma END) AS da, max(CASE WHEN label = 1 THEN mb END) - max(CASE WHEN label = 0 THEN mb END) AS db, 0 AS lv FROM c GROUP BY 1, 2) d ON p.fold = d.fold AND p.t = d.t),
s AS (SELECT w.t AS train_t, x.t AS test_t, x.fold, label, ROUND(wa * a + wb * b, 9) AS score FROM x JOIN w ON x.fold = w.fold), r AS (SELECT *, {_AUC.format(by='train_t, test_t, fold')} AS r FROM s),
u AS (SELECT train_t, test_t, fold, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM r GROUP BY 1, 2, 3)
SELECT train_t, test_t, {_R('avg(auc)', 'auc')} FROM u GROUP BY 1, 2""",
)
def _(spark, d):
    return decode.generalise(_pairs(spark, d), 5)


@entry(
    "forward_model_identity",
    f"""WITH o AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY {KEY}) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label < 2),
f AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, (SELECT min(k) FROM generate_series(1, 5) AS g(k) WHERE r <= ROUND(CAST(k * n AS DOUBLE) / 5)) AS fold FROM o),
t AS (SELECT k AS fold, avg(a) FILTER (label = 0) AS a0, avg(b) FILTER (label = 0) AS b0, avg(a) FILTER (label = 1) AS a1, avg(b) FILTER (label = 1) AS b1 FROM f, generate_series(1, 5) AS g(k) WHERE fold <> k GROUP BY 1),
h AS (SELECT fold, label, avg(a) AS a, avg(b) AS b FROM f GROUP BY 1, 2),
r AS (SELECT h.fold, label, (b1 * a - a1 * b) / (a0 * b1 - a1 * b0) AS c0, (a0 * b - b0 * a) / (a0 * b1 - a1 * b0) AS c1 FROM h JOIN t ON h.fold = t.fold)
SELECT 's1' AS subject, fold, resp, {_R('avg(CASE WHEN (resp = 1) = (label = 1) THEN c0 ELSE c1 END)', 'value')} FROM r, generate_series(1, 2) AS g(resp) GROUP BY 2, 3""",
)
def _(spark, d):
    trials = design.folds(epochs(spark, d).where("event_code < 2").withColumn("class", F.col("event_code")), 5).withColumn("x", F.slice("x", 1, 2))
    return decode.forward_model(trials, 2)
