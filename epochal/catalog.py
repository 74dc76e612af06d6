"""One entry per operator: the query over the driver's tables and, where SQL can express it, its oracle.

Queries end in ``_final``: whole numbers as long, doubles rounded to six places.  Oracles are written on
their own, in DuckDB's dialect, from the operators' definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.functions import text as T
from epochal.functions.dist import t_two_sided, z_of
from epochal.operators import arrays, behavior, circ, clusters, decode, design, files, group, linear, metrics, pairs, prep, results, robust, signals
from epochal.registry import ANGLES, HOURS, KEY, MATRIX, ORACLES, QUERIES, SAMPLES, Query, entry, f_upper_sql, normal_quantile_sql, normal_sql, rounded, t_two_sided_sql
from epochal.plans.levels import FirstLevel, GroupLevel, first_level, group_level
from epochal.sources.adapters import behaviour, epochs, samples, table
from epochal.streaming import events

FLAGSHIP = "diag_lda_auc"
_entry, _R, _S, _KEY = entry, rounded, SAMPLES, KEY


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)




# first level ---------------------------------------------------------------------------------------------


def _two_classes(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    trials = epochs(spark, sf_dir).where("event_code in (0, 1)").withColumn("class", F.col("event_code"))
    return design.folds(design.balance(trials, "class"), k)


@_entry(
    FLAGSHIP,
    f"""
WITH b AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY {_KEY}) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label IN (0, 1)),
m AS (SELECT min(n) AS n FROM b),
f AS (SELECT b.vec_id, b.label, b.embedding, CAST((SELECT min(k) FROM generate_series(1, 5) AS g(k) WHERE b.r <= ROUND(CAST(k * m.n AS DOUBLE) / 5)) AS BIGINT) AS fold FROM b, m WHERE b.r <= m.n),
x AS (SELECT vec_id, label, fold, i AS chan, CAST(embedding[i] AS DOUBLE) AS v FROM f, generate_series(1, 64) AS g(i)),
t AS (SELECT k AS fold, chan, avg(v) FILTER (label = 0) AS m0, avg(v) FILTER (label = 1) AS m1,
  (var_pop(v) FILTER (label = 0) * count(*) FILTER (label = 0) + var_pop(v) FILTER (label = 1) * count(*) FILTER (label = 1)) / (count(*) - 2) AS s
  FROM x, generate_series(1, 5) AS g(k) WHERE x.fold <> k GROUP BY k, chan),
sc AS (SELECT x.fold, x.vec_id, x.label, ROUND(sum((m1 - m0) / s * (v - (m0 + m1) / 2.0)), 7) AS score FROM x JOIN t ON x.fold = t.fold AND x.chan = t.chan GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS r FROM sc)
SELECT fold, ROUND((sum(r) FILTER (label = 1) - CAST(count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) AS DOUBLE) / 2.0) / CAST(count(*) FILTER (label = 1) * count(*) FILTER (label = 0) AS DOUBLE), 6) + 0.0 AS auc
FROM rk GROUP BY fold""",
)
def _(spark, d):
    return decode.diagonal_auc(_two_classes(spark, d), 5)


@_entry("erp_per_code", f"WITH {_S} SELECT event_code, t_idx, {_R('avg(value)', 'value')}, count(*) AS n FROM s GROUP BY 1, 2")
def _(spark, d):
    return prep.erp(samples(spark, d), ["event_code"])


@_entry("erp_per_class", f"WITH {_S} SELECT CASE WHEN event_code IN (3, 4, 5) THEN 2 WHEN event_code IN (0, 1, 2) THEN 1 ELSE 0 END AS class, t_idx, {_R('avg(value)', 'value')}, count(*) AS n FROM s GROUP BY 1, 2")
def _(spark, d):
    return prep.erp(design.label_classes(samples(spark, d), {1: [0, 1, 2], 2: [3, 4, 5]}), ["class"])


def _baseline_query(method: str, expression: str) -> None:
    sql = f"WITH {_S}, p AS (SELECT trial_id, event_code, t_idx, value * value + 0.01 AS x FROM s), b AS (SELECT *, avg(CASE WHEN t_idx BETWEEN 1 AND 16 THEN x END) OVER (PARTITION BY trial_id) AS m FROM p) SELECT trial_id, event_code, t_idx, {_R(expression, 'value')} FROM b"

    @_entry(f"baseline_{method}", sql)
    def _(spark, d):
        return prep.baseline(samples(spark, d).withColumn("value", F.col("value") * F.col("value") + 0.01), 1, 16, method)


for _m, _e in {"absolute": "x - m", "relative": "x / m", "relchange": "(x - m) / m", "vssum": "(x - m) / (x + m)", "db": "10 * log10(x / m)"}.items():
    _baseline_query(_m, _e)


@_entry(
    "bins_repeated_codes",
    f"""WITH {_S}, o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings),
spec(class, event_code, place, repeats, nth) AS (VALUES (1, 0, 0, 1, 0), (1, 1, 1, 1, 0), (2, 2, 0, 2, 0), (2, 2, 1, 2, 1), (2, 3, 2, 1, 0)),
dealt AS (SELECT o.vec_id, class, place, k // repeats AS bin FROM o JOIN spec ON o.label = spec.event_code AND k % repeats = nth),
n AS (SELECT class, min(c) AS n_bins FROM (SELECT class, place, count(*) AS c FROM dealt GROUP BY 1, 2) GROUP BY 1)
SELECT dealt.class, bin, t_idx, count(*) AS n_trials, {_R('avg(value)', 'value')} FROM dealt JOIN n ON dealt.class = n.class AND bin < n_bins JOIN s ON s.trial_id = dealt.vec_id GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return design.bins(samples(spark, d), {1: [0, 1], 2: [2, 2, 3]})


@_entry("balance_events", f"WITH o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_KEY}) AS k FROM embeddings) SELECT vec_id AS trial_id, label AS event_code, k FROM o WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM embeddings GROUP BY label))")
def _(spark, d):
    return design.balance(epochs(spark, d).drop("x"))


@_entry("restrict_training", f"WITH c AS (SELECT vec_id, label, label % 3 AS class FROM embeddings), o AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {_KEY}) AS k FROM c) SELECT vec_id AS trial_id, label AS event_code, class FROM o WHERE k <= 100 // 3")
def _(spark, d):
    return design.restrict_training(epochs(spark, d).drop("x").withColumn("class", F.col("event_code") % 3), 100, 3)


@_entry(
    "kfold_assignment",
    f"WITH o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_KEY}) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id AS trial_id, label AS event_code, (SELECT min(k) FROM generate_series(1, 5) AS g(k) WHERE r <= ROUND(CAST(k * n AS DOUBLE) / 5)) AS fold FROM o",
)
def _(spark, d):
    return design.folds(epochs(spark, d).drop("x"), 5, "event_code")


@_entry("fold_count", "WITH p AS (SELECT CASE WHEN label IN (1, 2) THEN 'common' WHEN label IN (0, 1, 2) THEN 'train' WHEN label IN (1, 2, 3) THEN 'test' END AS part FROM embeddings) SELECT least(10, min(c)) AS n_folds FROM (SELECT count(*) AS c FROM p WHERE part IS NOT NULL GROUP BY part)")
def _(spark, d):
    return design.smallest_subset(epochs(spark, d), [0, 1, 2], [1, 2, 3], 10)


# scores -----------------------------------------------------------------------------------------------


@_entry(
    "auc_quality_by_length",
    """WITH x AS (SELECT d.source, l.quality AS label, CAST(d.n_chars AS DOUBLE) AS score FROM documents d JOIN labels l USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0 AS r FROM x),
g AS (SELECT source, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS p, CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS n, sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS s FROM r GROUP BY source)
SELECT source, CASE WHEN p > 0 AND n > 0 THEN ROUND((s - p * (p + 1) / 2.0) / (p * n), 6) + 0.0 END AS auc FROM g""",
)
def _(spark, d):
    scored = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("score")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return metrics.auc(scored, ["source"])


_CENTROIDS = f"""{_S}, c AS (SELECT event_code AS class, t_idx, avg(value) AS m FROM s GROUP BY 1, 2),
sc AS (SELECT s.trial_id, s.event_code AS label, c.class, ROUND(-sum((value - m) * (value - m)), 7) AS score FROM s JOIN c USING (t_idx) GROUP BY 1, 2, 3)"""


def _centroid_scores(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    c = s.groupBy(F.col("event_code").alias("class"), "t_idx").agg(F.avg("value").alias("m"))
    joined = s.join(F.broadcast(c), "t_idx")  # each class's mean at each sample
    return joined.groupBy("trial_id", F.col("event_code").alias("label"), "class").agg(F.round(-F.sum((F.col("value") - F.col("m")) * (F.col("value") - F.col("m"))), 7).alias("score"))


@_entry(
    "auc_multiclass",
    f"""WITH {_CENTROIDS}, p AS (SELECT sc.*, o AS other FROM sc, generate_series(0, 9) AS g(o) WHERE o <> class AND (label = class OR label = o)),
r AS (SELECT *, rank() OVER (PARTITION BY class, other ORDER BY score) + (count(*) OVER (PARTITION BY class, other, score) - 1) / 2.0 AS r FROM p),
a AS (SELECT class, other, CAST(count(*) FILTER (label = class) AS DOUBLE) AS p, CAST(count(*) FILTER (label <> class) AS DOUBLE) AS n, sum(r) FILTER (label = class) AS s FROM r GROUP BY 1, 2)
SELECT 'all' AS set, {_R('avg((s - p * (p + 1) / 2.0) / (p * n))', 'auc')}, count(*) AS n_pairs FROM a""",
)
def _(spark, d):
    return metrics.auc_multiclass(_centroid_scores(spark, d).withColumn("set", F.lit("all")), list(range(10)), ["set"])


_ASSIGNED = f"{_CENTROIDS}, a AS (SELECT trial_id, label, arg_min(class, (-score, class)) AS assigned FROM sc GROUP BY 1, 2)"


@_entry("confusion_matrix", f"WITH {_ASSIGNED} SELECT label, assigned, count(*) AS n FROM a GROUP BY 1, 2")
def _(spark, d):
    return metrics.confusion(metrics.assigned_class(_centroid_scores(spark, d)))


@_entry("balanced_accuracy", f"WITH {_ASSIGNED}, r AS (SELECT label, avg(CASE WHEN label = assigned THEN 1.0 ELSE 0.0 END) AS x FROM a GROUP BY 1) SELECT {_R('avg(x)', 'balanced_accuracy')} FROM r")
def _(spark, d):
    return metrics.balanced_accuracy(metrics.assigned_class(_centroid_scores(spark, d)))


def _detected(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", F.col("quality").alias("label"), F.when(F.col("n_chars") > 800, 1).otherwise(2).alias("assigned"))


@_entry(
    "signal_detection",
    f"""WITH x AS (SELECT lang, quality AS label, CASE WHEN n_chars > 800 THEN 1 ELSE 2 END AS y FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, CAST(count(*) FILTER (label = 1 AND y = 1) AS DOUBLE) AS h, CAST(count(*) FILTER (label = 1 AND y <> 1) AS DOUBLE) AS m, CAST(count(*) FILTER (label <> 1 AND y = 1) AS DOUBLE) AS f, CAST(count(*) FILTER (label <> 1 AND y <> 1) AS DOUBLE) AS r FROM x GROUP BY 1)
SELECT lang, {_R('h / nullif(h + m, 0)', 'hr')}, {_R('f / nullif(f + r, 0)', 'far')}, {_R('m / nullif(h + m, 0)', 'mr')}, {_R('r / nullif(f + r, 0)', 'cr')}, {_R('h / nullif(h + m, 0) - f / nullif(f + r, 0)', 'hr_far')} FROM c""",
)
def _(spark, d):
    return metrics.detection(_detected(spark, d), ["lang"]).select("lang", "hr", "far", "mr", "cr", "hr_far")


@_entry(
    "d_prime",
    f"""WITH x AS (SELECT lang, quality AS label, CASE WHEN n_chars > 800 THEN 1 ELSE 2 END AS y FROM documents JOIN labels USING (doc_id)),
n AS (SELECT lang, CAST(count(*) FILTER (label = 1 AND y = 1) AS DOUBLE) AS h, CAST(count(*) FILTER (label = 1 AND y <> 1) AS DOUBLE) AS m, CAST(count(*) FILTER (label <> 1 AND y = 1) AS DOUBLE) AS f, CAST(count(*) FILTER (label <> 1 AND y <> 1) AS DOUBLE) AS r FROM x GROUP BY 1),
e AS (SELECT *, CASE WHEN least(h, m, f, r) = 0 THEN 0.5 ELSE 0.0 END AS k FROM n), c AS (SELECT lang, (h + k) / nullif(h + m + 2 * k, 0) AS h, (f + k) / nullif(f + r + 2 * k, 0) AS f FROM e)
SELECT lang, {_R(normal_quantile_sql('h') + ' - ' + normal_quantile_sql('f'), 'd_prime')} FROM c""",
)
def _(spark, d):
    return metrics.detection(_detected(spark, d), ["lang"]).select("lang", (z_of("hr_corrected") - z_of("far_corrected")).alias("d_prime"))


# preparation ------------------------------------------------------------------------------------------


@_entry("subtract_evoked", f"WITH {_S} SELECT trial_id, event_code, t_idx, {_R('value - avg(value) OVER (PARTITION BY event_code, t_idx)', 'value')} FROM s")
def _(spark, d):
    return prep.subtract_evoked(samples(spark, d))


@_entry("subtract_conditions", f"WITH k AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings WHERE label IN (0, 1)), j AS (SELECT a.k, a.embedding AS x, b.embedding AS y FROM k a JOIN k b ON a.k = b.k AND a.label = 0 AND b.label = 1) SELECT k, i AS t_idx, {_R('CAST(x[i] AS DOUBLE) - CAST(y[i] AS DOUBLE)', 'value')} FROM j, generate_series(1, 64) AS g(i)")
def _(spark, d):
    return prep.subtract_pairs(samples(spark, d), 0, 1)


@_entry("average_timebin", f"WITH {_S} SELECT trial_id, (t_idx - 1) // 4 + 1 AS bin, {_R('avg(value)', 'value')} FROM s GROUP BY 1, 2 HAVING count(*) = 4")
def _(spark, d):
    return prep.average_timebin(samples(spark, d), 4, ["trial_id"])


@_entry("select_time", f"WITH {_S} SELECT trial_id, event_code, t_idx, {_R('value', 'value')} FROM s WHERE t_idx > 10 AND t_idx < 20")
def _(spark, d):
    return prep.select_time(samples(spark, d), 10, 20)


@_entry("detrend_linear", f"WITH {_S}, c AS (SELECT *, regr_slope(value, t_idx) OVER w AS b, regr_intercept(value, t_idx) OVER w AS a FROM s WINDOW w AS (PARTITION BY trial_id)) SELECT trial_id, t_idx, ROUND(value - a - b * t_idx, 5) + 0.0 AS value FROM c")
def _(spark, d):
    return prep.detrend(samples(spark, d)).select("trial_id", "t_idx", F.round("value", 5).alias("value"))


@_entry("smooth_boxcar", f"WITH {_S}, l AS (SELECT *, avg(value) FILTER (t_idx <= 6) OVER (PARTITION BY trial_id) AS l FROM s) SELECT trial_id, event_code, t_idx, {_R('l + sum(value - l) OVER (PARTITION BY trial_id ORDER BY t_idx ROWS 4 PRECEDING) / 5', 'value')} FROM l")
def _(spark, d):
    return linear.boxcar(samples(spark, d), 5, ["trial_id"]).select("trial_id", "event_code", "t_idx", "value")


@_entry("nearest_sample", "WITH a AS (SELECT DISTINCT p_size AS t FROM part), q(target) AS (VALUES (7.5), (0.0), (1000.0), (12.2)) SELECT CAST(target AS DOUBLE) AS target, (SELECT arg_min(t, (abs(t - target), t)) FROM a) AS nearest FROM q")
def _(spark, d):
    targets = spark.createDataFrame([(7.5,), (0.0,), (1000.0,), (12.2,)], "target double")
    return prep.nearest(table(spark, d, "part").select(F.col("p_size").alias("t")).distinct(), targets)


@_entry("flatline_runs", f"WITH {_S}, d AS (SELECT *, COALESCE(abs(value - lag(value) OVER (PARTITION BY trial_id ORDER BY t_idx)) < 0.1, false) AS still FROM s), i AS (SELECT *, t_idx - row_number() OVER (PARTITION BY trial_id, still ORDER BY t_idx) AS g FROM d) SELECT trial_id, min(t_idx) AS first, max(t_idx) AS last, count(*) AS steps FROM i WHERE still GROUP BY trial_id, g HAVING count(*) >= 2")
def _(spark, d):
    return prep.flatlines(samples(spark, d), ["trial_id"], 2, 0.1)


@_entry("step_artifacts", f"WITH {_S}, d AS (SELECT trial_id, CASE WHEN count(*) OVER a = 8 AND count(*) OVER b = 8 THEN abs(avg(value) OVER b - avg(value) OVER a) END AS st FROM s WINDOW a AS (PARTITION BY trial_id ORDER BY t_idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY trial_id ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) SELECT trial_id, {_R('max(st)', 'largest')} FROM d GROUP BY 1 HAVING max(st) > 0.13")
def _(spark, d):
    return prep.step_artifacts(samples(spark, d), ["trial_id"], 8, 0.13)


@_entry("artifact_z", f"WITH {_S}, m AS (SELECT t_idx, avg(value) AS m, stddev_pop(value) AS sd FROM s GROUP BY 1) SELECT trial_id, {_R('sum((value - m) / sd)', 'z_sum')} FROM s JOIN m USING (t_idx) GROUP BY 1")
def _(spark, d):
    return prep.artifact_z(samples(spark, d))


# behaviour --------------------------------------------------------------------------------------------

_B = "e AS (SELECT user_id AS subject, event_type AS event, CAST(ROUND(epoch_us(ts) / 1000.0) AS BIGINT) AS time_ms, value, event_id FROM events)"


def _response_query(name: str, last: bool) -> None:
    pick = "DESC" if last else "ASC"
    sql = f"""WITH {_B}, j AS (SELECT s.event_id, s.subject, s.time_ms, r.time_ms AS response_ms, r.event_id AS response_id, row_number() OVER (PARTITION BY s.event_id ORDER BY r.time_ms {pick}, r.event_id {pick}) AS k
FROM e s LEFT JOIN e r ON s.subject = r.subject AND r.event = 'click' AND r.time_ms BETWEEN s.time_ms + 60000 AND s.time_ms + 7200000 WHERE s.event = 'view')
SELECT event_id, subject, time_ms, response_ms, response_id, response_ms - time_ms AS rt_ms FROM j WHERE k = 1"""

    @_entry(name, sql)
    def _(spark, d):
        e = behaviour(spark, d)
        return behavior.add_responses(e.where("event = 'view'").select("event_id", "subject", "time_ms"), e.where("event = 'click'"), 60_000, 7_200_000, last)


_response_query("responses_first", False)
_response_query("responses_last", True)


@_entry("epochs_around_errors", f"WITH {_B} SELECT s.event_id AS error_id, r.event_id AS event_id, r.time_ms - s.time_ms AS offset_ms FROM e s JOIN e r ON s.subject = r.subject AND r.time_ms - s.time_ms BETWEEN -1800000 AND 3600000 WHERE s.event = 'error'")
def _(spark, d):
    e = behaviour(spark, d)
    return prep.cut_epochs(e.where("event = 'error'").select(F.col("event_id").alias("error_id"), "subject", "time_ms"), e.select("event_id", "subject", "time_ms"), -1_800_000, 3_600_000, 3_600_000).select("error_id", "event_id", "offset_ms")


@_entry("reject_intervals", f"WITH {_B} SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.event = 'error' AND b.subject = e.subject AND e.time_ms BETWEEN b.time_ms - 3600000 AND b.time_ms + 3600000)")
def _(spark, d):
    e = behaviour(spark, d)
    bad = e.where("event = 'error'").select("subject", (F.col("time_ms") - 3_600_000).alias("start_ms"), (F.col("time_ms") + 3_600_000).alias("stop_ms"))
    return prep.reject_intervals(e.select("event_id", "subject", "time_ms"), bad, 7_200_000).select("event_id")


@_entry("join_adjacent_events", f"WITH {_B}, n AS (SELECT *, COALESCE(CAST(event <> lag(event) OVER w AS INT), 1) AS new FROM e WINDOW w AS (PARTITION BY subject ORDER BY time_ms, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY time_ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT subject, CAST(run AS BIGINT) AS run, min(event) AS event, min(time_ms) AS first, count(*) AS n FROM r GROUP BY subject, run")
def _(spark, d):
    return behavior.join_adjacent(behaviour(spark, d), "subject", ["time_ms", "event_id"])


@_entry("duration_to_next", f"WITH {_B} SELECT event_id, COALESCE(lead(time_ms) OVER (PARTITION BY subject ORDER BY time_ms, event_id) - time_ms, CAST(ROUND(value) AS BIGINT)) AS duration_ms FROM e")
def _(spark, d):
    return behavior.duration_to_next(behaviour(spark, d).withColumn("duration_ms", F.round("value").cast("long")), "subject", ["time_ms", "event_id"]).select("event_id", "duration_ms")


@_entry("role_runs", "WITH n AS (SELECT *, COALESCE(CAST(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS INT), 1) AS new FROM conversations), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT conv_id, CAST(run AS BIGINT) AS run, min(role) AS event, min(turn) AS first, count(*) AS n FROM r GROUP BY conv_id, run")
def _(spark, d):
    return behavior.join_adjacent(table(spark, d, "conversations"), "conv_id", ["turn"], "role")


# group level ------------------------------------------------------------------------------------------

_HOURS = HOURS


def _by_hour(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("subject"), (F.hour(F.col("ts").cast("timestamp")) + 1).alias("sample")).agg(F.avg("value").alias("value"))


@_entry("group_mean_se", f"WITH {_HOURS} SELECT sample, {_R('avg(value)', 'mean')}, {_R('stddev_samp(value) / sqrt(count(*))', 'se')}, count(*) AS n FROM h GROUP BY 1")
def _(spark, d):
    return group.mean_se(_by_hour(spark, d), ["sample"])


@_entry("one_sample_t", f"WITH {_HOURS} SELECT sample, {_R('avg(value)', 'mean')}, count(*) - 1 AS df, {_R('(avg(value) - 50) / (stddev_samp(value) / sqrt(count(*)))', 't')} FROM h GROUP BY 1")
def _(spark, d):
    return group.one_sample_t(_by_hour(spark, d), ["sample"], 50.0)


@_entry("one_sample_p", f"WITH {HOURS}, g AS (SELECT sample, avg(value) AS mean, count(*) - 1 AS df, (avg(value) - 50.0) / (stddev_samp(value) / sqrt(count(*))) AS t FROM h GROUP BY 1) SELECT sample, {_R('mean', 'mean')}, df, {_R('t', 't')}, {_R(t_two_sided_sql('t', 'df'), 'p')} FROM g")
def _(spark, d):
    return group.one_sample_t(_by_hour(spark, d), ["sample"], 50.0).withColumn("p", t_two_sided("t", F.col("df").cast("double")))


_SUPP = "q AS (SELECT l_suppkey AS subject, l_returnflag AS cond, avg(l_discount) AS value FROM lineitem GROUP BY 1, 2)"


def _by_supplier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("cond")).agg(F.avg("l_discount").alias("value"))


@_entry("paired_t", f"WITH {_SUPP}, p AS (SELECT a.value - b.value AS value FROM q a JOIN q b ON a.subject = b.subject WHERE a.cond = 'A' AND b.cond = 'N') SELECT 'A-N' AS cond, {_R('avg(value)', 'mean')}, count(*) - 1 AS df, {_R('avg(value) / (stddev_samp(value) / sqrt(count(*)))', 't')} FROM p")
def _(spark, d):
    q = _by_supplier(spark, d)
    return group.one_sample_t(group.paired(q.where("cond = 'A'"), q.where("cond = 'N'"), ["subject"]).withColumn("cond", F.lit("A-N")), ["cond"])


def _unpaired(name: str, equal: bool) -> None:
    if equal:
        se, df = "sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))", "CAST(n1 + n2 - 2 AS DOUBLE)"
    else:
        se, df = "sqrt(v1 / n1 + v2 / n2)", "pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))"
    sql = f"WITH g AS (SELECT l_linestatus AS s, avg(l_quantity) FILTER (l_returnflag = 'A') AS m1, var_samp(l_quantity) FILTER (l_returnflag = 'A') AS v1, count(*) FILTER (l_returnflag = 'A') AS n1, avg(l_quantity) FILTER (l_returnflag = 'R') AS m2, var_samp(l_quantity) FILTER (l_returnflag = 'R') AS v2, count(*) FILTER (l_returnflag = 'R') AS n2 FROM lineitem GROUP BY 1) SELECT s, {_R(f'(m1 - m2) / {se}', 't')}, {_R(df, 'df')} FROM g"

    @_entry(name, sql)
    def _(spark, d):
        return group.two_sample_t(table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "s"), ["s"], "l_returnflag", "A", "R", equal, "l_quantity")


_unpaired("two_sample_t_pooled", True)
_unpaired("two_sample_t_welch", False)


def _fdr_query(name: str, dependent: bool) -> None:
    harmonic = "sum(1.0 / r) OVER ()" if dependent else "1.0"
    sql = f"""WITH p AS (SELECT l_partkey AS key, ROUND(exp(-abs(avg(l_quantity) - 25.5) * sqrt(count(*)) / 3.0), 9) AS p FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, key) AS r, count(*) OVER () AS m FROM p),
c AS (SELECT *, r * CAST(0.05 AS DOUBLE) / (m * {harmonic}) AS bound FROM r), k AS (SELECT *, max(CASE WHEN p <= bound THEN p END) OVER () AS crit FROM c)
SELECT 'parts' AS family, key, {_R('p', 'p')}, r AS rank, {_R('crit', 'crit')}, COALESCE(p <= crit, false) AS h FROM k"""

    @_entry(name, sql)
    def _(spark, d):
        p = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.round(F.exp(-F.abs(F.avg("l_quantity") - 25.5) * F.sqrt(F.count(F.lit(1))) / 3.0), 9).alias("p"))
        return group.fdr(p.select(F.lit("parts").alias("family"), "key", "p"), ["family"], 0.05, dependent)


_fdr_query("fdr_bh", False)
_fdr_query("fdr_by", True)

_RUNS = """x AS (SELECT *, CASE WHEN t > {th} THEN 1 WHEN t < -{th} THEN -1 ELSE 0 END AS sign FROM ts),
i AS (SELECT *, sample - row_number() OVER (PARTITION BY {by}sign ORDER BY sample) AS g FROM x WHERE sign <> 0)"""


@_entry("clusters_1d", f"WITH {_HOURS}, ts AS (SELECT sample, (avg(value) - 50) / (stddev_samp(value) / sqrt(count(*))) AS t FROM h GROUP BY 1), {_RUNS.format(th=0.5, by='')} SELECT sign, min(sample) AS first, max(sample) AS last, count(*) AS size, {_R('sum(abs(t))', 'mass')}, arg_max(sample, (abs(ROUND(t, 9)), -sample)) AS peak_t FROM i GROUP BY sign, g")
def _(spark, d):
    return group.runs_over(group.one_sample_t(_by_hour(spark, d), ["sample"], 50.0), [], "sample", "t", 0.5)


@_entry(
    "cluster_permutation",
    f"""WITH {_HOURS}, f AS (SELECT rep, subject, sample, CASE WHEN rep = 0 OR floor((((rep * 7919 + subject * 104729) * 1103515245 + 12345) % 2147483648) / 65536.0) % 2 = 0 THEN 1.0 ELSE -1.0 END * (value - 50) AS value FROM h, generate_series(0, 50) AS g(rep)),
ts AS (SELECT rep, sample, CASE WHEN count(*) > 1 AND stddev_samp(value) > 0 THEN avg(value) / (stddev_samp(value) / sqrt(count(*))) END AS t FROM f GROUP BY 1, 2), {_RUNS.format(th=1.0, by='rep, ')},
c AS (SELECT rep, sum(abs(t)) AS mass FROM i GROUP BY rep, sign, g) SELECT rep, ROUND(COALESCE(max(mass), 0.0), 6) + 0.0 AS mass FROM generate_series(0, 50) AS g(rep) LEFT JOIN c USING (rep) GROUP BY rep""",
)
def _(spark, d):
    return group.permutation_masses(_by_hour(spark, d).withColumn("value", F.col("value") - 50), 50, 1.0)


@_entry(
    "permutation_p",
    f"""WITH {_HOURS}, f AS (SELECT rep, subject, sample, CASE WHEN rep = 0 OR floor((((rep * 7919 + subject * 104729) * 1103515245 + 12345) % 2147483648) / 65536.0) % 2 = 0 THEN 1.0 ELSE -1.0 END * (value - 50) AS value FROM h, generate_series(0, 50) AS g(rep)),
ts AS (SELECT rep, sample, CASE WHEN count(*) > 1 AND stddev_samp(value) > 0 THEN avg(value) / (stddev_samp(value) / sqrt(count(*))) END AS t FROM f GROUP BY 1, 2), {_RUNS.format(th=1.0, by='rep, ')},
c AS (SELECT rep, sum(abs(t)) AS mass FROM i GROUP BY rep, sign, g), m AS (SELECT rep, COALESCE(max(mass), 0.0) AS mass FROM generate_series(0, 50) AS g(rep) LEFT JOIN c USING (rep) GROUP BY rep)
SELECT {_R('avg(CASE WHEN mass > (SELECT mass FROM m WHERE rep = 0) THEN 1.0 ELSE 0.0 END)', 'p')}, count(*) AS n FROM m WHERE rep > 0""",
)
def _(spark, d):
    return group.permutation_p(group.permutation_masses(_by_hour(spark, d).withColumn("value", F.col("value") - 50), 50, 1.0))


_MATRIX = MATRIX


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_linenumber").alias("row"), (F.col("p_size") % 7 + 1).alias("col")).agg(F.avg("l_discount").alias("value"))


@_entry("symmetrise", f"WITH {_MATRIX} SELECT a.\"row\", a.col, {_R('(a.value + b.value) / 2.0', 'value')} FROM m a JOIN m b ON a.\"row\" = b.col AND a.col = b.\"row\"")
def _(spark, d):
    return group.symmetrise(_matrix(spark, d), [])


for _h, _c in (("avtrain", '"row"'), ("avtest", "col")):
    _entry(f"reduce_{_h}", f"WITH {_MATRIX} SELECT {_c} AS t, {_R('avg(value)', 'value')} FROM m GROUP BY 1")(lambda spark, d, how=_h: group.reduce_matrix(_matrix(spark, d), [], how))
_entry("reduce_diag", f"WITH {_MATRIX} SELECT \"row\" AS t, {_R('value', 'value')} FROM m WHERE \"row\" = col")(lambda spark, d: group.reduce_matrix(_matrix(spark, d), [], "diag"))


@_entry("latency_onset", f"WITH {_HOURS}, p AS (SELECT *, max(value) OVER (PARTITION BY subject) AS peak FROM h) SELECT subject, {_R('max(peak)', 'peak')}, min(sample) AS onset_t FROM p WHERE value >= peak * 0.5 GROUP BY 1")
def _(spark, d):
    return group.onset(_by_hour(spark, d).withColumnRenamed("sample", "t"), ["subject"])


@_entry("latency_jackknife", f"WITH {_HOURS} SELECT subject, sample AS t, ROUND((sum(value) OVER (PARTITION BY sample) - value) / nullif(count(*) OVER (PARTITION BY sample) - 1, 0), 4) + 0.0 AS value FROM h")
def _(spark, d):
    return group.jackknife(_by_hour(spark, d).withColumnRenamed("sample", "t")).select("subject", "t", F.round("value", 4).alias("value"))


for _k, _x, _y in (("pearson", "l_quantity", "l_extendedprice"), ("spearman", "rx", "ry")):
    _entry(
        f"correlate_{_k}",
        f"WITH q AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS ry FROM lineitem), c AS (SELECT l_returnflag, corr({_x}, {_y}) AS r FROM q GROUP BY 1) SELECT l_returnflag, {_R('r', 'r')}, {_R('0.5 * ln((1 + r) / (1 - r))', 'fisher_z')} FROM c",
    )(lambda spark, d, kind=_k: group.correlate(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", kind))


# arrays -------------------------------------------------------------------------------------------------


@_entry("array_demean", f"WITH {_S} SELECT trial_id, event_code, t_idx, {_R('value - avg(value) OVER (PARTITION BY trial_id)', 'value')} FROM s")
def _(spark, d):
    return arrays.weighted_demean(samples(spark, d), ["trial_id"])


@_entry("array_normcol", f"WITH {_S} SELECT trial_id, event_code, t_idx, {_R('value / sqrt(avg(value * value) OVER (PARTITION BY trial_id))', 'value')} FROM s")
def _(spark, d):
    return arrays.normalise(samples(spark, d), ["trial_id"])


@_entry("array_multishift", f"WITH {_S}, l AS (SELECT *, lead(value, 0) OVER w AS lag0, lead(value, 3) OVER w AS lag3 FROM s WINDOW w AS (PARTITION BY trial_id ORDER BY t_idx)) SELECT trial_id, event_code, t_idx, {_R('value', 'value')}, {_R('lag0', 'lag0')}, {_R('lag3', 'lag3')} FROM l WHERE lag3 IS NOT NULL")
def _(spark, d):
    return arrays.lags(samples(spark, d), [0, 3], ["trial_id"])


@_entry("array_cov", f"WITH {_S} SELECT a.t_idx AS i, b.t_idx AS j, {_R('sum(a.value * b.value)', 'sum')}, count(*) AS n FROM s a JOIN s b ON a.trial_id = b.trial_id AND a.t_idx <= b.t_idx GROUP BY 1, 2")
def _(spark, d):
    return arrays.cross_products(epochs(spark, d))


@_entry("array_lagged_cov", f"WITH {_S}, l AS (SELECT value, lead(value, 1) OVER w AS a, lead(value, 4) OVER w AS b FROM s WINDOW w AS (PARTITION BY trial_id ORDER BY t_idx)) SELECT 1 AS lag, {_R('sum(value * a)', 'sum')} FROM l WHERE b IS NOT NULL UNION ALL SELECT 4, {_R('sum(value * b)', 'sum')} FROM l WHERE b IS NOT NULL")
def _(spark, d):
    return arrays.lagged_products(samples(spark, d), [1, 4], ["trial_id"])


@_entry("array_split", f"WITH {_S}, c AS (SELECT trial_id, t_idx, ROUND(sum(value * value) OVER l - sum(value) OVER l * sum(value) OVER l / count(*) OVER l + sum(value * value) OVER r - sum(value) OVER r * sum(value) OVER r / count(value) OVER r, 9) AS cost FROM s WINDOW l AS (PARTITION BY trial_id ORDER BY t_idx ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY trial_id ORDER BY t_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT trial_id, arg_min(t_idx, (cost, t_idx)) AS split_t, {_R('min(cost)', 'cost')} FROM c WHERE cost IS NOT NULL AND NOT isnan(cost) GROUP BY 1")
def _(spark, d):
    return arrays.best_split(samples(spark, d), ["trial_id"])


@_entry("array_dsample_mmx", f"WITH {_S} SELECT trial_id, (t_idx - 1) // 8 AS bin, {_R('arg_min(value, t_idx)', 'value')}, {_R('min(value)', 'low')}, {_R('max(value)', 'high')} FROM s GROUP BY 1, 2")
def _(spark, d):
    return arrays.downsample(samples(spark, d), 8, ["trial_id"])


@_entry("array_bad_channels", f"WITH {_S}, c AS (SELECT median(abs(value)) AS c FROM s) SELECT t_idx, {_R('avg(CASE WHEN abs(value) > 1.5 * c THEN 1.0 ELSE 0.0 END)', 'share')} FROM s, c GROUP BY 1 HAVING avg(CASE WHEN abs(value) > 1.5 * c THEN 1.0 ELSE 0.0 END) > 0.3")
def _(spark, d):
    return arrays.bad_channels(samples(spark, d), 0.3, 1.5)


@_entry("array_unique", "SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2")
def _(spark, d):
    return arrays.unique_rows(table(spark, d, "part"), ["p_brand", "p_size"], "p_partkey")


@_entry("array_proximity", "WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS trial_id, ROUND(list_sum(list_transform(generate_series(1, 64), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, trial_id) AS rank FROM p) SELECT * FROM r WHERE rank <= 5")
def _(spark, d):
    e = epochs(spark, d).select("trial_id", "x")
    return arrays.neighbours(e, e.where("trial_id % 100 = 0"), 5)


# circular and robust statistics ----------------------------------------------------------------------------

_ANG = ANGLES


def _angles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), (2 * F.pi() * F.dayofyear("o_orderdate") / F.lit(366.0)).alias("alpha"), F.col("o_totalprice").alias("x"))


@_entry("circ_describe", f"WITH {_ANG}, r AS (SELECT *, sqrt(c * c + s * s) / n AS r FROM m) SELECT g, n, {_R('atan2(s, c)', 'mu')}, {_R('r', 'r')}, {_R('1 - r', 'var')}, {_R('sqrt(2 * (1 - r))', 'std')}, {_R('sqrt(-2 * ln(r))', 'std0')} FROM r")
def _(spark, d):
    return circ.describe(_angles(spark, d), ["g"])


@_entry("circ_rayleigh", f"WITH {_ANG}, r AS (SELECT *, sqrt(c * c + s * s) AS r FROM m) SELECT g, {_R('r * r / n', 'z')}, {_R('exp(sqrt(1 + 4 * n + 4 * (n * n - r * r)) - (1 + 2 * n))', 'p')} FROM r")
def _(spark, d):
    return circ.rayleigh(_angles(spark, d), ["g"])


@_entry("circ_vtest", f"WITH {_ANG}, v AS (SELECT g, c * cos(1.0) + s * sin(1.0) AS v, (c * cos(1.0) + s * sin(1.0)) * sqrt(2 / n) AS u FROM m) SELECT g, {_R('v', 'v')}, {_R('u', 'u')}, {_R('1 - ' + normal_sql('u'), 'p')} FROM v")
def _(spark, d):
    return circ.v_test(_angles(spark, d), ["g"], 1.0)


@_entry("circ_wwtest", f"WITH {_ANG}, t AS (SELECT count(*) AS g, sum(n) AS n, sum(sqrt(c * c + s * s)) AS sr, sqrt(sum(c) * sum(c) + sum(s) * sum(s)) AS ar FROM m), k AS (SELECT *, sr / n AS w FROM t), b AS (SELECT *, CASE WHEN w < 0.53 THEN 2 * w + pow(w, 3) + 5 * pow(w, 5) / 6 WHEN w < 0.85 THEN -0.4 + 1.39 * w + 0.43 / (1 - w) ELSE 1 / (pow(w, 3) - 4 * w * w + 3 * w) END AS kappa FROM k) , r AS (SELECT (1 + 3 / (8 * kappa)) * (n - g) * (sr - ar) / ((g - 1) * (n - sr)) AS f, g - 1 AS df1, n - g AS df2 FROM b) SELECT {_R('f', 'f')}, df1, df2, {_R(f_upper_sql('f', 'df1', 'df2'), 'p')} FROM r")
def _(spark, d):
    return circ.watson_williams(_angles(spark, d), "g")


@_entry("circ_corrcl", f"WITH {_ANG}, c AS (SELECT g, corr(x, sin(alpha)) AS rs, corr(x, cos(alpha)) AS rc, corr(sin(alpha), cos(alpha)) AS cs, count(*) AS n FROM a GROUP BY 1), r AS (SELECT g, n, sqrt((rc * rc + rs * rs - 2 * rc * rs * cs) / (1 - cs * cs)) AS rho FROM c) SELECT g, {_R('rho', 'rho')}, {_R('exp(-n * rho * rho / 2)', 'p')} FROM r")
def _(spark, d):
    return circ.linear_correlation(_angles(spark, d), ["g"])


@_entry("robust_mad", f"WITH a AS (SELECT l_returnflag AS g, median(l_extendedprice) AS md FROM lineitem GROUP BY 1), dv AS (SELECT l_returnflag AS g, l_extendedprice AS value, md, abs(l_extendedprice - md) AS dev FROM lineitem JOIN a ON l_returnflag = g), m AS (SELECT g, median(dev) AS mad FROM dv GROUP BY 1) SELECT g, {_R('max(md)', 'median')}, {_R('max(mad)', 'mad')}, count(*) FILTER (dev * 0.6745 > 2.2414 * mad) AS n_out FROM dv JOIN m USING (g) GROUP BY g")
def _(spark, d):
    out = robust.mad_rule(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("value")), ["g"])
    return out.groupBy("g").agg(F.max("median").alias("median"), F.max("mad").alias("mad"), F.sum(F.col("outlier").cast("long")).alias("n_out"))


@_entry("robust_ideal_fourths", f"WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), j AS (SELECT *, floor(n / 4.0 + 5 / 12.0) AS j, n / 4.0 + 5 / 12.0 - floor(n / 4.0 + 5 / 12.0) AS f FROM r) SELECT g, {_R('(1 - max(f)) * max(CASE WHEN i = j THEN v END) + max(f) * max(CASE WHEN i = j + 1 THEN v END)', 'low')}, {_R('(1 - max(f)) * max(CASE WHEN i = n - j + 1 THEN v END) + max(f) * max(CASE WHEN i = n - j THEN v END)', 'high')} FROM j GROUP BY g")
def _(spark, d):
    return robust.ideal_fourths(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("value")), ["g"])


def _bent(c: str) -> str:
    return f"""m{c} AS (SELECT g, median({c}) AS m, count(*) AS n FROM b GROUP BY 1), d{c} AS (SELECT b.g, k, {c} AS v, m, n, abs({c} - m) AS d FROM b JOIN m{c} ON b.g = m{c}.g),
w{c} AS (SELECT g, max(CASE WHEN i = floor(0.8 * n + 1e-9) THEN d END) AS w FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d) AS i FROM d{c}) GROUP BY 1),
l{c} AS (SELECT d.g, (sum(CASE WHEN abs((v - m) / w) <= 1 THEN v ELSE 0 END) + max(w) * (count(*) FILTER ((v - m) / w > 1) - count(*) FILTER ((v - m) / w < -1))) / (count(*) FILTER (abs((v - m) / w) <= 1)) AS l, max(w) AS w FROM d{c} d JOIN w{c} ON d.g = w{c}.g GROUP BY 1),
"b{c}" AS (SELECT d.g, k, least(greatest((v - l) / w, -1), 1) AS e FROM d{c} d JOIN l{c} ON d.g = l{c}.g)"""


@_entry("robust_bendcorr", f"WITH b AS (SELECT n_regionkey AS g, s_suppkey AS k, s_acctbal AS x, CAST(s_suppkey AS DOUBLE) AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey), {_bent('x')}, {_bent('y')}, r AS (SELECT p.g, sum(p.e * q.e) / sqrt(sum(p.e * p.e) * sum(q.e * q.e)) AS r, count(*) - 2 AS df FROM bx p JOIN \"by\" q ON p.g = q.g AND p.k = q.k GROUP BY 1) SELECT g AS n_regionkey, {_R('r', 'r')}, df, {_R('r * sqrt(df / (1 - r * r))', 't')} FROM r WHERE df > 5")
def _(spark, d):
    return robust.bend_correlation(table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y")), ["n_regionkey"], "x", "y").where("df > 5")


# names, sets and jobs -------------------------------------------------------------------------------------


@_entry("grouptrain_pairs", "SELECT a.n_name AS train, b.n_name AS test FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
def _(spark, d):
    return files.train_test_pairs(table(spark, d, "nation"), "n_name")


@_entry("missing_results", "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def _(spark, d):
    there = table(spark, d, "supplier").where("s_acctbal > 9000").withColumnRenamed("s_nationkey", "n_nationkey")
    return files.missing(table(spark, d, "nation"), there, ["n_nationkey"]).select("n_name")


@_entry("underscored_names", "SELECT p_partkey, replace(p_type, ' ', '_') AS name, (p_size - 1) % 24 + 1 AS slot FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.underscored("p_type").alias("name"), T.mod_from_one(F.col("p_size"), 24).alias("slot"))


@_entry("cube_by_region", f"SELECT r_name, c_mktsegment, count(*) AS n, {_R('avg(c_acctbal)', 'mean')} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)")
def _(spark, d):
    dims = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey")).cube("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean"))


# more of the group level, arrays and angles ------------------------------------------------------------------


@_entry("time_limits", f"WITH {_HOURS}, x AS (SELECT DISTINCT sample AS t FROM h), e AS (SELECT arg_min(t, (abs(t - 3.4), t)) AS lo, arg_min(t, (abs(t - 9.5), t)) AS hi FROM x) SELECT subject, sample AS t, {_R('value', 'value')} FROM h, e WHERE sample BETWEEN lo AND hi")
def _(spark, d):
    return group.snap_limits(_by_hour(spark, d).withColumnRenamed("sample", "t"), 3.4, 9.5).select("subject", "t", "value")


@_entry("select_subjects", "SELECT c_custkey, c_name AS subject FROM customer WHERE NOT (contains(c_name, '1') OR contains(c_name, '7'))")
def _(spark, d):
    return group.select_subjects(table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("subject")), ["1", "7"], invert=True)


@_entry("concat_stats", f"WITH {_SUPP}, p AS (SELECT 'A-N' AS cond, a.subject, a.value - b.value AS value FROM q a JOIN q b USING (subject) WHERE a.cond = 'A' AND b.cond = 'N'), u AS (SELECT cond, subject, value FROM p UNION ALL SELECT cond, subject, value FROM q) SELECT subject, {_R('value', 'value')}, cond, CAST(contains(cond, '-') AS BIGINT) AS place FROM u")
def _(spark, d):
    q = _by_supplier(spark, d)
    difference = group.paired(q.where("cond = 'A'"), q.where("cond = 'N'"), ["subject"]).withColumn("cond", F.lit("A-N"))
    return group.concat_stats([difference, q])


@_entry("average_stats", f"WITH {_SUPP} SELECT subject, {_R('avg(value)', 'value')} FROM q GROUP BY 1")
def _(spark, d):
    return results.average(_by_supplier(spark, d), ["cond"]).drop("n")


@_entry("randomisation_p", "WITH v AS (SELECT l_suppkey AS subject, l_linenumber - 1 AS rep, avg(l_tax) AS value FROM lineitem GROUP BY 1, 2) SELECT a.subject, ROUND(avg(CASE WHEN a.value >= b.value THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS p FROM v a JOIN v b ON a.subject = b.subject AND b.rep = 0 WHERE a.rep > 0 GROUP BY 1")
def _(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), (F.col("l_linenumber") - 1).alias("rep")).agg(F.avg("l_tax").alias("value"))
    return group.randomisation_p(v, ["subject"])


@_entry("job_expansion", "SELECT r_name, n_name, f AS fold FROM region, nation, generate_series(1, 3) AS g(f)")
def _(spark, d):
    return files.job_arguments([table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name"), spark.range(1, 4).withColumnRenamed("id", "fold")])


@_entry("weighted_mean", f"SELECT l_returnflag, {_R('sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0)', 'value')} FROM lineitem GROUP BY 1")
def _(spark, d):
    return arrays.weighted_mean(table(spark, d, "lineitem").withColumnRenamed("l_extendedprice", "value"), ["l_returnflag"], "l_quantity")


@_entry("array_growmask", f"WITH {_S} SELECT trial_id, t_idx, max(CASE WHEN abs(value) > 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY trial_id ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) > 0 AS mask FROM s")
def _(spark, d):
    return arrays.grow_mask(samples(spark, d).withColumn("mask", F.abs("value") > 0.25), 2, ["trial_id"]).select("trial_id", "t_idx", "mask")


@_entry("array_xcov", f"WITH {_S} SELECT a.t_idx AS i, b.t_idx AS j, {_R('sum(a.value * b.value)', 'sum')} FROM s a JOIN s b ON a.trial_id = b.trial_id WHERE a.t_idx <= 32 AND b.t_idx > 32 GROUP BY 1, 2")
def _(spark, d):
    s = samples(spark, d)
    return arrays.cross_covariance(s.where("t_idx <= 32"), s.where("t_idx > 32"), "trial_id")


@_entry("array_unfold", f"WITH {_S} SELECT trial_id, len(list(value ORDER BY t_idx)) AS n, {_R('list(value ORDER BY t_idx)[5]', 'fifth')} FROM s GROUP BY 1")
def _(spark, d):
    return arrays.unfold(samples(spark, d), ["trial_id"]).select("trial_id", F.size("x").alias("n"), F.col("x")[4].alias("fifth"))


@_entry("smooth_grid", f"WITH {_MATRIX} SELECT a.\"row\", a.col, {_R('avg(b.value)', 'value')} FROM m a JOIN m b ON abs(a.\"row\" - b.\"row\") <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2")
def _(spark, d):
    return arrays.smooth_grid(_matrix(spark, d), 1, 1)


@_entry("quality_windows", "WITH w AS (SELECT time_bucket(INTERVAL 20 MINUTES, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 20 MINUTES AS start, event_type FROM events, generate_series(0, 2) AS g(k)) SELECT epoch_us(start) // 1000000 AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.quality_windows(e).select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


@_entry("event_sessions", "WITH g AS (SELECT user_id, ts, COALESCE(CAST(ts - lag(ts) OVER w >= INTERVAL 6 HOURS AS INT), 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM r GROUP BY user_id, k")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(e).select("user_id", F.unix_micros("session_window.start").alias("start"), "n")


@_entry("circ_moment", f"WITH {_ANG}, p AS (SELECT g, count(*) AS n, sum(cos(2 * alpha)) AS c, sum(sin(2 * alpha)) AS s FROM a GROUP BY 1) SELECT g, {_R('sqrt(c * c + s * s) / n', 'rho')}, {_R('atan2(s, c)', 'mu')} FROM p")
def _(spark, d):
    return circ.moment(_angles(spark, d), ["g"], 2)


@_entry("circ_shape", f"WITH {_ANG} SELECT a.g, {_R('avg(sin(2 * (alpha - atan2(s, c))))', 'skewness')}, {_R('avg(cos(2 * (alpha - atan2(s, c))))', 'kurtosis')} FROM a JOIN m USING (g) GROUP BY 1")
def _(spark, d):
    return circ.shape(_angles(spark, d), ["g"])


@_entry("circ_samplecdf", f"WITH {_ANG}, b AS (SELECT g, CAST(floor((alpha - 2 * pi() * floor(alpha / (2 * pi()))) / (2 * pi()) * 12 + 1e-12) AS BIGINT) + 1 AS bin, count(*) AS k FROM a GROUP BY 1, 2), x AS (SELECT g, bin FROM (SELECT DISTINCT g FROM a), generate_series(1, 12) AS s(bin)) SELECT x.g, x.bin, ROUND(sum(COALESCE(k, 0)) OVER (PARTITION BY x.g ORDER BY x.bin) / sum(COALESCE(k, 0)) OVER (PARTITION BY x.g), 6) + 0.0 AS cdf FROM x LEFT JOIN b ON x.g = b.g AND x.bin = b.bin")
def _(spark, d):
    return circ.sample_cdf(_angles(spark, d), ["g"], 12)


@_entry("circ_corrcc", f"WITH a AS (SELECT 2 * pi() * dayofyear(o_orderdate) / 366.0 AS alpha, 2 * pi() * (o_custkey % 360) / 360.0 AS beta FROM orders), m AS (SELECT atan2(sum(sin(alpha)), sum(cos(alpha))) AS ma, atan2(sum(sin(beta)), sum(cos(beta))) AS mb FROM a), d AS (SELECT sin(alpha - ma) AS x, sin(beta - mb) AS y FROM a, m), q AS (SELECT sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS rho, abs(sqrt(sum(x * x) * sum(y * y) / sum(x * x * y * y)) * sum(x * y) / sqrt(sum(x * x) * sum(y * y))) AS ts FROM d) SELECT {_R('rho', 'rho')}, {_R('2 * (1 - ' + normal_sql('ts') + ')', 'p')} FROM q")
def _(spark, d):
    pairs = table(spark, d, "orders").select((2 * F.pi() * F.dayofyear("o_orderdate") / F.lit(366.0)).alias("alpha"), (2 * F.pi() * (F.col("o_custkey") % 360) / F.lit(360.0)).alias("beta"))
    return circ.angular_correlation(pairs)


@_entry(
    "robust_carling",
    f"""WITH r AS (SELECT l_returnflag AS flag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), j AS (SELECT *, floor(n / 4.0 + 5 / 12.0) AS j, n / 4.0 + 5 / 12.0 - floor(n / 4.0 + 5 / 12.0) AS f FROM r),
q AS (SELECT flag, (1 - max(f)) * max(CASE WHEN i = j THEN v END) + max(f) * max(CASE WHEN i = j + 1 THEN v END) AS lo, (1 - max(f)) * max(CASE WHEN i = n - j + 1 THEN v END) + max(f) * max(CASE WHEN i = n - j THEN v END) AS hi, median(v) AS m, (17.63 * max(n) - 23.64) / (7.74 * max(n) - 3.71) AS k FROM j GROUP BY 1)
SELECT flag, count(*) FILTER (abs(l_extendedprice - m) > k * (hi - lo)) AS n_out FROM lineitem JOIN q ON l_returnflag = flag GROUP BY 1""",
)
def _(spark, d):
    out = robust.carling(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("value")), ["flag"])
    return out.groupBy("flag").agg(F.sum(F.col("outlier").cast("long")).alias("n_out"))


@_entry(
    "rank_statistics",
    f"""WITH e AS (SELECT user_id AS subject, value AS x, CAST(hour(ts) AS DOUBLE) AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT a.subject, a.n, sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy, abs(a.x - b.x) AS gap, (a.x + b.x) / 2 AS walsh FROM e a JOIN e b ON a.subject = b.subject AND a.i < b.i),
t AS (SELECT subject, sum(dx * dy) AS s, sqrt(CAST(count(*) FILTER (dx <> 0) AS DOUBLE) * count(*) FILTER (dy <> 0)) AS scale FROM p GROUP BY 1),
w AS (SELECT subject, median(walsh) AS location FROM (SELECT subject, walsh FROM p UNION ALL SELECT subject, x FROM e) GROUP BY 1),
g AS (SELECT subject, n, gap, row_number() OVER (PARTITION BY subject ORDER BY gap) AS r FROM p),
q AS (SELECT subject, 2.2219 * gap * CASE WHEN n <= 9 THEN [0.399, 0.994, 0.512, 0.844, 0.611, 0.857, 0.669, 0.872][n - 1] WHEN n % 2 = 1 THEN n / (n + 1.4) ELSE n / (n + 3.8) END AS qn FROM g WHERE r = (n // 2 + 1) * (n // 2) // 2)
SELECT w.subject, {_R('CASE WHEN scale > 0 THEN s / scale END', 'tau')}, {_R('location', 'location')}, {_R('qn', 'qn')} FROM w LEFT JOIN t ON w.subject = t.subject LEFT JOIN q ON w.subject = q.subject""",
)
def _(spark, d):
    return pairs.rank_statistics(table(spark, d, "events").select(F.col("user_id").alias("subject"), "value", F.hour(F.col("ts").cast("timestamp")).cast("double").alias("hour")), ["subject"], "value", "hour")


@_entry(
    "first_level_plan",
    f"""WITH b AS (SELECT vec_id, label // 2 AS label, embedding, row_number() OVER (PARTITION BY label // 2 ORDER BY {_KEY}) AS r FROM embeddings WHERE label < 4), m AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM b GROUP BY label)),
f AS (SELECT b.vec_id, b.label, b.embedding, CAST((SELECT min(k) FROM generate_series(1, 5) AS g(k) WHERE b.r <= ROUND(CAST(k * m.n AS DOUBLE) / 5)) AS BIGINT) AS fold FROM b, m WHERE b.r <= m.n),
x AS (SELECT vec_id, label, fold, i AS chan, CAST(embedding[i] AS DOUBLE) AS v FROM f, generate_series(1, 64) AS g(i)),
t AS (SELECT k AS fold, chan, avg(v) FILTER (label = 0) AS m0, avg(v) FILTER (label = 1) AS m1, (var_pop(v) FILTER (label = 0) * count(*) FILTER (label = 0) + var_pop(v) FILTER (label = 1) * count(*) FILTER (label = 1)) / (count(*) - 2) AS s FROM x, generate_series(1, 5) AS g(k) WHERE x.fold <> k GROUP BY k, chan),
sc AS (SELECT x.fold, x.vec_id, x.label, ROUND(sum((m1 - m0) / s * (v - (m0 + m1) / 2.0)), 7) AS score FROM x JOIN t ON x.fold = t.fold AND x.chan = t.chan GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS r FROM sc)
SELECT fold, ROUND((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) + 0.0 AS auc FROM rk GROUP BY fold""",
)
def _(spark, d):
    return first_level(epochs(spark, d), FirstLevel({1: [0, 1], 2: [2, 3]}, folds=5, method="diagLinear"))


@_entry(
    "group_level_plan",
    f"""WITH {_HOURS}, g AS (SELECT sample, avg(value) AS mean, count(*) - 1 AS df, (avg(value) - 50.0) / (stddev_samp(value) / sqrt(count(*))) AS t FROM h GROUP BY 1 HAVING count(*) > 1 AND stddev_samp(value) > 0), p AS (SELECT *, {t_two_sided_sql('t', 'df')} AS p FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY p, sample) AS rank, count(*) OVER () AS m FROM p), c AS (SELECT max(p) AS crit FROM r WHERE p <= rank * 0.05 / m)
SELECT sample, {_R('mean', 'mean')}, df, {_R('t', 't')}, {_R('p', 'p')}, 'all' AS family, rank, {_R('crit', 'crit')}, COALESCE(p <= crit, false) AS h FROM r, c""",
)
def _(spark, d):
    return group_level(_by_hour(spark, d), GroupLevel(chance=50.0, correction="fdr_bh"))


@_entry(
    "group_cluster_plan",
    f"""WITH {_HOURS}, f AS (SELECT rep, subject, sample, CASE WHEN rep = 0 OR floor((((rep * 7919 + subject * 104729) * 1103515245 + 12345) % 2147483648) / 65536.0) % 2 = 0 THEN 1.0 ELSE -1.0 END * (value - 50) AS value FROM h, generate_series(0, 100) AS g(rep)),
ts AS (SELECT rep, sample, CASE WHEN count(*) > 1 AND stddev_samp(value) > 0 THEN avg(value) / (stddev_samp(value) / sqrt(count(*))) END AS t FROM f GROUP BY 1, 2), {_RUNS.format(th=0.5, by='rep, ')},
c AS (SELECT rep, sum(abs(t)) AS mass FROM i GROUP BY rep, sign, g), m AS (SELECT rep, COALESCE(max(mass), 0.0) AS mass FROM generate_series(0, 100) AS g(rep) LEFT JOIN c USING (rep) GROUP BY rep),
o AS (SELECT sign, min(sample) AS first, max(sample) AS last, count(*) AS size, sum(abs(t)) AS mass, arg_max(sample, (abs(ROUND(t, 9)), -sample)) AS peak_t FROM i WHERE rep = 0 GROUP BY sign, g)
SELECT sign, first, last, size, {_R('o.mass', 'mass')}, peak_t, {_R('(SELECT avg(CASE WHEN m.mass > o.mass THEN 1.0 ELSE 0.0 END) FROM m WHERE rep > 0)', 'p')} FROM o""",
)
def _(spark, d):
    return group_level(_by_hour(spark, d), GroupLevel(chance=50.0, correction="cluster", threshold=0.5, replicates=100))


@_entry("circ_omnibus", f"WITH {_ANG}, v AS (SELECT g, ROUND(alpha - 2 * pi() * floor(alpha / (2 * pi())), 9) AS v, count(*) AS k FROM a GROUP BY 1, 2), h AS (SELECT x.g, x.v, sum(CASE WHEN (y.v - x.v) - 2 * pi() * floor((y.v - x.v) / (2 * pi())) > 1e-8 AND (y.v - x.v) - 2 * pi() * floor((y.v - x.v) / (2 * pi())) < pi() - 1e-8 THEN y.k ELSE 0 END) AS i, sum(y.k) AS n FROM v x JOIN v y ON x.g = y.g GROUP BY 1, 2), l AS (SELECT g, CAST(max(n) AS BIGINT) AS n, CAST(min(least(i, n - i)) AS BIGINT) AS m FROM h GROUP BY 1), b AS (SELECT *, pi() * sqrt(n) / (2.0 * (n - 2 * m)) AS b FROM l) SELECT g, n, m, {_R('sqrt(2 * pi()) / b * exp(-pi() * pi() / (8 * b * b))', 'p')} FROM b")
def _(spark, d):
    return circ.omnibus(_angles(spark, d), ["g"])


@_entry("first_peak", f"WITH {_MATRIX} SELECT 'all' AS cond, \"row\", col, {_R('value', 'value')} FROM m ORDER BY ROUND(value, 9) DESC, col, \"row\" LIMIT 1")
def _(spark, d):
    return group.first_peak(_matrix(spark, d).withColumn("cond", F.lit("all")), ["cond"])


@_entry("pair_differences", f"WITH b AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1) SELECT x.k AS i, y.k AS j, {_R('x.v - y.v', 'value')} FROM b x JOIN b y ON x.k > y.k")
def _(spark, d):
    means = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("v"))
    return group.pair_differences(means, "k", "v")


@_entry("nearest_level", "WITH l AS (SELECT arg_min(l_tax, (abs(ROUND(l_tax, 2) - 0.05), l_tax)) AS x FROM (SELECT DISTINCT l_tax FROM lineitem)) SELECT l_orderkey, l_linenumber FROM lineitem, l WHERE l_tax = x")
def _(spark, d):
    return group.nearest_level(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), 0.05, "l_tax").select("l_orderkey", "l_linenumber")


@_entry("confidence_correlation", f"WITH c AS (SELECT l_returnflag AS cond, l_suppkey AS subject, corr(l_quantity, l_tax) AS r FROM lineitem GROUP BY 1, 2), z AS (SELECT cond, 0.5 * ln((1 + r) / (1 - r)) AS z FROM c WHERE abs(r) < 1) SELECT cond, {_R('avg(z)', 'mean')}, count(*) - 1 AS df, {_R('avg(z) / (stddev_samp(z) / sqrt(count(*)))', 't')} FROM z GROUP BY 1")
def _(spark, d):
    r = group.correlate(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cond"), F.col("l_suppkey").alias("subject"), "l_quantity", "l_tax"), ["cond", "subject"], "l_quantity", "l_tax")
    return group.one_sample_t(r.where("fisher_z is not null"), ["cond"], 0.0, "fisher_z")


@_entry("codes_in_both", "SELECT p_brand FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_size > 40")
def _(spark, d):
    p = table(spark, d, "part")
    return files.in_both(p.where("p_size < 10").select("p_brand"), p.where("p_size > 40").select("p_brand"))


@_entry("codes_in_one", "SELECT p_type FROM part WHERE p_size < 10 EXCEPT SELECT p_type FROM part WHERE p_size > 48")
def _(spark, d):
    p = table(spark, d, "part")
    return files.only_in_first(p.where("p_size < 10").select("p_type"), p.where("p_size > 48").select("p_type"))


@_entry("text_to_number", "SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS DOUBLE) AS number, c_mktsegment || '_' || c_nationkey AS code FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)$", 1).try_cast("double").alias("number"), F.concat_ws("_", "c_mktsegment", "c_nationkey").alias("code"))


@_entry("rollup_by_region", f"SELECT r_name, n_name, count(*) AS n, {_R('avg(s_acctbal)', 'mean')} FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def _(spark, d):
    dims = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(F.broadcast(dims), F.col("s_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.avg("s_acctbal").alias("mean"))


# channels, samples and further circular statistics ---------------------------------------------------------


@_entry("signal_rereference", f"WITH {_S} SELECT trial_id, t_idx, {_R('value - avg(value) OVER (PARTITION BY event_code, t_idx)', 'value')} FROM s")
def _(spark, d):
    return signals.rereference(samples(spark, d), ["event_code", "t_idx"]).drop("event_code")


@_entry("signal_power", f"SELECT l_returnflag AS g, {_R('sum(l_tax * l_tax * l_quantity)', 'power')}, {_R('CAST(sum(l_quantity) AS DOUBLE)', 'weight')}, {_R('sqrt(sum(l_tax * l_tax * l_quantity) / sum(l_quantity))', 'rms')} FROM lineitem GROUP BY 1")
def _(spark, d):
    own = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_tax").cast("double").alias("value"), F.col("l_quantity").cast("double").alias("w"))
    return signals.power(own, ["g"], weight="w")


@_entry("signal_fold", "SELECT o_orderkey, o_orderkey // 64 AS epoch, o_orderkey % 64 AS t FROM orders")
def _(spark, d):
    return signals.fold(table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("i")), 64)


@_entry("signal_statistics_at_scale", f"WITH {_S} SELECT trial_id, (t_idx - 1) // 16 AS bin, {_R('min(value)', 'least')}, {_R('max(value)', 'most')}, {_R('avg(value)', 'mean')}, {_R('stddev_samp(value)', 'sd')} FROM s GROUP BY 1, 2")
def _(spark, d):
    return signals.statistics_at_scale(samples(spark, d), 16, ["trial_id"])


@_entry("statistics_by_dimension", f"WITH {_MATRIX} SELECT \"row\", col, {_R('min(value)', 'least')}, {_R('max(value)', 'most')}, {_R('avg(value)', 'mean')}, {_R('var_pop(value)', 'variance')} FROM m GROUP BY GROUPING SETS ((\"row\"), (col))")
def _(spark, d):
    return signals.statistics_by_dimension(_matrix(spark, d), ["row", "col"])


@_entry("signal_sparse_filter", f"WITH {_S} SELECT trial_id, t_idx, {_R('value + 0.5 * coalesce(lag(value, 3) OVER w, 0) - 0.25 * coalesce(lag(value, 10) OVER w, 0)', 'value')} FROM s WINDOW w AS (PARTITION BY trial_id ORDER BY t_idx)")
def _(spark, d):
    return signals.sparse_filter(samples(spark, d), {0: 1.0, 3: 0.5, 10: -0.25}, ["trial_id"]).select("trial_id", "t_idx", "value")


@_entry(
    "signal_resample",
    f"WITH j AS (SELECT j, CAST(floor(j * 0.75) AS BIGINT) AS i, j * 0.75 - floor(j * 0.75) AS f FROM generate_series(0, 84) AS g(j)), v AS (SELECT vec_id, j, f, CAST(embedding[i + 1] AS DOUBLE) AS a, CAST(embedding[i + 2] AS DOUBLE) AS b FROM embeddings, j WHERE i < 64) SELECT vec_id AS trial_id, j, {_R('a + f * coalesce(b - a, 0)', 'value')} FROM v",
)
def _(spark, d):
    return signals.resample_linear(samples(spark, d), 0.75, ["trial_id"])


@_entry("outlier_trials", f"WITH {_S}, m AS (SELECT t_idx, avg(value) AS m FROM s GROUP BY 1), q AS (SELECT trial_id, sum((value - m) * (value - m)) AS q FROM s JOIN m USING (t_idx) GROUP BY 1) SELECT trial_id, {_R('q / (SELECT avg(q) FROM q)', 'deviation')}, q / (SELECT avg(q) FROM q) > 1.02 AS outlier FROM q")
def _(spark, d):
    return signals.outlier_trials(samples(spark, d), 1.02)


@_entry("interpolate_channels", f"WITH {_S}, g AS (SELECT trial_id, t_idx AS chan, value FROM s), n AS (SELECT a AS chan, b AS near, abs(a - b) AS distance FROM generate_series(1, 64) x(a), generate_series(1, 64) y(b) WHERE abs(a - b) BETWEEN 1 AND 3) SELECT trial_id, chan, {_R('value', 'value')} FROM g WHERE chan NOT IN (7, 8, 30) UNION ALL SELECT trial_id, n.chan, {_R('sum(value / distance) / sum(1.0 / distance)', 'value')} FROM g JOIN n ON g.chan = near WHERE n.chan IN (7, 8, 30) AND near NOT IN (7, 8, 30) GROUP BY 1, 2")
def _(spark, d):
    line = spark.range(1, 65).select(F.col("id").alias("chan"), F.explode(F.sequence(F.col("id") - 3, F.col("id") + 3)).alias("near"))
    neighbours = line.where("near between 1 and 64 and near <> chan").withColumn("distance", F.abs(F.col("chan") - F.col("near")))
    return signals.interpolate_channels(samples(spark, d).withColumnRenamed("t_idx", "chan"), [7, 8, 30], neighbours, ["trial_id"])


@_entry("morton_order", "SELECT p_partkey, CAST(sum((((p_size >> k) & 1) << (2 * k + 1)) + ((((p_partkey % 65536) >> k) & 1) << (2 * k))) AS BIGINT) AS place FROM part, (SELECT CAST(unnest(generate_series(0, 15)) AS INTEGER) AS k) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", signals.morton(F.col("p_size"), F.col("p_partkey") % 65536).alias("place"))


@_entry("peak_sign", f"WITH {_S} SELECT trial_id, {_R('sign(arg_max(value, (abs(value), -t_idx)))::DOUBLE', 'sign')} FROM s GROUP BY 1")
def _(spark, d):
    return signals.peak_sign(samples(spark, d), ["trial_id"])


_XY = "q AS (SELECT a.vec_id AS g, i AS t, CAST(a.embedding[i] AS DOUBLE) AS x, CAST(a.embedding[65 - i] AS DOUBLE) AS y FROM embeddings a, generate_series(1, 64) AS g(i))"


def _two_signals(spark: SparkSession, d: str) -> DataFrame:
    mirrored = epochs(spark, d).select(F.col("trial_id").alias("g"), F.posexplode(F.arrays_zip("x", F.reverse("x").alias("y"))).alias("t", "v"))
    return mirrored.select("g", (F.col("t") + 1).alias("t"), "v.x", "v.y")


@_entry("signal_cross_correlation", f"WITH {_XY}, l AS (SELECT g, lag, x, lead(y, CAST(lag AS INTEGER)) OVER (PARTITION BY g, lag ORDER BY t) AS z FROM q, (VALUES (0), (1), (5)) v(lag)) SELECT g, lag, {_R('corr(x, z)', 'r')}, count(*) AS n FROM l WHERE z IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return signals.cross_correlation(_two_signals(spark, d), [0, 1, 5], ["g"])


@_entry("signal_relative_shift", f"WITH {_XY}, l AS (SELECT g, t, x, lead(y, 4) OVER (PARTITION BY g ORDER BY t) AS y FROM q) SELECT g, t, {_R('x', 'x')}, {_R('y', 'y')} FROM l WHERE y IS NOT NULL")
def _(spark, d):
    return signals.relative_shift(_two_signals(spark, d), 4, ["g"])


@_entry("discriminability", f"WITH {_S} SELECT t_idx, {_R('abs(avg(value) FILTER (event_code = 0) - avg(value) FILTER (event_code = 1)) / sqrt((var_samp(value) FILTER (event_code = 0) + var_samp(value) FILTER (event_code = 1)) / 2)', 'd')} FROM s GROUP BY 1")
def _(spark, d):
    return signals.discriminability(samples(spark, d), ["t_idx"], "event_code", 0, 1)


@_entry("trend_windows", f"WITH {_S}, w AS (SELECT trial_id, t_idx, regr_slope(value, t_idx) OVER w AS b, regr_r2(value, t_idx) OVER w AS r, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY trial_id ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) SELECT trial_id, t_idx AS start, {_R('b', 'slope')}, {_R('r', 'r2')}, abs(b) >= 0.01 AND r >= 0.3 AS rejected FROM w WHERE n = 16 AND (t_idx - 1) % 8 = 0")
def _(spark, d):
    return signals.trends(samples(spark, d), 16, 8, 0.01, 0.3, ["trial_id"])


@_entry("spatial_difference", f"WITH {_S} SELECT trial_id, {_R('abs(avg(value) FILTER (t_idx <= 8)) - abs(avg(value) FILTER (t_idx > 56))', 'difference')} FROM s GROUP BY 1")
def _(spark, d):
    return signals.spatial_difference(samples(spark, d).withColumnRenamed("t_idx", "chan"), list(range(1, 9)), list(range(57, 65)), ["trial_id"])


@_entry("standard_scores", f"SELECT c_custkey, {_R('(c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w', 'z')} FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def _(spark, d):
    own = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("double").alias("value"))
    return signals.standardise(own, ["c_nationkey"]).select("c_custkey", "z")


@_entry("explained_share", f"SELECT l_returnflag AS g, {_R('greatest(0, 1 - avg((l_extendedprice - 1000 * l_quantity) * (l_extendedprice - 1000 * l_quantity)) / var_pop(l_extendedprice))', 'r2')}, {_R('sqrt(avg((l_extendedprice - 1000 * l_quantity) * (l_extendedprice - 1000 * l_quantity)))', 'rmse')} FROM lineitem GROUP BY 1")
def _(spark, d):
    own = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_quantity") * 1000.0).cast("double").alias("f"))
    return signals.explained(own, ["g"], "y", "f")


@_entry("joint_density", "WITH b AS (SELECT CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 60 THEN 7 ELSE floor(l_quantity / 10) + 1 END AS bx, CASE WHEN l_extendedprice < 0 THEN 0 WHEN l_extendedprice >= 60000 THEN 7 ELSE floor(l_extendedprice / 10000) + 1 END AS y FROM lineitem) SELECT CAST(bx AS BIGINT) AS bx, CAST(y AS BIGINT) AS \"by\", count(*) AS n FROM b GROUP BY 1, 2")
def _(spark, d):
    own = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return signals.joint_density(own, "x", "y", (0, 60), (0, 60000), 6)


@_entry("circ_axial_mean", f"WITH {_ANG}, x AS (SELECT g, avg(cos(3 * alpha)) AS c, avg(sin(3 * alpha)) AS s FROM a GROUP BY 1) SELECT g, {_R('sqrt(c * c + s * s)', 'r')}, {_R('atan2(s, c) / 3', 'mu')} FROM x")
def _(spark, d):
    return circ.axial_mean(_angles(spark, d), ["g"], 3)


_NARROW = "a AS (SELECT o_orderpriority AS g, dayofyear(o_orderdate) / 200.0 AS alpha FROM orders)"


def _narrow_angles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), (F.dayofyear("o_orderdate") / F.lit(200.0)).alias("alpha"))


_HALF = f"{_NARROW}, m AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(cos(alpha)) AS c, sum(sin(alpha)) AS s FROM a GROUP BY 1), l AS (SELECT *, sqrt(c * c + s * s) AS l, 3.841458820694124 AS x FROM m), h AS (SELECT g, atan2(s, c) AS mu, acos(CASE WHEN l / n >= 0.9 THEN sqrt(n * n - (n * n - l * l) * exp(x / n)) WHEN l / n > sqrt(x / 2 / n) THEN sqrt(2 * n * (2 * l * l - n * x) / (4 * n - x)) END / l) AS half FROM l)"


@_entry("circ_confidence", f"WITH {_HALF} SELECT g, {_R('mu', 'mu')}, {_R('half', 'half')} FROM h")
def _(spark, d):
    return circ.confidence(_narrow_angles(spark, d), ["g"])


@_entry("circ_mean_test", f"WITH {_HALF} SELECT g, {_R('mu', 'mu')}, abs(atan2(sin(0.9 - mu), cos(0.9 - mu))) > half AS rejected FROM h")
def _(spark, d):
    return circ.mean_test(_narrow_angles(spark, d), ["g"], 0.9)


@_entry("circ_equal_concentration", f"WITH {_NARROW}, m AS (SELECT CAST(count(*) FILTER (g = '1-URGENT') AS DOUBLE) AS n1, CAST(count(*) FILTER (g = '5-LOW') AS DOUBLE) AS n2, sqrt(sum(cos(alpha)) FILTER (g = '1-URGENT') ** 2 + sum(sin(alpha)) FILTER (g = '1-URGENT') ** 2) AS l1, sqrt(sum(cos(alpha)) FILTER (g = '5-LOW') ** 2 + sum(sin(alpha)) FILTER (g = '5-LOW') ** 2) AS l2 FROM a), f AS (SELECT *, (n2 - 1) * (n1 - l1) / ((n1 - 1) * (n2 - l2)) AS f FROM m) , r AS (SELECT CASE WHEN f > 1 THEN f ELSE 1 / f END AS f, CASE WHEN f > 1 THEN n1 ELSE n2 END AS df1, CASE WHEN f > 1 THEN n2 ELSE n1 END AS df2 FROM f) SELECT {_R('f', 'f')}, df1, df2, {_R('2 * ' + f_upper_sql('f', 'df1', 'df2'), 'p')} FROM r")
def _(spark, d):
    return circ.equal_concentration(_narrow_angles(spark, d), "g", "1-URGENT", "5-LOW")


@_entry("circ_rao_spacing", f"WITH {_ANG}, o AS (SELECT g, ROUND(degrees(alpha - 2 * pi() * floor(alpha / (2 * pi()))), 9) AS v FROM a), l AS (SELECT g, count(*) OVER p AS n, coalesce(lead(v) OVER (PARTITION BY g ORDER BY v), 360 + min(v) OVER p) - v AS gap FROM o WINDOW p AS (PARTITION BY g)) SELECT g, max(n) AS n, {_R('sum(abs(gap - 360.0 / n)) / 2', 'u')} FROM l GROUP BY 1")
def _(spark, d):
    return circ.rao_spacing(_angles(spark, d), ["g"])


@_entry("circ_kuiper", f"WITH {_ANG}, b AS (SELECT g, CAST(floor((alpha - 2 * pi() * floor(alpha / (2 * pi()))) / (2 * pi()) * 100 + 1e-12) AS BIGINT) + 1 AS bin FROM a WHERE g IN ('1-URGENT', '5-LOW')), c AS (SELECT k, count(*) FILTER (g = '1-URGENT' AND bin <= k) / CAST(count(*) FILTER (g = '1-URGENT') AS DOUBLE) - count(*) FILTER (g = '5-LOW' AND bin <= k) / CAST(count(*) FILTER (g = '5-LOW') AS DOUBLE) AS d FROM b, generate_series(1, 100) AS x(k) GROUP BY 1) SELECT {_R('(SELECT CAST(count(*) FILTER (g = \'1-URGENT\') * count(*) FILTER (g = \'5-LOW\') AS DOUBLE) FROM b) * (greatest(max(d), 0) + greatest(max(-d), 0))', 'k')} FROM c")
def _(spark, d):
    return circ.kuiper(_angles(spark, d), "g", "1-URGENT", "5-LOW")


# matrix models (tested against numpy) ---------------------------------------------------------------------


def _matrix_query(name: str, f: Query, sql: str | None = None) -> None:
    _entry(name, sql)(f)


_HANN = f"""WITH {_S}, w AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * t_idx / 65) AS h FROM s), c AS (SELECT trial_id, freq, value * h / sqrt((SELECT sum(h * h) FROM (SELECT DISTINCT t_idx, h FROM w))) AS v, 2 * pi() * freq * (t_idx - 1) / 64.0 AS a FROM w, (VALUES (4.0), (8.0), (16.0)) AS f(freq))
SELECT trial_id, CAST(freq AS DOUBLE) AS freq, {_R('pow(sum(v * cos(a)), 2) + pow(sum(v * sin(a)), 2)', 'power')} FROM c GROUP BY 1, 2"""


def _detrend_sql(rounds: int = 4) -> str:
    """Lines fitted to the samples that are left, which are those within three deviations of the line before."""
    out = f"WITH {_S}, r0 AS (SELECT trial_id, t_idx, value AS x, -1 + 2.0 * (t_idx - 1) / 63 AS u, true AS w FROM s)"
    for k in range(1, rounds + 1):
        out += f""", f{k} AS (SELECT trial_id, regr_slope(x, u) FILTER (w) AS b, regr_intercept(x, u) FILTER (w) AS a FROM r{k - 1} GROUP BY 1),
d{k} AS (SELECT r.trial_id, t_idx, x, u, w, x - a - b * u AS d FROM r{k - 1} r JOIN f{k} f ON f.trial_id = r.trial_id),
r{k} AS (SELECT trial_id, t_idx, x, u, d, w AND abs(d) <= 3 * stddev_pop(CASE WHEN w THEN d ELSE 0 END) OVER (PARTITION BY trial_id) AS w FROM d{k})"""
    return out + f" SELECT trial_id, t_idx - 1 AS t_idx, {_R('d', 'value')} FROM r{rounds}"


_matrix_query("lda_linear", lambda spark, d: metrics.auc(decode.decode_folds(_two_classes(spark, d)).where("class = 1"), ["fold"]))
_matrix_query("lda_whitened", lambda spark, d: metrics.auc(decode.decode_folds(_two_classes(spark, d), "diaglinear", True).where("class = 1"), ["fold"]))
_matrix_query("lda_quadratic", lambda spark, d: metrics.auc(decode.decode_folds(_two_classes(spark, d), "quadratic").where("class = 1"), ["fold"]))
_matrix_query("weights_and_patterns", lambda spark, d: decode.weights_and_patterns(_two_classes(spark, d).withColumn("subject", F.lit("s1"))))
_matrix_query("forward_model", lambda spark, d: decode.forward_model(design.folds(epochs(spark, d).where("event_code < 10").withColumn("class", F.col("event_code")), 5), 10))
_matrix_query("oversample_adasyn", lambda spark, d: decode.oversample(epochs(spark, d).withColumn("class", F.col("event_code")).withColumn("subject", F.lit("s1"))).select("class", "k", F.posexplode("x").alias("t_idx", "value")))
_matrix_query("tfr_hann_power", lambda spark, d: arrays.spectral_power(epochs(spark, d), 64.0, [4.0, 8.0, 16.0]), _HANN)
_matrix_query("robust_detrend", lambda spark, d: arrays.robust_detrend(epochs(spark, d), 1).select("trial_id", F.posexplode("x").alias("t_idx", "value")), _detrend_sql())
_matrix_query("principal_components", lambda spark, d: arrays.apply_filters(epochs(spark, d), arrays.principal(arrays.covariance(epochs(spark, d))[0])[1][:, :3]).select("trial_id", F.posexplode("x").alias("component", "value")))
def _islands(sign: int) -> str:
    n = "p" if sign > 0 else "n"
    return f"""k{n} AS (SELECT "row" AS r, col AS c, value - 0.05 AS value, col * 1000 + "row" AS id FROM m WHERE {sign} * (value - 0.05) > 0.0005),
z{n}(id, r, c, top) AS (SELECT id, r, c, id FROM k{n} UNION SELECT k.id, k.r, k.c, z.top FROM z{n} z JOIN k{n} k ON abs(k.r - z.r) <= 1 AND abs(k.c - z.c) <= 1),
t{n} AS (SELECT id, min(top) AS top FROM z{n} GROUP BY 1), c{n} AS (SELECT {sign} AS sign, dense_rank() OVER (ORDER BY top) AS cluster, value FROM t{n} JOIN k{n} USING (id))"""


_entry("grid_clusters", f"WITH RECURSIVE {_MATRIX}, {_islands(1)}, {_islands(-1)} SELECT 'discount' AS cond, sign, cluster, count(*) AS size, {_R('sum(abs(value))', 'mass')} FROM (SELECT * FROM cp UNION ALL SELECT * FROM cn) GROUP BY sign, cluster")(lambda spark, d: clusters.grid_clusters(_matrix(spark, d).withColumn("value", F.col("value") - 0.05).withColumn("cond", F.lit("discount")), 0.0005))


from epochal.queries import angles, arrays_more, components, decoding, design_more, matched, permutation, rank_pairs, recordings, statistics, trimmed_fits  # noqa: E402, F401  (they register themselves)
