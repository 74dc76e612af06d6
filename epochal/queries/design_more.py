"""Queries of channels, files, names, result tables and the group level's further steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.functions import text as T
from epochal.functions.dist import z_of
from epochal.operators import channels, files, group, results
from epochal.registry import HOURS, KEY, MATRIX, SAMPLES, entry, normal_quantile_sql, rounded
from epochal.sources.adapters import behaviour, epochs, samples, table

_R, _S = rounded, SAMPLES
_NAMES = channels.BUNDLES["OCCIPARIET"]
_LABEL = "CASE " + " ".join(f"WHEN t_idx = {k} THEN '{name}'" for k, name in enumerate(_NAMES, 1)) + " ELSE 'X' || t_idx END"
_LABELLED = f"{_S}, l AS (SELECT *, {_LABEL} AS label FROM s)"
_LIST = lambda labels: ", ".join(f"'{x}'" for x in labels)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in _NAMES])
    return samples(spark, d).withColumn("label", F.when(F.col("t_idx") <= len(_NAMES), F.element_at(names, F.col("t_idx"))).otherwise(F.concat(F.lit("X"), F.col("t_idx"))))


# channels -------------------------------------------------------------------------------------------------


@entry("select_channels", f"WITH {_LABELLED} SELECT trial_id, label, {_R('value', 'value')} FROM l WHERE label IN ({_LIST(channels.BUNDLES['OCCIP'])})")
def _(spark, d):
    return channels.select(_labelled(spark, d), "occip").select("trial_id", "label", "value")


@entry("select_channel_mean", f"WITH {_LABELLED} SELECT trial_id, 'PO7,PO8,X40' AS label, {_R('avg(value)', 'value')} FROM l WHERE label IN ('PO7', 'PO8', 'X40') GROUP BY 1")
def _(spark, d):
    return channels.select_mean(_labelled(spark, d), ["PO7", "PO8", "X40"], ["trial_id"])


@entry("align_channels", "WITH a AS (SELECT n_nationkey AS place, n_name AS label FROM nation WHERE n_nationkey % 3 <> 0), b AS (SELECT 24 - n_nationkey AS place, n_name AS label FROM nation WHERE n_nationkey % 2 = 0) SELECT a.place, a.label, b.place AS place_2 FROM a JOIN b USING (label)")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("label"))
    return channels.aligned(n.where("place % 3 <> 0"), n.where("place % 2 = 0").withColumn("place", 24 - F.col("place")))


@entry("channel_order", "WITH f AS (SELECT event_type AS label, min((ts, event_id)) AS first FROM events GROUP BY 1) SELECT label, row_number() OVER (ORDER BY first) AS place FROM f")
def _(spark, d):
    return channels.stable_order(table(spark, d, "events").withColumnRenamed("event_type", "label"), "label", ["ts", "event_id"])


@entry("channel_order_statistic", f"WITH {_S} SELECT trial_id, {_R('list_sort(list(-value))[3] * -1', 'third')} FROM s GROUP BY 1")
def _(spark, d):
    return epochs(spark, d).select("trial_id", channels.order_statistic(3).alias("third"))


_GRID = "p AS (SELECT 'E' || i AS label, i % 8 * 1.0 AS x, i // 8 * 1.0 AS y, (i % 3) * 0.4 AS z FROM generate_series(0, 63) AS g(i))"


def _positions(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(64).select(F.concat(F.lit("E"), i).alias("label"), (i % 8 * 1.0).alias("x"), (F.expr("id div 8") * 1.0).alias("y"), ((i % 3) * 0.4).alias("z"))


@entry("electrode_adjacency", f"WITH {_GRID} SELECT a.label, b.label AS other FROM p a JOIN p b ON a.label <> b.label WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 1.5 * 1.5 + 1e-9")
def _(spark, d):
    return channels.adjacency(_positions(spark), 1.5)


@entry("channel_connectivity", "WITH e AS (SELECT a.n_name AS label, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = a.n_nationkey + 1), u AS (SELECT * FROM e UNION SELECT other, label FROM e), k AS (SELECT n_name AS label FROM nation WHERE n_nationkey % 7 <> 0) SELECT label, other FROM u WHERE label IN (SELECT label FROM k) AND other IN (SELECT label FROM k)")
def _(spark, d):
    n = table(spark, d, "nation")
    pairs = n.select("n_regionkey", F.col("n_nationkey").alias("k"), F.col("n_name").alias("label")).join(n.select("n_regionkey", (F.col("n_nationkey") - 1).alias("k"), F.col("n_name").alias("other")), ["n_regionkey", "k"])
    lists = pairs.groupBy("label").agg(F.collect_list("other").alias("neighbours"))
    return channels.connectivity(lists, n.where("n_nationkey % 7 <> 0").select(F.col("n_name").alias("label")))


@entry("channel_positions", f"WITH {_GRID}, c AS (SELECT label, CASE WHEN length(label) = 2 THEN NULL ELSE x + 100 END AS x FROM p WHERE label <> 'E5') SELECT c.label, {_R('COALESCE(c.x, p.x)', 'x')}, {_R('p.y', 'y')}, {_R('p.z', 'z')} FROM c LEFT JOIN p ON c.label = p.label")
def _(spark, d):
    p = _positions(spark)
    own = p.where("label <> 'E5'").select("label", F.when(F.length("label") > 2, F.col("x") + 100).alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("z"))
    return channels.with_positions(own, p)


@entry("merge_sessions", "SELECT 's1_a' AS session, c_custkey, c_acctbal FROM customer WHERE c_nationkey = 1 UNION ALL SELECT 's1_b', c_custkey, c_acctbal FROM customer WHERE c_nationkey = 2")
def _(spark, d):
    of = lambda n: table(spark, d, "customer").where(F.col("c_nationkey") == n).select("c_custkey", "c_acctbal")
    return channels.merge_sessions({"s1_b": of(2), "s1_a": of(1), "s2_a": of(3)}, "^s1_")


@entry("copy_events", "SELECT o_orderkey, o_totalprice, l_returnflag AS code FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1")
def _(spark, d):
    first = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("code"))
    return channels.copy_events(table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(None).cast("string").alias("code")), first, ["o_orderkey"], ["code"])


@entry("match_scores", f"WITH a AS (SELECT vec_id, label, embedding[1] AS v FROM embeddings WHERE vec_id % 5 <> 0), b AS (SELECT vec_id, label, embedding[2] AS v FROM embeddings WHERE vec_id % 3 <> 0) SELECT a.vec_id AS trial_id, a.label AS event_code, {_R('CAST(a.v AS DOUBLE)', 'score_1')}, {_R('CAST(b.v AS DOUBLE)', 'score_2')}, count(*) OVER () < (SELECT count(*) FROM a) * 0.8 AS few FROM a JOIN b ON a.vec_id = b.vec_id")
def _(spark, d):
    of = lambda k, n: epochs(spark, d).where(F.col("trial_id") % n != 0).select("trial_id", "event_code", F.col("x")[k].alias("score"))
    return channels.matched_trials(of(0, 5), of(1, 3))


_TRIALS = "t AS (SELECT user_id AS subject, event_id AS trial_id, CAST(ROUND(epoch_us(ts) / 1000.0) AS BIGINT) - 3600000 AS start_ms, CAST(ROUND(epoch_us(ts) / 1000.0) AS BIGINT) + 7200000 AS stop_ms FROM events WHERE event_type = 'click'), b AS (SELECT user_id AS subject, CAST(ROUND(epoch_us(ts) / 1000.0) AS BIGINT) AS start_ms, CAST(ROUND(epoch_us(ts) / 1000.0) AS BIGINT) + 600000 AS stop_ms FROM events WHERE event_type = 'error')"


@entry("artifact_trials", f"WITH {_TRIALS} SELECT subject, trial_id FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.subject = t.subject AND (b.start_ms > t.start_ms AND b.start_ms < t.stop_ms OR b.stop_ms > t.start_ms AND b.stop_ms < t.stop_ms))")
def _(spark, d):
    e = behaviour(spark, d)
    trials = e.where("event = 'click'").select("subject", F.col("event_id").alias("trial_id"), (F.col("time_ms") - 3600000).alias("start_ms"), (F.col("time_ms") + 7200000).alias("stop_ms"))
    bad = e.where("event = 'error'").select("subject", F.col("time_ms").alias("start_ms"), (F.col("time_ms") + 600000).alias("stop_ms"))
    return channels.artifact_trials(trials, bad, 3600000).select("subject", "trial_id")


@entry("continuous_events", "WITH e AS (SELECT user_id AS subject, event_id, CAST(ROUND(epoch_us(ts) / 1000.0) AS BIGINT) AS time_ms, event_type FROM events), r AS (SELECT subject, min(time_ms) AS a, max(time_ms) AS b FROM e GROUP BY 1) SELECT e.subject, event_id, time_ms, CASE WHEN time_ms - 86400000 >= a AND time_ms + 172800000 <= b THEN event_type END AS code FROM e JOIN r ON e.subject = r.subject")
def _(spark, d):
    e = behaviour(spark, d).withColumnRenamed("event", "code")
    recording = e.groupBy("subject").agg(F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"))
    return channels.continuous_events(e, recording, -86400000, 172800000)


# names and files ----------------------------------------------------------------------------------------------


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("place"))


@entry("file_list_restrict", "SELECT 'results/' || n_name AS name FROM nation WHERE contains(n_name, 'I') AND contains(n_name, 'A')")
def _(spark, d):
    return _names(spark, d).where(T.has_all("name", ["I", "A"])).select(T.with_prefix("name", "results/").alias("name"))


@entry("file_list_combine", "WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS k FROM nation WHERE n_nationkey < 12), b AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS k FROM nation WHERE n_nationkey BETWEEN 12 AND 23) SELECT a.n_name || ';' || b.n_name AS pair FROM a JOIN b USING (k)")
def _(spark, d):
    n = _names(spark, d)
    return files.zipped(n.where("place < 12"), n.where("place between 12 and 23"))


@entry("file_list_patterns", "WITH p AS (SELECT * FROM (VALUES ('AN'), ('IA'), ('QQ')) AS v(pattern)) SELECT pattern, COALESCE((SELECT arg_max(n_name, n_nationkey) FROM nation WHERE n_nationkey < 12 AND contains(n_name, pattern)), '') || ';' || COALESCE((SELECT arg_max(n_name, n_nationkey) FROM nation WHERE n_nationkey >= 12 AND contains(n_name, pattern)), '') AS pair FROM p")
def _(spark, d):
    n = _names(spark, d)
    return files.zipped_by_pattern(n.where("place < 12"), n.where("place >= 12"), spark.createDataFrame([("AN",), ("IA",), ("QQ",)], "pattern string"))


@entry("train_test_pairs", "SELECT a.n_name AS train, b.n_name AS test FROM nation a JOIN nation b ON a.n_name <> b.n_name")
def _(spark, d):
    return files.train_test_pairs(_names(spark, d))


@entry("missing_files", "SELECT a.n_name AS train, b.n_name AS test FROM nation a JOIN nation b ON a.n_name <> b.n_name WHERE NOT EXISTS (SELECT 1 FROM supplier s JOIN customer c ON s.s_nationkey % 5 = c.c_nationkey % 5 WHERE s.s_nationkey = a.n_nationkey AND c.c_nationkey = b.n_nationkey)")
def _(spark, d):
    n = _names(spark, d)
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("place"), (F.col("s_nationkey") % 5).alias("m")).distinct().join(n, "place").select("m", F.col("name").alias("train"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("place"), (F.col("c_nationkey") % 5).alias("m")).distinct().join(n, "place").select("m", F.col("name").alias("test"))
    return files.missing(files.train_test_pairs(n), s.join(c, "m"), ["train", "test"])


@entry("job_arguments_together", "SELECT n_nationkey AS place, n_name, r_name FROM nation JOIN region ON n_nationkey = r_regionkey")
def _(spark, d):
    return files.job_arguments([table(spark, d, "nation").select(F.col("n_nationkey").alias("place"), "n_name"), table(spark, d, "region").select(F.col("r_regionkey").alias("place"), "r_name")], together=True)


@entry("delimited_rows", "SELECT n_nationkey || ';' || n_name || ';' || COALESCE(CASE WHEN n_regionkey > 2 THEN n_regionkey::VARCHAR END, '') AS value FROM nation")
def _(spark, d):
    return files.delimited(table(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 2, F.col("n_regionkey"))), ";")


@entry("joined_and_parted", "WITH g AS (SELECT n_regionkey AS k, list_sort(list(n_name)) AS names FROM nation GROUP BY 1) SELECT k, array_to_string(names, ',') AS joined, len(names) AS n, names[2] AS second FROM g")
def _(spark, d):
    g = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.concat(F.sort_array(F.collect_list("n_name")), F.array(F.lit(""), F.lit(None))).alias("names"))
    j = g.select("k", T.joined("names").alias("joined")).withColumn("parts", T.parted("joined"))
    return j.select("k", "joined", F.size("parts").alias("n"), F.col("parts")[1].alias("second"))


@entry(
    "longest_common_name",
    """WITH p AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey),
c AS (SELECT a, b, i, k, substr(a, i, k) AS s FROM p, generate_series(1, 30) AS x(i), generate_series(2, 30) AS y(k) WHERE i + k - 1 <= length(a) AND contains(b, substr(a, i, k)))
SELECT p.a, p.b, COALESCE(s, '') AS common FROM p LEFT JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY k DESC, i) = 1) q ON p.a = q.a AND p.b = q.b""",
)
def _(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").where("i < j").select("a", "b", T.longest_common(F.col("a"), F.col("b")).alias("common"))


# result tables ----------------------------------------------------------------------------------------------------


@entry("average_folds", f"WITH p AS (SELECT l_suppkey AS subject, l_linenumber AS fold, l_returnflag AS cond, avg(l_discount) AS value FROM lineitem GROUP BY 1, 2, 3) SELECT subject, cond, {_R('avg(value)', 'value')}, count(*) AS n FROM p GROUP BY 1, 2")
def _(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("fold"), F.col("l_returnflag").alias("cond")).agg(F.avg("l_discount").alias("value"))
    return results.average(p, ["fold"])


@entry("average_grouptraining", f"SELECT regexp_extract(c_name, '#0*([0-9])', 1) AS subject, {_R('avg(c_acctbal)', 'value')}, count(c_acctbal) AS n FROM customer WHERE regexp_extract(c_name, '#0*([0-9])', 1) <> '' GROUP BY 1")
def _(spark, d):
    return results.average_by_test_subject(table(spark, d, "customer").select("c_name", F.col("c_acctbal").alias("value")), "c_name", "#0*([0-9])")


@entry("first_fold_trials", f"WITH o AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY {KEY}) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings), f AS (SELECT CASE WHEN r <= ROUND(CAST(n AS DOUBLE) / 5) THEN 1 ELSE 0 END AS one FROM o) SELECT sum(1 - one)::BIGINT AS n_train, sum(one)::BIGINT AS n_test FROM f")
def _(spark, d):
    from epochal.operators import design

    return results.first_fold_trials(design.folds(epochs(spark, d).drop("x"), 5, "event_code"))


@entry("drop_unbalanced", f"WITH o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {KEY}) AS k FROM embeddings WHERE label IN (0, 1, 2)), k AS (SELECT vec_id FROM o WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM o GROUP BY label))) SELECT vec_id AS trial_id, label AS event_code FROM embeddings WHERE label NOT IN (0, 1, 2) OR vec_id IN (SELECT vec_id FROM k)")
def _(spark, d):
    from epochal.operators import design

    trials = epochs(spark, d).drop("x")
    return results.drop_unbalanced(trials, [0, 1, 2], design.balance(trials.where("event_code in (0, 1, 2)"))).select("trial_id", "event_code")


_PS = f"{HOURS}, q AS (SELECT sample AS t, avg(value) AS m, exp(-abs(avg(value) - 50.0)) AS p, sign(avg(value) - 50.0)::INT AS sign FROM h GROUP BY 1)"


def _p_values(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "events").groupBy(F.col("user_id").alias("subject"), (F.hour(F.col("ts").cast("timestamp")) + 1).alias("t")).agg(F.avg("value").alias("value"))
    m = F.avg("value") - 50.0
    return h.groupBy("t").agg(F.exp(-F.abs(m)).alias("p"), F.signum(m).cast("int").alias("sign"))


@entry("stats_mask", f"WITH {_PS} SELECT t, {_R('CASE WHEN t BETWEEN 5 AND 15 THEN p ELSE 1 END', 'p')}, CASE WHEN t BETWEEN 5 AND 15 THEN sign ELSE 0 END AS sign FROM q")
def _(spark, d):
    return results.masked(_p_values(spark, d), F.col("t").between(5, 15))


@entry("p_value_clusters", f"WITH {_PS}, k AS (SELECT *, t - row_number() OVER (PARTITION BY sign ORDER BY t) AS i FROM q WHERE p < 0.3 AND sign <> 0) SELECT sign, min(t) AS first, max(t) AS last, count(*) AS size, {_R('avg(p)', 'p')} FROM k GROUP BY sign, i")
def _(spark, d):
    return results.p_clusters(_p_values(spark, d), 0.3)


@entry("next_run", "SELECT min(n) AS next FROM generate_series(1, 200000) AS g(n) WHERE n NOT IN (SELECT l_linenumber FROM lineitem)")
def _(spark, d):
    return results.next_run(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("iteration")))


def _fold_sql(n: int, even: bool) -> str:
    c = f"list_concat([x[{n}]], x[1:{n}])" if even else f"x[1:{n}]"
    return f"c AS (SELECT vec_id AS k, {c} AS c FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings))"


@entry("tuning_slope", f"WITH {_fold_sql(8, True)}, h AS (SELECT k, i, (c[i] + c[10 - i]) / 2 AS v FROM c, generate_series(1, 5) AS g(i)) SELECT k, {_R('regr_slope(v, i)', 'slope')}, {_R('regr_intercept(v, i)', 'level')} FROM h GROUP BY 1")
def _(spark, d):
    return results.tuning_slopes(epochs(spark, d).select(F.col("trial_id").alias("k"), F.slice("x", 1, 8).alias("x")), "k")


@entry("tuning_slope_test", f"WITH {_fold_sql(7, False)}, h AS (SELECT k, i, (c[i] + c[8 - i]) / 2 AS v FROM c, generate_series(1, 4) AS g(i)), s AS (SELECT label AS event_code, regr_slope(v, i) AS v FROM h JOIN embeddings ON vec_id = k GROUP BY k, label) SELECT event_code, {_R('avg(v)', 'mean')}, count(*) - 1 AS df, {_R('avg(v) / (stddev_samp(v) / sqrt(count(*)))', 't')} FROM s GROUP BY 1")
def _(spark, d):
    trials = epochs(spark, d).select(F.struct("trial_id", "event_code").alias("k"), F.slice("x", 1, 7).alias("x"))
    return group.one_sample_t(results.tuning_slopes(trials, "k").select("k.event_code", F.col("slope").alias("value")), ["event_code"])


@entry(
    "tuning_gaussian",
    f"""WITH c AS (SELECT c_custkey AS k, list_transform(range(1, 8), lambda i: exp(0 - (i - 4 - (c_custkey % 5) / 10.0) ** 2 / (2 * (1 + (c_custkey % 7) / 5.0) ** 2)) * (1 + c_nationkey / 10.0) * (1 + ((c_custkey * i) % 3) / 100.0)) AS x FROM customer),
p AS (SELECT k, i AS u, ln(x[i]) AS y FROM c, generate_series(1, 7) AS g(i) WHERE x[i] > 0.3 * list_max(x)),
m AS (SELECT k, count(*) AS s0, sum(u) AS s1, sum(u ** 2) AS s2, sum(u ** 3) AS s3, sum(u ** 4) AS s4, sum(y) AS t0, sum(y * u) AS t1, sum(y * u * u) AS t2 FROM p GROUP BY 1),
e AS (SELECT k, s0, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS d, t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2) AS a, s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2) AS b, s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2) AS g FROM m),
f AS (SELECT k, a / z AS c0, b / z AS c1, g / z AS c2 FROM (SELECT *, CASE WHEN s0 >= 3 AND abs(d) > 1e-9 THEN d END AS z FROM e)), w AS (SELECT k, c0, c1, CASE WHEN c2 < 0 THEN -1 / (2 * c2) END AS v FROM f) SELECT k, {_R('sqrt(v)', 'sigma')}, {_R('c1 * v', 'mu')}, {_R('exp(c0 + c1 * v * c1 / 2)', 'height')} FROM w""",
)
def _(spark, d):
    k = F.col("c_custkey")
    value = lambda i: F.exp(-F.pow(i - 4 - (k % 5) / 10.0, F.lit(2.0)) / (2 * F.pow(1 + (k % 7) / 5.0, F.lit(2.0)))) * (1 + F.col("c_nationkey") / 10.0) * (1 + ((k * i) % 3) / 100.0)
    curves = table(spark, d, "customer").select(k.alias("k"), F.transform(F.sequence(F.lit(1), F.lit(7)), value).alias("x"))
    return results.gaussian_fit(curves, "k")


@entry("tuning_windows", f"WITH {_S} SELECT event_code, w AS \"window\", {_R('avg(value)', 'value')} FROM s, (VALUES (1, 1, 16), (2, 10, 40), (3, 60, 64)) AS v(w, a, b) WHERE t_idx BETWEEN a AND b GROUP BY 1, 2")
def _(spark, d):
    return results.windowed(samples(spark, d), [(1, 16), (10, 40), (60, 64)], ["event_code"])


def _components_sql(where: str) -> str:
    """Reachable least cell in column order, and its rank."""
    return f"""k AS (SELECT "row" AS r, col AS c, value, col * 1000 + "row" AS id FROM m WHERE {where}),
z(id, r, c, top) AS (SELECT id, r, c, id FROM k UNION SELECT k.id, k.r, k.c, z.top FROM z JOIN k ON abs(k.r - z.r) <= 1 AND abs(k.c - z.c) <= 1),
t AS (SELECT id, min(top) AS top FROM z GROUP BY 1), n AS (SELECT id, dense_rank() OVER (ORDER BY top) AS region FROM t)"""


@entry("region_means", f"WITH RECURSIVE {MATRIX}, {_components_sql('value > 0.05')} SELECT 'discount' AS map, region, count(*) AS cells, {_R('avg(value)', 'value')} FROM k JOIN n USING (id) GROUP BY 2")
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = rows.groupBy(F.col("l_linenumber").alias("row"), (F.col("p_size") % 7 + 1).alias("col")).agg(F.avg("l_discount").alias("value"))
    return results.regions(m.withColumn("mask", F.col("value") > 0.05).withColumn("map", F.lit("discount")))


_ERP = "d AS (SELECT l_suppkey AS subject, l_returnflag AS cond, l_linestatus || l_linenumber % 3 AS label, l_linenumber AS t_idx, avg(l_discount) * 0.001 AS value FROM lineitem GROUP BY ALL)"


def _evoked(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat("l_linestatus", F.col("l_linenumber") % 3)
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("cond"), label.alias("label"), F.col("l_linenumber").alias("t_idx")).agg((F.avg("l_discount") * 0.001).alias("value"))


def _erp_query(name: str, method: str, arithmetic: str, electrode: str, final: str) -> None:
    @entry(name, f"WITH {_ERP}, e AS (SELECT subject, cond, t_idx, sum(CASE WHEN label IN ('O0', 'O1') THEN {electrode} ELSE 0 END) AS value FROM d WHERE label IN ('O0', 'O1') AND cond IN ('A', 'N') GROUP BY 1, 2, 3), f AS ({final}) SELECT subject, t_idx, cond, {_R('value * CASE WHEN max(value) OVER () < 0.001 THEN 1000000 ELSE 1 END', 'value')} FROM f")
    def _(spark, d):
        return results.event_related(_evoked(spark, d), ["O0", "O1"], method, ["A", "N"], arithmetic)


_erp_query("erp_average_keep", "average", "keep", "value / 2", "SELECT * FROM e")
_erp_query("erp_subtract_difference", "subtract", "subtract", "CASE WHEN label = 'O0' THEN value ELSE -value END", "SELECT subject, t_idx, max(CASE WHEN cond = 'A' THEN value END) - max(CASE WHEN cond = 'N' THEN value END) AS value, 'difference' AS cond FROM e GROUP BY 1, 2")
_erp_query("erp_average_average", "average", "average", "value / 2", "SELECT subject, t_idx, avg(value) AS value, 'average' AS cond FROM e GROUP BY 1, 2")

_RATES = "r AS (SELECT l_suppkey AS subject, avg(CASE WHEN l_linestatus = 'F' THEN (l_returnflag = 'A')::INT END) AS h, avg(CASE WHEN l_linestatus = 'O' THEN (l_quantity > 49)::INT END) AS f, count(*) FILTER (l_linestatus = 'F') AS ns, count(*) FILTER (l_linestatus = 'O') AS nn FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)"


def _rates(spark: SparkSession, d: str) -> DataFrame:
    s, o = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O"
    return table(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("subject")).agg(
        F.avg(F.when(s, (F.col("l_returnflag") == "A").cast("double"))).alias("p_hit"), F.avg(F.when(o, (F.col("l_quantity") > 49).cast("double"))).alias("p_fa"), F.count(F.when(s, 1)).alias("n_signal"), F.count(F.when(o, 1)).alias("n_noise")
    )


def _sdt_query(method: str, hit: str, fa: str) -> None:
    @entry(f"detection_{method}", f"WITH {_RATES} SELECT subject, {_R(hit, 'p_hit')}, {_R(fa, 'p_fa')} FROM r")
    def _(spark, d):
        return results.corrected_rates(_rates(spark, d), method).select("subject", "p_hit", "p_fa")

    z = f"{normal_quantile_sql('h')} - {normal_quantile_sql('f')}"

    @entry(f"d_prime_{method}", f"WITH {_RATES}, c AS (SELECT subject, CAST({hit} AS DOUBLE) AS h, CAST({fa} AS DOUBLE) AS f FROM r) SELECT subject, {_R(z, 'd_prime')} FROM c")
    def _(spark, d):
        return results.corrected_rates(_rates(spark, d), method).select("subject", (z_of("p_hit") - z_of("p_fa")).alias("d_prime"))


_sdt_query("arbitrary", "CASE WHEN h = 0 THEN 0.00001 WHEN h = 1 THEN 0.99999 ELSE h END", "CASE WHEN f = 0 THEN 0.00001 WHEN f = 1 THEN 0.99999 ELSE f END")
_sdt_query("loglinear", "(h * ns + 0.5) / (ns + 1)", "(f * nn + 0.5) / (nn + 1)")
_sdt_query("extremes", "CASE WHEN h = 0 THEN 0.5 / ns WHEN h = 1 THEN (ns - 0.5) / ns ELSE h END", "CASE WHEN f = 0 THEN 0.5 / nn WHEN f = 1 THEN (nn - 0.5) / nn ELSE f END")


@entry("score_of_first_class", f"SELECT label AS event_code, {_R('avg(CAST(embedding[1] AS DOUBLE))', 'value')}, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, d):
    scores = epochs(spark, d).select("event_code", F.posexplode(F.slice("x", 1, 2)).alias("p", "score")).select("event_code", (F.col("p") + 1).alias("class"), "score")
    return results.first_score(scores, ["event_code"])


@entry("test_halves", "WITH r AS (SELECT vec_id AS trial_id, label AS event_code, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, (count(*) OVER (PARTITION BY label) + 1) // 2 AS m FROM embeddings) SELECT trial_id, event_code, 1 AS half FROM r WHERE k <= m UNION ALL SELECT trial_id, event_code, 2 FROM r WHERE k >= m")
def _(spark, d):
    return results.halves(epochs(spark, d).drop("x"), ["trial_id"], ["event_code"])


@entry("first_minimum", f"WITH {MATRIX} SELECT 'all' AS cond, \"row\", col, {_R('value', 'value')} FROM m ORDER BY ROUND(value, 9), col, \"row\" LIMIT 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = rows.groupBy(F.col("l_linenumber").alias("row"), (F.col("p_size") % 7 + 1).alias("col")).agg((-F.avg("l_discount")).alias("value"))
    return group.first_peak(m.withColumn("cond", F.lit("all")), ["cond"]).withColumn("value", -F.col("value"))
