"""Operators against their definitions, one value at a time, on the examples that come with them."""

import math
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from epochal import catalog
from epochal.functions import dist, text
from epochal.operators import channels, circ, decode, design, files, group, linear, ordered, results, scale

ALPHA = np.deg2rad([13, 15, 21, 26, 28, 30, 35, 36, 41, 60, 92, 103, 165, 199, 210, 250, 301, 320, 343, 359])
BETA = np.deg2rad([1, 13, 41, 56, 67, 71, 81, 85, 99, 110, 119, 131, 145, 177, 199, 220, 291, 320, 340, 355])


@pytest.fixture(scope="module")
def angles(spark):
    return spark.createDataFrame([("a", float(v), k) for k, v in enumerate(ALPHA)] + [("b", float(v), k) for k, v in enumerate(BETA)] + [("c", float(v), k) for k, v in enumerate(ALPHA[:13])], "g string, alpha double, k int")


def turn(d):
    return math.atan2(math.sin(d), math.cos(d))


def slow_median(x):
    x = np.sort(np.mod(x, 2 * np.pi))
    uneven = [abs(sum(np.sign(round(turn(b - a), 9)) for b in x)) for a in x]
    pick = [a for a, u in zip(x, uneven) if u == min(uneven)][: 1 if len(x) % 2 else 2]
    middle = np.angle(np.exp(1j * np.array(pick)).sum())
    mean = np.angle(np.exp(1j * x).sum())
    return np.mod(middle + np.pi, 2 * np.pi) if abs(turn(mean - middle)) > np.pi / 2 else middle


def test_circular_examples(angles):
    got = {r.g: r for r in circ.describe(angles, ["g"]).collect()}
    medians = {r.g: r.median for r in circ.median(angles, ["g"]).collect()}
    for g, x in (("a", ALPHA), ("b", BETA), ("c", ALPHA[:13])):
        z = np.exp(1j * x).mean()
        assert got[g].mu == pytest.approx(np.angle(z)) and got[g].r == pytest.approx(abs(z)) and got[g].var == pytest.approx(1 - abs(z))
        assert turn(medians[g] - slow_median(x)) == pytest.approx(0, abs=1e-7)


def test_median_tests_of_the_examples(angles):
    got = {r.g: r for r in circ.median_test(angles, ["g"], 1.0).collect()}
    for g, x in (("a", ALPHA), ("b", BETA)):
        d = [turn(v - 1.0) for v in x]
        low, high, n = min(sum(v < 0 for v in d), sum(v > 0 for v in d)), max(sum(v < 0 for v in d), sum(v > 0 for v in d)), len(x)
        expected = 1.0 if low == high else sum(math.comb(n, k) for k in range(n + 1) if k <= low or k >= high) / 2**n
        assert got[g].p == pytest.approx(expected)


def test_von_mises_density_is_one_in_all(spark):
    grid = spark.range(2000).select((F.col("id") / 2000 * 2 * F.pi()).alias("alpha"), F.lit(1.0).alias("mu"), F.lit(7.5).alias("kappa"))
    assert circ.von_mises_density(grid).agg(F.avg("density")).first()[0] * 2 * math.pi == pytest.approx(1)


def test_modulo_from_one(spark):
    row = spark.range(1).select(text.mod_from_one(F.lit(34), 30).alias("a"), text.mod_from_one(F.lit(23), 24).alias("b"), text.mod_from_one(F.lit(25), 24).alias("c")).first()
    assert tuple(row) == (4, 23, 1)


def test_binomial(spark):
    rows = [(k, n) for n in (1, 7, 30) for k in range(-1, n + 1)]
    for r in spark.createDataFrame(rows, "k long, n long").select("k", "n", dist.binomial_lower("k", "n").alias("p")).collect():
        assert r.p == pytest.approx(sum(math.comb(r.n, j) for j in range(r.k + 1)) / 2**r.n)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_and_ranks_by_counts(spark, by):
    r = np.random.default_rng(2)
    rows = [("x" if i % 3 else None, float(v)) for i, v in enumerate(np.concatenate([r.integers(0, 40, 400), r.normal(1e6, 1, 50), [-5.0]]))] + [("x", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for row in ordered.quantiles(df, by, "v", {"q1": 0.25, "m": 0.5, "top": 1.0}).collect():
        own = [v for g, v in rows if v is not None and (not by or g == row.g)]
        assert (row.n, row.q1, row.m, row.top) == pytest.approx((len(own), *np.quantile(own, [0.25, 0.5, 1.0])))
    for row in ordered.with_average_rank(df, by, "v", "rank").where("v is not null").collect():
        own = np.array([v for g, v in rows if v is not None and (not by or g == row.g)])
        assert row["rank"] == (own < row.v).sum() + ((own == row.v).sum() + 1) / 2


def test_bundles_and_errors(spark):
    types = {"Cz": "EEG", "HEOG": "EOG"}
    assert channels.labels_of("all", types) == ["Cz"] and channels.labels_of("ALL_NOSELECTION") is None and "HEOG" in channels.labels_of("eeg_eog", types)
    with pytest.raises(ValueError):
        channels.labels_of("NOWHERE")
    a = spark.createDataFrame([(1, 5, 0.1), (2, 6, 0.2)], "trial_id int, event_code int, score double")
    with pytest.raises(PySparkException):
        channels.matched_trials(a, a.withColumn("event_code", F.lit(5))).collect()
    assert [r.few for r in channels.matched_trials(a, a.limit(1)).collect()] == [True]
    with pytest.raises(PySparkException):
        files.zipped(spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("c",)], "name string")).collect()


def test_subjects_are_decoded_apart_and_in_chunks(spark, monkeypatch):
    """Posteriors of two subjects, from sums and in chunks, are those of each subject's own trials at once."""
    monkeypatch.setattr(decode, "CHUNK", 7)
    r = np.random.default_rng(4)
    rows = [(s, i, i % 2, 1 + i % 3, (r.normal(size=4) + (i % 2) * (1 if s == "s1" else -2)).tolist()) for s in ("s1", "s2") for i in range(60)]
    trials = spark.createDataFrame(rows, "subject string, trial_id long, class int, fold int, x array<double>")
    for kind in ("linear", "quadratic", "diaglinear", "mahalanobis"):
        got = {(x.subject, x.trial_id): x.score for x in decode.decode_folds(trials, kind).where("class = 1").collect()}
        assert len(got) == 120
        for s in ("s1", "s2"):
            own = [t for t in rows if t[0] == s]
            x, y, fold, ids = np.array([t[4] for t in own]), np.array([t[2] for t in own]), np.array([t[3] for t in own]), [t[1] for t in own]
            for f in (1, 2, 3):
                p = decode.posterior(decode.discriminant(decode.moments_of(x[fold != f], y[fold != f]), kind), x[fold == f])[:, 1]
                assert np.allclose([got[s, i] for i, k in zip(ids, fold) if k == f], p)


def test_sensor_noise_and_repeated_components(spark):
    r = np.random.default_rng(6)
    source = r.normal(size=(400, 2))
    x = source @ r.normal(size=(2, 6)) + 1e-3 * r.normal(size=(400, 6))
    noisy = x.copy()
    noisy[:, 3] += r.normal(size=400)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(noisy)], "trial_id int, x array<double>")
    got = np.array([v.x for v in linear.without_sensor_noise(df, 4).orderBy("trial_id").collect()])
    assert np.abs(got[:, 3] - x[:, 3]).mean() < 0.3 * np.abs(noisy[:, 3] - x[:, 3]).mean()


def test_small_tables(spark):
    none = spark.createDataFrame([], "g string, value double")
    assert scale.median_deviation(none, ["g"]).count() == 0 and linear.two_clusters(none, ["g"]).count() == 0
    assert results.next_run(spark.createDataFrame([], "iteration int")).first()[0] == 1
    assert results.next_run(spark.createDataFrame([(1,), (2,), (4,)], "iteration int")).first()[0] == 3


def test_epochs_without_a_code_at_zero_stop_the_job(spark):
    from epochal.sources.readers import first_at_zero

    events = spark.createDataFrame([(1, 1, 0.0, 11), (1, 2, 0.0, 12), (2, 1, -5.0, 20), (2, 2, 0.0, 21)], "epoch int, place int, latency_ms double, code int")
    assert sorted(r.code for r in first_at_zero(events).collect()) == [11, 21]
    with pytest.raises(Exception, match="no event code at latency 0"):
        first_at_zero(events.where("code <> 21")).collect()


def test_fold_roles_without_trials_or_folds(spark):
    trials = spark.createDataFrame([(k, k % 3) for k in range(9)], "trial_id long, event_code int")
    with pytest.raises(ValueError, match="no trials to test class 2"):
        design.fold_roles(trials, {1: [0], 2: [1]}, {1: [0], 2: [7]}, 3)
    once = design.fold_roles(trials, {1: [0], 2: [1]}, {1: [0], 2: [2]}, 1).collect()
    assert sorted((r["class"], r.role) for r in once) == [(1, "test")] * 3 + [(1, "train")] * 3 + [(2, "test")] * 3 + [(2, "train")] * 3
    lowered = design.fold_roles(trials, {1: [0], 2: [1]}, {1: [0], 2: [2]}, 10)
    assert lowered.agg(F.max("fold")).first()[0] == 3


def test_matched_scores_with_other_codes_stop_the_job(spark):
    a = spark.createDataFrame([("s", k, k % 2, float(k)) for k in range(10)], "subject string, trial_id long, event_code int, score double")
    b = a.withColumn("score", F.col("score") * 2 + 1)
    assert group.matched_correlation(a, b.where("trial_id < 7"), ["subject"]).select("r", "n", "few").first() == (1.0, 7, True)
    with pytest.raises(Exception, match="don't match"):
        group.matched_correlation(a, b.withColumn("event_code", F.lit(5)), ["subject"]).collect()


def test_oversampling_compares_blocks_and_never_a_trial_with_itself(spark, monkeypatch):
    monkeypatch.setattr(decode, "LEAST", 20)  # eight blocks of each subject
    monkeypatch.setattr(decode, "COMPARED", 8)
    r, rows = np.random.default_rng(4), []
    for subject, sizes in (("a", (70, 31, 50, 1)), ("b", (30, 90))):
        x = np.concatenate([r.normal(size=(n, 3)) * [1, 9, 0] + [0.8 * c, 0, 5] for c, n in enumerate(sizes)])
        y = np.repeat(np.arange(len(sizes)), sizes)
        x[y == 1] = x[: sizes[1]] if sizes[1] < sizes[0] else x[y == 1]  # each is a copy of a trial of class 0, which has the lower number
        rows += [(subject, int(c), k * 37, v.tolist()) for k, (c, v) in enumerate(zip(y, x))]
    want = []
    for subject in "ab":
        own = [(c, i, np.array(v)) for s, c, i, v in rows if s == subject]
        y, x, ids = np.array([c for c, _, _ in own]), np.array([v for _, _, v in own]), [i for _, i, _ in own]
        z = x / np.maximum(x.std(axis=0, ddof=1), 1e-12)
        d = ((z[:, None] - z[None]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        for c in np.unique(y):
            at, need = np.flatnonzero(y == c), max(np.bincount(y)) - (y == c).sum()
            if need and len(at) > 1:
                others = [int((y[np.argsort(d[i], kind="stable")[:5]] != c).sum()) for i in at]
                shares = [w * need // sum(others) for w in others]
                for i in sorted(range(len(at)), key=lambda i: (-(others[i] * need % sum(others)), i))[: need - sum(shares)]:
                    shares[i] += 1
                mine = [at[np.argsort(d[i][at], kind="stable")[:5]] for i in at]
                want += [(subject, int(c), x[i], x[m]) for i, k, m in zip(at, shares, mine) for _ in range(k)]
    runs = []
    for parts in (3, 7):
        df = spark.createDataFrame(rows, "subject string, class int, trial_id long, x array<double>").repartition(parts)
        runs.append(decode.oversample(df).orderBy("subject", "k").collect())
    assert len(runs[0]) == len(want) and [(v.subject, v["class"]) for v in runs[0]] == [(s, c) for s, c, _, _ in want]
    assert [v.k for v in runs[0] if v.subject == "a"] == list(range(sum(s == "a" for s, *_ in want)))
    between = lambda v, a, b: abs(np.linalg.norm(v - a) + np.linalg.norm(b - v) - np.linalg.norm(b - a)) < 1e-9
    assert all(any(between(np.array(v.x), x, other) for other in mine) for v, (_, _, x, mine) in zip(runs[0], want))
    assert np.allclose([v.x for v in runs[0]], [v.x for v in runs[1]])


def test_oversample_query_returns_its_trials(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    trials = [(r.label, np.array(r.embedding, float)) for r in spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()]
    y, x = np.array([c for c, _ in trials]), np.array([v for _, v in trials])
    made, query = {}, catalog.queries()["oversample_adasyn"](spark, data)
    assert query._jdf.queryExecution().optimizedPlan().toString().count("\n") < 500
    for r in query.orderBy("k", "t_idx").collect():
        made.setdefault((r["class"], r.k), []).append(r.value)
    sizes = np.bincount(y)
    assert sorted(c for c, _ in made) == [c for c, n in enumerate(sizes) if n > 1 for _ in range(max(sizes) - n)]
    z = x / np.maximum(x.std(axis=0, ddof=1), 1e-12)
    for (c, _), v in made.items():
        own = np.flatnonzero(y == c)
        near = np.argsort(((z[own][:, None] - z[own]) ** 2).sum(axis=2), axis=1, kind="stable")[:, 1:6]
        a, b = np.repeat(x[own], near.shape[1], axis=0), x[own][near].reshape(-1, x.shape[1])
        excess = np.linalg.norm(np.array(v) - a, axis=1) + np.linalg.norm(b - v, axis=1) - np.linalg.norm(b - a, axis=1)
        assert len(v) == x.shape[1] and excess.min() < 1e-4  # on the way from a trial to one of its class's nearest; values have six places


def test_padded_trials_without_joins(spark):
    rows = [(k, t, None if t == 3 else float(t)) for k in (1, 2) for t in range(1, 120 + 50 * k, k)] + [(3, 500, 1.0), (3, None, 1.0), (None, 5, 1.0), (4, 7, 1.0), (4, 7, 2.0)]
    df = spark.createDataFrame(rows, "trial_id long, t_idx long, value double").repartition(5)
    padded = linear.padded_trials(df, 140, ["trial_id"])
    want = []
    for trial in (1, 2, 3, 4, None):
        for t in range(1, 141):
            own = [v or 0.0 for k, at, v in rows if trial is not None and k == trial and at == t]
            want += [(trial, t, v, 1) for v in own] or [(trial, t, 0.0, 0)]
    order = lambda v: (v[0] or 0, *v[1:])
    assert sorted(map(tuple, padded.collect()), key=order) == sorted(want, key=order)
    kept = linear.weighted_trials(padded)
    assert sorted(map(tuple, kept.collect())) == sorted(v[:3] for v in want if v[3])
    assert "Join" not in padded._jdf.queryExecution().optimizedPlan().toString() and "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
