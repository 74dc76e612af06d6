"""Cross-validated and multiway components, muscle artifacts and splines against whole arrays in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.operators import arrays, canonical, trials


@pytest.fixture(scope="module")
def recordings():
    r = np.random.default_rng(2)
    shared = r.normal(size=(4, 120, 1))
    x, y = r.normal(size=(4, 120, 3)), r.normal(size=(4, 120, 2))
    x[:, :, 1:2] += 3 * shared
    y[:, 2:, 0:1] += 3 * shared[:, :-2]  # y follows two samples later
    return x, y


def frames(spark, x, y):
    side = lambda v, n: spark.createDataFrame([(f, t, v[f, t].tolist()) for f in range(v.shape[0]) for t in range(v.shape[1])], f"fold long, t long, {n} array<double>").repartition(5)
    return side(x, "x"), side(y, "y")


def test_cross_validated_components(spark, recordings):
    x, y = recordings
    got = {(r.fold, r.shift, r.component): r for r in canonical.cross_validated(*frames(spark, x, y), [0, 2, -1], 3, surrogate=True).collect()}
    assert len(got) == 4 * 3 * 2
    pair = lambda f, g, s: np.hstack([x[f, max(0, -s) : 120 - max(0, s)], y[g, max(0, s) : 120 + min(0, s)]])
    for f in range(4):
        for s in (0, 2, -1):
            others = np.vstack([pair(g, g, s) for g in range(4) if g != f])
            a, b, _ = arrays.canonical(others.T @ others, 3)
            for g, name in ((f, "r"), ((f + 1) % 4, "r_surrogate")):
                z = pair(f, g, s)
                u, v = z[:, :3] @ a, z[:, 3:] @ b
                want = (u * v).sum(axis=0) / np.sqrt((u * u).sum(axis=0) * (v * v).sum(axis=0))
                assert np.allclose([got[f, s, k][name] for k in (1, 2)], want, atol=1e-9)
    assert min(got[f, 2, 1].r for f in range(4)) > 0.8 > 0.4 > max(abs(got[f, 2, 1].r_surrogate) for f in range(4))


def test_multiway_components_find_what_blocks_share(spark):
    r = np.random.default_rng(3)
    common = r.normal(size=(500, 2))
    x = np.hstack([np.hstack([common @ r.normal(size=(2, 2)), r.normal(size=(500, 3))]) @ r.normal(size=(5, 5)) for _ in range(3)])
    filters, score = canonical.multiway(spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>"), 5)
    assert np.allclose(score[:2], 3, atol=1e-6) and score[2] < 2
    found = x @ filters[:, :2]
    assert np.allclose(common, found @ np.linalg.lstsq(found, common, rcond=None)[0], atol=1e-6)


def test_muscle_bursts_are_found(spark):
    r, rate = np.random.default_rng(5), 500.0
    rows = []
    for trial in range(12):
        x = 0.1 * r.normal(size=(4, 500)) + np.sin(2 * np.pi * 10 * np.arange(500) / rate)
        if trial in (3, 8):
            x[:, 200:300] += 2 * np.sin(2 * np.pi * 125 * np.arange(100) / rate)
        rows += [(trial, c, x[c].tolist()) for c in range(4)]
    df = spark.createDataFrame(rows, "trial long, chan long, x array<double>").repartition(4)
    found = trials.muscle_artifacts(df, rate, 4.0, padding=20).collect()
    assert {a.trial for a in found} == {3, 8} and all(140 < a.first < 210 and 290 < a.last < 360 and a.first <= a.peak_t <= a.last for a in found)
    assert {t.trial for t in trials.without_muscle(df, rate, 4.0).select("trial").collect()} == set(range(12)) - {3, 8}
    with pytest.raises(ValueError):
        trials.muscle_activity(df, 200.0)
    # the numbers: z of each channel's envelopes
    from epochal.functions import filters

    b, a = filters.butterworth(6, 2 * 110 / rate, 2 * 140 / rate)
    env = {(t, c): trials.moving_mean(trials.envelope(trials.zero_phase(np.array(x), b, a)), 100) for t, c, x in rows}
    stats = {c: np.concatenate([env[t, c] for t in range(12)]) for c in range(4)}
    want = sum((env[5, c] - stats[c].mean()) / stats[c].std(ddof=1) for c in range(4)) / 2
    got = [q.z for q in trials.muscle_activity(df, rate).where("trial = 5").orderBy("t").collect()]
    assert np.allclose(got, want)


def test_muscle_activity_of_uneven_trials(spark, monkeypatch):
    from epochal.functions import filters

    r, rate, lengths = np.random.default_rng(6), 500.0, {0: (300, 300, 280), 1: (260, 300, 300), 2: (300, 290, 300)}
    rows = [(t, c, [0.0] * n if c == 2 else r.normal(size=n).tolist()) for t, sizes in lengths.items() for c, n in enumerate(sizes)]
    rows[0] = (0, 0, None)
    df = spark.createDataFrame(rows, "trial long, chan long, x array<double>").repartition(4)
    b, a = filters.butterworth(6, 0.44, 0.56)
    env = {(t, c): trials.moving_mean(trials.envelope(trials.zero_phase(np.array(x), b, a)), 100) for t, c, x in rows if x}
    stats = {c: np.concatenate([v for (_, k), v in env.items() if k == c]) for c in range(3)}
    got = {(q.trial, q.t): q.z for q in trials.muscle_activity(df, rate).collect()}
    assert len(got) == 300 * 3
    for (trial, t), z in got.items():
        own = [(v[t] - stats[c].mean()) / stats[c].std(ddof=1) for (k, c), v in env.items() if k == trial and t < len(v) and c < 2]  # channel 2 has no deviation
        assert np.isclose(z, sum(own) / len(own) ** 0.5)
    # one filter serves arrays of many lengths, and samples do not travel one by one
    made, model = [], trials.Recursive
    monkeypatch.setattr(trials, "Recursive", lambda b, a, size: made.append(size) or model(b, a, size))
    for n in range(300, 340):
        trials.zero_phase(r.normal(size=n), b * 1.5, a)
    assert len(made) == 1
    assert "hashpartitioning(trial" in (plan := trials.muscle_activity(df, rate)._jdf.queryExecution().executedPlan().toString()) and ", t#" not in "".join(v for v in plan.splitlines() if "hashpartitioning" in v)


def test_pieces_of_muscle_activity():
    from epochal.functions import filters

    t = np.arange(1000) / 500
    b, a = filters.butterworth(6, 0.44, 0.56)
    inside, outside = np.sin(2 * np.pi * 125 * t), np.sin(2 * np.pi * 30 * t)
    assert np.allclose(trials.zero_phase(inside, b, a)[200:800], inside[200:800], atol=0.01) and np.abs(trials.zero_phase(outside, b, a)[200:800]).max() < 1e-6
    assert np.allclose(trials.envelope(inside), 1, atol=1e-6) and trials.moving_mean(np.arange(5.0), 3).tolist() == [0.5, 1, 2, 3, 3.5]
    assert trials.zero_phase(np.array([2.0]), b, a).shape == (1,)


def test_spline(spark):
    x, at = np.array([0.0, 1, 2.5, 4, 7]), np.linspace(0, 7, 29)
    cubic = lambda v: v**3 - 2 * v * v + 1  # noqa: E731  (a cubic is its own spline)
    assert np.allclose(trials.cubic_spline(x, cubic(x), at), cubic(at)) and trials.cubic_spline(x[:2], x[:2], at) == pytest.approx(at)
    t = np.arange(128)
    slow = np.sin(2 * np.pi * t / 64) + 0.05 * np.random.default_rng(1).normal(size=128)
    slow[40] = 5.0
    got = trials.spline(spark.createDataFrame([(1, slow.tolist()), (2, None)], "trial long, x array<double>"), 128.0, 10, 100).where("trial = 1").first().x
    assert len(got) == 128 and got[40] == pytest.approx(5.0) and got[56] == pytest.approx(slow[56]) and got[24] == pytest.approx(slow[24])
