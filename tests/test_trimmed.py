"""Trimmed estimators against concentration from very many starts in memory, on groups that are larger than the sample."""

import numpy as np
import pytest

from epochal.operators import trimmed


def cloud(n, share, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2)) @ np.array([[2.0, 0.5], [0.0, 1.0]]) + [10, -3]
    bad = r.random(n) < share
    x[bad] = r.normal(size=(int(bad.sum()), 2)) * 0.3 + [30, 20]
    return x, bad


@pytest.fixture(scope="module")
def clouds():
    return {"small": cloud(60, 0.2, 1), "large": cloud(1500, 0.22, 2), "clean": cloud(200, 0.0, 3)}


def best_determinant(x, h, tries=300):
    v, r, best = np.hstack([np.ones((len(x), 1)), x]), np.random.default_rng(99), np.inf
    for _ in range(tries):
        own, last = x[r.choice(len(x), 3, replace=False)], np.inf
        while True:
            c, s = own.mean(axis=0), np.cov(own.T)
            if np.linalg.det(s) < 1e-12:
                break
            d = np.einsum("ni,ij,nj->n", x - c, np.linalg.inv(s), x - c)
            own = x[np.argsort(d)[:h]]
            now = np.linalg.slogdet(np.cov(own.T))[1]
            if now >= last - 1e-13:
                break
            last = now
        best = min(best, last)
    return best


def test_minimum_covariance(spark, clouds):
    rows = [(g, float(a), float(b)) for g, (x, _) in clouds.items() for a, b in x] + [("few", 1.0, 2.0), ("large", None, 1.0)] + [("flat", float(k), 2.0 * k) for k in range(50)]
    got = {r.g: r for r in trimmed.minimum_covariance(spark.createDataFrame(rows, "g string, a double, b double").repartition(6), ["g"], ["a", "b"]).collect()}
    assert set(got) == set(clouds)
    for g, (x, bad) in clouds.items():
        r = got[g]
        assert r.n == len(x) and r.h == trimmed.least_h(len(x), 2, 0.75)
        assert r.objective <= best_determinant(x, r.h, 60 if g == "large" else 300) + (5e-3 if g == "large" else 1e-9)
        good = x[~bad]
        assert np.allclose(r.center, good.mean(axis=0), atol=0.3) and np.allclose(np.reshape(r.cov, (2, 2)), np.cov(good.T), rtol=0.35, atol=0.3)
        c, s = np.array(r.raw_center), np.reshape(r.raw_cov, (2, 2))
        d = np.einsum("ni,ij,nj->n", x - c, np.linalg.inv(s), x - c)
        assert abs(int((d <= trimmed.chi2_quantile(0.975, 2)).sum()) - r.kept) <= 1 and (d[bad] > 7.4).all()
        near = x[d <= trimmed.chi2_quantile(0.975, 2)]
        assert np.allclose(r.center, near.mean(axis=0)) and np.allclose(np.reshape(r.cov, (2, 2)), np.cov(near.T))


def test_trimmed_squares(spark):
    r = np.random.default_rng(7)
    data, rows = {}, []
    for g, n in (("small", 50), ("large", 1500)):
        x = r.normal(size=(n, 2))
        y = 4 + x @ [2.0, -1.0] + 0.1 * r.normal(size=n)
        bad = r.random(n) < 0.2
        y[bad] += 20 + 5 * x[bad, 0]
        data[g] = x, y, bad
        rows += [(g, float(a), float(b), float(c)) for (a, b), c in zip(x, y)]
    got = {q.g: q for q in trimmed.trimmed_squares(spark.createDataFrame(rows, "g string, a double, b double, y double").repartition(4), ["g"], ["a", "b"], "y").collect()}
    assert set(got) == set(data)
    for g, (x, y, bad) in data.items():
        q, full = got[g], np.hstack([np.ones((len(x), 1)), x])
        assert np.allclose(q.coefficients, [4, 2, -1], atol=0.08) and q.r2 > 0.99 and abs(q.scale - 0.1) < 0.03 and q.raw_scale == pytest.approx(np.sqrt(q.objective) * trimmed.consistency(q.h, q.n))
        # a fixed point: the h best rows under the coefficients give the coefficients
        h = trimmed.least_h(len(x), 3, 0.75)
        best = np.argsort((y - full @ q.raw_coefficients) ** 2)[:h]
        assert q.h == h and np.allclose(np.linalg.lstsq(full[best], y[best], rcond=None)[0], q.raw_coefficients, rtol=1e-2) and q.objective == pytest.approx(((y - full @ q.raw_coefficients)[best] ** 2).mean(), rel=2e-3)
        assert q.kept <= (~bad).sum() and q.kept > 0.9 * (~bad).sum()


def test_constants():
    assert trimmed.chi2_quantile(0.975, 2) == pytest.approx(7.377758908)
    assert trimmed.consistency(100, 100) == 1.0 and trimmed.least_h(100, 2, 0.5) == 51 and trimmed.least_h(100, 2, 1.0) == 100
    r = np.sort(np.abs(np.random.default_rng(0).normal(size=200_000)))
    assert np.sqrt((r[:150_000] ** 2).mean()) * trimmed.consistency(150_000, 200_000) == pytest.approx(1, abs=0.01)


def test_empty(spark):
    none = spark.createDataFrame([], "g string, a double, b double")
    assert trimmed.minimum_covariance(none, ["g"], ["a", "b"]).count() == 0 and trimmed.trimmed_squares(none, ["g"], ["a"], "b").count() == 0


def test_steps_order_one_range_of_scores_only(spark, monkeypatch):
    """Limits and sums equal those of all rows in order, and few rows are written for ordering; equal and zero scores count."""
    r = np.random.default_rng(5)
    v = np.hstack([np.ones((20_000, 1)), r.normal(size=(20_000, 2))])
    v[:3000] = [1.0, 0.0, 0.0]  # copies at a distance of 0
    kind, h = trimmed.Location(2), {0: 15_000, 1: 2_000}
    model = np.array([0.0, 0.0, 1.0, 0.2, 0.2, 2.0])
    rows = spark.createDataFrame([(g, row.tolist()) for g in h for row in v], "k long, v array<double>")
    models = spark.createDataFrame([(g, 0, model.tolist()) for g in h], "k long, start int, model array<double>")
    sizes = spark.createDataFrame([(g, len(v), n) for g, n in h.items()], "k long, n long, h long")
    seen, cells = {}, [(i, j) for i in range(3) for j in range(i, 3)]

    def written(df, name):
        seen[name] = df.localCheckpoint()
        return seen[name]

    monkeypatch.setattr(trimmed, "written", written)
    score = kind.scores(v, model[None, None])[:, 0]
    for x in trimmed._least_sums(rows, models, sizes, kind, cells).collect():
        limit = np.sort(score)[h[x.k] - 1]
        own = v[score <= limit * (1 + 1e-12)]
        assert x.limit == pytest.approx(limit, abs=1e-12) and all(x[f"s{i}_{j}"] == pytest.approx((own[:, i] * own[:, j]).sum(), abs=1e-6) for i, j in cells)
    assert seen["near"].where("k = 0").count() < 1000 and seen["near"].where("k = 1").count() == 3000


def test_a_start_from_copies_is_no_start():
    singular = np.array([[4.0, 0.4, 0.12], [0.4, 0.04000000000000001, 0.012], [0.12, 0.012, 0.0036]])
    assert trimmed.Location(2).model(singular) is None or np.isfinite(trimmed.Location(2).model(singular)[1])


def test_scores_are_computed_once_a_pass(spark, clouds, monkeypatch):
    rows = [(g, float(a), float(b)) for g, (x, _) in clouds.items() for a, b in x]
    written, plans = trimmed.written, []
    monkeypatch.setattr(trimmed, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if name == "near" and not plans else written(df, name))
    with pytest.raises(AttributeError):  # stops at the first pass that looks for the last score kept
        trimmed.minimum_covariance(spark.createDataFrame(rows, "g string, a double, b double"), ["g"], ["a", "b"])
    assert plans[0].count("LOG2(") == 1
