"""Whitening against the eigenvectors of the covariance, in exact and in double arithmetic, and on odd rows."""

from fractions import Fraction

import numpy as np
import pytest

from epochal.llm import whitening
from epochal.llm.work import Work

SCHEMA = "vec_id long, embedding array<float>, n long, component string"


def brute(vectors):
    x = np.floor(64 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), [int(v) for v in x.sum(axis=0)]
    far = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x]
    centred = np.array([[float(Fraction(int(v)) - Fraction(t, n)) for v, t in zip(row, s)] for row in x])
    values, right = np.linalg.eigh(centred.T @ centred / n)
    return far, centred, values[::-1], right[:, ::-1]


def by_row(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_equals_eigenvectors(spark, parts):
    random = np.random.default_rng(3)
    vectors = (random.normal(size=(700, 40)) @ random.normal(size=(40, 40))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1, "c") for i, v in enumerate(vectors)], SCHEMA).repartition(parts)
    got = by_row(whitening.whiten(df))
    far, centred, values, right = brute(vectors)
    assert sorted(got) == list(range(700)) and all(sorted(r) == list(range(1, 33)) for r in got.values())
    assert all(got[i][1].deviation == far[i] == int(got[i][5].deviation_wide) and got[i][1].n == 700 for i in got)
    for k in range(32):
        own = np.array([got[i][k + 1].whitened for i in range(700)])
        want = centred @ right[:, k] / np.sqrt(values[k])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-6
        assert got[0][k + 1].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
    whole = np.array([[got[i][k].whitened for k in range(1, 33)] for i in range(700)])
    error = np.abs(np.cov(whole.T, bias=True) - np.eye(32)).max()
    assert got[0][1].identity_error < 1e-9 and error < 1e-9
    assert len({r.identity_error for x in got.values() for r in x.values()}) == 1


def test_factor_is_that_of_all_rows(spark):
    random = np.random.default_rng(4)
    vectors = random.normal(size=(300, 9))
    df = spark.createDataFrame([(i, v.tolist(), 1, "c") for i, v in enumerate(vectors)], SCHEMA).repartition(50)
    rows, work = whitening._rows(df, "vec_id", "embedding"), Work(spark, "test")
    n, sums = whitening._sums(rows)
    r = whitening._factor(rows, whitening.Fit(n, sums, np.zeros((9, 0)), np.zeros(0), np.zeros(0)), work)
    _, centred, _, _ = brute(vectors.astype(np.float32))
    assert np.allclose(r.T @ r, centred.T @ centred) and np.allclose(r, np.triu(r))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, 1.0], [-0.25, 3.0], [2.0, 2.0], [2.0, 2.0], [1.5], []]
    rows = [(i, v, 1, None) for i, v in enumerate(good)] + [(None, [7.0, -1.0], None, None), (3, [2.0, 2.0], 1, "x")]
    rows += [(10, None, 1, "c"), (11, [1.0, None], 1, "c"), (12, [nan, 1.0], 1, "c"), (13, [inf, 0.0], 1, "c"), (14, [1.0, -inf], 1, "c")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(-1 if r.vec_id is None else r.vec_id for r in got if r.component == 1) == [-1, 0, 1, 2, 3, 3, 4, 5]
    filled = [[*v, 0.0, 0.0][:2] for v in [*good, [7.0, -1.0], [2.0, 2.0]]]
    far, _, values, _ = brute(filled)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(far) and {r.n for r in got} == {8}
    assert {round(r.explained, 9) for r in got} == {round(v / values.sum(), 9) for v in values}


def test_little_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(100)], schema)
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


def test_huge_entries_keep_exact_deviations(spark):
    rows = [(i, [1e12 * i, float(i % 3)]) for i in range(50)] + [(99, [1e300, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    x = [[min(int(64 * a), 1 << 52) + 1_000_000, int(64 * b) + 1_000_000] for _, (a, b) in [(i, (int(v[0]), int(v[1]))) for i, v in rows]]
    n, s = len(x), [sum(c) for c in zip(*x)]
    want = {i: sum((n * v - t) ** 2 for v, t in zip(row, s)) for (i, _), row in zip(rows, x)}
    assert {r.vec_id: int(r.deviation_wide) for r in got} == want
    assert all(r.deviation is None or r.deviation == want[r.vec_id] for r in got) and any(r.deviation is None for r in got)
