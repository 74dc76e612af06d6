"""Statistics over pairs against all pairs formed, with ties, odd sizes, and brackets that have to be narrowed."""

import itertools

import numpy as np
import pytest

from epochal.operators import pairs

SCHEMA = "g string, x double, y double"


def groups():
    r = np.random.default_rng(8)
    out = {"one": [(3.0, 1.0)], "two": [(1.0, 2.0), (4.0, 1.0)], "same": [(2.0, 5.0)] * 6, "three": [(0.0, 1.0), (1.0, 0.0), (10.0, 3.0)]}
    out["ties"] = [(float(a), float(b)) for a, b in r.integers(0, 6, (90, 2))]
    out["plain"] = [(float(a), float(a + b)) for a, b in r.normal(size=(301, 2))]
    out["skewed"] = [(float(a), float(b)) for a, b in np.exp(r.normal(size=(150, 2)))]
    out["outlier"] = [*out["plain"][:60], (1e12, -1e12)]
    out[None] = out["plain"][:40]
    return out


def tau_b(x, y):
    i, j = np.triu_indices(len(x), 1)
    a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    scale = np.sqrt((a != 0).sum()) * np.sqrt((b != 0).sum())
    return (a * b).sum() / scale if scale else None


def qn(x):
    n, h = len(x), len(x) // 2 + 1
    if n < 2:
        return None
    gaps = sorted(abs(a - b) for a, b in itertools.combinations(x, 2))
    return 2.2219 * gaps[h * (h - 1) // 2 - 1] * pairs.SMALL_QN.get(n, n / (n + 1.4) if n % 2 else n / (n + 3.8))


def medcouple(x):
    m = np.median(x)
    up, down, k = sorted(x[x >= m]), sorted(x[x <= m], reverse=True), int((x == m).sum())
    out, ties = [], 0
    for a in up:
        for b in down:
            if a == b == m:
                ties += 1
            else:
                out.append(((a - m) - (m - b)) / (a - b))
    assert ties == k * k
    return float(np.median(out + [-1.0] * (k * (k - 1) // 2) + [0.0] * k + [1.0] * (k * (k - 1) // 2)))


@pytest.fixture(scope="module")
def data(spark):
    rows = [(g, *r) for g, own in groups().items() for r in own] + [("plain", None, 1.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def check(df, column, expected):
    got = {r.g: r[column] for r in df.collect()}
    assert set(got) == set(groups())
    for g, rows in groups().items():
        want = expected(*np.array(rows).T)
        assert (got[g] is None) == (want is None) and (want is None or got[g] == pytest.approx(want, rel=1e-9, abs=1e-12)), g


@pytest.mark.parametrize("least", [10])
def test_all_pairs(data, monkeypatch, least):
    monkeypatch.setattr(pairs, "LEAST", least)
    monkeypatch.setattr(pairs, "FEW", 4 if least > 10 else 1)
    check(pairs.qn(data, ["g"], "x"), "qn", lambda x, y: qn(x))
    check(pairs.hodges_lehmann(data, ["g"], "x"), "location", lambda x, y: float(np.median([(a + b) / 2 for a, b in itertools.combinations_with_replacement(x, 2)])))
    check(pairs.medcouple(data, ["g"], "x"), "medcouple", lambda x, y: medcouple(x))


def test_kendall(data):
    check(pairs.kendall(data, ["g"], "x", "y"), "tau", tau_b)


def test_larger_groups_narrow_their_brackets(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LEAST", 1000)
    x = np.random.default_rng(1).normal(size=1500).round(4)
    df = spark.createDataFrame([("a", float(v), 0.0) for v in x], SCHEMA)
    gaps = np.abs(x[:, None] - x[None, :])[np.triu_indices(1500, 1)]
    h = 751
    assert pairs.qn(df, ["g"], "x").first().qn == pytest.approx(2.2219 * np.partition(gaps, h * (h - 1) // 2 - 1)[h * (h - 1) // 2 - 1] * 1500 / 1503.8)
    walsh = (x[:, None] + x[None, :])[np.triu_indices(1500)] / 2
    assert pairs.hodges_lehmann(df, ["g"], "x").first().location == pytest.approx(np.median(walsh), abs=1e-9)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pairs.rank_statistics(none, ["g"], "x", "y").count() == 0 and pairs.medcouple(none, ["g"], "x").count() == 0


def test_small_groups_write_no_rounds(spark, data, monkeypatch):
    written, names = pairs.written, []
    monkeypatch.setattr(pairs, "written", lambda df, name: names.append(name) or written(df, name))
    plain = lambda df: sorted((str(r.g), *(None if v is None else round(v, 9) for v in (r.tau, r.location, r.qn))) for r in df.collect())
    rows = data.unionByName(spark.createDataFrame([("nulls", None, 1.0), ("gap", 1.0, None), ("gap", 4.0, 2.0), ("gap", 2.0, 3.0)], SCHEMA))
    small = plain(pairs.rank_statistics(rows, ["g"], "x", "y"))
    assert len(names) <= 1
    monkeypatch.setattr(pairs, "SMALL", 3)
    mixed = rows.unionByName(spark.createDataFrame([("far", 1.0, 1.0), ("far", 2.0, float("inf"))], SCHEMA))
    both = plain(pairs.rank_statistics(mixed, ["g"], "x", "y"))
    assert len(names) > 10 and [r for r in both if r[0] != "far"] == small and ("far", 1.0, 1.5, round(2.2219 * 0.399, 9)) in both
    gap = next(r for r in small if r[0] == "gap")
    assert gap[1:3] == (-1.0, 2.25) and "nulls" not in [r[0] for r in small]
