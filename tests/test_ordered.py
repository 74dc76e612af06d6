"""Running counts of small groups in one window and of large ones in ranges, no broadcast with a row for each group, pairs dealt to many tasks."""

import numpy as np
import pytest

from epochal.operators import arrays, ordered, robust, scale


@pytest.fixture(scope="module")
def groups(spark):
    r = np.random.default_rng(3)
    rows = [(g, float(np.round(x, 1))) for g, n in ((None, 40), ("a", 1), ("b", 300), ("c", 7)) for x in r.normal(size=n) * 5]
    return spark.createDataFrame(rows, "g string, value double").cache(), {g: np.array([x for h, x in rows if h == g]) for g in (None, "a", "b", "c")}


@pytest.mark.parametrize("whole", [0, 20, 1 << 14])
def test_small_and_large_groups_agree(groups, monkeypatch, whole):
    data, values = groups
    monkeypatch.setattr(ordered, "WHOLE", whole)
    got = {r.g: r for r in ordered.quantiles(data, ["g"], "value", {"q": 0.3}).collect()}
    assert set(got) == set(values) and all(got[g].n == len(x) and got[g].q == pytest.approx(np.quantile(x, 0.3)) for g, x in values.items())
    one = data.selectExpr("g", "value", "1L as one")
    up = ordered.up_to(one, ["g"], "value", ["one"]).collect()
    assert len(up) == sum(map(len, values.values())) and all(r.one_upto == (values[r.g] <= r.value).sum() for r in up)


def test_no_broadcast_of_a_row_for_each_group(groups):
    data, _ = groups
    for df in (scale.median_deviation(data, ["g"]), scale.outliers(data, ["g"]), scale.huber_location(data, ["g"], rounds=1), scale.mean_deviation(data, ["g"]), robust.carling(data, ["g"])):
        plan = df._jdf.queryExecution().analyzed().toString().splitlines()
        hints = [k for k, line in enumerate(plan) if "strategy=broadcast" in line]
        assert hints and all("_size" in "".join(plan[k + 1 : k + 3]) for k in hints)


def test_points_from_one_file_are_dealt_to_many_tasks(spark, tmp_path):
    spark.range(500).selectExpr("id", "id * 1.5D as x", "id % 3 as c").coalesce(1).write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))
    got = scale.dissimilarities(points, points.where("id % 100 = 0"), "id", ["x"], ["c"])
    assert got.rdd.getNumPartitions() > 100 and got.count() == 5 * 499
    assert all(r.value == pytest.approx((abs(r.i - r.j) / 499 + (r.i % 3 != r.j % 3)) / 2) for r in got.where("j < 20").collect())


def test_pairs_of_copies_are_written_short(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scale, "PARTS", 8)
    rows = spark.range(20000).selectExpr("id", "(id % 500 * 7919 % 1009) / 7 as x", "id % 3 as c")
    rows = rows.unionByName(spark.sql("select null as id, 1.0D as x, 0L as c union all select 20001L, null, 0L union all select 20002L, 1.5D, null"))
    scale.dissimilarities(rows, rows.where("id % 100 = 0"), "id", ["x"], ["c"]).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    assert pairs.count() == pairs.select("i", "j").distinct().count() == 200 * 20001
    own = {v.id: v for v in rows.where("id is not null").collect()}
    known = [v.x for v in own.values() if v.x is not None]
    r = max(known) - min(known)
    for v in pairs.where("i = 300 and (j % 97 = 0 or j > 20000)").collect():
        a, b = own[v.i], own[v.j]
        assert v.value is None if b.c is None else v.value == pytest.approx(((0.0 if b.x is None else abs(a.x - b.x) / r) + (a.c != b.c)) / 2)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < pairs.count() / 2


def test_neighbours_by_blocks_with_ties(spark, monkeypatch):
    monkeypatch.setattr(arrays, "POINT_BLOCK", 40)
    monkeypatch.setattr(arrays, "QUERY_BLOCK", 7)
    x = np.random.default_rng(6).integers(0, 3, size=(200, 4)).astype(float)  # many equal distances
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "trial_id long, x array<double>")
    got = sorted((r.query_id, r["rank"], r.trial_id, r.distance) for r in arrays.neighbours(points, points.where("trial_id % 10 = 0"), 5).collect())
    want = [(i, n + 1, j, d) for i in range(0, 200, 10) for n, (d, j) in enumerate(sorted((float(((x[j] - x[i]) ** 2).sum()), j) for j in range(200) if j != i)[:5])]
    assert got == want
