"""Components over neighbour graphs against flood fill, on shapes that need many steps, and the permutation test on planted effects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.operators import clusters, group


def as_cells(spark, mask, by="m"):
    rows = [(by, int(j * 100 + i), int(i), int(j)) for i, j in zip(*np.nonzero(mask))]
    return spark.createDataFrame(rows, "by string, cell long, row long, col long")


def snake(n):
    """One winding path."""
    out = np.zeros((n, n), dtype=bool)
    out[::2] = True
    for k, i in enumerate(range(1, n, 2)):
        out[i, -1 if k % 2 == 0 else 0] = True
    return out


@pytest.mark.parametrize("mask", [np.random.default_rng(1).random((25, 30)) < 0.35, snake(21), np.zeros((3, 3), dtype=bool), np.ones((12, 12), dtype=bool)])
def test_labels_equal_flood_fill(spark, mask):
    cells = as_cells(spark, mask)
    got = {(r.row, r.col): r.cluster for r in clusters.labelled(cells, clusters.grid_edges(cells), ["by"]).collect()}
    want = group.label_grid(mask)
    assert set(got) == {(int(i), int(j)) for i, j in zip(*np.nonzero(mask))}
    assert len({(want[k], v) for k, v in got.items()}) == len(set(got.values())) == want.max()
    assert all(v == min(c for (i, j), c2 in got.items() if c2 == v for c in [j * 100 + i]) for v in set(got.values()))


def test_groups_stay_apart_and_null_keys_count(spark):
    cells = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), (None, 2), (None, 3), ("a", 9)], "by string, cell long")
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2), (9, 9)], "cell long, near long")
    got = sorted((r.by or "", r.cell, r.cluster) for r in clusters.labelled(cells, edges, ["by"]).collect())
    assert got == [("", 2, 2), ("", 3, 2), ("a", 1, 1), ("a", 2, 1), ("a", 9, 9), ("b", 2, 2)]


@pytest.fixture(scope="module")
def planted(spark):
    """30 subjects on an 8 x 8 grid; a 3 x 3 patch is raised in the first 15, another lowered in all."""
    random = np.random.default_rng(4)
    rows = []
    for s in range(30):
        x = random.normal(size=(8, 8))
        x[4:7, 4:7] -= 1.5
        x[0:3, 0:3] += 3.0 * (s < 15)
        rows += [(s, i, j, j * 100 + i, float(x[i, j]), s < 15) for i in range(8) for j in range(8)]
    return spark.createDataFrame(rows, "subject long, row long, col long, cell long, value double, first boolean").cache()


def test_planted_effects_are_found(planted):
    edges = clusters.grid_edges(planted)
    paired = clusters.permutation_test(planted, edges, 60).where("significant").collect()
    assert {r.sign for r in paired} == {1, -1} and all(r.size >= 8 and r.p == 0 for r in paired)
    unpaired = clusters.permutation_test(planted, edges, 60, paired=False).where("significant").collect()
    assert [(r.sign, r.cluster) for r in unpaired] == [(1, 0)] and unpaired[0].size >= 9
    assert clusters.permutation_test(planted, edges, 20, tail="right").where("sign < 0").count() == 0
    masked = clusters.permutation_test(planted, edges, 40, mask=planted.where("col >= 3")).collect()
    assert all(r.cluster >= 300 for r in masked) and any(r.significant and r.sign == -1 for r in masked)


def test_shuffles_keep_the_groups_sizes(planted):
    got = clusters._shuffled(planted, 5).groupBy("rep").agg(F.sum(F.col("first").cast("int")).alias("n"), F.count(F.lit(1)).alias("all")).collect()
    assert sorted((r.rep, r.n, r["all"]) for r in got) == [(k, 15, 30) for k in range(6)]
    orders = {tuple(sorted(r.subject for r in g if r.first)) for k in range(6) for g in [clusters._shuffled(planted, 5).where(F.col("rep") == k).collect()]}
    assert len(orders) == 6


def test_nothing_passes(planted):
    assert clusters.permutation_test(planted, clusters.grid_edges(planted), 5, p_cell=1e-30).count() == 0


def test_large_subject_numbers_do_not_overflow(spark):
    subjects = [0, 7, 79_766, 90_000, 2**31 + 5, 2**62, -3]
    rows = [(r, s) for r in (0, 1, 40) for s in subjects]
    h = {(r, s): ((r * 7919 + s * 104729) * 1103515245 + 12345) % 2**31 for r, s in rows}
    got = spark.createDataFrame(rows, "r long, s long").select("r", "s", group.replicate_sign(F.col("r"), F.col("s")).alias("sign"), group.replicate_hash(F.col("r"), F.col("s")).alias("h")).collect()
    assert all(x.h == h[x.r, x.s] and x.sign == (1.0 if x.r == 0 or h[x.r, x.s] // 65536 % 2 == 0 else -1.0) for x in got) and len(got) == len(rows)
    data = spark.createDataFrame([(s, 1, float(k), s % 2 == 0) for k, s in enumerate(subjects)], "subject long, cell long, value double, first boolean")
    order = lambda r: sorted(subjects, key=lambda s: (h[r, s] ** 2 % (2**31 - 1), s))
    dealt = {(x.rep, x.subject): x.first for x in clusters._shuffled(data, 40).where("rep in (1, 40)").collect()}
    assert dealt == {(r, s): k < sum(s % 2 == 0 for s in subjects) for r in (1, 40) for k, s in enumerate(order(r))}
