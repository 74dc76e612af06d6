"""Simhash groups against brute force over all pairs, the index against all distances, and odd rows."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from epochal.llm import simhash
from epochal.llm.work import Work

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, code long, component string"


def brute_fingerprint(text, width=3):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, limit=2):
    codes = np.array(sorted(set(prints)), dtype=np.uint64)
    label = list(range(len(codes)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= limit).tolist():
            a, b = sorted((top(i), top(j)))
            label[b] = a
    return {int(c): top(k) for k, c in enumerate(codes)}


def clustered(n, seed):
    """Random codes, half of them a few flipped bits away from another."""
    random = np.random.default_rng(seed)
    codes = random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + random.integers(0, 2, n, dtype=np.uint64)
    for k in range(n // 2, n):
        codes[k] = codes[random.integers(0, k)] ^ sum(np.uint64(1) << np.uint64(b) for b in random.choice(64, random.integers(1, 5), replace=False))
    return np.unique(codes)


@pytest.mark.parametrize("limit", [0, 1, 2, 3])
def test_search_finds_all_pairs(limit):
    a, b = clustered(700, 1), clustered(300, 2)
    b = np.unique(np.concatenate([b, a[::7] ^ np.uint64(5)]))
    rank = lambda x: np.argsort([int(bin(int(v)), 2) for v in x])
    a, b = a[rank(a)], b[rank(b)]
    distance = np.bitwise_count(a[:, None] ^ b[None, :])
    got = {(int(i), int(j)) for x, y in simhash.near(simhash.Tree(a, ~a), simhash.Tree(b, ~b), limit) for i, j in zip(x, y)}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(distance <= limit))}
    one = simhash.Tree(a, ~a)
    got = {(int(i), int(j)) for x, y in simhash.near(one, one, limit, same=True) for i, j in zip(x, y)}
    own = np.bitwise_count(a[:, None] ^ a[None, :])
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(own <= limit)) if i < j}


def test_gray_rank_orders_neighbours(spark):
    ranks = np.arange(5000, dtype=np.uint64) * np.uint64((1 << 64) // 5000)
    codes = (ranks ^ (ranks >> np.uint64(1))).view(np.int64)
    got = spark.createDataFrame([(int(c),) for c in codes], "code long").select(simhash.gray_rank(F.col("code")).alias("r")).toPandas()["r"].to_numpy()
    assert (got.view(np.uint64) ^ np.uint64(1 << 63)).tolist() == ranks.tolist()


@pytest.mark.parametrize("block", [64, 1 << 14])
def test_links_join_what_brute_force_joins(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CHUNK", 16)
    codes = clustered(6000, 5)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long").repartition(5)
    work = Work(spark, "test")
    label = {int(np.int64(r.u).view(np.uint64)): r.component for r in simhash.components(simhash.links(df, len(codes), 2, work), work).collect()}
    want = brute_components(codes)
    groups = {}
    for c, k in want.items():
        groups.setdefault(k, set()).add(c)
    assert all(len({label.get(c, c if len(g) == 1 else None) for c in g}) == 1 for g in groups.values())
    assert len({label.get(c, c) for c in want}) == len(groups)


def test_documents_equal_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    group = brute_components(prints.values())
    first = {}
    for i, p in sorted(prints.items()):
        first.setdefault(group[p], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{p:016x}", first[group[p]]) for i, p in prints.items()}


@pytest.fixture
def tables():
    return "/root/testdata/sf0.001"


def test_odd_documents(spark):
    texts = [None, "", " \t\n", "One", "one", "one two", "one  TWO", "a b c", "É ß 漢字 x", "w " * 60_000, "a b c a b c", "x\x1cy z\x0bq r"]
    rows = [(i, t, 1, "c") for i, t in enumerate(texts)] + [(5, "one two", 1, "c"), (5, "other words than those before", 2, None), (None, "one", 0, None), (None, None, None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert sorted((r.fingerprint, r.doc_id is None) for r in got) == sorted((f"{brute_fingerprint(t):016x}", i is None) for i, t, _, _ in rows)
    of = {r.doc_id: r.component_id for r in got if r.doc_id not in (None, 5)}
    assert of[0] == of[1] == of[2] == 0 and of[3] == of[4] == 3 and of[6] == 5
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_values_are_those_of_the_sql_function(spark):
    texts = ["one two three", "é ß 漢字", "x" * 100 + " y z"]
    want = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert [int(x) for _, _, found in simhash.fingerprints_of(pa.array(texts), 3) for x in found] == want
