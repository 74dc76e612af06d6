"""Near-duplicate documents by simhash: a hierarchical index over fingerprints in Gray order.

1. A text's fingerprint has the bits that more than half of its word shingles' XXH64 values have; shingles count
   as often as they occur.  Documents with one fingerprint are one code.
2. Codes are sorted by Gray rank (neighbours in that order share most bits, across the steps of the high bits too)
   and cut into blocks.  A block's pattern is the bits that all its codes share, ones and zeros apart.
3. The patterns of all blocks, at most MOST_BLOCKS of 24 bytes, are the leaves of the upper index; four nodes make
   a node above, which keeps what their patterns share.  A node's pattern is part of its children's, so differences
   between two nodes only grow downwards, and two whole groups are left out as soon as they pass the limit.
4. The pairs of blocks that the upper index leaves meet in a task each, where trees of the same kind over their
   codes are searched against each other down to single codes, a bounded number of node pairs at a time.
5. Each task returns a spanning forest of its links; alternating large-star and small-star steps give components.

Every pair of codes within the limit is found: nothing is sampled or capped.  A code is sent to the blocks whose
patterns allow a link, a number that grows with the square of the logarithm of the number of blocks (for two bits).

Defined results: a null or wordless text has fingerprint zero and is linked like any other; rows with one doc_id
are compared by their own texts and carry the smallest id reachable; a null doc_id is in no group (component_id null);
an empty table gives an empty table; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochal.llm import textops as X
from epochal.llm.components import components
from epochal.llm.minhash import _runs as runs
from epochal.llm.work import Work

SEED = 42
BLOCK, CHUNK = 1 << 14, 1 << 12
"""Codes of a block, and of the rows in which a block travels (32 KB)."""
MOST_BLOCKS = 1 << 20
"""Most blocks in the upper index (24 MB); for more codes blocks grow instead."""
BRANCH, AT_ONCE = 4, 1 << 15
"""Children of a node, and pairs of nodes that are opened at once."""


def fingerprints_of(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last + 1, fingerprints) of runs of texts."""
    for first, last, data, offsets in X.pieces(texts):
        data = X.lower_ascii(data)
        starts, ends, bounds = X.word_spans(data, offsets)
        out = np.zeros(last - first, dtype=np.uint64)
        if len(starts):
            # words with one space between them
            length = ends - starts
            at = np.concatenate([[0], np.cumsum(length + 1)])
            source = np.repeat(starts - at[:-1], length + 1) + np.arange(at[-1])
            joined = data[np.minimum(source, len(data) - 1)]
            joined[at[1:] - 1] = 0x20
            counts = np.diff(bounds)
            n = np.where(counts >= width, counts - width + 1, counts > 0)
            begin = np.concatenate([[0], np.cumsum(n)])
            word = np.repeat(bounds[:-1] - begin[:-1], n) + np.arange(begin[-1])
            stop = at[word + np.repeat(np.minimum(counts, width), n)] - 1
            raw = joined.tobytes()
            values = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in zip(at[word].tolist(), stop.tolist(), strict=True)), dtype=np.uint64, count=len(word))
            bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            full = np.flatnonzero(n)
            most = 2 * np.add.reduceat(bits, begin[full], axis=0, dtype=np.int64) > n[full, None]
            out[full] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
        yield first, last, out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and code, the 64 bits as a long, of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, found in fingerprints_of(batch.column("text"), width):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(found.view(np.int64))], ["doc_id", "code"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, code long")


def gray_rank(code: Column) -> Column:
    """The place of a code in the Gray order of 64 bits; signed comparison orders ranks as unsigned ones."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


class Tree:
    """Levels of shared patterns, single codes (or blocks) first: bits that are one, and bits that are zero, in all of a group."""

    def __init__(self, ones: np.ndarray, zeros: np.ndarray) -> None:
        self.levels = [(ones, zeros)]
        while len(self.levels[-1][0]) > 1:
            self.raise_by_one()

    def raise_by_one(self) -> None:
        at = np.arange(0, len(self.levels[-1][0]), BRANCH)
        self.levels.append(tuple(np.bitwise_and.reduceat(x, at) for x in self.levels[-1]))


def near(a: Tree, b: Tree, limit: int, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of leaves of a and of b that share no more than ``limit`` differing bits; with ``same``, i < j only."""
    while len(a.levels) != len(b.levels):
        min(a, b, key=lambda t: len(t.levels)).raise_by_one()
    child = np.arange(BRANCH)
    waiting = [(len(a.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while waiting:
        level, i, j = waiting.pop()
        if level:
            level -= 1
            i, j = (np.broadcast_to(BRANCH * x[:, None, None] + own, (len(x), BRANCH, BRANCH)).ravel() for x, own in ((i, child[:, None]), (j, child[None, :])))
        (ones_a, zeros_a), (ones_b, zeros_b) = a.levels[level], b.levels[level]
        inside = (i < len(ones_a)) & (j < len(ones_b))
        if same:
            inside &= i <= j if level else i < j
        i, j = i[inside], j[inside]
        close = np.bitwise_count((ones_a[i] & zeros_b[j]) | (zeros_a[i] & ones_b[j])) <= limit
        i, j = i[close], j[close]
        if not level:
            if len(i):
                yield i, j
        else:
            waiting += [(level, i[k : k + AT_ONCE], j[k : k + AT_ONCE]) for k in range(0, len(i), AT_ONCE)]


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of a tree) after further links."""
    while len(i):
        x, y = label[i], label[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(above := label[label], label):
            label = above
    return label


def _blocks(codes: DataFrame, n: int) -> DataFrame:
    """(block, chunk, codes, ones, zeros): the codes in Gray order, a block being named by its first code."""
    size = max(BLOCK, 1 << int(np.ceil(np.log2(max(1, 2 * n / MOST_BLOCKS)))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, dtype=np.int64)
        for batch in _with_end(batches):
            held = held if batch is None else np.concatenate([held, batch.column("code").to_numpy()])
            while len(held) >= size or (batch is None and len(held)):
                own, held = held[:size], held[size:]
                ones, zeros = (int(np.bitwise_and.reduce(x)) for x in (own, ~own))
                parts = [own[k : k + CHUNK].tobytes() for k in range(0, len(own), CHUNK)]
                m = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(own[0])] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array(parts, pa.binary()), pa.array([ones] * m, pa.int64()), pa.array([zeros] * m, pa.int64())], ["block", "chunk", "codes", "ones", "zeros"]
                )

    tasks = max(1, -(-n // (8 * size)))
    ranked = codes.select("code", gray_rank(F.col("code")).alias("rank")).repartitionByRange(tasks, "rank").sortWithinPartitions("rank")
    return ranked.select("code").mapInArrow(cut, "block long, chunk int, codes binary, ones long, zeros long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(codes: DataFrame, n: int, limit: int, work: Work) -> DataFrame:
    """(u, v): for the n distinct ``codes``, links that join exactly those which chains of ``limit`` differing bits or fewer join."""
    spark = codes.sparkSession
    chunks = work.cut(_blocks(codes, n), "blocks")
    tops = chunks.where("chunk = 0").select("block", "ones", "zeros")
    known = tops.orderBy(gray_rank(F.col("block"))).toArrow()
    block, ones, zeros = (known.column(c).to_numpy() for c in ("block", "ones", "zeros"))
    sent = spark.sparkContext.broadcast((block, ones, zeros))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ones, zeros = sent.value
        whole = Tree(ones.view(np.uint64), zeros.view(np.uint64))
        place = {int(x): k for k, x in enumerate(block)}
        for batch in batches:
            own = np.array(sorted(place[x] for x in batch.column("block").to_pylist()), dtype=np.int64)
            if len(own):
                for i, j in near(Tree(ones[own].view(np.uint64), zeros[own].view(np.uint64)), whole, limit):
                    i = own[i]
                    once = i <= j
                    yield pa.RecordBatch.from_arrays([pa.array(block[i[once]]), pa.array(block[j[once]])], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in runs(batches, ["a", "b"]):
            side, parts = pair.column("side").to_numpy(), pair.column("codes").to_pylist()
            left, right = (np.frombuffer(b"".join(p for p, s in zip(parts, side, strict=True) if s == k), dtype=np.uint64) for k in (0, 1))
            both = np.concatenate([left, right])
            label = np.arange(len(both))
            one = Tree(left, ~left)
            for i, j in near(one, Tree(right, ~right), limit) if len(right) else near(one, one, limit, same=True):
                label = _join(label, i, j + len(left) if len(right) else j)
            linked = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(both[linked].view(np.int64)), pa.array(both[label[linked]].view(np.int64))], ["u", "v"])

    pairs = tops.repartition("block").mapInArrow(partners, "a long, b long")
    pairs = work.cut(pairs, "pairs")
    sent.destroy()
    sides = pairs.select("a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(pairs.where("a <> b").select("a", "b", F.col("b").alias("block"), F.lit(1).alias("side")))
    met = chunks.select("block", "codes").join(sides, "block").repartition("a", "b").sortWithinPartitions("a", "b")
    return met.select("a", "b", "side", "codes").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, limit: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id that links of ``limit`` bits reach, for every document."""
    work = Work(docs.sparkSession, "simhash")
    marked = work.cut(fingerprints(docs, width), "marked")
    codes = work.cut(marked.where("doc_id is not null").groupBy("code").agg(F.min("doc_id").alias("least")), "codes")
    label = work.cut(components(links(codes.select("code"), codes.count(), limit, work), work).withColumnRenamed("u", "code"), "label")
    grouped = codes.join(label, "code", "left").select("code", "least", F.coalesce("component", "code").alias("component"))
    firsts = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = work.cut(grouped.join(firsts, "component").select("code", "component_id"), "named")
    joined = marked.join(named, "code", "left")
    print_of = F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint")
    return joined.select("doc_id", print_of, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
