"""Near-duplicate documents: many universal hash minima, banding, verification, components.

1. Each text becomes the set of its distinct word shingles (64-bit fingerprints); the set's minima
   under ``permutations`` universal hash functions are its signature.
2. Texts with equal sets are one node, named by a 64-bit fingerprint of the set (a partial aggregate: a group
   of copies of any size costs one row per task).
3. Bands of the signature are bucket keys.  A bucket never emits all its pairs: its nodes are linked to its
   hub, that of the smallest doc_id.  A hub and all nodes that share a bucket with it are its star, so any two nodes that
   share a bucket share a star.
4. Each star's nodes are compared with its hub: signatures that agree too little (the margin is five standard
   deviations) rule a pair out, the others are confirmed on full sets.  Components of these links label the nodes.
5. Where a star then holds several components, every node outside its largest one meets every node of the
   star in blocks of bounded size, by the same two tests.  So no link that a bucket holds is lost.
6. Components come from alternating large-star and small-star steps.

Defined results: a null or wordless text has an empty set and is linked with nothing; rows with equal doc_ids
are compared by their own texts; a null doc_id is in no group (component_id null, kept true); an empty table
gives an empty table; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochal.llm import textops as X
from epochal.llm.components import components
from epochal.llm.work import Work

PERMUTATIONS, ROWS = 160, 5
"""32 bands of 5: a pair at a similarity of 0.8 is missed with a chance of 3e-6."""
MARGIN = 0.18
"""How far below the limit two signatures may agree and still be confirmed on full sets (5 deviations)."""


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(7)
    return random.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), random.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def _sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, last, data, offsets in X.pieces(texts, X.PIECE_BYTES // 2):
        data = X.lower_ascii(data)
        starts, ends, bounds = X.word_spans(data, offsets)
        runs, begin = X.shingle_hashes(X.span_hashes(data, starts, ends), bounds, width)
        yield first, last, *X.distinct_by_text(runs, begin)


def _minima(values: np.ndarray, begin: np.ndarray, a: np.ndarray, b: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
    """Signatures (texts x functions); texts without values get zeros."""
    out = np.zeros((len(begin) - 1, len(a)), dtype=np.uint32)
    full = np.flatnonzero(np.diff(begin))
    x = (values >> np.uint64(32)).astype(np.uint32)
    lo = 0
    while lo < len(full):  # a run of texts whose values stay in the cache while all functions pass over them
        hi = max(lo + 1, int(np.searchsorted(begin[full], begin[full[lo]] + at_once)))
        own, at = x[begin[full[lo]] : begin[full[min(hi, len(full)) - 1] + 1]], begin[full[lo:hi]] - begin[full[lo]]
        for k in range(len(a)):
            out[full[lo:hi], k] = np.minimum.reduceat(own * a[k] + b[k], at)
        lo = hi
    return out


def signatures(docs: DataFrame, width: int, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, text_key, n_shingles, node (a fingerprint of the set, null if it is empty) and the signature, per document."""
    a, b = _universal(permutations)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, values, begin in _sets(batch.column("text"), width):
                n = np.diff(begin)
                own = [batch.column(c).slice(first, last - first) for c in ("doc_id", "text_key")]
                found = _minima(values, begin, a, b)
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(n, pa.int64()), pa.array(_nodes(values, begin), mask=n == 0), pa.array([x.tobytes() for x in found], pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "node", "signature"],
                )

    return _texts(docs).mapInArrow(work, "doc_id long, text_key long, n_shingles long, node long, signature binary")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))


def _nodes(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each text's set (0 for an empty one)."""
    out, full = np.zeros(len(begin) - 1, dtype=np.uint64), np.flatnonzero(np.diff(begin))
    if len(full):
        sums, folds = np.add.reduceat(X.mix(values), begin[full]), np.bitwise_xor.reduceat(X.mix(values ^ np.uint64(0xA24BAED4963EE407)), begin[full])
        out[full] = X.mix(sums + X.mix(folds))
    return out.view(np.int64)


def _buckets(nodes: DataFrame, rows: int) -> DataFrame:
    """(bucket, node, doc_id): a row for each band of each signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = _matrix(batch.column("signature"))
            bands = found.shape[1] // rows
            key = np.empty((len(found), bands), dtype=np.uint64)
            for band in range(bands):
                key[:, band] = band + 1
                for x in found[:, band * rows : band * rows + rows].T:
                    key[:, band] = X.mix(key[:, band] * np.uint64(0x9FB21C651E98DF25) + x)
            own = [pa.array(np.repeat(batch.column(c).to_numpy(), bands)) for c in ("node", "doc_id")]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), *own], ["bucket", "node", "doc_id"])

    return nodes.select("node", "least.doc_id", "signature").mapInArrow(work, "bucket long, node long, doc_id long")


def _matrix(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), dtype=np.uint32).reshape(len(signatures), -1)


FILTER_BITS = 1 << 28
"""Most bits of the filter that is broadcast (32 MB); more wanted texts than fit are found by a shuffled join."""


def _filter_of(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter over column ``key``, made by a partial aggregate."""
    slot = [F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(bits)) for seed in (1, 2, 3)]
    cells = keys.select(F.explode(F.array(*slot)).alias("bit")).select(F.expr("bit div 64").alias("cell"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mask"))
    found = cells.groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[found.column("cell").to_numpy()] = found.column("mask").to_numpy()
    return out


def _full_sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, width: int, permutations: int) -> DataFrame:
    """(node, n, signature, members): whole shingle sets, made anew from the texts of the wanted (doc_id, text_key).

    Texts are not shuffled while a filter of at most FILTER_BITS tells which are wanted (a false hit adds a
    set that nothing refers to); beyond that many, the wanted texts come by a shuffled join.
    """
    a, b = _universal(permutations)
    key = F.xxhash64("doc_id", "text_key")
    wanted = wanted.select("doc_id", "text_key").distinct()
    bits = 1 << max(16, int(np.ceil(np.log2(12 * max(1, n_wanted)))))
    sent = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted.select(key.alias("key")), bits)) if bits <= FILTER_BITS else None

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent is not None:
                hit = np.ones(batch.num_rows, dtype=bool)
                for c in ("h1", "h2", "h3"):
                    at = batch.column(c).to_numpy()
                    hit &= (sent.value[at // 64] >> (at % 64)) & 1 > 0
                batch = batch.filter(pa.array(hit))
            for _, _, values, begin in _sets(batch.column("text"), width):
                n = np.diff(begin)
                full = n > 0
                cut = [values[i:j].tobytes() for i, j in zip(begin[:-1][full], begin[1:][full], strict=True)]
                signed = [x.tobytes() for x in _minima(values, begin, a, b)[full]]
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(values, begin)[full]), pa.array(n[full], pa.int64()), pa.array(signed, pa.binary()), pa.array(cut, pa.binary())], ["node", "n", "signature", "members"])

    texts = _texts(docs).where("doc_id is not null")
    if sent is None:
        texts = texts.join(wanted, ["doc_id", "text_key"], "left_semi").select("text")
    else:
        slots = [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)).alias(f"h{seed}") for seed in (1, 2, 3)]
        texts = texts.select("text", *slots)
    return texts.mapInArrow(sets, "node long, n long, signature binary, members binary").groupBy("node").agg(*(F.any_value(c).alias(c) for c in ("n", "signature", "members")))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each value of the keys, from batches that are sorted by them; one value's rows at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys])
        starts = np.flatnonzero(np.concatenate([[True], (values[:, 1:] != values[:, :-1]).any(axis=0)])).tolist()
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            own = tuple(values[:, lo].tolist())
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def _links_between(block: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Of one block: links of its outsiders (role 1) to its members (role 0), at most one fewer than it has components.

    Signatures that agree too little rule a pair out; the others are confirmed on full sets.
    """
    role, node, component = (block.column(c).to_numpy() for c in ("role", "node", "component"))
    sets = [np.frombuffer(x, np.uint64) for x in block.column("members").to_pylist()]
    size, signed = block.column("n").to_numpy(), _matrix(block.column("signature").combine_chunks())
    base, outside = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    least = (percent / 100 - MARGIN) * signed.shape[1]
    root = {c: c for c in component.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    u, v = [], []
    for o in outside.tolist():
        near = base[(component[base] != component[o]) & ((signed[base] == signed[o]).sum(axis=1) >= least)]
        for b in near[(100 * np.minimum(size[near], size[o]) >= percent * np.maximum(size[near], size[o]))].tolist():
            x, y = top(int(component[o])), top(int(component[b]))
            if x != y:
                both = len(np.intersect1d(sets[o], sets[b], assume_unique=True))
                if 100 * both >= percent * (int(size[o]) + int(size[b]) - both):
                    root[max(x, y)] = min(x, y)
                    u.append(int(node[o]))
                    v.append(int(node[b]))
    return u, v


ROWS_OF_BLOCK, SIZE_OF_BLOCK = 1000, 500_000
"""Most texts, and about most shingles, on either side of a block in which sets are compared."""


def _compared(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v) of stars(hub, node, component, outside, rows, columns).

    Each star's outsiders meet each of its members, dealt into ``rows`` x ``columns`` blocks, so that no
    star, however large, is gathered in one task.
    """
    deal = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = stars.select("hub", "node", "component", F.lit(0).alias("role"), deal("rows", 1).alias("r"), to("columns").alias("c"))
    outside = stars.where("outside").select("hub", "node", "component", F.lit(1).alias("role"), to("rows").alias("r"), deal("columns", 2).alias("c"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, ["hub", "r", "c"]):
            u, v = _links_between(block, percent)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    blocks = base.unionByName(outside).join(sets, "node").repartition("hub", "r", "c").sortWithinPartitions("hub", "r", "c")
    return blocks.mapInArrow(compare, "u long, v long")


def _blocks_of(n: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / ROWS_OF_BLOCK), F.ceil(size / SIZE_OF_BLOCK)).cast("int")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document; first: the one row of its group that is to stay; text_key."""
    work = Work(docs.sparkSession, "minhash")
    signed = work.cut(signatures(docs, width, permutations), "signed")
    nodes = signed.where("node is not null and doc_id is not null").groupBy("node")
    nodes = work.cut(nodes.agg(F.any_value("signature").alias("signature"), F.min(F.struct("doc_id", "text_key")).alias("least"), F.any_value("n_shingles").alias("n")), "nodes")
    buckets = work.cut(_buckets(nodes, rows), "buckets")
    # an early document is the hub: later ones are more often copies of it than of each other
    hubs = buckets.groupBy("bucket").agg(F.min_by("node", "doc_id").alias("hub"), F.min("node").alias("low"), F.max("node").alias("top")).where("low <> top").select("bucket", "hub")
    shared = work.cut(buckets.join(hubs, "bucket").where("node <> hub").select("hub", "node").distinct(), "shared")
    work.drop_table(buckets)

    # a star is a hub and all nodes that share a bucket with it; whoever shares a bucket shares a star
    own = shared.select("hub").distinct()
    stars = work.cut(shared.unionByName(own.select("hub", F.col("hub").alias("node"))).join(nodes.select("node", "n"), "node"), "stars")
    ends = work.cut(nodes.join(stars.select("node").distinct(), "node", "left_semi").select("least.*"), "wanted")
    sets = work.cut(_full_sets(docs, ends, ends.count(), width, permutations), "sets")
    sizes = stars.groupBy("hub").agg(_blocks_of(F.count(F.lit(1)), F.sum("n")).alias("rows"))
    to_hub = stars.join(sizes, "hub").select("hub", "node", F.col("node").alias("component"), (F.col("node") == F.col("hub")).alias("outside"), "rows", F.lit(1).alias("columns"))
    label = work.cut(components(_compared(to_hub, sets, percent), work), "label")

    # within stars that still hold several components, all outside the largest meet all
    placed = stars.join(label.select(F.col("u").alias("node"), "component"), "node", "left").select("hub", "node", "n", F.coalesce("component", "node").alias("component"))
    placed = work.cut(placed, "placed")
    parts = placed.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"))
    facts = parts.groupBy("hub").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("k"), F.sum("size").alias("size"), F.max(F.struct("k", "component", "size")).alias("most"))
    facts = facts.where("parts > 1 and k > 2").select("hub", F.col("most.component").alias("main"), _blocks_of(F.col("k"), F.col("size")).alias("rows"), _blocks_of(F.col("k") - F.col("most.k"), F.col("size") - F.col("most.size")).alias("columns"))
    opened = placed.join(facts, "hub").select("hub", "node", "component", (F.col("component") != F.col("main")).alias("outside"), "rows", "columns")
    more = work.cut(_compared(opened, sets, percent), "more")

    # links between components, as links between their labels
    of = lambda c: label.select(F.col("u").alias(c), F.col("component").alias(f"of_{c}"))
    lifted = more.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v"))
    joined = components(lifted, work)
    label = label.select(F.col("u").alias("node"), "component").unionByName(joined.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()
    label = label.join(joined.select(F.col("u").alias("component"), F.col("component").alias("joined")), "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    of_node = nodes.select("node", "least").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = of_node.groupBy("component").agg(F.min("least").alias("least"))
    named = work.cut(of_node.select("node", "component").join(firsts, "component").select("node", "least"), "named")

    whole = signed.select("doc_id", "text_key", "n_shingles", "node").join(named, "node", "left")
    name = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id"))
    first = F.coalesce(F.struct("doc_id", "text_key") == F.col("least"), F.lit(True))
    return whole.select("doc_id", "n_shingles", name.alias("component_id"), F.coalesce(F.col("doc_id") == name, F.lit(True)).alias("kept"), F.when(F.col("doc_id").isNull(), F.lit(True)).otherwise(first).alias("first"), "text_key")
