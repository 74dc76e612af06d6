"""A consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at VIRTUAL places of the ring; a document belongs to the first place clockwise of its
hash.  A shard takes documents up to its capacity; those that overflow continue clockwise to the next
shard with room.  Documents next to a shard have the right of way: first every arc fills its own shard, arc
after arc in ring order, then the overflow moves on, again in ring order.

With the default slack of 0 the capacities are the counts as equal as can be (law ``rows``); a larger
slack moves fewer documents when a shard is added.

Only counts decide, and they are kept by bins of the ring: a bin's documents are ranked within the bin, bins
within blocks, blocks (at most BLOCKS) on the driver; the plan that the driver makes of these counts has
a segment for each arc and each place where a shard fills up, whatever the number of documents.

Defined results: a null text has size 1; rows without a doc_id have no key and stand anywhere on the ring, each
at a place of its own; repeated rows are each placed; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochal.llm.work import Work

VIRTUAL, BLOCKS, PER_BIN = 64, 1024, 1000


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Places (31-bit, ascending) and the shard that stands at each."""
    at = [(int.from_bytes(sha256(f"{s}:{v}".encode()).digest()[:4], "big") >> 1, s) for s in range(shards) for v in range(virtual)]
    at.sort()
    return np.array([a for a, _ in at], dtype=np.int64), np.array([s for _, s in at], dtype=np.int64)


def capacities(total: int, shards: int, slack: float = 0.0) -> np.ndarray:
    if slack <= 0:
        return np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    return np.full(shards, int(np.ceil(total * (1 + slack) / shards)), dtype=np.int64)


def assign(sizes: np.ndarray, owners: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Segments (first rank, last rank + 1, shard, first slot) of documents ranked clockwise, arc after arc.

    ``sizes`` are the arcs' counts, ``owners`` their shards, ``room`` the shards' capacities.
    """
    room, slots = room.copy(), np.zeros(len(room), dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    segments, over = [], []

    def put(first: int, n: int, shard: int) -> None:
        segments.append((first, first + n, shard, int(slots[shard])))
        slots[shard] += n
        room[shard] -= n

    for a, (n, shard) in enumerate(zip(sizes.tolist(), owners.tolist(), strict=True)):
        take = min(n, int(room[shard]))
        if take:
            put(int(begin[a]), take, shard)
        if take < n:
            over.append((a, int(begin[a]) + take, n - take))
    for a, first, n in over:
        place = a
        while n:
            place = (place + 1) % len(owners)
            take = min(n, int(room[owners[place]]))
            if take:
                put(first, take, int(owners[place]))
                first, n = first + take, n - take
    return sorted(segments)


def shard(docs: DataFrame, shards: int = 16, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    work = Work(docs.sparkSession, "sharding")
    body = F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b""))
    key = F.col("doc_id").cast("long")
    place = F.xxhash64(F.coalesce(key, F.monotonically_increasing_id())).bitwiseAND(F.lit((1 << 31) - 1))  # written at once, so it stays
    keyed = docs.select(key.alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), place.alias("place"))
    keyed = work.cut(keyed, "keyed")
    total = keyed.count()
    bins = 1 << max(8, int(np.ceil(np.log2(max(1, total) / PER_BIN))))
    places, owners = ring(shards)

    # a bin never spans two arcs: its number is (arc, part of the ring)
    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy(zero_copy_only=False)
            # the arc after the last place belongs to the first place: it is ranked at the ring's end, as arc len(places)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(places, at))], [*batch.schema.names, "arc"])

    keyed = keyed.mapInArrow(arcs, "doc_id long, size long, text_crc32 long, place long, arc long")
    binned = keyed.withColumn("bin", F.col("arc") * bins + F.expr(f"place div {(1 << 31) // bins}"))
    within = Window.partitionBy("bin").orderBy("place", "doc_id", "text_crc32", "size")
    ranked = work.cut(binned.withColumn("rank", F.row_number().over(within) - 1), "ranked")
    counts = ranked.groupBy("arc", "bin").agg(F.count(F.lit(1)).alias("n"))
    # blocks of arcs and equal parts of them, so that a block's bins are few and the blocks fit the driver
    block = F.col("arc") * F.lit(max(1, BLOCKS // 256)) + F.expr(f"(bin % {bins}) div {max(1, bins // max(1, BLOCKS // 256))}")
    counts = work.cut(counts.withColumn("block", block), "counts")
    blocks = counts.groupBy("block", "arc").agg(F.sum("n").alias("n")).orderBy("block").toPandas()  # a few for each arc
    before = np.concatenate([[0], np.cumsum(blocks["n"].to_numpy(dtype=np.int64))])
    sizes = np.bincount(blocks["arc"].to_numpy(dtype=np.int64), weights=blocks["n"].to_numpy(), minlength=len(places) + 1).astype(np.int64)
    plan = assign(sizes, np.append(owners, owners[0]), capacities(total, shards, slack)) if total else []
    first, goes, slot = (np.array([p[k] for p in plan], dtype=np.int64) for k in (0, 2, 3))
    start = docs.sparkSession.createDataFrame([(int(b), int(n)) for b, n in zip(blocks["block"], before[:-1], strict=True)], "block long, before long")
    run = Window.partitionBy("block").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("inside", F.coalesce(F.sum("n").over(run), F.lit(0))).join(F.broadcast(start), "block").select("bin", (F.col("before") + F.col("inside")).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(first, rank, side="right") - 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(["rows"] * n, pa.string()), pa.array(goes[at].astype(np.int32)), pa.array(slot[at] + rank - first[at]), pa.nulls(n, pa.int32())],
                ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
            )

    placed = ranked.join(offsets, "bin").select("doc_id", "size", "text_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return placed.mapInArrow(place, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
