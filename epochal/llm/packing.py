"""Lexical retrieval packing.

Every document's ids are cut into whole windows, each a sequence of its own, and a remainder.  Remainders
are dealt by their rarest ids (in a byte-pair vocabulary a larger id is a later, rarer merge), so texts
with rare words in common are neighbours; runs of SHARD remainders in that order are the shards of a BM25
inverted index (document frequencies and mean length are those of the whole corpus).  Each unused
remainder in turn is a seed: its shard's index returns its unused neighbours, best first by all ids that
they share, which fill the seed's window; the last one is cut to fit and what is left of it returns to the
shard.  What a shard has not filled at its end goes on to the next shard of the task, so that only a task's
last sequence has padding.

Defined results: a null or empty text has the closing id 0 only; null and repeated doc_ids are packed row by
row; an empty table gives an empty table; a text with too many ids for memory is the only bound (one text
is tokenised at a time).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.llm import textops as X
from epochal.llm import tokens
from epochal.llm.work import Work

WINDOW, SHARD = 1024, 4096
VOCABULARY, SPECIAL = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(docs: DataFrame, path: str, special: tuple[tuple[str, int], ...], window: int) -> DataFrame:
    """Whole windows (ids null) and remainders (their ids) of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(tokens.encoder(path, special).encode_to_numpy, allowed_special="all")
        task, sequences = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            for first, last, data, offsets in X.pieces(batch.column("text")):
                raw, rows = data.tobytes(), []
                for i in range(first, last):
                    ids = np.append(encode(raw[offsets[i - first] : offsets[i - first + 1]].decode("utf-8")), 0).astype("<u4")
                    whole = len(ids) // window * window
                    for start in range(0, whole, window):
                        rows.append((own[i], start, window, crc32(ids[start : start + window].tobytes()), len(ids), (1 << 62) | (task << 36) | sequences, 0, None, 0, 0))
                        sequences += 1
                    if whole < len(ids):
                        rest = ids[whole:]
                        rare = np.unique(rest)[-2:]
                        rows.append((own[i], whole, len(rest), None, len(ids), None, None, rest.astype("<u4").tobytes() if rest.max() > 65535 else rest.astype("<u2").tobytes(), int(rare[-1]), int(rare[0])))
                types = [pa.int64()] * 7 + [pa.binary(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "rarest", "rare"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, PIECES + ", ids binary, rarest int, rare int")


def _ids(raw: bytes, length: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * length else "<u4")


def _frequencies(rests: DataFrame) -> DataFrame:
    """(id, n): in how many remainders an id is; a task sends each id of the vocabulary once at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for raw, length in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist(), strict=True):
                own = np.unique(_ids(raw, length)).astype(np.int64)
                if own[-1] >= len(total):
                    total = np.pad(total, (0, int(own[-1]) + 1 - len(total)))
                total[own] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    return rests.select("ids", "length").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


class _Shard:
    """An inverted index over some remainders; BM25 scores of all of them for a seed's distinct ids."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        key = np.sort(np.concatenate(pieces).astype(np.int64) * n + np.repeat(np.arange(n), size))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf, key = np.diff(np.append(first, len(key))), key[first]
        term, self.piece = key // n, key % n
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.piece] / mean))
        self.begin = np.searchsorted(term, np.arange(len(idf) + 1))
        self.n = n
        # ids that many remainders have stand in a dense table, the others in lists
        dense = np.diff(self.begin) > n // 16
        self.place = np.cumsum(dense) - 1
        self.place[~dense] = -1
        self.table = np.zeros((int(dense.sum()), n), dtype=np.float32)
        often = dense[term]
        self.table[self.place[term[often]], self.piece[often]] = self.weight[often]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        own = np.unique(ids).astype(np.int64)
        place = self.place[own]
        wanted = np.zeros(len(self.table), dtype=np.float32)
        wanted[place[place >= 0]] = 1
        own = own[place < 0]
        spans = [slice(a, b) for a, b in zip(self.begin[own].tolist(), self.begin[own + 1].tolist(), strict=True)]
        common = wanted @ self.table
        if not spans:
            return common.astype(np.float64)
        return common + np.bincount(np.concatenate([self.piece[s] for s in spans]), weights=np.concatenate([self.weight[s] for s in spans]), minlength=self.n)


def _falling(values: np.ndarray, at_once: int = 24) -> Iterator[int]:
    """Places by falling value, ties in order; only as many as asked for are sorted."""
    least = np.partition(values, -at_once)[-at_once] if len(values) > at_once else -np.inf
    top = np.flatnonzero(values > least)
    yield from top[np.argsort(-values[top], kind="stable")].tolist()
    rest = np.flatnonzero(values <= least)
    yield from rest[np.argsort(-values[rest], kind="stable")].tolist()


def pack_shard(rows: list[list], idf: np.ndarray, mean: float, window: int, last: bool) -> tuple[list[list[list]], list[list]]:
    """Full windows made of [doc_id, start, ids, doc_tokens] rows, and the rows that are left (none if last).

    A window takes its seed's neighbours in falling order of their scores until it is full; only when no
    unused remainder shares an id with the seed does the order in which they stand decide.
    """
    windows: list[list[list]] = []
    room_left = sum(len(r[2]) for r in rows)
    free = np.zeros(0, dtype=bool)
    while room_left >= window or (last and room_left):
        if 2 * free.sum() <= len(free):  # an index of what is still unused
            rows = [r for r, f in zip(rows, free, strict=True) if f] if len(free) else rows
            shard, free, seed = _Shard([r[2] for r in rows], idf, mean), np.ones(len(rows), dtype=bool), 0
        while not free[seed]:
            seed += 1
        mine, room, free[seed] = [rows[seed]], window - len(rows[seed][2]), False
        if room:
            found = np.where(free, shard.scores(rows[seed][2]), -1.0)
            for i in _falling(found):
                if not room or found[i] < 0:
                    break
                doc, start, ids, total = rows[i]
                if len(ids) <= room:
                    mine.append(rows[i])
                    free[i] = False
                else:
                    mine.append([doc, start, ids[:room], total])
                    rows[i] = [doc, start + room, ids[room:], total]
                room -= len(mine[-1][2])
        room_left -= window - room
        windows.append(mine)
    return windows, [r for r, f in zip(rows, free, strict=True) if f] if len(free) else rows


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, special: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` is a rank file, ``special`` the strings with an id of their own (default: those of SPECIAL).
    """
    work = Work(docs.sparkSession, "packing")
    if special is None:
        special = {} if path else tokens.special_tokens(tokens.public_path(SPECIAL))
    cut = work.cut(_cut(docs, path or tokens.public_path(VOCABULARY), tuple(special.items()), window), "cut")
    rests = cut.where("ids is not null")
    counts = _frequencies(rests).toPandas()  # a row for each id of the vocabulary at most
    n, mean = rests.agg(F.count(F.lit(1)), F.avg("length")).first()
    idf = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1)
    idf[counts["id"].to_numpy(dtype=np.int64)] = np.log(1 + (n - counts["n"].to_numpy() + 0.5) / (counts["n"].to_numpy() + 0.5))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sequences, held = TaskContext.get().partitionId(), 0, []

        def written(windows: list[list[list]]) -> pa.RecordBatch:
            nonlocal sequences
            rows = []
            for w in windows:
                offset = 0
                for doc, start, ids, total in w:
                    rows.append((doc, start, len(ids), crc32(ids.astype("<u4").tobytes()), total, (task << 36) | sequences, offset))
                    offset += len(ids)
                sequences += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, start, length, raw, total in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids", "doc_tokens")), strict=True):
                held.append([doc, start, _ids(raw, length), total])
                if len(held) >= SHARD:
                    windows, held = pack_shard(held, idf, mean, window, last=False)
                    yield written(windows)
        if held:
            yield written(pack_shard(held, idf, mean, window, last=True)[0])

    dealt = rests.select("doc_id", "start", "length", "ids", "doc_tokens", "rarest", "rare").repartitionByRange("rarest", "rare", "doc_id", F.xxhash64("ids")).sortWithinPartitions("rarest", "rare", "doc_id", "start")
    packed = dealt.select("doc_id", "start", "length", "ids", "doc_tokens").mapInArrow(fill, PIECES)
    return cut.where("ids is null").select(*packed.columns).unionByName(packed)
