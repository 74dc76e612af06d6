"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, in each cell, a bit for every language: the AND of an n-gram's HASHES
cells names all languages that have it.  Per text, language l's hits h among n n-grams are corrected for
the false positives of its own slice, (h - n f) / (1 - f) with f its fill to the power HASHES; the language
with most is predicted.

Learned from a bounded sample: of each language about SAMPLE documents that aren't held out, chosen by a hash
of doc_id; n-grams with at least COMMON of a language's occurrences enter its slice, so at most 1 / COMMON do.
Counts are made on the executors, and so are the filter's cells: as many 64-bit words a cell as the learned
languages need come to the driver, 8 MB for each 64 languages.

Defined results: ``und`` with score 0 for a null text or one without a letter; a text none of whose n-grams
is known goes to the most frequent language with score 0; ties go to the language first in the alphabet;
without labelled rows everything is ``und``.  Repeated rows are each predicted; an empty table gives an empty
table; a text's length has no bound.  score is the winner's share of the two largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.llm import textops as X
from epochal.llm.toxicity import held_out
from epochal.llm.work import Work

N, HASHES, SAMPLE, COMMON, SLOTS = 4, 3, 1500, 2e-5, 1 << 20
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the n-grams of letters (other runs count as one space), where each text's begin, letters per text."""
    codes = _letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)]
    opens = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = opens[offsets]
    gap = codes == 32
    letters = np.concatenate([[0], np.cumsum(~gap)])
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    kept = np.concatenate([[0], np.cumsum(keep)])
    codes, begin = codes[keep].astype(np.uint64), kept[bounds]
    n = max(0, len(codes) - N + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(N):
        out += codes[k : k + n] * _C[k]
    whole = np.ones(n, dtype=bool)  # an n-gram does not reach into the next text
    for b in begin[1:-1]:
        whole[max(0, b - N + 1) : b] = False
    at = np.concatenate([[0], np.cumsum(whole)])
    return X.mix(out[whole]), at[np.minimum(begin, n)], letters[bounds[1:]] - letters[bounds[:-1]]


def _slots(fingerprints: np.ndarray) -> list[np.ndarray]:
    step = (fingerprints >> np.uint64(40)) | np.uint64(1)
    return [((fingerprints + np.uint64(k) * step) % np.uint64(SLOTS)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """Bit-sliced cells (SLOTS x words of 64 languages) and each language's rate of false positives."""

    def __init__(self, languages: list[str], cells: np.ndarray) -> None:
        self.languages, self.cells = languages, cells
        fill = [self.bits(cells[:, k // 64], k).mean() for k in range(len(languages))]
        self.false = np.array(fill, dtype=float) ** HASHES

    @staticmethod
    def bits(words: np.ndarray, k: int) -> np.ndarray:
        return (words >> np.uint64(k % 64)) & np.uint64(1)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts (texts x languages) and letters per text."""
        fingerprints, begin, letters = grams(data, offsets)
        slots = _slots(fingerprints)
        total, hits = np.diff(begin), np.empty((len(begin) - 1, len(self.languages)))
        for k in range(len(self.languages)):
            if k % 64 == 0:
                masks = reduce(np.bitwise_and, (self.cells[slot, k // 64] for slot in slots))
            run = np.concatenate([[0], np.cumsum(self.bits(masks, k), dtype=np.int64)])
            hits[:, k] = run[begin[1:]] - run[begin[:-1]]
        return np.maximum(0, (hits - total[:, None] * self.false) / (1 - self.false)), letters


def train(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    spark = docs.sparkSession
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    found = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    languages = [r["lang"] for r in found]
    cells = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), dtype=np.uint64)
    if not languages:
        return Filters([], cells)
    rates = spark.createDataFrame([(r["lang"], k, int(min(1.0, sample / r["count"]) * (1 << 30))) for k, r in enumerate(found)], "lang string, k long, rate long")
    texts = usable.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < F.col("rate")).select("k", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("k").to_numpy()
            for first, last, data, offsets in X.pieces(batch.column("text")):
                grams_of, begin, _ = grams(data, offsets)
                of = np.repeat(lang[first:last], np.diff(begin))
                for k in np.unique(of):
                    own, n = np.unique(grams_of[of == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k)), pa.array(own.view(np.int64)), pa.array(n)], ["k", "gram", "n"])

    counts = texts.mapInArrow(count, "k long, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    counts = Work(spark, "language").cut(counts, "counts")
    totals = counts.groupBy("k").agg(F.sum("n").alias("total"))
    common = counts.join(F.broadcast(totals), "k").where(F.col("n") >= F.col("total") * COMMON)  # a row for each language
    low, step = F.col("gram").bitwiseAND(F.lit(SLOTS - 1)), F.shiftrightunsigned("gram", 40).bitwiseOR(F.lit(1))
    slots = [(low + F.lit(k) * step).bitwiseAND(F.lit(SLOTS - 1)) for k in range(HASHES)]
    masks = common.select(F.explode(F.array(*slots)).alias("slot"), F.expr("k div 64").alias("word"), F.expr("shiftleft(1L, cast(k % 64 as int))").alias("mask"))
    masks = masks.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # the cells that are not empty
    cells[masks.column("slot").to_numpy(), masks.column("word").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64)
    return Filters(languages, cells)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS cells of 8 bytes for each 64 languages

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        order = sorted(range(len(own.languages)), key=lambda k: own.languages[k])
        names = np.array([own.languages[k] for k in order] + ["und"], dtype=object)
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, data, offsets in X.pieces(batch.column("text")):
                n = last - first
                counts, letters = own.counts(data, offsets)
                if order:
                    counts = counts[:, order]
                    best = counts.argmax(axis=1)
                    best[counts.max(axis=1) == 0] = order.index(0)  # languages are held by falling frequency
                    top = np.sort(np.concatenate([np.zeros((n, 1)), counts], axis=1), axis=1)[:, -2:]
                    share = np.where(top[:, 1] > 0, top[:, 1] / np.maximum(top.sum(axis=1), 1e-12), 0.0)
                    best[letters == 0], share[letters == 0] = len(names) - 1, 0.0
                else:
                    best, share = np.zeros(n, dtype=np.int64), np.zeros(n)
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(names[best].tolist(), pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
