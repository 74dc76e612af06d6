"""Phrase collocations: n-grams as rows, counted per language, scored by their weakest cut.

1. Every run of 1, 2 .. ``longest`` words of a piece becomes a row (lang, phrase, count), equal runs of two MB
   of text counted together first, and rows are hash-aggregated by language and phrase.  One level follows the
   other: a phrase can only reach the least count if the two phrases that are one word shorter do, so a Bloom
   filter of the level before tells which runs need no row.  The filter has a fixed largest size; a full one lets
   more rows through and never loses any, so the counts are exact for any corpus.
2. Counts of the two parts of each cut come by joins; scores are whole-number divisions of decimals with 38 digits.
3. A candidate with a one-word extension that is about as frequent is dropped by an anti-join.  Longer extensions
   need no look: what holds for a phrase of more words holds for the phrases between.
4. Ranks come from a window over what windows over shares of each language let through, so a language that holds
   most of the phrases is not sorted in one task.

Defined results: a null or wordless text has no phrases; null languages count as ``und``; rows with equal ids
are texts like any other; an empty table gives an empty table; columns besides text and lang are ignored.
Within a piece of two MB equal phrases are told by 64-bit fingerprints (two unlike ones meet with a chance of
1e-9), between pieces by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.llm import textops as X
from epochal.llm.work import Work

PIECE_BYTES = 2 << 20
FILTER_BITS = 1 << 28
"""Most bits of the filter of a level's frequent phrases (32 MB are broadcast at most)."""
SHARES = 64
"""Parts of a language that are ranked apart first."""

_TO = X.lower_ascii(np.arange(256, dtype=np.uint8))
_TO[list(b".,;:!?")] = 0x0A
_U = np.uint64


def _words(texts: pa.Array, langs: np.ndarray) -> Iterator[tuple]:
    """Per piece of text: bytes, starts and ends of its words, the text of each, its fingerprint by language, and how many words follow in its piece."""
    for first, last, data, offsets in X.pieces(texts, PIECE_BYTES):
        data = _TO[data]
        starts, ends, bounds = X.word_spans(data, offsets)
        if not len(starts):
            continue
        text = np.repeat(np.arange(first, last), np.diff(bounds))
        breaks = np.concatenate([[0], np.cumsum((data >= 0x0A) & (data <= 0x0D))])[starts] + text
        end = np.flatnonzero(np.concatenate([(breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1]), [True]]))
        left = np.repeat(end, np.diff(np.concatenate([[-1], end]))) - np.arange(len(starts))
        yield data, starts, ends, text, X.mix(X.span_hashes(data, starts, ends) ^ langs[text]), left


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of the n words from each word on (the last ones wrap; nobody asks for them)."""
    out = words
    for k in range(1, n):
        out = X.mix(out * _U(0x9FB21C651E98DF25) + np.roll(words, -k))
    return out


def _slots(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    low, high = keys & _U(0xFFFFFFFF), keys >> _U(32) | _U(1)
    return ((low + _U(k) * high) & _U(bits - 1) for k in range(3))


def _maybe(cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), dtype=bool)
    for at in _slots(keys, 64 * len(cells)):
        out &= (cells[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) > 0
    return out


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, n: int) -> pa.Array:
    """The n words from each of ``first`` on, joined by one space."""
    word = (first[:, None] + np.arange(n)).ravel()
    length = ends[word] - starts[word]
    gap = np.ones(len(word), dtype=np.int64)
    gap[n - 1 :: n] = 0
    at = np.concatenate([[0], np.cumsum(length + gap)])
    source = np.repeat(starts[word] - at[:-1], length + gap) + np.arange(at[-1])
    out = data[np.minimum(source, len(data) - 1)]
    out[(at[:-1] + length)[gap > 0]] = 0x20
    return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.ascontiguousarray(at[::n])), pa.py_buffer(out)]).cast(pa.string())


def _lang_keys(langs: pa.Array) -> np.ndarray:
    data, offsets = X.buffers(langs)
    return X.mix(X.span_hashes(data, offsets[:-1], offsets[1:]) + _U(0x2545F4914F6CDD1D))  # else the word "en" in "de" is the word "de" in "en"


def counted(docs: DataFrame, n: int, shorter=None) -> DataFrame:
    """(lang, phrase, f) of all phrases of n words, but for those of which ``shorter``, a broadcast filter, knows a part to be rare.

    The phrase of no word stands for all words of the language (n = 1 only).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang")
            keys = _lang_keys(lang)
            for data, starts, ends, text, words, left in _words(batch.column("text"), keys):
                at = np.flatnonzero(left >= n - 1)
                if shorter is not None and len(at):
                    known = _maybe(shorter.value, _runs(words, n - 1))
                    at = at[known[at] & known[at + 1]]
                if n == 1:
                    own, count = np.unique(text, return_counts=True)
                    yield pa.RecordBatch.from_arrays([lang.take(pa.array(own)), pa.array([""] * len(own)), pa.array(count)], ["lang", "phrase", "f"])
                if len(at):
                    _, first, count = np.unique(_runs(words, n)[at], return_index=True, return_counts=True)
                    first = at[first]
                    yield pa.RecordBatch.from_arrays([lang.take(pa.array(text[first])), _spelled(data, starts, ends, first, n), pa.array(count)], ["lang", "phrase", "f"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _filter_of(phrases: DataFrame, n: int, count: int) -> np.ndarray:
    """A Bloom filter over the fingerprints of phrases of n words: bits by cell, set by a partial aggregate."""
    bits = min(FILTER_BITS, 1 << max(16, int(np.ceil(np.log2(16 * max(1, count))))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _lang_keys(batch.column("lang"))
            for _, _, _, _, words, left in _words(batch.column("phrase"), keys):
                for at in _slots(_runs(words, n)[left == n - 1], bits):
                    yield pa.RecordBatch.from_arrays([pa.array((at >> _U(6)).astype(np.int64)), pa.array((_U(1) << (at & _U(63))).view(np.int64))], ["cell", "mask"])

    found = phrases.select("lang", "phrase").mapInArrow(work, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found.column("cell").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return out


def _part(words: Column, first: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words with ``least`` occurrences or more.

    A phrase is left out if it lies in a longer one that occurs at least ``percent`` times in a hundred of its own.
    """
    work, spark = Work(docs.sparkSession, "collocations"), docs.sparkSession
    single = work.cut(counted(docs, 1).where((F.col("f") >= least) | (F.col("phrase") == "")), "words")
    totals = work.cut(single.where("phrase = ''").select("lang", F.col("f").alias("n")), "totals")
    levels = [single.where("phrase <> ''").withColumn("words", F.lit(1))]
    for n in range(2, longest + 1):
        found = levels[-1].count()
        if not found:
            break
        sent = spark.sparkContext.broadcast(_filter_of(levels[-1], n - 1, found))
        levels.append(work.cut(counted(docs, n, sent).where(F.col("f") >= least).withColumn("words", F.lit(n)), f"phrases{n}"))
        sent.destroy()
    known = levels[0]
    for level in levels[1:]:
        known = known.unionByName(level)

    parts = known.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("w"))
    cuts = parts.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("first"), _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    count_of = lambda key, name: known.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    cuts = cuts.join(count_of("first", "l"), ["lang", "first"]).join(count_of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n"))).withColumn("below", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.any_value("a").alias("a"), F.any_value("n").alias("n"))

    inner = parts.where("words > 2").select("lang", F.explode(F.array(_part(F.col("w"), 1, F.col("words") - 1), _part(F.col("w"), 2, F.col("words") - 1))).alias("part"), F.col("a").alias("f"))
    same = (inner["lang"] == scored["lang"]) & (inner["part"] == scored["phrase"]) & (100 * inner["f"] >= percent * scored["a"])
    kept = scored.join(inner, same, "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share")
    kept = kept.select("*", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
