"""Benchmark decontamination by CGK embedding, bit sampling and exact edit verification.

A document leaks an item when some run of its words is within floor(EDITS * n) word edits of the item's n
words (ASCII lower case, words ``[^\\x20\\x09-\\x0D]+``): words may be changed, inserted or left out.

Windows of as many words as the item has are embedded by the random walk of Chakraborty, Goldenberg and
Koucky: at every step the walk writes the word it stands on and a random bit of (step, word) says whether it
moves on; so strings at a small edit distance become strings at a small Hamming distance.  REPEATS tables each
sample SAMPLED coordinates of the embedding; a window and an item that agree in one table are compared by an
exact alignment whose ends are free within the window and as many words around it as edits are allowed.
Windows are taken at every word, for every length that items have.  Before the walk a window must pass two
tests that no leak can fail at its first word: with d edits, of whatever kind, the window holds all but d of
the item's words in at most d + 1 stretches, so enough runs (of up to 3 words) of items of its length; and all
but d of its words occur in them.

Items are held in blocks of about BLOCK words, one broadcast for each block: a larger benchmark means more
passes over the documents, not a larger broadcast.  Items of one text are held once.

Defined results: null and empty texts and items leak nothing; an item of few words allows no edits below
1/EDITS words; repeated items each report, with null item_ids too; repeated documents each report; null
doc_ids are carried through; a very long text is worked on alone, whole; empty tables give an empty table
(``decontaminate``: all documents where the benchmark is empty).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.llm import textops as X
from epochal.llm.work import small_batches

EDITS = 0.2
SAMPLED, REPEATS, SEED = 2, 96, 5
BLOCK = 1_000_000
CELLS = 400_000
"""Words of windows, or steps of walks, that are held at once."""
_SLOTS = 1 << 19


class Items:
    """The items of one block by length: word filter, embedded sample tables and words."""

    def __init__(self, keys: list[int], texts: list[str | None], edits: float = EDITS) -> None:
        self.edits = edits
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, text in zip(keys, texts, strict=True):
            data, offsets = X.buffers(pa.array([text], pa.string()))
            data = X.lower_ascii(data)
            starts, ends, _ = X.word_spans(data, offsets)
            if len(starts):
                by_length.setdefault(len(starts), []).append((i, X.span_hashes(data, starts, ends)))
        self.lengths = sorted(by_length)
        # sets of words and of runs as bit tables: 64 lengths share a cell; a false bit only costs a comparison
        groups = -(-len(self.lengths) // 64)
        self.known = np.zeros((groups, _SLOTS), dtype=np.uint64)
        self.runs = {w: np.zeros((groups, _SLOTS), dtype=np.uint64) for w in {self.run(n) for n in self.lengths}}
        self.ids, self.words, self.keys = [], [], []
        for k, length in enumerate(self.lengths):
            own = by_length[length]
            words = np.stack([w for _, w in own])
            bit = np.uint64(1) << np.uint64(k % 64)
            self.known[k // 64, (words % np.uint64(_SLOTS)).ravel()] |= bit
            bounds = np.arange(len(words) + 1) * length
            runs, _ = X.shingle_hashes(words.ravel(), bounds, self.run(length))
            self.runs[self.run(length)][k // 64, runs % np.uint64(_SLOTS)] |= bit
            self.ids.append(np.array([i for i, _ in own]))
            self.words.append(words)
            self.keys.append(sample_keys(embed(words)))

    def allowed(self, length: int) -> int:
        return int(self.edits * length + 1e-9)

    def run(self, length: int) -> int:
        d = self.allowed(length)
        return min(3, -(-(length - d) // (d + 1)))

    def need(self, length: int) -> int:
        """Runs of the item that a window at a leak's first word holds: n - d of its words in at most d + 1 stretches."""
        width, d = self.run(length), self.allowed(length)
        return max(1, length - d - (d + 1) * (width - 1))


def embed(strings: np.ndarray) -> np.ndarray:
    """The CGK walk of equally long strings (rows of 64-bit symbols), three steps for each symbol."""
    n, length = strings.shape
    padded = np.concatenate([strings, np.zeros((n, 1), dtype=np.uint64)], axis=1)
    at = np.zeros(n, dtype=np.int64)
    out = np.empty((3 * length, n), dtype=np.uint64)
    row = np.arange(n)
    for step in range(3 * length):
        symbol = padded[row, at]
        out[step] = symbol
        bit = X.mix(symbol + np.uint64((SEED + step) * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(1)
        at = np.minimum(at + bit.astype(np.int64), length)
    return out


def sample_keys(embedded: np.ndarray) -> np.ndarray:
    """REPEATS x strings: fingerprints of SAMPLED coordinates each."""
    random = np.random.default_rng(SEED)
    out = np.empty((REPEATS, embedded.shape[1]), dtype=np.uint64)
    for r in range(REPEATS):
        at = random.integers(0, len(embedded) * 2 // 3, SAMPLED)  # the walk of most strings ends soon after
        key = np.full(embedded.shape[1], r + 1, dtype=np.uint64)
        for a in at:
            key = X.mix(key * np.uint64(0x9FB21C651E98DF25) + embedded[a])
        out[r] = key
    return out


_COST = 1 << 20


def alignments(items: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the fewest edits between an item and any run of a span, and where the first such run begins."""
    n, width = spans.shape
    places = np.arange(width + 1, dtype=np.int64)
    best = np.tile(places, (n, 1))  # edits * _COST + where the run begins
    for i in range(items.shape[1]):
        now = np.empty_like(best)
        now[:, 0] = best[:, 0] + _COST
        now[:, 1:] = np.minimum(best[:, 1:] + _COST, best[:, :-1] + _COST * (items[:, i : i + 1] != spans))
        # an insertion costs 1 for each place moved: a running minimum of (value - place)
        best = np.minimum.accumulate(now - places * _COST, axis=1) + places * _COST
    least = best.min(axis=1)
    return least // _COST, least % _COST


def leaks(texts: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item id, first word, edits): the best window of every text and item that match."""
    found: list[tuple[np.ndarray, ...]] = []
    for first, _, data, offsets in X.pieces(texts):
        data = X.lower_ascii(data)
        starts, ends, bounds = X.word_spans(data, offsets)
        if not len(starts):
            continue
        words = X.span_hashes(data, starts, ends)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        for width, tables in items.runs.items():
            runs, begin = X.shingle_hashes(words, bounds, width)
            place = np.arange(len(runs)) + np.repeat(bounds[:-1] - begin[:-1], np.diff(begin))  # a run's first word
            slot = (runs % np.uint64(_SLOTS)).astype(np.int64)
            for group, table in enumerate(tables):
                bits = table[slot]
                hit = np.flatnonzero(bits)
                for k, length in enumerate(items.lengths[group * 64 : group * 64 + 64]):
                    if items.run(length) != width:
                        continue
                    own = place[hit[(bits[hit] >> np.uint64(k)) & np.uint64(1) > 0]]
                    need = items.need(length)
                    if len(own) < need:
                        continue
                    span = length - width  # the last run of enough ones must begin at most so far after the first
                    least, most = own[need - 1 :] - span, own[: len(own) - need + 1]
                    near = least <= most
                    reach = np.zeros(len(words) + 1, dtype=np.int32)
                    np.add.at(reach, np.maximum(least[near], 0), 1)
                    np.add.at(reach, most[near] + 1, -1)
                    at = np.flatnonzero(np.cumsum(reach[:-1])) if near.any() else own[:0]
                    at = at[at + length - items.allowed(length) <= bounds[1:][text[at]]]
                    rows = max(1, CELLS // (3 * length))
                    for lo in range(0, len(at), rows):
                        found.extend(_matches(words, at[lo : lo + rows], text, bounds, first, items, group * 64 + k))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    text, item, start, edits = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, edits, item, text))
    text, item, start, edits = text[order], item[order], start[order], edits[order]
    best = np.ones(len(text), dtype=bool)  # candidates that all fail leave nothing
    best[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    return text[best], item[best], start[best], edits[best]


def _words_at(words: np.ndarray, at: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """n words from each place on; 0 for those outside the place's own text (low, high)."""
    place = at[:, None] + np.arange(n)
    inside = (place >= low[:, None]) & (place < high[:, None])
    return np.where(inside, words[np.clip(place, 0, len(words) - 1)], np.uint64(0))


def _matches(words: np.ndarray, at: np.ndarray, text: np.ndarray, bounds: np.ndarray, first: int, items: Items, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    if not len(at):
        return
    length, edits_allowed = items.lengths[k], items.allowed(items.lengths[k])
    windows = _words_at(words, at, length, bounds[text[at]], bounds[text[at] + 1])
    known = (items.known[k // 64][(windows % np.uint64(_SLOTS)).astype(np.int64)] >> np.uint64(k % 64)) & np.uint64(1)
    enough = known.sum(axis=1) >= length - items.allowed(length)
    at, windows = at[enough], windows[enough]
    if not len(at):
        return
    keys = sample_keys(embed(windows))
    pairs = []
    for own, of_items in zip(keys, items.keys[k], strict=True):
        order = np.argsort(of_items, kind="stable")
        lo, hi = np.searchsorted(of_items[order], own), np.searchsorted(of_items[order], own, side="right")
        hit = np.flatnonzero(hi > lo)
        which = np.repeat(hit, (hi - lo)[hit])
        nth = np.arange(len(which)) - np.repeat(np.cumsum((hi - lo)[hit]) - (hi - lo)[hit], (hi - lo)[hit])
        pairs.append(which * np.int64(len(of_items)) + order[lo[which] + nth])
    pair = np.unique(np.concatenate(pairs))
    rows = max(1, CELLS // (length + 2 * edits_allowed))
    for lo in range(0, len(pair), rows):
        window, item = pair[lo : lo + rows] // items.keys[k].shape[1], pair[lo : lo + rows] % items.keys[k].shape[1]
        place = at[window]
        own = text[place]
        spans = _words_at(words, place - edits_allowed, length + 2 * edits_allowed, bounds[own], bounds[own + 1])
        edits, begin = alignments(items.words[k][item], spans)
        good = edits <= edits_allowed
        start = np.maximum(place[good] - edits_allowed + begin[good] - bounds[own[good]], 0)
        yield own[good] + first, items.ids[k][item[good]], start, edits[good]


def _keyed(benchmark: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return benchmark.select(F.col("item_id").cast("long"), F.xxhash64(text).alias("item_key"), text.alias("text")).where("text is not null")


def _blocks(benchmark: DataFrame, edits: float) -> Iterator[Items]:
    """Blocks of items of different texts; their number follows the benchmark's size, a block's size does not."""
    small_batches(benchmark.sparkSession)
    items = _keyed(benchmark).select("item_key", "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(chars) // (5 * BLOCK)))
    for k in range(n):
        rows = sorted(tuple(r) for r in items.where(F.pmod("item_key", F.lit(n)) == k).collect())
        yield Items([r[0] for r in rows], [r[1] for r in rows], edits)


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, first_word, n_edits: a row for each document and item that match; clean documents have none."""
    out = None
    for items in _blocks(benchmark, edits):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text, item, start, edits = leaks(batch.column("text"), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text)), pa.array(item), pa.array(start), pa.array(edits)], ["doc_id", "item_key", "first_word", "n_edits"])

        own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, item_key long, first_word long, n_edits long")
        out = own if out is None else out.unionByName(own)
    return out.join(_keyed(benchmark).select("item_id", "item_key"), "item_key").select("doc_id", "item_id", "first_word", "n_edits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The documents, with all their columns, that leak no item."""
    for items in _blocks(benchmark, edits):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[leaks(batch.column("text"), sent.value)[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
