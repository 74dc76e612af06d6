"""Language-model scores by masked pseudo-likelihood.

A window network predicts every word from the SIDE words on either side: the sum of position-wise
embeddings goes through tanh to a two-level softmax (classes of words of like frequency, then the word in its
class).  A document's score is the sum of its words' conditional log-probabilities.

Words are those of the corpus, by counts over all documents: those with LEAST occurrences or more, so that the
vocabulary and the weights grow with the corpus, up to the MOST most frequent (a word more costs every position
time).  The rest falls into RARE cells by ending (its last ENDING bytes), which the network knows like words: it
gives a rare word its cell's probability in this context; times the word's share of its cell's count over all
documents, that is a probability of the word's own.  Shares of the HELD most frequent rare words are broadcast,
those of all others come by a join with the counts.

Texts are read twice, for the counts and to write them out as word numbers; training and scores read the numbers.
Training is spread over the corpus: each task runs Adagrad over its documents' positions, every ROUNDS-th a
round so that each position is a target once, starting from common weights; the tasks' weights are averaged,
in levels of at most FAN rows a group, and the next round starts from the average.  So weights depend on how
the table is dealt into tasks, as in any averaging of models; scores of one deal are the same in every run.

Defined results: a null, empty or wordless text has n_tokens 0, log_likelihood 0 and a null mean; null and
repeated doc_ids are scored row by row; a very long text is worked on alone, whole; an empty table gives an
empty table (nothing is trained).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.llm import textops as X
from epochal.llm.work import Work

SIDE, WIDTH, RARE, ENDING = 2, 24, 256, 3
LEAST, MOST = 100, 2880
ROUNDS, BATCH, RATE = 2, 16384, 0.15
BLOCK, FAN, HELD, STEEP = 4096, 256, 1 << 18, 60.0

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Network:
    """The shapes of a network of ``known`` words and RARE cells, and its weights as one row of numbers."""

    known: int

    @property
    def side(self) -> int:
        """Classes, and words in each."""
        return int(np.ceil(np.sqrt(self.known + RARE)))

    @property
    def words(self) -> int:
        return self.side**2

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        n = self.side
        return {"embed": (2 * SIDE, self.words + 1, WIDTH), "bias": (WIDTH,), "top": (WIDTH, n), "top_bias": (n,), "low": (n, WIDTH, n), "low_bias": (n, n)}

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes.values())

    def unpack(self, flat: np.ndarray) -> Weights:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def start(self) -> np.ndarray:
        return np.random.default_rng(1).normal(0, 0.05, self.size).astype(np.float32)


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of words: 56 bits of the whole word, and in the lowest 8 its cell, by its ending."""
    sums = X.byte_sums(data)
    cell = X.span_hashes(data, np.maximum(starts, ends - ENDING), ends, sums) % np.uint64(RARE)
    return (X.span_hashes(data, starts, ends, sums) & ~np.uint64(RARE - 1)) | cell


def words_of(texts: pa.Array, known: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece: first, last + 1, word numbers, bounds, fingerprints.  ``known`` are the frequent words' fingerprints, by rank."""
    order = np.argsort(known, kind="stable")
    ranked = known[order]
    for first, last, data, offsets in X.pieces(texts):
        data = X.lower_ascii(data)
        starts, ends, bounds = X.word_spans(data, offsets)
        own = fingerprints(data, starts, ends)
        number = len(known) + (own % np.uint64(RARE)).astype(np.int64)
        if len(ranked):
            at = np.minimum(np.searchsorted(ranked, own), len(ranked) - 1)
            number = np.where(ranked[at] == own, order[at], number)
        yield first, last, number, bounds, own


def _contexts(numbers: np.ndarray, bounds: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """The words around the given positions (positions x 2 SIDE); ``none`` stands where the text has no word."""
    text = np.searchsorted(bounds, at, side="right") - 1
    low, high = bounds[text], bounds[text + 1]
    out = np.empty((len(at), 2 * SIDE), dtype=np.int64)
    for k, step in enumerate([d for d in range(-SIDE, SIDE + 1) if d]):
        place = at + step
        out[:, k] = np.where((place >= low) & (place < high), numbers[np.clip(place, 0, len(numbers) - 1)], none)
    return out


def _hidden(w: Weights, context: np.ndarray) -> np.ndarray:
    total = w["bias"] + w["embed"][0][context[:, 0]]
    for k in range(1, 2 * SIDE):
        total += w["embed"][k][context[:, k]]
    return np.tanh(total)


def _log_of_chosen(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log-probability of one entry of each row of a softmax (of numbers within STEEP of 0)."""
    np.clip(x, -STEEP, STEEP, out=x)
    own = x[np.arange(len(x)), chosen]
    return own - np.log(np.exp(x, out=x).sum(axis=1))


def _error(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Softmax less one at the chosen entry of each row."""
    np.clip(x, -STEEP, STEEP, out=x)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    x[np.arange(len(x)), chosen] -= 1
    return x


def _by_class(group: np.ndarray, classes: int) -> Iterator[tuple[int, np.ndarray]]:
    group = group.astype(np.uint16)  # a radix sort
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(classes + 1))
    for g in np.flatnonzero(np.diff(ends)).tolist():
        yield g, order[ends[g] : ends[g + 1]]


def log_probabilities(w: Weights, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target given its context."""
    out, n = np.empty(len(target), dtype=np.float64), w["top"].shape[1]
    for lo in range(0, len(target), BATCH):
        own, hidden = target[lo : lo + BATCH], _hidden(w, context[lo : lo + BATCH])
        group, place = own // n, own % n
        value = _log_of_chosen(hidden @ w["top"] + w["top_bias"], group).astype(np.float64)
        for g, rows in _by_class(group, n):
            value[rows] += _log_of_chosen(hidden[rows] @ w["low"][g] + w["low_bias"][g], place[rows])
        out[lo : lo + BATCH] = value
    return out


def gradient(w: Weights, context: np.ndarray, target: np.ndarray) -> Weights:
    """Of the mean negative log-probability."""
    count, n = len(target), w["top"].shape[1]
    hidden, group, place = _hidden(w, context), target // n, target % n
    grads = {name: np.zeros(x.shape, dtype=np.float32) for name, x in w.items()}
    error = _error(hidden @ w["top"] + w["top_bias"], group)
    grads["top"], grads["top_bias"] = hidden.T @ error, error.sum(axis=0)
    back = error @ w["top"].T
    for g, rows in _by_class(group, n):
        own = hidden[rows]
        error = _error(own @ w["low"][g] + w["low_bias"][g], place[rows])
        grads["low"][g], grads["low_bias"][g] = own.T @ error, error.sum(axis=0)
        back[rows] += error @ w["low"][g].T
    back *= 1 - hidden**2
    grads["bias"] = back.sum(axis=0)
    for k in range(2 * SIDE):
        word = context[:, k].astype(np.uint16)
        order = np.argsort(word, kind="stable")
        word = word[order]
        at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        grads["embed"][k][word[at]] = np.add.reduceat(back[order], at, axis=0)
    for g in grads.values():
        g /= count
    return grads


class Trainer:
    """Adagrad over the batches of one task."""

    def __init__(self, network: Network, flat: np.ndarray) -> None:
        self.flat = flat.astype(np.float32).copy()
        self.weights, self.squares, self.seen = network.unpack(self.flat), network.unpack(np.full(network.size, 1e-6, np.float32)), 0

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        for lo in range(0, len(target), BATCH):
            for name, g in gradient(self.weights, context[lo : lo + BATCH], target[lo : lo + BATCH]).items():
                self.squares[name] += g * g
                self.weights[name] -= RATE * g / np.sqrt(self.squares[name])
        self.seen += len(target)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the fingerprint and count of every word of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in X.pieces(batch.column("text")):
                data = X.lower_ascii(data)
                starts, ends, _ = X.word_spans(data, offsets)
                word, n = np.unique(fingerprints(data, starts, ends), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Work(docs.sparkSession, "word-counts").cut(counts, "counts")


def vocabulary(counts: DataFrame, least: int | None = None) -> np.ndarray:
    """Fingerprints of the words with ``least`` occurrences, the most frequent first (ties: smaller fingerprint), at most MOST."""
    top = counts.where(F.col("n") >= (least or LEAST)).orderBy(F.desc("n"), "word").limit(MOST).toArrow()
    return top.column("word").to_numpy().view(np.uint64)


def shares(counts: DataFrame, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """Of the rare words: log count of each cell, fingerprints and log counts of those held, (word, log_n) of the others."""
    spark = counts.sparkSession
    frequent = spark.createDataFrame([(int(w),) for w in known.view(np.int64)], "word long")
    rare = counts.join(F.broadcast(frequent), "word", "left_anti")  # MOST rows at most
    cells = np.ones(RARE)
    for r in rare.groupBy(F.expr(f"word & {RARE - 1}").alias("cell")).agg(F.sum("n").alias("n")).collect():
        cells[r["cell"]] = r["n"]
    least, total = 1 << 16, 0
    for n, words in sorted(rare.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect(), reverse=True):
        total += words
        if total > HELD:
            least = n + 1
            break
        least = n
    own = rare.where(F.least("n", F.lit(1 << 16)) >= least).toArrow()  # at most HELD
    held = own.column("word").to_numpy().view(np.uint64)
    order = np.argsort(held)
    others = rare.where(F.least("n", F.lit(1 << 16)) < least)
    return np.log(cells), held[order], np.log(own.column("n").to_numpy().astype(float))[order], others.where("n > 1").select("word", F.log("n").alias("log_n"))


def numbered(docs: DataFrame, counts: DataFrame, known: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Every document as word numbers: (row, doc_id, n_tokens, numbers, shares, rare), and the log counts of words not held.

    ``numbers`` are 16-bit numbers, ``shares`` the summed log shares of the rare words whose counts are held, less the
    cells' of the others, and ``rare`` the fingerprints of these.
    """
    cells, held, logs, others = shares(counts, known)
    sent = docs.sparkSession.sparkContext.broadcast((known, cells, held, logs))  # the network's and HELD words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cells, held, logs = sent.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for first, last, numbers, bounds, words in words_of(batch.column("text"), known):
                rare = np.flatnonzero(numbers >= len(known))
                value = np.zeros(len(numbers))
                value[rare] = -cells[numbers[rare] - len(known)]
                if len(held):
                    at = np.minimum(np.searchsorted(held, words[rare]), len(held) - 1)
                    found = held[at] == words[rare]
                    value[rare[found]] += logs[at[found]]
                    rare = rare[~found]
                run = np.concatenate([[0.0], np.cumsum(value)])
                lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(rare, bounds)), pa.array(words[rare].view(np.int64))).cast(pa.list_(pa.int64()))
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(np.ascontiguousarray(2 * bounds, dtype=np.int64)), pa.py_buffer(numbers.astype("<u2"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + last - first)), batch.column("doc_id").slice(first, last - first), pa.array(np.diff(bounds), pa.int64()), raw, pa.array(run[bounds[1:]] - run[bounds[:-1]]), lists],
                    ["row", "doc_id", "n_tokens", "numbers", "shares", "rare"],
                )
                row += last - first

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "row long, doc_id long, n_tokens long, numbers binary, shares double, rare array<long>")
    return Work(docs.sparkSession, "numbers").cut(rows, "numbers"), others


def _numbers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of a batch and where each document's begin."""
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(what, dtype="<u2") if what is not None and what.size else np.zeros(0, "<u2")
    return data[offsets[0] // 2 : offsets[-1] // 2].astype(np.int64), (offsets - offsets[0]) // 2


def train(numbers: DataFrame, known: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights averaged over the tasks, ``rounds`` times; a document's every ``rounds``-th position is a target in a round."""
    spark, network = numbers.sparkSession, Network(len(known))
    flat = network.start()
    work = Work(spark, "language-model")
    blocks = -(-network.size // BLOCK)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(flat)  # one set of weights

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            own, kept = Trainer(network, sent.value), []
            for batch in batches:
                words, bounds = _numbers_of(batch.column("numbers"))
                first = np.repeat(bounds[:-1] - batch.column("row").to_numpy(), np.diff(bounds))
                at = np.flatnonzero((np.arange(len(words)) - first) % rounds == turn)
                for lo in range(0, len(at), BATCH):
                    some = at[lo : lo + BATCH]
                    kept.append((_contexts(words, bounds, some, network.words), words[some]))
                    if sum(len(t) for _, t in kept) >= BATCH:
                        own.learn(*(np.concatenate(x) for x in zip(*kept, strict=True)))
                        kept = []
            if kept:
                own.learn(*(np.concatenate(x) for x in zip(*kept, strict=True)))
            if own.seen:
                part = TaskContext.get().partitionId()
                scaled = np.pad(own.flat * np.float32(own.seen), (0, blocks * BLOCK - network.size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(blocks, dtype=np.int32)), pa.array(np.full(blocks, part, dtype=np.int32)), pa.array(np.full(blocks, own.seen)), pa.array([x.tobytes() for x in scaled.reshape(blocks, BLOCK)], pa.binary())],
                    ["block", "part", "seen", "sums"],
                )

        schema = "block int, part int, seen long, sums binary"
        parts = work.cut(numbers.select("row", "numbers").mapInArrow(learn, schema), "weights")
        most = parts.agg(F.max("part")).first()[0]
        while most:  # level after level, FAN rows of a block at a time
            parts = parts.withColumn("part", F.expr(f"part div {FAN}").cast("int")).groupBy("block", "part").applyInArrow(_added, schema)
            most //= FAN
        rows = sorted(parts.collect(), key=lambda r: r["block"])  # one set of weights
        if rows:
            flat = np.concatenate([np.frombuffer(bytes(r["sums"]), np.float32) / np.float32(r["seen"]) for r in rows])[: network.size]
    return flat


def _added(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.float32) for x in group.column("sums").to_pylist()], axis=0, dtype=np.float64).astype(np.float32)
    first = group.slice(0, 1)
    return pa.table({"block": first.column("block"), "part": first.column("part"), "seen": pa.array([sum(group.column("seen").to_pylist())]), "sums": pa.array([total.tobytes()], pa.binary())})


def score(numbers: DataFrame, others: DataFrame, known: np.ndarray, flat: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and mean_log_likelihood for every document of ``numbered``."""
    network = Network(len(known))
    sent = numbers.sparkSession.sparkContext.broadcast(flat)  # one set of weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = network.unpack(sent.value)
        for batch in batches:
            words, bounds = _numbers_of(batch.column("numbers"))
            value = np.empty(len(words) + 1)
            value[0] = 0
            for lo in range(0, len(words), 4 * BATCH):
                some = np.arange(lo, min(lo + 4 * BATCH, len(words)))
                value[some + 1] = log_probabilities(weights, _contexts(words, bounds, some, network.words), words[some])
            run = np.cumsum(value)
            total = run[bounds[1:]] - run[bounds[:-1]] + batch.column("shares").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_tokens")), pa.array(total), batch.column("rare")], ["row", "doc_id", "n_tokens", "cells", "rare"])

    scored = numbers.mapInArrow(work, "row long, doc_id long, n_tokens long, cells double, rare array<long>")
    scored = Work(numbers.sparkSession, "scores").cut(scored, "cells")
    extra = scored.select("row", F.explode("rare").alias("word")).join(others, "word").groupBy("row").agg(F.sum("log_n").alias("extra"))
    total = (F.col("cells") + F.coalesce("extra", F.lit(0.0))).alias("log_likelihood")
    return scored.drop("rare").join(extra, "row", "left").select("doc_id", "n_tokens", total).withColumn("mean_log_likelihood", F.try_divide("log_likelihood", "n_tokens"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    counts = word_counts(docs)
    known = vocabulary(counts)
    numbers, others = numbered(docs, counts, known)
    return score(numbers, others, known, train(numbers, known))
