"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel of two words sums, over their common subsequences of ORDER characters, DECAY to the power of
the spans, for spans of at most SPAN: inserted or left-out characters lower a match, they don't end it.
Punctuation inside a word only widens the gap it stands in.  Landmarks are words of the training part;
K(word, landmarks) times the inverse root of K(landmarks, landmarks) gives a word's features, and a
support vector machine (squared hinge, Newton steps) separates words that only toxic documents hold from
words of clean ones.  As both steps are linear in the kernel, and the kernel is linear in a word's
subsequences, the trained machine is one table: subsequence -> weight, of fixed size.  A document's score
is its highest word's, put on 0..1 by a logistic fitted on training documents.

Training reads at most SAMPLE toxic and 3 * SAMPLE clean labelled rows (a documented bound: those with
the smallest hashes of doc_id).  Words of all these rows are counted on the executors; the machine is fitted
on the POSITIVE heaviest of toxic rows and on about NEGATIVE of clean ones, in one task.

Defined results: a null, empty or wordless text gets the score of a document without toxic words; rows
with a null doc_id are scored too (held_out false); labels of null, of other values than 0 and 1, that
contradict each other, or of absent documents are not learned from; of rows with one doc_id one is; with no
label of one class every score is the share of label 1.  Repeated rows are each scored; an empty table gives
an empty table.  Words beyond WIDTH bytes are read in overlapping windows, so a text's length has no bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.llm import textops as X
from epochal.llm.work import Work

ORDER, SPAN, DECAY = 4, 6, 0.6
WIDTH, OVERLAP = 28, 12
SAMPLE, POSITIVE, NEGATIVE, LANDMARKS = 4000, 2000, 16000, 400
THRESHOLD = 0.3

_GAPS = [g for last in range(ORDER - 1, SPAN + 1) for g in (c + (last,) for c in combinations(range(1, last), ORDER - 2))]
_EDGE = 31
_CODE = np.zeros(256, dtype=np.int32)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
for _digit, _letter in zip(b"013457@", b"oieasta", strict=True):  # digits that stand for letters
    _CODE[_digit] = _letter - 96
_CODE[0xC2:0xF5] = 27
_CODE[0x80:0xC0] = 28 + np.arange(64) % 3
for _last, _letter in zip(range(0xA0, 0xC0), b"aaaaaaaceeeeiiiidnooooo/ouuuuyty", strict=True):  # U+00E0.. as their base letters
    if _letter > 96:
        _CODE[_last] = _CODE[_last - 32] = _letter - 96
_CELLS = 32**ORDER


def _grid(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of spans (rows, WIDTH + 1 columns, an edge mark first), and the span each row is of."""
    step = WIDTH - OVERLAP
    rows = np.maximum(1, -(-(ends - starts - OVERLAP) // step))
    owner = np.repeat(np.arange(len(starts)), rows)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    at = starts[owner] + part * step
    columns = at[:, None] + np.arange(WIDTH)
    inside = columns < ends[owner][:, None]
    codes = np.zeros((len(owner), WIDTH + 1 + SPAN), dtype=np.int32)
    codes[:, 1 : WIDTH + 1] = np.where(inside, _CODE[data[np.minimum(columns, len(data) - 1)]], 0)
    codes[:, 0] = np.where(part == 0, _EDGE, 0)
    return codes, owner


def _cells(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each gap pattern the subsequence at every place (0 where there is none) and its weight."""
    width = codes.shape[1] - SPAN
    for gap in _GAPS:
        cell, real = codes[:, :width].copy(), codes[:, :width] > 0
        for d in gap:
            own = codes[:, d : d + width]
            cell *= 32
            cell += own
            real &= own > 0
        cell[~real] = 0
        yield cell, DECAY ** gap[-1]


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The machine's value for every span (the highest of a long span's windows)."""
    out = np.full(len(starts), -np.inf, dtype=np.float32)
    order = np.argsort(ends - starts, kind="stable")
    for lo in range(0, len(order), 8192):  # spans of like length together, without their empty columns
        own = order[lo : lo + 8192]
        codes, owner = _grid(data, starts[own], ends[own])
        used = int(min(WIDTH, (ends[own] - starts[own]).max())) + 1
        codes = codes[:, : used + SPAN]
        total, size = np.zeros(len(codes), dtype=np.float32), np.full(len(codes), 1e-9, dtype=np.float32)
        for cell, weight in _cells(codes):
            total += weight * table[cell].sum(axis=1)
            size += weight**2 * (cell > 0).sum(axis=1)
        best = np.full(len(own), -np.inf, dtype=np.float32)
        np.maximum.at(best, owner, total / np.sqrt(size))
        out[own] = best
    return out


@dataclass(frozen=True)
class Model:
    table: np.ndarray
    slope: float
    shift: float
    base: float

    def probability(self, highest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * highest + self.shift, -30, 30)))


def _bytes_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return np.frombuffer(b"".join(words), dtype=np.uint8), ends - [len(w) for w in words], ends


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse subsequence features: word, cell, value."""
    codes, owner = _grid(*_bytes_of(words))
    found = [(np.repeat(owner, cell.shape[1])[cell.ravel() > 0], cell.ravel()[cell.ravel() > 0], weight) for cell, weight in _cells(codes)]
    word, cell = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    value = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
    value /= np.sqrt(np.bincount(word, weights=value**2, minlength=len(words)))[word]
    key, at = np.unique(word.astype(np.int64) * _CELLS + cell, return_inverse=True)
    return key // _CELLS, key % _CELLS, np.bincount(at, weights=value)


def fit_table(words: list[bytes], label: np.ndarray, weight: np.ndarray, landmarks: int = LANDMARKS, c: float = 1000.0) -> np.ndarray:
    """The machine trained on words (label 1 or -1), as weights of subsequences."""
    random = np.random.default_rng(11)
    positive, negative = np.flatnonzero(label > 0), np.flatnonzero(label < 0)
    # half of the landmarks from either class, the heaviest positive words first
    chosen = np.concatenate([positive[np.argsort(-weight[positive], kind="stable")][: landmarks // 2], random.permutation(negative)[: landmarks - min(len(positive), landmarks // 2)]])
    place, cell, value = _features([words[i] for i in chosen])
    cells = np.unique(cell)
    marks = np.zeros((len(cells), len(chosen)), dtype=np.float32)
    np.add.at(marks, (np.searchsorted(cells, cell), place), value)
    kernel = np.zeros((len(words), len(chosen)), dtype=np.float32)
    for lo in range(0, len(words), 200):  # memory for a few words' features only
        word, cell, value = _features(words[lo : lo + 200])
        at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
        shared = cells[at] == cell
        part = np.zeros((min(200, len(words) - lo), len(cells)), dtype=np.float32)
        part[word[shared], at[shared]] = value[shared]
        kernel[lo : lo + 200] = part @ marks
    values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.hstack([kernel @ root.astype(np.float32), np.ones((len(words), 1), dtype=np.float32)])
    share = np.where(label > 0, 0.5 * weight / weight[positive].sum(), 0.5 * weight / weight[negative].sum()) * c  # a well supported word counts for more
    u = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps of the squared hinge loss
        active = np.flatnonzero(1 - label * (z @ u) > 0)
        normal, aim = np.eye(len(u)), np.zeros(len(u))
        for lo in range(0, len(active), 2000):
            own = z[active[lo : lo + 2000]].astype(np.float64)
            weighted = own * share[active[lo : lo + 2000], None]
            normal += weighted.T @ own
            aim += weighted.T @ label[active[lo : lo + 2000]]
        step = np.linalg.solve(normal, aim) - u
        u += step
        if np.abs(step).max() < 1e-6:
            break
    table = np.zeros(_CELLS, dtype=np.float32)
    table[cells] = marks @ (root @ u[:-1])
    table[0] = 0
    return table


def _distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a piece (start, end), and for every word of the piece which of them it is; bounds by text."""
    data = X.lower_ascii(data)
    starts, ends, bounds = X.word_spans(data, offsets)
    _, first, which = np.unique(X.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return starts[first], ends[first], which, bounds


def highest_words(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Each text's highest word score; 0 at least, so that texts without words have a value too."""
    out = np.zeros(len(texts), dtype=np.float64)
    for first, _, data, offsets in X.pieces(texts):
        starts, ends, which, bounds = _distinct_words(data, offsets)
        if len(starts):
            value = np.append(np.maximum(word_scores(data, starts, ends, table), 0)[which], 0)
            full = np.flatnonzero(np.diff(bounds))
            out[first + full] = np.maximum.reduceat(value[:-1], bounds[:-1][full])
    return out


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _fitted(words: list[bytes], positive: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The table of a machine whose positive words it holds for positive itself."""
    for _ in range(2):  # words that are in toxic documents by chance have nothing in common: they drop out
        table = fit_table(words, np.where(positive, 1.0, -1.0), heavy)
        bad = np.flatnonzero(positive)
        right = word_scores(*_bytes_of([words[i] for i in bad]), table) > 0
        if right.all() or not right.any():
            break
        keep = np.ones(len(words), dtype=bool)
        keep[bad[~right]] = False
        words, positive, heavy = [w for w, k in zip(words, keep, strict=True) if k], positive[keep], heavy[keep]
    return table


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model on the labelled rows that aren't held out."""
    work = Work(docs.sparkSession, "toxicity")
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    usable = usable.agg(F.min("toxic").cast("int").alias("y"), F.max("toxic").cast("int").alias("most")).where("y = most").drop("most")
    part = lambda y, n: usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(n)
    chosen = part(1, sample).unionByName(part(0, 3 * sample))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")  # at most 4 * sample ids
    # of rows with one doc_id one is learned from, so the bound holds for rows too
    texts = texts.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("row")).select("y", "row.text")
    texts = work.cut(texts, "labelled")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for first, last, data, offsets in X.pieces(batch.column("text")):
                data = X.lower_ascii(data)
                starts, ends, bounds = X.word_spans(data, offsets)
                word = X.span_hashes(data, starts, ends)
                text = np.repeat(np.arange(last - first), np.diff(bounds))
                prior = np.where(np.arange(len(word)) > bounds[:-1][text], np.roll(word, 1), np.uint64(0))
                # a word counts once for each word before it: copies of a text add nothing
                place, at = np.unique(X.mix(X.mix(word) + prior) ^ X.mix(y[first:last][text].astype(np.uint64) + np.uint64(1)), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(word[at].view(np.int64)), pa.array(place.view(np.int64)), pa.array(y[first:last][text[at]])], ["word", "place", "y"])

    counts = texts.mapInArrow(places, "word long, place long, y int").groupBy("word", "place", "y").agg(F.lit(1).alias("one")).groupBy("word").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    counts = work.cut(counts, "counts")
    share = texts.agg(F.avg("y")).first()[0] or 0.0
    support = int(np.ceil(np.log(5e-5) / np.log(min(0.5, max(share, 0.01)))))  # places that by chance are all in toxic rows for 1 word in 20,000
    weight = (F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) * F.sqrt("toxic")).alias("weight")
    positive = counts.where(f"toxic >= {support} and toxic > 8 * clean").select("word", F.lit(True).alias("positive"), weight).orderBy(F.desc("weight"), "word").limit(POSITIVE)
    clean = counts.where("clean > 0 and toxic <= 2 * clean")
    least, n = _least_count(clean, NEGATIVE // 4)
    rest = clean.where(F.col("clean") < least)
    rate = (NEGATIVE - n) / max(1, rest.count())  # of the rarer ones a share by hash, about as many as are wanted
    negative = clean.where(F.col("clean") >= least).unionByName(rest.where(F.pmod(F.xxhash64("word", F.lit(5)), F.lit(1 << 30)) < rate * (1 << 30)))
    chosen = positive.unionByName(negative.select("word", F.lit(False).alias("positive"), F.sqrt("clean").alias("weight"))).toArrow()  # about POSITIVE + NEGATIVE fingerprints
    fingerprints = np.sort(chosen.column("word").to_numpy().view(np.uint64))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in X.pieces(batch.column("text")):
                data = X.lower_ascii(data)
                starts, ends, _ = X.word_spans(data, offsets)
                word, at = np.unique(X.span_hashes(data, starts, ends), return_index=True)
                hit = np.isin(word, fingerprints, assume_unique=True)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(word[hit].view(np.int64)), pa.array([raw[starts[i] : ends[i]] for i in at[hit]], pa.binary())], ["word", "spelling"])

    spellings = texts.select("text").mapInArrow(spelled, "word long, spelling binary").groupBy("word").agg(F.min("spelling").alias("spelling"))
    known = docs.sparkSession.createDataFrame(chosen) if chosen.num_rows else positive
    chosen_words = spellings.join(F.broadcast(known), "word").select(F.col("spelling").alias("word"), "positive", "weight")
    table = np.zeros(_CELLS, dtype=np.float32)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("positive", "descending"), ("word", "ascending")])
        own = rows.column("positive").to_numpy()
        if own.any() and not own.all():
            found = _fitted(rows.column("word").to_pylist(), own, rows.column("weight").to_numpy())
            cells = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(found[cells])], ["cell", "weight"])

    # about POSITIVE + NEGATIVE words: one task fits the machine, and the landmarks' subsequences come back
    fitted = chosen_words.coalesce(1).mapInArrow(fit, "cell long, weight float").toArrow()
    if not fitted.num_rows:
        return Model(table, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))), share)
    table[fitted.column("cell").to_numpy()] = fitted.column("weight").to_numpy()
    work.drop_table(counts)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(highest_words(batch.column("text"), sent.value)), batch.column("y")], ["x", "y"])

    seen = texts.select("text", "y").mapInArrow(highest, "x double, y int").toArrow()  # a row for each row learned from
    sent.destroy()
    # the classes as often as among all labels that may be learned from, not as in the sample
    total = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    x, y = seen.column("x").to_numpy(), seen.column("y").to_numpy().astype(float)
    weight = np.where(y == 1, total.get(1, 1) / max(1, (y == 1).sum()), total.get(0, 1) / max(1, (y == 0).sum()))
    slope, shift = _logistic(x, y, weight / weight.mean())
    work.drop()  # the model is all that is left
    return Model(table, slope, shift, float(share))


def _least_count(clean: DataFrame, most: int) -> tuple[int, int]:
    """The smallest count such that at most so many words have it or more (counts beyond 2**16 as one), and how many have."""
    least, n = (1 << 16) + 1, 0
    for count, words in sorted(clean.groupBy(F.least("clean", F.lit(1 << 16)).alias("k")).count().collect(), reverse=True):  # at most 2**16 rows
        if n + words > most:
            break
        least, n = count, n + words
    return least, n


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a = np.column_stack([x, np.ones(len(x))])
    u = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ u, -30, 30)))
        grad = a.T @ (weight * (y - p)) - 1e-2 * u
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        u += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return float(u[0]), float(u[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    sent = docs.sparkSession.sparkContext.broadcast((model.table, model.slope, model.shift))  # 4 MB, whatever the input

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, slope, shift = sent.value
        for batch in batches:
            p = Model(table, slope, shift, 0.0).probability(highest_words(batch.column("text"), table))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
