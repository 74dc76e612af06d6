"""Long recordings, sample by sample: filters and sliding spectra over chunks that borrow their neighbours' edges.

A recording is rows (by, t, value) with whole t, one row a sample; ``by`` names the recording and channel.  Chunks of
``size`` samples are worked on apart, so a recording of any length is spread over the cluster.  What a sample needs
of its neighbours comes in one of two ways: a finite kernel reads a halo that the neighbouring chunks send along, and
a recursive filter carries its state, a few numbers a chunk, which are summed up in a tree of bounded groups.

Samples that are missing between a recording's first and last, and null ones, count as 0 and get a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.functions import filters
from epochal.sources.shared import written

SIZE = 1 << 14
"""Samples of a chunk, besides its halo."""
FAN = 256
"""Chunks whose states meet in one task."""

Work = Callable[[np.ndarray, int, int, int], dict[str, np.ndarray]]


def chunks(recording: DataFrame, by: list[str], size: int, before: int = 0, after: int = 0, t: str = "t", value: str = "value") -> DataFrame:
    """(k, chunk, lo, hi, at, x): each chunk's samples with those of the halo; k is the key, lo and hi the recording's ends."""
    rows = recording.select(F.struct(*by).alias("k"), F.col(t).cast("long").alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    ends = rows.groupBy("k").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    first, last = F.floor((F.col("t") - after) / size), F.floor((F.col("t") + before) / size)
    dealt = rows.select("k", "t", "v", F.explode(F.sequence(first, last)).alias("chunk") if before or after else first.alias("chunk"))
    own = dealt.groupBy("k", "chunk").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"))
    own = own.join(ends, "k").where((F.col("chunk") >= F.floor(F.col("lo") / size)) & (F.col("chunk") <= F.floor(F.col("hi") / size)))
    return own.select("k", "chunk", "lo", "hi", F.col("s.t").alias("at"), F.col("s.v").alias("x"))


def _reflected(x: np.ndarray, first: int, lo: int, hi: int) -> np.ndarray:
    """A window that begins at ``first``: what lies beyond the recording's ends is their odd reflection."""
    at, n = np.arange(first, first + len(x)), hi - lo + 1
    left, right = at < lo, at > hi
    source = np.where(left, lo + (lo - at) % n, np.where(right, lo + (n - 1 - (at - hi)) % n, at)) - first
    out = x[np.clip(source, 0, len(x) - 1)]
    if left.any():
        out[left] = 2 * x[lo - first] - out[left]
    if right.any():
        out[right] = 2 * x[hi - first] - out[right]
    return out


def over_windows(recording: DataFrame, by: list[str], size: int, before: int, after: int, work: Work, columns: str, t: str = "t", value: str = "value") -> DataFrame:
    """(by, columns): what ``work(window, place of its first sample, lo, hi)`` makes of each chunk's window."""
    kinds = {f.name: f.dataType.simpleString() for f in recording.schema}
    names = [c.split(" ")[0] for c in columns.split(", ")]
    table = chunks(recording, by, size, before, after, t, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, at, x = batch.column("at").offsets.to_numpy(), batch.column("at").values.to_numpy(), batch.column("x").values.to_numpy()
            chunk, lo, hi = (batch.column(c).to_numpy() for c in ("chunk", "lo", "hi"))
            for k in range(batch.num_rows):
                first = int(chunk[k]) * size - before
                window = np.zeros(size + before + after)
                window[at[begin[k] : begin[k + 1]] - first] = x[begin[k] : begin[k + 1]]
                found = work(window, first, int(lo[k]), int(hi[k]))
                n = len(found[names[0]])
                keys = batch.column("k").slice(k, 1).take(pa.array(np.zeros(n, np.int64)))
                yield pa.RecordBatch.from_arrays([*keys.flatten(), *(pa.array(found[c]) for c in names)], [*by, *names])

    return table.mapInArrow(run, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), columns]))


def convolved(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    n = 1 << int(np.ceil(np.log2(len(x) + len(kernel) - 1)))
    if np.iscomplexobj(kernel):
        return np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(kernel, n))[: len(x) + len(kernel) - 1]
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(kernel, n), n)[: len(x) + len(kernel) - 1]


def _own(values: np.ndarray, first: int, lo: int, hi: int) -> dict[str, np.ndarray]:
    at = np.arange(first, first + len(values))
    inside = (at >= lo) & (at <= hi)
    return {"t": at[inside], "value": values[inside]}


def fir(recording: DataFrame, taps: np.ndarray, by: list[str], size: int = SIZE, t: str = "t", value: str = "value") -> DataFrame:
    """(by, t, value): the causal filter, by overlap-save; before the first sample stand zeros."""
    reach = len(taps) - 1

    def work(x: np.ndarray, first: int, lo: int, hi: int) -> dict[str, np.ndarray]:
        return _own(convolved(x, taps)[reach : reach + size], first + reach, lo, hi)

    return over_windows(recording, by, size, reach, 0, work, "t long, value double", t, value)


def fir_zero_phase(recording: DataFrame, taps: np.ndarray, by: list[str], size: int = SIZE, t: str = "t", value: str = "value") -> DataFrame:
    """(by, t, value): the filter run forwards and backwards over a recording that its odd reflection continues at both ends.

    Both runs together are one kernel, the taps' autocorrelation, so neither has to wait for the other.
    """
    reach, kernel = len(taps) - 1, np.convolve(taps, taps[::-1])

    def work(x: np.ndarray, first: int, lo: int, hi: int) -> dict[str, np.ndarray]:
        return _own(convolved(_reflected(x, first, lo, hi), kernel)[2 * reach : 2 * reach + size], first + reach, lo, hi)

    return over_windows(recording, by, size, reach, reach, work, "t long, value double", t, value)


class Recursive:
    """A recursive filter over chunks of one size: its impulse response, what each number of its state adds, and a chunk's step of the state."""

    def __init__(self, b: np.ndarray, a: np.ndarray, size: int) -> None:
        order = max(len(a), len(b)) - 1
        self.b, self.a = (np.concatenate([x, np.zeros(order + 1 - len(x))]) / a[0] for x in (np.asarray(b, float), np.asarray(a, float)))
        self.order, self.size = order, size
        self.impulse = self._run(np.eye(1, size)[0], np.zeros(order))[0]
        runs = [self._run(np.zeros(size), unit) for unit in np.eye(order)]
        self.free, self.step = np.array([y for y, _ in runs]).reshape(order, size).T, np.array([z for _, z in runs]).reshape(order, order).T

    def _run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, state = np.zeros(len(x)), np.append(state, 0.0)
        for i, v in enumerate(x):
            y[i] = self.b[0] * v + state[0]
            state[:-1] = state[1:] + self.b[1:] * v - self.a[1:] * y[i]
        return y, state[:-1]

    def rested(self, x: np.ndarray) -> np.ndarray:
        """The output of a chunk that begins at rest."""
        return convolved(x, self.impulse)[: self.size]

    def end(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The state after a chunk, from its last inputs and outputs."""
        lag = np.arange(1, self.order + 1)
        return np.array([sum(self.b[k] * x[i - k] - self.a[k] * y[i - k] for k in lag[i:]) for i in range(self.order)])


def carried(states: DataFrame, step: np.ndarray, fan: int = FAN) -> DataFrame:
    """(k, chunk, s): the state before each chunk, of states(k, chunk, s) that chunks at rest end in; a chunk takes a state s to step s.

    Chunks meet by ``fan``; what a span of so many adds is carried over spans in the same way, so no group is larger.
    """
    d = len(step)
    kind = states.schema["k"].dataType.simpleString()
    schema = f"k {kind}, chunk long, s array<double>"

    def rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table.column("chunk").to_numpy(), np.array(table.column("s").to_pylist(), dtype=float).reshape(-1, d)

    def result(table: pa.Table, at: list[int], chunk: list[int], s: list[np.ndarray]) -> pa.Table:
        keys = table.column("k").combine_chunks().take(pa.array(at, pa.int64()))
        return pa.table([keys, pa.array(chunk, pa.int64()), pa.array([list(x) for x in s], pa.list_(pa.float64()))], names=["k", "chunk", "s"])

    def whole(table: pa.Table) -> pa.Table:
        chunk, s = rows(table)
        end = (chunk[0] // fan + 1) * fan - 1
        total = sum((np.linalg.matrix_power(step, int(end - c)) @ x for c, x in zip(chunk, s, strict=True)), np.zeros(d))
        return result(table, [0], [int(chunk[0] // fan)], [total])

    def through(table: pa.Table, state: np.ndarray, place: int) -> pa.Table:
        chunk, s = rows(table)
        order, out = np.argsort(chunk), []
        for i in order:
            state = np.linalg.matrix_power(step, int(chunk[i] - place)) @ state
            out.append(state)
            state, place = step @ state + s[i], int(chunk[i]) + 1
        return result(table, order.tolist(), chunk[order].tolist(), out)

    span = states.agg((F.max("chunk") - F.min("chunk") + 1).alias("n")).first()["n"] or 0
    if span <= fan:
        return states.groupBy("k").applyInArrow(lambda table: through(table, np.zeros(d), int(min(table.column("chunk").to_pylist()))), schema)
    spans = states.withColumn("span", F.floor(F.col("chunk") / fan))
    before = carried(written(spans.groupBy("k", "span").applyInArrow(whole, schema), "spans"), np.linalg.matrix_power(step, fan), fan)
    met = spans.join(before.select("k", F.col("chunk").alias("span"), F.col("s").alias("before")), ["k", "span"])

    def within(table: pa.Table) -> pa.Table:
        return through(table, np.array(table.column("before")[0].as_py()), table.column("span")[0].as_py() * fan)

    return met.groupBy("k", "span").applyInArrow(within, schema)


def iir(recording: DataFrame, b: np.ndarray, a: np.ndarray, by: list[str], size: int = SIZE, steady: bool = False, t: str = "t", value: str = "value", fan: int = FAN) -> DataFrame:
    """(by, t, value): the recursive filter from rest, or (``steady``) from the state that the first value for ever would have left.

    Chunks run from rest; the states they end in are carried along, and each chunk adds what the state before it still gives.
    """
    model = Recursive(b, a, size)
    kinds = {f.name: f.dataType.simpleString() for f in recording.schema}
    firsts = recording.groupBy(F.struct(*by).alias("k")).agg(F.coalesce(F.min_by(F.col(value).cast("double"), t), F.lit(0.0)).alias("level"))
    table = chunks(recording, by, size, 0, 0, t, value)
    table = written(table.join(firsts, "k") if steady else table.withColumn("level", F.lit(0.0)), "chunks")
    gain = model.b.sum() / model.a.sum() if steady else 0.0

    def windows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        begin, at, x = batch.column("at").offsets.to_numpy(), batch.column("at").values.to_numpy(), batch.column("x").values.to_numpy()
        chunk, lo, hi, level = (batch.column(c).to_numpy() for c in ("chunk", "lo", "hi", "level"))
        for k in range(batch.num_rows):
            place = np.arange(chunk[k] * size, chunk[k] * size + size)
            window = np.zeros(size)
            window[at[begin[k] : begin[k + 1]] - place[0]] = x[begin[k] : begin[k + 1]]
            inside = (place >= lo[k]) & (place <= hi[k])
            yield k, np.where(inside, window - level[k], 0.0), place, inside

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.end(x, model.rested(x)).tolist() for _, x, _, _ in windows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("chunk"), pa.array(found, pa.list_(pa.float64()))], ["k", "chunk", "s"])

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, level = batch.column("s").to_pylist(), batch.column("level").to_numpy()
            for k, x, place, inside in windows(batch):
                y = model.rested(x) + model.free @ np.array(states[k]) + gain * level[k]
                keys = batch.column("k").slice(k, 1).take(pa.array(np.zeros(int(inside.sum()), np.int64)))
                yield pa.RecordBatch.from_arrays([*keys.flatten(), pa.array(place[inside]), pa.array(y[inside])], [*by, "t", "value"])

    kind = table.schema["k"].dataType.simpleString()
    states = written(table.mapInArrow(ends, f"k {kind}, chunk long, s array<double>"), "states")
    met = table.join(carried(states, model.step, fan), ["k", "chunk"])
    return met.mapInArrow(outputs, ", ".join([*(f"`{b_}` {kinds[b_]}" for b_ in by), "t long, value double"]))


def iir_zero_phase(recording: DataFrame, b: np.ndarray, a: np.ndarray, by: list[str], size: int = SIZE, t: str = "t", value: str = "value") -> DataFrame:
    """(by, t, value): the recursive filter forwards, then backwards, each from the steady state of its first value.

    The recording is continued at both ends by three times the filter's order of odd reflection; recordings that are
    not longer than that are left out.
    """
    n = 3 * (max(len(a), len(b)) - 1)
    rows = recording.select(*by, F.col(t).cast("long").alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"), F.struct(*by).alias("k"))
    ends = rows.groupBy("k").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.min_by("value", "t").alias("x_lo"), F.max_by("value", "t").alias("x_hi")).where(F.col("hi") - F.col("lo") >= n)
    known = rows.join(ends, "k")
    beyond = lambda end, level: known.where((F.abs(F.col("t") - F.col(end)) <= n) & (F.col("t") != F.col(end))).select(*by, (2 * F.col(end) - F.col("t")).alias("t"), (2 * F.col(level) - F.col("value")).alias("value"))
    longer = known.select(*by, "t", "value").unionByName(beyond("lo", "x_lo")).unionByName(beyond("hi", "x_hi"))
    back = lambda df: df.withColumn("t", -F.col("t"))
    done = back(iir(back(iir(longer, b, a, by, size, steady=True)), b, a, by, size, steady=True)).withColumn("k", F.struct(*by))
    return done.join(ends.select("k", "lo", "hi"), "k").where("t between lo and hi").select(*by, "t", "value")


def cycles_near(frequency: float, seconds: float) -> int:
    """Whole cycles, 1 to 100, whose duration is nearest to ``seconds`` (of two the fewer)."""
    return min(range(1, 101), key=lambda c: (abs(c / frequency - seconds), c))


def tapers(frequencies: list[float], rate: float, multitaper: bool, seconds: float = 0.5, cycles: float = 15.0, smoothing: float = 0.1) -> dict[float, np.ndarray]:
    """Per frequency the tapers as rows of unit norm: one Hann window of about ``seconds``, or Slepian ones over a number of cycles."""
    out = {}
    for f in frequencies:
        n = int(np.floor((cycles / f if multitaper else cycles_near(f, seconds) / f) * rate + 0.5))
        if multitaper:
            bandwidth = n * smoothing * f / rate
            out[f] = filters.slepian(n, bandwidth, max(1, int(np.floor(2 * bandwidth)) - 1))
        else:
            own = filters.hann(n)
            out[f] = (own / np.linalg.norm(own))[None, :]
    return out


def sliding_power(recording: DataFrame, by: list[str], rate: float, windows: dict[float, np.ndarray], step: int, size: int = SIZE, t: str = "t", value: str = "value") -> DataFrame:
    """(by, freq, t, power) at every ``step``-th place (t a multiple of it) where the frequency's window fits.

    A frequency's tapers are convolved with each chunk and its halo; the power is the mean over tapers of the squared
    magnitude, times 2 over the window's length.
    """
    reach = max(w.shape[1] for w in windows.values())

    def work(x: np.ndarray, first: int, lo: int, hi: int) -> dict[str, np.ndarray]:
        freq, at, power = [], [], []
        for f, own in windows.items():
            n = own.shape[1]
            place = np.arange(-(-(first + reach) // step) * step, first + reach + size, step)
            place = place[(place - lo + 1 >= n / 2) & (place - lo + 1 < hi - lo + 1 - n / 2)]
            turn = np.exp(-2j * np.pi * f / rate * (np.arange(n) - (n - 1) / 2))
            begin = place - first - (n + 1) // 2 + 1
            found = [np.abs(convolved(x, (taper * turn)[::-1])[begin + n - 1]) ** 2 for taper in own]
            freq.append(np.full(len(place), f))
            at.append(place)
            power.append(np.mean(found, axis=0) * 2 / n)
        return {"freq": np.concatenate(freq), "t": np.concatenate(at), "power": np.concatenate(power)}

    return over_windows(recording, by, size, reach, reach, work, "freq double, t long, power double", t, value)
