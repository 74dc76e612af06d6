"""Filters and sliding spectra over chunks against whole-recording loops, for chunk sizes that cut anywhere."""

import numpy as np
import pytest

from epochal.functions import filters
from epochal.operators import recordings


@pytest.fixture(scope="module")
def signals():
    random = np.random.default_rng(11)
    return {("a", 1): (0, random.normal(size=400).cumsum()), ("a", 2): (-37, random.normal(size=150)), (None, 3): (5, random.normal(size=23)), ("b", 4): (1000, np.array([2.5]))}


@pytest.fixture(scope="module")
def recording(spark, signals):
    rows = [(r, c, lo + i, float(v)) for (r, c), (lo, x) in signals.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "rec string, chan int, t long, value double").repartition(7)


def back(df, value="value"):
    out = {}
    for r in df.collect():
        out.setdefault((r.rec, r.chan), {})[r.t] = r[value]
    return out


def same(got, signals, expected):
    want = {k: expected(x) for k, (lo, x) in signals.items()}
    want = {k: v for k, v in want.items() if v is not None}
    assert set(got) == set(want)
    for k, y in want.items():
        lo = signals[k][0]
        assert sorted(got[k]) == list(range(lo, lo + len(y)))
        assert np.allclose([got[k][lo + i] for i in range(len(y))], y, atol=1e-9)


def loop(b, a, x, state=None):
    b, a = (np.concatenate([v, np.zeros(max(len(a), len(b)) - len(v))]) for v in (np.asarray(b, float), np.asarray(a, float)))
    z, y = np.zeros(len(a)) if state is None else np.append(state, 0.0), np.zeros(len(x))
    for i, v in enumerate(x):
        y[i] = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:] * v - a[1:] * y[i]
    return y


def continued(x, n):
    t = len(x)
    return np.concatenate([2 * x[0] - x[np.arange(n, 0, -1) % t], x, 2 * x[-1] - x[(t - 1 - np.arange(1, n + 1)) % t]])


@pytest.mark.parametrize(("size", "order"), [(16, 50), (64, 4), (4096, 50)])
def test_fir(recording, signals, size, order):
    taps = filters.fir(order, [0, 0.2, 0.3, 1], [1, 1, 0, 0])
    same(back(recordings.fir(recording, taps, ["rec", "chan"], size)), signals, lambda x: np.convolve(x, taps)[: len(x)])

    def both_ways(x):
        y = continued(x, len(taps))
        for _ in range(2):
            y = np.convolve(y, taps)[: len(y)][::-1]
        return y[len(taps) : -len(taps)]

    same(back(recordings.fir_zero_phase(recording, taps, ["rec", "chan"], size)), signals, both_ways)


@pytest.mark.parametrize(("size", "fan", "edges"), [(8, 3, (0.1, 0.3)), (50, 256, (None, 0.2)), (4096, 2, (0.4, None))])
def test_iir(recording, signals, size, fan, edges):
    b, a = filters.butterworth(3, *edges)
    same(back(recordings.iir(recording, b, a, ["rec", "chan"], size, fan=fan)), signals, lambda x: loop(b, a, x))
    same(back(recordings.iir(recording, b, a, ["rec", "chan"], size, steady=True, fan=fan)), signals, lambda x: loop(b, a, np.concatenate([np.full(2000, x[0]), x]))[2000:])


def test_iir_zero_phase(recording, signals):
    b, a = filters.butterworth(2, None, 0.25)
    n = 3 * (len(a) - 1)

    def both_ways(x):
        if len(x) <= n:
            return None
        y = continued(x, n)
        for _ in range(2):
            y = loop(b, a, np.concatenate([np.full(3000, y[0]), y]))[3000:][::-1]
        return y[n:-n]

    same(back(recordings.iir_zero_phase(recording, b, a, ["rec", "chan"], 32)), signals, both_ways)


@pytest.mark.parametrize("multitaper", [False, True])
def test_sliding_power(recording, signals, multitaper):
    rate, step = 100.0, 5
    windows = recordings.tapers([8.0, 12.0] if not multitaper else [35.0, 45.0], rate, multitaper)
    got = {(r.rec, r.chan, r.freq, r.t): r.power for r in recordings.sliding_power(recording, ["rec", "chan"], rate, windows, step, size=40).collect()}
    want = {}
    for (rec, chan), (lo, x) in signals.items():
        for f, own in windows.items():
            n = own.shape[1]
            for t in range(lo, lo + len(x)):
                place = t - lo + 1
                if t % step == 0 and n / 2 <= place < len(x) - n / 2:
                    cut = x[t - lo - (n + 1) // 2 + 1 :][:n]
                    wave = np.exp(-2j * np.pi * f / rate * (np.arange(n) - (n - 1) / 2))
                    want[rec, chan, f, t] = np.mean([abs((cut * taper * wave).sum()) ** 2 for taper in own]) * 2 / n
    assert set(got) == set(want) and len(want) > 50
    assert np.allclose([got[k] for k in want], list(want.values()))


def test_missing_and_null_samples_count_as_zero(spark):
    rows = [("a", 0, 1.0), ("a", 3, None), ("a", 9, 2.0)]
    got = recordings.fir(spark.createDataFrame(rows, "rec string, t long, value double"), np.array([1.0, 0.5]), ["rec"], 4).collect()
    assert sorted((r.t, round(r.value, 9) + 0.0) for r in got) == [(0, 1.0), (1, 0.5)] + [(k, 0.0) for k in range(2, 9)] + [(9, 2.0)]
    none = spark.createDataFrame([], "rec string, t long, value double")
    assert recordings.fir(none, np.ones(3), ["rec"]).count() == 0
    assert recordings.iir(none, np.ones(2), np.array([1.0, 0.5]), ["rec"]).count() == 0


def test_kernels():
    b, a = filters.butterworth(4, 0.2, 0.4)
    response = lambda f: abs(np.polyval(b[::-1], np.exp(-1j * np.pi * f)) / np.polyval(a[::-1], np.exp(-1j * np.pi * f)))
    assert len(b) == 9 and response(0.2) == pytest.approx(np.sqrt(0.5)) and response(0.4) == pytest.approx(np.sqrt(0.5)) and response(0.29) > 0.99 and response(0.05) < 1e-2
    low = filters.fir(60, [0, 0.3, 0.4, 1], [1, 1, 0, 0])
    gain = lambda f: abs(np.polyval(low[::-1], np.exp(-1j * np.pi * f)))
    assert len(low) == 61 and np.allclose(low, low[::-1]) and gain(0.1) == pytest.approx(1, abs=0.01) and gain(0.6) < 0.01
    own = filters.slepian(64, 3.0, 5)
    assert np.allclose(own @ own.T, np.eye(5))
    kept = lambda v: sum(abs(np.fft.fft(v, 4096)[[*range(0, 193), *range(-192, 0)]]) ** 2) / 4096
    assert kept(own[0]) > 0.9999 and kept(own[0]) > kept(own[4]) > 0.7
    at = np.linspace(0, 4, 41)
    smooth = filters.monotone_cubic(np.array([0, 1.0, 2, 4]), np.array([0, 1.0, 1, 0]), at)
    assert smooth.max() <= 1 + 1e-12 and smooth[10] == 1 and smooth[20] == 1 and abs(smooth[15] - 1) < 1e-12
    assert len(filters.kaiser(0.1, 0.2, 60, force_odd=True)) % 2 == 1
