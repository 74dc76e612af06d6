"""Filter kernels and tapers, as small arrays that a query computes once."""

from __future__ import annotations

import numpy as np


def hamming(n: int) -> np.ndarray:
    """n + 1 values of the symmetric Hamming window."""
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n + 1) / n) if n else np.ones(1)


def kaiser(low: float, high: float, attenuation: float, force_odd: bool = False) -> np.ndarray:
    """The Kaiser window for a transition band (in shares of the Nyquist frequency) and an attenuation in decibels."""
    beta = 0.1102 * (attenuation - 8.7) if attenuation > 50 else 0.5842 * max(0.0, attenuation - 21) ** 0.4 + 0.07886 * max(0.0, attenuation - 21)
    n = int(np.round((attenuation - 7.95) / (2 * np.pi * 2.285 * (high - low)))) + 1
    return np.kaiser(n + (force_odd and n % 2 == 0), beta)


def monotone_cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic interpolation whose slopes never overshoot the data (weighted harmonic means of the neighbouring secants)."""
    h, secant = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return y[0] + secant[0] * (at - x[0])
    slope = np.zeros(len(x))
    same = secant[:-1] * secant[1:] > 0
    left, right = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    slope[1:-1][same] = ((left + right)[same]) / (left[same] / secant[:-1][same] + right[same] / secant[1:][same])
    for end, (h0, h1, d0, d1) in {0: (h[0], h[1], secant[0], secant[1]), -1: (h[-1], h[-2], secant[-1], secant[-2])}.items():
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        slope[end] = 0.0 if s * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(h) - 1)
    u = (at - x[k]) / h[k]
    return y[k] * (1 + 2 * u) * (1 - u) ** 2 + y[k + 1] * u * u * (3 - 2 * u) + h[k] * u * (1 - u) * (slope[k] * (1 - u) - slope[k + 1] * u)


def fir(order: int, frequencies: list[float], amplitudes: list[float], bins: int | None = None, window: np.ndarray | None = None) -> np.ndarray:
    """Taps of a linear-phase filter by frequency sampling; frequencies run from 0 to 1 (Nyquist)."""
    bins = bins or max(512, 1 << int(np.ceil(np.log2(order))))
    grid = np.arange(bins + 1)
    wanted = monotone_cubic(np.round(np.array(frequencies) * bins), np.array(amplitudes, dtype=float), grid)
    spectrum = wanted * np.exp(-0.5j * order * np.pi * grid / bins)
    kernel = np.fft.ifft(np.concatenate([spectrum, np.conj(spectrum[-2:0:-1])])).real
    return kernel[: order + 1] * (hamming(order) if window is None else window)


def butterworth(order: int, low: float | None = None, high: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a Butterworth filter between two edges (shares of the Nyquist frequency); without one edge, low- or high-pass."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 2 * np.tan(np.pi * f / 2)  # noqa: E731  (bilinear transform at a sampling rate of 1)
    if low is not None and high is not None:
        width, centre = warp(high) - warp(low), np.sqrt(warp(high) * warp(low))
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2)
        poles, zeros, middle = np.concatenate([half + root, half - root]), np.zeros(order), 2 * np.arctan(centre / 2)
    elif high is not None:
        poles, zeros, middle = poles * warp(high), np.zeros(0), 0.0
    else:
        poles, zeros, middle = warp(low) / poles, np.zeros(order), np.pi
    z, p = (2 + zeros) / (2 - zeros), (2 + poles) / (2 - poles)
    b, a = np.poly(np.concatenate([z, -np.ones(len(p) - len(z))])).real, np.poly(p).real
    at = np.exp(-1j * middle * np.arange(len(a)))
    return b * abs((a * at).sum() / (b * at).sum()), a


def hann(n: int) -> np.ndarray:
    """The Hann window without its zero ends."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1, n + 1) / (n + 1))


def slepian(n: int, bandwidth: float, count: int) -> np.ndarray:
    """The ``count`` orthonormal sequences of length n best concentrated within ``bandwidth`` (time-bandwidth product), as rows."""
    k = np.arange(n)
    middle = ((n - 1 - 2 * k) / 2) ** 2 * np.cos(2 * np.pi * bandwidth / n)
    beside = k[1:] * (n - k[1:]) / 2
    _, vectors = np.linalg.eigh(np.diag(middle) + np.diag(beside, 1) + np.diag(beside, -1))
    return vectors[:, ::-1][:, :count].T
