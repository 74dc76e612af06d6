"""Distributions and small statistics in numpy (no scipy), with pandas UDFs over them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
    h = d.copy()
    for m in range(1, 300):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * h))
    return np.where(swap, 1 - out, out)


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function (series, or continued fraction beyond a + 1)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    safe = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(safe) - safe - _lgamma(a))
    term = 1 / a
    total = term.copy()
    for n in range(1, 1000):
        term = term * safe / (a + n)
        total = total + term
        if np.all(np.abs(term) < 1e-16 * np.abs(total)):
            break
    b = safe + 1 - a
    c, d = np.full_like(safe, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for i in range(1, 1000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
    return np.where(x <= 0, 0.0, np.where(x < a + 1, front * total, 1 - front * h))


def t_cdf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return np.where(t > 0, 1 - tail, tail)


def t_p(t: np.ndarray, df: np.ndarray, tail: str = "both") -> np.ndarray:
    if tail == "both":
        t, df = np.asarray(t, float), np.asarray(df, float)
        return beta_cdf(df / (df + t * t), df / 2, 0.5)
    return 1 - t_cdf(t, df) if tail == "right" else t_cdf(t, df)


def f_cdf(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f = np.asarray(f, float)
    return beta_cdf(d1 * f / (d1 * f + d2), np.asarray(d1) / 2, np.asarray(d2) / 2)


def chi2_cdf(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gamma_cdf(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


_erf = np.vectorize(math.erf, otypes=[float])


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """By bisection and Newton steps on the distribution function; -inf and inf at 0 and 1."""
    p = np.asarray(p, float)
    lo, hi = np.full_like(p, -40.0), np.full_like(p, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = normal_cdf(mid) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    out = (lo + hi) / 2
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, out))


def ranks(x: np.ndarray) -> np.ndarray:
    """Tied ranks."""
    x = np.asarray(x, float)
    _, which, n = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(n)
    return (last - (n - 1) / 2)[which]


def rank_auc(label: np.ndarray, score: np.ndarray) -> float:
    y = np.asarray(label) == 1
    p, n = int(y.sum()), int((~y).sum())
    return float((ranks(score)[y].sum() - p * (p + 1) / 2) / (p * n)) if p and n else float("nan")


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_p(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(1 - f_cdf(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(1 - chi2_cdf(x.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def z_of(p: pd.Series) -> pd.Series:
    return pd.Series(normal_quantile(p.to_numpy(float)))


@F.pandas_udf(DoubleType())
def normal_lower(x: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf(x.to_numpy(float)))


@F.pandas_udf(DoubleType())
def binomial_lower(k: pd.Series, n: pd.Series) -> pd.Series:
    """Chance of at most k of n, each with a chance of one half."""
    k, n = k.to_numpy(float), n.to_numpy(float)
    inside = (k >= 0) & (k < n)
    out = beta_cdf(np.full(len(k), 0.5), np.where(inside, n - k, 1.0), np.where(inside, k + 1, 1.0))
    return pd.Series(np.where(k < 0, 0.0, np.where(k >= n, 1.0, out)))


def _one_tailed(tail: str):
    @F.pandas_udf(DoubleType())
    def p_of(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(t_p(t.to_numpy(float), df.to_numpy(float), tail))

    return p_of


t_upper, t_lower = _one_tailed("right"), _one_tailed("left")


def t_p_of(tail: str):
    """The UDF of (t, df) for ``both`` tails, the ``right`` or the ``left`` one."""
    return {"both": t_two_sided, "right": t_upper, "left": t_lower}[tail]


REGISTRY = {"normal_lower": normal_lower, "binomial_lower": binomial_lower, "t_two_sided": t_two_sided, "t_upper": t_upper, "t_lower": t_lower, "f_upper": f_upper, "chi2_upper": chi2_upper, "z_of": z_of}
"""The library's scalar UDFs by name."""


def register(spark) -> None:
    """Makes the UDFs known to ``spark.sql``."""
    for name, udf in REGISTRY.items():
        spark.udf.register(name, udf)
