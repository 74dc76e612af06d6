"""Canonical correlation between recordings: cross-validated over lags, and over several blocks of channels at once.

All that is needed are sums of products.  Each fold's are summed once, per lag; a fold is left out by subtraction, and the
correlation of its components follows from its own sums, so the data are read once however many folds there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.operators.arrays import canonical, covariance

MOST_NUMBERS = 50_000_000
"""Most sums (folds x lags x channels squared) that come to the driver; more are an error."""


def fold_products(left: DataFrame, right: DataFrame, shifts: list[int]) -> dict[tuple[int, int], np.ndarray]:
    """The products of [x, y] summed by (fold, shift), of left(fold, t, x) and right(fold, t, y): x meets the y of ``shift`` samples later."""
    moved = left.select("fold", "x", "t", F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift")).withColumn("t", F.col("t") + F.col("shift"))
    met = moved.join(right.select("fold", "t", "y"), ["fold", "t"]).select(F.col("fold").cast("long"), F.col("shift").cast("long"), F.concat("x", "y").alias("z"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                z = batch.column("z").flatten().to_numpy().reshape(batch.num_rows, -1)
                keys, which = np.unique(np.stack([batch.column(c).to_numpy() for c in ("fold", "shift")]), axis=1, return_inverse=True)
                for k, key in enumerate(map(tuple, keys.T.tolist())):
                    own = z[which.ravel() == k]
                    sums[key] = sums.get(key, 0) + own.T @ own
        flat = [(f, s, m.ravel().tolist()) for (f, s), m in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], pa.int64()), pa.array([r[2] for r in flat], pa.list_(pa.float64()))], ["fold", "shift", "m"])

    parts = met.mapInArrow(work, "fold long, shift long, m array<double>").select("fold", "shift", F.posexplode("m").alias("i", "v")).groupBy("fold", "shift", "i").agg(F.sum("v").alias("v"))
    rows = parts.limit(MOST_NUMBERS + 1).toArrow()
    if rows.num_rows > MOST_NUMBERS:
        raise ValueError("too many folds, lags or channels for sums on the driver")
    fold, shift, i, v = (rows.column(c).to_numpy() for c in ("fold", "shift", "i", "v"))
    out = {}
    for key in sorted(set(zip(fold.tolist(), shift.tolist(), strict=True))):
        own = (fold == key[0]) & (shift == key[1])
        n = int(round(np.sqrt(own.sum())))
        m = np.zeros(n * n)
        m[i[own]] = v[own]
        out[key] = m.reshape(n, n)
    return out


def _correlations(m: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    xx, xy, yy = m[:n, :n], m[:n, n:], m[n:, n:]
    along = lambda c: np.einsum("ik,ij,jk->k", a, c, a)
    return np.einsum("ik,ij,jk->k", a, xy, b) / np.sqrt(along(xx) * np.einsum("ik,ij,jk->k", b, yy, b))


def cross_validated(left: DataFrame, right: DataFrame, shifts: list[int], channels: int, surrogate: bool = False) -> DataFrame:
    """(fold, shift, component, r[, r_surrogate]): correlations of each left-out fold under the components of the others.

    ``channels`` is the number of x; a surrogate takes the y of the next fold, which tells what chance gives.
    """
    spark = left.sparkSession
    sums = fold_products(left, right, shifts)
    folds = sorted({f for f, _ in sums})
    other = {}
    if surrogate:
        following = spark.createDataFrame([(folds[(k + 1) % len(folds)], f) for k, f in enumerate(folds)], "fold long, to long")
        other = fold_products(left, right.join(F.broadcast(following), "fold").select(F.col("to").alias("fold"), "t", "y"), shifts)
    rows = []
    for s in shifts:
        total = sum(m for (_, shift), m in sums.items() if shift == s)
        for f in folds:
            if (f, s) in sums:
                a, b, _ = canonical(total - sums[f, s], channels)
                r = _correlations(sums[f, s], channels, a, b).tolist()
                chance = _correlations(other[f, s], channels, a, b).tolist() if (f, s) in other else [None] * len(r)
                rows += [(f, s, k + 1, v, c) for k, (v, c) in enumerate(zip(r, chance, strict=True))]
    out = spark.createDataFrame(rows, "fold long, shift long, component long, r double, r_surrogate double")
    return out if surrogate else out.drop("r_surrogate")


def multiway(vectors: DataFrame, block: int, x: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """(filters as columns, scores): blocks of ``block`` channels are whitened apart, then turned to what they share.

    A score is the summed power of a component over the whitened blocks: the number of blocks where all share it, 1 where none do.
    """
    cov, _ = covariance(vectors, x)
    white = np.zeros_like(cov)
    for k in range(0, len(cov), block):
        own = slice(k, k + block)
        values, turned = np.linalg.eigh(cov[own, own])
        white[own, own] = turned[:, ::-1] / np.sqrt(np.where(values[::-1] > 1e-12 * values[-1], values[::-1], np.inf))
    values, turned = np.linalg.eigh(white.T @ cov @ white)
    return white @ turned[:, ::-1], values[::-1]
