"""Minimum-covariance determinant and least trimmed squares, by concentration steps over all rows.

Both keep the h rows of a group that fit best, refit, and repeat.  Good starts come from a bounded sample of each group
(SAMPLE rows, chosen by a hash of their values; smaller groups whole), where many small subsets are concentrated in one
task.  From there every step runs over all rows for all starts at once: rows are counted, and their products summed, by
ranges of the score (PARTS to a doubling), so only these sums travel; the rows of the one range that holds the h-th
smallest score are then ordered.  A step never raises the objective, so the steps end.  Rows that tie with the h-th are kept too.  Rows with a null take no part; groups with fewer rows than h
needs, or whose best rows lie in a plane, get no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.functions.dist import chi2_cdf, gamma_cdf, normal_quantile, t_cdf
from epochal.operators import ordered
from epochal.sources.shared import written

SAMPLE, STARTS, KEPT, STEPS = 600, 500, 4, 200
"""Rows of a group that starts are looked for in, small subsets tried there, starts kept, and most steps."""
FIRST, CLOSE = 1, 5e-4
"""Steps over all rows before the best start goes on alone, and the gain (in the log determinant, or as a share of the squares) at which they end; samples are concentrated to the end."""

PARTS = 64
"""Ranges of the score to a doubling: one holds about a hundredth of the rows."""


def least_h(n: int, p: int, share: float) -> int:
    """Rows to keep of n in p dimensions, between half of them (share 0.5) and all (1)."""
    half = (n + p + 1) // 2
    return int(np.floor(2 * half - n + 2 * (n - half) * share))


def _inverse(cdf, p: float) -> float:
    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    while lo < (mid := (lo + hi) / 2) < hi:
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def chi2_quantile(p: float, df: float) -> float:
    return _inverse(lambda x: float(chi2_cdf(np.array([x]), np.array([df]))[0]), p)


@dataclass
class Location:
    """Centre and covariance; a row is [1, x], its score the squared distance."""

    p: int

    def model(self, m: np.ndarray) -> tuple[np.ndarray, float] | None:
        """(centre and inverse covariance, log determinant) from the sums of products m of the rows."""
        n, centre = m[0, 0], m[0, 1:] / m[0, 0]
        cov = (m[1:, 1:] - n * np.outer(centre, centre)) / (n - 1) if n > 1 else np.zeros((self.p, self.p))
        scale = np.sqrt(np.diag(cov))
        if n <= self.p or not (scale > 0).all() or np.linalg.slogdet(cov / np.outer(scale, scale))[1] < np.log(1e-12) * self.p:
            return None
        try:
            return np.concatenate([centre, np.linalg.inv(cov).ravel()]), float(np.linalg.slogdet(cov)[1])
        except np.linalg.LinAlgError:  # the check above is by rounded correlations
            return None

    def scores(self, v: np.ndarray, models: np.ndarray) -> np.ndarray:
        """rows x starts; models are (rows or 1) x starts x numbers."""
        z = v[:, None, 1:] - models[..., : self.p]
        return np.einsum("nsi,nsij,nsj->ns", z, np.broadcast_to(models[..., self.p :].reshape(*models.shape[:2], self.p, self.p), (*z.shape, self.p)), z)

    def score(self, v: Column, model: Column) -> Column:
        z = [v[i + 1] - model[i] for i in range(self.p)]
        return sum((z[i] * z[j] * model[self.p + i * self.p + j] for i in range(self.p) for j in range(self.p)), F.lit(0.0))

    def subset(self) -> int:
        return self.p + 1


@dataclass
class Regression:
    """Coefficients of [1, x] for y; a row is [1, x, y], its score the squared residual."""

    p: int

    def model(self, m: np.ndarray) -> tuple[np.ndarray, float] | None:
        x, xy = m[:-1, :-1], m[:-1, -1]
        scale = np.sqrt(np.diag(x))
        if not (scale > 0).all() or np.linalg.slogdet(x / np.outer(scale, scale))[1] < np.log(1e-13) * self.p:
            return None
        try:
            b = np.linalg.solve(x / np.outer(scale, scale), xy / scale) / scale
        except np.linalg.LinAlgError:
            return None
        return b, float(max(0.0, m[-1, -1] - b @ xy) / m[0, 0])

    def scores(self, v: np.ndarray, models: np.ndarray) -> np.ndarray:
        return (v[:, None, -1] - np.einsum("ni,nsi->ns", v[:, :-1], np.broadcast_to(models, (len(v), *models.shape[1:])))) ** 2

    def score(self, v: Column, model: Column) -> Column:
        gap = v[self.p] - sum((v[i] * model[i] for i in range(self.p)), F.lit(0.0))
        return gap * gap

    def subset(self) -> int:
        return self.p


def _concentrated(kind, v: np.ndarray, h: int, model: np.ndarray, steps: int) -> tuple[np.ndarray, float] | None:
    """One start over rows in memory."""
    found, last = None, np.inf
    for _ in range(steps):
        own = v[np.argsort(kind.scores(v, model[None, None])[:, 0], kind="stable")[:h]]
        found = kind.model(own.T @ own)
        if found is None or found[1] >= last:
            break
        model, last = found
    return None if found is None else (model, last)


def starts(kind, v: np.ndarray, h: int, seed: int = 1) -> list[np.ndarray]:
    """Models of the best small subsets of v after concentration, different ones, best first."""
    random, found = np.random.default_rng(seed), []
    for _ in range(STARTS):
        order = random.permutation(len(v))
        for k in range(kind.subset(), len(v) + 1):  # a subset that lies in a plane grows
            first = kind.model(v[order[:k]].T @ v[order[:k]])
            if first is not None:
                break
        own = None if first is None else _concentrated(kind, v, h, first[0], 2)
        if own is not None:
            found.append(own)
    found.sort(key=lambda f: f[1])
    best = [f for f in (_concentrated(kind, v, h, m, STEPS) for m, _ in found[: 3 * KEPT]) if f is not None]
    best.sort(key=lambda f: f[1])
    out: list[np.ndarray] = []
    for m, _ in best:
        if not any(np.allclose(m, o, rtol=1e-6) for o in out):
            out.append(m)
    return out[:KEPT]


def _fit(rows: DataFrame, kind: Location | Regression, share: float) -> DataFrame:
    """(k, n, h, model, objective, limit) of each group's best start, of rows(k, v)."""
    width = kind.p + 1
    key = rows.schema["k"].dataType.simpleString()
    n = F.col("n").cast("double")
    half = F.floor((n + kind.p + 1) / 2)
    sizes = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * width).withColumn("h", F.floor(2 * half - n + 2 * (n - half) * share)), "sizes")
    dice = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(sizes, "k").where(dice * F.col("n") < SAMPLE)

    def look(table: pa.Table) -> pa.Table:
        v = np.array(table.column("v").to_pylist())
        count, h = table.column("n")[0].as_py(), table.column("h")[0].as_py()
        found = starts(kind, v, min(len(v), max(kind.subset() + 1, round(h / count * len(v)))))
        return pa.table({"k": table.column("k").combine_chunks().take(pa.array([0] * len(found), pa.int64())), "start": pa.array(range(len(found)), pa.int32()), "model": pa.array([m.tolist() for m in found], pa.list_(pa.float64())), "objective": pa.array([float("inf")] * len(found), pa.float64())})

    models = written(sample.groupBy("k").applyInArrow(look, f"k {key}, start int, model array<double>, objective double"), "starts")
    cells = [(i, j) for i in range(width) for j in range(i, width)]
    state = models.withColumn("limit", F.lit(None).cast("double")).withColumn("going", F.lit(True))
    for step in range(STEPS):
        sums = _least_sums(rows, state.where("going"), sizes, kind, cells)

        def refit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, out = np.array([batch.column(f"s{i}_{j}").to_numpy() for i, j in cells]), []
                for r in range(batch.num_rows):
                    m = np.zeros((width, width))
                    for c, (i, j) in enumerate(cells):
                        m[i, j] = m[j, i] = flat[c, r]
                    out.append(kind.model(m) or (None, None))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "start", "limit")), pa.array([None if m is None else m.tolist() for m, _ in out], pa.list_(pa.float64())), pa.array([o for _, o in out], pa.float64())], ["k", "start", "limit", "next", "value"])

        found = sums.mapInArrow(refit, f"k {key}, start int, limit double, next array<double>, value double").where("next is not null")
        held = state.where("going").select("k", "start", "model", "objective").join(found, ["k", "start"])
        gain = F.col("objective") - F.col("value")
        small = CLOSE * (F.abs("value") if isinstance(kind, Regression) else F.lit(1.0))
        going = (gain > small) | (F.col("objective") == float("inf"))
        moved = held.select("k", "start", F.when(gain > 0, F.col("next")).otherwise(F.col("model")).alias("model"), F.least("value", "objective").alias("objective"), "limit", going.alias("going"))
        now = moved.unionByName(state.where("not going")) if step else moved
        if step == FIRST:
            now = now.groupBy("k").agg(F.min(F.struct("objective", "start", "model", "limit", "going")).alias("b")).select("k", "b.start", "b.model", "b.objective", "b.limit", "b.going")
        state = written(now, "state")
        if state.where("going").isEmpty():
            break
    best = state.groupBy("k").agg(F.min(F.struct("objective", "start", "model", "limit")).alias("b"))
    return best.join(sizes, "k").select("k", "n", "h", "b.model", "b.objective", "b.limit")


def scores(rows: DataFrame, models: DataFrame, kind) -> DataFrame:
    """(k, v, start, score): every row's score under each of its group's models(k, start, model)."""
    return rows.join(models.select("k", "start", "model"), "k").select("k", "v", "start", kind.score(F.col("v"), F.col("model")).alias("score"))


def _least_sums(rows: DataFrame, models: DataFrame, sizes: DataFrame, kind, cells: list[tuple[int, int]]) -> DataFrame:
    """(k, start, limit, s<i>_<j>): the h-th smallest score under each model, and sums of products of the rows up to it."""
    score = F.col("score")
    inside = (score > 0) & (score < float("inf"))
    part = F.when(inside, F.floor(F.log2(score) * PARTS)).when(score <= 0, F.lit(-(1 << 31))).otherwise(F.lit(1 << 31))
    # a part is never null, else the joins below would test that where rows meet models, in an expression too long to be compiled
    scored = scores(rows, models, kind).withColumn("part", F.coalesce(part, F.lit(1 << 31)))
    names = [f"s{i}_{j}" for i, j in cells]
    products = [F.sum(F.col("v")[i] * F.col("v")[j]).alias(name) for (i, j), name in zip(cells, names, strict=True)]
    parts = written(scored.groupBy("k", "start", "part").agg(F.count(F.lit(1)).alias("c"), *products), "parts")
    lower = Window.partitionBy("k", "start").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    zero = lambda x: F.coalesce(x, F.lit(0))
    placed = parts.withColumns({"before": zero(F.sum("c").over(lower))} | {f"b{n}": zero(F.sum(n).over(lower)) for n in names}).join(sizes.select("k", "h"), "k")
    chosen = written(placed.where((F.col("before") < F.col("h")) & (F.col("h") <= F.col("before") + F.col("c"))).select("k", "start", "part", (F.col("h") - F.col("before")).alias("place"), *[f"b{n}" for n in names]), "chosen")
    near = written(scored.join(chosen.select("k", "start", "part", "place"), ["k", "start", "part"]).drop("part"), "near")
    limits = ordered.at_places(near, ["k", "start", "place"], "score", {"limit": F.col("place")}).select("k", "start", "limit")
    last = near.join(limits, ["k", "start"]).where("score <= limit").groupBy("k", "start", "limit").agg(*products)
    return last.join(chosen, ["k", "start"]).select("k", "start", "limit", *[(F.col(n) + F.col(f"b{n}")).alias(n) for n in names])


def _rows(data: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    known = [F.col(c).cast("double") for c in columns]
    fine = F.lit(True)
    for c in known:
        fine = fine & c.isNotNull() & ~F.isnan(c)
    return data.where(fine).select(F.struct(*by).alias("k"), F.array(F.lit(1.0), *known).alias("v"))


def minimum_covariance(data: DataFrame, by: list[str], columns: list[str], share: float = 0.75) -> DataFrame:
    """(by, n, h, objective, raw_center, raw_cov, center, cov, kept): the log determinant that h rows reach, their scaled estimates, and those of all rows near them.

    Covariances are row after row in one array; ``kept`` rows lie within the 97.5 % ellipsoid of the raw estimates.
    """
    p = len(columns)
    rows, kind = written(_rows(data, by, columns), "rows"), Location(p)
    best = written(_fit(rows, kind, share), "best")
    return _reweighted(rows, best, kind, by, p)


def _reweighted(rows: DataFrame, best: DataFrame, kind: Location, by: list[str], p: int) -> DataFrame:
    cut = chi2_quantile(0.975, p)
    key = rows.schema["k"].dataType.simpleString()

    def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            factor = [limit / chi2_quantile(min(h / n, 1 - 1e-12), p) for limit, h, n in zip(own["limit"], own["h"], own["n"], strict=True)]
            cov = [(f * np.linalg.inv(np.array(m[p:]).reshape(p, p))).ravel().tolist() for f, m in zip(factor, own["model"], strict=True)]
            yield own.assign(factor=factor, raw_cov=cov, raw_center=[list(m[:p]) for m in own["model"]])[["place", "factor", "raw_center", "raw_cov"]]

    numbered = best.withColumn("place", F.xxhash64("k"))
    factors = numbered.select("place", "n", "h", "limit", "model").mapInPandas(scaled, "place long, factor double, raw_center array<double>, raw_cov array<double>")
    known = written(numbered.join(factors, "place").drop("place"), "factors")
    near = scores(rows, known.select("k", F.lit(0).alias("start"), "model"), kind).join(known.select("k", "factor"), "k").where(F.col("score") <= cut * F.col("factor"))
    x = lambda i: F.col("v")[i + 1]
    moments = near.groupBy("k").agg(F.count(F.lit(1)).alias("kept"), F.array(*[F.avg(x(i)) for i in range(p)]).alias("center"), F.array(*[F.covar_samp(x(i), x(j)) for i in range(p) for j in range(p)]).alias("cov"))
    return known.join(moments, "k").select("k.*", "n", "h", "objective", "raw_center", "raw_cov", "center", "cov", "kept")


def consistency(h: int, n: int) -> float:
    """What makes the root mean square of the h smallest normal residuals of n consistent."""
    q = float(normal_quantile(np.array([(h + n) / (2 * n)]))[0])
    if not np.isfinite(q):
        return 1.0
    return float(1 / np.sqrt(1 - 2 * n / h * q * np.exp(-q * q / 2) / np.sqrt(2 * np.pi)))


def scale_variance(h: int, n: int) -> float:
    """Asymptotic variance of that scale, squared."""
    share = h / n
    q = chi2_quantile(min(share, 1 - 1e-12), 1)
    c2, c3 = float(gamma_cdf(np.array([1.5]), np.array([q / 2]))[0]), 3 * float(gamma_cdf(np.array([2.5]), np.array([q / 2]))[0])
    return (c3 - 2 * q * c2 + share * q * q - (q * share - c2) ** 2) / c2**2


def trimmed_squares(data: DataFrame, by: list[str], predictors: list[str], response: str, share: float = 0.75) -> DataFrame:
    """(by, n, h, objective, raw_scale, raw_coefficients, coefficients, scale, r2, kept): regression on the h rows of least squared residuals, then on all rows near it.

    Coefficients begin with the constant; the objective is the mean of the h squared residuals.
    """
    p = len(predictors) + 1
    rows, kind = written(_rows(data, by, [*predictors, response]), "rows"), Regression(p)
    best = _fit(rows, kind, share)

    def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            scale = [float(np.sqrt(o) * consistency(h, n)) for o, h, n in zip(own["objective"], own["h"], own["n"], strict=True)]
            df = [2 * n / scale_variance(h, n) for h, n in zip(own["h"], own["n"], strict=True)]
            reach = [s * _inverse(lambda t, d=d: float(t_cdf(np.array([t]), np.array([d]))[0]), 0.9875) if s >= 1e-7 else 1e-7 for s, d in zip(scale, df, strict=True)]
            yield own.assign(raw_scale=scale, reach=reach)[["place", "raw_scale", "reach"]]

    numbered = best.withColumn("place", F.xxhash64("k"))
    factors = numbered.select("place", "n", "h", "objective").mapInPandas(scaled, "place long, raw_scale double, reach double")
    known = written(numbered.join(factors, "place").drop("place"), "factors")
    near = scores(rows, known.select("k", F.lit(0).alias("start"), "model"), kind).join(known.select("k", "reach"), "k").where(F.col("score") <= F.col("reach") * F.col("reach"))
    cells = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = near.groupBy("k").agg(*[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"s{i}_{j}") for i, j in cells]).withColumn("place", F.xxhash64("k"))

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            out = []
            for r in own.itertuples():
                m = np.zeros((p + 1, p + 1))
                for i, j in cells:
                    m[i, j] = m[j, i] = getattr(r, f"s{i}_{j}")
                b, mean = kind.model(m) or (np.full(p, np.nan), np.nan)
                total = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
                n = m[0, 0]
                out.append((r.place, b.tolist(), float(np.sqrt(mean * n / (n - 1))), float(np.clip(1 - mean * n / total, 0, 1)) if total > 0 else None, int(n)))
            yield pd.DataFrame(out, columns=["place", "coefficients", "scale", "r2", "kept"])

    final = sums.drop("k").mapInPandas(solved, "place long, coefficients array<double>, scale double, r2 double, kept long")
    return known.withColumn("place", F.xxhash64("k")).join(final, "place").select("k.*", "n", "h", "objective", "raw_scale", F.col("model").alias("raw_coefficients"), "coefficients", "scale", "r2", "kept")
