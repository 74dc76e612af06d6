"""Whitening of embeddings by a tall-skinny QR: the covariance is never formed.

1. Entries c become whole numbers floor(64 c) + 1000000; their sums by dimension are exact, in decimals of 38 digits.
2. Each task centres its rows by these sums and folds them, block by block, into one triangular factor.
3. Factors meet in a tree: a task stacks a bounded number of them and factors again, until one is left.
4. The singular values and right vectors of that one, d x d at most, are those of all centred rows: the vectors are
   the components, the squared values over n their variances.
5. Rows are projected on the components and divided by the roots of the variances; sums of products of the results
   over all rows tell how far their covariance is from the identity.

Defined results: null vectors, and vectors with null, NaN or infinite entries, are dropped; a vector shorter than the
longest is filled up with zeros; |64 c| beyond 2^52 counts as 2^52; rows with one vec_id, or none, are rows like any
other; components without variance are left out, so one vector, equal vectors or an empty table give no rows;
``deviation`` is null where it passes 63 bits, ``deviation_wide`` has it as a decimal; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.llm.work import Work

OFFSET, SCALE, MOST = 1_000_000, 64.0, float(1 << 52)
BLOCK = 1024
"""Rows that are worked on at once; so many entries up to 2^52 have a sum that a long holds."""
MERGED_BYTES = 64 << 20
"""Most bytes of the factors that meet in one task of the tree."""
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"


def _rows(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("e")).where(F.col("e").isNotNull() & finite)


def _blocks(batch: pa.RecordBatch, width: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whole numbers by row and dimension) of the batch's rows, a block at a time."""
    lists = batch.column("e")
    begin, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    for first in range(0, len(lists), BLOCK):
        at = begin[first : first + BLOCK + 1]
        length = np.diff(at)
        out = np.zeros((len(length), max(int(length.max()), width or 0)))
        row = np.repeat(np.arange(len(length)), length)
        out[row, np.arange(at[0], at[-1]) - at[row]] = flat[at[0] : at[-1]]
        yield first, np.clip(np.floor(SCALE * out), -MOST, MOST).astype(np.int64) + OFFSET


@dataclass
class Fit:
    """n, the exact sums by dimension, the components as columns, their standard deviations and shares of the trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        return (x - np.array(whole, dtype=np.int64)) - np.array(rest) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions / self.deviations

    def distance(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - sum)^2, exact."""
        far = int(np.abs(self.centred(x)).max(initial=0) + 1) * self.n
        if x.shape[1] * far * far < 1 << 62 and self.n * int(np.abs(x).max(initial=0)) < 1 << 62:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        return ((self.n * x.astype(object) - np.array(self.sums, dtype=object)) ** 2).sum(axis=1).tolist()


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the sums by dimension; what a short vector lacks counts as an entry 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _blocks(batch):
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([(x - OFFSET).sum(axis=0)], pa.list_(pa.int64()))], ["n", "sums"])

    parts = rows.mapInArrow(work, "n long, sums array<long>").select(F.posexplode(F.concat(F.array("n"), "sums")).alias("i", "value"))
    found = dict(parts.groupBy("i").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("sum")).toPandas().itertuples(index=False))
    n = int(found.pop(0, 0))
    return n, [int(found[i + 1]) + OFFSET * n for i in range(len(found))]


def _triangle(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def _factor(rows: DataFrame, fit: Fit, work: Work) -> np.ndarray:
    """The triangular factor of all centred rows."""
    d = len(fit.sums)
    schema = "node long, factor binary"
    width = max(2, min(16, MERGED_BYTES // (8 * d * d)))

    def batch_of(node: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], ["node", "factor"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for _, x in _blocks(batch, d):
                r = _triangle([r, fit.centred(x)])
        if len(r):
            yield batch_of(TaskContext.get().partitionId(), r)

    def merged(node: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([batch_of(node[0].as_py(), _triangle([np.frombuffer(x, dtype=np.float64).reshape(-1, d) for x in table.column("factor").to_pylist()]))])

    factors = work.cut(rows.mapInArrow(local, schema), "factors")
    while factors.count() > 1:
        factors = work.cut(factors.withColumn("node", F.expr(f"node div {width}")).groupBy("node").applyInArrow(merged, schema), "merged")
    return np.frombuffer(factors.first()["factor"], dtype=np.float64).reshape(-1, d)


def fit(rows: DataFrame, components: int, work: Work) -> Fit | None:
    n, sums = _sums(rows)
    if not n or not sums:
        return None
    out = Fit(n, sums, np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0))
    _, values, right = np.linalg.svd(_factor(rows, out, work), full_matrices=False)
    if not values[0]:
        return None
    own = np.flatnonzero(values > values[0] * max(len(sums), 64) * np.finfo(float).eps)[:components]
    right = right[own].T
    sign = np.where(right[np.abs(right).argmax(axis=0), np.arange(len(own))] < 0, -1.0, 1.0)
    return Fit(n, sums, right * sign, values[own] / np.sqrt(n), (values**2 / (values**2).sum())[own])


def _identity_error(rows: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    d, k = model.directions.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in _blocks(batch, d):
                y = model.whitened(x)
                sums, products = sums + y.sum(axis=0), products + y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([sums, products.ravel()])], pa.list_(pa.float64()))], ["sums"])

    parts = rows.mapInArrow(work, "sums array<double>").select(F.posexplode("sums").alias("i", "value")).groupBy("i").agg(F.sum("value").alias("sum")).toPandas()
    flat = parts.sort_values("i")["sum"].to_numpy() / model.n
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 32, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error, for every vector and up to ``components`` components."""
    spark = vectors.sparkSession
    work = Work(spark, "whitening")
    rows = _rows(vectors, id_column, column)
    model = fit(rows, components, work)
    if model is None:
        return spark.createDataFrame([], RESULT)
    error = _identity_error(rows, model)
    sent = spark.sparkContext.broadcast(model)  # d x 32 doubles and d sums

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        d, k = known.directions.shape
        for batch in batches:
            for first, x in _blocks(batch, d):
                m = len(x)
                far, row = known.distance(x), pa.array(np.repeat(np.arange(m), k))
                repeat = lambda values, kind, m=m: pa.array(np.tile(values, m), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").slice(first, m).take(row), repeat(np.arange(1, k + 1), pa.int32()), repeat(np.full(k, known.n), pa.int64()),
                        pa.array([v if v < 1 << 63 else None for v in far], pa.int64()).take(row), pa.array(known.whitened(x).ravel()), repeat(known.explained, pa.float64()), repeat(np.full(k, error), pa.float64()),
                        pa.array(far, pa.decimal128(38, 0)).take(row),
                    ],
                    RESULT_NAMES,
                )

    return rows.mapInArrow(project, RESULT)


RESULT_NAMES = [part.split(" ")[0] for part in RESULT.split(", ")]
