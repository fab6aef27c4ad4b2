"""Whitening of embeddings onto their leading components.

Entries become integers, so sums over all vectors are exact whatever the order. The
covariance is summed over centred vectors per partition; the driver gets one d by d
matrix. Its leading components come from :mod:`qdwh`, polar decompositions of the shifted
covariance that split invariant subspaces, and are broadcast (d times the number of
components) to whiten every row.

* Rows whose vector is NULL, or holds NULL, NaN or infinite entries, are dropped; so are
  vectors with an entry of 2**50 or more, which have no such integer.
* The dimension is the most frequent length (the larger of equally frequent ones); vectors
  of other lengths, and empty ones, cannot be projected and are dropped too.
* Components without variance (at most 1e-12 of the trace) cannot be whitened and have no
  rows: equal vectors, one vector and an empty table give none. Fewer dimensions than
  components give as many components as dimensions.
* Equal and NULL ids and repeated rows are rows of their own, each counted in the fit.
* ``deviation`` is NULL where it does not fit into 64 bits.
* Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cedarlog.llm.normal import fold_sums
from cedarlog.llm.qdwh import top_components

#: Vectors a worker handles at a time.
ROWS = 4096
#: Components with a smaller share of the variance are left out.
LEAST_SHARE = 1e-12
SCALE, SHIFT = 1024, 100_000


@dataclass(frozen=True)
class Whitening:
    """Mean, components and their eigenvalues; its size depends on the dimension only."""

    n: int
    sums: list[int]
    components: np.ndarray  # d x k, unit columns
    eigenvalues: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n * x - S)**2."""
        widest = max((abs(s) for s in self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if widest < 1 << 62:
            gap = self.n * x - np.array(self.sums, np.int64)
            if int(np.abs(gap).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
                return (gap * gap).sum(axis=1).tolist()
            gap = gap.astype(object)
        else:
            gap = self.n * x.astype(object) - np.array(self.sums, object)
        exact = (gap * gap).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vector (array of doubles) of the rows that can be used, of any length."""
    v = F.col("vector")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float(1 << 50)))
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    return base.where(F.coalesce(fine, F.lit(False)) & (F.size("vector") > 0))


def _integers(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension; tasks give one row a dimension, added up as decimals."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in _slices(batches):
            x = _integers(batch.column(0), d)
            n += len(x)
            if int(np.abs(x).max(initial=0)) >= 1 << 50:  # 4096 of them would not fit
                x = x.astype(object)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
        values = pa.array([n, *total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), values], names=["dimension", "s"])

    added = rows.select("vector").mapInArrow(add, "dimension int, s decimal(38,0)").groupBy("dimension").agg(F.sum("s").alias("s"))
    sums = {r["dimension"]: int(r["s"]) for r in added.collect()}  # one row a dimension
    return sums.get(-1, 0), [sums.get(k, 0) for k in range(d)]


def fit(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors of the most frequent length; None if there are none."""
    rows = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    d = lengths.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if d is None:
        return None
    d = d["d"]
    rows = rows.where(F.size("vector") == d)
    n, sums = exact_sums(rows, d)
    mean = np.array([s / n for s in sums])

    def products(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for lo in range(0, batch.num_rows, ROWS):
            y = _integers(batch.column(0).slice(lo, ROWS), d) - mean
            yield 0, np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    total = fold_sums(rows.select("vector"), products)[0] / n
    covariance, rest = total[: d * d].reshape(d, d), total[d * d :]
    covariance = covariance - np.outer(rest, rest)  # what rounding of the mean left
    values, found = top_components(covariance, components)
    trace = float(np.trace(covariance))
    keep = values > LEAST_SHARE * trace
    return Whitening(n, sums, found[:, keep], values[keep], trace)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    d, k = model.components.shape

    def products(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for lo in range(0, batch.num_rows, ROWS):
            w = model.whiten(_integers(batch.column(0).slice(lo, ROWS), d))
            yield 0, np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    total = fold_sums(rows.select("vector"), products)[0] / model.n
    mean = total[k * k :]
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    model = fit(vectors, components, id_col, vec_col)
    kind = vectors.schema[id_col].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    d, k = model.components.shape
    rows = usable(vectors, id_col, vec_col).where(F.size("vector") == d)
    error = identity_error(rows, model)
    given = vectors.sparkSession.sparkContext.broadcast(model)  # d x k numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = given.value
        share = own.eigenvalues / own.trace
        for batch in _slices(batches):
            x = _integers(batch.column(1), d)
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column(0).cast(to_arrow_type(kind)).take(at),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, own.n), pa.int64()),
                pa.array(own.deviations(x), pa.int64()).take(at),
                pa.array(own.whiten(x).ravel(), pa.float64()),
                pa.array(np.tile(share, m), pa.float64()),
                pa.array(np.full(m * k, error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
