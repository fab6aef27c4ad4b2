"""Normal equations of weighted least squares, summed per partition and fold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Second-level tasks: each adds up the partial sums of many first-level ones.
ADDERS = 16


def fold_sums(rows: DataFrame, equations: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """The sum over all rows of one array per fold.

    ``equations`` gives (fold, array) parts of a batch. Tasks add up theirs, a few
    tasks add up those, and the driver gets one array per fold: its size depends on
    the model only.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, part in equations(batch):
                sums[fold] = sums[fold] + part if fold in sums else part
        folds = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(folds, pa.int64()), pa.array([sums[f].astype(np.float64).tobytes() for f in folds], pa.binary())], names=["fold", "sum"]
        )

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data)
                sums[fold] = sums[fold] + part if fold in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["fold", "sum"]
        )

    def last(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [group["fold"].iloc[0]], "sum": [np.sum([np.frombuffer(s) for s in group["sum"]], axis=0).tobytes()]})

    schema = "fold long, sum binary"
    added = rows.mapInArrow(partial, schema).repartition(ADDERS).mapInArrow(more, schema)
    return {r["fold"]: np.frombuffer(bytes(r["sum"])) for r in added.groupBy("fold").applyInPandas(last, schema).collect()}


def weighted(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """X'WX, X'Wy and the sum of weights, in one flat array."""
    w = x if weight is None else x * weight[:, None]
    return np.concatenate([(w.T @ x).ravel(), w.T @ y, [len(x) if weight is None else weight.sum()]])


def solve(sums: np.ndarray, width: int, ridge: float) -> np.ndarray:
    """Coefficients; the last column, the intercept, is not shrunk."""
    a, b = sums[: width * width].reshape(width, width), sums[width * width : -1]
    shrink = np.full(width, ridge)
    shrink[-1] = 1e-9
    return np.linalg.solve(a + np.diag(shrink + 1e-9), b)
