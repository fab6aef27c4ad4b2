"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics are taken from the bytes of whole texts. Cosines of random projections
approximate a Gaussian kernel over them. Normal equations are summed per partition
and fold, so the model that scores a training row never saw it; those out-of-fold
scores are calibrated by isotonic regression.

* NULL and empty texts have statistics of their own (zeros) and get a score.
* Rows with a NULL id are never training rows and are not held out. Repeated rows are scored each.
* Each label of an id counts for every row of it. Without training labels all scores are 0.5.
* Calibration pools the rows whose raw scores agree in one of 2,000 bins from -0.5 to 1.5;
  scores outside go into the end bins. Each bin stands at the mean score of its rows.
* Texts of any length are read whole, one text at a time beyond 4 MB.
* Other columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cedarlog.llm import words as W
from cedarlog.llm.line_dedup import line_parts
from cedarlog.llm.normal import fold_sums, solve, weighted
from cedarlog.session import materialize

FOLDS = 5
#: Score bins of the calibration; what the driver gets of it.
BINS = 2000
_CODES = np.arange(256)
#: Classes of bytes that are counted, as shares of all bytes.
BYTE_CLASSES = {
    "upper": (_CODES >= 65) & (_CODES <= 90),
    "lower": (_CODES >= 97) & (_CODES <= 122),
    "digit": (_CODES >= 48) & (_CODES <= 57),
    "other": _CODES >= 128,
    "space": (_CODES == 32) | (_CODES == 9),
    "line": _CODES == 10,
    "stop": _CODES == ord("."),
    "comma": _CODES == ord(","),
    "shout": (_CODES == ord("!")) | (_CODES == ord("?")),
    "table": (_CODES == ord("|")) | (_CODES == ord("\t")),
    "symbol": np.isin(_CODES, [ord(c) for c in "#*$%&<>{}[]()@~^_=+/\\"]),
    "quote": np.isin(_CODES, [ord(c) for c in "'\"`;:-"]),
}
STATISTICS = [
    *BYTE_CLASSES, "log_bytes", "log_words", "word_bytes", "short_words", "long_words", "distinct_words", "again_3", "log_lines",
    "line_words", "again_lines", "words_a_stop",
]


def document_statistics(texts: pa.Array) -> np.ndarray:
    """(n, len(STATISTICS)) of whole texts."""
    data, bounds = W.text_bytes(texts)
    size = np.diff(bounds)
    at_least = np.maximum(size, 1)
    out = []

    def counted(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[ends])

    stops = None
    for name, members in BYTE_CLASSES.items():
        n = counted(members[data], bounds)
        stops = n if name == "stop" else stops
        out.append(n / at_least)
    first, length, hashes = W.words(data, bounds)
    at = W.word_bounds(first, bounds)
    n = np.diff(at)
    some = np.maximum(n, 1)
    distinct = np.diff(W.sorted_sets(hashes, at)[1])
    grams, gram_at = W.shingles(hashes, at, 3)
    n_grams = np.diff(gram_at)
    text, _, key, _, _ = line_parts(data, bounds)
    n_lines = np.bincount(text, minlength=len(size))
    line_at = np.concatenate([[0], np.cumsum(n_lines)])
    out += [
        np.log1p(size), np.log1p(n), counted(length, at) / some, counted(length <= 3, at) / some, counted(length >= 9, at) / some,
        distinct / some, 1 - np.diff(W.sorted_sets(grams, gram_at)[1]) / np.maximum(n_grams, 1), np.log1p(n_lines),
        np.log1p(n / np.maximum(n_lines, 1)), 1 - np.diff(W.sorted_sets(key, line_at)[1]) / np.maximum(n_lines, 1),
        np.log1p(n / (stops + 1)),
    ]
    return np.stack(out, axis=1)


def held_out(id_: Column) -> Column:
    """Whether the checksum of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def isotonic(x: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points (x, rate) of a curve that never falls."""
    blocks: list[list[float]] = []
    for xs, count, hits in zip((x * n).tolist(), n.tolist(), total.tolist(), strict=True):
        blocks.append([xs, count, hits])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array(blocks).reshape(-1, 3)
    return at[:, 0] / at[:, 1], at[:, 2] / at[:, 1]


@dataclass(frozen=True)
class QualityModel:
    """All that scoring needs; its size does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    coefficients: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    def fourier(self, statistics: np.ndarray) -> np.ndarray:
        z = (statistics - self.mean) / self.scale
        waves = np.cos(np.clip(z, -8, 8) @ self.directions + self.phases) * np.sqrt(2 / self.directions.shape[1])
        return np.concatenate([waves, np.ones((len(z), 1))], axis=1)

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return np.interp(self.fourier(statistics) @ self.coefficients, *self.curve)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, statistics (array of doubles); written once to the shared folder."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = to_arrow_type(base.schema["doc_id"].dataType)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                _, bounds = W.text_bytes(batch.column(1).slice(at))
                take = min(max(1, int(np.searchsorted(bounds, 4 << 20, "right")) - 1), batch.num_rows - at)
                found = document_statistics(batch.column(1).slice(at, take))
                flat = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, take).cast(kind), flat], names=["doc_id", "statistics"])
                at += take

    schema = f"doc_id {base.schema['doc_id'].dataType.simpleString()}, statistics array<double>"
    return materialize(base.mapInArrow(measure, schema), "document-statistics")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(measured: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", features: int = 256, ridge: float = 1.0, width: float = 1.0, seed: int = 7) -> QualityModel | None:
    """Fit on the labelled rows that are not held out; None if there are none.

    ``width`` is the kernel's width in units of the square root of the number of statistics.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y IS NOT NULL")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    train = measured.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("statistics", "y", fold.alias("fold"))
    train = materialize(train, "quality-training")
    k = len(STATISTICS)
    moments = fold_sums(train.select("statistics"), lambda b: [(0, np.concatenate([[len(b)], (m := _matrix(b.column(0))).sum(0), (m * m).sum(0)]))])
    n = moments[0][0] if moments else 0
    if not n:
        return None
    mean = moments[0][1 : k + 1] / n
    spread = np.sqrt(np.maximum(moments[0][k + 1 :] / n - mean * mean, 0))
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(k, features)) / (width * np.sqrt(k))
    base = QualityModel(mean, np.where(spread > 1e-9, spread, 1), directions, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), (np.zeros(1), np.full(1, 0.5)))

    def equations(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x, y, folds = base.fourier(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for f in range(FOLDS):
            if (own := folds == f).any():
                yield f, weighted(x[own], y[own])

    sums = fold_sums(train, equations)
    total = sum(sums.values())
    coefficients = solve(total, features + 1, ridge)
    others = {f: solve(total - s, features + 1, ridge) if len(sums) > 1 else coefficients for f, s in sums.items()}

    def binned(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x, y, folds = base.fourier(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        raw = np.einsum("ij,ij->i", x, np.stack([others[f] for f in folds.tolist()])) if len(x) else np.zeros(0)
        bins = np.clip(((raw + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
        yield 0, np.concatenate([np.bincount(bins, w, BINS) for w in (np.ones(len(y)), y, raw)])

    count, hits, raw = fold_sums(train, binned)[0].reshape(3, BINS)
    has = count > 0
    curve = isotonic(raw[has] / count[has], count[has], hits[has])
    return QualityModel(base.mean, base.scale, base.directions, base.phases, coefficients, curve)


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= ``cut``) of each row."""
    measured = with_statistics(docs, id_col, text_col)
    model = fit(measured, labels, label_col, id_col, **options)
    kind = to_arrow_type(measured.schema["doc_id"].dataType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.clip(model.score(_matrix(batch.column(1))), 0, 1) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = measured.mapInArrow(score, f"doc_id {measured.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
