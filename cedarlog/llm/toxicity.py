"""Toxicity by a classifier chain.

Each category has a logistic model over the words and word beginnings that tell most
about it, and over the log odds of the categories before it in the chain. In
training, those come from models that did not see the row (out of fold); in scoring,
from the models of all training rows. Models are fitted by Newton steps on normal
equations summed per partition.

* NULL and empty texts have no features; their probability comes from the intercepts and the chain.
* A label counts for every row of its id; rows with a NULL label train nothing. Of several
  labels of one id, each category takes the largest. Repeated rows are scored each.
* Rows with equal texts are in one fold, so no model that leaves a text out has seen a copy of it.
* Texts of any length are read whole, one text at a time beyond 4 MB.
* Without training rows every probability is 0.5. An empty table gives no rows.
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

from cedarlog.llm import words as W
from cedarlog.llm.normal import fold_sums, solve, weighted
from cedarlog.session import materialize

FOLDS = 3
STEPS = 8
#: Bytes of the word beginnings that are features beside the words.
PREFIXES = (4, 6, 8)


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hashes, how often, n + 1 bounds): the words and word beginnings of each text."""
    data, bounds = W.text_bytes(texts)
    first, length, hashes = W.words(data, bounds)
    at = W.word_bounds(first, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    values, owner = [hashes], [text]
    for size in PREFIXES:
        long = np.flatnonzero(length > size)
        start = np.full(len(long), size, np.uint64)
        for k in range(size):
            start = W.mix64(start << np.uint64(8) | W.LOWER[data[first[long] + k]].astype(np.uint64))
        values.append(start)
        owner.append(text[long])
    of, value = np.concatenate(owner), np.concatenate(values)
    order = np.argsort(of, kind="stable")
    of, value = of[order], value[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(bounds) - 1))])
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        value[lo:hi].sort()
    head = np.ones(len(value), bool)
    head[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    starts = np.flatnonzero(head)
    many = np.diff(np.append(starts, len(value)))
    return value[starts], many, np.concatenate([[0], np.cumsum(np.bincount(of[starts], minlength=len(bounds) - 1))])


def _slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < batch.num_rows:
        _, bounds = W.text_bytes(batch.column(column).slice(at))
        take = min(max(1, int(np.searchsorted(bounds, size, "right")) - 1), batch.num_rows - at)
        yield batch.slice(at, take)
        at += take


Active = list[tuple[np.ndarray, np.ndarray]]


def _active(features: tuple[np.ndarray, np.ndarray, np.ndarray], chosen: np.ndarray) -> Active:
    """Which of the ``chosen`` (ascending) features each text has, and the logarithm of how often."""
    values, many, bounds = features
    if len(bounds) < 2:
        return []
    k = np.searchsorted(chosen, values)
    hit = chosen[np.minimum(k, len(chosen) - 1)] == values if len(chosen) else np.zeros(len(values), bool)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[hit]
    cuts = np.cumsum(np.bincount(text, minlength=len(bounds) - 1))[:-1]
    return list(zip(np.split(k[hit], cuts), np.split(np.log2(1.0 + many[hit]), cuts), strict=True))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Link:
    """One category: its columns among the chosen features, and a model per left-out fold; the last is that of all rows."""

    columns: np.ndarray
    models: list[np.ndarray]


def _design(active: Active, total: int, link_columns: np.ndarray, odds: list[np.ndarray]) -> np.ndarray:
    x = np.zeros((len(active), total))
    rows = np.repeat(np.arange(len(active)), [len(k) for k, _ in active])
    if len(rows):
        x[rows, np.concatenate([k for k, _ in active])] = np.concatenate([v for _, v in active])
    return np.column_stack([x[:, link_columns], *odds, np.ones(len(active))])


def chain_odds(active: Active, total: int, chain: list[Link], folds: np.ndarray | None = None) -> list[np.ndarray]:
    """Log odds of each category; with ``folds``, each row by the models that left its fold out."""
    odds: list[np.ndarray] = []
    for link in chain:
        x = _design(active, total, link.columns, odds)
        if folds is None:
            odds.append(np.clip(x @ link.models[-1], -12, 12))
        else:
            odds.append(np.clip(np.einsum("ij,ij->i", x, np.stack([link.models[f] for f in folds.tolist()])), -12, 12))
    return odds


@dataclass
class ToxicityChain:
    categories: list[str]
    chosen: np.ndarray
    links: list[Link]

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """(n, categories)."""
        if not self.links:
            return np.full((len(texts), len(self.categories)), 0.5)
        active = _active(text_features(texts), self.chosen)
        return np.stack([_sigmoid(o) for o in chain_odds(active, len(self.chosen), self.links)], axis=1)


def _counts(n_labels: int):
    """Rows and positives of each feature, summed inside the task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 0, 16 << 20):
                values, _, bounds = text_features(part.column(0))
                labels = np.stack([part.column(2 + k).to_numpy() for k in range(n_labels)], axis=1)
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                found, place, n = np.unique(values, return_inverse=True, return_counts=True)
                hits = [np.bincount(place, labels[row, k], len(found)) for k in range(n_labels)]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.float64)), *map(pa.array, hits)], names=["feature", "n", *(f"h{k}" for k in range(n_labels))])

    return count


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", features: int = 250, least_rows: int = 3, ridge: float = 0.3, max_training_rows: int = 200_000) -> ToxicityChain:
    """Fit the chain in the order of ``categories``, which are 0/1 columns of ``labels``.

    At most ``max_training_rows`` labelled ids are used, those with the smallest hashes,
    so that they may be sent to every task (some MB); the texts are not shuffled.
    """
    marks = [F.col(c).cast("double").alias(f"_y{k}") for k, c in enumerate(categories)]
    ys = [f"_y{k}" for k in range(len(categories))]
    known = labels.select(F.col(id_col).alias("_id"), *marks).dropna().groupBy("_id").agg(*(F.max(y).alias(y) for y in ys))
    sample = materialize(known.orderBy(F.xxhash64("_id"), "_id").limit(max_training_rows), "toxicity-labels")
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    joined = base.join(F.broadcast(sample), "_id").select("_text", F.pmod(F.xxhash64("_text"), F.lit(FOLDS)).cast("int").alias("fold"), *ys)
    hits = ", ".join(f"h{k} double" for k in range(len(ys)))
    counts = joined.mapInArrow(_counts(len(ys)), f"feature long, n double, {hits}").groupBy("feature").agg(F.sum("n").alias("n"), *(F.sum(f"h{k}").alias(f"h{k}") for k in range(len(ys))))
    counts = materialize(counts.where(F.col("n") >= least_rows), "toxicity-features")
    total = joined.agg(F.count(F.lit(1)), *(F.sum(y) for y in ys)).first()
    if not total[0]:
        return ToxicityChain(categories, np.zeros(0, np.uint64), [])
    picked = []
    for k in range(len(ys)):
        rate = min(max(total[k + 1] / total[0], 1e-6), 1 - 1e-6)
        apart = F.abs(F.col(f"h{k}") - F.col("n") * rate) / F.sqrt((F.col("n") + 5) * rate * (1 - rate))
        picked.append([r[0] for r in counts.orderBy(apart.desc(), "feature").select("feature").limit(features).collect()])
    chosen = np.unique(np.array([f for p in picked for f in p], np.int64).view(np.uint64))

    def activate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 0):
                active = _active(text_features(part.column(0)), chosen)
                lists = [pa.array([a[k].tolist() for a in active], pa.list_(t)) for k, t in ((0, pa.int64()), (1, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*lists, *part.columns[1:]], names=["active", "often", *part.schema.names[1:]])

    train = materialize(joined.mapInArrow(activate, f"active array<long>, often array<double>, fold int, {', '.join(f'{y} double' for y in ys)}"), "toxicity-training")
    links: list[Link] = []
    for k, own in enumerate(picked):
        columns = np.searchsorted(chosen, np.array(own, np.int64).view(np.uint64))
        width = len(columns) + len(links) + 1
        models = [np.zeros(width) for _ in range(FOLDS + 1)]
        for _ in range(STEPS):

            def equations(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
                for lo in range(0, batch.num_rows, 2000):
                    part = batch.slice(lo, 2000)
                    pairs = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                    active = [(np.array(a, np.int64), np.array(v, np.float64)) for a, v in pairs]
                    folds, y = part.column(2).to_numpy(), part.column(3 + k).to_numpy()  # noqa: B023
                    odds = chain_odds(active, len(chosen), links, folds)
                    x = _design(active, len(chosen), columns, odds)  # noqa: B023
                    for m, beta in enumerate(models):  # noqa: B023
                        use = folds != m  # the last model uses all
                        eta = np.clip(x[use] @ beta, -15, 15)
                        p = _sigmoid(eta)
                        w = np.maximum(p * (1 - p), 1e-5)
                        yield m, weighted(x[use], eta + (y[use] - p) / w, w)

            sums = fold_sums(train, equations)
            new = [solve(sums[m], width, ridge) for m in range(FOLDS + 1)]
            moved = max(np.abs(a - b).max() for a, b in zip(new, models, strict=True))
            models = new
            if moved < 1e-3:
                break
        links.append(Link(columns, models))
    return ToxicityChain(categories, chosen, links)


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and p_<category> of each row, for whole texts."""
    chain = fit_chain(docs, labels, categories, id_col, text_col, **options)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = to_arrow_type(base.schema["doc_id"].dataType)
    names = ["doc_id", *(f"p_{c}" for c in categories)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                p = chain.probabilities(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kind), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=names)

    schema = ", ".join([f"doc_id {base.schema['doc_id'].dataType.simpleString()}", *(f"{n} double" for n in names[1:])])
    return base.mapInArrow(score, schema)
