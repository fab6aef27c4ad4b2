"""Importance resampling towards a target distribution of hashed word n-grams.

Every run of 1 to ``n`` words is a feature, counted as often as it stands there; its bucket
is its CRC-32 modulo ``buckets``, taken by :mod:`position_crc`. Bucket counts of all
documents and of the target give each bucket a gain; a document's weight is the sum over
its features. Gumbel noise drawn from a seeded hash of the id is added, and the highest
scores are drawn: sampling without replacement in proportion to the exponent of the weight.

* Words are runs of ``[0-9a-z]`` and non-ASCII characters after A-Z are lower-cased.
  NULL and empty texts have no features and a weight of 0.
* A NULL id has the noise of an empty id. Rows with equal ids are rows of their own: equal
  scores go to the smaller id (NULL last), then by the row's place in the written table.
* Whole texts are read, of any length; a long one is cut into blocks of words in memory.
* An empty table gives no rows. An empty target gives all buckets a count of zero.
* Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cedarlog.llm import words as W
from cedarlog.llm.position_crc import span_crc32
from cedarlog.operators.ids import assign_ids
from cedarlog.session import materialize, scratch_path

#: Bytes of text that a worker measures at a time; one longer text is taken alone.
SLICE_BYTES = 2 << 20
#: Features whose checksums are taken at a time.
FEATURES_AT_A_TIME = 1 << 17


def feature_buckets(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of each text (runs of 1, then of 2 words, ...), their n + 1 bounds, and numbers of words."""
    data, bounds = W.text_bytes(texts)
    first, length, _ = W.words(data, bounds)
    at = W.word_bounds(first, bounds)
    n_words = np.diff(at)
    data = W.LOWER[data]
    if n > 1:  # all words with one space between them, so that a run is one span
        moved = np.concatenate([[0], np.cumsum(length + 1)])
        joined = np.full(moved[-1], 32, np.uint8)
        for lo in range(0, len(first), FEATURES_AT_A_TIME):
            f, s, m = (x[lo : lo + FEATURES_AT_A_TIME] for x in (first, length, moved[:-1]))
            inside = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            joined[np.repeat(m, s) + inside] = data[np.repeat(f, s) + inside]
        data, first = joined, moved[:-1]
    runs, owners = [], []
    text = np.repeat(np.arange(len(n_words)), n_words)
    for width in range(1, n + 1):
        begin = np.arange(max(len(first) - width + 1, 0))
        begin = begin[text[begin] == text[begin + width - 1]]
        out = np.zeros(len(begin), np.int32)
        for lo in range(0, len(begin), FEATURES_AT_A_TIME):
            b = begin[lo : lo + FEATURES_AT_A_TIME]
            last = b + width - 1
            out[lo : lo + len(b)] = span_crc32(data, first[b], first[last] + length[last] - first[b]) % np.uint32(buckets)
        runs.append(out)
        owners.append(text[begin])
    found, owner = np.concatenate(runs), np.concatenate(owners)
    if n > 1:
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, np.searchsorted(owner, np.arange(len(n_words) + 1)), n_words


def with_buckets(docs: DataFrame, n: int, buckets: int, id_col: str | None, text_col: str) -> DataFrame:
    """doc_id, n_words, buckets (of all features); written once to the shared folder."""
    id_ = F.col(id_col) if id_col else F.lit(None).cast("long")
    base = docs.select(id_.alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema["doc_id"].dataType

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                _, bounds = W.text_bytes(batch.column(1).slice(at))
                take = min(max(1, int(np.searchsorted(bounds, SLICE_BYTES, "right")) - 1), batch.num_rows - at)
                found, ends, n_words = feature_buckets(batch.column(1).slice(at, take), n, buckets)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, take).cast(to_arrow_type(kind)), pa.array(n_words, pa.int64()), lists], names=["doc_id", "n_words", "buckets"]
                )
                at += take

    schema = f"doc_id {kind.simpleString()}, n_words long, buckets array<int>"
    return materialize(base.mapInArrow(measure, schema), "feature-buckets")


def bucket_counts(measured: DataFrame, buckets: int) -> list[int]:
    """Features per bucket: tasks add up theirs, Spark adds those up by bucket, the driver gets ``buckets`` numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], names=["bucket", "n"])

    added = measured.select("buckets").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = [0] * buckets
    for row in added.collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) per bucket."""
    m = len(source)
    all_source, all_target = float(sum(source)), float(sum(target))
    s, t = np.array(source, np.float64), np.array(target, np.float64)
    return np.floor(1000 * np.log((t + 1) * (all_source + m) / ((s + 1) * (all_target + m)))).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), n: int = 1, buckets: int = 10000, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is NULL for those not drawn.

    Of the N rows with ``least_words`` words, floor(share[0] * N / share[1]) are drawn.
    """
    measured = with_buckets(docs, n, buckets, id_col, text_col)
    gains = bucket_gains(bucket_counts(measured, buckets), bucket_counts(with_buckets(target, n, buckets, None, text_col), buckets))
    given = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket
    kind = measured.schema["doc_id"].dataType

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = given.value[lists.flatten().to_numpy()]
            many = lists.value_lengths().to_numpy()
            ends = np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(many)])]
            columns = [batch.column(0).cast(to_arrow_type(kind)), batch.column(1), pa.array(many.astype(np.int64)), pa.array(np.diff(ends))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    weighed = measured.mapInArrow(weigh, f"doc_id {kind.simpleString()}, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    noise = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296))).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + gumbel).withColumn("_less", F.col("n_words") < least_words)
    # places from 1 on, those that can be drawn first; the last key tells equal rows apart, so they spread over tasks
    order = [F.col("_less"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = assign_ids(scored, order_by=order, staging=scratch_path(docs.sparkSession, "draw-order"))
    many = placed.where(~F.col("_less")).count() * share[0] // share[1]
    rank = F.when(~F.col("_less") & (F.col("id") <= many), F.col("id"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
