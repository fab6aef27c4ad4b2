"""Benchmark decontamination with a distributed positional inverted index.

The index holds every token of every training text. It is made of blocks: the texts
that one task reads at a time. A block's row of a term lists the places of that
term in the block, as varint differences. A place is the number of the word in the
block, counted over all its texts, so a phrase is one arithmetic progression of
places. Blocks are independent: searching them is a join on the terms asked for and
an intersection per block, from the term that is rarest there.

* NULL and empty texts have no words and no hits. An item without words matches nothing.
* Rows with equal or NULL doc_ids are documents of their own; items with equal ids are one
  item, and so are all without an id, called "null" in the lists beside any of that name.
* Texts and items of any length are read whole; a long text is a block of its own.
* Only ``doc_id``, ``text``, ``item_id`` are read; other columns do not matter.
* An empty corpus or benchmark gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cedarlog.llm import words as W
from cedarlog.llm.rows import nested
from cedarlog.session import fits_broadcast, materialize, scratch_path

#: Bytes of text in a block.
BLOCK_BYTES = 16 << 20
#: Distinct windows that a task looks for in a block; the windows of a larger benchmark are dealt to more tasks.
WINDOWS_A_PASS = 100_000
#: Terms asked for that are sent to every task at most (8 MB); beyond that the join shuffles.
BROADCAST_TERMS = 1_000_000


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LEB128 bytes of unsigned numbers, and the number of bytes of each."""
    values = values.astype(np.uint64)
    size = 1 + sum((values >= np.uint64(1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        has = np.flatnonzero(size > k)
        if not len(has):
            break
        more = (size[has] > k + 1).astype(np.uint64) << np.uint64(7)
        out[at[has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127) | more).astype(np.uint8)
    return out, size


def places(data: bytes) -> np.ndarray:
    """The ascending places of one list."""
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    shift = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * shift), first))


def _index_block(block: int, ids: pa.Array, texts: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of documents (term NULL, data their first place), then rows of terms."""
    data, bounds = W.text_bytes(texts)
    first, _, hashes = W.words(data, bounds)
    doc_first = W.word_bounds(first, bounds)
    n = len(ids)
    order = np.argsort(hashes, kind="stable")
    terms = hashes[order]
    head = np.ones(len(terms), bool)
    head[1:] = terms[1:] != terms[:-1]
    starts = np.flatnonzero(head)
    step = np.diff(order, prepend=0)
    step[starts] = order[starts]
    coded, size = varint(step)
    ends = np.append(np.concatenate([[0], np.cumsum(size)])[starts], len(coded)) if len(starts) else np.zeros(1, np.int64)
    postings = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(coded)])
    count = np.append(starts, len(terms))
    total = n + len(starts)
    pad = pa.nulls(len(starts), ids.type)
    columns = [
        pa.array(np.full(total, block)),
        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(terms[starts].view(np.int64))]),
        pa.array(np.concatenate([np.diff(doc_first), np.diff(count) if len(starts) else starts])),
        pa.array(np.concatenate([doc_first[:-1], np.zeros(len(starts), np.int64)])),
        pa.array(np.concatenate([np.arange(n), np.full(len(starts), -1)])),
        pa.concat_arrays([ids, pad]),
        pa.concat_arrays([pa.nulls(n, pa.binary()), postings]),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


@dataclass(frozen=True)
class PositionalIndex:
    """An index on disk. ``path`` has both kinds of rows: documents and posting lists."""

    spark: SparkSession
    path: str

    def documents(self) -> DataFrame:
        """block, ordinal, doc_id, first (place of its first word), n_words."""
        rows = self.spark.read.parquet(self.path).where("term IS NULL")
        return rows.select("block", "ordinal", "doc_id", "first", F.col("n").alias("n_words"))

    def postings(self) -> DataFrame:
        """block, term (hash), n, places."""
        return self.spark.read.parquet(self.path).where("term IS NOT NULL").select("block", "term", "n", "places")


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> PositionalIndex:
    """Index every word of every text; written to ``path`` or to the shared folder."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "positional-index")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField(n, t) for n, t in (("block", T.LongType()), ("term", T.LongType()), ("n", T.LongType()), ("first", T.LongType()), ("ordinal", T.LongType()), ("doc_id", kind), ("places", T.BinaryType()))]
    )
    arrow = to_arrow_schema(schema)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table["doc_id"].combine_chunks().cast(arrow.field("doc_id").type)
            return _index_block(block, ids, table["text"].combine_chunks(), arrow)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                _, bounds = W.text_bytes(batch.column(1).slice(at))
                take = max(1, int(np.searchsorted(bounds, BLOCK_BYTES - size, "right")) - 1)
                take = min(take, batch.num_rows - at)
                held.append(batch.slice(at, take))
                size += int(bounds[take])
                at += take
                if size >= BLOCK_BYTES or at < batch.num_rows:
                    yield flush()
                    held, size, block = [], 0, block + 1
        if held:
            yield flush()

    source.mapInArrow(index, schema).write.parquet(path)
    return PositionalIndex(spark, path)


def item_windows(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, owners): window (hash), terms and packed terms of each distinct window, and the items that have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                _, _, hashes = W.words(*W.text_bytes(one.column(1)))
                if not len(hashes):
                    continue
                for lo in range(0, max(len(hashes) - width, 0) + 1, 65536):  # a long item's windows in parts
                    found = np.lib.stride_tricks.sliding_window_view(hashes[lo : lo + 65536 + width - 1], min(width, len(hashes)))
                    found = np.ascontiguousarray(found).view(np.int64)
                    n, size = found.shape
                    lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * size, pa.array(found.ravel()))
                    packed = pa.array([row.tobytes() for row in found], pa.binary())
                    yield pa.RecordBatch.from_arrays([one.column(0).take(pa.array(np.zeros(n, np.int64))), lists, packed], names=["item", "terms", "packed"])

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("_text"))
    rows = items.mapInArrow(cut, "item string, terms array<long>, packed binary").withColumn("window", F.xxhash64("packed"))
    rows = materialize(rows, "benchmark-windows")
    windows = rows.groupBy("window").agg(F.first("terms").alias("terms"), F.first("packed").alias("packed"))
    return materialize(windows, "benchmark-windows"), rows.select("window", "item").distinct()


def _near(places_: np.ndarray, want: np.ndarray, slop: int) -> np.ndarray:
    """Which of ``want`` have a place at most ``slop`` away."""
    k = np.searchsorted(places_, want - slop)
    return (k < len(places_)) & (places_[np.minimum(k, len(places_) - 1)] <= want + slop)


def match_block(lists: dict[int, np.ndarray], firsts: np.ndarray, n_words: np.ndarray, windows: list[tuple[int, ...]], slop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window number, starts of exact occurrences, starts of places where each term is at most ``slop`` off)."""
    lasts = firsts + n_words
    for number, window in enumerate(windows):
        if any(t not in lists for t in window):
            continue
        by_rarity = sorted(range(len(window)), key=lambda k: len(lists[window[k]]))
        start = lists[window[by_rarity[0]]] - by_rarity[0]
        for k in by_rarity[1:]:
            if not len(start):
                break
            start = start[_near(lists[window[k]], start + k, slop)]
        if not len(start):
            continue
        doc = np.searchsorted(firsts, start + by_rarity[0], "right") - 1
        start = start[(start >= firsts[doc]) & (start + len(window) <= lasts[doc])]
        exact = start
        for k in by_rarity[1:] if slop else ():
            exact = exact[_near(lists[window[k]], exact + k, 0)]
        if len(start):
            yield number, exact, start


MATCHES = "block long, ordinal long, spans array<struct<start:long,end:long>>, exact array<long>, near array<long>"


def _small(rows: DataFrame, most: int) -> DataFrame:
    return F.broadcast(rows) if fits_broadcast(rows, most) else rows


def find_windows(index: PositionalIndex, windows: DataFrame, slop: int = 2) -> DataFrame:
    """Matches of ``windows``: block, ordinal, spans (word numbers), exact and near (windows).

    A window goes to the blocks that hold its rarest term, if all its terms are in the
    index at all. There the lists are intersected. A block's windows are dealt into
    parts of about ``WINDOWS_A_PASS``, each with the block's lists, so that a task's work
    is bounded. A document comes back if a window occurs in it exactly (``exact``,
    ``spans``) or with each term at most ``slop`` words off its place (``near``).
    """
    count = windows.count()
    parts = max(1, -(-count // WINDOWS_A_PASS))
    places_of = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    words = windows.select("window", F.explode(F.array_distinct("terms")).alias("term"))
    asked = index.postings().join(_small(words.select("term").distinct(), BROADCAST_TERMS), "term", "left_semi")
    totals = materialize(asked.groupBy("term").agg(F.sum("n").alias("total")), "term-totals")
    known = words.join(_small(totals, BROADCAST_TERMS), "term", "left").groupBy("window").agg(
        F.count(F.lit(1)).alias("terms_"), F.count("total").alias("found"), F.min(F.struct("total", "term")).alias("rarest")
    )
    home = known.where("terms_ = found").select("window", F.col("rarest.term").alias("term")).join(windows.select("window", "packed"), "window")
    home = materialize(home, "window-terms")
    blocks = index.postings().select("block", "term").join(_small(home, WINDOWS_A_PASS), "term")
    none = F.lit(0).cast("long")
    rows = blocks.select("block", F.pmod("window", F.lit(parts)).cast("int").alias("part"), F.lit(2).alias("kind"), F.col("window").alias("term"), none.alias("n"), none.alias("first"), none.alias("ordinal"), F.col("packed").alias("places"))
    lists = asked.select("block", places_of, F.lit(1).alias("kind"), "term", "n", none.alias("first"), none.alias("ordinal"), "places")
    documents = index.documents().select("block", places_of, F.lit(0).alias("kind"), none.alias("term"), F.col("n_words").alias("n"), "first", "ordinal", F.lit(None).cast("binary").alias("places"))

    def search(block: pd.DataFrame) -> pd.DataFrame:
        docs, has, asked = (block[block["kind"] == k] for k in range(3))
        docs = docs[docs["n"] > 0].sort_values("ordinal")
        firsts, n_words, ordinals = (docs[c].to_numpy(np.int64) for c in ("first", "n", "ordinal"))
        lists = {int(t): places(p) for t, p in zip(has["term"], has["places"], strict=True)} if len(asked) else {}
        wanted = [tuple(np.frombuffer(p, np.int64).tolist()) for p in asked["places"]]
        names = asked["term"].tolist()
        hits: dict[int, list] = {}
        for number, exact, near in match_block(lists, firsts, n_words, wanted, slop):
            size = len(wanted[number])
            for kind, starts in ((0, exact), (1, near)):
                for start, doc in zip(starts.tolist(), (np.searchsorted(firsts, starts, "right") - 1).tolist(), strict=True):
                    spans, *sets = hits.setdefault(doc, [[], set(), set()])
                    sets[kind].add(names[number])
                    if not kind:
                        spans.append((start - int(firsts[doc]), start - int(firsts[doc]) + size))
        out = []
        for doc, (spans, exact, near) in hits.items():
            spans_ = [{"start": lo, "end": hi} for lo, hi in _merged(spans)]
            out.append((int(block["block"].iloc[0]), int(ordinals[doc]), spans_, sorted(exact), sorted(near)))
        return pd.DataFrame(out, columns=["block", "ordinal", "spans", "exact", "near"])

    return rows.unionByName(lists).unionByName(documents).groupBy("block", "part").applyInPandas(search, MATCHES)


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    return merged


def _joined_spans() -> Column:
    """The spans of all parts of one document, those that touch made one."""
    one = "struct<start:bigint,end:bigint>"
    last = lambda done: F.element_at(done, -1)

    def add(done: Column, span: Column) -> Column:
        touch = (F.size(done) > 0) & (span["start"] <= F.get(done, F.size(done) - 1)["end"])
        longer = F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], span["end"]).alias("end"))
        return F.when(touch, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.sort_array(F.flatten(F.collect_list("spans"))), F.array().cast(f"array<{one}>"), add)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 13,
    slop: int = 2,
    index_path: str | None = None,
) -> DataFrame:
    """One row per document: block, ordinal, doc_id, n_words, n_hit, spans, items, near_items.

    ``n_hit`` counts the words inside any exact occurrence of a window of ``width``
    item words; ``items`` and ``near_items`` name the items with exact and with
    proximity matches, sorted as text.
    """
    index = build_index(docs, index_path, id_col, text_col)
    windows, owners = item_windows(benchmark, width, item_id_col, item_text_col)
    matches = materialize(find_windows(index, windows, slop), "window-matches")
    spans = matches.groupBy("block", "ordinal").agg(_joined_spans().alias("spans"))
    width_of = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = spans.select("block", "ordinal", "spans", width_of.alias("n_hit"))
    # which items: each window's owners, once a document
    exact = F.transform("exact", lambda w: F.struct(w.alias("window"), F.lit(True).alias("whole")))
    near = F.transform("near", lambda w: F.struct(w.alias("window"), F.lit(False).alias("whole")))
    pairs = matches.select("block", "ordinal", F.inline(F.concat(exact, near))).join(_small(owners, BROADCAST_TERMS), "window").groupBy("block", "ordinal", "item").agg(F.max("whole").alias("whole"))
    name = F.coalesce("item", F.lit("null"))  # an item without an id is no item called "null"
    lists = pairs.groupBy("block", "ordinal").agg(
        F.sort_array(F.collect_list(F.when(F.col("whole"), name))).alias("items"), F.sort_array(F.collect_list(name)).alias("near_items")
    )
    found = found.join(lists, ["block", "ordinal"])
    joined = index.documents().join(found, ["block", "ordinal"], "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "block", "ordinal", "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"),
    )


def contaminated(percent: int = 5) -> Column:
    """A document is contaminated if at least ``percent`` of its words are hit."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", percent: int = 5, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; columns stay.

    The rows are written once with a number each, which the index carries.
    """
    numbered = materialize(docs.select(nested(docs), F.monotonically_increasing_id().alias("number")), "decontaminate-rows")
    texts = numbered.select("number", F.col(f"row.`{text_col}`").alias("text"))
    found = decontaminate(texts, benchmark, id_col="number", text_col="text", **options)
    bad = materialize(found.where(contaminated(percent)).select(F.col("doc_id").alias("number")), "contaminated-rows")
    rows = F.broadcast(bad) if fits_broadcast(bad, BROADCAST_TERMS) else bad
    return numbered.join(rows, "number", "left_anti").select("row.*")
