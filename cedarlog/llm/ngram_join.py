"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

Texts are sets of five-word shingles. Texts with the same set are one class from
the start. Classes that share a MinHash band are candidates. A candidate pair's
MinHash values are compared sixteen at a time; it is dropped as soon as the
posterior probability of a similarity at the threshold (uniform prior) is below the
tolerance; the rest are verified on the whole sets.

Candidate pairs are never rows. Each class goes to the hubs (smallest class) of its
buckets, and pairs are formed inside tasks, a block against a block; only the number
of links of each class and a spanning forest of them come out. 32 bands of 4 values
miss a pair at 0.8 with a probability of 5e-8, pruning with about the tolerance.

* NULL texts and texts without words have no shingles: a class each, no links.
* One to four words make one shingle.
* Equal texts and repeated rows are links of similarity 1. The class id is the smallest
  doc_id of the class, NULL if all are NULL.
* Other columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.llm import words as W
from cedarlog.llm.groups import Forest, components, hub_blocks, sorted_groups
from cedarlog.llm.rows import column, nested
from cedarlog.session import fits_broadcast, materialize

HASHES, ROWS_A_BAND, STEP = 128, 4, 16
BANDS = HASHES // ROWS_A_BAND
#: Classes in a block; a task holds two blocks at most.
BLOCK = 1024
#: Text keys that are sent to every task at most (8 bytes each); beyond that the join shuffles.
BROADCAST_KEYS = 2_000_000
#: Bytes of bit sets in a task; larger sets are intersected pair by pair.
BITS = 64 << 20
#: Odd multipliers of the MinHash permutations of 32-bit values.
MULTIPLIERS = (W.mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For n compared values, the matches below which a pair is dropped.

    With a uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1),
    and P(similarity >= t) is the chance of at most m successes in n + 1 trials of t.
    """

    def posterior(m: int, n: int) -> float:
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return {
        n: next(m for m in range(n + 1) if posterior(m, n) >= tolerance) for n in range(STEP, HASHES + 1, STEP)
    }


def minhash(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(n, HASHES) 16-bit MinHash values of the sets between the bounds."""
    out = np.zeros((len(bounds) - 1, HASHES), np.uint16)
    low = (values >> np.uint64(32)).astype(np.uint32)
    for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if hi > lo:
            best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
            for at in range(lo, hi, 256):
                best = np.minimum(best, (low[at : min(at + 256, hi), None] * MULTIPLIERS).min(axis=0))
            out[k] = (best ^ (best >> np.uint32(16))) & np.uint32(0xFFFF)
    return out


def _pieces(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of some MB of text, at least one row each, with their shingle sets."""
    at = 0
    while at < batch.num_rows:
        data, bounds = W.text_bytes(batch.column(column).slice(at))
        take = max(1, int(np.searchsorted(bounds, size, "right")) - 1)
        take = min(take, batch.num_rows - at)
        data, bounds = data[: bounds[take]], bounds[: take + 1]
        first, _, hashes = W.words(data, bounds)
        values, sets = W.sorted_sets(*W.shingles(hashes, W.word_bounds(first, bounds)))
        yield batch.slice(at, take), values, sets
        at += take


def _set_keys(values: np.ndarray, sets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix64(values))])
    n = np.diff(sets).astype(np.uint64)
    return W.mix64(total[sets[1:]] - total[sets[:-1]] + n).view(np.int64)


def _binary(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(rows)]).cast(pa.binary())


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, values, sets in _pieces(batch, 1):
            signature = minhash(values, sets)
            ends = np.arange(len(sets)) * signature.shape[1] * 2
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(_set_keys(values, sets)), pa.array(np.diff(sets)), _binary(signature, ends)],
                names=["tk", "key", "n", "sig"],
            )


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, values, sets in _pieces(batch, 1):
            yield pa.RecordBatch.from_arrays([rows.column(0), _binary(values, sets * 8)], names=["key", "shingles"])


def _alive(own: np.ndarray, sig: np.ndarray, least: dict[int, int], across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x < y) that are left after all MinHash values; ``across``: of different blocks only."""
    xs, ys = [], []
    for lo in range(0, len(sig), 128):
        same = (sig[lo : lo + 128, None, :STEP] == sig[None, :, :STEP]).sum(axis=2, dtype=np.uint8)
        x, y = np.nonzero(same >= least[STEP])
        x += lo
        fit = (x < y) & (own[x] != own[y]) if across else x < y
        x, y = x[fit], y[fit]
        count = same[x - lo, y].astype(np.int64)
        for done in range(STEP, HASHES, STEP):
            if not len(x):
                break
            count += (sig[x, done : done + STEP] == sig[y, done : done + STEP]).sum(axis=1)
            fit = count >= least[done + STEP]
            x, y, count = x[fit], y[fit], count[fit]
        xs.append(x)
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the pairs' intersections."""
    used = np.unique(np.concatenate([x, y]))
    values, place = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
    width = -(-len(values) // 64)
    if width * 8 * len(used) > BITS:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x.tolist(), y.tolist(), strict=True)])
    bits = np.zeros((len(used), width * 64), bool)
    bits[np.repeat(np.arange(len(used)), [len(sets[k]) for k in used]), place] = True
    packed = np.packbits(bits, axis=1).view(np.uint64)
    x, y = np.searchsorted(used, x), np.searchsorted(used, y)
    step = max(1, (8 << 20) // (8 * width))
    return np.concatenate([np.bitwise_count(packed[x[k : k + step]] & packed[y[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), step)])


def _linker(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            hub, i, j = (group.column(k)[0].as_py() for k in range(3))
            own, key, size = (group[c].to_numpy() for c in ("own", "key", "size"))
            sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)
            x, y = _alive(own, sig, least, i != j)
            if not len(x):
                continue
            # a pair that meets in several groups counts in that of its smallest hub
            hubs = [[h for h in hs if h < hub] for hs in group["hubs"].to_pylist()]
            wide = max(map(len, hubs))
            if wide:
                table = np.array([h + [None] * (wide - len(h)) for h in hubs], object)
                lower = np.array([[v is not None for v in row] for row in table])
                table = np.where(lower, table, 0).astype(np.int64)
                met = np.zeros(len(x), bool)
                for k in range(wide):
                    met |= ((table[x, k, None] == table[y]) & lower[y] & lower[x, k, None]).any(axis=1)
                x, y = x[~met], y[~met]
            if not len(x):
                continue
            sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
            n = np.array([len(s) for s in sets])
            both = _common(sets, x, y)
            linked = both >= threshold * (n[x] + n[y] - both) - 1e-9
            x, y = x[linked], y[linked]
            if not len(x):
                continue
            count = np.bincount(x, size[y], len(key)) + np.bincount(y, size[x], len(key))
            has = np.flatnonzero(count)
            forest = Forest()
            edges = [(a, b) for a, b in zip(key[x].tolist(), key[y].tolist(), strict=True) if forest.join(a, b)]
            a = np.concatenate([key[has], np.array([e[0] for e in edges], np.int64)])
            b = pa.array([None] * len(has) + [e[1] for e in edges], pa.int64())
            links = np.concatenate([count[has].astype(np.int64), np.zeros(len(edges), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(links)], names=["a", "b", "links"])

    return link


def text_key(text: Column) -> Column:
    """Equal texts have equal keys; NULL is an empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text, F.octet_length(text))


def link_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.8, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of a join of all texts with all texts.

    rows: doc_id, tk (text key), key (class of equal shingle sets), n. classes, one row
    per key that has shingles: key, root (connected group), n_links, tk of the text that
    stands for it, size, least_id.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"), text_key(F.col(text_col)).alias("tk"))
    # texts are hashed in whole; an id only rides along in the second read of the profile
    profile = materialize(base.select("tk", "_text", "doc_id").mapInArrow(_with_id(base), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, tk long, key long, n long, sig binary"), "shingle-profile")
    classes = materialize(
        profile.where("n > 0").groupBy("key").agg(F.min(F.struct("tk", "sig")).alias("_s"), F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least_id"))
        .select("key", "_s.tk", "_s.sig", "size", "least_id"), "shingle-classes",
    )
    width = ROWS_A_BAND * 2
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width))))
    banded = classes.select("key", F.explode(bands).alias("band"))
    buckets = banded.groupBy("band").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = materialize(banded.join(buckets, "band").select("hub", "key").distinct(), "shingle-hubs")
    hubs = members.groupBy("key").agg(F.collect_list("hub").alias("hubs"))  # BANDS at most
    wanted = materialize(hubs.join(classes, "key").select("key", "tk", "size", "sig", "hubs"), "shingle-wanted")
    keys = wanted.select("tk", F.col("key").alias("_key"))
    small = fits_broadcast(keys, BROADCAST_KEYS)
    texts = base.select("tk", "_text").join(F.broadcast(keys) if small else keys, "tk")
    one = texts.select(F.col("_key").alias("key"), "_text").mapInArrow(_contents, "key long, shingles binary")
    contents = one.groupBy("key").agg(F.first("shingles").alias("shingles"))
    full = wanted.join(contents, "key").select("key", "size", "sig", "hubs", "shingles")
    work = hub_blocks(members, BLOCK).join(full, "key").select("hub", "i", "j", "own", "key", "size", "sig", "hubs", "shingles")
    dealt = work.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "key")
    found = materialize(dealt.mapInArrow(_linker(threshold, tolerance), "a long, b long, links long"), "shingle-links")
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("key"), "links")
    roots = components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("a").alias("key"), "root")
    joined = classes.select("key", "tk", "size", "least_id").join(links, "key", "left").join(roots, "key", "left")
    out = joined.select("key", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "tk", "size", "least_id")
    return profile.select("doc_id", "tk", "key", "n"), out


def _with_id(base: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(base.schema["doc_id"].dataType)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows in _profile(iter([batch])):
                ids = batch.column(2).slice(at, rows.num_rows).cast(kind)
                at += rows.num_rows
                yield pa.RecordBatch.from_arrays([ids, *rows.columns], names=["doc_id", *rows.schema.names])

    return profile


def jaccard_join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, n_links, n_shingles.

    ``class_id`` is the smallest doc_id of the connected group of links, ``class_size``
    its rows, ``n_links`` the other rows with a similarity of ``threshold`` or more.
    """
    rows, classes = link_texts(docs, text_col, id_col, threshold, tolerance)
    groups = classes.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("size").alias("class_size"))
    known = classes.where("n_links > 0").join(groups, "root").select("key", "class_id", "class_size", "n_links")
    alone = rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))
    linked = F.col("n_links").isNotNull()
    joined = rows.where("n > 0").join(known, "key", "left")
    return joined.select(
        "doc_id", F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_shingles"),
    ).unionByName(alone)


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """The rows of ``docs`` with one document of each class, that of the smallest doc_id.

    Rows without shingles are no copies of each other and all stay. Of rows with
    equal doc_id and text one stays.
    """
    rows, classes = link_texts(docs, text_col, id_col, threshold, tolerance)
    texts = rows.where("n > 0").groupBy("key", "tk").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id")).alias("_id"))
    first = F.min(F.struct("_id.no", "_id.doc_id", "tk"))
    chosen = texts.join(classes.select("key", "root"), "key").groupBy("root").agg(first.alias("_f"))
    chosen = chosen.select(F.col("_f.tk").alias("tk"), F.col("_f.doc_id").alias("first"))
    tagged = docs.select(nested(docs), text_key(column(text_col)).alias("tk"), column(id_col).alias("id"))
    stay = tagged.join(chosen, "tk").where(F.col("id").eqNullSafe(F.col("first"))).dropDuplicates(["tk"])
    return stay.select("row.*").unionByName(without_shingles(docs, text_col))


def without_shingles(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text is NULL or has no word."""
    return docs.where(~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
