"""Merkle fixity audit of replicas of a web archive.

Records are hashed where they stand. Ordered ranges of offsets in a file form the
leaves' parents, ranges of ranges their parents, up to a root per file; files are
gathered by hash buckets up to one root per replica. Two replicas are compared from
the root down: a level's nodes are compared only below nodes that differ, so equal
branches cost their roots' comparison.

* A NULL file is the file "", a NULL offset is -1, a NULL payload is an empty one.
* Several records at one place are compared by how often each digest is there. Between a
  place and its range stand SLOTS buckets of digests, so that a place which holds very many
  records (all those without file and offset) is no single list.
* Payloads are hashed whole, however long or empty. Other columns do not matter.
* Two empty replicas are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.session import materialize

#: Bytes of a lowest range, ranges in the next higher one, and the levels of ranges.
RANGE_BYTES, FANOUT, RANGE_LEVELS = 1 << 16, 16, 3
#: Hexadecimal digits of a digest that name its bucket inside a place: 4096 buckets.
SLOT_DIGITS = 3
#: Buckets of files at each level above the files; the last is the root.
FILE_BUCKETS = (4096, 64, 1)
#: Node columns of each level, from the ranges up.
LEVELS = [*(("file", f"r{k}") for k in range(RANGE_LEVELS)), ("file",), *((f"b{k}",) for k in range(len(FILE_BUCKETS)))]


def warc_record(uri: Column, date: Column, payload: Column) -> Column:
    """A response record as stored: header lines, an empty line, the block, two line ends."""
    block = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nWARC-Date: "), date,
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"),
    )


def _places() -> dict[str, Column]:
    """The node that a record belongs to, at each level."""
    ranges = {f"r{k}": F.floor(F.col("offset") / (RANGE_BYTES * FANOUT**k)).cast("long") for k in range(RANGE_LEVELS)}
    bucket = F.pmod(F.xxhash64("file"), F.lit(FILE_BUCKETS[0]))
    step = {}
    for k, n in enumerate(FILE_BUCKETS):
        step[f"b{k}"] = F.floor(bucket * n / FILE_BUCKETS[0]).cast("long")
    return ranges | step


def record_digests(records: DataFrame, payload: str = "payload") -> DataFrame:
    """file, offset, length, digest and the nodes above, of each record."""
    data = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    base = records.select(
        F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"), F.coalesce(F.col("offset").cast("long"), F.lit(-1)).alias("offset"),
        F.octet_length(data).cast("long").alias("length"), F.sha2(data, 256).alias("digest"),
    )
    return base.withColumns(_places())


def counted(digests: DataFrame) -> DataFrame:
    """file, offset, length, digest and how many such records there are; equal ones are added up before the shuffle."""
    return digests.groupBy("file", "offset", "length", "digest").agg(F.count(F.lit(1)).alias("n"))


def merkle_tree(digests: DataFrame) -> list[DataFrame]:
    """The nodes of each level of LEVELS, each with its digest; every level is written once.

    A node's digest covers its children's places and digests in their order. A node has
    a range's buckets of records, FANOUT ranges, a file's top ranges or a bucket's files below it.
    """
    above = [c for c in _places()]
    place = F.lpad(F.col("offset").cast("string"), 20, "0")
    listed = F.concat_ws(":", F.col("length").cast("string"), "digest", F.col("n").cast("string"))
    slots = counted(digests).withColumn("slot", F.substring("digest", 1, SLOT_DIGITS)).groupBy("file", "offset", "slot")
    slots = slots.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(listed)), "\n"), 256).alias("digest")).withColumns(_places())
    now, levels = slots.withColumn("_child", F.concat_ws(":", place, "slot", "digest")), []
    for level in LEVELS:
        keep = [c for c in ("file", *above) if c not in level]
        # what lies above a node is the same for all below it
        up = [F.first(c).alias(c) for c in keep if LEVELS.index(level) < _first_level(c)]
        node = F.sha2(F.array_join(F.sort_array(F.collect_list("_child")), "\n"), 256)
        now = materialize(now.groupBy(*level).agg(node.alias("digest"), *up), "merkle-level")
        levels.append(now)
        name = F.concat_ws("/", *(F.lpad(F.col(c).cast("string"), 20, "0") if c != "file" else F.col(c) for c in level))
        now = now.withColumn("_child", F.concat_ws(":", name, "digest"))
    return levels


def _first_level(column: str) -> int:
    """The level at which a column names the nodes."""
    return max(k for k, level in enumerate(LEVELS) if column in level)


def audit(first: DataFrame, second: DataFrame, payload: str = "payload") -> DataFrame:
    """file, offset, length, status of each place where the replicas differ.

    ``status`` is changed, missing (only the first has it) or extra (only the second);
    ``length`` is that of the first replica's record, or of the extra one.
    """
    a, b = (materialize(record_digests(r, payload), "record-digests") for r in (first, second))
    trees = merkle_tree(a), merkle_tree(b)
    below: DataFrame | None = None
    for k in range(len(LEVELS) - 1, -1, -1):
        level = list(LEVELS[k])
        sides = [t[k] if below is None else _under(t[k], below) for t in trees]
        names = [F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}")).alias(c) for c in level]
        same = F.lit(True)
        for c in level:
            same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
        pairs = sides[0].alias("x").join(sides[1].alias("y"), same, "full")
        below = materialize(pairs.where(~F.col("x.digest").eqNullSafe(F.col("y.digest"))).select(*names), "merkle-differences")
    x, y = (counted(_under(side, below)).alias(name) for side, name in ((a, "x"), (b, "y")))
    keys = ("file", "offset", "length", "digest")
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    both = x.join(y, same, "full").select(
        F.coalesce("x.file", "y.file").alias("file"), F.coalesce("x.offset", "y.offset").alias("offset"),
        F.col("x.length").alias("x_length"), F.col("y.length").alias("y_length"), F.col("x.n").eqNullSafe(F.col("y.n")).alias("same"),
    )
    found = both.groupBy("file", "offset").agg(F.max("x_length").alias("x"), F.max("y_length").alias("y"), F.min("same").alias("same")).where("NOT same")
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("changed")
    return found.select("file", "offset", F.coalesce("x", "y").alias("length"), status.alias("status"))


def _under(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """The nodes below the parents that differ."""
    on = [c for c in parents.columns if c in nodes.columns]
    return nodes.join(parents, on, "left_semi")
