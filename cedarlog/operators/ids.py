"""Ever-growing row ids without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.session import materialize

# monotonically_increasing_id keeps the partition number above these bits.
_ROW_BITS = 33


def assign_ids(
    df: DataFrame,
    base: int = 0,
    order_by: Sequence[Column | str] = (),
    partitions: int | None = None,
    staging: str | None = None,
) -> DataFrame:
    """Add ``id`` = base+1, base+2, ... without gaps.

    Ids follow ``order_by``, or arrival (partition) order when that is empty, which
    saves the shuffle. ``order_by`` may name an ``id`` the rows had before, which the new
    one replaces. Rows that tie on ``order_by`` are told apart by a hash of
    the row and then by position, so that many equal rows still spread over tasks.

    The rows are written out once between numbering and counting; otherwise a
    recomputed task could count other rows than it numbered. ``staging`` is where
    to; the result reads from there.
    """
    spark = df.sparkSession
    data = [c for c in df.columns if c != "id"]
    kept = [F.col(f"`{c}`") for c in data]
    rows = df.select(*kept)
    if order_by:
        tied = df.select("*", F.xxhash64(*kept).alias("__tie"), F.monotonically_increasing_id().alias("__at"))
        order = [*order_by, "__tie", "__at"]
        spread = tied.repartitionByRange(partitions, *order) if partitions else tied.repartitionByRange(*order)
        rows = spread.sortWithinPartitions(*order).select(*kept)
    staged = materialize(rows.withColumn("__seq", F.monotonically_increasing_id()), "ids", staging)

    # One row per task of the write above: small, whatever the number of rows.
    part = F.shiftright("__seq", _ROW_BITS)
    counts = staged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts = accumulate((row.n for row in counts), initial=base)
    offsets = spark.createDataFrame(
        [(row.part, start) for row, start in zip(counts, starts)], "__part bigint, __start bigint"
    )
    position = F.col("__seq").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        staged.join(F.broadcast(offsets), part == F.col("__part"))
        .withColumn("id", F.col("__start") + position + 1)
        .select("id", *(F.col(f"`{c}`") for c in data))
    )


def nth_id(df: DataFrame, n: int, block: int = 1 << 20, fan: int = 4096) -> int | None:
    """The n-th smallest ``id`` of ``df``, or None when there are fewer rows.

    Narrows the range of ids by counting per slice, a few thousand slices at a
    time, until one slice is small enough to sort.
    """
    bounds = df.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    if bounds.low is None:
        return None
    low, high, wanted = bounds.low, bounds.high, n
    while high - low + 1 > block:
        width = -(-(high - low + 1) // fan)
        inside = df.filter(F.col("id").between(low, high))
        slices = (
            inside.groupBy(((F.col("id") - F.lit(low)) / F.lit(width)).cast("bigint").alias("slice"))
            .agg(F.count("*").alias("n"))
            .orderBy("slice")
            .collect()
        )
        for row in slices:
            if wanted <= row.n:
                low, high = low + row.slice * width, min(low + (row.slice + 1) * width - 1, high)
                break
            wanted -= row.n
        else:
            return None
    picked = df.filter(F.col("id").between(low, high)).select("id").orderBy("id").limit(wanted).agg(
        F.max("id").alias("id"), F.count("*").alias("n")
    ).first()
    return picked.id if picked.n == wanted else None
