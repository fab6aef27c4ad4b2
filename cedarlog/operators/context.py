"""What else a host logged around given moments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.functions.args import parse_duration
from cedarlog.session import fits_broadcast, materialize

_MICROSECOND = dt.timedelta(microseconds=1)

# Above this many anchor cells (some 60 bytes each) the join is by shuffle.
BROADCAST_ROWS = 1_000_000

# Parts the rows of one host and time cell are spread over in a shuffled join.
SALTS = 16


def _cell(us: Column, width: int) -> Column:
    """Exact floor division, also before 1970."""
    return ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("bigint")


def _neighbours(anchors: DataFrame, width: int) -> DataFrame:
    """Per host and time cell: the first and last anchor in it, the last one of the
    cell before and the first one of the cell after."""
    marks = anchors.groupBy("__key", _cell(F.col("__at"), width).alias("__mark")).agg(
        F.min("__at").alias("__first"), F.max("__at").alias("__last")
    )
    shift = F.col("__shift")
    return (
        marks.withColumn("__shift", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        .groupBy(F.col("__key").alias("__near_key"), (F.col("__mark") + shift).alias("__near_cell"))
        .agg(
            F.min(F.when(shift == 0, F.col("__first"))).alias("__own_first"),
            F.max(F.when(shift == 0, F.col("__last"))).alias("__own_last"),
            F.max(F.when(shift == 1, F.col("__last"))).alias("__previous"),
            F.min(F.when(shift == -1, F.col("__first"))).alias("__following"),
        )
    )


def context_around(
    anchors: DataFrame,
    log: DataFrame,
    before: str,
    after: str,
    anchor_time: str = "ts",
    log_time: str = "r_isodate",
    key: str = "host",
) -> DataFrame:
    """The log rows that lie, on the same host, from ``before`` ahead of to ``after``
    past at least one anchor; each row once, however many anchors match.

    Time is cut into cells as long as the window side. An anchor at or before a
    row, in the row's own cell, is then close enough, and of the cell before only
    the last anchor can matter; the other side is the mirror image. So anchors
    shrink to a few moments per host and cell before the join, no pairs are ever
    formed, and a busy host spreads over its cells.

    Few anchors are broadcast, so that the log is not shuffled at all; whether they
    are few is checked by counting. Otherwise the log's rows of one host and cell
    are spread over :data:`SALTS` parts. Either way only the days the anchors span
    are read from a log that is partitioned by ``day``.
    """
    lead, trail = (parse_duration(side) // _MICROSECOND for side in (before, after))
    at = F.col("__us")
    marks = materialize(
        anchors.select(
            F.col(key).alias("__key"), F.unix_micros(F.col(anchor_time).cast("timestamp")).alias("__at")
        ).dropna(),
        "anchors",
    )
    bounds = marks.agg(F.min("__at").alias("first"), F.max("__at").alias("last")).first()
    if bounds.first is None:
        return log.limit(0)
    earliest, latest = (F.timestamp_micros(F.lit(us)) for us in (bounds.first - lead, bounds.last + trail))
    rows = log.filter(F.col(log_time).between(earliest, latest))
    if log_time == "r_isodate" and "day" in log.columns:
        rows = rows.filter(F.col("day").between(F.to_date(earliest), F.to_date(latest)))
    rows = rows.withColumn("__us", F.unix_micros(F.col(log_time).cast("timestamp"))).withColumn("__in", F.lit(False))

    for width in sorted({max(lead, 1), max(trail, 1)}):
        near = materialize(_neighbours(marks, width), "anchor-cells")
        hit = F.col("__in")
        if width == max(trail, 1):
            hit = hit | F.coalesce(
                (F.col("__own_first") <= at) | (at - F.col("__previous") <= F.lit(trail)), F.lit(False)
            )
        if width == max(lead, 1):
            hit = hit | F.coalesce(
                (F.col("__own_last") >= at) | (F.col("__following") - at <= F.lit(lead)), F.lit(False)
            )
        rows = rows.withColumn("__cell", _cell(at, width))
        on = (F.col(key) == F.col("__near_key")) & (F.col("__cell") == F.col("__near_cell"))
        if fits_broadcast(near, BROADCAST_ROWS):
            joined = rows.join(F.broadcast(near), on, "left")
        else:
            spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in log.columns)), F.lit(SALTS))
            salted = near.withColumn("__near_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            on = on & (F.col("__salt") == F.col("__near_salt"))
            joined = rows.withColumn("__salt", spread).join(salted, on, "left")
        rows = joined.withColumn("__in", hit).select(*(F.col(f"`{c}`") for c in log.columns), "__us", "__in")
    return rows.filter("__in").drop("__us", "__in")
