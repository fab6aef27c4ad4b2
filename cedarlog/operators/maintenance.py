"""Retention and re-enrichment as pure DataFrame steps.

The store (:mod:`cedarlog.sources.store`) applies them to its files.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.functions import records
from cedarlog.functions.args import parse_duration
from cedarlog.functions.once import with_once
from cedarlog.operators import rules as rule_ops
from cedarlog.operators.filters import timestamp, window_filter
from cedarlog.operators.ids import nth_id
from cedarlog.schemas import source, time_column


def expired(source_name: str, older_than: str, as_of: dt.datetime, column: str | None = None) -> Column:
    """True for rows past the age; receipt time counts unless told otherwise.

    A row without that time is never expired.
    """
    if older_than is None:
        raise ValueError("older_than is required, e.g. 90d")
    cutoff = as_of - parse_duration(older_than)
    time = F.col(time_column(source(source_name), column, "r_isodate"))
    return F.coalesce(time < timestamp(cutoff), F.lit(False))


def prune_survivors(df: DataFrame, source_name: str, older_than: str, as_of: dt.datetime, column: str | None = None):
    return df.filter(~expired(source_name, older_than, as_of, column))


def prune_dry_run(df: DataFrame, source_name: str, older_than: str, as_of: dt.datetime, column: str | None = None):
    """One row: how many rows would go."""
    return df.agg(F.count_if(expired(source_name, older_than, as_of, column)).alias("would_delete"))


def reenrich_scope(
    since: str | None = None,
    program: str | None = None,
    everything: bool = False,
    column: str | None = None,
    as_of: dt.datetime | None = None,
) -> Column:
    """Which syslog rows to scan; refuses the whole table unless told so."""
    src = source("syslog")
    column = time_column(src, column, "r_isodate")
    scope = F.lit(True)
    if since is not None:
        if as_of is None:
            raise ValueError("since needs as_of")
        scope = scope & window_filter(src, since, as_of, column)
    if program is not None:
        scope = scope & (F.col("program") == F.lit(program))
    if since is None and program is None and not everything:
        raise ValueError("refusing to scan the whole table; give since or program, or everything=True")
    return scope


def limited(df: DataFrame, limit: int | None) -> Column:
    """The first ``limit`` rows by id; as the limit is tested after a row, 0 means 1."""
    if limit is None:
        return F.lit(True)
    last = nth_id(df.select("id"), max(limit, 1))
    return F.lit(True) if last is None else F.col("id") <= F.lit(last)


def reenrich(df: DataFrame, rules: Sequence[rule_ops.Rule], scope: Column | None = None) -> DataFrame:
    """Re-run the rules: add ``scanned``, ``changed``, ``new_raw``.

    The old block is dropped first, so a row no rule matches any longer loses it.
    Rows that are out of scope or not JSON objects stay as they are.
    """
    raw = F.col("raw")
    in_scope = F.coalesce(scope if scope is not None else F.lit(True), F.lit(False))
    scanned = df.withColumn("scanned", in_scope)
    usable = F.col("scanned") & records.is_object(raw) & records.record(raw).isNotNull()
    matched = rule_ops.with_captures(with_once(scanned, "__usable", F.when(usable, raw)), rules, "__usable")
    old_new = F.struct(
        records.enriched_block(F.col("__usable")).alias("old"),
        records.canonical(rule_ops.fields_json(F.col("__caps"), rules)).alias("new"),
    )
    compared = with_once(matched, "__blocks", old_new)
    old, new = F.col("__blocks.old"), F.col("__blocks.new")
    changed = F.col("__usable").isNotNull() & ~old.eqNullSafe(new)
    rebuilt = F.when(new.isNotNull(), records.with_member(raw, "enriched", new)).otherwise(
        records.without_member(raw, "enriched")
    )
    return (
        compared.withColumn("changed", changed)
        .withColumn("new_raw", F.when(F.col("changed"), rebuilt).otherwise(raw))
        .drop("__usable", "__caps", "__blocks")
    )


def reenrich_report(done: DataFrame) -> DataFrame:
    """One row: rows scanned and rows (that would be) changed."""
    return done.agg(F.count_if("scanned").alias("scanned"), F.count_if("changed").alias("changed"))
