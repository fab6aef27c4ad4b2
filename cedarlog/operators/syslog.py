"""syslog-ng JSON lines to syslog rows, with rejects set aside."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cedarlog.functions import records
from cedarlog.functions.once import with_once
from cedarlog.functions.text import canonical_ip, digits_to, is_blank, is_ip, let
from cedarlog.operators import rules as rule_ops
from cedarlog.schemas import SYSLOG_REQUIRED


class Split(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def _is_intact(line: Column) -> Column:
    """True when the line is one JSON value and nothing else.

    A lenient JSON reader stops after the first value of a line. The line is
    therefore read between brackets with a check value behind it: anything that
    follows the record shows up as a failure or a displaced check value.
    """
    check = F.xxhash64(line)
    wrapped = F.try_parse_json(F.concat(F.lit("["), line, F.lit(","), check.cast("string"), F.lit("]")))
    return F.coalesce(F.try_variant_get(wrapped, "$[1]", "bigint") == check, F.lit(False))


def _moment(value: Column) -> Column:
    """A time with a whole date; a bare cast would also read "10:30" as today's."""
    return F.when(value.rlike(r"\A\s*[0-9]{4,6}-[0-9]{1,2}-[0-9]{1,2}(?:[ T].*)?\z"), value.try_cast("timestamp"))


def _reject_reason(line: Column) -> Column:
    """Why a line is not stored, NULL when it is; checks go from outside in."""

    def member(key: str) -> Column:
        return F.col(f"__record.{key}")

    checks = [
        (~F.is_valid_utf8(line), F.lit("not valid UTF-8")),
        (~F.col("__intact"), F.lit("not valid JSON")),
        (~records.is_object(line), F.lit("not a JSON object")),
    ]
    checks += [(member(key).isNull(), F.lit(f"{key} is missing")) for key in SYSLOG_REQUIRED]
    checks += [(F.col(f"__times.{key}").isNull(), F.lit(f"{key} is not a time")) for key in SYSLOG_REQUIRED[:3]]
    checks.append((~is_ip(member("SOURCEIP")), F.lit("SOURCEIP is not an address")))
    reason = F.when(*checks[0])
    for check, text in checks[1:]:
        reason = reason.when(check, text)
    return reason


def _has_repeated_key(line: Column, block: Column) -> Column:
    """A key twice in the record or in its enriched block, so that a field would have two values."""

    def repeats(object_text: Column) -> Column:
        differ = let(F.json_object_keys(object_text), lambda keys: F.size(keys) != F.size(F.array_distinct(keys)))
        return F.coalesce(differ, F.lit(False))

    return repeats(line) | repeats(block)


def parse_syslog(lines: DataFrame, line: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """One row per non-blank line: the syslog columns plus ``reject_reason``.

    ``reject_reason`` is NULL for a good row. ``raw`` keeps the line verbatim,
    except that of a key repeated in the record or its enriched block the last one is stored.
    ``keep`` names further columns of ``lines`` to carry along.
    """
    text = F.col(line)
    checked = with_once(lines.filter(~is_blank(text)), "__intact", _is_intact(text))
    extracted = with_once(checked, "__record", records.text_members(text, *SYSLOG_REQUIRED, "PID", "enriched"))
    times = F.struct(*(_moment(F.col(f"__record.{k}")).alias(k) for k in SYSLOG_REQUIRED[:3]))
    dated = with_once(extracted, "__times", times)
    judged = with_once(dated, "reject_reason", _reject_reason(text))
    repeated = with_once(judged, "__repeated", _has_repeated_key(text, F.col("__record.enriched")))
    address = F.col("__record.SOURCEIP")
    return repeated.select(
        *keep,
        *(F.col(f"__times.{k}").alias(k.lower()) for k in SYSLOG_REQUIRED[:3]),
        *(F.col(f"__record.{k}").alias(k.lower()) for k in ("FACILITY", "HOST", "HOST_FROM")),
        digits_to(F.col("__record.PID"), "bigint").alias("pid"),
        *(F.col(f"__record.{k}").alias(k.lower()) for k in ("PRIORITY", "PROGRAM")),
        F.when(address.contains(":") & is_ip(address), canonical_ip(address)).otherwise(address).alias("sourceip"),
        F.when(F.col("reject_reason").isNull() & F.col("__repeated"), records.canonical(text)).otherwise(text).alias("raw"),
        "reject_reason",
    )


def split_rejects(parsed: DataFrame) -> Split:
    """Good rows without the reason column; bad lines with it."""
    return Split(
        parsed.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        parsed.filter(F.col("reject_reason").isNotNull()).select("raw", "reject_reason"),
    )


def ingest_syslog(
    lines: DataFrame,
    rules: Sequence[rule_ops.Rule] = (),
    line: str = "value",
    ranges: DataFrame | None = None,
    counts: Observation | None = None,
) -> DataFrame:
    """Parse, leave rejects out, enrich: the rows that would be stored.

    ``counts`` observes ``ingested`` and ``total`` while the rows are used, so that
    rejects do not go unnoticed; :func:`split_rejects` gives the rejected lines.
    """
    parsed = parse_syslog(lines, line)
    if counts is not None:
        accepted = F.count_if(F.col("reject_reason").isNull())
        parsed = parsed.observe(counts, accepted.alias("ingested"), F.count(F.lit(1)).alias("total"))
    return rule_ops.enrich(split_rejects(parsed).accepted, rules, ranges=ranges)


def ingest_report(parsed: DataFrame) -> DataFrame:
    """One row: lines that were ingested, of how many non-blank ones."""
    return parsed.agg(
        F.count_if(F.col("reject_reason").isNull()).alias("ingested"), F.count("*").alias("total")
    )
