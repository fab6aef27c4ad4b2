"""Search predicates: column, message, enriched-field and time-window filters.

Every filter becomes one Column; all of them are AND-ed. Wrong arguments raise
``ValueError`` while the plan is built, before any job runs.
"""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Collection, Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cedarlog.functions import records
from cedarlog.functions.args import FieldFilter, like_pattern, looks_numeric, parse_duration, parse_field
from cedarlog.functions.patterns import java_pattern
from cedarlog.functions.text import canonical_ip, is_ip
from cedarlog.operators import promote
from cedarlog.schemas import Source, source, time_column

# Columns whose filter takes % as a wildcard.
WILDCARD_COLUMNS = ("program", "host")

# Columns that hold addresses, each in its one spelling.
ADDRESS_COLUMNS = ("client_ip",)

_COMPARE = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def column_filter(src: Source, name: str, value: str) -> Column:
    if name not in src.filters:
        raise ValueError(f"{name} is not a filter of {src.name}; it has {', '.join(src.filters)}")
    column = F.col(name)
    dtype = src.schema[name].dataType.simpleString()
    if dtype == "int":
        return column == F.lit(int(value))
    if name in WILDCARD_COLUMNS and "%" in value:
        return column.like(like_pattern(value))
    if name in ADDRESS_COLUMNS:
        return column == F.when(is_ip(F.lit(value)), canonical_ip(F.lit(value))).otherwise(F.lit(value))
    return column == F.lit(value)


def message_filter(text: str) -> Column:
    """Case-insensitive substring; % and _ inside the text stay wildcards."""
    return records.message(F.col("raw")).ilike(like_pattern(f"%{text}%"))


def _numeric_compare(op: str, json_value: Column, value: str) -> Column:
    """Compare JSON numbers only; a quoted string never casts to a number.

    Doubles decide unless they are equal; then the digits do, however many there are.
    """
    compare = _COMPARE[op]
    number, limit = json_value.try_cast("double"), F.lit(float(value))
    return F.when(number == limit, compare(records.compare_numbers(json_value, F.lit(value)), F.lit(0))).otherwise(compare(number, limit))


def _promoted_compare(op: str, key: str, value: str) -> Column:
    """The same by a field's own columns; its JSON text is read only for a value that no double equals."""
    number, limit = promote.number_column(key), F.lit(float(value))
    beyond = number > limit if op[0] == ">" else number < limit
    if Fraction(value) == Fraction(float(value)) == Fraction(repr(float(value))):
        return beyond | ((number == limit) & _COMPARE[op](promote.rest_column(key), F.lit(0)))
    return beyond | ((number == limit) & _COMPARE[op](records.compare_numbers(promote.json_column(key), F.lit(value)), F.lit(0)))


def field_filter(field: FieldFilter, promoted: Collection[str] = ()) -> Column:
    """One enriched-field predicate.

    ``=`` matches a JSON string, or for a numeric value also an equal JSON number;
    ``!=`` and ``<>`` count a missing field as different; ``~`` and ``!~`` are
    patterns of the advanced POSIX dialect; ``=~`` is a case-insensitive substring; the ordering
    operators compare JSON numbers for a numeric value and text otherwise.
    Fields in ``promoted`` are read from their own columns.
    """
    key, op, value = field
    raw = F.col("raw")
    has_columns = key in promoted
    text = promote.text_column(key) if has_columns else records.enriched_text(raw, key)
    json_value = promote.json_column(key) if has_columns else records.enriched_value(raw, key)

    if op in ("!=", "<>"):
        return ~text.eqNullSafe(F.lit(value))
    if op == "=":
        accepted = [records.json_literal(value)]
        if looks_numeric(value):
            accepted += records.json_numbers(value)
        test = json_value.isin(*accepted)
    elif op == "~":
        test = text.rlike(java_pattern(value))
    elif op == "!~":
        test = ~text.rlike(java_pattern(value))
    elif op == "=~":
        test = text.ilike(like_pattern(f"%{value}%"))
    elif looks_numeric(value):
        test = _numeric_compare(op, json_value, value)
        if has_columns:
            # Rounding to double keeps order, so this bound loses no row, and it reaches the scan.
            loose = _COMPARE[op[0] + "="]
            test = loose(promote.number_column(key), F.lit(float(value))) & _promoted_compare(op, key, value)
    else:
        test = _COMPARE[op](text, F.lit(value))
    return test if has_columns else records.may_hold(raw, key) & test


def window_filter(src: Source, since: str, as_of: dt.datetime, column: str | None = None) -> Column:
    """Rows whose time is within ``since`` before ``as_of``; a NULL time is out."""
    cutoff = as_of - parse_duration(since)
    return F.col(time_column(src, column)) >= timestamp(cutoff)


def timestamp(moment: dt.datetime) -> Column:
    """A UTC instant; a naive value is taken as UTC."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ") + "+00:00").cast("timestamp")


def day_filter(src: Source, since: str, as_of: dt.datetime, column: str | None = None) -> Column | None:
    """The partition bound a receipt-time window implies, None for other columns."""
    if time_column(src, column) != "r_isodate":
        return None
    cutoff = as_of - parse_duration(since)
    return F.col("day") >= F.to_date(timestamp(cutoff))


def build_filter(
    source_name: str,
    *,
    message: str | None = None,
    field: str | Sequence[str] = (),
    since: str | None = None,
    column: str | None = None,
    as_of: dt.datetime | None = None,
    promoted: Collection[str] = (),
    partitioned: bool = False,
    **columns: str | None,
) -> Column:
    """All given filters as one predicate; no filter at all is ``true``.

    ``columns`` are exact matches on the source's filterable columns. ``since``
    needs ``as_of``. ``partitioned`` says the rows come from a store with a
    ``day`` partition, so that a receipt-time window can prune it.
    """
    src = source(source_name)
    time_column(src, column)
    parts = [
        column_filter(src, name, value) for name, value in sorted(columns.items()) if value is not None
    ]
    if since is not None:
        if as_of is None:
            raise ValueError("since needs as_of")
        if partitioned:
            bound = day_filter(src, since, as_of, column)
            parts += [bound] if bound is not None else []
        parts.append(window_filter(src, since, as_of, column))
    for text in [field] if isinstance(field, str) else field:
        parts.append(field_filter(parse_field(text), promoted))
    if message is not None:
        parts.append(message_filter(message))
    return reduce(operator.and_, parts, F.lit(True)) if parts else F.lit(True)
