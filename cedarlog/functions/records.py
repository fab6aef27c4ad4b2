"""Reading and rewriting the stored JSON record."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_text(value: Column, *path: str) -> Column:
    """The value at a path of literal keys as text; NULL when absent or null."""
    return F.get_json_object(value, "$" + "".join(f"['{key}']" for key in path))


def message(raw: Column) -> Column:
    return json_text(raw, "MESSAGE")


def text_members(raw: Column, *keys: str) -> Column:
    """Several top-level values as text, in one struct and one pass over the record."""
    schema = T.StructType([T.StructField(key, T.StringType()) for key in keys])
    return F.from_json(raw, schema, {"allowSingleQuotes": "false"})


def record(raw: Column) -> Column:
    return F.try_parse_json(raw)


def enriched_value(raw: Column, key: str) -> Column:
    """The enriched field as canonical JSON: strings quoted, numbers bare."""
    return F.to_json(F.try_variant_get(record(raw), f'$.enriched["{key}"]', "variant"))


def enriched_text(raw: Column, key: str) -> Column:
    """The enriched field as text, NULL when missing or null."""
    return json_text(raw, "enriched", key)


def enriched_block(raw: Column) -> Column:
    """The whole enriched block as canonical JSON, NULL when there is none."""
    return F.to_json(F.try_variant_get(record(raw), "$.enriched", "variant"))


def json_literal(value: str) -> Column:
    """The JSON string for ``value``, in the spelling :func:`enriched_value` uses."""
    return F.to_json(F.parse_json(F.lit(json.dumps(value))))


def json_numbers(text: str) -> list[Column]:
    """Every spelling :func:`enriched_value` can give a number equal to ``text``."""
    spellings = [text, f"{text}e0"]
    if float(text) == 0:
        spellings.append("-0e0")
    return [F.to_json(F.parse_json(F.lit(s))) for s in spellings]


def canonical(raw: Column) -> Column:
    """Sorted keys, no padding, last duplicate kept."""
    return F.to_json(record(raw))


def with_member(obj: Column, key: str, value: Column) -> Column:
    """``obj`` (JSON object text) with ``key`` set to ``value``, which goes last.

    Only an object that may hold the key already is parsed and written anew:
    parsing keeps the last of two equal keys.
    """
    blank = F.lit(" \t\r\n")
    trimmed = F.rtrim(obj, blank)
    opened = F.rtrim(F.left(trimmed, F.length(trimmed) - 1), blank)
    comma = F.when(opened.endswith("{"), "").otherwise(",")
    joined = F.concat(opened, comma, F.lit(f"{json.dumps(key)}:"), value, F.lit("}"))
    return F.when(may_hold(obj, key), canonical(joined)).otherwise(joined)


def may_hold(raw: Column, key: str) -> Column:
    """A cheap test that no record with the key, at whatever depth, fails.

    A key can also be written with ``\\u`` escapes; such records are let through.
    """
    return raw.contains(f'"{key}"') | raw.contains("\\u")


def without_member(obj: Column, key: str) -> Column:
    """``obj`` without one top-level key, canonical; NULL when not an object."""
    members = F.try_variant_get(record(obj), "$", "map<string,variant>")
    return F.to_json(F.map_filter(members, lambda k, _: k != F.lit(key)))


def is_object(raw: Column) -> Column:
    """For text already known to be JSON: is it an object?"""
    return raw.rlike(r"\A\s*\{")


def _magnitude(number: Column) -> Column:
    """(power of ten, digits without outer zeros) of a JSON number's text; they sort as the absolute values do."""
    parts = [F.regexp_extract(number, r"\A-?([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?\z", k) for k in (1, 2, 3)]
    every = F.concat(parts[0], parts[1])
    digits = F.ltrim(every, F.lit("0"))
    power = F.length(parts[0]) + F.coalesce(parts[2].try_cast("int"), F.lit(0)) - (F.length(every) - F.length(digits))
    return F.struct(F.when(digits == "", F.lit(0)).otherwise(power).alias("power"), F.rtrim(digits, F.lit("0")).alias("digits"))


def _sign(number: Column, magnitude: Column) -> Column:
    return F.when(magnitude["digits"] == "", 0).when(number.startswith("-"), -1).otherwise(1)


def compare_numbers(ours: Column, theirs: Column) -> Column:
    """-1, 0 or 1 as one JSON number is below, equal to or above another, by all their digits."""
    a, b = _magnitude(ours), _magnitude(theirs)
    side, other = _sign(ours, a), _sign(theirs, b)
    by_digits = side * F.when(a > b, 1).when(a < b, -1).otherwise(0)
    return F.when(side > other, 1).when(side < other, -1).otherwise(by_digits)
