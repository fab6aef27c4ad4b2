"""Enriched fields as typed columns of their own.

A field that is searched often is copied out of the record into four columns: its
text, its number, what rounding to that number left (-1, 0, 1), and its JSON form. The
scan can then skip row groups by their minima and maxima, text also by bloom filters,
and need not read ``raw`` at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cedarlog.functions import records


def check_field(key: str) -> str:
    """Only word characters: stricter than searching, which also takes dots."""
    if not re.fullmatch(r"\w+", key, re.ASCII):
        raise ValueError(f"a promoted field must be word characters, got {key!r}")
    return key


def text_column(key: str) -> Column:
    return F.col(f"field_{key}_text")


def number_column(key: str) -> Column:
    return F.col(f"field_{key}_number")


def rest_column(key: str) -> Column:
    return F.col(f"field_{key}_rest")


def json_column(key: str) -> Column:
    return F.col(f"field_{key}_json")


def promoted_schema(fields: Iterable[str]) -> list[T.StructField]:
    out = []
    for key in fields:
        out += [
            T.StructField(f"field_{key}_text", T.StringType()),
            T.StructField(f"field_{key}_number", T.DoubleType()),
            T.StructField(f"field_{key}_rest", T.ByteType()),
            T.StructField(f"field_{key}_json", T.StringType()),
        ]
    return out


def promote_fields(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Add the four columns of each field."""
    fields = [check_field(key) for key in fields]
    raw = F.col("raw")
    with_json = df.withColumns({f"field_{key}_json": records.enriched_value(raw, key) for key in fields})
    return with_json.withColumns(
        {f"field_{key}_text": records.enriched_text(raw, key) for key in fields}
        | {f"field_{key}_number": json_column(key).try_cast("double") for key in fields}
    ).withColumns({f"field_{key}_rest": _rest(json_column(key), number_column(key)) for key in fields})


def _rest(json_value: Column, number: Column) -> Column:
    """The sign of a JSON number less the shortest text of its double.

    Numbers of at most 15 digits are told apart by their doubles, so most rows compare nothing.
    """
    beyond = records.compare_numbers(json_value, number.cast("string")).cast("tinyint")
    plain = (F.length(json_value) <= 15) & F.abs(number).between(1e-290, 1e290)
    return F.when(number.isNull(), None).when(plain, F.lit(0).cast("tinyint")).otherwise(beyond)


def bloom_filters(writer: DataFrameWriter, fields: Iterable[str]) -> DataFrameWriter:
    """Let the files say which texts of the fields they do not hold."""
    for key in fields:
        for kind in ("text", "json"):
            writer = writer.option(f"parquet.bloom.filter.enabled#field_{key}_{kind}", "true")
    return writer
