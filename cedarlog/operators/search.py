"""Newest-N search, tail, cursor reads and row display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.functions import records
from cedarlog.functions.args import positive_or
from cedarlog.functions.text import squash
from cedarlog.operators.filters import build_filter
from cedarlog.schemas import source, time_column


def search(df: DataFrame, source_name: str, *, limit: int | None = 20, asc: bool = False, **filters) -> DataFrame:
    """The newest (or oldest) matching rows by id, never by time."""
    order = F.col("id").asc() if asc else F.col("id").desc()
    return df.filter(build_filter(source_name, **filters)).orderBy(order).limit(positive_or(limit, 20))


def tail(df: DataFrame, source_name: str, *, lines: int | None = 10, **filters) -> DataFrame:
    """The last matching rows, oldest of them first."""
    return search(df, source_name, limit=positive_or(lines, 10), **filters).orderBy("id")


def after(df: DataFrame, source_name: str, last: int, **filters) -> DataFrame:
    """Matching rows past a cursor, in id order."""
    return df.filter(F.col("id") > F.lit(last)).filter(build_filter(source_name, **filters)).orderBy("id")


def display(df: DataFrame, source_name: str, column: str | None = None, with_id: bool = False) -> DataFrame:
    """The columns a source shows, under their shown names."""
    src = source(source_name)

    def shown(name: str) -> Column:
        return records.message(F.col("raw")) if name == "raw.MESSAGE" else F.col(name)

    lead = [F.col("id")] if with_id else []
    when = F.col(time_column(src, column)).alias("time")
    return df.select(*lead, when, *(shown(name).alias(label) for label, name in src.display))


def to_tsv(df: DataFrame) -> DataFrame:
    """One tab-separated line per row, column ``line``."""
    return df.select(F.concat_ws("\t", *(squash(F.col(f"`{c}`")) for c in df.columns)).alias("line"))


def tsv_header(df: DataFrame) -> str:
    return "\t".join(df.columns)


def to_json_lines(df: DataFrame) -> DataFrame:
    """The stored record only, column ``line``."""
    return df.select(F.col("raw").alias("line"))
