"""Input rows beside helper columns: whole rows in one struct, so that no name of theirs can clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(docs: DataFrame) -> Column:
    """All columns of a row as the struct ``row``; ``select("row.*")`` gives them back."""
    return F.struct(*(column(c) for c in docs.columns)).alias("row")


def column(name: str) -> Column:
    return F.col(f"`{name}`")
