"""Costly expressions computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Like ``withColumn``, but ``value`` is never evaluated more than once per row.

    The optimizer copies a projected expression into each filter and expression
    above that uses it, so a JSON parse or a pattern match could run many times.
    What a generator puts out is not copied; unnesting a one-element array keeps
    the rows as they are. The value is computed by a projection below, which is
    compiled in parts where a stage is too long to be fused; a generator itself
    would be interpreted there.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    computed = df.select(*others, value.alias("__once"))
    return computed.select(*others, F.explode(F.array("__once")).alias(name))
