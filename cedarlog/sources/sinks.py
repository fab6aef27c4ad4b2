"""Text outputs of a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cedarlog.functions.text import squash
from cedarlog.operators.search import to_json_lines


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated lines; every file starts with the header.

    Values hold no tab or line end once squashed, so nothing needs quoting.
    """
    shown = df.select(*(squash(F.col(f"`{c}`")).alias(c) for c in df.columns))
    shown.write.options(
        sep="\t",
        header=True,
        quote="",
        escapeQuotes=False,
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """The stored records, one per line, no header."""
    to_json_lines(df).write.text(path)
