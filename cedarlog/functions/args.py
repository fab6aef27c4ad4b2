"""Argument texts checked on the driver while a plan is built."""

from __future__ import annotations

import datetime as dt
import re
from typing import NamedTuple

# The accepted forms of a duration, a field filter and a number.
_DURATION = re.compile(r"([0-9]+)(?:\s*([smhdw]))?", re.IGNORECASE | re.ASCII)
_FIELD = re.compile(r"([\w.]+)\s*(!=|>=|<=|<>|=~|!~|~|>|<|=)\s*(.*)", re.DOTALL | re.ASCII)
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?")
_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


class FieldFilter(NamedTuple):
    key: str
    op: str
    value: str


def parse_duration(text: str | int) -> dt.timedelta:
    """``90`` and ``90d`` are days; ``s m h d w`` in either case are units."""
    found = _DURATION.fullmatch(str(text))
    if not found:
        raise ValueError(f"cannot read {text!r} as a time span: digits, then s, m, h, d or w (d if left out)")
    amount, unit = found.groups()
    return dt.timedelta(**{_UNITS[(unit or "d").lower()]: int(amount)})


def parse_field(text: str) -> FieldFilter:
    """Split ``key<op>value``; the first operator after the key counts."""
    found = _FIELD.fullmatch(text)
    if not found:
        raise ValueError(f"no field test in {text!r}: write a key, a comparison (= != <> > < >= <= ~ !~ =~), a value")
    return FieldFilter(*found.groups())


def looks_numeric(text: str) -> bool:
    """An optionally negative integer or decimal without leading zeros."""
    return _NUMBER.fullmatch(text) is not None


def like_pattern(text: str) -> str:
    """Keep only the escapes Spark's LIKE accepts, with the same meaning.

    A backslash makes the next character literal whatever it is; Spark allows it
    only before a wildcard or another backslash.
    """
    out = []
    chars = iter(text)
    for ch in chars:
        if ch != "\\":
            out.append(ch)
            continue
        escaped = next(chars, None)
        if escaped is None:
            raise ValueError(f"pattern must not end with an escape character: {text!r}")
        out.append(escaped if escaped not in "%_\\" else "\\" + escaped)
    return "".join(out)


def positive_or(value: int | None, default: int) -> int:
    """Row limits that are missing or not positive fall back to the default."""
    return value if value is not None and value > 0 else default
