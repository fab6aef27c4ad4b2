"""Text, number, time and address expressions for log fields."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A control character that separates captured groups; lines holding it take the
# slower extraction path in :func:`capture`.
_SEP = "\x01"

# The English month abbreviations used in web-server logs.
_MONTHS = {
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06",
    "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"\A(?:{_OCTET}\.){{3}}{_OCTET}\z"
_HEX_RUN = r"(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*)?"


def is_blank(line: Column) -> Column:
    """True for a line of nothing but whitespace."""
    return ~line.rlike(r"\S")


def digits_to(value: Column, dtype: str) -> Column:
    """A run of ASCII digits as ``dtype``; anything else, or out of range, is NULL.

    The digit check comes first because a bare cast also takes blanks and signs.
    """
    return F.when(value.rlike(r"\A[0-9]+\z"), value.try_cast(dtype))


def squash(value: Column) -> Column:
    """NULL becomes empty, each run of CR, LF or TAB becomes one space."""
    return F.coalesce(F.regexp_replace(value.cast("string"), r"[\r\n\t]+", " "), F.lit(""))


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def capture(value: Column, pattern: str, groups: int, tag: str = "") -> Column:
    """``[tag, group 1, ..., group n]`` of the first match, NULL without a match.

    One test and one rewrite of the text, however many groups there are. A group
    that took no part in the match is an empty string.
    """
    whole = rf"\A(?s:.*?)(?:{pattern})(?s:.*)\z"
    joined = _SEP.join([tag, *(f"${n}" for n in range(1, groups + 1))])
    fast = F.split(F.regexp_replace(value, whole, joined), _SEP, -1)
    slow = F.array(F.lit(tag), *(F.regexp_extract(value, pattern, n) for n in range(1, groups + 1)))
    return F.when(value.rlike(pattern), F.when(value.contains(_SEP), slow).otherwise(fast))


def captured_by(value: Column, number: Column, patterns: Sequence[tuple[str, int]]) -> Column:
    """As :func:`capture` by the pattern of that number, which matches; the tag is the number.

    Patterns, given with their numbers of groups, are looked up, so that there is one rewrite in the plan.
    """

    def table(texts: list) -> Column:
        return F.get(F.from_json(F.lit(json.dumps(texts)), "array<string>"), number)

    whole = table([rf"\A(?s:.*?)(?:{pattern})(?s:.*)\z" for pattern, _ in patterns])
    joined = table([_SEP.join([str(at), *(f"${n}" for n in range(1, groups + 1))]) for at, (_, groups) in enumerate(patterns)])
    fast = F.split(F.regexp_replace(value, whole, joined), _SEP, -1)
    own = table([pattern for pattern, _ in patterns])
    count = F.get(F.from_json(F.lit(json.dumps([groups for _, groups in patterns])), "array<int>"), number)
    most = max(groups for _, groups in patterns)
    each = [F.when(count >= n, F.call_function("regexp_extract", value, own, F.lit(n))) for n in range(1, most + 1)]
    slow = F.array(number.cast("string"), *each)
    return F.when(value.contains(_SEP), slow).otherwise(fast)


def _month(name: Column) -> Column:
    """``01`` .. ``12`` for a three-letter month in any case, else NULL."""
    numbers = F.create_map(*(F.lit(x) for pair in _MONTHS.items() for x in pair))
    return F.try_element_at(numbers, F.lower(name))


def access_time(value: Column) -> Column:
    """``10/Oct/2000:13:55:36 -0700`` as an instant; any other layout is NULL."""
    layout = r"\A[0-9]{2}/[A-Za-z]{3}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2}\s*[+-][0-9]{4}\z"
    zone = F.right(value, F.lit(5))
    iso = F.concat(
        F.substring(value, 8, 4),
        F.lit("-"),
        _month(F.substring(value, 4, 3)),
        F.lit("-"),
        F.substring(value, 1, 2),
        F.lit("T"),
        F.substring(value, 13, 8),
        F.substring(zone, 1, 3),
        F.lit(":"),
        F.right(zone, F.lit(2)),
    )
    return F.when(value.rlike(layout), iso.try_cast("timestamp"))


def error_time(value: Column) -> Column:
    """nginx and Apache error-log times, read in the session time zone.

    A fraction is kept; any other layout is NULL.
    """
    nginx = r"\A[0-9]{4}/[0-9]{2}/[0-9]{2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}\z"
    apache = (
        r"\A[A-Za-z]{3}\s+[A-Za-z]{3}\s+[0-9]{1,2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?\s+[0-9]{4}\z"
    )
    words = F.split(value, r"\s+")
    return F.when(
        value.rlike(nginx),
        F.concat(F.translate(F.substring(value, 1, 10), "/", "-"), F.lit("T"), F.right(value, F.lit(8))).try_cast(
            "timestamp"
        ),
    ).when(
        value.rlike(apache),
        F.concat(
            words[4], F.lit("-"), _month(words[1]), F.lit("-"), F.lpad(words[2], 2, "0"), F.lit("T"), words[3]
        ).try_cast("timestamp"),
    )


def is_ipv4(value: Column) -> Column:
    return value.rlike(_IPV4)


def is_ip(value: Column) -> Column:
    """A dotted IPv4 address, or an IPv6 one with or without ``::``."""
    plain = F.regexp_replace(value, rf":(?:0*{_OCTET}\.){{3}}0*{_OCTET}\z", ":0:0")
    colons = F.length(plain) - F.length(F.replace(plain, F.lit(":"), F.lit("")))
    full = plain.rlike(r"\A[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}\z")
    short = plain.rlike(rf"\A{_HEX_RUN}::{_HEX_RUN}\z") & (colons <= 7)
    return is_ipv4(value) | (value.contains(":") & (full | short))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once and written into the plan once."""
    return F.get(F.transform(F.array(value), body), 0)


def _hex_groups(v: Column) -> Column:
    """A dotted tail of an IPv6 address as two groups."""
    byte = [F.regexp_extract(v, r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)\z", k).try_cast("bigint") for k in range(1, 5)]
    pair = [F.lower(F.hex(byte[k] * 256 + byte[k + 1])) for k in (0, 2)]
    tail = F.concat(F.regexp_replace(v, r"[0-9.]+\z", ""), pair[0], F.lit(":"), pair[1])
    return F.when(v.contains("."), tail).otherwise(v)


def _all_groups(halves: Column) -> Column:
    """Eight groups without leading zeros, each between colons."""
    left, right = (F.filter(F.split(F.coalesce(F.get(halves, k), F.lit("")), ":"), lambda x: x != "") for k in (0, 1))
    known = F.size(F.filter(F.split(F.array_join(halves, ":"), ":"), lambda x: x != ""))
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - known, F.lit(0))), right)
    groups = F.transform(filled, lambda x: F.regexp_replace(x, r"\A0+(?=.)", ""))
    return F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":"))


def canonical_ip(value: Column) -> Column:
    """One spelling for each address: small letters, no leading zeros, the first longest run of zero groups as ``::``.

    Only for text that :func:`is_ip` accepts; IPv4 stays as it is.
    """

    def shortened(text: Column) -> Column:
        runs = F.array(*(F.lit(":" + "0:" * n) for n in range(8, 1, -1)))
        longest = F.get(F.filter(runs, lambda zeros: text.contains(zeros)), 0)
        parts = let(longest, lambda zeros: let(F.instr(text, zeros), lambda at: F.struct(at.alias("at"), zeros.alias("zeros"))))
        return let(
            parts,
            lambda p: F.when(p["zeros"].isNull(), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(
                F.concat(
                    F.substring(text, F.lit(2), F.greatest(p["at"] - 2, F.lit(0))),
                    F.lit("::"),
                    F.substring(text, p["at"] + F.length(p["zeros"]), F.greatest(F.length(text) - p["at"] - F.length(p["zeros"]), F.lit(0))),
                )
            ),
        )

    whole = let(F.lower(value), lambda v: let(F.split(_hex_groups(v), "::"), lambda h: let(_all_groups(h), shortened)))
    return F.when(value.contains(":"), whole).otherwise(value)


def ipv4_number(value: Column) -> Column:
    """The address as a number, NULL for anything but IPv4."""
    part = F.split(value, r"\.")
    number = sum(
        (part[i].try_cast("bigint") * F.lit(256 ** (3 - i)) for i in range(1, 4)),
        part[0].try_cast("bigint") * F.lit(256**3),
    )
    return F.when(is_ipv4(value), number)


def address_bytes(value: Column) -> Column:
    """The address as 16 bytes, IPv4 within ``::ffff:0:0/96``; NULL for anything else."""
    dotted = F.split(value, r"\.")
    four = F.concat(F.lit("0" * 20 + "ffff"), *(F.lpad(F.hex(dotted[k].try_cast("bigint")), 2, "0") for k in range(4)))

    def sixteen(groups: Column) -> Column:
        return F.array_join(F.transform(F.filter(F.split(groups, ":"), lambda x: x != ""), lambda x: F.lpad(x, 4, "0")), "")

    six = let(F.lower(value), lambda v: let(F.split(_hex_groups(v), "::"), lambda h: let(_all_groups(h), sixteen)))
    return F.unhex(F.when(is_ipv4(value), four).when(is_ip(value), six))
