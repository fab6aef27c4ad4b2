"""Enrichment rules: program-gated patterns whose captures become fields.

A rule list is plain data. It compiles to one pass over the message: the first
rule, in list order, whose gate and pattern both match supplies the fields.

Of more than ``MANY`` rules a row tries candidates only. Gates that ask for a beginning
of PROGRAM sort rows into branches by that beginning, and a pattern is tried where the
message holds the longest text the pattern cannot do without. What a rule captures and
how it is written is then looked up by the rule's number, so the plan does not grow with
each rule's fields.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.functions import records
from cedarlog.functions.once import with_once
from cedarlog.functions.text import capture, captured_by, digits_to, empty_to_null
from cedarlog.operators.geo import places

_CAPS = "__caps"


@dataclass(frozen=True)
class Field:
    """One capture group and the JSON type its text is stored as.

    ``ip`` marks an address that is geolocated when ranges are at hand.
    """

    name: str
    group: int
    type: str = "string"
    ip: bool = False


@dataclass(frozen=True)
class Rule:
    """``gate`` is a pattern for PROGRAM (None: any, even none); ``pattern`` for MESSAGE."""

    name: str
    pattern: str
    fields: tuple[Field, ...]
    gate: str | None = None

    @property
    def groups(self) -> int:
        return max(field.group for field in self.fields)


SSHD = (
    Rule(
        name="sshd",
        gate=r"\Asshd",
        pattern=r"^(?:Failed|Accepted) \S+ for (?:invalid user )?(\S+) from (\S+) port ([0-9]+)",
        fields=(Field("ssh_user", 1), Field("ssh_src_ip", 2, ip=True), Field("ssh_src_port", 3, "long")),
    ),
    Rule(
        name="sshd_invalid_user",
        gate=r"\Asshd",
        pattern=r"^Invalid user (\S*) from (\S+) port ([0-9]+)",
        fields=(Field("ssh_user", 1), Field("ssh_src_ip", 2, ip=True), Field("ssh_src_port", 3, "long")),
    ),
    Rule(
        name="sshd_disconnect",
        gate=r"\Asshd",
        pattern=r"^(?:Connection closed|Disconnected|Received disconnect)"
        r"(?: (?:by|from))?(?: (?:authenticating|invalid))?(?: user (\S+))? ([0-9a-fA-F.:]+) port ([0-9]+)",
        fields=(Field("ssh_user", 1), Field("ssh_src_ip", 2, ip=True), Field("ssh_src_port", 3, "long")),
    ),
)


#: Rules up to which each is written into the plan on its own.
MANY = 16
#: Rules without a fixed beginning of PROGRAM that each branch repeats at most.
_COMMON = 32
_SPECIAL = frozenset(".^$*+?{}[]()|\\")


def literal_runs(pattern: str) -> list[tuple[int, str]]:
    """(place, text) of the stretches of a pattern that every match holds as they stand.

    Only what is outside of groups and brackets counts; a pattern with alternatives or
    with options of its own has none.
    """
    out, run, start, depth, at = [], "", 0, 0, 0

    def end() -> None:
        nonlocal run
        if run:
            out.append((start, run))
        run = ""

    while at < len(pattern):
        c, size = pattern[at], 1
        if c == "\\":
            size = 2
            escaped = pattern[at + 1 : at + 2]
            c = escaped if escaped and not escaped.isalnum() else None
        elif c == "[":
            close = at + 1 + (pattern[at + 1 : at + 2] == "^")
            close += pattern[close : close + 1] == "]"
            while close < len(pattern) and pattern[close] != "]":
                if pattern[close] == "[":
                    return []  # classes within classes
                close += 1 + (pattern[close] == "\\")
            c, size = None, close + 1 - at
        elif c in "()":
            depth += 1 if c == "(" else -1
            if re.match(r"\(\?[a-zA-Z-]+[:)]", pattern[at:]):
                return []
            c = None
        elif c == "{":
            close = pattern.find("}", at)
            c, size = None, (close + 1 - at if close > at else 1)
        elif c == "|" and not depth:
            return []
        elif c in _SPECIAL or c in "#":
            c = None
        after = pattern[at + size : at + size + 1]
        if depth or c is None or after in ("*", "?", "{"):
            end()
        else:
            if not run:
                start = at
            run += c
            if after == "+":
                end()
        at += size
    end()
    return out


def _beginning(gate: str | None) -> tuple[str, bool]:
    """(what PROGRAM must begin with, whether that is all the gate asks for)."""
    for anchor in (r"\A", "^"):
        if gate and gate.startswith(anchor):
            for at, run in literal_runs(gate)[:1]:
                if at == len(anchor):
                    return run, gate[at:] == run
    return "", False


def _tried(message: Column, program: Column | None, rule: Rule) -> Column:
    """Whether a rule matches, the cheap tests first."""
    tests = []
    if rule.gate is not None:
        if program is None:
            return F.lit(False)
        begins, enough = _beginning(rule.gate)
        tests += [program.startswith(begins)] if begins else []
        tests += [] if enough else [program.rlike(rule.gate)]
    held = max((run for _, run in literal_runs(rule.pattern)), key=len, default="")
    tests += [message.contains(held)] if len(held) > 1 else []
    return reduce(Column.__and__, [*tests, message.rlike(rule.pattern)])


def _first_of_many(message: Column, program: Column | None, rules: Sequence[Rule]) -> Column:
    """The number of the first matching rule, by branches of how PROGRAM begins."""
    begins = [_beginning(rule.gate)[0] for rule in rules]

    def first(numbers: Sequence[int]) -> Column:
        return F.coalesce(*(F.when(_tried(message, program, rules[n]), F.lit(n)) for n in numbers), F.lit(None).cast("int"))

    if program is None or begins.count("") > _COMMON:
        return first(range(len(rules)))
    branches = sorted(set(begins) - {""}, key=lambda b: (-len(b), b))  # the longest first: it may go on from a shorter one
    otherwise = first([n for n, b in enumerate(begins) if not b])
    choice = None
    for branch in branches:
        own = first([n for n, b in enumerate(begins) if branch.startswith(b)])
        choice = (F if choice is None else choice).when(program.startswith(branch), own)
    return choice.otherwise(otherwise) if choice is not None else otherwise


def match(message: Column, program: Column | None, rules: Sequence[Rule]) -> Column:
    """``[rule position, group 1, ...]`` of the first matching rule, else NULL."""
    if len(rules) > MANY:
        position = F.array(_first_of_many(message, program, rules))
        return F.get(F.transform(position, lambda n: F.when(n.isNotNull(), captured_by(message, n, [(r.pattern, r.groups) for r in rules]))), 0)

    def attempt(at: int, rule: Rule) -> Column:
        caps = capture(message, rule.pattern, rule.groups, str(at))
        if rule.gate is None:
            return caps
        return F.when(program.rlike(rule.gate), caps) if program is not None else F.lit(None)

    return F.coalesce(*(attempt(at, rule) for at, rule in enumerate(rules)))


def field_value(caps: Column, field: Field) -> Column:
    return _typed(caps[field.group], field.type)


def _typed(text: Column, kind: str) -> Column:
    text = empty_to_null(text)
    if kind == "string":
        return text
    if kind == "long":
        return digits_to(text, "bigint")
    return text.try_cast(kind)


def _table(values: list, kind: str) -> Column:
    """A literal array, looked up by the number of a rule."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _fields_of_many(caps: Column, rules: Sequence[Rule]) -> Column:
    """As :func:`fields_json`, with names, groups and types looked up by the rule's number."""
    kinds = sorted({f.type for rule in rules for f in rule.fields})
    fields = [[{"n": json.dumps(f.name, ensure_ascii=False), "g": f.group, "t": f.type} for f in sorted(rule.fields, key=lambda f: f.name)] for rule in rules]
    own = F.get(_table(fields, "array<array<struct<n:string,g:int,t:string>>>"), caps[0].cast("int"))

    def member(f: Column) -> Column:
        text = F.get(caps, f["g"])
        written = F.coalesce(*(F.when(f["t"] == kind, F.to_json(F.struct(_typed(text, kind).alias("v")))) for kind in kinds))
        return F.when(written != "{}", F.concat(f["n"], F.lit(":"), F.substring(written, F.lit(6), F.length(written) - 6)))

    return F.concat(F.lit("{"), F.concat_ws(",", F.transform(own, member)), F.lit("}"))


def fields_json(caps: Column, rules: Sequence[Rule]) -> Column:
    """The matched rule's fields as a JSON object with sorted keys.

    Fields without a value are left out; a match without any value is NULL.
    """
    if len(rules) > MANY:
        return F.when(caps.isNotNull(), F.nullif(_fields_of_many(caps, rules), F.lit("{}")))

    def one(rule: Rule) -> Column:
        ordered = sorted(rule.fields, key=lambda f: f.name)
        return F.to_json(F.struct(*(field_value(caps, f).alias(f.name) for f in ordered)))

    choice = reduce(
        lambda chain, item: chain.when(caps[0] == str(item[0]), one(item[1])),
        list(enumerate(rules))[1:],
        F.when(caps[0] == "0", one(rules[0])),
    )
    return F.nullif(choice, F.lit("{}"))


def rule_name(caps: Column, rules: Sequence[Rule]) -> Column:
    return F.get(_table([rule.name for rule in rules], "array<string>"), caps[0].cast("int"))


def _address(caps: Column, rules: Sequence[Rule], name: str) -> Column:
    """The text of an address field, whichever rule matched."""
    if len(rules) > MANY:
        groups = [next((f.group for f in rule.fields if f.name == name), None) for rule in rules]
        return empty_to_null(F.get(caps, F.get(_table(groups, "array<int>"), caps[0].cast("int"))))
    texts = [F.when(caps[0] == str(at), field_value(caps, f)) for at, rule in enumerate(rules) for f in rule.fields if f.name == name]
    return F.coalesce(*texts)


def with_captures(df: DataFrame, rules: Sequence[Rule], raw: str = "raw") -> DataFrame:
    """Add ``__caps``, see :func:`match`; the record is read once for all rules."""
    read = with_once(df, "__parts", records.text_members(F.col(raw), "MESSAGE", "PROGRAM"))
    found = match(F.col("__parts.MESSAGE"), F.col("__parts.PROGRAM"), rules)
    return with_once(read, _CAPS, found).drop("__parts")


def with_fields(matched: DataFrame, rules: Sequence[Rule], ranges: DataFrame | None = None) -> DataFrame:
    """Add ``__fields``, the extracted fields as JSON, to a frame with ``__caps``.

    With a prepared range or network table, the place of each address field that has
    one goes in at ``geoip.<field>``. That is done on the captures, so that no record
    is parsed for it.
    """
    caps, fields = F.col(_CAPS), F.col("__fields")
    found = with_once(matched, "__fields", fields_json(caps, rules))
    if ranges is None:
        return found
    names = sorted({f.name for rule in rules for f in rule.fields if f.ip})
    for name in names:
        found = places(found.withColumn("__address", _address(caps, rules, name)), "__address", ranges, prepared=True)
        found = found.withColumnRenamed("place", f"__place_{name}").drop("__address")
    entries = [F.concat(F.lit(f"{json.dumps(name)}:"), F.col(f"__place_{name}")) for name in names]
    geo = F.nullif(F.concat_ws(",", *entries), F.lit(""))
    with_geo = F.concat(F.lit('{"geoip":{'), geo, F.lit("},"), F.substr(fields, F.lit(2)))
    return found.withColumn("__fields", F.coalesce(with_geo, fields)).drop(*(f"__place_{n}" for n in names))


def enrich(
    df: DataFrame, rules: Sequence[Rule], raw: str = "raw", ranges: DataFrame | None = None
) -> DataFrame:
    """Merge the extracted fields into ``raw`` under ``enriched``.

    A record no rule matches keeps its text exactly as it was. ``ranges`` is a
    prepared range table for the address fields, or None.
    """
    if not rules:
        return df
    record, fields = F.col(raw), F.col("__fields")
    found = with_fields(with_captures(df, rules, raw), rules, ranges)
    merged = F.when(fields.isNotNull(), records.with_member(record, "enriched", fields)).otherwise(record)
    return with_once(found, raw, merged).select(*(F.col(f"`{c}`") for c in df.columns))


def as_records(lines: DataFrame, line: str = "value", program: str | None = None) -> DataFrame:
    """Turn previewed lines into records, column ``raw``.

    A JSON object is taken as the record; any other text becomes the MESSAGE of
    a new one, with PROGRAM when one is given. Empty lines are dropped.
    """
    text = F.col(line)
    members = [text.alias("MESSAGE")] + ([F.lit(program).alias("PROGRAM")] if program is not None else [])
    is_record = records.is_object(text) & records.record(text).isNotNull()
    return lines.filter(text != "").withColumn(
        "raw", F.when(is_record, text).otherwise(F.to_json(F.struct(*members)))
    )


def enrich_fields(df: DataFrame, rules: Sequence[Rule], raw: str = "raw") -> DataFrame:
    """Preview: add ``fields``, the extracted fields alone (``{}`` without a match)."""
    found = fields_json(F.col(_CAPS), rules)
    return with_captures(df, rules, raw).withColumn("fields", F.coalesce(found, F.lit("{}"))).drop(_CAPS)


def enrich_full(df: DataFrame, rules: Sequence[Rule], raw: str = "raw") -> DataFrame:
    """Preview: the whole record as it would be stored."""
    return enrich(df, rules, raw)


def enrich_explain(df: DataFrame, rules: Sequence[Rule], raw: str = "raw") -> DataFrame:
    """Preview: add ``matched``, ``rule`` and ``fields``."""
    caps = F.col(_CAPS)
    return (
        with_captures(df, rules, raw)
        .withColumn("matched", caps.isNotNull())
        .withColumn("rule", rule_name(caps, rules))
        .withColumn("fields", fields_json(caps, rules))
        .drop(_CAPS)
    )


def rule_coverage(df: DataFrame, rules: Sequence[Rule], program: str = "program", raw: str = "raw") -> DataFrame:
    """Rows per program and rule that fired; unmatched rows have a NULL rule."""
    caps = F.col(_CAPS)
    return (
        with_captures(df, rules, raw)
        .select(F.col(program).alias("program"), rule_name(caps, rules).alias("rule"))
        .groupBy("program", "rule", F.col("rule").isNotNull().alias("matched"))
        .agg(F.count("*").alias("n"))
    )
