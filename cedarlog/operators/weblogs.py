"""Web-server access and error lines to rows; no line is ever lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.functions.once import with_once
from cedarlog.functions.text import access_time, canonical_ip, capture, digits_to, empty_to_null, error_time, is_blank, is_ip
from cedarlog.operators.rules import Field, Rule, with_fields
from cedarlog.schemas import HTTP_ACCESS, HTTP_ERROR

# Text up to the closing quote, escapes included. Possessive, so that a very long
# value neither backtracks nor deepens the matcher's stack.
_TEXT = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_QUOTED = f'"({_TEXT})"'

ACCESS = (
    Rule(
        name="http_access",
        pattern=(
            r"\A(\S+) (\S+) (\S+) \[([^\]]+)\] "
            rf'"(?:([A-Za-z]+) (\S+)(?: HTTP/([0-9]+(?:\.[0-9]+)?))?|({_TEXT}))" '
            rf"([0-9]{{3}}) (?:([0-9]+)|-)(?: {_QUOTED} {_QUOTED})?\s*\z"
        ),
        fields=(
            Field("http_clientip", 1, ip=True),
            Field("http_ident", 2),
            Field("http_auth", 3),
            Field("http_timestamp", 4),
            Field("http_verb", 5),
            Field("http_request", 6),
            Field("http_httpversion", 7),
            Field("http_rawrequest", 8),
            Field("http_response", 9, "long"),
            Field("http_bytes", 10, "long"),
            Field("http_referrer", 11),
            Field("http_agent", 12),
        ),
    ),
)

ERROR = (
    Rule(
        name="apache24_error",
        pattern=(
            r"\A\[([A-Za-z]{3} [A-Za-z]{3} +[0-9]{1,2} [0-9:]{8}(?:\.[0-9]+)? [0-9]{4})\] "
            r"\[([^\]:]*):([^\]]+)\] \[pid ([0-9]+)(?::tid ([0-9]+))?\]"
            r"(?: \[client (\[[0-9a-fA-F:.]+\]|[0-9a-fA-F:.]+?)(?::([0-9]+))?\])? ?"
            r"(?:(AH[0-9]+): )?(.*)\z"
        ),
        fields=(
            Field("http_error_timestamp", 1),
            Field("http_error_module", 2),
            Field("http_error_loglevel", 3),
            Field("http_error_pid", 4, "long"),
            Field("http_error_tid", 5, "long"),
            Field("http_error_client_ip", 6, ip=True),
            Field("http_error_client_port", 7, "long"),
            Field("http_error_code", 8),
            Field("http_error_message", 9),
        ),
    ),
    Rule(
        name="apache22_error",
        pattern=(
            r"\A\[([A-Za-z]{3} [A-Za-z]{3} +[0-9]{1,2} [0-9:]{8}(?:\.[0-9]+)? [0-9]{4})\] "
            r"\[([a-z]+)\] (?:\[client ([0-9a-fA-F:.]+)\] )?(.*)\z"
        ),
        fields=(
            Field("http_error_timestamp", 1),
            Field("http_error_loglevel", 2),
            Field("http_error_client_ip", 3, ip=True),
            Field("http_error_message", 4),
        ),
    ),
    Rule(
        name="nginx_error",
        pattern=(
            r"\A([0-9]{4}/[0-9]{2}/[0-9]{2} [0-9:]{8}) \[([a-z]+)\] ([0-9]+)#([0-9]+): (?:\*([0-9]+) )?"
            r"(.*?)(?:, client: ([0-9a-fA-F:.]+))?(?:, server: ([^,]*))?"
            rf"(?:, request: {_QUOTED})?(?:, upstream: {_QUOTED})?(?:, host: {_QUOTED})?(?:, referrer: {_QUOTED})?\s*\z"
        ),
        fields=(
            Field("http_error_timestamp", 1),
            Field("http_error_loglevel", 2),
            Field("http_error_pid", 3, "long"),
            Field("http_error_tid", 4, "long"),
            Field("http_error_connection", 5, "long"),
            Field("http_error_message", 6),
            Field("http_error_client_ip", 7, ip=True),
            Field("http_error_server", 8),
            Field("http_error_request", 9),
            Field("http_error_upstream", 10),
            Field("http_error_host", 11),
            Field("http_error_referrer", 12),
        ),
    ),
)


def _match(lines: DataFrame, line: str, rules: tuple[Rule, ...], ranges: DataFrame | None) -> DataFrame:
    """Non-blank lines with ``__caps``, whose tag in front names the layout that
    matched, and ``__fields``, all of its fields as JSON."""
    text = F.col(line)
    attempts = (capture(text, rule.pattern, rule.groups, str(at)) for at, rule in enumerate(rules))
    matched = with_once(lines.filter(~is_blank(text)), "__caps", F.coalesce(*attempts))
    return with_fields(matched, rules, ranges)


def _field(caps: Column, rules: tuple[Rule, ...], name: str) -> Column:
    """A field's text from whichever layout matched."""
    at = [(str(i), f) for i, rule in enumerate(rules) for f in rule.fields if f.name == name]
    if len(rules) == 1:
        return empty_to_null(caps[at[0][1].group])
    return F.coalesce(*(F.when(caps[0] == tag, empty_to_null(caps[f.group])) for tag, f in at))


def _raw(line: Column) -> Column:
    """``{"MESSAGE": line}``, with ``enriched`` when anything was extracted."""
    fields = F.col("__fields")
    bare = F.to_json(F.struct(line.alias("MESSAGE")))
    return F.concat(
        F.rtrim(bare, F.lit("}")), F.coalesce(F.concat(F.lit(',"enriched":'), fields), F.lit("")), F.lit("}")
    )


def _tag(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _received(value) -> Column:
    """The receipt time given, else the clock when the query starts."""
    return F.current_timestamp() if value is None else _tag(value).cast("timestamp")


def _address(value: Column) -> Column:
    bare = F.regexp_replace(value, r"\A\[|\]\z", "")
    return F.when(is_ip(bare), canonical_ip(bare))


def parse_http_access(
    lines: DataFrame,
    host,
    vhost=None,
    vhost_port=None,
    received_at=None,
    line: str = "value",
    keep: Sequence[str] = (),
    ranges: DataFrame | None = None,
) -> DataFrame:
    """Access lines in combined or common format to ``http_access`` rows.

    ``host``, ``vhost``, ``vhost_port`` and ``received_at`` tag every row; each is
    a constant or a column of ``lines``; receipt time is the clock's unless given;
    ``keep`` names columns to carry along. A line in any other layout yields a row
    with NULL columns; blank lines yield none. ``ranges`` is a prepared range table
    for geolocating the client, or None.
    """
    caps = F.col("__caps")
    text = {f.name: _field(caps, ACCESS, f.name) for f in ACCESS[0].fields}
    columns = {
        "r_isodate": _received(received_at),
        "req_isodate": access_time(text["http_timestamp"]),
        "host": _tag(host).cast("string"),
        "vhost": _tag(vhost).cast("string"),
        "vhost_port": _tag(vhost_port).cast("int"),
        "client_ip": _address(text["http_clientip"]),
        "ident": text["http_ident"],
        "auth": text["http_auth"],
        "method": text["http_verb"],
        "request": F.coalesce(text["http_request"], text["http_rawrequest"]),
        "http_version": text["http_httpversion"],
        "status": digits_to(text["http_response"], "int"),
        "bytes": digits_to(text["http_bytes"], "bigint"),
        "referrer": text["http_referrer"],
        "user_agent": text["http_agent"],
        "raw": _raw(F.col(line)),
    }
    return _match(lines, line, ACCESS, ranges).select(*keep, *_in_order(columns, HTTP_ACCESS))


def parse_http_error(
    lines: DataFrame,
    host,
    vhost=None,
    vhost_port=None,
    received_at=None,
    line: str = "value",
    keep: Sequence[str] = (),
    ranges: DataFrame | None = None,
) -> DataFrame:
    """Apache 2.2, Apache 2.4 and nginx error lines to ``http_error`` rows."""
    caps = F.col("__caps")

    def text(name: str) -> Column:
        return _field(caps, ERROR, f"http_error_{name}")

    columns = {
        "r_isodate": _received(received_at),
        "err_isodate": error_time(text("timestamp")),
        "host": _tag(host).cast("string"),
        "vhost": _tag(vhost).cast("string"),
        "vhost_port": _tag(vhost_port).cast("int"),
        "client_ip": _address(text("client_ip")),
        "loglevel": text("loglevel"),
        "pid": digits_to(text("pid"), "bigint"),
        "code": text("code"),
        "server": text("server"),
        "request": text("request"),
        "message": text("message"),
        "raw": _raw(F.col(line)),
    }
    return _match(lines, line, ERROR, ranges).select(*keep, *_in_order(columns, HTTP_ERROR))


def _in_order(columns: dict[str, Column], schema) -> list[Column]:
    return [columns[f.name].alias(f.name) for f in schema.fields if f.name != "id"]
