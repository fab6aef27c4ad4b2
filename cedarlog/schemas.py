"""Table schemas and the registry of what each source offers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TS = T.TimestampType()
_STR = T.StringType()
_LONG = T.LongType()
_INT = T.IntegerType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


SYSLOG = _schema(
    ("id", _LONG),
    ("c_isodate", _TS),
    ("r_isodate", _TS),
    ("s_isodate", _TS),
    ("facility", _STR),
    ("host", _STR),
    ("host_from", _STR),
    ("pid", _LONG),
    ("priority", _STR),
    ("program", _STR),
    ("sourceip", _STR),
    ("raw", _STR),
)

HTTP_ACCESS = _schema(
    ("id", _LONG),
    ("r_isodate", _TS),
    ("req_isodate", _TS),
    ("host", _STR),
    ("vhost", _STR),
    ("vhost_port", _INT),
    ("client_ip", _STR),
    ("ident", _STR),
    ("auth", _STR),
    ("method", _STR),
    ("request", _STR),
    ("http_version", _STR),
    ("status", _INT),
    ("bytes", _LONG),
    ("referrer", _STR),
    ("user_agent", _STR),
    ("raw", _STR),
)

HTTP_ERROR = _schema(
    ("id", _LONG),
    ("r_isodate", _TS),
    ("err_isodate", _TS),
    ("host", _STR),
    ("vhost", _STR),
    ("vhost_port", _INT),
    ("client_ip", _STR),
    ("loglevel", _STR),
    ("pid", _LONG),
    ("code", _STR),
    ("server", _STR),
    ("request", _STR),
    ("message", _STR),
    ("raw", _STR),
)

# The JSON keys a syslog record must carry.
SYSLOG_REQUIRED = (
    "C_ISODATE",
    "R_ISODATE",
    "S_ISODATE",
    "FACILITY",
    "HOST",
    "HOST_FROM",
    "PRIORITY",
    "PROGRAM",
    "SOURCEIP",
)


@dataclass(frozen=True)
class Source:
    """What may be filtered, grouped and shown for one table.

    The first entry of ``times`` and ``dims`` is that source's default.
    ``display`` pairs a shown name with a column; ``raw.MESSAGE`` stands for the
    message inside the stored record.
    """

    name: str
    schema: T.StructType
    times: tuple[str, ...]
    filters: tuple[str, ...]
    dims: tuple[str, ...]
    display: tuple[tuple[str, str], ...]


# Which columns each source exposes for what.
SOURCES: dict[str, Source] = {
    "syslog": Source(
        name="syslog",
        schema=SYSLOG,
        times=("s_isodate", "c_isodate", "r_isodate"),
        filters=("host", "program", "facility", "priority"),
        dims=("program", "host", "host_from", "facility", "priority"),
        display=(("host", "host"), ("program", "program"), ("message", "raw.MESSAGE")),
    ),
    "http_access": Source(
        name="http_access",
        schema=HTTP_ACCESS,
        times=("r_isodate", "req_isodate"),
        filters=("host", "vhost", "client_ip", "method", "status"),
        dims=("vhost", "host", "method", "status", "client_ip"),
        display=(
            ("vhost", "vhost"),
            ("client", "client_ip"),
            ("status", "status"),
            ("method", "method"),
            ("request", "request"),
        ),
    ),
    "http_error": Source(
        name="http_error",
        schema=HTTP_ERROR,
        times=("r_isodate", "err_isodate"),
        filters=("host", "vhost", "client_ip", "loglevel", "code", "server"),
        dims=("server", "host", "loglevel", "code", "client_ip"),
        display=(
            ("level", "loglevel"),
            ("client", "client_ip"),
            ("code", "code"),
            ("message", "message"),
        ),
    ),
}


def source(name: str) -> Source:
    """Look a source up by name, or fail naming the valid ones."""
    try:
        return SOURCES[name]
    except KeyError:
        raise ValueError(f"source must be one of {', '.join(sorted(SOURCES))}, got {name!r}") from None


def time_column(src: Source, column: str | None, default: str | None = None) -> str:
    """The time column to window on, checked against the source."""
    chosen = column or default or src.times[0]
    if chosen not in src.times:
        raise ValueError(f"column for {src.name} must be one of {', '.join(sorted(src.times))}, got {chosen!r}")
    return chosen
