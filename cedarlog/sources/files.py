"""Line files: syslog JSON, web-server logs, and named sets of them."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cedarlog.functions.text import digits_to, is_blank
from cedarlog.operators.geo import prepare_ranges
from cedarlog.operators.networks import prepare_networks
from cedarlog.operators.weblogs import parse_http_access, parse_http_error
from cedarlog.session import materialize

# Names in a web-log configuration that are settings, not sets.
RESERVED = ("geoip", "state_dir", "pid_dir")

KINDS = ("access", "error")

#: Files that are asked at a time whether they may be opened; each costs a call to the file system.
ASKED_AT_ONCE = 16


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Non-blank lines (``value``) with the ``path`` they came from.

    Only a newline ends a line. Files that vanish, or that break off while they are
    read, give what could be read of them.
    """
    return _raw_lines(spark, paths).filter(~is_blank(F.col("value")))


def _raw_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    reader = spark.read.option("lineSep", "\n").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    return reader.text(paths).select("value", F.col("_metadata.file_path").alias("path"))


def read_syslog_json(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines for :func:`cedarlog.operators.syslog.parse_syslog`.

    Paths that are missing, and files that may not be opened, are warned about and skipped.
    """
    present, problems = openable(spark, paths)
    for path, status in problems:
        warnings.warn(f"{path} is {status} and is skipped", stacklevel=2)
    if not present:
        return spark.createDataFrame([], "value string, path string")
    return read_lines(spark, present)


def openable(spark: SparkSession, paths: str | Sequence[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """(paths or patterns that can be read, (path, ``missing`` or ``unreadable``) of the others).

    A pattern of which some files may not be opened is replaced by the others. Every
    file is asked, however many there are.
    """
    present, problems, _ = _asked(spark, paths)
    return present, problems


def _asked(spark: SparkSession, paths: str | Sequence[str]) -> tuple[list[str], list[tuple[str, str]], list[str]]:
    """What :func:`openable` gives, and those files to be read that have no byte."""
    wanted = [paths] if isinstance(paths, str) else list(paths)
    if not wanted:
        raise ValueError("at least one file is required")
    read = spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsAction.READ

    def ask(files, status) -> tuple[str, bool, bool]:
        """Name, whether it may be opened, whether it is an empty file."""
        path = status.getPath()
        try:
            files.access(path, read)
        except Py4JJavaError:
            return path.toString(), False, False
        return path.toString(), True, status.isFile() and not status.getLen()

    present, problems, empty = [], [], []
    with ThreadPoolExecutor(ASKED_AT_ONCE) as pool:
        for path in wanted:
            files, found = _matches(spark, path)
            if not found:
                problems.append((path, "missing"))
                continue
            answers = list(pool.map(partial(ask, files), found))
            closed = {name for name, opens, _ in answers if not opens}
            problems += [(name, "unreadable") for name in sorted(closed)]
            present += [name for name, opens, _ in answers if opens] if closed else [path]
            empty += [name for name, _, blank in answers if blank]
    return present, problems, empty


def _matches(spark: SparkSession, path: str) -> tuple:
    """The file system of a path or pattern, and the status of what matches."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    return files, list(files.globStatus(target) or [])


def file_outcomes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(path, status, lines)`` of each file asked for.

    ``read`` with the number of its lines, blank ones included; ``empty``; ``missing``;
    ``unreadable``: not opened, or without a line although it has bytes.
    """
    present, problems, empty = _asked(spark, paths)
    # Spark plans no task for a file without a byte
    other = spark.createDataFrame([(p, s, 0) for p, s in [*problems, *((p, "empty") for p in empty)]], "path string, status string, lines long")
    if not present:
        return other
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(present).where("length > 0").select("path")  # no content is read
    counted = _raw_lines(spark, present).groupBy(F.col("path").alias("__path")).agg(F.count(F.lit(1)).alias("lines"))
    joined = files.join(counted, local_path(F.col("path")) == local_path(F.col("__path")), "left")
    status = F.when(F.col("lines") > 0, "read").otherwise("unreadable")
    return joined.select("path", status.alias("status"), F.coalesce("lines", F.lit(0)).cast("long").alias("lines")).unionByName(other)


def read_http_access(
    lines: DataFrame, host: str, vhost: str | None = None, vhost_port: int | None = None, received_at=None
) -> DataFrame:
    return parse_http_access(lines, host, vhost, vhost_port, received_at)


def read_http_error(
    lines: DataFrame, host: str, vhost: str | None = None, vhost_port: int | None = None, received_at=None
) -> DataFrame:
    return parse_http_error(lines, host, vhost, vhost_port, received_at)


@dataclass(frozen=True)
class WebSet:
    """One named group of web logs; ``geoip`` names a range table or is None."""

    name: str
    access: str | None = None
    error: str | None = None
    vhost: str | None = None
    vhost_port: int | None = None
    geoip: str | None = None

    def pattern(self, kind: str) -> str | None:
        return self.access if kind == "access" else self.error


def web_sets(config: Mapping, name: str = "all") -> list[WebSet]:
    """The sets of a configuration, by name; ``name`` picks one.

    A set that has a ``geoip`` key, even an empty one, overrides the common one.
    """
    sets = []
    for key in sorted(config):
        entry = config[key]
        if key in RESERVED or name not in ("all", key) or not isinstance(entry, Mapping):
            continue
        sets.append(
            WebSet(
                name=key,
                access=entry.get("access"),
                error=entry.get("error"),
                vhost=entry.get("vhost"),
                vhost_port=entry.get("vhost_port"),
                geoip=entry["geoip"] if "geoip" in entry else config.get("geoip"),
            )
        )
    return sets


def _glob_regex(pattern: str) -> tuple[str, int]:
    """A Java pattern capturing what each * and ? matched, and how many there are."""
    parts = [{"*": "(.*)", "?": "(.)"}.get(ch) or re.escape(ch) for ch in pattern]
    return r"(?s)\A" + "".join(parts) + r"\z", pattern.count("*") + pattern.count("?")


def glob_text(path: Column, pattern: str | None) -> Column:
    """What the wildcards of ``pattern`` matched in ``path``, joined; NULL without any."""
    wild = _glob_regex(pattern) if pattern else ("", 0)
    if not wild[1]:
        return F.lit(None).cast("string")
    regex, groups = wild
    joined = F.concat(*(F.regexp_extract(path, regex, n) for n in range(1, groups + 1)))
    return F.when(path.rlike(regex), joined)


def tag_vhost(path: Column, web_set: WebSet, kind: str = "access") -> tuple[Column, Column]:
    """``(vhost, vhost_port)`` of a file of the set.

    A vhost named by the set wins, with the set's port. Otherwise the vhost is the
    wildcard text, or the set's name when there is none; a trailing ``:digits``
    of it is the port.
    """
    own_port = F.lit(web_set.vhost_port).cast("int")
    if web_set.vhost is not None:
        return F.lit(web_set.vhost), own_port
    found = glob_text(path, web_set.pattern(kind))
    name = F.when(found.isNull() | (found == ""), F.lit(web_set.name)).otherwise(found)
    with_port = r"(?s)\A(.*):([0-9]+)\z"
    split = name.rlike(with_port)
    port = digits_to(F.regexp_extract(name, with_port, 2), "int")
    return (
        F.when(split, F.regexp_extract(name, with_port, 1)).otherwise(name),
        F.when(split, port).otherwise(own_port),
    )


def local_path(path: Column) -> Column:
    """``file:///a`` and ``file:/a`` as ``/a``, other file systems without their authority."""
    plain = F.regexp_replace(path, r"\A[a-z0-9]+:(?://[^/]*)?(?=/)", "")
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


def parse_web_lines(
    lines: DataFrame, web_set: WebSet, kind: str, host: str, received_at=None, ranges: DataFrame | None = None
) -> DataFrame:
    """Lines (``value``, ``path``) of one set and kind, tagged by path and parsed.

    ``ranges`` is a prepared range table, or None for no geolocation.
    """
    vhost, port = tag_vhost(F.col("path"), web_set, kind)
    tagged = lines.withColumns({"__vhost": vhost, "__port": port})
    parse = parse_http_access if kind == "access" else parse_http_error
    return parse(tagged, host, F.col("__vhost"), F.col("__port"), received_at, ranges=ranges)


def prepared_ranges(sets: Sequence[WebSet], ranges: Mapping[str, DataFrame] | None) -> dict[str | None, DataFrame]:
    """The range tables the sets name, each prepared and written out once."""
    used = {s.geoip for s in sets if s.geoip is not None and s.geoip in (ranges or {})}
    return {
        name: materialize((prepare_networks if "place" in ranges[name].columns else prepare_ranges)(ranges[name]), "ranges") for name in sorted(used)
    }


def read_web_sets(
    spark: SparkSession,
    config: Mapping,
    host: str,
    received_at=None,
    name: str = "all",
    ranges: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """``{"access": rows, "error": rows}`` over all files of the chosen sets.

    ``ranges`` maps the names used by ``geoip`` to range tables. A kind without
    any file is left out.
    """
    out: dict[str, list[DataFrame]] = {}
    chosen = web_sets(config, name)
    tables = prepared_ranges(chosen, ranges)
    for web_set in chosen:
        table = tables.get(web_set.geoip)
        for kind in KINDS:
            pattern = web_set.pattern(kind)
            present = openable(spark, pattern)[0] if pattern is not None else []
            if not present:
                continue
            lines = read_lines(spark, present).withColumn("path", local_path(F.col("path")))
            out.setdefault(kind, []).append(parse_web_lines(lines, web_set, kind, host, received_at, table))
    return {kind: reduce(DataFrame.unionByName, frames) for kind, frames in out.items()}
