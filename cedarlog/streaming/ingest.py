"""Streaming ingest into the store."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cedarlog.functions.args import positive_or
from cedarlog.operators import rules as rule_ops
from cedarlog.operators.filters import timestamp
from cedarlog.operators.syslog import parse_syslog, split_rejects
from cedarlog.sources.files import WebSet, local_path, parse_web_lines
from cedarlog.sources.store import LogStore

# Fixed value: seconds a partial batch waits at most.
FLUSH_SECONDS = 1


def stream_lines(
    spark: SparkSession, path: str, max_files: int | None = None, glob: str | None = None
) -> DataFrame:
    """Lines of the text files landing in a folder; each file is read once, whole."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def _start(
    lines: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    name: str,
    flush_seconds: int | None,
    available_now: bool,
) -> StreamingQuery:
    writer = lines.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{positive_or(flush_seconds, FLUSH_SECONDS)} seconds").start()


def stream_syslog(
    lines: DataFrame,
    store: LogStore,
    checkpoint: str,
    rules: Sequence[rule_ops.Rule] = (),
    *,
    rejects_path: str,
    ranges: DataFrame | None = None,
    flush_seconds: int | None = FLUSH_SECONDS,
    available_now: bool = False,
    name: str = "syslog",
) -> StreamingQuery:
    """Parse, put rejects into ``rejects_path``, enrich and append; a bad line never stops the stream.

    Any streaming frame with a ``value`` line column will do: a landing folder, the
    ``logfollow`` source, or Kafka values cast to string. A batch repeated after a
    failure replaces its first attempt.
    """

    def write(batch: DataFrame, number: int) -> None:
        good, bad = split_rejects(parse_syslog(batch))
        store.append("syslog", rule_ops.enrich(good, rules, ranges=ranges), (name, number))
        bad.withColumn("batch", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(rejects_path)

    return _start(lines, write, checkpoint, name, flush_seconds, available_now)


def stream_web_logs(
    lines: DataFrame,
    store: LogStore,
    checkpoint: str,
    web_set: WebSet,
    kind: str,
    host: str,
    *,
    ranges: DataFrame | None = None,
    received_at=None,
    flush_seconds: int | None = FLUSH_SECONDS,
    available_now: bool = False,
) -> StreamingQuery:
    """Follow the files of one set and kind into its table.

    ``lines`` has ``value`` and ``path``; ``ranges`` is a prepared range table.
    Receipt time is the start of the batch's first attempt unless ``received_at`` gives
    one. Several sets may be stored into one table at once: each has a name of its own.
    """
    name = f"{web_set.name}-{kind}"

    def write(batch: DataFrame, number: int) -> None:
        tagged = batch.withColumn("path", local_path(F.col("path")))
        begun = store.batch_time(f"http_{kind}", (name, number)) if received_at is None else received_at
        received = timestamp(begun) if isinstance(begun, dt.datetime) else begun
        rows = parse_web_lines(tagged, web_set, kind, host, received, ranges)
        store.append(f"http_{kind}", rows, (name, number))

    return _start(lines, write, checkpoint, name, flush_seconds, available_now)


def follow_sets(
    spark: SparkSession, sets: Sequence[WebSet], options: Mapping[str, str] | None = None
) -> dict[tuple[WebSet, str], DataFrame]:
    """One ``logfollow`` stream per set and kind; register the source first."""
    out = {}
    for web_set in sets:
        for kind in ("access", "error"):
            if web_set.pattern(kind) is not None:
                reader = spark.readStream.format("logfollow").options(**(options or {}))
                out[web_set, kind] = reader.option("path", web_set.pattern(kind)).load()
    return out
