"""The log store: one parquet table per source, a folder for each batch.

    <table>/data/ids=<base>-<last>/batch=<writer>-<number>/day=<receipt day>/part-..
    <table>/sketches/ids=..    for each batch and day, a sketch of the values of each dimension
    <table>/promoted.json      fields with columns of their own

A batch is one Spark write in overwrite mode to a folder of its own, and is there once
Spark has put its ``_SUCCESS`` mark into it; a repeated batch overwrites its folder. The
folder's name says which ids it holds, so ids go on from the names, and a cursor or
newest-N search prunes by them. What rewrites stored rows (prune, re-enrich, fill) is a
dynamic partition overwrite of the partitions that change. Compaction writes the rows of
neighbouring batches as one larger batch; a batch whose ids lie within a larger one's is
no longer read, and goes.

Any number of streams of one driver may append to a table at a time. Another driver has a
store of its own; the stores' tables can be read as a union.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import threading
import uuid
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cedarlog.functions.args import parse_duration, positive_or
from cedarlog.operators import maintenance, promote, stats
from cedarlog.operators.filters import build_filter, day_filter, timestamp
from cedarlog.operators.ids import assign_ids
from cedarlog.operators.rules import Rule
from cedarlog.schemas import SOURCES, source, time_column
from cedarlog.session import scratch_path

_PARTITIONS = [T.StructField("ids", T.StringType()), T.StructField("batch", T.StringType()), T.StructField("day", T.DateType())]
_KEYS = [f.name for f in _PARTITIONS]

#: Bytes of a file that compaction aims at.
_FILE_BYTES = 128 << 20
#: Batches of one driver take their ids in turns.
_RESERVING = threading.Lock()


class Batch(NamedTuple):
    """Ids ``base`` + 1 to ``last``."""

    base: int
    last: int
    name: str

    @property
    def folder(self) -> str:
        return f"ids={self.base:020d}-{self.last:020d}/batch={self.name}"

    def holds(self, other: Batch) -> bool:
        return self.base <= other.base and other.last <= self.last and self[:2] != other[:2]


def parse_batch(path: str) -> Batch | None:
    found = re.search(r"ids=([0-9]+)-([0-9]+)/batch=([^/]+)", path)
    return Batch(int(found[1]), int(found[2]), found[3]) if found else None


class LogStore:
    """Any number of streams and readers per source."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- files ---------------------------------------------------------------

    def data_path(self, source_name: str) -> str:
        return f"{self._top(source_name)}/data"

    def _top(self, source_name: str) -> str:
        return f"{self.root}/{source(source_name).name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        fs, target = self._fs(path)
        return fs.exists(target)

    def _delete(self, path: str) -> None:
        fs, target = self._fs(path)
        fs.delete(target, True)

    def _names(self, pattern: str) -> list[str]:
        """Paths that match, by listing."""
        fs, target = self._fs(pattern)
        return sorted(str(s.getPath().toString()) for s in fs.globStatus(target) or [])

    # -- promoted fields -----------------------------------------------------

    def _promotions(self, source_name: str) -> dict[str, list[str]]:
        """Fields with columns of their own, and the days whose rows do not have them yet."""
        path = f"{self._top(source_name)}/promoted.json"
        if not self._exists(path):
            return {}
        fs, target = self._fs(path)
        stream = fs.open(target)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put_promotions(self, source_name: str, known: dict[str, list[str]]) -> None:
        """Replaced as a whole by one rename."""
        jvm = self.spark.sparkContext._jvm
        fs, target = self._fs(f"{self._top(source_name)}/promoted.json")
        _, draft = self._fs(f"{self._top(source_name)}/promoted.{uuid.uuid4().hex}.tmp")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(known), "utf-8"))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(fs.makeQualified(draft), fs.makeQualified(target), how)

    def promoted(self, source_name: str) -> list[str]:
        """Enriched fields that every stored row has in columns of their own."""
        return [field for field, days in self._promotions(source_name).items() if not days]

    def promote(self, source_name: str, fields: Iterable[str]) -> None:
        """Give fields their own columns.

        New rows have them at once. Stored days are filled one at a time, and until
        the last is, searches take the field from the record.
        """
        self.recover(source_name)
        known = self._promotions(source_name)
        added = [promote.check_field(f) for f in fields if f not in known]
        if added:
            days = sorted({path.rsplit("day=", 1)[1] for path in self._names(f"{self.data_path(source_name)}/ids=*/batch=*/day=*")})
            known = known | {field: days for field in added}
            self._put_promotions(source_name, known)
        self.fill(source_name)

    def fill(self, source_name: str) -> None:
        """Write promoted columns into the days that lack them; goes on where it was left."""
        known = self._promotions(source_name)
        for day in sorted({day for days in known.values() for day in days}):
            fields = [field for field, days in known.items() if day in days]
            rows = self._rows(source_name).where(F.col("day") == F.lit(day).cast("date"))
            plain = [c for c in rows.columns if not any(c.startswith(f"field_{f}_") for f in fields)]
            self._overwrite(source_name, promote.promote_fields(rows.select(*plain), fields).select(*rows.columns))
            known = {field: [d for d in days if d != day] for field, days in known.items()}
            self._put_promotions(source_name, known)

    # -- reading -------------------------------------------------------------

    def schema(self, source_name: str) -> T.StructType:
        fields = promote.promoted_schema(self._promotions(source_name))
        return T.StructType(source(source_name).schema.fields + fields + _PARTITIONS)

    def _listed(self, source_name: str) -> tuple[list[Batch], set[Batch]]:
        """All batches in the order of their ids, and those of them that are not to be read: unfinished, or part of a larger one."""
        data = self.data_path(source_name)
        every = sorted(filter(None, map(parse_batch, self._names(f"{data}/ids=*/batch=*"))))
        whole = set(filter(None, map(parse_batch, self._names(f"{data}/ids=*/batch=*/_SUCCESS"))))
        hidden, large = set(every) - whole, None
        for batch in sorted(whole, key=lambda b: (b.base, -b.last)):
            if large and large.holds(batch):
                hidden.add(batch)
            else:
                large = batch
        return every, hidden

    def _rows(self, source_name: str) -> DataFrame:
        """All rows of whole batches, with the columns of their partitions."""
        schema = self.schema(source_name)
        if not self._exists(self.data_path(source_name)):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.data_path(source_name))
        hidden = [b.folder.split("/")[0][4:] for b in self._listed(source_name)[1]]
        return rows.where(~F.col("ids").isin(hidden)) if hidden else rows

    def read(self, source_name: str) -> DataFrame:
        """All rows of whole batches, with ``day`` and ``id_base``, the largest id before their batch."""
        return self._rows(source_name).withColumn("id_base", _base()).drop("ids", "batch")

    def matching(self, source_name: str, **filters) -> DataFrame:
        """Stored rows passing the filters; windows prune days, promoted fields prune rows."""
        return self.read(source_name).filter(self._filter(source_name, filters))

    def _filter(self, source_name: str, filters: dict) -> Column:
        return build_filter(
            source_name, promoted=self.promoted(source_name), partitioned=True, **filters
        )

    def max_id(self, source_name: str) -> int:
        """The largest id given out so far, pruned rows included."""
        found = filter(None, map(parse_batch, self._names(f"{self.data_path(source_name)}/ids=*/batch=*")))
        return max((b.last for b in found), default=0)

    def batches(self, source_name: str) -> list[Batch]:
        """The batches that are read, oldest ids first."""
        every, hidden = self._listed(source_name)
        return [b for b in every if b not in hidden]

    def between(self, source_name: str, low: int, high: int) -> DataFrame:
        """Rows with ``low`` < id <= ``high``, from the batches that hold such ids."""
        within = (F.col("id") > F.lit(low)) & (F.col("id") <= F.lit(high))
        return self._rows(source_name).where(within & (_base() < F.lit(high)) & (_last() > F.lit(low))).withColumn("id_base", _base()).drop("ids", "batch")

    def newest(
        self, source_name: str, limit: int | None = 20, asc: bool = False, first_step: int = 1 << 20, **filters
    ) -> DataFrame:
        """Newest-N (or oldest-N) search that stops early.

        Matches are counted over ranges of ids that grow eightfold from the wanted
        end, until there are enough or the ids run out; the result then reads only
        those ranges. Batches outside are skipped by directory, the rest by
        row-group minima and maxima.
        """
        wanted = positive_or(limit, 20)
        batches = self.batches(source_name)
        bottom, top = (batches[0].base, max(b.last for b in batches)) if batches else (0, 0)
        matching = self._filter(source_name, filters)
        order = F.col("id").asc() if asc else F.col("id").desc()
        step, found, edge = first_step, 0, bottom if asc else top
        while True:
            low, high = (edge, min(edge + step, top)) if asc else (max(edge - step, bottom), edge)
            edge = high if asc else low
            done = edge == (top if asc else bottom)
            if not done:
                found += self.between(source_name, low, high).filter(matching).select("id").limit(wanted - found).count()
            if done or found >= wanted:
                span = (bottom, edge) if asc else (edge, top)
                return self.between(source_name, *span).filter(matching).orderBy(order).limit(wanted)
            step *= 8

    def after(self, source_name: str, last: int, **filters) -> DataFrame:
        """Rows past a cursor in id order; batches wholly before it are not opened."""
        return self.between(source_name, last, max(self.max_id(source_name), last)).filter(self._filter(source_name, filters)).orderBy("id")

    def tail(self, source_name: str, lines: int | None = 10, **filters) -> DataFrame:
        return self.newest(source_name, positive_or(lines, 10), **filters).orderBy("id")

    def register(self) -> None:
        """Make the tables reachable by name from SQL.

        Beside the stored columns, ``record`` is ``raw`` as a VARIANT, NULL where that is no
        JSON, so that SQL can ask by path: ``record:enriched.port::int``. It is parsed
        only where a query uses it.
        """
        for name in SOURCES:
            self.read(name).withColumn("record", F.try_parse_json("raw")).createOrReplaceTempView(name)

    # -- sketches ------------------------------------------------------------

    def _sketch_path(self, source_name: str) -> str:
        return f"{self._top(source_name)}/sketches"

    def _sketched(self, source_name: str) -> set[str]:
        """The ids of the batches that have sketches."""
        found = map(parse_batch, self._names(f"{self._sketch_path(source_name)}/ids=*/batch=*"))
        return {b.folder.split("/")[0][4:] for b in found if b}

    def _drop_sketches(self, source_name: str, ids: Iterable[str]) -> None:
        for one in set(ids):
            self._delete(f"{self._sketch_path(source_name)}/ids={one}")

    def sketch(self, source_name: str) -> None:
        """Sketch the batches that have none, in one job; from then on each append does so.

        A batch's sketches go before its rows change and come after them, so those that
        are there are right; what a lost driver left out is read from the rows.
        """
        there = self._sketched(source_name)
        seen = {b.folder.split("/")[0][4:] for b in self.batches(source_name)}
        self._drop_sketches(source_name, there - seen)
        fs, target = self._fs(self._sketch_path(source_name))
        fs.mkdirs(target)
        if seen - there:
            rows = self._rows(source_name)
            rows = rows.where(~F.col("ids").isin(sorted(there & seen))) if len(there) < len(seen - there) else rows.where(F.col("ids").isin(sorted(seen - there)))
            made = rows.groupBy(*_KEYS).agg(*stats.sketch_columns(source_name)).repartition("ids", "batch")
            writer = made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("ids", "batch").parquet(self._sketch_path(source_name))

    def sketches(self, source_name: str) -> DataFrame:
        """ids, batch, day and a sketch per dimension."""
        dims = [T.StructField(d, T.BinaryType()) for d in source(source_name).dims]
        schema = T.StructType([_PARTITIONS[2], *dims, *_PARTITIONS[:2]])
        if not self._exists(self._sketch_path(source_name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._sketch_path(source_name))

    def distinct_estimate(self, source_name: str, by: str, since: str, as_of: dt.datetime) -> DataFrame:
        """About how many different values a dimension takes in a window on receipt time.

        Days that lie in the window as a whole come from sketches. Rows are read of the
        day in which the window begins, if it begins within one, and of batches without
        sketches. :func:`stats.distinct_in_window` counts exactly.
        """
        cutoff = timestamp(as_of - parse_duration(since))
        whole = F.col("day") >= F.to_date(cutoff + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND"))
        seen = {b.folder.split("/")[0][4:] for b in self.batches(source_name)}
        there = self._sketched(source_name)
        stale, missing = sorted(there - seen), sorted(seen - there)
        kept = self.sketches(source_name).where(whole)
        kept = kept.where(~F.col("ids").isin(stale)) if stale else kept
        rows = self._rows(source_name).where((F.col("day") >= F.to_date(cutoff)) & (F.col("r_isodate") >= cutoff))
        rows = rows.where(~whole | F.col("ids").isin(missing) if missing else ~whole)
        fresh = rows.groupBy("day").agg(*stats.sketch_columns(source_name))
        dims = source(source_name).dims
        return stats.distinct_of_sketches(kept.select(*dims).unionByName(fresh.select(*dims)), source_name, by)

    # -- writing -------------------------------------------------------------

    def _stored_batch(self, source_name: str, name: str) -> Batch | None:
        found = self._names(f"{self.data_path(source_name)}/ids=*/batch={name}")
        return parse_batch(found[0]) if found else None

    def batch_time(self, source_name: str, batch: tuple[str, int]) -> dt.datetime:
        """The receipt time of a streaming writer's batch: what an earlier attempt stored, else now."""
        stored = self._stored_batch(source_name, f"{batch[0]}-{batch[1]}")
        if stored and stored in set(self.batches(source_name)):
            row = self.between(source_name, stored.base, stored.last).select("r_isodate").first()
            if row:
                return row.r_isodate.astimezone(dt.timezone.utc)
        return dt.datetime.now(dt.timezone.utc)

    def append(
        self,
        source_name: str,
        rows: DataFrame,
        batch: tuple[str, int] | None = None,
        order_by: Sequence[Column | str] = (),
    ) -> int:
        """Number and add rows; returns the largest id given out.

        ``batch`` is (writer name, batch number) of a streaming writer; writers of one
        table need names of their own. A repeated batch takes the ids of its earlier
        attempt and overwrites its rows, on whatever days those were. Every row needs
        a receipt time. ``order_by`` may name an ``id`` that the rows bring along, so that
        rows of one time keep its order; the stored ids are the store's own.
        """
        columns = [f.name for f in source(source_name).schema.fields if f.name != "id"]
        needed = F.coalesce("r_isodate", F.raise_error(F.lit("a row has no r_isodate")).cast("timestamp"))
        staging = scratch_path(self.spark, "append")
        try:
            own_order = [c for c in rows.columns if c == "id" and order_by]
            staged = assign_ids(rows.select(*own_order, *columns).withColumn("r_isodate", needed), 0, order_by, staging=staging)
            count = staged.count()
            if not count:
                return self.max_id(source_name)
            place = self._place(source_name, f"{batch[0]}-{batch[1]}" if batch else uuid.uuid4().hex, count)
            sketched = self._exists(self._sketch_path(source_name))
            if sketched:
                self._drop_sketches(source_name, [place.folder.split("/")[0][4:]])
            numbered = staged.withColumn("id", F.col("id") + F.lit(place.base))
            stored = promote.promote_fields(numbered, self._promotions(source_name)).withColumn("day", F.to_date("r_isodate"))
            own = [n for n in self.schema(source_name).names if n not in ("ids", "batch")]
            writer = promote.bloom_filters(stored.select(*own).write.mode("overwrite"), self._promotions(source_name))
            writer.partitionBy("day").parquet(f"{self.data_path(source_name)}/{place.folder}")
            if sketched:
                self.sketch(source_name)
        finally:
            self._delete(staging)
        return self.max_id(source_name)

    def _place(self, source_name: str, name: str, count: int) -> Batch:
        """The ids of a batch: those it had before if it has as many rows, else the next ones."""
        with _RESERVING:
            before = self._stored_batch(source_name, name)
            if before and before.last - before.base == count:
                return before
            if before:  # the batch came back with other rows
                self._delete(f"{self.data_path(source_name)}/{before.folder.split('/')[0]}")
            base = max(self.max_id(source_name), before.last if before else 0)
            place = Batch(base, base + count, name)
            fs, target = self._fs(f"{self.data_path(source_name)}/{place.folder}")
            fs.mkdirs(target)
            return place

    # -- rewriting -----------------------------------------------------------

    def _overwrite(self, source_name: str, rows: DataFrame) -> None:
        """Put rows in place of the partitions they came from."""
        writer = promote.bloom_filters(rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic"), self._promotions(source_name))
        writer.partitionBy(*_KEYS).parquet(self.data_path(source_name))

    def recover(self, source_name: str) -> None:
        """Finish an overwrite whose driver was lost while Spark exchanged partitions.

        Spark writes all partitions aside and then puts one after the other in place of
        the old one. Where the old one is gone, the new one is moved; the rest is left
        as it was. One job at a time rewrites a table, while appends go on.
        """
        data = self.data_path(source_name)
        for aside in self._names(f"{data}/.spark-staging-*"):
            for ready in self._names(f"{aside}/ids=*/batch=*/day=*"):
                target = f"{data}/{'/'.join(ready.rsplit('/', 3)[1:])}"
                fs, place = self._fs(target)
                if self._exists(target.rsplit("/", 1)[0]) and not fs.exists(place):
                    fs.rename(self._fs(ready)[1], place)
            self._delete(aside)

    def _some(self, source_name: str, keys: Sequence) -> DataFrame:
        """The rows of given partitions."""
        rows = self._rows(source_name)
        if not keys:
            return rows.limit(0)
        wanted = [F.struct(F.lit(k.ids).alias("ids"), F.lit(k.batch).alias("batch"), F.lit(str(k.day)).cast("date").alias("day")) for k in keys]
        return rows.where(F.col("day").isin([k.day for k in keys]) & F.struct(*_KEYS).isin(*wanted))

    def compact(self, source_name: str, day: str) -> None:
        """Merge batches without a row past ``day`` with their neighbours, into large files in id order.

        A batch written meanwhile stays as it is. A repeat of a merged batch would be
        a new one, so merge days that no stream repeats any more.
        """
        data, batches = self.data_path(source_name), self.batches(source_name)
        late = {parse_batch(p) for p in self._names(f"{data}/ids=*/batch=*/day=*") if p.rsplit("day=", 1)[1] > day}
        every, hidden = self._listed(source_name)
        runs: list[list[Batch]] = [[]]
        for batch in every:
            if batch in hidden and any(b.holds(batch) for b in batches):
                self._delete(f"{data}/{batch.folder.split('/')[0]}")  # merged before
            elif batch in late or batch in hidden:
                runs.append([])
            else:
                runs[-1].append(batch)
        for run in runs:
            if len(run) < 2:
                continue
            whole = Batch(run[0].base, run[-1].last, f"merged-{uuid.uuid4().hex}")
            fs = self._fs(data)[0]
            size = sum(fs.getContentSummary(self._fs(f"{data}/{b.folder}")[1]).getLength() for b in run)
            rows = self.between(source_name, whole.base, whole.last).drop("id_base")
            spread = rows.repartitionByRange(max(1, -(-size // _FILE_BYTES)), "day", "id").sortWithinPartitions("day", "id")
            promote.bloom_filters(spread.write.mode("overwrite"), self._promotions(source_name)).partitionBy("day").parquet(f"{data}/{whole.folder}")
            for batch in run:
                self._delete(f"{data}/{batch.folder.split('/')[0]}")
        if self._exists(self._sketch_path(source_name)):
            self.sketch(source_name)

    def prune(
        self,
        source_name: str,
        older_than: str,
        as_of: dt.datetime,
        column: str | None = None,
        dry_run: bool = False,
    ) -> int:
        """Delete rows past the age; returns how many (would) go.

        Partitions of which every row goes are dropped as folders, those of which some
        go are rewritten: by receipt time that is the boundary day alone.
        """
        self.recover(source_name)
        column = time_column(source(source_name), column, "r_isodate")
        gone = maintenance.expired(source_name, older_than, as_of, column)
        rows = self._rows(source_name)
        cutoff = as_of - parse_duration(older_than)
        if column == "r_isodate":
            rows = rows.filter(F.col("day") <= F.to_date(timestamp(cutoff)))
        counts = rows.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.count_if(gone).alias("gone")).filter(F.col("gone") > 0)
        touched = counts.collect()  # one row per partition, as in a listing
        if not dry_run:
            self._drop_sketches(source_name, [k.ids for k in touched])
            self._overwrite(source_name, self._some(source_name, [k for k in touched if k.gone < k.n]).filter(~gone))
            for k in touched:
                if k.gone == k.n:
                    self._delete(f"{self.data_path(source_name)}/ids={k.ids}/batch={k.batch}/day={k.day}")
            if touched and self._exists(self._sketch_path(source_name)):
                self.sketch(source_name)
        return sum(k.gone for k in touched)

    def reenrich(
        self,
        rules: Sequence[Rule],
        *,
        since: str | None = None,
        program: str | None = None,
        everything: bool = False,
        column: str | None = None,
        as_of: dt.datetime | None = None,
        limit: int | None = None,
        dry_run: bool = False,
    ) -> dict[str, int]:
        """Re-run the rules over stored syslog rows; a window reads its days only, and only partitions that change are rewritten."""
        if not rules:
            raise ValueError("there are no rules to enrich with")
        self.recover("syslog")
        scope = maintenance.reenrich_scope(since, program, everything, column, as_of)
        rows = self._rows("syslog")
        bound = day_filter(source("syslog"), since, as_of, column or "r_isodate") if since is not None else None
        near = rows if bound is None else rows.filter(bound)
        scope = scope & maintenance.limited(near.filter(scope), limit)
        done = maintenance.reenrich(near.filter(scope), rules)
        parts = done.groupBy(*_KEYS).agg(F.count("*").alias("scanned"), F.count_if("changed").alias("changed")).collect()
        report = {"scanned": sum(p.scanned for p in parts), "changed": sum(p.changed for p in parts)}
        changed = [p for p in parts if p.changed]
        if changed and not dry_run:
            whole = maintenance.reenrich(self._some("syslog", changed), rules, scope)
            fresh = whole.withColumn("raw", F.col("new_raw")).select(*rows.columns)
            promoted = list(self._promotions("syslog"))
            if promoted:
                plain = [c for c in fresh.columns if not c.startswith("field_")]
                fresh = promote.promote_fields(fresh.select(*plain), promoted).select(*rows.columns)
            self._overwrite("syslog", fresh)
        return report


def _base() -> Column:
    return F.substring("ids", 1, 20).cast("bigint")


def _last() -> Column:
    return F.substring("ids", 22, 20).cast("bigint")
