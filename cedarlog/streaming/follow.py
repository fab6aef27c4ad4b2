"""Follow a store: new matching rows as their batches are there.

The store's ids are the stream. ``storeids`` is a source whose offset is the last id up to
which all batches are whole; it reads folder names only. A batch of the stream is one range
of ids, and Spark reads those rows from the store, wherever they are by then.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from cedarlog.functions.args import positive_or
from cedarlog.operators.filters import build_filter
from cedarlog.sources.store import Batch, LogStore, parse_batch

# Fixed value: seconds between polls.
POLL_SECONDS = 2


class IdReader(DataSourceStreamReader):
    def __init__(self, path: str, last: int, most: int):
        self.path, self.last, self.most = path, last, most
        self.at = 0

    def _folders(self, path: str) -> list[str]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path)
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [f.path for f in found if f.type == fs.FileType.Directory]

    def _whole(self, folder: str) -> bool:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(f"{self.path}/{folder}/_SUCCESS")
        return files.get_file_info(path).type == fs.FileType.File

    def initialOffset(self) -> dict:
        return {"last": self.last}

    def latestOffset(self) -> dict:
        """The last id before the first batch that is not whole; only folders with later ids than seen are looked into."""
        self.at = max(self.at, self.last)
        named = (parse_batch(f"{path}/batch=_") for path in self._folders(self.path))
        fresh = sorted(b for b in named if b and b.last > self.at)
        end = self.at
        for b in fresh:
            inner = [parse_batch(path) for path in self._folders(f"{self.path}/{b.folder.split('/')[0]}")]
            if not any(x and self._whole(x.folder) for x in inner):
                if any(x.holds(Batch(b.base, b.last, "")) or b.holds(x) for x in fresh if x != b):
                    continue  # being merged: its rows are in others as well
                break
            end = max(end, b.last)
        if self.most:
            end = min(end, self.at + self.most)
        return {"last": end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["last"])
        return [InputPartition((start["last"], end["last"]))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        low, high = partition.value
        if high > low:
            yield low, high


class IdSource(DataSource):
    """Options: ``path`` (a table's data folder), ``last`` (ids up to it are not shown), ``maxIdsPerBatch``."""

    @classmethod
    def name(cls) -> str:
        return "storeids"

    def schema(self) -> str:
        return "low long, high long"

    def streamReader(self, schema) -> IdReader:
        return IdReader(self.options["path"], int(self.options.get("last", 0)), int(self.options.get("maxIdsPerBatch", 0)))


def follow(
    store: LogStore,
    source_name: str,
    emit: Callable[[DataFrame, int], None],
    checkpoint: str,
    *,
    last: int = 0,
    interval: int | None = POLL_SECONDS,
    available_now: bool = False,
    max_ids: int = 0,
    clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc),
    **filters,
) -> StreamingQuery:
    """Hand rows with ``id`` past ``last`` that pass the filters to ``emit``, in id order.

    A batch is shown when all of it is there, once, whatever order its folders appeared
    in and whatever later rewrites or merges them; batches with later ids wait for it.
    The last id shown is the stream's offset in the checkpoint, so a restart goes on
    where it stopped. ``max_ids`` bounds the ids of a poll after a long pause (with
    ``available_now`` one such poll is made a run). A ``since`` window is taken anew,
    from ``clock``, at each poll.
    """
    store.spark.dataSource.register(IdSource)
    ids = store.spark.readStream.format("storeids").option("path", store.data_path(source_name)).option("last", last)
    if max_ids:
        ids = ids.option("maxIdsPerBatch", max_ids)

    def write(batch: DataFrame, number: int) -> None:
        span = batch.first()  # one row a batch
        if span is None:
            return
        wanted = build_filter(source_name, promoted=store.promoted(source_name), as_of=clock(), **filters)
        emit(store.between(source_name, span.low, span.high).filter(wanted).orderBy("id"), number)

    writer = ids.load().writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{positive_or(interval, POLL_SECONDS)} seconds").start()
