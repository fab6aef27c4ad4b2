"""``logfollow``: a streaming source over files that keep growing.

The built-in file source reads each file once and misses what is appended later.
This one keeps, per file, its inode and the byte offset read so far. The same
file, no shorter than before, goes on from there; a truncated one starts over. After
a rotation the old file's rest is read first, under whatever name it has in the
folder by then, and the new file from its beginning. Bytes come through unchanged,
also where they are not UTF-8. Only lines that end in a newline are taken.

A micro-batch takes at most ``maxBytesPerBatch`` of what is there, shared among the
files that have more; a line longer than its file's share is taken whole. A backlog of
any size so comes in batches of bounded size, each with an offset of its own in the
checkpoint, and a restart goes on from the last of them.

    spark.dataSource.register(LogFollowSource)
    spark.readStream.format("logfollow").option("path", "/srv/logs/web/*-access.log").load()

Files must be on a file system that driver and executors share.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_SCHEMA = "value string, path string"

# Bytes of a micro-batch, unless the option maxBytesPerBatch says otherwise.
_BATCH_BYTES = 1024 * 1024 * 1024
# Bytes one task reads, unless the option chunkBytes says otherwise.
_CHUNK = 64 * 1024 * 1024
_BATCH_LINES = 8192
_BACKWARD_STEP = 64 * 1024


@dataclass
class FileSlice(InputPartition):
    """The lines of one file that begin within ``[start, end)``; ``inode`` tells the file whatever its name."""

    path: str
    inode: int
    start: int
    end: int
    stop: int


def last_line_end(path: str, size: int, floor: int) -> int:
    """The offset just past the last newline in ``[floor, size)``, or ``floor``."""
    with open(path, "rb") as handle:
        at = size
        while at > floor:
            step = min(_BACKWARD_STEP, at - floor)
            handle.seek(at - step)
            found = handle.read(step).rfind(b"\n")
            if found >= 0:
                return at - step + found + 1
            at -= step
    return floor


def next_line_end(path: str, at: int, size: int) -> int:
    """The offset just past the first newline in ``[at, size)``, or ``size``."""
    with open(path, "rb") as handle:
        handle.seek(at)
        while at < size:
            step = min(_BACKWARD_STEP, size - at)
            found = handle.read(step).find(b"\n")
            if found >= 0:
                return at + found + 1
            at += step
    return size


def shares(wanted: dict[str, int], budget: int) -> dict[str, int]:
    """Bytes that each file gets of a batch: all it wants where that is below an equal share, and so on with the rest."""
    out: dict[str, int] = {}
    for left, (path, n) in zip(range(len(wanted), 0, -1), sorted(wanted.items(), key=lambda x: x[1]), strict=True):
        out[path] = min(n, max(budget // left, 1))
        budget = max(budget - out[path], 0)
    return out


def resume_offset(known: dict | None, inode: int, size: int) -> int | None:
    """Where to go on in a file: its saved offset, 0 after rotation, None if never seen."""
    if known is None:
        return None
    return known["offset"] if known["inode"] == inode and size >= known["offset"] else 0


def find_inode(path: str, inode: int) -> str | None:
    """The name that a file of the folder of ``path`` has now: its own, or the one it was rotated to."""
    folder = os.path.dirname(path) or "."
    try:
        names = [path, *sorted(entry.path for entry in os.scandir(folder))]
    except OSError:
        names = [path]
    for name in names:
        try:
            if os.stat(name).st_ino == inode:
                return name
        except OSError:
            continue
    return None


class LogFollowReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        # Option names arrive in lower case from a query.
        given = {name.lower(): value for name, value in options.items()}
        if not given.get("path"):
            raise ValueError("logfollow needs the option path")
        self.pattern = given["path"]
        first, later = given.get("startingoffset", "latest"), given.get("newfileoffset", "earliest")
        for value in (first, later):
            if value not in ("earliest", "latest"):
                raise ValueError(f"starting offsets are earliest or latest, got {value!r}")
        self.first, self.later = first, later
        self.chunk = int(given.get("chunkbytes", _CHUNK))
        self.most = int(given.get("maxbytesperbatch", _BATCH_BYTES))
        if self.chunk < 1 or self.most < 1:
            raise ValueError("chunkBytes and maxBytesPerBatch are at least 1")
        self._known: dict = {}
        self._past: dict = {}

    def _files(self) -> list[tuple[str, os.stat_result]]:
        out = []
        for path in sorted(glob.glob(self.pattern)):
            try:
                if os.path.isfile(path):
                    out.append((path, os.stat(path)))
            except OSError:
                continue
        return out

    def initialOffset(self) -> dict:
        return {
            path: {"inode": st.st_ino, "offset": 0 if self.first == "earliest" else last_line_end(path, st.st_size, 0)}
            for path, st in self._files()
        }

    def latestOffset(self) -> dict:
        """Ends of whole lines, no more than a batch may take past those planned before; files that are gone keep their last position."""
        known = self._known = {**self._past, **self._known}
        ends, rests, wanted = {}, {}, {}
        for path, st in self._files():
            before = known.get(path)
            floor = resume_offset(before, st.st_ino, st.st_size)
            try:
                end = last_line_end(path, st.st_size, floor or 0)
            except OSError:
                continue
            start = floor if floor is not None else 0 if self.later == "earliest" else end
            if before and before["inode"] != st.st_ino and (rest := self._rest(path, before)):
                rests[path] = rest
            ends[path] = (st.st_ino, start, end)
            wanted[path] = end - start + (rests[path]["end"] - rests[path]["start"] if path in rests else 0)
        given = shares({path: n for path, n in wanted.items() if n}, self.most)
        out = dict(known)
        for path, (inode, start, end) in ends.items():
            room = given.get(path, 0)
            if path in rests:
                rest = rests[path]
                if rest["end"] - rest["start"] > room:  # the rotated file first, as far as the batch goes
                    out[path] = {"inode": rest["inode"], "offset": self._cut(rest["name"], rest["start"], rest["end"], room)}
                    continue
                room -= rest["end"] - rest["start"]
            at = self._cut(path, start, end, room) if room or path not in rests else start
            out[path] = {"inode": inode, "offset": at}
            if path in rests:
                out[path]["rest"] = {k: v for k, v in rests[path].items() if k != "name"}
        self._known = out
        return out

    @staticmethod
    def _cut(path: str, start: int, end: int, room: int) -> int:
        """The end of the whole lines in the first ``room`` bytes; of one line if it is longer."""
        if end - start <= room:
            return end
        try:
            at = last_line_end(path, start + room, start)
            return at if at > start else next_line_end(path, start + room, end)
        except OSError:
            return start

    def _rest(self, path: str, before: dict) -> dict | None:
        """What a rotated file still has past the offset read so far."""
        name = find_inode(path, before["inode"])
        if name is None:
            return None  # deleted: its rest cannot be read any more
        try:
            end = last_line_end(name, os.stat(name).st_size, before["offset"])
        except OSError:
            return None
        found = {"name": name, "inode": before["inode"], "start": before["offset"], "end": end}
        return found if end > before["offset"] else None

    def partitions(self, start: dict, end: dict) -> list[FileSlice]:
        # A file can drop out of the offsets over a restart while it is away.
        self._past.update(start)
        self._known.update(end)  # after a restart: what was planned last
        slices = []
        for path, target in sorted(end.items()):
            known = start.get(path) or self._past.get(path)
            if known is None:
                begin = 0 if self.later == "earliest" else target["offset"]
            else:
                begin = resume_offset(known, target["inode"], target["offset"])
            rest = target.get("rest")
            if rest and known and known["inode"] == rest["inode"]:
                for low in range(known["offset"], rest["end"], self.chunk):
                    slices.append(FileSlice(path, rest["inode"], low, min(low + self.chunk, rest["end"]), rest["end"]))
            for low in range(begin, target["offset"], self.chunk):
                high = min(low + self.chunk, target["offset"])
                slices.append(FileSlice(path, target["inode"], low, high, target["offset"]))
        return slices

    def read(self, partition: FileSlice) -> Iterator[pa.RecordBatch]:
        """A line belongs to the slice its first byte is in."""
        lines: list[bytes] = []

        def batch() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, lines)]).astype(np.int32)
            buffers = [None, pa.py_buffer(ends), pa.py_buffer(b"".join(lines))]
            value = pa.Array.from_buffers(pa.string(), len(lines), buffers)  # bytes that are not UTF-8 stay as they are
            return pa.RecordBatch.from_arrays([value, pa.array([partition.path] * len(lines))], names=["value", "path"])

        while True:
            name = find_inode(partition.path, partition.inode)
            if name is None:
                raise FileNotFoundError(f"{partition.path} was to be read up to byte {partition.end}, but is gone")
            handle = open(name, "rb")
            if os.fstat(handle.fileno()).st_ino == partition.inode:
                break
            handle.close()  # rotated just now: look again
        with handle:
            at = partition.start
            handle.seek(max(at - 1, 0))
            if at > 0 and handle.read(1) != b"\n":
                at += len(handle.readline())
            while at < partition.end:
                line = handle.readline(partition.stop - at)
                if not line.endswith(b"\n"):
                    break
                at += len(line)
                lines.append(line[:-1])
                if len(lines) == _BATCH_LINES:
                    yield batch()
                    lines.clear()
        if lines:
            yield batch()


class LogFollowSource(DataSource):
    """Options: ``path`` (a glob), ``startingOffset`` for files present at the start
    (default latest), ``newFileOffset`` for files that appear later (default
    earliest), ``maxBytesPerBatch`` of a micro-batch, ``chunkBytes`` per task."""

    @classmethod
    def name(cls) -> str:
        return "logfollow"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> LogFollowReader:
        return LogFollowReader(dict(self.options))
