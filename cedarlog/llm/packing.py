"""Best-fit packing by minimum bin slack.

What fits together depends on lengths alone, and there are at most ``capacity`` of
them. So bins are planned on the histogram of piece lengths: the longest length left
is put into a bin, a bitset subset-sum finds the fullest feasible combination of the
lengths left, and the combination is taken as often as the histogram allows. Each
combination uses up a length, so a plan has at most ``capacity`` of them however many
pieces there are. Pieces are then numbered within their length, and the number tells
the bin.

* NULL text is an empty text; each document still has its end id, so each has a piece.
* Repeated rows and equal or NULL doc_ids are packed each for itself.
* Other columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cedarlog.llm.tokens import encoder
from cedarlog.session import materialize


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Which available lengths, how often each, sum to the most that ``room`` holds.

    Bit s of ``reach`` says that some combination sums to s. Long lengths come first,
    and the search ends as soon as the room can be filled.
    """
    reach, steps = 1, []
    full = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        take = 1
        while left > 0:
            take = min(take, left)
            more = reach | (reach << (length * take)) & full
            if more != reach:
                steps.append((length, take, reach))
                reach = more
            left -= take
            take *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how often in the bin}) for all bins."""
    left = {length: n for length, n in histogram.items() if n > 0}
    out = []
    while left:
        longest = max(left)
        rest = {length: n - (length == longest) for length, n in left.items() if length <= capacity - longest}
        chosen = fullest({length: n for length, n in rest.items() if n > 0}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[length] // n for length, n in chosen.items())
        out.append((times, chosen))
        for length, n in chosen.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return out


def _pieces(path: str, end_id: int, capacity: int, kind: pa.DataType):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rank: dict[int, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple] = []
                for k, ids in enumerate(encoder(path).encode(part.column(1).to_pylist())):
                    ids = np.append(ids, end_id).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        n = rank[len(own)] = rank.get(len(own), -1) + 1
                        rows.append((k, piece, start, len(own), zlib.crc32(own), n))
                at, *columns = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(kind).take(pa.array(at)), *map(pa.array, columns), pa.array(np.full(len(at), task))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"],
                )

    return cut


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's number among those of its length in its task."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, piece long, start long, length long, ids_crc32 long, rank long, task long"
    return materialize(base.mapInArrow(_pieces(tokenizer, end_id, capacity, to_arrow_type(kind)), schema), "pieces")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    # per length: where each combination's numbers begin, and what they mean
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for times, chosen in plan(histogram, capacity):
        place = 0
        for length in sorted(chosen, reverse=True):
            slots.setdefault(length, []).append((given.get(length, 0), chosen[length], sequence, place))
            given[length] = given.get(length, 0) + times * chosen[length]
            place += length * chosen[length]
        sequence += times
    tables = docs.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in slots.items()})  # bounded by capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence_id, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                begin, each, first, inside = tables.value[size].T
                k = np.searchsorted(begin, number[at], "right") - 1
                nth = number[at] - begin[k]
                sequence_id[at] = first[k] + nth // each[k]
                offset[at] = inside[k] + nth % each[k] * size
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(c) for c in names] + [pa.array(sequence_id), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    # numbers of a length before each task: a running sum over one row per task and length
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    numbered = pieces.join(counts.select("task", "length", before.alias("before")), ["task", "length"])
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    rows = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before").mapInArrow(place, schema)
    return rows.withColumn("piece", F.col("piece").cast("int"))
