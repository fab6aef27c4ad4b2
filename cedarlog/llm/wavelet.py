"""Token files as wavelet matrices.

A shard is one file. Its tokens are kept as bit planes, the highest bit first; behind
each plane the tokens with a 0 in it come before those with a 1, in their order.
With a count of ones before every block, one walk over the planes gives the token at a
place (access), the occurrences of a token before a place (rank) and the place of its
k-th occurrence (select). A file is its planes, those counts, and the documents' ids
and lengths: about 17 bits a token at 50,257 ids, compressed further plane by plane
where that helps.

File: ``WVMX0001``, then the length of a JSON header (8 bytes), the header, and the
sections that it names, each raw or deflated.

* NULL is an empty text; it has its end id only.
* Rows are ordered by doc_id, NULL first, and rows with equal ids by a hash of the text.
* Other columns do not matter. An empty table gives no documents.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from cedarlog.llm.ngram_join import text_key
from cedarlog.llm.tokens import encoder
from cedarlog.session import materialize, scratch_path

MAGIC = b"WVMX0001"
#: Tokens after which a shard's file ends; a document is never split.
SHARD_TOKENS = 8 << 20
#: Bits of a plane between two counts.
STRIDE = 512


class WaveletMatrix:
    """Tokens behind bit planes. Build with :meth:`of`, or from a file by :func:`read_shard`."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], counts: list[np.ndarray]) -> None:
        self.n, self.planes, self.zeros, self.counts = n, planes, zeros, counts

    @classmethod
    def of(cls, tokens: np.ndarray) -> WaveletMatrix:
        n, planes, zeros, counts = len(tokens), [], [], []
        bits = max(1, int(tokens.max()).bit_length()) if n else 1
        for level in range(bits - 1, -1, -1):
            on = (tokens & tokens.dtype.type(1 << level)) != 0
            packed = np.packbits(on, bitorder="little")
            planes.append(packed)
            padded = np.pad(packed, (0, -len(packed) % (STRIDE // 8))).view(np.uint64).reshape(-1, STRIDE // 64)
            ones = np.bitwise_count(padded).sum(1, dtype=np.int64)
            counts.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))
            zeros.append(n - int(counts[-1][-1]))
            after = np.empty_like(tokens)
            np.compress(~on, tokens, out=after[: zeros[-1]])
            np.compress(on, tokens, out=after[zeros[-1] :])
            tokens = after
        return cls(n, planes, zeros, counts)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, rest = np.divmod(at, STRIDE)
        out = self.counts[level][block].astype(np.int64)
        plane = self.planes[level]
        for k in range(STRIDE // 8):
            byte = block * (STRIDE // 8) + k
            width = np.clip(rest - 8 * k, 0, 8)
            live = np.flatnonzero(width)
            if not len(live):
                break
            value = plane[byte[live]] & ((1 << width[live]) - 1).astype(np.uint8)
            out[live] += np.bitwise_count(value)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The tokens at places."""
        at = np.asarray(at, np.int64).copy()
        out = np.zeros(len(at), np.int64)
        for level, plane in enumerate(self.planes):
            on = (plane[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            ones = self._ones(level, at)
            out = out << 1 | on
            at = np.where(on, self.zeros[level] + ones, at - ones)
        return out

    def rank(self, token: int, at: int) -> int:
        """Occurrences of ``token`` before place ``at``."""
        lo, hi = self._range(token, at)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _range(self, token: int, at: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        lo, hi = 0, at
        for level in range(len(self.planes)):
            ones = self._ones(level, np.array([lo, hi]))
            if token >> (len(self.planes) - 1 - level) & 1:
                lo, hi = (self.zeros[level] + ones).tolist()
            else:
                lo, hi = (np.array([lo, hi]) - ones).tolist()
        return lo, hi

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0); -1 if there are fewer."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            # the block that holds the want-th such bit, then the bit in it
            counts = self.counts[level].astype(np.int64)
            if not one:
                counts = np.arange(len(counts)) * STRIDE - counts
            block = int(np.searchsorted(counts, want, "right")) - 1
            size = STRIDE // 8
            bits = np.unpackbits(self.planes[level][block * size : (block + 1) * size], bitorder="little")
            at = block * STRIDE + int(np.flatnonzero(bits == one)[want - int(counts[block])])
        return at

    def places(self, token: int) -> list[int]:
        """All occurrences."""
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All tokens: from the last plane up, each undoes its own stable partition."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        tokens = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            on = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros = self.zeros[level]
            up = np.empty_like(tokens)
            up[~on] = tokens[:zeros]
            up[on] = tokens[zeros:] | kind(1 << (len(self.planes) - 1 - level))
            tokens = up
        return tokens


class Shard(NamedTuple):
    matrix: WaveletMatrix
    doc_ids: pa.Array
    lengths: np.ndarray


def shard_bytes(tokens: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray) -> bytes:
    """The file of a shard."""
    m = WaveletMatrix.of(tokens)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", doc_ids.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([doc_ids], names=["doc_id"]))
    parts = [("ids", sink.getvalue().to_pybytes()), ("lengths", lengths.astype("<u8").tobytes())]
    parts += [(f"plane{k}", p.tobytes()) for k, p in enumerate(m.planes)]
    parts += [(f"count{k}", c.astype("<u4").tobytes()) for k, c in enumerate(m.counts)]
    sections, body = [], []
    for name, raw in parts:
        probe = raw[: 1 << 16]
        small = zlib.compress(raw, 1) if len(zlib.compress(probe, 1)) < 0.8 * len(probe) else raw
        deflated = len(small) < len(raw)
        sections.append([name, len(small) if deflated else len(raw), deflated])
        body.append(small if deflated else raw)
    header = json.dumps({"n": m.n, "docs": len(doc_ids), "zeros": m.zeros, "sections": sections}).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *body])


def parse_shard(data: bytes) -> Shard:
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    size = int.from_bytes(data[8:16], "little")
    header = json.loads(data[16 : 16 + size])
    at, found = 16 + size, {}
    for name, length, deflated in header["sections"]:
        raw = data[at : at + length]
        found[name] = zlib.decompress(raw) if deflated else raw
        at += length
    levels = range(len(header["zeros"]))
    matrix = WaveletMatrix(
        header["n"], [np.frombuffer(found[f"plane{k}"], np.uint8) for k in levels], header["zeros"],
        [np.frombuffer(found[f"count{k}"], "<u4") for k in levels],
    )
    ids = pa.ipc.open_stream(found["ids"]).read_all()["doc_id"].combine_chunks()
    return Shard(matrix, ids, np.frombuffer(found["lengths"], "<u8").astype(np.int64))


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def read_shard(uri: str) -> Shard:
    files, path = _file_system(uri)
    with files.open_input_stream(path) as f:
        return parse_shard(f.read())


def write_shards(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` in ascending doc_id order; returns the manifest: part, number, uri, tokens.

    Files get names of their own and the manifest, written last, names those of the
    attempts that counted; a repeated task leaves at most an unnamed file behind.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "wavelet")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"), text_key(F.col(text_col)).alias("tk"))
    kind = to_arrow_type(base.schema["doc_id"].dataType)
    ordered = base.repartitionByRange("doc_id", "tk").sortWithinPartitions("doc_id", "tk")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        files, top = _file_system(path)
        files.create_dir(top, recursive=True)
        tokens: list[np.ndarray] = []
        ids: list[pa.Array] = []
        lengths: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:05d}-{number:04d}-{uuid.uuid4().hex}.wvm"
            data = shard_bytes(np.concatenate(tokens), pa.concat_arrays(ids), np.array(lengths))
            with files.open_output_stream(f"{top}/{name}") as f:
                f.write(data)
            values = ([part], [number], [f"{path}/{name}"], [size])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["part", "number", "uri", "tokens"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                for coded in encoder(tokenizer).encode(rows.column(1).to_pylist()):
                    tokens.append(np.append(coded, np.uint16(end_id)))
                    lengths.append(len(coded) + 1)
                    size += len(coded) + 1
                ids.append(rows.column(0).cast(kind))
                if size >= SHARD_TOKENS:
                    yield flush()
                    tokens, ids, lengths, size, number = [], [], [], 0, number + 1
        if tokens:
            yield flush()

    return materialize(ordered.mapInArrow(write, "part int, number int, uri string, tokens long"), "wavelet-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone.

    Where a file begins is a running sum over the manifest, one row per file.
    """
    spark: SparkSession = manifest.sparkSession
    first = manifest.select("uri").first()
    kind = read_shard(first["uri"]).doc_ids.type if first else pa.int64()
    schema = f"doc_id {from_arrow_type(kind).simpleString()}, start long, n_tokens long, ids_crc32 long"
    base = F.sum("tokens").over(Window.orderBy("part", "number")) - F.col("tokens")
    files = manifest.select("uri", base.alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = read_shard(uri)
                tokens = shard.matrix.decode()
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(tokens[a:b].astype("<u4", copy=False)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([shard.doc_ids, pa.array(starts + base), pa.array(shard.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uri").mapInArrow(read, schema)
