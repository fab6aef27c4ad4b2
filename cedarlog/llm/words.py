"""Words and lines of a whole column of texts at once, on the UTF-8 bytes of its Arrow buffers.

A word is a maximal run of ``[0-9a-z]`` and non-ASCII characters after A-Z are
lower-cased. Every function takes whole texts; only the working memory is cut into
chunks, always between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _splitmix(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit values so that close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix64 = _splitmix

_BYTES = np.arange(256)
IS_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
IS_WORD |= (_BYTES >= 0x41) & (_BYTES <= 0x5A)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: One random value per byte, the same for a capital and its small letter.
BYTE_VALUE = _splitmix(LOWER.astype(np.uint64) * np.uint64(_BASE) + np.uint64(1))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = np.full(n + (n >> 2), _BASE if kind == "up" else _INVERSE, np.uint64)
        base[0] = 1
        _powers[kind] = np.multiply.accumulate(base)
    return _powers[kind][:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and the n + 1 bounds; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, bounds - bounds[0]


def _cuts(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Chunks of about ``size`` bytes that end where no word goes on."""
    at, n = 0, len(data)
    while at < n:
        end = at + size
        if end >= n:
            end = n
        else:
            border = int(bounds[np.searchsorted(bounds, end)])
            while end < border:
                gap = np.flatnonzero(~IS_WORD[data[end : min(border, end + 65536)]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(border, end + 65536)
        yield at, end
        at = end


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, length, 64-bit hash) of each word, in order; no word spans two texts."""
    firsts, lengths, hashes = [], [], []
    for lo, hi in _cuts(data, bounds, CHUNK):
        part = data[lo:hi]
        on = np.zeros(len(part) + 2, bool)
        on[1:-1] = IS_WORD[part]
        edges = on[1:] != on[:-1]
        inner = np.unique(bounds[np.searchsorted(bounds, lo, "right") : np.searchsorted(bounds, hi, "left")]) - lo
        both = inner[on[inner] & on[inner + 1]]  # two texts meet inside a run
        edge = np.flatnonzero(edges)
        if len(both):
            edge = np.sort(np.concatenate([edge, both, both]))
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[part] * _power("up", len(part)), out=total[1:])
        value = (total[end] - total[start]) * _power("down", len(part) + 1)[start]
        firsts.append(start + lo)
        lengths.append(end - start)
        hashes.append(_splitmix(value + (end - start).astype(np.uint64)))
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(lengths), np.concatenate(hashes)


def word_bounds(first: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """n + 1 bounds of each text's words."""
    return np.searchsorted(first, bounds, "left")


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each text, and their bounds.

    A text with fewer words, but not none, has one shingle of all its words.
    """
    count = np.diff(bounds)
    many = np.maximum(count - width + 1, (count > 0).astype(count.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(many)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], many) + np.arange(out_bounds[-1])
    span = np.repeat(np.minimum(count, width), many)
    value = np.zeros(len(first), np.uint64)
    factor = 1
    for k in range(width):
        inside = span > k
        at = np.minimum(first + k, max(len(hashes) - 1, 0))
        if len(first):
            value += np.where(inside, hashes[at] * np.uint64(factor), np.uint64(0))
        factor = factor * _BASE % (1 << 64)
    return _splitmix(value + span.astype(np.uint64)), out_bounds


def sorted_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each part, ascending, and their bounds."""
    values = values.copy()
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[lo:hi].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
