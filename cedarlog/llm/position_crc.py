"""CRC-32 of many spans of a byte buffer at once.

A checksum is linear in the message's bits but for a constant that depends on its length.
So a byte contributes a value that depends only on the byte and its distance from the
span's end. Those contributions are looked up in one table and XORed per span by
``bitwise_xor.reduceat``. Spans longer than the table are cut into blocks from their end;
neighbouring blocks are folded in pairs, the left one moved on by the right one's length.
"""

from __future__ import annotations

import numpy as np

#: Distances the table covers; longer spans are folded from blocks of so many bytes.
BLOCK = 64
#: Bytes looked up at a time.
STEP_BYTES = 1 << 18
_POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(_POLYNOMIAL), value >> 1).astype(np.uint32)
    return value


_NEXT = _byte_table()


def _one_on(state: np.ndarray) -> np.ndarray:
    """States after one more zero byte."""
    return (state >> np.uint32(8)) ^ _NEXT[state & np.uint32(0xFF)]


def _positions() -> np.ndarray:
    table = np.zeros((BLOCK, 256), np.uint32)
    table[0] = _NEXT
    for k in range(1, BLOCK):
        table[k] = _one_on(table[k - 1])
    return table


#: POSITIONS[d, b]: what byte b contributes with d bytes behind it.
POSITIONS = _positions().ravel()


def _apply(zeros: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = zeros[0][state & np.uint32(0xFF)]
    for k in (1, 2, 3):
        out = out ^ zeros[k][(state >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def _zero_tables(count: int = 40) -> list[np.ndarray]:
    """The k-th moves a state on by 2**k zero bytes, one table for each byte of the state."""
    state = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    out = [_one_on(state)]
    for _ in range(count - 1):
        out.append(_apply(out[-1], out[-1]))
    return out


_ZEROS = _zero_tables()


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of so many zero bytes each."""
    state = np.full(len(lengths), _ONES, np.uint32)
    left, k = lengths.copy(), 0
    while len(left) and left.max() > 0:
        odd = (left & 1).astype(bool)
        state[odd] = _apply(_ZEROS[k], state[odd])
        left >>= 1
        k += 1
    return state ^ _ONES


_CONSTANTS = length_constants(np.arange(BLOCK + 1))


def _linear(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XOR of the contributions of spans of 1 to BLOCK bytes."""
    ends = np.cumsum(length)
    starts = ends - length
    span = np.repeat(np.arange(len(first)), length)
    inside = np.arange(ends[-1]) - starts[span]
    distance = length[span] - 1 - inside
    return np.bitwise_xor.reduceat(POSITIONS[distance * 256 + data[first[span] + inside]], starts)


def _short(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first), np.uint32)
    total = np.cumsum(length)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + STEP_BYTES, "right")))
        out[lo:hi] = _linear(data, first[lo:hi], length[lo:hi])
        lo = hi
    return out


def _long(data: np.ndarray, first: int, length: int) -> int:
    """The linear part of one span of more than BLOCK bytes."""
    size = np.full(-(-length // BLOCK), BLOCK, np.int64)
    size[0] = length - BLOCK * (len(size) - 1)
    value = _short(data, first + np.cumsum(size) - size, size)
    k = BLOCK.bit_length() - 1
    while len(value) > 1:  # all blocks but the first are whole, and zeros before it would add nothing
        if len(value) & 1:
            value = np.concatenate([np.zeros(1, np.uint32), value])
        value = _apply(_ZEROS[k], value[0::2]) ^ value[1::2]
        k += 1
    return int(value[0])


def span_crc32(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``data[first : first + length]`` for each span, as uint32."""
    first, length = np.asarray(first, np.int64), np.asarray(length, np.int64)
    out = np.zeros(len(first), np.uint32)
    small = (length > 0) & (length <= BLOCK)
    if small.all():
        return _short(data, first, length) ^ _CONSTANTS[length] if len(first) else out
    out[small] = _short(data, first[small], length[small]) ^ _CONSTANTS[length[small]]
    large = np.flatnonzero(length > BLOCK)
    if len(large):
        linear = np.array([_long(data, int(first[k]), int(length[k])) for k in large.tolist()], np.uint32)
        out[large] = linear ^ length_constants(length[large])
    return out
