"""Fuzzy line deduplication over a corpus.

Lines are normalised to their lower-case words. Equal ones are one node from the
start. Nodes get MinHash values of their distinct words; nodes that agree on all values
of one of ``TABLES`` tables meet in a bucket. Of those, pairs whose 64-bit SimHashes
differ in ``MAX_BITS`` bits at most are verified by edit similarity, and of each
connected group the first occurrence, by (doc_id, line number), stays.

The tables follow from the threshold: at edit similarity 0.8 a fifth of the words may
be others, which leaves a Jaccard similarity of 2/3 of the word sets. 24 tables of 5
values find such a pair with 97 %, one with a word of eight replaced with 99.9 %. The
SimHashes of such a pair differ in 13 bits, with a deviation of 3.

Pairs are never rows: nodes go to their buckets' hubs, and a task compares a block
of nodes with a block, testing only pairs that are not connected yet.

Buckets travel as blocks: the entries that some lines have in a range of bucket hashes
are one row, and a task sorts the entries of a range.

* NULL and empty texts have no lines. Lines without words are neither counted nor removed.
* Rows with NULL doc_id come last in the order; equal doc_ids are ordered by a hash of the text.
* Rows with equal doc_id and text are one document: each keeps the same lines.
* Other columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cedarlog.llm import words as W
from cedarlog.llm.edits import Letters, within
from cedarlog.llm.groups import Forest, components, hub_blocks
from cedarlog.llm.ngram_join import BROADCAST_KEYS, text_key
from cedarlog.llm.rows import column, nested
from cedarlog.session import fits_broadcast, materialize

#: SimHash bits in which a pair that is verified may differ.
MAX_BITS = 22
TABLES, ROWS_A_TABLE = 24, 5
#: Odd multipliers of the MinHash permutations of word hashes.
MULTIPLIERS = W.mix64(np.arange(1, TABLES * ROWS_A_TABLE + 1, dtype=np.uint64)) | np.uint64(1)
#: The bits of each byte as eight bytes.
BIT_BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]
#: Nodes in a block of a task.
BLOCK = 512
#: Rows, pairs and bytes that a task verifies at a time; a group of a block pair stays whole.
ROWS, PAIRS, BYTES = 32768, 1 << 21, 16 << 20
#: Bucket members that are compared with each other before the join; longer buckets go on whole.
NEIGHBOURS = 256
#: Entries of a range of bucket hashes, on average, and those a task holds before it passes long buckets on.
RANGE, ENTRIES = 1 << 17, 1 << 22
#: Lines whose entries are dealt to ranges together.
LINES = 1 << 16
#: Words of either line that may be passed over to find where an alignment goes on.
AHEAD = 6
HAS_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def simhash(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The majority of each bit over the distinct words of each part; parts are not empty.

    Each word counts once: by their counts, long texts of one language are all alike.
    """
    hashes, bounds = W.sorted_sets(hashes, bounds)
    out = np.zeros(len(bounds) - 1, np.uint64)
    at = 0
    while at < len(out):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 65536, "right")) - 1)
        lo, hi = bounds[at], bounds[end]
        size = np.diff(bounds[at : end + 1])
        # up to 255 words are added with a byte for each bit, eight at a time
        runs = (size + 254) // 255
        first = np.cumsum(runs) - runs
        starts = np.repeat(bounds[at:end] - lo, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
        bits = BIT_BYTES[hashes[lo:hi].view(np.uint8)].reshape(-1, 8)
        votes = np.add.reduceat(bits, starts, axis=0).view(np.uint8)
        if len(starts) > end - at:
            votes = np.add.reduceat(votes, first, axis=0, dtype=np.int32)
        out[at:end] = np.packbits(2 * votes.astype(np.int32) > size[:, None], axis=1).view(np.uint64)[:, 0]
        at = end
    return out


def minhash_tables(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of TABLES 32-bit values of each part; equal word sets have equal rows. Parts are not empty."""
    out = np.zeros((len(bounds) - 1, TABLES), np.uint64)
    at = 0
    while at < len(out):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 65536, "right")) - 1)
        own, first = hashes[bounds[at] : bounds[end]], bounds[at:end] - bounds[at]
        for k, factor in enumerate(MULTIPLIERS):
            table = out[at:end, k // ROWS_A_TABLE]
            table[:] = W.mix64(table * np.uint64(W._BASE) + np.minimum.reduceat(own * factor, first))
        at = end
    return (out >> np.uint64(32)).astype(np.uint32)


def line_parts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, line number, hash) of the lines with words, the hashes of all words, and the bounds of each line's."""
    first, _, hashes = W.words(data, bounds)
    ends = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], ends + 1]))
    line_words = np.append(np.searchsorted(first, starts, "left"), len(first))
    has = np.flatnonzero(np.diff(line_words))
    # a newline that ends a text gives a start equal to the next text's: it has no words of its own
    text = np.searchsorted(bounds, starts[has], "right") - 1
    number = np.searchsorted(ends, starts[has]) - np.searchsorted(ends, bounds[text])
    part = np.append(line_words[has], len(first))
    if not len(has):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), hashes, part
    inside = np.arange(len(first)) - np.repeat(part[:-1], np.diff(part))
    factor = W._power("up", int(inside.max()) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix64(hashes) * factor[inside])])
    n = np.diff(part)
    key = W.mix64(total[part[1:]] - total[part[:-1]] + n.astype(np.uint64))
    return text, number, key, hashes, part


def _lines(kind: pa.DataType):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                data, bounds = W.text_bytes(batch.column(2).slice(at))
                take = min(max(1, int(np.searchsorted(bounds, 4 << 20, "right")) - 1), batch.num_rows - at)
                text, number, key, hashes, part = line_parts(data[: bounds[take]], bounds[: take + 1])
                sim, tables = simhash(hashes, part), minhash_tables(hashes, part)
                ids = batch.column(0).slice(at, take).cast(kind).take(pa.array(text))
                tk = batch.column(1).slice(at, take).take(pa.array(text))
                at += take
                starts = pa.array(np.arange(len(tables) + 1, dtype=np.int32) * TABLES)
                lists = pa.ListArray.from_arrays(starts, pa.array(tables.view(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids, tk, pa.array(number.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(sim.view(np.int64)), lists],
                    names=["doc_id", "tk", "line", "key", "sim", "tables"],
                )

    return lines


def _deal(ranges: int):
    """(range, entries): the buckets of some lines and their sims, a row for each range of bucket hashes."""

    def rows(sims: list[np.ndarray], tables: list[np.ndarray]) -> pa.RecordBatch:
        sim, values = np.concatenate(sims), np.concatenate(tables).view(np.uint32).astype(np.uint64).reshape(-1, TABLES)
        bucket = W.mix64(values + (np.arange(1, TABLES + 1, dtype=np.uint64) << np.uint64(32))).ravel()
        part = (bucket >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        order = np.argsort(part.astype(np.uint16 if ranges <= 65536 else np.uint32), kind="stable")
        part = part[order]
        entries = np.stack([bucket[order], sim.view(np.uint64)[order // TABLES]], axis=1)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        offsets = np.append(first, len(part)).astype(np.int32) * 16
        data = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(entries)])
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), data], names=["range", "entries"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sims, tables, n = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sims.append(batch.column(0).to_numpy())
            tables.append(batch.column(1).flatten().to_numpy())
            n += batch.num_rows
            if n >= LINES:
                yield rows(sims, tables)
                sims, tables, n = [], [], 0
        if n:
            yield rows(sims, tables)

    return deal


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, sim) of the bucket members that have a neighbour within MAX_BITS; rows of ``_deal`` sorted by range."""

    def out(hub: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hub), pa.array(sim)], names=["hub", "sim"])

    def settle(bucket: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(bucket[1:] == bucket[:-1])
        first = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])[: len(bucket)]
        size = np.diff(np.append(first, len(bucket)))
        long = np.repeat(size > NEIGHBOURS, size)
        hub = np.repeat(first, size)
        hub[~long] = np.flatnonzero(~long)
        unsigned = sim.view(np.uint64)
        xs, ys = [], []
        for d in range(1, NEIGHBOURS):
            at = at[at + d < len(bucket)]
            at = at[(bucket[at] == bucket[np.minimum(at + d, len(bucket) - 1)]) & ~long[at]]
            if not len(at):
                break
            pair = at[np.bitwise_count(unsigned[at] ^ unsigned[at + d]) <= MAX_BITS]
            xs.append(pair)
            ys.append(pair + d)
        near = long
        if xs:
            x, y = np.concatenate(xs), np.concatenate(ys)
            near = long.copy()
            near[x] = near[y] = True
            # the hub of a short bucket's member is the first of those it is near to, directly or through others
            while True:
                low = np.minimum(hub[x], hub[y])
                if (low == hub[x]).all() and (low == hub[y]).all():
                    break
                np.minimum.at(hub, x, low)
                np.minimum.at(hub, y, low)
        return out(sim[hub[near]], sim[near])

    def members(entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The buckets and sims of those that are not alone in their bucket, in this order."""
        every = np.concatenate(entries)
        order = np.argsort(every[:, 0])
        same = every[order[1:], 0] == every[order[:-1], 0]
        every = every[order[np.append(same, False) | np.append(False, same)]]
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        return every[:, 0].copy(), every[:, 1].copy()

    def relieve() -> Iterator[pa.RecordBatch]:
        """Pass the buckets on that have grown long, and take their later members out of what is held."""
        nonlocal held, n
        every = np.concatenate(held)
        bucket, sim = members([every])
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(bucket)))
        for at in first[size > 16 * NEIGHBOURS].tolist():
            hubs.setdefault(int(bucket[at]), int(sim[at]))
        known = np.array(sorted(hubs), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, every[:, 0]), len(known) - 1)
            gone = known[at] == every[:, 0]
            hub = np.array([hubs[k] for k in known.tolist()], np.int64)[at[gone]]
            if len(hub):
                yield out(hub, every[gone, 1])
            every = every[~gone]
        held, n = [every], len(every)

    held: list[np.ndarray] = []
    hubs: dict[int, int] = {}  # long buckets of this range that were passed on in part, and their hubs
    n, now, most = 0, None, ENTRIES
    for batch in batches:
        for part, entries in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != now:
                if n:
                    yield from relieve() if hubs else ()
                    yield settle(*members(held))
                held, hubs, n, now, most = [], {}, 0, part, ENTRIES
            held.append(np.frombuffer(entries.as_buffer(), np.int64).reshape(-1, 2))
            n += len(held[-1])
            if n > most:
                yield from relieve()
                most = max(ENTRIES, 2 * n)
    if n:
        yield from relieve() if hubs else ()
        yield settle(*members(held))


def edit_distance(a: str, b: str, most: float = float("inf")) -> float:
    """Levenshtein distance, a bit vector per column; shared ends are cut off first.

    Infinite as soon as the distance must be over ``most``.
    """
    if a == b:
        return 0
    n = min(len(a), len(b))
    lo, hi = 0, n
    while lo < hi:  # longest common prefix
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid :] == b[len(b) - mid :] else (lo, mid - 1)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        eq = where.get(c, 0)
        x = eq | minus
        d0 = (((eq & plus) + plus) ^ plus) | x
        up, down = minus | (full & ~(d0 | plus)), plus & d0
        score += bool(up & top) - bool(down & top)
        if score - left > most:
            return float("inf")
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(d0 | up)), up & d0
    return score


def _meet(x: list[str], y: list[str], i: int, j: int) -> tuple[int, int]:
    """The nearest places from i and j on where two words are equal; the ends if there are none near."""
    n, m = len(x) - i, len(y) - j
    if n and m:
        for reach in range(2 * AHEAD + 1):
            for di in range(max(0, reach - AHEAD, reach - m + 1), min(reach, AHEAD, n - 1) + 1):
                p, q = i + di, j + reach - di
                if x[p] == y[q] and x[p + 1 : p + 2] == y[q + 1 : q + 2]:
                    return p, q
    return len(x), len(y)


def aligned_distance(a: str, b: str, most: float = float("inf")) -> float:
    """Edits of one alignment, by equal words near each other: never less than the distance.

    Only the words between those are compared by their characters. Infinite as soon as
    it must be over ``most``, or when no words meet.
    """
    x, y = a.split(" "), b.split(" ")
    i = j = 0
    edits = 0.0
    while edits <= most and (i < len(x) or j < len(y)):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p, q = _meet(x, y, i, j)
        if not (i or j) and p == len(x) and q == len(y):
            return float("inf")
        # each word with the space behind it: the last one's, in both texts, costs no edit
        edits += edit_distance("".join(w + " " for w in x[i:p]), "".join(w + " " for w in y[j:q]), most - edits)
        i, j = p, q
    return edits


def _similar(a: str, b: str, threshold: float) -> bool:
    longest = max(len(a), len(b))
    room = longest * (1 - threshold) + 1e-9
    if longest - min(len(a), len(b)) > room:
        return False
    return aligned_distance(a, b, room) <= room or edit_distance(a, b, room) <= room


def _normal(line: str) -> str:
    data = np.frombuffer(line.encode(), np.uint8)
    kept = np.where(W.IS_WORD[data], W.LOWER[data], 32).astype(np.uint8)
    return " ".join(kept.tobytes().decode().split(" ")).strip() if len(data) else ""


class Texts:
    """The normalised lines of a column: words with one space between them."""

    def __init__(self, column: pa.Array) -> None:
        data, bounds = W.text_bytes(column)
        first, length, _ = W.words(data, bounds)
        part = W.word_bounds(first, bounds)
        ends = np.cumsum(length + 1)  # each word with a space behind it
        at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        at += np.repeat((first - (ends - length - 1)).astype(np.int32), length + 1)
        self.data = W.LOWER[data[np.minimum(at, len(data) - 1)]] if len(at) else np.zeros(0, np.uint8)
        self.data[ends - 1] = 32
        ends = np.append(0, ends)[part]
        self._cut(ends[:-1], np.maximum(ends[1:] - 1, ends[:-1]))
        if any(chr(c).isspace() and c != 32 for c in np.flatnonzero(np.bincount(self.points))):
            own = [" ".join(self[k].split()).encode() for k in range(len(bounds) - 1)]
            self.data = np.frombuffer(b"".join(own), np.uint8)
            ends = np.cumsum([0, *map(len, own)])
            self._cut(ends[:-1], ends[1:])
        self.letters = Letters(self.points, self.chars[self.starts].astype(np.int64), self.chars[self.ends].astype(np.int64))
        del self.points, self.chars, at

    def _cut(self, starts: np.ndarray, ends: np.ndarray) -> None:
        self.starts, self.ends = starts, ends
        self.points = np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        self.chars = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum((self.data & 0xC0) != 0x80, out=self.chars[1:])

    def __getitem__(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode()

    def bigram_counts(self) -> np.ndarray:
        """How often pairs of neighbouring bytes stand in each text, in 256 bins; counts stop at 255."""
        n = len(self.starts)
        out = np.zeros((n, 256), np.uint8)
        pair = (self.data[:-1].astype(np.uint32) * 167 + self.data[1:].astype(np.uint32) * 59) & 255
        many = np.maximum(self.ends - self.starts - 1, 0)
        to = np.concatenate([[0], np.cumsum(many)])
        for lo in range(0, n, 2048):
            hi = min(n, lo + 2048)
            own = many[lo:hi]
            at = np.arange(to[hi] - to[lo]) + np.repeat(self.starts[lo:hi] - (to[lo:hi] - to[lo]), own)
            bins = np.bincount(np.repeat(np.arange(hi - lo) * 256, own) + pair[at], minlength=(hi - lo) * 256)
            out[lo:hi] = np.minimum(bins, 255).reshape(-1, 256)
        return out


def may_be_similar(counts: np.ndarray, chars: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Of pairs of texts, those that may reach the threshold; none that does is left out.

    An edit changes at most one character, of up to four bytes, so five pairs of bytes of
    the longer text. All other pairs stand in both, and bins only add to what seems common.
    """
    longest = np.maximum(chars[x], chars[y])
    room = longest * (1 - threshold) + 1e-9
    fit = np.abs(chars[x] - chars[y]) <= room
    wide = np.maximum(size[x] - chars[x], size[y] - chars[y]) > 0
    need = np.maximum(size[x], size[y]) - 1 - np.where(wide, 5, 2) * room
    few = np.flatnonzero(fit & (need > 0))
    for lo in range(0, len(few), 16384):
        at = few[lo : lo + 16384]
        a, b = counts[x[at]], counts[y[at]]
        full = ((a == 255) | (b == 255)).any(axis=1)  # counts that stopped prove nothing
        fit[at] = (np.minimum(a, b).sum(axis=1, dtype=np.int64) >= need[at]) | full
    return fit


def _turns(groups: np.ndarray, quota: int) -> np.ndarray:
    """Which of these numbers, in order, are among the first ``quota`` equal ones."""
    order = np.argsort(groups, kind="stable")
    ranked = groups[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    turn = np.empty(len(groups), bool)
    turn[order] = np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups)))) < quota
    return turn


def _linked(x: np.ndarray, y: np.ndarray, texts: Texts, threshold: float) -> list[tuple[int, int]]:
    """Links that join what the similar ones of the pairs (x, y) join; the likeliest pairs come first.

    First each text is tested with the likeliest one before it, then rounds test the next
    pairs of each group, four times as many each time; what is joined needs no test.
    """
    forest, links = Forest(), []
    root = np.arange(len(texts.starts), dtype=np.uint16 if len(texts.starts) < 65536 else np.int64)
    chars, size, counts = texts.letters.size, texts.ends - texts.starts, texts.bigram_counts()
    quota = 1
    while len(x):
        if quota == 1:
            turn = _turns(y.astype(root.dtype), 1)
        else:
            turn = _turns(np.stack([root[x], root[y]], axis=1).ravel(), quota).reshape(-1, 2).any(axis=1)
        a, b = x[turn], y[turn]
        fit = may_be_similar(counts, chars, size, a, b, threshold)
        a, b = a[fit], b[fit]
        most = np.floor(np.maximum(chars[a], chars[b]) * (1 - threshold) + 1e-9).astype(np.int64)
        same = within(texts.letters, a, b, most, lambda p, q: _similar(texts[p], texts[q], threshold), quota == 1)
        for p, q in zip(a[same].tolist(), b[same].tolist(), strict=True):
            if forest.join(p, q):
                links.append((p, q))
        nodes = np.fromiter(forest.parent, np.int64)
        root[nodes] = [forest.find(k) for k in nodes.tolist()]
        rest = np.flatnonzero(~turn)
        rest = rest[root[x[rest]] != root[y[rest]]]
        x, y, quota = x[rest], y[rest], 4 * quota
    return links


def _candidates(group: np.ndarray, own: np.ndarray, sim: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group within MAX_BITS, fewest bits first; where ``apart``, of two blocks only."""
    at, unsigned = np.arange(len(group)), sim.view(np.uint64)
    xs, ys, bits = [], [], []
    for d in range(1, len(group)):
        at = at[: np.searchsorted(at, len(group) - d)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        differ = np.bitwise_count(unsigned[at] ^ unsigned[at + d])
        fit = (differ <= MAX_BITS) & (~apart[at] | (own[at] != own[at + d]))
        xs.append(at[fit].astype(np.int32))
        ys.append(xs[-1] + np.int32(d))
        bits.append(differ[fit])
    if not xs:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    x, y = np.concatenate(xs), np.concatenate(ys)
    order = np.argsort(np.concatenate(bits), kind="stable")
    return x[order], y[order]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some whole groups at a time, with the number of each row's; rows sorted by hub, i, j."""

    def parts(table: pa.Table, last: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        nonlocal held
        rows = table.combine_chunks().to_batches()[0]
        new = np.zeros(len(rows), bool)
        for c in ("hub", "i", "j"):
            values = rows[c].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new), [len(rows)]])
        data, bounds = W.text_bytes(rows["text"])
        work = np.stack([starts[1:] / ROWS, np.cumsum(np.diff(starts) ** 2) / PAIRS, bounds[starts[1:]] / BYTES])
        groups = len(starts) - 1 if last else len(starts) - 2  # the last one may go on
        at, done = 0, np.zeros(3)
        while at < groups:
            over = ((work[:, at:groups] - done[:, None]) > 1).any(axis=0)
            end = at + max(1, int(np.argmax(over)) if over.any() else groups - at)
            lo, hi = int(starts[at]), int(starts[end])
            yield rows.slice(lo, hi - lo), np.repeat(np.arange(end - at), np.diff(starts[at : end + 1]))
            at, done = end, work[:, end - 1]
        held = [] if last else [rows.slice(int(starts[groups]))]

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                yield from parts(pa.Table.from_batches(held), False)
                n = sum(map(len, held)) if len(held) > 1 else 0
    if held:
        yield from parts(pa.Table.from_batches(held), True)


def _verifier(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _whole_groups(batches):
            i, j, own, key, sim = (rows[c].to_numpy() for c in ("i", "j", "own", "key", "sim"))
            x, y = _candidates(group, own, sim, i != j)
            if not len(x):
                continue
            edges = _linked(x, y, Texts(rows["text"]), threshold)
            if edges:
                at = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(key[at[:, 0]]), pa.array(key[at[:, 1]])], names=["a", "b"])

    return verify


def line_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots): nodes has key, sim, first (its first occurrence), count; roots has a, root of the fuzzy groups."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tk"), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema["doc_id"].dataType
    lines = base.mapInArrow(_lines(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, tk long, line int, key long, sim long, tables array<int>")
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tk", "line")
    grouped = lines.groupBy("key", "sim").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("count"), F.first("tables").alias("tables"))
    held = materialize(grouped, "line-nodes")
    nodes = held.drop("tables")
    ranges = 1 + held.count() * TABLES // RANGE
    entries = held.select("sim", "tables").mapInArrow(_deal(ranges), "range int, entries binary")
    met = entries.repartition("range").sortWithinPartitions("range").mapInArrow(_buckets, "hub long, sim long").distinct()
    # several nodes may have one SimHash: those meet under it even without another neighbour
    twins = nodes.groupBy("sim").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("sim").alias("hub"), "sim")
    members = materialize(met.unionByName(twins).distinct().join(nodes.select("sim", "key"), "sim").select("hub", "key"), "line-hubs")
    wanted = members.select("key").distinct().join(nodes, "key").select("key", "sim", "first.tk", "first.doc_id", "first.line")
    wanted = materialize(wanted, "line-wanted")
    texts = wanted.select("tk").distinct()
    small = fits_broadcast(texts, BROADCAST_KEYS)
    some = base.join(F.broadcast(texts) if small else texts, "tk", "left_semi").select("tk", F.col("doc_id").alias("_id"), "_text")
    places = wanted.groupBy("tk", "doc_id").agg(F.collect_list(F.struct("line", "key", "sim")).alias("_at"))  # a text's own lines
    found = some.join(places, (some["tk"] == places["tk"]) & some["_id"].eqNullSafe(places["doc_id"]))
    cut = found.select("_at", F.split("_text", "\n").alias("_lines")).select(
        F.inline(F.transform("_at", lambda p: F.struct(p["key"].alias("key"), p["sim"].alias("sim"), F.get("_lines", p["line"]).alias("text"))))
    )
    content = cut.groupBy("key", "sim").agg(F.first("text").alias("text"))
    work = hub_blocks(members, BLOCK).join(content, "key").select("hub", "i", "j", "own", "key", "sim", "text")
    dealt = work.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "key")
    edges = materialize(dealt.mapInArrow(_verifier(threshold), "a long, b long"), "line-edges")
    return nodes, components(edges)


def line_verdicts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """(tk, doc_id, kept): the numbers of the lines with words that stay, for each document that keeps any."""
    nodes, roots = line_groups(docs, text_col, id_col, threshold)
    joined = nodes.join(roots.withColumnRenamed("a", "key"), "key", "left")
    first = joined.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first"))
    keeper = first.select("first.tk", "first.doc_id", "first.line")
    return keeper.groupBy("tk", "doc_id").agg(F.sort_array(F.collect_list("line")).alias("kept"))


def dedup_report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """doc_id, n_lines (with words), n_kept, n_removed, kept (line numbers) of each row."""
    kept = line_verdicts(docs, text_col, id_col, threshold).withColumnRenamed("doc_id", "_id")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tk"),
        F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD))).cast("long").alias("n_lines"),
    )
    joined = rows.join(kept, (rows["tk"] == kept["tk"]) & rows["doc_id"].eqNullSafe(kept["_id"]), "left")
    lines = F.coalesce("kept", F.array().cast("array<int>"))
    n = F.size(lines).cast("long")
    return joined.select("doc_id", "n_lines", n.alias("n_kept"), (F.col("n_lines") - n).alias("n_removed"), lines.alias("kept"))


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """``docs`` with the lines that repeat an earlier one taken out of the texts; rows and columns stay."""
    kept = line_verdicts(docs, text_col, id_col, threshold)
    tagged = docs.select(nested(docs), text_key(column(text_col)).alias("key"), column(id_col).alias("id"))
    joined = tagged.join(kept, (F.col("key") == F.col("tk")) & F.col("id").eqNullSafe(F.col("doc_id")), "left").select("row", "kept")
    names = docs.columns
    at = names.index(text_col)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = batch.column(0).flatten(), []
            for text, numbers in zip(columns[at].to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    texts.append(None)
                    continue
                stay = set(numbers or ())
                texts.append("\n".join(x for k, x in enumerate(text.split("\n")) if k in stay or not _normal(x)))
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(rebuild, joined.select("row.*").schema)
