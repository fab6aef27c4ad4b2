"""Token counts by finite-state transduction of a byte-level BPE vocabulary.

**Inside a piece of text.** After each byte the transducer's state holds the places
at which the next token may still begin: what was read since, the last token before,
and how many tokens that was ago. BPE has exactly one last token for each prefix, the
one whose neighbour to the left goes together with it, so the next state and the
change in the number of tokens depend on the state and the byte only. States are
finite and made when first reached; a transition carries the tokens it emits (net:
a byte may also take tokens back, when a longer one forms).

**Between pieces.** The vocabulary's split pattern (contractions, letters, numbers,
other, white space with a last space that goes to the next word) is a small automaton
over classes of characters around the first one.

**Chunks.** A long text is cut into chunks of bytes, each with what stands shortly before
and after it, so that special strings across a border are seen from both sides. A chunk's
state map takes entry states to (exit state, tokens). It is first made for the entry that
the text before the chunk leads to (exact where that text has a cut). Then maps are
extended, all chunks at once: each exit of a chunk must be an entry of the next one.
States soon forget how a run began, so a round or two close all maps; a closed map is
right for whatever enters. Closed maps compose associatively, and are composed by
prefix scans over blocks of chunks, level by level, each level in parallel.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cedarlog.llm import words as W
from cedarlog.llm.tokens import LETTERS_ONLY, pieces, special_pattern
from cedarlog.session import materialize

#: Bytes of a chunk, and of what is seen before and behind it.
CHUNK_BYTES, AROUND = 65_536, 256
#: Chunk maps composed by one scan.
SCAN = 256
#: States kept by each of the two automata, word counts, and pairs of tokens tried: about 150 MB a worker at most.
MEMO_STATES, MEMO_WORDS, MEMO_FITS = 30_000, 300_000, 400_000
MEMO_CHARS = 48


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files: printable ones themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


#: The places at which the next token may begin: (bytes since, token before, tokens there less those now).
START_KEY = ((b"", -1, 0),)


class ByteTransducer:
    """The transducer inside a piece."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        letters = byte_letters()
        # entries with other letters are special tokens, which no merge makes
        raw = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if all(c in letters for c in t)}
        self.ids = raw
        self.rank = {(vocabulary[a], vocabulary[b]): (k, vocabulary[a + b]) for k, (a, b) in enumerate(merges)}
        self.made = {made: (k, a, b) for (a, b), (k, made) in self.rank.items()}
        if len(self.made) < len(self.rank):
            raise ValueError("a token of the vocabulary has several merge rules")
        self.begins = {t[:k] for t in raw for k in range(len(t))}  # proper prefixes of tokens
        self.fits: dict[int, bool] = {}
        self.ends: dict[tuple[int, int], list[tuple[int, float]]] = {}
        # a state is the dict of its moves; under None stands what it is
        self.start: dict = {None: START_KEY}
        self.states: dict[tuple, dict] = {START_KEY: self.start}

    def state(self, key: tuple) -> dict:
        """The state of that content: kept while there is room, else made for this run only."""
        row = self.states.get(key)
        if row is None:
            row = {None: key}
            if len(self.states) < MEMO_STATES:
                self.states[key] = row
        return row

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at an end of ``token`` while it is merged, and the rule that uses each up."""
        known = self.ends.get((token, side))
        if known is None:
            known = self.ends[token, side] = [(token, float("inf"))]
            while token in self.made:
                used, *halves = self.made[token]
                token = halves[side]
                known.append((token, used))
        return known

    def _joined(self, left: int, right: int, before: float) -> bool:
        """Whether a rule older than ``before`` joins an end of one with an end of the other while both stand.

        A rule is younger than those of its halves, so rules apply in their order; of
        equal rules the one further left goes first.
        """
        ends = self._edge(right, 0)
        for a, a_used in self._edge(left, 1):
            for b, b_used in ends:
                rule = self.rank.get((a, b))
                if rule and rule[0] < a_used and rule[0] <= b_used and rule[0] < before:
                    return True
        return False

    def together(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens as they are; ``left`` -1 is the start of the piece."""
        known = self.fits.get(left << 32 | right)
        if known is None:
            if left >= 0:
                known = self.together(-1, right) and not self._joined(left, right, float("inf"))
            elif right in self.made:  # its own bytes give the token itself
                rule, a, b = self.made[right]
                known = self.together(-1, a) and self.together(-1, b) and not self._joined(a, b, rule)
            else:
                known = True
            if len(self.fits) > MEMO_FITS:
                self.fits.clear()
            self.fits[left << 32 | right] = known
        return known

    def step(self, state: dict, byte: int) -> tuple[dict, int]:
        """(next state, change in the number of tokens)."""
        move = state.get(byte)
        if move is None:
            last, emitted, live, one = -1, 0, [], bytes((byte,))
            for seen, before, ago in state[None]:
                seen = seen + one
                if last < 0:
                    token = self.ids.get(seen)
                    if token is not None and self.together(before, token):
                        last, emitted = token, ago + 1
                if seen in self.begins:
                    live.append((seen, before, ago))
            row = self.state((*((s, b, n - emitted) for s, b, n in live), (b"", last, 0)))
            move = row, emitted
            if len(self.states) < MEMO_STATES:
                state[byte] = move
        return move

    def run(self, state: dict, data: bytes) -> tuple[dict, int]:
        total = 0
        for byte in data:
            state, emitted = state.get(byte) or self.step(state, byte)
            total += emitted
        return state, total

    def count(self, data: bytes) -> int:
        """Tokens of one whole piece: over kept moves as far as they go, then the same steps without making states."""
        state, total, n = self.start, 0, len(data)
        for at in range(n):
            move = state.get(data[at])
            if move is None:
                if len(self.states) < MEMO_STATES:
                    move = self.step(state, data[at])
                else:
                    break
            state, emitted = move
            total += emitted
        else:
            return total
        ids, begins, together = self.ids, self.begins, self.together
        live = [(at - len(seen), before, total + ago) for seen, before, ago in state[None]]
        for end in range(at + 1, n + 1):
            last, found, still = -1, 0, []
            for place in live:
                first, before, so_far = place
                seen = data[first:end]
                if last < 0:
                    token = ids.get(seen)
                    if token is not None and together(before, token):
                        last, found = token, so_far + 1
                if seen in begins:
                    still.append(place)
            still.append((end, last, found))
            live = still
        return found


class Split(NamedTuple):
    """A state between characters: what is open, the byte states in it, and what may be taken back."""

    mode: str = ""  # "", L, N, O, W, ' and 'r 'v 'l
    inner: tuple = START_KEY
    before: tuple = START_KEY  # of white space without its last character
    back: int = 0  # tokens that the last character added
    last: str = ""


class CountTransducer:
    """Tokens of whole texts, as the tokenizers library counts them for a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bytes = ByteTransducer(model["vocab"], merges)
        self.special = [t["content"] for t in file["added_tokens"]]
        self.parting = special_pattern(self.special)
        #: Whether where special strings stand can be told from a stretch of text around them.
        self.local = not any(
            a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))) for a in self.special for b in self.special
        ) and max((len(t.encode()) for t in self.special), default=0) < AROUND
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.classes: dict[str, str] = {}
        self.start: dict = {None: Split()}
        self.states: dict[Split, dict] = {Split(): self.start}
        self.words: dict[str, int] = {}

    def state(self, at: Split) -> dict:
        row = self.states.get(at)
        if row is None:
            row = {None: at}
            if len(self.states) < MEMO_STATES:
                self.states[at] = row
        return row

    def _move(self, state: dict, c: str) -> tuple[dict, int]:
        """Make the move of a state by a character."""
        to, n = self._step(state[None], c)
        move = self.state(to), n
        if len(self.states) < MEMO_STATES:
            state[c] = move
        return move

    def _run(self, key: tuple, data: bytes) -> tuple[tuple, int]:
        state, n = self.bytes.run(self.bytes.state(key), data)
        return state[None], n

    def kind(self, c: str) -> str:
        """L, N, O or W, as the library's own split has it."""
        known = self.classes.get(c)
        if known is None:
            one = [k for k, left in (("L", "a"), ("N", "1"), ("O", "!")) if len(self.splitter.pre_tokenize_str(left + c)) == 1]
            known = self.classes[c] = one[0] if one else "W"
        return known

    def _open(self, c: str) -> tuple[Split, int]:
        """A piece that begins with ``c``."""
        inner, n = self._run(START_KEY, c.encode())
        kind = self.kind(c)
        if kind == "W":
            return Split("W", inner, 0, n, c), n
        return Split("'" if c == "'" else kind, inner), n

    def _step(self, s: Split, c: str) -> tuple[Split, int]:
        kind, run = self.kind(c), self._run
        if s.mode == "":
            return self._open(c)
        if s.mode == "W":
            if kind == "W":
                inner, n = run(s.inner, c.encode())
                return Split("W", inner, s.inner, n, c), n
            if s.last == " ":  # the last space goes to the word
                inner, n = run(START_KEY, (" " + c).encode())
                return Split(kind, inner), n - s.back
            to, n = self._open(c)
            return to, n - s.back + run(START_KEY, s.last.encode())[1]
        if s.mode == "'":
            if c in "stmd":
                return Split(), run(s.inner, c.encode())[1]
            if c in "rvl":
                to, n = self._open(c)
                return Split("'" + c, to.inner, 0, n + run(START_KEY, b"'")[1]), n
            if kind == "O":
                inner, n = run(s.inner, c.encode())
                return Split("O", inner), n
            return self._open(c)
        if s.mode[0] == "'":
            if s.mode + c in ("'re", "'ve", "'ll"):
                return Split(), run(START_KEY, (s.mode + c).encode())[1] - s.back
            s = Split("L", s.inner)
        if kind == s.mode:
            inner, n = run(s.inner, c.encode())
            return Split(s.mode, inner), n
        return self._open(c)

    def run(self, text: str) -> int:
        """Tokens of a text without special strings, from the start state."""
        return self.run_from(self.start, text)[1]

    def run_from(self, state: dict, text: str) -> tuple[dict, int]:
        """(state, tokens) after more text without special strings."""
        total = 0
        for c in text:
            state, n = state.get(c) or self._move(state, c)
            total += n
        return state, total

    def count(self, text: str) -> int:
        """Tokens of a whole text: special strings count one each and part the text."""
        if self.parting is None or not any(x in text for x in self.special):
            return self._count(pieces(text))
        between = self.parting.split(text)
        return len(between) // 2 + sum(self._count(pieces(part)) for part in between[::2] if part)

    def _count(self, words: list[str]) -> int:
        """Tokens of consecutive parts that begin and end at cuts."""
        found = list(map(self.words.get, words))
        if None in found:
            if len(self.words) > MEMO_WORDS:
                self.words.clear()
            for k, n in enumerate(found):
                if n is None:
                    word = words[k]
                    found[k] = n = self.words.get(word)
                    if n is None:
                        found[k] = n = self.bytes.count(word.encode()) if LETTERS_ONLY.fullmatch(word) else self.run(word)
                        if len(word) <= MEMO_CHARS:
                            self.words[word] = n
        return sum(found)

    def name(self, state: dict) -> str:
        """A state in words that any worker understands."""
        return repr(tuple(state[None]))

    def named(self, name: str) -> dict:
        return self.state(Split(*ast.literal_eval(name)))

    def _from(self, entry: str, text: str) -> tuple[str, int]:
        """(exit, tokens) of a stretch without special strings: its head up to the first cut from the entry, the rest from the start."""
        if not text:
            return entry, 0
        parts = pieces(text)
        state, n = self.run_from(self.named(entry), parts[0])
        if len(parts) > 1:
            n += self._count(parts[1:-1])
            state, more = self.run_from(self.start, parts[-1])
            n += more
        return self.name(state), n

    def around(self, part: bytes, lead: int, own: int) -> tuple[str, list[str], bool]:
        """A chunk with ``lead`` bytes before its ``own``: (the stretch before it, its stretches parted by special strings, whether a special string reaches into it)."""
        text = part.decode("utf-8")
        a = len(part[:lead].decode("utf-8"))
        b = a + len(part[lead : lead + own].decode("utf-8"))
        found = [m.span() for m in self.parting.finditer(text)] if self.parting else []
        before = max((e for _, e in found if e <= a), default=0)
        reach = next((e for s, e in found if s < a < e), a)
        out, at = [], min(reach, b)
        for s, e in found:
            if a <= s < b:
                out.append(text[at:s])
                at = min(e, b)
        return text[before:a], [*out, text[at:b]], reach > a

    def guess(self, before: str) -> str:
        """The state that the text before a chunk leads to; right if that text has a cut."""
        parts = pieces(before)
        return self.name(self.run_from(self.start, parts[-1] if parts else "")[0])

    def chunk_map(self, entry: str, stretches: list[str], reached: bool) -> tuple[str, int]:
        """(exit, tokens) of a chunk for one entry. A special string counts where it begins."""
        state, tokens = START if reached else entry, 0
        for k, stretch in enumerate(stretches):
            state, n = self._from(START if k else state, stretch)
            tokens += n + (k > 0)
        return state, tokens


START = repr(tuple(Split()))

#: What chunks do to a run that enters them: entry state to (exit state, tokens).
StateMap = dict[str, tuple[str, int]]


def compose(left: StateMap, right: StateMap) -> StateMap:
    return {entry: (right[by][0], n + right[by][1]) for entry, (by, n) in left.items() if by in right}


def scan(maps: list[StateMap]) -> list[StateMap]:
    """All prefixes' compositions, in log2(n) rounds of independent compositions."""
    gap = 1
    while gap < len(maps):
        maps = maps[:gap] + [compose(a, b) for a, b in zip(maps, maps[gap:], strict=False)]
        gap *= 2
    return maps


_transducers: dict[str, CountTransducer] = {}


def transducer(path: str) -> CountTransducer:
    """One per worker process and file."""
    if path not in _transducers:
        _transducers[path] = CountTransducer(path)
    return _transducers[path]


def _cut(data: np.ndarray, size: int, around: int) -> list[tuple[int, int, int, int]]:
    """(first byte seen, first own byte, end of own bytes, end of bytes seen) of the chunks; no character is cut."""

    def back(at: int) -> int:
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    borders = [back(k) for k in range(0, len(data), size)] + [len(data)]
    return [(back(max(a - around, 0)), a, b, back(min(b + around, len(data)))) for a, b in zip(borders, borders[1:], strict=False)]


MAP = "row long, k long, entry string, exit string, tokens long"


def _compose_blocks(maps: DataFrame) -> DataFrame:
    """One map for each block of up to SCAN chunks of a text, numbered anew."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for (row, block), group in groupby(rows, key=lambda r: (r[0], r[1] // SCAN)):
            made = [{e: (x, n) for _, _, e, x, n in own} for _, own in groupby(group, key=lambda r: r[1])]
            out += [(row, block, entry, exit_, n) for entry, (exit_, n) in scan(made)[-1].items()]
            if len(out) >= 10_000:
                yield _map_batch(out)
                out = []
        if out:
            yield _map_batch(out)

    block = F.expr(f"k div {SCAN}")
    return maps.repartition("row", block).sortWithinPartitions("row", "k").mapInArrow(blocks, MAP)


def _map_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["row", "k", "entry", "exit", "tokens"])


def closed_maps(chunks: DataFrame, tokenizer: str) -> DataFrame:
    """(row, k, entry, exit, tokens): the chunks' state maps, extended until each exit is an entry of the next chunk."""

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(tokenizer)
        for batch in batches:
            out = []
            for row, k, lead, own, part, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before, stretches, reached = t.around(part, lead, own)
                if entry is None:
                    entry = START if k == 0 or reached else t.guess(before)
                out.append((row, k, entry, *t.chunk_map(entry, stretches, reached)))
            if out:
                yield _map_batch(out)

    fields = ["row", "k", "lead", "own", "part"]
    first = chunks.repartition("row", "k").select(*fields, F.lit(None).cast("string").alias("entry"))
    maps = materialize(first.mapInArrow(evaluate, MAP), "chunk-maps")
    while True:
        asked = maps.select("row", (F.col("k") + 1).alias("k"), F.col("exit").alias("entry")).distinct()
        new = asked.join(maps.select("row", "k", "entry"), ["row", "k", "entry"], "left_anti")
        more = materialize(chunks.join(new, ["row", "k"]).select(*fields, "entry").mapInArrow(evaluate, MAP), "chunk-maps")
        if more.isEmpty():  # the last chunk's exits ask for none
            return maps
        maps = maps.unionByName(more)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, around: int = AROUND) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) of each row.

    NULL is an empty text: no bytes, no tokens. Rows are counted each for itself,
    with equal or NULL ids as well; other columns do not matter; no rows give none.
    Texts of up to ``chunk_bytes`` are counted where they are read. A longer one is cut
    into chunks that any task may count, however long it is; what is composed are
    state maps, a few short states for each chunk.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    names = ["row", "doc_id", "n_bytes", "n_tokens", "n", "k", "lead", "own", "part"]
    types = (pa.int64(), arrow, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(tokenizer)
        for batch in batches:
            data, bounds = W.text_bytes(batch.column(2))
            size = np.diff(bounds)
            own = np.flatnonzero((size <= chunk_bytes) | (not t.local))
            if len(own):
                few, ids = batch.take(pa.array(own)), size[own]
                counts = [t.count(x) if x else 0 for lo in range(0, len(own), 256) for x in few.column(2).slice(lo, 256).to_pylist()]
                one, none = np.ones(len(own), np.int64), np.zeros(len(own), np.int64)
                columns = [few.column(0), few.column(1).cast(arrow), ids, counts, one, none, none, none, pa.nulls(len(own), pa.binary())]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, x) for c, x in zip(columns, types, strict=True)], names=names)
            for at in np.flatnonzero((size > chunk_bytes) & t.local).tolist():
                text = data[bounds[at] : bounds[at + 1]]
                cut = _cut(text, chunk_bytes, around)
                for lo in range(0, len(cut), 64):
                    some = cut[lo : lo + 64]
                    m, same = len(some), batch.slice(at, 1).take(pa.array([0] * len(some[:64])))
                    columns = [same.column(0), same.column(1).cast(arrow), [len(text)] * m, pa.nulls(m, pa.int64()), [len(cut)] * m, range(lo, lo + m)]
                    columns += [[a - s for s, a, _, _ in some], [b - a for _, a, b, _ in some], [text[s:e].tobytes() for s, _, _, e in some]]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, x) for c, x in zip(columns, types, strict=True)], names=names)

    schema = f"row long, doc_id {kind.simpleString()}, n_bytes long, n_tokens long, n long, k long, lead long, own long, part binary"
    found = materialize(base.mapInArrow(read, schema), "token-counts")
    counted = found.where("n = 1").select("doc_id", "n_bytes", "n_tokens")
    longest = found.where("k > 0").agg(F.max("n")).first()[0]
    if longest:
        maps = closed_maps(found.where("n > 1"), tokenizer)
        while longest > 1:
            maps = materialize(_compose_blocks(maps), "block-maps")
            longest = -(-longest // SCAN)
        totals = maps.where(F.col("entry") == START).select("row", "tokens")
        long = found.where("n > 1 AND k = 0").select("row", "doc_id", "n_bytes").join(totals, "row")
        counted = counted.unionByName(long.select("doc_id", "n_bytes", F.col("tokens").alias("n_tokens")))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
