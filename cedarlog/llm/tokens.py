"""Token ids of whole texts by a public tokenizer file, with a bounded cache of words.

A text is parted at special strings first, as the library does; so white space before one
is white space at an end. The parts are cut where both vocabularies' split patterns end a
piece whatever stands around: before a single white-space character between other
characters, behind one that is no space and before a letter, and between letters and the
marks ``.,;:!?#$%&*``. U+0130 is no such letter: in
small letters it ends in a combining mark, which goes together with what follows. So the ids of a text are those of its parts, one
after the other. Parts seen before come from the cache; the rest go through the
tokenizers library. Texts with white space other than space, tab, line feed and the
like are encoded in one piece.

Many texts are cut at once, on their bytes (``cuts`` does what the patterns do), and each
different part of them is looked up once. Parts of letters only are one piece to the
vocabularies' own split patterns; the library's model gets them without those.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Bytes of the texts that are cut at once, and at most one text more.
CHUNK_BYTES = 2 << 20
#: Word pieces kept; the cache starts anew beyond it, so its memory is bounded.
CACHE_WORDS = 500_000
#: Longer pieces are not kept.
CACHE_CHARS = 48
_SPACE, _LETTER, _MARK = r" \t\n\r\f\v", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", ".,;:!?#$%&*"
_WORD = rf"[{_LETTER}]+(?=[{_SPACE}{_MARK}]|\Z)"
_MARKS = rf"[{_MARK}]+(?=[{_SPACE}{_LETTER}]|\Z)"
PIECES = re.compile(
    rf" ?{_WORD}|{_MARKS}|[\t\n\r\f\v](?=[{_LETTER}])|[{_SPACE}]?[^{_SPACE}]+|[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])|[{_SPACE}]+"
)
#: Coarser ones: also what the counting of chunks takes for granted where it cuts.
COUNT_PIECES = re.compile(
    rf"[{_SPACE}]?[{_LETTER}]+(?=[{_SPACE}.,;:!?]|\Z)|[.,;:!?]+(?=[{_SPACE}{_LETTER}]|\Z)"
    rf"|[{_SPACE}]?[^{_SPACE}]+|[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])|[{_SPACE}]+"
)
#: The same as ``PIECES`` without white space, for vocabularies that drop it.
BARE_PIECES = re.compile(rf"{_WORD}|{_MARKS}|[^{_SPACE}]+")
#: One piece to the byte-level pattern, a space before it or none.
LETTERS_ONLY = re.compile(rf" ?[{_LETTER}]+")
#: White space by some definition, other than the six above: such texts are not cut.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


_OTHER, _WHITE, _LETTERS, _MARKED = range(4)
#: Kinds of bytes; those of letters above ASCII are set by their first byte.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t\n\r\f\v")], _KIND[list(_MARK.encode())] = _WHITE, _MARKED
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTERS
#: The characters that stand for bytes in the vocabularies, and what parts words in the text given to the model.
_SHOWN = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}
BYTE_CHARS[10] = " "


def _kinds(data: np.ndarray) -> np.ndarray:
    kind = _KIND[data]
    first = np.flatnonzero(data >= 0xC3)
    if len(first):
        lead, tail = data[first], data[first + 1]
        letter = (lead <= 0xC8) | (lead == 0xC9) & (tail < 0x90)
        letter &= ~((lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7)) | (lead == 0xC4) & (tail == 0xB0))
        first = first[letter]
        kind[first] = kind[first + 1] = _LETTERS
    return kind


def cuts(data: np.ndarray, bounds: np.ndarray, bare: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where ``PIECES``, or ``BARE_PIECES``, begin in texts that lie one after the other, and which bytes are white space."""
    kind = _kinds(data)
    white = kind == _WHITE
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds] = True
    after_white = np.zeros(len(data), bool)  # in the same text
    after_white[1:] = white[:-1]
    after_white &= ~begins[:-1]
    runs = ~white & (after_white | begins[:-1])
    # a run of other characters goes on as one piece from the last letters or marks before the first character
    # that is neither; marks behind white space are not parted from what follows
    shut = kind == _OTHER
    if not bare:
        shut |= runs & after_white & (kind == _MARKED)
    turn = np.zeros(len(data), bool)
    turn[1:] = (kind[1:] != kind[:-1]) & (kind[1:] >= _LETTERS) & (kind[:-1] >= _LETTERS)
    turn = np.flatnonzero(turn & ~begins[:-1])
    run_at, shut_at = np.flatnonzero(runs), np.concatenate([[-1], np.flatnonzero(shut)])
    if len(turn):
        own = run_at[np.searchsorted(run_at, turn, "right") - 1]
        turn = turn[shut_at[np.searchsorted(shut_at, turn, "right") - 1] < own]
    if bare:
        start = runs
    else:
        start = begins[:-1].copy()
        start[1:] |= white[1:] & ~white[:-1]  # white space but its last character is a piece
        start[:-1] |= runs[1:] & after_white[1:]
        start[1:] |= runs[1:] & (kind[1:] == _LETTERS) & (data[:-1] != 0x20)
    start[turn] = True
    return start, white


def pieces(text: str) -> list[str]:
    """A text without special strings in parts whose ids do not depend on each other."""
    return [text] if ODD.search(text) else COUNT_PIECES.findall(text)


def special_pattern(specials: list[str]) -> re.Pattern | None:
    """What parts a text at special strings; of those that begin at the same place the longest."""
    return re.compile(f"({'|'.join(re.escape(x) for x in sorted(specials, key=len, reverse=True))})") if specials else None


class TextEncoder:
    """Ids of texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # a vocabulary of small letters without white space: such differences need no words of their own
        same = ("a", " A", "\n\ta", "A ")
        self.folds = len({tuple(x.ids) for x in self.tokenizer.encode_batch(same, add_special_tokens=False)}) == 1
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = special_pattern(self.specials)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        for token, k in vocab.items():
            self.bytes[k] = len(token.removesuffix(suffix))
        self._start()

    def _start(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint16)
        self.ends = np.zeros(CACHE_WORDS + 1, np.int64)
        #: In how many later chunks a word was met, since the cache was last full.
        self.hits = np.zeros(CACHE_WORDS, np.int32)

    def _learn(self, words: list[str], at: np.ndarray, new: list[int]) -> None:
        """Put new words into the cache, those of letters in one call of the library and the others in another."""
        plain, other = [], []
        for k in new:
            (plain if LETTERS_ONLY.fullmatch(words[k]) else other).append(k)
        if plain:
            own = [words[k] for k in plain]
            at[plain] = self._put(own, *self._letters(own))
        if other:
            own = [words[k] for k in other]
            got = self.tokenizer.encode(own, is_pretokenized=True, add_special_tokens=False)
            at[other] = self._put(own, got.ids, np.bincount(np.array(got.word_ids, np.int64), minlength=len(own)))

    def _letters(self, words: list[str]) -> tuple[list[int] | np.ndarray, np.ndarray]:
        """(ids, how many of each word) of words that the split pattern leaves whole; tokens end where words end."""
        text = "\n".join(words)
        text = (text.lower() if self.folds else text).encode().decode("latin-1").translate(BYTE_CHARS)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        reached = np.cumsum(self.bytes[ids])
        ends = np.cumsum(np.fromiter(map(len, text.split(" ")), np.int64))
        if reached[-1] != ends[-1]:
            raise ValueError("not a vocabulary of bytes")
        return ids, np.diff(np.searchsorted(reached, ends) + 1, prepend=0)

    def _put(self, words: list[str], ids: list[int] | np.ndarray, size: np.ndarray) -> np.ndarray:
        n = len(self.index)
        ends = self.ends[n] + np.concatenate([[0], np.cumsum(size)])
        self.ends[n : n + 1 + len(words)] = ends
        while len(self.ids) < ends[-1]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[ends[0] : ends[-1]] = ids
        self.index.update(zip(words, range(n, n + len(words)), strict=True))
        return np.arange(n, n + len(words))

    def _forget(self) -> None:
        """Leave the words that came again in later chunks, half a cache of them at most; those most often."""
        hits = self.hits[: len(self.index)]
        stay = np.flatnonzero(hits)
        if len(stay) > CACHE_WORDS // 2:
            stay = np.sort(stay[np.argsort(-hits[stay], kind="stable")[: CACHE_WORDS // 2]])
        words, size = np.array(list(self.index), object)[stay].tolist(), self.ends[stay + 1] - self.ends[stay]
        ids = self.ids[np.arange(size.sum()) + np.repeat(self.ends[stay] - np.cumsum(size) + size, size)]
        self._start()
        self._put(words, ids, size)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """uint16 ids of each text (both vocabularies have fewer than 65,536)."""
        held: list[bytes | list[str]] = []
        size = 0
        for text in texts:
            held.append(self._pieces(text) if text and self._special(text) else (text or "").encode())
            size += len(text or "")
            if size >= CHUNK_BYTES:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _special(self, text: str) -> bool:
        """Whether a text is cut by itself, by the patterns."""
        return any((x[:2] if self.folds else x) in text for x in self.specials) or ODD.search(text) is not None

    def _encode(self, texts: list[bytes | list[str]]) -> Iterator[np.ndarray]:
        together = [t for t in texts if isinstance(t, bytes)]
        data = b"".join(together)
        ids = self._whole(data.lower() if self.folds else data, np.cumsum([0, *map(len, together)]))
        for t in texts:
            if isinstance(t, bytes):
                yield next(ids)
            else:
                words = list(dict.fromkeys(t))
                number = dict(zip(words, range(len(words)), strict=True))
                yield from self._gather(words, np.fromiter(map(number.get, t), np.int64, len(t)), np.array([0, len(t)]))

    def _whole(self, data: bytes, bounds: np.ndarray) -> Iterator[np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        start, white = cuts(raw, bounds, self.folds)
        if self.folds:  # white space is no part of any piece
            start, raw = start[~white], raw[~white]
            bounds = bounds - np.concatenate([[0], np.cumsum(white)])[bounds]
        at = np.flatnonzero(start)
        offsets = pa.py_buffer(np.append(at, len(raw)).astype(np.int64))
        coded = pa.LargeStringArray.from_buffers(len(at), offsets, pa.py_buffer(raw)).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist()
        yield from self._gather(words, coded.indices.to_numpy(), np.searchsorted(at, bounds))

    def _places(self, words: list[str]) -> np.ndarray:
        """The cache's number of each of different words, which are learnt if new; -1 if too long for it."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        new = [k for k in np.flatnonzero(at < 0).tolist() if len(words[k]) <= CACHE_CHARS]
        self.hits[at[at >= 0]] += 1
        if len(self.index) + len(new) > CACHE_WORDS:
            self._forget()
            if len(self.index) + len(new) > CACHE_WORDS:
                self._start()
            at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
            new = [k for k in np.flatnonzero(at < 0).tolist() if len(words[k]) <= CACHE_CHARS][: CACHE_WORDS - len(self.index)]
        self._learn(words, at, new)
        return at

    def _pieces(self, text: str) -> list[str]:
        if self.parts is None or not any(x in text for x in self.specials):
            return self._plain(text)
        between = self.parts.split(text)  # every second one is a special string
        return [w for k, part in enumerate(between) for w in ([part] if k % 2 else self._plain(part) if part else [])]

    def _plain(self, text: str) -> list[str]:
        if ODD.search(text):
            return [text]
        if not self.folds:
            return PIECES.findall(text)
        if not any(x[:2] in text for x in self.specials):
            text = text.encode().lower().decode()  # A-Z only; the library does the others
        return BARE_PIECES.findall(text)

    def _gather(self, words: list[str], which: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text, from the different words and the number of each piece's word."""
        at = self._places(words)
        gaps = np.flatnonzero(at < 0)
        lo, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        source = self.ids
        if len(gaps):  # too long for the cache
            own = [np.array(self.tokenizer.encode(words[k], add_special_tokens=False).ids, np.uint16) for k in gaps.tolist()]
            size[gaps] = [len(x) for x in own]
            lo[gaps] = len(self.ids) + np.cumsum([0, *(len(x) for x in own)])[:-1]
            source = np.concatenate([self.ids, *own])
        lo, size = lo[which], size[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = source[np.arange(ends[-1]) + np.repeat(lo - ends[:-1], size)]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield ids[ends[a] : ends[b]]


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
