"""Token counts, token files and packing against the tokenizers library and plain loops."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cedarlog.llm import packing, tokens, transducer, wavelet

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
LETTERS = " \n\t'sabtrevl!1\x1c\u0301\u03a3.\u3000\U0001f642l'    \u0085é.,;:!?|-ABÉ×"
FIXED = [
    "", "hello<|endoftext|> you  <|endoftext|>", "'re 're'll 'r 'v", "'", " '", "''s", "x'rex'r", "a" * 300, "!" * 99,
    " " * 50, "\n" * 33 + "a", "ΣΑΣ ΟΔΥΣΣΕΥΣ", "日本語 です。", "don't I'll 'sun", "<|ENDOFTEXT|> A", "a.b-.c;;-d '.' İ",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    prose = [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 900))) for _ in range(40)]
    return FIXED + made + prose


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_ids_are_the_librarys(texts, path, monkeypatch):
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.TextEncoder(path).encode(texts)] == want
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    monkeypatch.setattr(tokens, "CACHE_CHARS", 5)
    assert [x.tolist() for x in tokens.TextEncoder(path).encode(texts)] == want


@pytest.mark.parametrize("bare", [False, True])
def test_cuts_are_the_patterns(bare):
    rng = random.Random(3)
    alphabet = " \t\n\r\f\v ab.é.,;:!?#&-1'ÀÖ×Ø÷øİıɏɐʰ日\U0001f642Ǆ|"
    for n in range(60):
        made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(n)]
        data, bounds = b"".join(x.encode() for x in made), np.cumsum([0, *(len(x.encode()) for x in made)])
        start, _ = tokens.cuts(np.frombuffer(data, np.uint8), bounds, bare)
        got = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at = [*(np.flatnonzero(start[lo:hi]) + lo).tolist(), hi]
            parts = [data[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]
            got.append([x.strip(" \t\n\r\f\v") for x in parts] if bare else parts)
        assert got == [(tokens.BARE_PIECES if bare else tokens.PIECES).findall(x) for x in made]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_of_letters_go_to_the_model_and_used_ones_stay(path, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 60)
    encoder = tokens.TextEncoder(path)

    class Slow:
        def encode(self, words, **_):
            raise AssertionError(words)

    monkeypatch.setattr(encoder, "tokenizer", Slow())
    made = [" ".join([*"abcdefg", *(f"{x}{k}" for x in "pqrst" for k in "uvwxyz"[:n])]) for n in (1, 6, 2)]
    made += [" ".join([*"abcdefg", *(f"{x}{y}{n}" for x in "klmn" for y in "uvwxyz")]).translate({48: "ü", 49: "É"}) for n in range(2)]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(made, add_special_tokens=False)]
    learnt, letters = [], encoder._letters
    monkeypatch.setattr(encoder, "_letters", lambda words: (learnt.extend(words), letters(words))[1])
    assert [next(encoder.encode([x])).tolist() for x in made] == want
    assert sum(x.strip() == "b" for x in learnt) == 1  # full once on the way; the words of all texts stayed
    assert len(learnt) > 60


def library_counts(texts):
    return [len(x.ids) for x in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]


def chunk_maps(t, text, size, around=transducer.AROUND):
    """Closed maps of a text's chunks, made as the query makes them."""
    data = np.frombuffer(text.encode(), np.uint8)
    chunks = [t.around(data[s:e].tobytes(), a - s, b - a) for s, a, b, e in transducer._cut(data, size, around)]
    maps = [{} for _ in chunks]
    asked = [{transducer.START if k == 0 or reached else t.guess(before)} for k, (before, _, reached) in enumerate(chunks)]
    rounds = 0
    while any(asked):
        rounds += 1
        for m, (_, stretches, reached), entries in zip(maps, chunks, asked, strict=True):
            m.update({e: t.chunk_map(e, stretches, reached) for e in entries})
        asked = [set()] + [{x for x, _ in left.values()} - right.keys() for left, right in zip(maps, maps[1:], strict=False)]
    return maps, rounds


def test_transducer_counts_as_the_library(texts, monkeypatch):
    for memo in (transducer.MEMO_STATES, 20, 1):
        monkeypatch.setattr(transducer, "MEMO_STATES", memo)
        t = transducer.CountTransducer(BYTE)
        assert t.local
        assert [t.count(x) for x in texts] == library_counts(texts)


SPECIAL = ["a\n\n<|endoftext|>", "a \n <|endoftext|> b", "<|endoftext|>\n\n<|endoftext|>", "x<|endoftext|<|endoftext|>  ", "GELİ.", "EVLİ, iki", "İ?"]


def random_texts(seed, n):
    """Short texts of special strings, all white space, Latin capitals, marks and contractions."""
    rng = random.Random(seed)
    space, latin = " \n\t\r\x0b\x0c\x1c\x85\xa0\u3000", [chr(c) for c in (*range(0xC0, 0x250), 0x130, 0x130, 0x3A3, 0x1E9E)]
    kinds = [
        lambda: rng.choice(["<|endoftext|>", "<|startoftext|>", "<|", "<", "|>"]), lambda: rng.choice(space[: rng.choice([4, 10])]) * rng.randint(1, 3),
        lambda: rng.choice(latin), lambda: rng.choice(".,;:!?'-1"), lambda: rng.choice("abSTDMVErelz"), lambda: rng.choice(["'re", "\u0301", "日本", "\U0001f642"]),
    ]
    return ["".join(rng.choice(kinds)() for _ in range(rng.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_around_special_strings_and_capitals(path):
    made = SPECIAL + random_texts(1, 20_000)
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(made, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.TextEncoder(path).encode(made)] == want


def test_counts_around_special_strings():
    made = SPECIAL + random_texts(2, 20_000)
    assert [transducer.transducer(BYTE).count(x) for x in made] == library_counts(made)


@pytest.mark.parametrize("size", [1, 3, 10, 40])
def test_scanned_chunk_maps_count_as_the_library(texts, size):
    t = transducer.transducer(BYTE)
    made = [x for x in texts[:600] + SPECIAL + random_texts(size, 600) if x]
    for text, want in zip(made, library_counts(made), strict=True):
        maps, _ = chunk_maps(t, text, size, 16)
        scanned = transducer.scan(maps)
        assert len(scanned) == len(maps) and scanned[-1][transducer.START][1] == want
        total, state = 0, transducer.START
        for m, prefix in zip(maps, scanned, strict=True):
            state, n = m[state]
            total += n
            assert prefix[transducer.START] == (state, total)


def test_counts_of_rows(spark, texts, monkeypatch):
    monkeypatch.setattr(transducer, "SCAN", 3)
    rows = [*enumerate(texts[-60:] + FIXED), (None, "a b"), (3, None), (3, None), (None, texts[-1]), (None, texts[-1])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in transducer.count_tokens(docs, BYTE, chunk_bytes=200).collect())
    lib = Tokenizer.from_file(BYTE)
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted((str(i), len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, want, strict=True))
    assert transducer.count_tokens(docs.limit(0), BYTE).collect() == []


def test_special_string_across_chunks(spark):
    text = "one two<|endoftext|> three <|endoftext|>four five six" * 3
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want = len(Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids)
    assert transducer.count_tokens(docs, BYTE, chunk_bytes=7, around=16).first().n_tokens == want


@pytest.mark.parametrize("n,top", [(0, 2), (1, 1), (513, 3), (5000, 50_257)])
def test_wavelet_matrix(n, top):
    rng = np.random.default_rng(n)
    values = rng.integers(0, top, n).astype(np.uint16)
    m = wavelet.parse_shard(wavelet.shard_bytes(values, pa.array([7]), np.array([n]))).matrix
    assert m.decode().tolist() == values.tolist()
    assert m.access(np.arange(n)).tolist() == values.tolist()
    for token in {0, 1, top - 1, *values[:20].tolist()}:
        want = np.flatnonzero(values == token).tolist()
        assert m.count(token) == len(want)
        assert m.places(token) == want
        assert m.rank(token, n // 2) == sum(k < n // 2 for k in want)
        assert m.select(token, len(want)) == -1
    assert m.count(1 << 20) == 0


def test_files_round_trip(spark, texts, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 3000)
    rows = [*enumerate(texts[-50:]), (100, None), (101, "")]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, tokens string").repartition(5)
    got = sorted(tuple(r) for r in wavelet.read_documents(wavelet.write_shards(docs, BYTE)).collect())
    lib, want, start = Tokenizer.from_file(BYTE), [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert got == want
    assert wavelet.read_documents(wavelet.write_shards(docs.limit(0), BYTE)).collect() == []


def test_plan_fills_bins():
    rng = random.Random(3)
    histogram = {}
    for _ in range(5000):
        n = min(64, 1 + int(rng.expovariate(1 / 20)))
        histogram[n] = histogram.get(n, 0) + 1
    bins = packing.plan(histogram, 64)
    used = {}
    for times, chosen in bins:
        assert sum(k * n for k, n in chosen.items()) <= 64
        for k, n in chosen.items():
            used[k] = used.get(k, 0) + n * times
    assert used == histogram
    assert sum(times for times, _ in bins) <= -(-sum(k * n for k, n in histogram.items()) // 64) + 1


def test_fullest_is_optimal():
    rng = random.Random(8)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        chosen = packing.fullest(counts, room)
        assert all(n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)


def test_packed_rows(spark, texts):
    rows = [*enumerate(texts[-50:]), (100, None), (101, ""), (101, ""), (None, "a b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rank int").repartition(4)
    out = packing.pack(docs, WORD, capacity=128).collect()
    lib = Tokenizer.from_file(WORD)
    want = []
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 128)):
            own = ids[start : start + 128]
            want.append((str(i), piece, start, len(own), zlib.crc32(own)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= -(-sum(w[3] for w in want) // 128) + 1
    assert packing.pack(docs.limit(0), WORD).collect() == []


def uncut():
    """Texts whose chunks ``pieces`` does not cut: odd white space in each, no white space, letters only."""
    rng = random.Random(9)
    prose = " ".join("".join(rng.choice("etaoinshr'.1") for _ in range(rng.randint(1, 9))) for _ in range(6000))
    odd = "".join(c + " " * (k % 40 == 0) for k, c in enumerate(prose))
    return [
        odd, odd[:3000] + "<|endoftext|>" + odd[3000:], "".join(rng.choice("ABCxyz019+/='<|") for _ in range(9000)),
        "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(6000)), "日本語です。" * 900, "a" * 5000, " " * 3000 + "x",
        "".join(rng.choice("ab") for _ in range(2000)) + "<|endoftext|>" + "b" * 1000,
    ]


def test_maps_of_uncut_texts_close(monkeypatch):
    """No cut, odd white space, one letter over and over: few entries a chunk, few rounds, the library's counts."""
    for memo in (transducer.MEMO_STATES, 5):
        monkeypatch.setattr(transducer, "MEMO_STATES", memo)
        t = transducer.CountTransducer(BYTE)
        for text, want in zip(uncut(), library_counts(uncut()), strict=True):
            for size in (61, 500):
                maps, rounds = chunk_maps(t, text, size)
                assert transducer.scan(maps)[-1][transducer.START][1] == want
                assert rounds <= 12 and max(map(len, maps)) <= 12


def test_long_uncut_rows(spark):
    """Several MB: a no-break space in each chunk, and a run without white space."""
    odd, _, base, letters, *_ = uncut()
    texts = [odd * 80, base * 120, letters * 40, "a" * 300_000, "x y " * 100_000 + "\n\n" * 40_000 + "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lib = Tokenizer.from_file(BYTE)
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in transducer.count_tokens(docs, BYTE).collect()} == want
