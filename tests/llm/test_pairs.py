"""Line deduplication and the Jaccard join against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cedarlog.llm import line_dedup as L
from cedarlog.llm import ngram_join as J
from cedarlog.llm import words as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return WORD.findall(lower(text))


def copies(seed, n, length=60, families=4, changes=3):
    """Texts of which families differ in a few words."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeéß1") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    bases = [[rng.choice(pool) for _ in range(length)] for _ in range(families)]
    out = []
    for _ in range(n):
        text = list(rng.choice(bases)) if rng.random() < 0.7 else [rng.choice(pool) for _ in range(length)]
        for _ in range(rng.randint(0, changes)):
            text[rng.randrange(len(text))] = rng.choice(pool)
        out.append(" ".join(text))
    return out


def roots(nodes, pairs):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_words_as_the_pattern():
    texts = ["", None, "abc", "Déjà VU, x1!\n--", "a" * 300_000, "…", "\x00a\x7fb", "ab", "cd ef"]
    data, bounds = W.text_bytes(pa.array(texts))
    first, length, hashes = W.words(data, bounds)
    at = W.word_bounds(first, bounds)
    want = [words_of(t) for t in texts]
    assert [len(w) for w in want] == np.diff(at).tolist()
    seen = {}
    for word, value in zip([w for ws in want for w in ws], hashes.tolist(), strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_least_matches_keep_likely_pairs():
    least = J.least_matches(0.8, 1e-6)
    assert sorted(least) == list(range(16, 129, 16))
    assert all(0 < least[n] < 0.8 * n for n in least)


def jaccard_brute(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    ids = [i for i, _ in rows]
    pairs = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
    ]
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    root = roots(ids, pairs)
    return {i: (root[i], links[i], len(sets[i])) for i in ids}


@pytest.mark.parametrize("block", [1024, 16])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    texts = copies(3, 160) + ["", None, "one two", "one two", "One, TWO!", "...", "a b c d e f"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, key long, hub string")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in J.jaccard_join(docs).collect()}
    assert got == jaccard_brute(rows)


def test_join_keeps_one_of_each_class(spark):
    texts = copies(5, 80) + ["", None, "one two", "one two"]
    rows = list(enumerate(texts))
    want = jaccard_brute(rows)
    docs = spark.createDataFrame([(i, t, t) for i, t in rows] + [(0, texts[0], texts[0])], "doc_id long, text string, tk string")
    stay = J.keep_one(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted({c for c, _, _ in want.values()})


def test_join_of_null_ids_and_of_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted(tuple(r) for r in J.jaccard_join(docs).select("class_id", "n_links").collect()) == [(4, 2)] * 3
    assert J.keep_one(docs).collect()[0].doc_id == 4
    assert J.jaccard_join(docs.limit(0)).collect() == []


def test_edit_distance():
    rng = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert L.edit_distance(a, b) == plain(a, b)


def test_near_copies_are_told_by_the_words_that_differ(monkeypatch):
    lines = copies(4, 60, length=120, families=3, changes=8)
    pairs = [(a, b) for a in lines for b in lines]
    want = [L.edit_distance(a, b) <= max(len(a), len(b)) * (1 - 0.8) + 1e-9 for a, b in pairs]
    for a, b in pairs[:600]:
        assert L.aligned_distance(a, b) >= L.edit_distance(a, b)
    steps, plain = [], L.edit_distance
    monkeypatch.setattr(L, "edit_distance", lambda a, b, most=float("inf"): (steps.append(len(a) + len(b)), plain(a, b, most))[1])
    near = [(a, b) for (a, b), same in zip(pairs, want, strict=True) if same]
    assert all(L._similar(a, b, 0.8) for a, b in near)
    assert sum(steps) < 0.3 * sum(len(a) + len(b) for a, b in near)
    assert [L._similar(a, b, 0.8) for a, b in pairs] == want
    assert L._similar("", "", 0.8) and not L._similar("a", "", 0.8) and L._similar("abcdefgh", "abcdefg", 0.8)


def lines_brute(rows, threshold=0.8):
    """Kept line numbers per document, from all pairs of distinct lines."""
    seen = []
    for i, text in rows:
        for number, line in enumerate((text or "").split("\n")):
            if words_of(line):
                seen.append((i, number, " ".join(words_of(line))))
    distinct = sorted({x for _, _, x in seen})
    bits = {}
    for x in distinct:
        data, bounds = W.text_bytes(pa.array([x]))
        hashes = W.words(data, bounds)[2]
        bits[x] = int(L.simhash(hashes, np.array([0, len(hashes)]))[0])
    pairs = [
        (a, b)
        for k, a in enumerate(distinct)
        for b in distinct[k + 1 :]
        if (bits[a] ^ bits[b]).bit_count() <= L.MAX_BITS and L._similar(a, b, threshold)
    ]
    root = roots(distinct, pairs)
    first = {}
    for i, number, x in seen:
        first.setdefault(root[x], (i, number))
    kept = defaultdict(list)
    for i, number in sorted(first.values()):
        kept[i].append(number)
    total = defaultdict(int)
    for i, _, _ in seen:
        total[i] += 1
    return {i: (total[i], kept[i]) for i, _ in rows}


@pytest.mark.parametrize("block,neighbours", [(512, 256), (8, 2)])
def test_lines_equal_brute_force(spark, monkeypatch, block, neighbours):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "NEIGHBOURS", neighbours)
    rng = random.Random(7)
    lines = copies(11, 200, length=25, families=5, changes=2) + ["", "---", "One. two", "one two", "x"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(60)] + [(60, ""), (61, None)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, line int, sim int")
    got = {r.doc_id: (r.n_lines, r.kept) for r in L.dedup_report(docs).collect()}
    want = lines_brute(rows)
    assert got == want
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns
    texts = dict(rows)
    for r in out.collect():
        if texts[r.doc_id] is None:
            assert r.text is None
            continue
        stay = [x for k, x in enumerate(texts[r.doc_id].split("\n")) if k in want[r.doc_id][1] or not words_of(x)]
        assert r.text == "\n".join(stay)


def test_lines_of_repeated_rows_null_ids_and_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b\nc d"), (1, "a b\nc d"), (None, "c d\ne f")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_lines, r.n_kept, r.n_removed) for r in L.dedup_report(docs).collect())
    assert got == [(-1, 2, 1, 1), (1, 2, 2, 0), (1, 2, 2, 0)]
    assert L.dedup_report(docs.limit(0)).collect() == []
    assert L.dedup_lines(docs.limit(0)).collect() == []


def replaced(seed, n, length, share=0.2):
    """Pairs of a line and a copy with as many words replaced as leave an edit similarity of 0.8, ``share`` of them at most."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    out = []
    while len(out) < n:
        line = [rng.choice(pool) for _ in range(length)]
        copy = list(line)
        for k in rng.sample(range(length), max(1, int(length * share))):
            copy[k] = rng.choice(pool)
        a, b = " ".join(line), " ".join(copy)
        if a != b and L._similar(a, b, 0.8):
            out.append((a, b))
    return out


@pytest.mark.parametrize("share,least", [(0, 0.98), (0.2, 0.93)])
def test_near_lines_of_any_length_are_found(spark, share, least):
    """Against edit similarity alone: every pair is one that should be found."""
    pairs = {n: replaced(n, 60, n, share) for n in (8, 12, 20, 30, 50)}
    rows = [(2 * k + side, pair[side]) for k, pair in enumerate(p for n in pairs for p in pairs[n]) for side in (0, 1)]
    got = {r.doc_id: r.n_kept for r in L.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] for i in got if i % 2 == 0)
    found = {n: sum(not got[2 * (60 * g + k) + 1] for k in range(60)) / 60 for g, n in enumerate(pairs)}
    print(share, found)
    assert sum(found.values()) / len(found) >= least, found
