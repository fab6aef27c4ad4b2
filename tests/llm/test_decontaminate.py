"""The positional index against a scan for every window."""

import random
import re

import numpy as np

from cedarlog.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=13):
    out = []
    for i, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for item, other in items:
            v = words_of(other)
            for s in range(max(len(v) - width, 0) + 1) if v else ():
                window = v[s : s + width]
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    pool = ["alpha", "Beta", "é", "7", "of", "the", "x" * 300]
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 4, 13, 14, 30])))) for k in range(12)]
    items += [(3, "of the of the"), (40, None), (41, "!!")]
    docs = []
    for i in range(50):
        parts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 1), rng.choice(items)[1] or "")
        docs.append((i, ", ".join(parts)))
    return docs + [(60, None), (61, ""), (60, "of the of the"), (None, "of the of the")], items


def test_hits_equal_a_scan(spark, monkeypatch):
    docs, items = case(4)
    frame = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, block int, term string")
    bench = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    for block, windows in ((16 << 20, 100_000), (2000, 20)):
        monkeypatch.setattr(D, "BLOCK_BYTES", block)
        monkeypatch.setattr(D, "WINDOWS_A_PASS", windows)
        got = D.decontaminate(frame, bench).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == want
        assert all(set(r["items"]) <= set(r.near_items) for r in got)


def test_proximity_allows_words_off_their_place(spark):
    docs = spark.createDataFrame([(1, "one two three x four five"), (2, "one two x x x three four five")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.near_items) for r in D.decontaminate(docs, bench).collect()}
    assert got == {1: (0, ["1"]), 2: (0, [])}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r.n_hit for r in D.decontaminate(docs, bench.limit(0)).collect()] == [0]
    assert D.decontaminate(docs.limit(0), bench).collect() == []


def test_items_without_ids_and_long_items(spark):
    words = [f"w{k}" for k in range(70_000)]
    docs = spark.createDataFrame([(1, "a b c"), (2, " ".join(words[65_500:65_600])), (3, " ".join(words[69_990:]))], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "A b"), ("null", "b c"), (None, "b, c"), ("long", " ".join(words))], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in D.decontaminate(docs, bench).collect()}
    assert got == {1: (3, ["null", "null"], [(0, 3)]), 2: (100, ["long"], [(0, 100)]), 3: (0, [], [])}


def test_no_window_passes_through_the_driver(spark, monkeypatch):
    """Windows dealt to many parts give what one part gives."""
    docs, items = case(9)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for most in (100_000, 3):
        monkeypatch.setattr(D, "WINDOWS_A_PASS", most)
        monkeypatch.setattr(D, "BROADCAST_TERMS", most)
        found = D.decontaminate(frame, bench).drop("block", "ordinal").collect()
        rows.append(sorted(map(str, found)))
    assert rows[0] == rows[1]


def test_varint_lists():
    steps = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**31], np.int64)
    coded, size = D.varint(steps)
    assert D.places(coded.tobytes()).tolist() == np.cumsum(steps).tolist()
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 4, 5]
