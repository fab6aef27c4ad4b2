"""Edit distances of many pairs at a time, and the groups that come of them, against one pair at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cedarlog.llm import edits as E
from cedarlog.llm import line_dedup as L
from cedarlog.llm.groups import Forest


def changed(rng, base, share, letters):
    s = list(base)
    for _ in range(rng.randint(0, int(len(s) * share) + 1)):
        p, how = rng.randrange(len(s) + 1), rng.random()
        if how < 0.35 and p < len(s):
            s[p] = rng.choice(letters)
        elif how < 0.7:
            s.insert(p, rng.choice(letters))
        elif p < len(s) > 1:
            del s[p]
    cut = rng.randrange(len(s)) if rng.random() < 0.2 else 0
    return "".join(s[cut:] + s[:cut])


@pytest.mark.parametrize("own,shared", [(96, 32), (4, 2)])
@pytest.mark.parametrize("likely", [False, True])
@pytest.mark.parametrize("threshold", [0.8, 0.5, 0.95])
def test_distances_of_many_pairs(monkeypatch, own, shared, likely, threshold):
    monkeypatch.setattr(E.Letters, "LETTERS", own)
    monkeypatch.setattr(E.Letters, "SHARED", shared)
    rng = random.Random(own + likely)
    for length in (1, 5, 40, 100, 330, 700):
        base = "".join(rng.choice("abcdé日 f") for _ in range(length))
        texts = [changed(rng, base, 0.35, "abcdeé日本fz ") for _ in range(16)]
        size = np.array([len(t) for t in texts])
        letters = E.Letters(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum(size) - size, np.cumsum(size))
        x, y = np.nonzero(~np.eye(16, dtype=bool))
        most = np.floor(np.maximum(size[x], size[y]) * (1 - threshold) + 1e-9).astype(np.int64)
        got = E.within(letters, x, y, most, lambda p, q: L._similar(texts[p], texts[q], threshold), likely)
        want = [L.edit_distance(texts[p], texts[q]) <= m for p, q, m in zip(x.tolist(), y.tolist(), most.tolist(), strict=True)]
        assert got.tolist() == want


def dealt(seed, groups, most):
    """Rows as a verifying task gets them, sorted by hub, i, j; lines of few families, some not of ASCII, some with wide spaces."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    rows = []
    for hub in range(groups):
        families = [[rng.choice(pool) for _ in range(rng.choice([3, 12, 40]))] for _ in range(3)]
        two = hub % 3 == 0
        for _ in range(rng.randint(2, most)):
            words = list(rng.choice(families))
            for k in rng.sample(range(len(words)), rng.randint(0, len(words) * 2 // 5)):
                words[k] = rng.choice(pool)
            line = rng.choice([" ", ", ", "  "]).join(words).title()
            rows.append((hub, 0, int(two), rng.randint(0, 1) if two else 0, rng.getrandbits(62), rng.getrandbits(12) * 0x1001, line))
    rows.sort(key=lambda r: (r[0], r[4]))
    return pa.table(dict(zip(("hub", "i", "j", "own", "key", "sim", "text"), map(list, zip(*rows, strict=True)), strict=True)))


def joined(edges):
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    return sorted((k, forest.find(k)) for k in forest.parent)


@pytest.mark.parametrize("rows,pairs,bytes_", [(8, 1 << 21, 1 << 20), (64, 100, 1 << 20), (32768, 1 << 21, 3000), (32768, 1 << 21, 1 << 24)])
def test_verified_groups_equal_pair_by_pair(monkeypatch, rows, pairs, bytes_):
    for name, value in (("ROWS", rows), ("PAIRS", pairs), ("BYTES", bytes_)):
        monkeypatch.setattr(L, name, value)
    table = dealt(5, 30, 14)
    data = table.to_pylist()
    normal = [" ".join(L._normal(r["text"]).split()) for r in data]
    want = []
    for x, a in enumerate(data):
        for y, b in enumerate(data[:x]):
            apart = a["i"] == a["j"] or a["own"] != b["own"]
            near = (a["sim"] ^ b["sim"]).bit_count() <= L.MAX_BITS
            if a["hub"] == b["hub"] and apart and near and L._similar(normal[x], normal[y], 0.8):
                want.append((a["key"], b["key"]))
    got = [(a, b) for batch in L._verifier(0.8)(iter(table.to_batches(37))) for a, b in zip(*batch.to_pydict().values(), strict=True)]
    assert len(want) > 50 and joined(got) == joined(want)


def test_few_pairs_are_compared_one_by_one(monkeypatch):
    calls = []
    plain = L.edit_distance
    monkeypatch.setattr(L, "edit_distance", lambda *args: (calls.append(1), plain(*args))[1])
    table = dealt(6, 12, 90)
    assert sum(batch.num_rows for batch in L._verifier(0.8)(iter(table.to_batches(200)))) > 100
    assert len(calls) < 1000, len(calls)


def test_bucket_blocks_hold_every_bucket(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(L, "LINES", 50)
    sim = rng.integers(-(2**63), 2**63, 400, dtype=np.int64)
    sim[200:300] = sim[200] ^ (np.int64(1) << rng.integers(0, 62, 100))
    values = rng.integers(0, 60, (400, L.TABLES)).astype(np.int32)
    values[200:300, 5] = 7
    lists = pa.ListArray.from_arrays(pa.array(np.arange(401, dtype=np.int32) * L.TABLES), pa.array(values.ravel()))
    lines = pa.table({"sim": sim, "tables": lists})
    near = np.bitwise_count(sim.view(np.uint64)[:, None] ^ sim.view(np.uint64)[None, :]) <= L.MAX_BITS
    want = {(int(sim[x]), int(sim[y])) for k in range(L.TABLES) for x, y in np.argwhere((values[:, k][:, None] == values[:, k][None, :]) & near) if x != y}
    for ranges, neighbours, entries in ((1, 256, 1 << 22), (5, 256, 1 << 22), (3, 2, 500)):
        monkeypatch.setattr(L, "NEIGHBOURS", neighbours)
        monkeypatch.setattr(L, "ENTRIES", entries)
        rows = pa.Table.from_batches(list(L._deal(ranges)(iter(lines.to_batches(37)))))
        assert len(rows) <= 8 * ranges + 8
        found = pa.Table.from_batches(list(L._buckets(iter(rows.sort_by("range").to_batches(3))))).to_pylist()
        hubs = {}
        for r in found:
            hubs.setdefault(r["sim"], set()).add(r["hub"])
        assert all(hubs[a] & hubs[b] for a, b in want)
        assert neighbours < 256 or set(hubs) == {a for a, _ in want}
    assert list(L._deal(2)(iter([]))) == [] and list(L._buckets(iter([]))) == []


def test_simhash_counts_words_of_long_and_short_lines():
    rng = np.random.default_rng(1)
    size = np.array([1, 2, 254, 255, 256, 70000, 3, 511, 600, 1])
    bounds = np.concatenate([[0], np.cumsum(size)])
    hashes = rng.integers(0, 2**64, bounds[-1], dtype=np.uint64)
    hashes[3:200] &= np.uint64(0xFF)  # many equal words
    want = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        words = np.unique(hashes[lo:hi])
        votes = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        want.append(np.packbits(2 * votes > len(words)).view(np.uint64)[0])
    assert L.simhash(hashes, bounds).tolist() == [int(x) for x in want]
