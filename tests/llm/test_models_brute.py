"""The toxicity chain and the quality model against plain versions over strings."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cedarlog.llm import quality_model, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed, n=160):
    rng = random.Random(seed)
    pool = ["rain", "Meadow", "lantern", "thought", "évé", "walking", "be", "a", "river7"]
    docs, labels = [], []
    for i in range(n):
        low, toxic = rng.random() < 0.35, rng.random() < 0.35
        words = [rng.choice(pool) for _ in range(rng.choice([1, 5, 12, 40]))]
        words += rng.choices(["nastyword", "vilething", "nastywords"], k=rng.randint(1, 3)) * toxic
        rng.shuffle(words)
        text = " ".join(words) + (" ##!! | click" if low else ".") + ("\n" + " ".join(words[:3])) * rng.randint(0, 2)
        docs.append((i, text))
        labels.append((i, int(not low) if rng.random() < 0.95 else None, int(toxic)))
    docs += [(n, None), (n + 1, ""), (None, "nastyword"), (3, docs[3][1]), (n + 2, docs[5][1])]
    labels += [(n, 1, 0), (n + 1, 0, 0), (None, 1, 1), (7, 1, 1), (7, 0, 0), (n + 2, 1, 0)]
    return docs, labels


def features_of(text):
    words = WORD.findall(lowered(text))
    found = Counter(("word", w) for w in words)
    for size in toxicity.PREFIXES:
        found.update(("beginning", w.encode()[:size]) for w in words if len(w.encode()) > size)
    return found


def newton(x, y, ridge):
    """One model's steps; yields the coefficients after each."""
    beta = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 0
    while True:
        eta = np.clip(x @ beta, -15, 15)
        p = 1 / (1 + np.exp(-eta))
        w = np.maximum(p * (1 - p), 1e-5)
        a = sum((w[i] * np.outer(x[i], x[i]) for i in range(len(x))), np.zeros((x.shape[1],) * 2))
        beta = np.linalg.solve(a + np.diag(shrink + 2e-9), x.T @ (w * eta + y - p))
        yield beta


@pytest.mark.parametrize("seed", [1, 2])
def test_toxicity_chain_equals_brute_force(spark, seed):
    docs, labels = corpus(seed)
    schema = "doc_id long, text string"
    frame = spark.createDataFrame(docs, schema)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("low", 1 - F.col("quality"))
    got = toxicity.score_toxicity(frame, marks, ["low", "toxic"], features=10_000, ridge=0.3)
    got = sorted(((r.doc_id, r.p_low, r.p_toxic) for r in got.collect()), key=str)

    best = {}
    for i, quality, toxic in labels:
        if i is not None and quality is not None:
            before = best.get(i, (0, 0))
            best[i] = (max(before[0], 1 - quality), max(before[1], toxic))
    folds = {r.text: r.f for r in frame.select("text", F.pmod(F.xxhash64("text"), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    train = [(t, *best[i]) for i, t in docs if i in best]
    seen = Counter(f for t, *_ in train for f in features_of(t))
    chosen = [f for f, n in seen.items() if n >= 3]

    def rows(texts):
        return np.array([[np.log2(1 + features_of(t)[f]) for f in chosen] for t in texts])

    x, fold = rows([t for t, *_ in train]), np.array([folds[t] for t, *_ in train])
    every = rows([t for _, t in docs])
    one = np.ones((len(x), 1))
    odds, all_odds = np.zeros((len(x), 0)), np.zeros((len(every), 0))
    want = []
    for k in (1, 2):
        y = np.array([float(row[k]) for row in train])
        design = np.hstack([x, odds, one])
        steps = [newton(design[fold != m], y[fold != m], 0.3) for m in range(toxicity.FOLDS)] + [newton(design, y, 0.3)]
        before = np.zeros((len(steps), design.shape[1]))
        for _ in range(toxicity.STEPS):
            now = np.array([next(s) for s in steps])
            done = np.abs(now - before).max() < 1e-3
            before = now
            if done:
                break
        mine = np.clip([row @ before[f] for row, f in zip(design, fold, strict=True)], -12, 12)
        full = np.clip(np.hstack([every, all_odds, np.ones((len(every), 1))]) @ before[-1], -12, 12)
        odds, all_odds = np.column_stack([odds, mine]), np.column_stack([all_odds, full])
        want.append(1 / (1 + np.exp(-full)))
    want = sorted(((i, a, b) for (i, _), a, b in zip(docs, *want, strict=True)), key=str)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert np.allclose([r[1:] for r in got], [r[1:] for r in want], atol=1e-6)


def statistics_of(text):
    data = (text or "").encode()
    words = WORD.findall(lowered(text))
    sizes = [len(w.encode()) for w in words]
    lines = [tuple(WORD.findall(x)) for x in lowered(text).split("\n") if WORD.search(x)]
    grams = [tuple(words[k : k + 3]) for k in range(max(len(words) - 2, 1 if words else 0))]
    n, n_words = max(len(data), 1), max(len(words), 1)
    shares = [sum(bool(c[b]) for b in data) / n for c in quality_model.BYTE_CLASSES.values()]
    return [
        *shares, np.log1p(len(data)), np.log1p(len(words)), sum(sizes) / n_words, sum(s <= 3 for s in sizes) / n_words,
        sum(s >= 9 for s in sizes) / n_words, len(set(words)) / n_words, 1 - len(set(grams)) / max(len(grams), 1), np.log1p(len(lines)),
        np.log1p(len(words) / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(words) / (data.count(b".") + 1)),
    ]


@pytest.mark.parametrize("seed", [3, 4])
def test_quality_equals_brute_force(spark, seed):
    docs, labels = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(((r.doc_id, r.held_out, r.score, r.predicted) for r in quality_model.score_quality(frame, marks, features=20).collect()), key=str)

    out = {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in docs}
    folds = {r.doc_id: r.f for r in frame.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality_model.FOLDS)).alias("f")).collect()}
    train = [(statistics_of(t), float(q), folds[i]) for i, t in docs for j, q, _ in labels if i is not None and i == j and q is not None and not out[i]]
    s, y, fold = np.array([r[0] for r in train]), np.array([r[1] for r in train]), np.array([r[2] for r in train])
    mean, spread = s.mean(0), s.std(0)
    spread[spread <= 1e-9] = 1
    rng = np.random.default_rng(7)
    directions = rng.normal(size=(s.shape[1], 20)) / np.sqrt(s.shape[1])
    phases = rng.uniform(0, 2 * np.pi, 20)

    def fourier(stats):
        z = np.clip((np.array(stats) - mean) / spread, -8, 8)
        return np.hstack([np.sqrt(2 / 20) * np.cos(z @ directions + phases), np.ones((len(z), 1))])

    def ridge(x, t):
        return np.linalg.solve(x.T @ x + np.diag([1.0] * 20 + [0]) + 2e-9 * np.eye(21), x.T @ t)

    x = fourier(s)
    raw = np.array([row @ ridge(x[fold != f], y[fold != f]) for row, f in zip(x, fold, strict=True)])
    bins = np.clip(np.floor((raw + 0.5) * 1000), 0, 1999)
    cells = [(raw[bins == b].mean(), y[bins == b].mean(), (bins == b).sum()) for b in np.unique(bins)]
    at, rate, n = (np.array(c) for c in zip(*cells, strict=True))
    # the least squares rising fit: the largest of the smallest means to the right
    fit = np.array([max(min(np.average(rate[a : b + 1], weights=n[a : b + 1]) for b in range(k, len(at))) for a in range(k + 1)) for k in range(len(at))])
    blocks = [np.isclose(fit, v, atol=1e-12) for v in sorted(set(np.round(fit, 12)))]
    curve = [np.average(at[b], weights=n[b]) for b in blocks], [fit[b][0] for b in blocks]
    score = np.clip(np.interp(fourier([statistics_of(t) for _, t in docs]) @ ridge(x, y), *curve), 0, 1)
    want = sorted(((i, out[i], v, int(v >= 0.7)) for (i, _), v in zip(docs, score, strict=True)), key=str)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-6)
    assert [r[3] for r in got] == [r[3] for r in want]


def test_several_labels_of_one_id(spark):
    docs = spark.createDataFrame([(k, f"plain words number{k}") for k in range(30)] + [(k, "vilething said") for k in range(30, 60)], "doc_id long, text string")
    rows = [(k, int(k >= 30)) for k in range(60)] + [(k, 0) for k in range(30, 60)]
    both = [
        {r.doc_id: r.p_toxic for r in toxicity.score_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int").repartition(p), ["toxic"]).collect()}
        for x, p in ((rows, 1), (rows[::-1], 7))
    ]
    assert np.allclose(list(both[0].values()), [both[1][k] for k in both[0]], atol=1e-9)
    assert all((p >= 0.5) == (k >= 30) for k, p in both[0].items())
