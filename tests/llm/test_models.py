"""Quality rules, quality model, toxicity chain and fixity audit."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cedarlog.llm import fixity, quality_model, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(grams)
    covered = {k + d for k, g in enumerate(grams) if count[g] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_and_host_verdicts(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        pool = ["é", "ab", "#x", "c|d", " ", "日本"][: rng.randint(2, 6)] if i % 3 else [f"w{k}" for k in range(200)]
        text = "".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\t", "\r\n"]) for _ in range(rng.choice([0, 1, 2, 3, 60, 200])))
        rows.append((i, text, f"h{i % 7}"))
    rows += [(None, None, "bad"), (400, "", None), (400, "", None)] + [(500 + k, "x", "bad") for k in range(40)]
    rows += [(600, " ".join(f"v{k}" for k in range(80)), "bad"), (601, " ".join(f"v{k}" for k in range(80)), None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, host int")
    got = quality_rules.apply_host_rules(docs, max_rate=0.9).collect()
    want = sorted((str(i), *measures(t)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[600].base_failed, by_id[600].host_failed, by_id[600].kept) == (False, True, False)
    assert by_id[601].kept
    good = quality_rules.keep_good(docs, max_rate=0.9)
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert quality_rules.apply_host_rules(docs.limit(0)).collect() == []


def test_held_out_is_the_checksum(spark):
    got = {r.id: r.h for r in spark.range(200).select("id", quality_model.held_out(quality_model.F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_isotonic_is_the_best_rising_fit():
    x, y = quality_model.isotonic(np.arange(5.0), np.ones(5), np.array([0.0, 1, 0, 1, 1]))
    assert np.interp([0, 1.5, 4], x, y).tolist() == [0, 0.5, 1]
    assert (np.diff(y) >= 0).all()


def prose(rng, n=80):
    return " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        low, toxic = rng.random() < 0.3, rng.random() < 0.3
        text = prose(rng)
        if toxic:
            text += " " + rng.choice(["nastyword", "vilething"])
        docs.append((i, text.upper().replace(" ", "!! ") if low else text))
        labels.append((i, int(not low), int(low), int(toxic)))
    return (
        spark.createDataFrame([*docs, (700, None), (701, ""), (None, "a"), (5, docs[5][1])], "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, low_quality int, toxic int"),
    )


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    got = quality_model.score_quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert np.mean([a == b for a, b in held]) > 0.97


def test_quality_ignores_held_out_labels(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", quality_model.F.expr("IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, 1 - quality, quality)"))
    scores = [sorted((str(r.doc_id), r.score) for r in quality_model.score_quality(docs, x).collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_quality_without_labels_or_rows(labelled):
    docs, labels = labelled
    assert {r.score for r in quality_model.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.score_quality(docs.limit(0), labels).collect() == []


def test_toxicity_chain(labelled):
    docs, labels = labelled
    some = labels.where("doc_id % 2 = 0")
    got = toxicity.score_toxicity(docs, some, ["low_quality", "toxic"], features=50).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r for r in labels.collect()}
    fresh = [r for r in got if r.doc_id in truth and r.doc_id % 2]
    assert np.mean([(r.p_toxic >= 0.5) == truth[r.doc_id].toxic for r in fresh]) > 0.97
    assert toxicity.score_toxicity(docs.limit(0), some, ["toxic"]).collect() == []
    assert {r.p_toxic for r in toxicity.score_toxicity(docs, some.limit(0), ["toxic"]).collect()} == {0.5}


def test_chain_trains_on_probabilities_of_other_folds():
    link = toxicity.Link(np.array([0]), [np.array([1.0, 0]), np.array([2.0, 0]), np.array([5.0, 0])])
    active = [(np.array([0]), np.array([1.0]))] * 2
    assert toxicity.chain_odds(active, 1, [link], np.array([0, 1]))[0].tolist() == [1.0, 2.0]
    assert toxicity.chain_odds(active, 1, [link])[0].tolist() == [5.0, 5.0]


def test_text_features_are_words_and_beginnings():
    values, many, bounds = toxicity.text_features(pa.array(["Worthless", "worthy worth", None, "worthless worthless"]))
    sets = [set(values[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert [len(s) for s in sets] == [4, 3, 0, 4]
    assert many.tolist() == [1] * 4 + many[4:7].tolist() + [2] * 4 and sorted(many[4:7]) == [1, 1, 2]
    assert sets[0] == sets[3]
    assert len(sets[0] & sets[1]) == 1


@pytest.mark.parametrize("change", ["none", "some", "empty"])
def test_audit_finds_every_difference(spark, change, monkeypatch):
    monkeypatch.setattr(fixity, "RANGE_BYTES", 64)
    rng = random.Random(6)
    first = {(f"f{k % 9}", 37 * (k // 9)): f"record {k} {rng.random()}" for k in range(900)}
    second = dict(first)
    if change == "some":
        for place in rng.sample(sorted(first), 6):
            second[place] += "x"
        del second["f3", 37 * 5]
        second["f4", 10**9] = "new"
        second["other", 0] = "new file"
    if change == "empty":
        second = {}
    want = sorted((*p, "missing" if p not in second else "extra" if p not in first else "changed") for p in first.keys() | second.keys() if first.get(p) != second.get(p))
    frames = [spark.createDataFrame([(*p, t, 1) for p, t in r.items()], "file string, offset long, payload string, digest int") for r in (first, second)]
    assert sorted((r.file, r.offset, r.status) for r in fixity.audit(*frames).collect()) == want


def test_audit_of_nulls_and_repeats(spark):
    schema = "file string, offset long, payload string"
    a = spark.createDataFrame([(None, None, None), ("f", 1, "x"), ("f", 1, "x")], schema)
    b = spark.createDataFrame([("", -1, ""), ("f", 1, "x")], schema)
    assert [(r.file, r.offset, r.status) for r in fixity.audit(a, b).collect()] == [("f", 1, "changed")]
    assert fixity.audit(a, a).collect() == []


def test_audit_of_crowded_places(spark):
    """Thousands of records without file and offset, many of them equal, and clashing column names."""
    base = spark.range(9000).selectExpr("CAST(NULL AS STRING) AS file", "CAST(NULL AS LONG) AS offset", "IF(id < 4000, 'same', concat('p', id)) AS payload", "1 AS slot", "2 AS n")
    odd = base.withColumn("payload", fixity.F.when(fixity.F.col("payload") == "p7000", "q").otherwise(fixity.F.col("payload")))
    assert fixity.audit(base, base.repartition(5)).collect() == []
    assert [tuple(r) for r in fixity.audit(base, odd).collect()] == [("", -1, 5, "changed")]
    fewer = base.where("payload <> 'same'").unionByName(base.where("payload = 'same'").limit(3999))
    assert [r.status for r in fixity.audit(base, fewer).collect()] == ["changed"]
    assert [tuple(r) for r in fixity.audit(base.limit(0), base).collect()] == [("", -1, 5, "extra")]
    assert [r.status for r in fixity.audit(base, base.limit(0)).collect()] == ["missing"]
