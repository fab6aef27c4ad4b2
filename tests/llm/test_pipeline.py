"""The pipeline against its stages in plain Python, and the queries against their SQL."""

import os
import random

import numpy as np
import pytest
import zlib
from tokenizers import Tokenizer

import corpus_pipeline
from cedarlog.llm import queries as llm_queries
from cedarlog.llm.oracle import oracle_sql
from tests.check_oracle import connect, difference
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_models import measures
from tests.llm.test_pairs import jaccard_brute, lines_brute, words_of
from tests.llm.test_tokens import WORD

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def corpus(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(500)]

    def line(n):
        return " ".join(rng.choice(pool) for _ in range(n))

    items = [(k, line(20)) for k in range(5)] + [(9, None)]
    shared = [line(9) for _ in range(4)]
    rows = []
    for i in range(90):
        text = [line(rng.randint(5, 25)) for _ in range(6)]
        if rng.random() < 0.3:
            text.insert(2, rng.choice(shared))
        if rng.random() < 0.2:
            text.insert(1, rng.choice(items)[1] or "")
        if rng.random() < 0.3 and rows:
            words = (rng.choice(rows)[1] or "x").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = [" ".join(words)]
        rows.append((i, "\n".join(text) if rng.random() < 0.95 else rng.choice(["", "x y", None]), f"s{i % 3}"))
    return rows, items


def plain(rows, items):
    rows = [(i, t) for i, t, _ in rows if (m := measures(t)) and m[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    kept = lines_brute(rows)
    rows = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k in kept[i][1] or not words_of(x))) for i, t in rows]
    rows = [(i, t) for i, t in rows if words_of(t)]
    classes = jaccard_brute(rows)
    rows = [(i, t) for i, t in rows if classes[i][0] == i]
    bad = {i for i, n, hit, _ in hits(rows, items) if hit and 20 * hit >= n}
    return [(i, t) for i, t in rows if i not in bad]


def test_stages_equal_plain_python(spark, tmp_path):
    rows, items = corpus(3)
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plain(rows, items)
    assert 0 < len(want) < len(rows) - 10
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in now.collect()) == [(i, t, len(t)) for i, t in sorted(want)]
    lib, pieces = Tokenizer.from_file(WORD), []
    for i, t in want:
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        pieces += [(i, s // 4096, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096])) for s in range(0, len(ids), 4096)]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out) == sorted(pieces)


HELPERS = [
    "_id", "_tk", "_kept", "_key", "_first", "_row", "_host", "_base_failed", "_text", "row", "key", "tk", "id", "kept", "first", "host",
    "base_failed", "number", "block", "a b.c",
]


@pytest.mark.parametrize("stage", range(4))
def test_helper_names_as_input_columns(spark, tmp_path, stage):
    """A column of any name a stage uses inside comes back unchanged, and changes nothing."""
    rows, items = corpus(5)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain_rows = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    values = {name: [f"{name} {i}" for i, _, _ in rows] for name in HELPERS}
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{name}` string" for name in HELPERS)
    wide = spark.createDataFrame([(*r, *(values[name][k] for name in HELPERS)) for k, r in enumerate(rows)], schema)
    apply = corpus_pipeline.STAGES[stage][1]
    want = apply(spark, plain_rows, str(tmp_path)).collect()
    got = apply(spark, wide, str(tmp_path))
    assert got.columns == wide.columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted((r.doc_id, r.text or "") for r in want)
    assert all(r[name] == f"{name} {r.doc_id}" for r in got.collect() for name in HELPERS)


def test_stage_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_sql(spark, name):
    want = connect(SF_DIR).execute(oracle_sql()[name]).to_arrow_table()
    assert want.num_rows > 0
    assert difference(llm_queries.queries()[name](spark, SF_DIR).toArrow(), want) is None


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", [n for n in llm_queries.queries() if n not in oracle_sql() and n != "op13_qdwh_whitening"])
def test_query_gives_a_row_per_document(spark, name):
    found = llm_queries.queries()[name](spark, SF_DIR)
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    count = found.select("doc_id").distinct().count()
    assert 0 < count <= documents if name == "pipeline" else count == documents


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_whitening_gives_eight_rows_per_vector(spark):
    found = llm_queries.queries()["op13_qdwh_whitening"](spark, SF_DIR)
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
    rows = found.groupBy("vec_id").count().collect()
    assert len(rows) == vectors and {r["count"] for r in rows} == {8}
