"""Site templates, importance resampling by position checksums, and whitening, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cedarlog.llm import qdwh, resampling, site_template, whitening
from cedarlog.llm.position_crc import BLOCK, span_crc32

PAGE = "page_id long, url string, html string, text string, host string, template int, hashes int"


def extract(spark, pages, **options):
    rows = [(k, url, source, "x", "y", 1, 2) for k, (url, source) in enumerate(pages)]
    got = site_template.extract_text(spark.createDataFrame(rows, PAGE), **options).collect()
    assert all(r.n_chars == len(r.text) and r.url == rows[r.page_id][1] for r in got)
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; a <b>bo</b>ld word", "just text & a bold word"),
        ("<p>a<p>b<br>c</p>d", "a b c d"),
        ("<article><h1>T</h1><p><b>one<br><p>two &lt;3 &eacute;t&#233; &copy 5</article><footer>f</footer>", "T one two <3 été © 5"),
        ("<head><title>x</title><script>var t='</p>';</script></head><body><p>in", "in"),
        ("<script>never closed <p>a", ""),
        ("<!-- a <p> --><p>x<!-- unclosed <p>y", "x"),
        ("<p title='a>b' class=c data-x=\"<p>\">x</p >y", "x y"),
        ("<p don't>x</p><p>it's", "x it's"),
        ("<div>a<span>b</span>c</div>", "abc"),
        ("1 < 2 and <3 <p>x</p> <x", "1 < 2 and <3 x"),
        ("<NAV>menu</NAV><MAIN><P>Body</P><aside>side</aside></MAIN><form>f</form>", "Body"),
        ("<form><article><p>kept</p><button>go</button></article></form>", "kept"),
        ("<div class='has-sidebar'><h1>t</h1></div><div class='sideBar'>s</div><div id=cookie-notice>c</div>", "t s"),
        ("<article>a<section class=comments><article class=comment>c</article></section></article>", "a"),
        ("<header>site</header><article><header><h1>t</h1></header>x</article>", "t x"),
        ("<p hidden>h</p><p style='display: none'>d</p><p>v</p>", "v"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("a  b&nbsp;c\n\td", "a b c d"),
        ("</p></div><p>x</span></p>", "x"),
    ],
)
def test_text_of_one_page(spark, source, text):
    tree = site_template.PageTree(source or "")
    inside = [any(a <= k < b for a, b in tree.apart) for k in range(len(tree.pieces))]
    assert " ".join("".join(" " if i else p for p, i in zip(tree.pieces, inside, strict=True)).split()) == text


def test_recurring_subtrees_of_a_host_go(spark):
    box = "<div><p>Call us on weekdays</p></div>"
    links = "<ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul>"
    legal = "<p>The same words in each article.</p>"
    pages = [(f"http://a.example/{k}", f"{box}<article><p>story {k}</p>{legal}{links}</article>") for k in range(6)]
    pages += [("http://b.example/1", f"{box}<article><p>other</p>{links}</article>"), (None, f"{box}none"), ("nonsense", None)]
    pages += [("http://c.example/same", f"{box}copy")] * 9  # one address
    got = extract(spark, pages)
    assert got[:6] == [f"story {k} The same words in each article." for k in range(6)]
    assert got[6:9] == ["Call us on weekdays other One Two", "Call us on weekdays none", ""]
    assert set(got[9:]) == {"Call us on weekdays copy"}
    assert extract(spark, pages, min_pages=7)[0].startswith("Call us on weekdays story 0")
    assert extract(spark, pages, min_share=1.0)[0] == got[0]


def test_templates_by_salted_join_are_the_same(spark, monkeypatch):
    pages = [(f"http://h.example/{k % 50}", f"<div>menu {k % 3}</div><p>text {k}</p>") for k in range(120)]
    broadcast = extract(spark, pages)
    monkeypatch.setattr(site_template, "BROADCAST_TEMPLATES", 0)
    assert extract(spark, pages) == broadcast == [f"text {k}" for k in range(120)]


def test_pages_none_and_very_long(spark):
    assert extract(spark, []) == []
    text = " ".join(f"w{k}" for k in range(200_000))
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000 + "<span>" * 20_000 + "</a>" * 20_000 + "y"
    got = extract(spark, [("http://l.example/1", f"<p>{text}</p>" + "<p>" * 50_000 + "<a b=\"" * 3), ("http://l.example/2", deep)])
    assert got == [text, "x y"]


def test_span_checksums_of_every_length():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 400_000).astype(np.uint8)
    length = np.concatenate([np.arange(3 * BLOCK + 2), rng.integers(0, 9, 5000), [65_536, 100_001, 300_000]])
    first = rng.integers(0, 100_000, len(length))
    assert span_crc32(data, first, length).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(first, length, strict=True)]
    assert span_crc32(data, np.zeros(0), np.zeros(0)).tolist() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, n):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return ws, [" ".join(ws[k : k + m]) for m in range(1, n + 1) for k in range(len(ws) - m + 1)]


def plain_resample(docs, target, n=1, buckets=10000, share=(10, 100), least=20, seed=2024):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t, n)[1])

    s, t = counts(x for _, x in docs), counts(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for id_, text in docs:
        ws, fs = plain_features(text, n)
        at = [zlib.crc32(f.encode()) % buckets for f in fs]
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in at)
        h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        rows.append([id_, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)])
    can = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(can[: share[0] * len(can) // share[1]])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize(("n", "buckets", "share"), [(1, 10000, (10, 100)), (3, 97, (1, 2))])
def test_resampling_against_plain_python(spark, n, buckets, share):
    rng = random.Random(n)
    pool = [*(f"W{k}" for k in range(60)), "É", "日本", "it's", "x" * 70, "İ", "a-b", "0", "~"]
    docs = [(k, rng.choice([" ", "\n", ", "]).join(rng.choice(pool) for _ in range(rng.choice([0, 1, 19, 20, 60])))) for k in range(300)]
    docs += [(None, None), (None, docs[5][1]), (400, ""), (401, " ".join(f"t{k}" for k in range(20))), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(500, "y" * 5000 + " " + "z " * 3000)]
    target = [" ".join(rng.choice(pool[:9]) for _ in range(30)) for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, id int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(frame, goal, n=n, buckets=buckets, share=share)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(docs, target, n, buckets, share)
    assert resampling.resample(frame.limit(0), goal).collect() == []
    empty = resampling.resample(frame, goal.limit(0), n=n, buckets=buckets, share=share).collect()
    assert sorted((tuple(r) for r in empty), key=repr) == plain_resample(docs, [], n, buckets, share)


def test_features_do_not_depend_on_the_block(monkeypatch):
    texts = pa.array(["a b c d", None, "É " * 50, "", "one"])
    whole = resampling.feature_buckets(texts, 2, 1000)
    monkeypatch.setattr(resampling, "FEATURES_AT_A_TIME", 3)
    assert all((a == b).all() for a, b in zip(whole, resampling.feature_buckets(texts, 2, 1000), strict=True))


@pytest.mark.parametrize("kind", ["random", "ties", "rank", "graded", "zero", "one"])
def test_components_are_those_of_the_covariance(kind):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    values = {"random": rng.random(24), "ties": np.repeat([5.0, 3, 1], 8), "rank": np.r_[np.ones(3), np.zeros(21)], "graded": 10.0 ** -np.arange(24), "zero": np.zeros(24)}
    a = np.array([[2.0]]) if kind == "one" else q @ np.diag(values[kind]) @ q.T
    e, v = qdwh.top_components(a, 8)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:8]
    assert np.abs(e - want).max() <= 1e-13 * max(want[0], 1e-300)
    assert np.abs(a @ v - v * e).max() <= 1e-13 * max(want[0], 1e-300)
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13


def plain_whitening(vectors, k=8):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors])
    n, s = len(x), x.sum(axis=0)
    cov = np.cov(x.T, bias=True).reshape(x.shape[1], -1)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u / np.sqrt(e), e / np.trace(cov)


@pytest.mark.parametrize("d", [1, 5, 64])
def test_whitening_against_numpy(spark, d):
    rng = np.random.default_rng(d)
    good = (rng.normal(size=(700, d)) * np.linspace(1, 3, d)).astype(np.float32).tolist()
    good[10] = good[11]
    bad = [None, [None] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [1e30] * d, [], [0.0] * (d + 1)]
    rows = [(k % 690, v, 1, 2) for k, v in enumerate(good)] + [(None, v, 1, 2) for v in bad]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, vector int").repartition(5)
    got = whitening.whiten(frame).collect()
    k = min(d, 8)
    assert len(got) == 700 * k and {r.n for r in got} == {700}
    deviation, white, share = plain_whitening(good)
    ids = np.array([r[0] for r in rows[:700]])
    for c in range(k):
        own = [r for r in got if r.component == c + 1]
        mine = sorted((r.vec_id, r.deviation, abs(r.whitened)) for r in own)
        plain = sorted(zip(ids.tolist(), deviation.tolist(), np.abs(white[:, c]).tolist(), strict=True))
        assert [m[:2] for m in mine] == [p[:2] for p in plain]
        np.testing.assert_allclose([m[2] for m in mine], [p[2] for p in plain], atol=1e-8)
        assert abs(own[0].explained / share[c] - 1) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_without_variance_or_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")
    for rows in (frame, frame.limit(1), frame.limit(0)):
        got = whitening.whiten(rows)
        assert got.columns[:3] == ["vec_id", "component", "n"] and got.collect() == []
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


def test_deviations_are_exact_or_null():
    model = whitening.Whitening(1 << 40, [7, -5], np.eye(2), np.ones(2), 2.0)
    x = np.array([[1, 0], [0, 0], [1 << 30, 3]])
    exact = [sum(((1 << 40) * int(a) - s) ** 2 for a, s in zip(row, model.sums, strict=True)) for row in x]
    assert model.deviations(x) == [v if v < 1 << 63 else None for v in exact]
    small = whitening.Whitening(10, [7, -5], np.eye(2), np.ones(2), 2.0)
    assert small.deviations(np.array([[1, 0], [1 << 20, 5]])) == [34, (10 * (1 << 20) - 7) ** 2 + 55**2]
