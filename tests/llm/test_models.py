"""Toxicity, language and HTML operators."""

import zlib
from html import unescape

import numpy as np
import pytest

from voltframe.llm import html, langid, toxicity

MID = "/root/testdata/sf0.1"


def brute_marginals(crf, n, at, extra):
    """All-steps forward-backward."""
    e = np.full(n, crf.bias)
    for i, x in zip(at, extra, strict=True):
        e[i] += x
    m = [np.exp(crf.moves) * np.array([1.0, np.exp(v)]) for v in e]
    ahead = [np.array([1.0, 0.0])]
    for s in m:
        v = ahead[-1] @ s
        ahead.append(v / v.sum())
    back = [np.ones(2)]
    for s in reversed(m):
        v = s @ back[-1]
        back.append(v / v.sum())
    back = back[::-1]
    p = [ahead[i + 1] * back[i + 1] for i in range(n)]
    log_z, v = 0.0, np.array([1.0, 0.0])
    for s in m:
        v = v @ s
        log_z += np.log(v.sum())
        v = v / v.sum()
    return np.array([q[1] / q.sum() for q in p]), n * crf.moves[0, 0] - log_z


def test_marginals_with_runs_are_those_of_all_steps():
    crf = toxicity.Crf(weights={"=bad": 5.0}, bias=-3.0, moves=np.array([[0.4, -0.6], [-0.2, 0.3]]))
    crf.prepare()
    for n, at in ((1, [0]), (7, [3]), (30, [0, 1, 2, 17, 29]), (400, [5, 390])):
        extra = [4.0 + 0.1 * i for i in range(len(at))]
        p, none = crf.marginals(n, at, extra)
        want, log_none = brute_marginals(crf, n, at, extra)
        assert p == pytest.approx(want[at], abs=1e-9) and none == pytest.approx(log_none, abs=1e-7)
    _, none = crf.marginals(50, [], [])
    assert none == pytest.approx(brute_marginals(crf, 50, [], [])[1], abs=1e-7)


def test_toxic_documents_are_found_with_spans():
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in "ba be bi bo bu ka ke ki".split() for b in "ra re ri ro ru la le".split()]
    texts, labels = [], []
    for i in range(400):
        w = rng.choice(words, 60).tolist()
        if i % 5 == 0:
            w[int(rng.integers(60))] = f"zorg{rng.choice(words)}"
            w[int(rng.integers(60))] = "Scumbag!!"
        texts.append(" ".join(w))
        labels.append(int(i % 5 == 0))
    crf = toxicity.fit(texts, labels)
    assert all((crf.score(t)[0] >= 0.7) == bool(y) for t, y in zip(texts, labels, strict=True))
    score, spans = crf.score("ba  😀 zorgnew, kara scumbag.")
    assert score >= 0.7 and [(a, b) for a, b, _ in spans] == [(6, 13), (20, 27)]
    for t in (None, "", "\n"):
        assert crf.score(t)[0] < 0.1 and crf.score(t)[1] == []
    assert 0 <= toxicity.fit([], []).score("x")[0] <= 1 and 0 <= toxicity.fit(["a"], [1]).score("x")[0] <= 1


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.op1_toxicity(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.9
    df = spark.createDataFrame([(1, "x", "a"), (1, "x", "a"), (None, None, "b")], "doc_id long, text string, toxic_score string")
    none = spark.createDataFrame([(None, None)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(df, none).count() == 3


def test_language_codes_and_held_out_accuracy(spark):
    for n in (1, 2, 4, 7, 12):
        c = langid.codewords(n)
        assert len(c) == n and len({tuple(r) for r in c.tolist()}) == n
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in langid.op8_language(spark, sf).collect()}
    assert set(got) == set(docs)
    held = [i for i, r in got.items() if r.held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[i].lang_pred == docs[i].lang for i in held]) > 0.97
    df = spark.createDataFrame([(1, None, None), (2, "", None), (3, "123 ½ !?", "en"), (4, "the cat", "en"), (None, "le chat est là", "fr")], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.identify_language(df).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[4].lang_pred in ("en", "fr")
    assert {r.lang_pred for r in langid.identify_language(df, langid.fit([], [])).collect()} == {"und"}


def test_long_texts_count_the_same_in_blocks(monkeypatch):
    t = "Das ist ein Text, " * 200000
    assert langid.ngrams(t) == pytest.approx(langid.ngrams("Das ist ein Text, " * 1000), abs=1e-3)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script><style>p{}</style></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a>One</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Big &amp; bold</h1><p><b>First   part<br>goes on.<p>Second &lt;one&gt;&nbsp;here.</p><div class="ad">Buy!</div>
<aside>Aside</aside><form><input value="x">Send</form><p>a < b &#233;.</p><section class="comments"><p>Nice!</p></section></article>
<div id="sidebar">Side</div><footer>&copy; me</footer></body></html>"""


def test_main_text_of_marked_articles():
    assert html.main_text(PAGE) == "Big & bold\n\nFirst part goes on.\n\nSecond <one> here.\n\na < b é."
    for t in (None, "", " ", "<nav>x</nav>", "<script>alert(1)", "<!-- never closed"):
        assert html.main_text(t) == ""


def test_main_text_without_marks_takes_dense_paths():
    p = "".join(f"<p>Sentence {i}, with words; and more, and still more words to read. It goes on.</p>" for i in range(6))
    page = f"<body><div class=menu><a>A</a><a>B</a></div><div class=x><span><a href=/>link one</a></span></div><div class=t>{p}</div><div>Short</div></body>"
    got = html.main_text(page)
    assert got.count("Sentence") == 6 and "link one" not in got and "Short" not in got


def test_html_query(spark):
    import re

    for r in html.op10_html(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)
    df = spark.createDataFrame([(1, None, "u", "x"), (1, PAGE, "u", "y")], "page_id long, html string, url string, main_text string")
    assert sorted(len(r.main_text) > 0 for r in html.extract_text(df).collect()) == [False, True]
