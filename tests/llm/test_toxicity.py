"""The chain against all steps in logarithms, the gradient against differences, and what the model learns from documents."""

import zlib
from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest

from voltframe.llm import toxicity


def brute(x, moves):
    """All paths of one document: probability of toxic for each token, and log-probability of none."""
    paths = []
    for path in product((0, 1), repeat=len(x)):
        before, score = 0, 0.0
        for t, y in enumerate(path):
            score += moves[before, y] + y * x[t]
            before = y
        paths.append((path, np.exp(score)))
    z = sum(w for _, w in paths)
    return [sum(w for p, w in paths if p[t]) / z for t in range(len(x))], np.log(paths[0][1] / z)


def test_chain_matches_all_paths(monkeypatch):
    rng, moves = np.random.default_rng(3), np.array([[0.7, -0.9], [-0.4, 0.8]])
    sizes = np.array([3, 0, 1, 7, 0, 9, 2, 0])
    x = rng.normal(size=sizes.sum()) * 3
    for stretch in (1, 2, 5, 256):
        monkeypatch.setattr(toxicity, "STRETCH", stretch)
        s = toxicity.chain(x, sizes, moves)
        at = 0
        for k, n in enumerate(sizes.tolist()):
            p, none = brute(x[at : at + n], moves)
            assert s.p[at : at + n] == pytest.approx(p) and s.clean[k] == pytest.approx(none, abs=1e-9)
            at += n


def test_gradient_matches_differences():
    rng, moves = np.random.default_rng(4), np.array([[0.3, -0.5], [0.1, 0.4]])
    sizes, toxic, weight = np.array([4, 1, 0, 6]), np.array([True, False, True, False]), np.array([1.0, 0.5, 1.0, 2.0])
    x = rng.normal(size=11)
    by_x, by_moves, _ = toxicity.gradient(x, sizes, toxic, moves, weight)
    value = lambda x, m: toxicity.gradient(x, sizes, toxic, m, weight)[2]
    for i in range(11):
        d = np.eye(11)[i] * 1e-5
        assert by_x[i] == pytest.approx((value(x + d, moves) - value(x - d, moves)) / 2e-5, abs=1e-6)
    for i, j in product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = 1e-5
        assert by_moves[i, j] == pytest.approx((value(x, moves + d) - value(x, moves - d)) / 2e-5, abs=1e-6)


@pytest.fixture(scope="module")
def rows():
    d = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    labels = pq.read_table(f"{d}/labels.parquet").to_pylist()
    return [(r["doc_id"], docs[r["doc_id"]], r["toxic"]) for r in labels if docs.get(r["doc_id"]) and r["toxic"] is not None]


def test_held_out_documents_and_context(rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    crf = toxicity.fit([t for i, t, _ in rows if not held(i)], [y for i, _, y in rows if not held(i)])
    got = [(s >= toxicity.THRESHOLD, y) for (s, _), y in zip(crf.scores([t for i, t, _ in rows if held(i)]), [y for i, _, y in rows if held(i)], strict=True)]
    right = sum(a and b for a, b in got)
    # labels are noisy: about one in a hundred is wrong on either side
    assert right / sum(b for _, b in got) >= 0.9 and right / sum(a for a, _ in got) >= 0.9
    # potentials are the sums of the features' weights
    some = {c for _, t, _ in rows[:300] for c in t.split()}
    assert all(crf.potential(c) == pytest.approx(crf.bias + sum(crf.weights.get(f, 0.0) for f in toxicity.features(c))) for c in some)
    # what stands beside a token changes its marginals, and order does
    word = max((f[1:] for f in crf.weights if f[0] == "="), key=lambda w: crf.potential(w))
    x = crf.potentials([word, "the", "the", word, word])
    a = toxicity.chain(np.array(x), np.array([5]), crf.moves).p
    b = toxicity.chain(np.array([x[i] for i in (0, 3, 4, 1, 2)]), np.array([5]), crf.moves).p
    assert a[0] > 0.5 > a[1] and abs(a[0] - a[3]) > 1e-6 and abs(a[0] - b[0]) > 1e-6


def test_very_long_texts_repeated_rows_and_empty_tables(spark, rows):
    crf = toxicity.fit([t for _, t, _ in rows[:600]], [y for _, _, y in rows[:600]])
    word = max((f[1:] for f in crf.weights if f[0] == "="), key=lambda w: crf.potential(w))
    long = "a b c " * 200_000 + word
    df = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (2, None, None), (None, "", "z")], "doc_id long, text string, toxic_spans string")
    got = toxicity.score_toxicity(df, None, crf)
    assert got.columns == ["doc_id", "text", "toxic_score", "toxic_spans"]
    for r in got.collect():
        if r.text:
            assert r.toxic_spans.split(",")[-1] == f"{len(long) - len(word)}:{len(long)}"
        else:
            assert r.toxic_spans == "" and 0 <= r.toxic_score < 0.5
    assert toxicity.score_toxicity(df.where("false"), None, crf).collect() == []
