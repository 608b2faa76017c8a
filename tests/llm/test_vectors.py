import numpy as np
import pytest

from tests.llm.test_simhash import brute_components
from voltframe.llm import vectors


def brute(rows):
    ok = {}
    for n, (_, x) in enumerate(rows):
        v = None if x is None or any(y is None for y in x) else np.array(x, dtype=float)
        if v is not None and len(v) and np.isfinite(v).all() and v.any():
            ok[n] = v / np.linalg.norm(v)
    linked = lambda a, b: len(a) == len(b) and a @ b >= 0.95
    return {n: sum(linked(v, w) for m, w in ok.items() if m != n) for n, v in ok.items()}, brute_components(ok, linked)


@pytest.mark.parametrize("block", [7, 1024])
def test_links_match_brute_force_on_clusters(spark, block):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        base = rng.normal(size=24)
        rows += [(len(rows) + i, (base + rng.normal(size=24) * 0.08).tolist()) for i in range(4 + 3 * g)]
    rows += [(500 + i, rng.normal(size=24).tolist()) for i in range(100)]
    rows += [(1000 + i, rows[3][1]) for i in range(5)]
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [1.0, None] * 12), (2003, [float("nan")] * 24), (2004, [float("inf")] * 24), (2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    df = spark.createDataFrame([(a, b, 9) for a, b in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.link_vectors(df, block=block).collect()}
    n, comp = brute(rows)
    assert len(got) == len(rows)
    want = sum(n.values())
    have = sum(r.n_links for r in got.values())
    assert have <= want and have >= 0.97 * want
    for k, (i, _) in enumerate(rows):
        assert got[i].n_links <= n.get(k, 0)
        assert got[i].component_id == (rows[comp[k]][0] if k in comp else i)
        assert got[i].kept == (got[i].component_id == i)


def test_repeated_and_missing_ids(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(7, v), (7, v), (None, v), (None, w), (None, None)], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, vectors.link_vectors(df).collect()), key=str)
    assert got == sorted([(7, 2, 7, True), (7, 2, 7, True), (None, 2, 7, False), (None, 0, None, False), (None, 0, None, False)], key=str)
    assert vectors.link_vectors(df.where("false")).collect() == []


def test_recall_on_the_table(spark):
    got = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = np.array([r.embedding for r in got.orderBy("vec_id").collect()], dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int(((u @ u.T) >= 0.95).sum()) - len(u)
    have = vectors.op5_vectors(spark, "/root/testdata/sf0.01").agg({"n_links": "sum"}).first()[0]
    assert have >= 0.9 * want


def planted(n, dim, seed=5):
    """Vectors in loose clusters, and for each of some a copy at a cosine from 0.95 up."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    base = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, dim)) * 1.5
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    some = u[: n // 2]
    g = rng.normal(size=some.shape)
    g -= (g * some).sum(1, keepdims=True) * some
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    c = np.repeat([0.951, 0.957, 0.965, 0.975, 0.99], -(-len(some) // 5))[: len(some), None]
    return np.concatenate([u, c * some + np.sqrt(1 - c * c) * g]), np.array(c[:, 0])


def test_recall_by_band_of_planted_copies(spark):
    x, c = planted(1500, 32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectors.link_vectors(df).collect()}
    close = x @ x.T >= 0.95
    want = close.sum(1) - 1
    assert all(got[i].n_links <= want[i] for i in range(len(x)))
    assert sum(r.n_links for r in got.values()) >= 0.95 * want.sum()
    for band in np.unique(c):
        own = 1500 + np.flatnonzero(c == band)
        assert sum(got[i].n_links for i in own.tolist()) >= 0.9 * want[own].sum() > 0
    assert all(got[i].component_id == min(got[j].component_id for j in np.flatnonzero(close[i]).tolist() if got[j].component_id == got[i].component_id) for i in range(0, len(x), 50))


def test_score_is_the_footrule_of_ranks():
    rng = np.random.default_rng(6)
    perm = np.array([rng.permutation(20)[: vectors.NEAREST] for _ in range(30)], dtype=np.int32)
    k = vectors.NEAREST
    got = vectors.score(perm, perm)
    for a in range(30):
        for b in range(30):
            rank = [{int(p): i for i, p in enumerate(perm[x])} for x in (a, b)]
            foot = sum(abs(rank[0].get(p, k) - rank[1].get(p, k)) for p in {*rank[0], *rank[1]})
            assert got[a, b] == k * (k + 1) - foot


def test_pivots_grow_with_the_vectors_within_their_bytes(monkeypatch):
    rng = np.random.default_rng(7)
    rows = [rng.normal(size=8).tobytes() for _ in range(300)]
    assert len(vectors.choose_pivots(rows, 120)[8]) > 60 and len(vectors.choose_pivots(rows, 40)[8]) == 40
