import numpy as np

from voltframe.llm import simhash


def kept(spark, rows):
    return {r.doc_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.keep}


def brute(rows, similarity=0.8):
    """Smallest numbers of the groups by comparing all pairs of shingle sets."""
    sets = [(i, set(simhash.shingle_hashes(t, 5).tolist())) for i, t in sorted(rows)]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if len(x & y) >= similarity * len(x | y) and top(a) != top(b):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i for i in root if root[i] == i}


def family(n, shared, own, start=0, tag="f"):
    """Texts of shared words that are the same and own ones, in one run each."""
    core = " ".join(f"{tag}{i}" for i in range(shared))
    return [(start + d, core + " " + " ".join(f"{tag}{d}x{i}" for i in range(own))) for d in range(n)]


def test_family_below_the_similarity_stays_whole(spark):
    rows = family(300, 244, 40)  # 240 shared shingles of 240 + 2 * 40: 0.75
    assert kept(spark, rows) == {i for i, _ in rows}


def with_copies(rows, every=1, words=4):
    """And copies of rows with some words changed in their own part, five shingles each."""
    out = list(rows)
    for i, t in rows[::every]:
        w = t.split()
        for k in range(words):
            w[-8 - 10 * k] = f"c{i}x{k}"
        out.append((1000 + i, " ".join(w)))
    return out


def test_buckets_are_compared_whole(spark, monkeypatch):
    for name, value in (("HOT", 4), ("LEADERS", 1), ("BUCKET", 16)):
        monkeypatch.setattr(simhash, name, value, raising=False)
    rows = with_copies(family(240, 210, 50))  # 0.67 and 0.86
    assert kept(spark, rows) == brute(rows) == set(range(240))


def test_pairs_within_a_template_are_all_found(spark):
    rows = with_copies(family(400, 210, 56), every=4)  # 0.65 and 0.86
    assert kept(spark, rows) == brute(rows) == set(range(400))


def test_every_pair_just_above_the_similarity_is_linked(spark):
    rows = []
    for n in range(200):  # 300 shingles, and the first 240 to 254 of them: 0.80 to 0.85; 239 stay apart
        w = [f"p{n}x{i}" for i in range(304)]
        rows += [(n, " ".join(w)), (1000 + n, " ".join(w[: 243 + n % 16]))]
    assert kept(spark, rows) == brute(rows) == set(range(200)) | {1000 + n for n in range(0, 200, 16)}


def test_random_edits_match_brute_force(spark):
    rng, rows = np.random.default_rng(11), []
    for n in range(300):
        w = rows[int(rng.integers(0, n))][1].split() if n and rng.random() < 0.8 else [f"v{x}" for x in rng.integers(0, 3000, int(rng.integers(5, 250)))]
        for at in rng.integers(0, len(w), int(rng.integers(0, 8))):
            w[at] = f"v{rng.integers(0, 3000)}"
        rows.append((n, " ".join(w[int(rng.integers(0, 10)) :] or w)))
    assert kept(spark, rows) == brute(rows)


def test_repeated_lines_count_once(spark):
    text, line = " ".join(f"w{i}" for i in range(300)), " ".join(f"r{i}" for i in range(12))
    rows = [(1, text + " " + line), (2, text + " " + " ".join([line] * 10))]
    assert kept(spark, rows) == brute(rows) == {1}




def test_table_matches_brute_force_with_all_and_no_crowds(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert {r.doc_id for r in simhash.near_duplicates(docs).collect() if r.keep} == want and len(want) < len(rows)
    monkeypatch.setattr(simhash, "CROWD", 0)  # every candidate of another group goes to the prefixes
    monkeypatch.setattr(simhash, "HOT_ROWS", 1)  # and so does every bucket of two
    assert {r.doc_id for r in simhash.near_duplicates(docs).collect() if r.keep} == want


def test_geometry_misses_few_pairs():
    for n in (0, 10_000, 10**7, 10**10):
        g = simhash.geometry(n)
        p = np.arccos(1.6 / 1.8) / np.pi
        meets = (1 - p) ** g.bits * (1 + g.bits * p / (1 - p))
        assert (1 - meets) ** g.segments <= simhash.MISS and g.width * 64 >= 64 * simhash.CHECK + g.bits * g.segments
        assert n / 2**g.bits <= simhash.ROWS
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (400, 900)).astype(np.uint64)
    other = base.copy()
    other[:, 800:] = rng.integers(0, 2**63, (400, 100)).astype(np.uint64)  # 800 of 1000 shared: 0.8
    g = simhash.geometry(0)
    x, y = (simhash.set_fingerprints(list(s), g.width) for s in (base, other))
    d = np.bitwise_count(x ^ y)
    assert (d[:, : simhash.CHECK].sum(1) <= g.check).mean() > 0.99 and (d.sum(1) <= g.full).mean() > 0.99
    near = np.zeros(400, dtype=bool)
    for s in range(g.segments):
        near |= np.bitwise_count(simhash.segment(x, s, g.bits) ^ simhash.segment(y, s, g.bits)) <= 1
    assert near.mean() > 0.99


def test_nulls_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, " \n", 3), (None, "a b c d e f", 4), (None, None, 5), (5, "a b c d e f", 6), (5, "a b c d e f", 7), (9, "A B C D E F", 8)], "doc_id long, text string, key int")
    got = sorted((r.doc_id, r.keep) for r in simhash.near_duplicates(df).collect())
    assert got == [(1, True), (2, False), (3, False), (5, True), (9, False)]
    assert simhash.near_duplicates(df.where("false")).collect() == []
