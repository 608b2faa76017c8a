import re
from collections import Counter

import numpy as np
import xxhash

from voltframe.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(items, linked):
    parent = {i: i for i in items}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(items)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if linked(items[a], items[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, key string")


def test_fingerprints_and_components_match_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, base.replace(f"w{7 * i} ", f"x{i} ")) for i in range(25)]
    rows += [(40, None), (41, ""), (42, " \n\t"), (43, "One Two"), (44, "one  two"), (45, "É é A a"), (46, "a b c d e"), (47, base), (48, base)]
    rows += [(60 + i, " ".join(f"q{(i * 37 + j * 11) % 89}" for j in range(40))) for i in range(30)]
    got = {r.doc_id: r for r in simhash.simhash_groups(docs_of(spark, [(a, b, "x", "y") for a, b in rows])).collect()}
    want = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in want.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(want, lambda a, b: (a ^ b).bit_count() <= 3)


def test_hot_buckets_give_the_same_components(spark):
    rng = np.random.default_rng(5)
    fps = {}
    for i in range(400):
        f = int(rng.integers(0, 4)) << 40
        for b in rng.integers(0, 64, size=int(rng.integers(0, 9))):
            f ^= 1 << int(b)
        fps[i] = f
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "doc_id long, fp long")
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    for hot in (1, 5, 2048):
        got = {r.fp % 2**64: r.component for r in simhash.hamming_components(df, hot=hot).collect()}
        assert {i: got[f] for i, f in fps.items()} == want, hot


def test_long_texts_and_repeats_and_no_rows(spark):
    long = "word " * 70000 + "end"
    got = simhash.simhash_groups(docs_of(spark, [(1, long, None, None), (1, long, None, None), (2, "z", None, None), (None, "z", None, None)])).collect()
    assert len(got) == 4 and Counter(r.component_id for r in got) == {1: 2, 2: 2}
    assert simhash.fingerprints([long], 3)[0, 0] == brute_fingerprint(long)
    assert simhash.simhash_groups(docs_of(spark, [])).collect() == []


def test_near_duplicates_keep_one_of_each_group_and_all_others(spark):
    rng = np.random.default_rng(2)
    text = lambda: [f"w{x}" for x in rng.integers(0, 100000, 300)]
    rows, groups = [], {}
    for g in range(12):
        base = text()
        for c in range(6):
            w = list(base)
            for at in rng.integers(0, 300, size=c):
                w[at] = f"y{rng.integers(0, 10**9)}"
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    for _ in range(40):
        groups[len(rows)] = 100 + len(rows)
        rows.append((len(rows), " ".join(text())))
    rows += [(1000, ""), (1001, None), (None, "a b")]
    got = {r.doc_id: r.keep for r in simhash.near_duplicates(docs_of(spark, [(a, b, "", "") for a, b in rows])).collect()}
    firsts = {min(i for i in groups if groups[i] == g) for g in groups.values()}
    assert {i for i, k in got.items() if k} == firsts | {1000}
    small, simhash.HOT = simhash.HOT, 4
    try:
        got = {r.doc_id: r.keep for r in simhash.near_duplicates(docs_of(spark, [(a, b, "", "") for a, b in rows])).collect()}
    finally:
        simhash.HOT = small
    assert {i for i, k in got.items() if k} == firsts | {1000}
