import re
from collections import defaultdict

import numpy as np
import pytest

from voltframe.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_are_shared_again_above_three_times_the_size():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    got = mixing.targets([10, 10, 580], [1, 2, 3])
    assert got == pytest.approx([30, 30, 540]) and sum(got) == pytest.approx(600)
    assert mixing.targets([0, 5], [1, 2]) == [0.0, 5.0] and mixing.targets([], []) == [] and mixing.targets([0], [1]) == [0.0]


def test_permutations_and_draws():
    for n in (1, 2, 3, 64, 1000, 4099):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, 5).tolist() != mixing.permuted(np.arange(1000), 1000, 6).tolist()
    due = [1000, 0, 37, 5000]
    got = mixing.draw(due, 500)
    sums, per = defaultdict(int), defaultdict(int)
    for shard, source, first, n in got:
        assert first == sums[source]
        sums[source] += n
        per[shard] += n
    assert [sums[i] for i in range(4)] == due and set(per.values()) <= {500, 37}
    assert got == mixing.draw(due, 500)


def rows_of():
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{i}-{j}" for j in range(int(r.integers(0, 900)))), f"s{i % 5}" if i % 7 else None) for i in range(80)]
    return [*rows, (90, None, "s1"), (91, "", "s2"), (92, "only\tone ", "Z"), (93, "x y", "é"), (3, rows[3][1], rows[3][2]), (None, "a b c", "s0")]


def test_mixture_meets_targets_and_reruns_agree(spark):
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, target int")
    got = mixing.mixture(df, block=16).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r["size"], r.taken)
    assert sorted(got, key=key) == sorted(mixing.mixture(df, block=16).collect(), key=key)
    assert len(got) == len(rows)
    size, by_size = defaultdict(int), defaultdict(list)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))]), strict=True))
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _ in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by_size[r.source_size, round(r.target, 6)].append(r)
        taken[r.source_size, round(r.target, 6)] += r.taken
    for s in names:
        assert abs(taken[size[s], round(goal[s], 6)] - goal[s]) <= 16 + 1e-6 or [size[x] for x in names].count(size[s]) > 1
    assert mixing.mixture(df.where("false")).collect() == []


def test_documents_of_the_mix_have_the_words_that_were_counted(spark):
    rows = [(a, b, "en", c, len(b or "")) for a, b, c in rows_of()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counted = sum(r.taken for r in mixing.mixture(df, block=16).collect())
    got = mixing.mixed_documents(df, block=16).collect()
    assert sum(len(WORD.findall(r.text)) for r in got) == counted
    whole = {r[0]: set(WORD.findall(r[1] or "")) for r in rows}
    assert all(set(WORD.findall(r.text)) <= whole[r.doc_id] and r.n_chars == len(r.text) for r in got)
    assert mixing.taken_texts("a  b\nc d", 2, [0, 1], [1, 3], 4) == ["a  b\nc d", "c d", "c d"]


def brute_mixture(rows, block):
    """Every word of every source one by one."""
    by = defaultdict(list)
    for n, (doc, text, source) in enumerate(rows):
        by[source].append((doc is not None, doc or 0, n, len(WORD.findall(text or ""))))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = [sum(x[-1] for x in by[s]) for s in names]
    goal = mixing.targets(size, [(1.0, 2.0, 3.0)[i % 3] for i in range(len(names))])
    blocks = [-(-s // block) for s in size]
    due = [min(3 * b, round(t * b / s)) if s else 0 for s, t, b in zip(size, goal, blocks, strict=True)]
    times = [[0] * b for b in blocks]
    for _, i, first, n in mixing.draw(due, max(mixing.SHARD_BLOCKS, 1)):
        for slot in range(first, first + n):
            turn, index = divmod(slot, blocks[i])
            times[i][mixing.permuted(np.array([index]), blocks[i], mixing.SEED + 7919 * i + turn)[0]] += 1
    out = []
    for i, s in enumerate(names):
        at = 0
        for _, _, n, words in sorted(by[s]):
            out.append((n, words, size[i], goal[i], sum(times[i][w // block] for w in range(at, at + words))))
            at += words
    return sorted(out)


def test_mixture_matches_a_plain_version(spark):
    rows = [r for r in rows_of() if r[0] is not None and (r[0] != 3 or r[1] != "")]
    rows = [(i * 10, t, s) for i, (_, t, s) in enumerate(rows)]  # one row for each doc_id: any order of equal ones is right
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mixture(df, block=16).collect()}
    for n, words, source_size, target, taken in brute_mixture(rows, 16):
        r = got[n * 10]
        assert (r["size"], r.source_size, r.taken) == (words, source_size, taken) and r.target == pytest.approx(target)


def test_many_sources_are_shared_quickly():
    import time

    rng = np.random.default_rng(8)
    size = (10 ** rng.uniform(0, 6, 100_000)).astype(int).tolist()
    began = time.time()
    got = mixing.targets(size, [(1.0, 2.0, 3.0)[i % 3] for i in range(len(size))])
    assert time.time() - began < 5 and sum(got) == pytest.approx(sum(size), rel=1e-9)
    assert all(g <= 3 * s + 1e-6 for g, s in zip(got, size, strict=True))


def test_equal_rows_share_what_is_taken(spark):
    rows = [(7, "a b c d e f g h", "en", "s", 15)] * 3 + [(None, "x y z w", "en", "s", 7)] * 2 + [(8, "", "en", "s", 0), (9, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counted = sum(r.taken for r in mixing.mixture(df, block=4).collect())
    got = mixing.mixed_documents(df, block=4)
    assert got.columns == df.columns and sum(len(WORD.findall(r.text)) for r in got.collect()) == counted == 32
    assert mixing.mixed_documents(df.where("false")).collect() == []
