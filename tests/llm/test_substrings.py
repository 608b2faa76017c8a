import re
from collections import Counter

import pytest

from voltframe.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def rows_of(seed):
    import random

    r = random.Random(seed)
    passage = [" ".join(f"p{k}-{i}" for i in range(60)) for k in range(3)]
    loop = " ".join(["la", "li"] * 60)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            k = r.randrange(5)
            if k < 3:
                p = passage[k].split()
                a = r.randrange(0, 20)
                parts.append("  ".join(p[a : r.randrange(a + 20, 60)]))
            else:
                parts.append("\n".join(f"u{r.randrange(50)}" for _ in range(r.randrange(3, 60))))
        rows.append((i, " ".join(parts)))
    return [*rows, (90, loop), (91, None), (92, ""), (93, "é x \x0b b"), (94, passage[0]), (94, passage[0]), (95, passage[1]), (95, "other"), (None, passage[2]), (None, None)]


@pytest.mark.parametrize("hot", [1, 3, 2000])
def test_windows_match_brute_force(spark, hot):
    rows = rows_of(hot)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, h int")
    got = sorted([tuple(r) for r in substrings.remove_repeats(df, hot=hot).collect()], key=str)
    assert got == brute(rows, 35)


def test_long_texts_are_cut_into_pieces_without_a_trace(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 50)
    monkeypatch.setattr(substrings, "BLOCK", 3000)
    rows = rows_of(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for _, s in substrings.super_kmers([t for _, t in rows]):
        found += list(zip(s["row"].tolist(), s["first"].tolist(), s["windows"].tolist(), strict=True))
    windows = {(r, f + i) for r, f, n in found for i in range(n)}
    assert windows == {(k, i) for k, (_, t) in enumerate(rows) for i in range(len(WORD.findall(t or "")) - 34)}
    assert substrings.remove_repeats(df.where("false")).collect() == []
