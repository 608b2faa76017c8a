from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer

from voltframe.llm import bpe

ODD = ["", " ", "Hello's it's they'LL I'd", "İstanbul ΣΑΣ Σ", "a\x1cb\x1d c\x85d\xa0e f​g", "x<|endoftext|>y <|STARTOFTEXT|><|startoftext|>z", "ﬁ é é ½²٣ Ⅷ ª", "😀😀 zz" * 3, "a" * 700, "ab" * 999 + " 123456.7", "!!!???", "¨ ̈ x", "क्षि", "ᾳ ᾼ ǅ ẞ", "日本語テスト", "_a_b__c 1_2", "\x00\x01", None]


@pytest.fixture(scope="module")
def pair():
    path = bpe.default_path()
    return bpe.Bpe(path, cache=50), Tokenizer.from_file(path)


def test_same_as_the_library_on_odd_texts(pair):
    mine, lib = pair
    for t in ODD:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert mine.encode(t) == want, ascii(t)
        assert mine.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_long_words_merge_alike(pair):
    mine, _ = pair
    rng = np.random.default_rng(0)
    for _ in range(20):
        raw = rng.choice([97, 98, 101, 104, 116], size=150).astype(np.uint8).tobytes()
        s = [*mine.first[list(raw[:-1])].tolist(), int(mine.last[raw[-1]])]
        got = mine.merge(np.array([s]))[0]
        assert got[got >= 0].tolist() == mine.merge_long(s)


def test_query_matches_the_library(spark, pair):
    _, lib = pair
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = bpe.op2_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = lib.encode(rows[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_operator_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "z")], "doc_id long, text string, bpe_ids string")
    got = bpe.bpe_encode(df).collect()
    assert sorted([(r.doc_id is None, r.bpe_decoded, len(r.bpe_ids)) for r in got]) == [(False, "", 0), (False, "a</w> b</w>", 2), (False, "a</w> b</w>", 2), (True, "", 0)]
    assert bpe.bpe_encode(df.where("false")).collect() == []


def test_special_tokens_survive_turns_of_the_cache(spark):
    path = bpe.default_path()
    lib = Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    texts = [" ".join([f"w{rng.integers(0, 40)}" for _ in range(12)] + ["<|endoftext|>", "<|endoftext|>y", "x<|startoftext|>"][n % 3 :]) for n in range(60)]
    for cache in (3, 20):
        mine = bpe.Bpe(path, cache=cache)
        for at in range(0, 60, 20):
            got = mine.encode_all(texts[at : at + 20])
            assert [np.frombuffer(x, dtype=np.uint32).tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts[at : at + 20]]


def test_digests_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (None, None, 1), (2, "", 2), (3, "word " * 60_000, 3)], "doc_id long, text string, n_tokens int")
    got = sorted([(r.doc_id or 0, r.n_tokens) for r in bpe.bpe_digests(df).collect()])
    assert got == [(0, 0), (1, 2), (1, 2), (2, 0), (3, 60_000)]
    assert bpe.bpe_digests(df.where("false")).collect() == []
