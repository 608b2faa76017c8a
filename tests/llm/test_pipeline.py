import corpus_pipeline
from voltframe.llm import bpe, pii, simhash, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near copies", "personal data", "mixing", "encoding"]
    f = dict(corpus_pipeline.STAGES)
    first = f["toxicity"](spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("toxic_score >= 0.7").collect()}
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect()} - bad and bad
    second = f["near copies"](spark, first, SF).cache()
    kept = {r.doc_id: r.text for r in second.collect()}
    everything = {r.doc_id: r.text for r in first.collect()}
    assert set(kept) < set(everything) and len(set(kept.values())) == len(kept)

    def shingles(t):
        return set(simhash.shingle_hashes(t, 5).tolist())

    # whatever is gone has a near copy of a smaller number; whoever stays has none that is nearly the same
    sets = {i: shingles(t) for i, t in everything.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    ids = sorted(everything)
    for i in ids:
        best = max((alike(i, j) for j in ids if j != i), default=0)
        if i not in kept:
            assert best > 0.7
        elif best >= 0.9:
            assert all(j > i or j not in kept for j in ids if j != i and alike(i, j) >= 0.9)
    third = f["personal data"](spark, second, SF).cache()
    assert all(r.text == pii.redact(kept[r.doc_id], pii.find(kept[r.doc_id])) and r.n_chars == len(r.text) for r in third.collect())
    fourth = f["mixing"](spark, third, SF).cache()
    assert fourth.columns == docs.columns
    last = f["encoding"](spark, fourth, SF).collect()
    coder = bpe.tokenizer(bpe.default_path())
    assert len(last) == fourth.count() and all(r.bpe_ids == coder.encode(r.text) and r.n_tokens == len(r.bpe_ids) for r in last[:200])


def test_run_is_all_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "text", "bpe_ids", "bpe_decoded", "n_tokens"} <= set(got.columns)


def test_stages_bear_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], schema)
    for docs in (odd, odd.where("false")):
        for _, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, SF)
        assert docs.count() <= 3
