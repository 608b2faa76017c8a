import random
import re

from voltframe.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def base(text):
    return [x for x in pii.find(text) if x[2] in pii.BASE]


def test_base_spans_match_the_patterns():
    r = random.Random(4)
    for alphabet in ("1234567890123456789 -.@+()aé.", "ab.@-+1 ", "0123456789 -"):
        for _ in range(8000):
            t = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
            assert base(t) == brute(t), t
    for t in (None, "", "4111 1111 1111 1111", "a@b.c@d.e", "256.1.1.1 1.2.3.4.5.6.7.8", "😀 x@y.zz +1 (234) 555-7890", "@" * 5000, "1" * 40000):
        assert base(t) == brute(t)


def test_further_kinds_and_redaction():
    t = 'see https://a.example/x?y=1, token = "04dbebab91ab8568" and IBAN: DE89 3704 0044 0532 0130 00.'
    assert [(k, t[a:b]) for a, b, k in pii.find(t)] == [("url", "https://a.example/x?y=1"), ("secret", "04dbebab91ab8568"), ("iban", "DE89 3704 0044 0532 0130 00")]
    assert pii.redact(t, pii.find(t)) == 'see [URL], token = "[SECRET]" and IBAN: [IBAN].'
    assert pii.redact(None, []) is None


def test_query_and_operator(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in pii.op7_pii(spark, "/root/testdata/sf0.001").collect():
        want = brute(rows[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[2] for x in want) for k in pii.BASE]
        assert r.base_sha256 == pii.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in want).encode()).hexdigest()
    df = spark.createDataFrame([(1, "a@b.cd", 5), (None, None, 6), (1, "a@b.cd", 5)], "doc_id long, text string, pii int")
    got = pii.find_pii(df).collect()
    assert [(r.doc_id, r.redacted, len(r.pii)) for r in got] == [(1, "[EMAIL]", 1), (None, None, 0), (1, "[EMAIL]", 1)]
    assert pii.find_pii(df.where("false")).collect() == []


def test_digests_of_odd_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a@b.co", 1), (1, "a@b.co", 1), (None, None, 2), (2, "", 3), (3, "x " * 300_000 + "1.2.3.4", 4)], "doc_id long, text string, n_ip int")
    got = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.spans) for r in pii.pii_digests(df).collect())
    assert got == [(0, 0, 0, ""), (1, 1, 0, "email:0:6"), (1, 1, 0, "email:0:6"), (2, 0, 0, ""), (3, 0, 1, "ip:600000:600007")]
    assert pii.pii_digests(df.where("false")).collect() == []
