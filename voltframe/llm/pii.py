"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes and identifier cues) in a
single pass over a text. At each anchor a deterministic parser expands to both sides as far as the kind's
alphabet reaches, and validates what it has: number parts, check digits, lengths. Anchors inside a stretch
that its kind has already expanded are passed over, so the work is linear in the text.

Base kinds, with fixed patterns (leftmost, without overlap within a kind; what fails is dropped, not retried):
    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), every part at most 255
    card   [0-9]([\\x20-]?[0-9])+, 14 to 19 digits that pass Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 10 to 15 digits
Further kinds, from schemes and cues: url, iban (mod 97), account (digits after a cue), secret (a value after
token, password, key and the like).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import for_python, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "secret")
_ORDER = {k: n for n, k in enumerate(KINDS)}
#: Cues (fixed values); each is sought in lower case, upper case and with a capital.
SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = {"iban": ("iban",), "account": ("account", "acct", "konto", "ssn", "passport"), "secret": ("token", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "secret", "access_key")}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_RUN, _IP = re.compile(r"[0-9.]+"), re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD_RUN, _CARD = re.compile(r"[0-9\x20-]+"), re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?:[A-Za-z]+://|[Ww]{3}\.)[^\s<>\"'`(){}\[\]|]+")
_IBAN = re.compile(r"[\s:#=.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\s?(?:no|nr|number|id)\b\.?)?[\s:#=.]{0,4}([0-9][0-9-]{4,20}[0-9])(?![0-9])", re.IGNORECASE)
_SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}(\"[^\"\s]{8,}\"|'[^'\s]{8,}'|[A-Za-z0-9_./+=~-]{8,})")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for kind, words in {"url": SCHEMES, **CUES}.items():
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive. Null and empty: none."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    email = ip = card = url = secret = account = 0  # how far each kind has come
    for at, (kind, size) in _anchors().iter(text):
        if kind == "digit":
            if at >= ip:
                ip = _IP_RUN.match(text, at).end()
                if ip - at >= 7:
                    for m in _IP.finditer(text, at, ip):
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                            out.append((m.start(), m.end(), "ip"))
            if at >= card:
                card = _CARD_RUN.match(text, at).end()
                if card - at >= 14:
                    for m in _CARD.finditer(text, at, card):
                        if m.end() - m.start() >= 14:
                            digits = m[0].replace(" ", "").replace("-", "")
                            if 14 <= len(digits) <= 19 and luhn(digits):
                                out.append((m.start(), m.end(), "card"))
        elif kind == "email":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append((start, email, "email"))
        elif kind == "phone":
            if (m := _PHONE.match(text, at)) and 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((at, m.end(), "phone"))
        elif kind == "url":
            start = at + 1 - size
            if start >= url and (m := _URL.match(text, start)):
                said = m[0].rstrip(".,;:!?*#%$&")
                url = m.end()
                if "." in said.split("//")[-1].strip("."):
                    out.append((start, start + len(said), "url"))
        elif at + 1 >= secret and kind == "secret":
            if m := _SECRET.match(text, at + 1):
                secret = m.end()
                quoted = m[1][0] in "\"'"
                out.append((m.start(1) + quoted, m.end(1) - quoted, "secret"))
        elif at + 1 >= account and kind in ("iban", "account"):
            m = (_IBAN if kind == "iban" else _ACCOUNT).match(text, at + 1)
            if m and (kind == "account" or _mod97(m[1])):
                account = m.end()
                out.append((m.start(1), m.end(1), kind))
    out.sort(key=lambda x: (x[0], _ORDER[x[2]]))
    return out


def _mod97(said: str) -> bool:
    s = said.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not spans:
        return text
    out, done, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii (array of struct start, end, kind) and redacted (string), one row for each row.

    Null texts: no spans, redacted null; empty: no spans, empty. Repeated rows and further columns pass
    through; columns that already have the two names are replaced. Narrow: no shuffle.
    """
    for_python(docs.sparkSession)
    docs = docs.drop("pii", "redacted")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema), "pii array<struct<start:bigint,end:bigint,kind:string>>", "redacted string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            found = [find(t) for t in texts]
            spans = pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, spans, pa.array([redact(t, x) for t, x in zip(texts, found, strict=True)], pa.string())], [*b.schema.names, "pii", "redacted"])

    return docs.mapInArrow(run, schema)


def _said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{k}:{s}:{e}" for s, e, k in spans])


def pii_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of whole texts, one row for each row of docs (doc_id, text).

    Null and empty texts have no spans: counts of 0, the digest of nothing, an empty string. Repeated rows and rows that
    share a doc_id or have none are each answered; an empty table gives no rows; further columns are not looked at.
    """
    for_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t) for t in b.column(1).to_pylist()]
            base = [[s for s in x if s[2] in BASE] for x in found]
            counts = [pa.array([sum(s[2] == k for s in x) for x in base], pa.int64()) for k in BASE]
            digest = pa.array([sha256(_said(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([_said(x) for x in found], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pii_digests() of all documents; nulls, ties and empty tables as there."""
    return pii_digests(table(spark, sf_dir, "documents", "doc_id", "text"))
