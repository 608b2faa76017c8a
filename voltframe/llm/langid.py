"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1. One linear classifier on hashed character bigrams and trigrams
predicts each bit. A text gets the language whose codeword is nearest when every bit's disagreement is
weighted by its logistic loss; texts whose two nearest codewords are close are flagged as ambiguous.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import for_python, table

#: The model is fitted to at most ROWS labelled rows, EACH at most of a language and one at least, none longer than
#: LONGEST characters. (So it knows ROWS languages at most, the most frequent ones.)
ROWS, EACH, LONGEST = 4000, 1000, 20_000
#: Texts that are classified side by side.
SIDE = 128
DIMENSIONS = 1 << 13
#: Texts whose best language has less than this lead in probability are ambiguous.
LEAD = 0.2
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII signs, digits and controls count as space.
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)


def ngrams(text: str) -> np.ndarray:
    """Shares of hashed bigrams and trigrams of the lower-cased text, as square roots."""
    out = np.zeros(DIMENSIONS)
    lowered = f" {text.lower()} "
    for at in range(0, len(lowered), 1 << 20):  # blocks overlap by two characters
        c = np.frombuffer(lowered[at : at + (1 << 20) + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        low = c < 128
        c[low] = _FOLD[c[low]]
        c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
        two = c[:-1] * np.uint32(2654435761) + c[1:] * np.uint32(40503)
        three = two[:-1] * np.uint32(31) + c[2:] * np.uint32(2246822519)
        for h in (two, three):
            out += np.bincount((h ^ (h >> np.uint32(15))) >> np.uint32(3) & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
    return np.sqrt(out / max(out.sum(), 1.0))


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1: all splits of up to seven languages; random ones, far apart, of more."""
    if n <= 7:
        splits = [[1, *(1 if s >> i & 1 else -1 for i in range(n - 1))] for s in range(2 ** (n - 1) - 1)] if n > 1 else [[1]]
        return np.array(splits, dtype=float).T
    rng, best, gap = np.random.default_rng(3), None, -1
    for _ in range(60 if n <= 400 else 5):
        code = rng.choice([-1.0, 1.0], size=(n, int(10 * np.ceil(np.log2(n)))))
        apart = code.shape[1] - (code @ code.T)
        np.fill_diagonal(apart, np.inf)
        if apart.min() > gap:
            best, gap = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    level: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, probability, ambiguous) of each text."""
        out = [(UNDETERMINED, 0.0, True)] * len(texts)
        if not self.languages:
            return out
        all_ = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        for at in range(0, len(all_), SIDE):
            some = all_[at : at + SIDE]
            loss = self.losses(np.stack([ngrams(texts[i]) for i in some]) @ self.weights + self.level)
            p = np.exp(loss.min(1, keepdims=True) - loss)
            p /= p.sum(1, keepdims=True)
            for i, row in zip(some, p, strict=True):
                best = int(row.argmax())
                second = float(np.delete(row, best).max()) if len(row) > 1 else 0.0
                out[i] = self.languages[best], float(row[best]), bool(row[best] - second < LEAD)
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """For each text (its bits' margins) and language the logistic losses of the bits of the language's codeword, summed up."""
        plus = (self.code > 0).astype(float).T
        return np.logaddexp(0, -margins) @ plus + np.logaddexp(0, margins) @ (1 - plus)


def fit(texts: list[str], languages: list[str], rounds: int = 200) -> Model:
    """One logistic classifier for each bit of the code, all trained side by side (Nesterov steps)."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((0, 1)), np.zeros((DIMENSIONS, 1)), np.zeros(1))
    code = codewords(len(names))
    number = {x: i for i, x in enumerate(names)}
    y = code[[number[x] for x in languages]]
    x = np.empty((len(texts), DIMENSIONS), dtype=np.float32)  # at most ROWS x DIMENSIONS x 4 bytes
    for i, t in enumerate(texts):
        x[i] = ngrams(t)
    each = 1.0 / np.bincount([number[x] for x in languages])[[number[x] for x in languages]] / len(names)
    w, level = np.zeros((DIMENSIONS, code.shape[1])), np.zeros(code.shape[1])
    ahead, before = w.copy(), w.copy()
    for n in range(rounds):
        m = x @ ahead.astype(np.float32) + level
        g = -(y / (1 + np.exp(np.clip(y * m, -30, 30)))) * each[:, None]
        w = ahead - 8.0 * (x.T @ g.astype(np.float32) + 1e-6 * ahead)
        level = level - 2.0 * g.sum(0)
        ahead = w + n / (n + 3) * (w - before)
        before = w
    return Model(names, code, w, level)


def sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Bounded training rows: crc32(doc_id as text) mod 4 is not 2, lang known, picked by a hash of doc_id."""
    rows = docs.where("doc_id is not null and lang is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    rows = rows.where((F.length("text") <= LONGEST) & F.col("text").rlike(r"\p{L}"))
    top = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(ROWS).collect()
    if not top:
        return [], []
    each = min(EACH, max(1, ROWS // len(top)))
    # the rows of least hashes of each language; what lies below a bound holds them, about twice as many as are needed
    bounds = [(r.lang, 2**63 - 1 if r["count"] <= 4 * each else -(2**63) + int(2**64 * (2 * each + 20) / r["count"])) for r in top]
    below = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, most long")), "lang").where("h <= most")
    near: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in below.select("lang", "h", "doc_id").collect():
        near[r.lang].append((r.h, r.doc_id))
    picked = {i for x in near.values() for _, i in sorted(x)[:each]}
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(picked)], "doc_id long")
    got = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "lang").collect()
    got.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    return [r.text for r in got], [r.lang for r in got]


def identify_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with lang_pred (string), lang_score (double) and lang_ambiguous (boolean), one row for each row.

    Whole texts are used, and nothing else of a row. Null texts and texts without a letter are `und` with
    score 0; so are all texts where no labelled row was there to learn from. Repeated rows and further
    columns pass through; columns that already have the three names are replaced.
    """
    for_python(docs.sparkSession)
    model = model or fit(*sample(docs))
    docs = docs.drop("lang_pred", "lang_score", "lang_ambiguous")
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, lang_score double, lang_ambiguous boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.predict(b.column(b.schema.get_field_index("text")).to_pylist())
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "lang_pred", "lang_score", "lang_ambiguous"])

    return docs.mapInArrow(run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify_language() of all documents, learnt from those that are not held out; null doc_ids are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify_language(docs.select("doc_id", "text"), fit(*sample(docs)))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
