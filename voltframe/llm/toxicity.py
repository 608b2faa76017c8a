"""Toxic spans and documents by a linear-chain conditional random field.

Labels mark whole documents, so the labels of tokens are latent. A chain with the two states clean and toxic runs
over all tokens; a token's potential is the sum of the weights of its features (the word, its beginnings and ends,
its shape), and moves between the states have weights too. The model is fitted to the likelihood of the documents'
labels: of a clean one that all tokens are clean, of a toxic one that one at least is not, with some noise in the
labels. Its gradient is that of marginals given the label less free ones, from forward-backward sums. A document's
score comes from its marginals: the expected number of toxic tokens, the probability that there is any, and their
share, put through a logistic curve that is fitted to the labels.

Forward and backward sums are ratios of the two states. All tokens of many documents are one sequence that is cut
into equal stretches, which run side by side: first as products of matrices, then, from where each begins, as ratios.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import for_python, table, trimmed

#: The model is fitted to at most so many labelled rows of each kind, none of them longer than LONGEST characters.
TOXIC_ROWS, CLEAN_ROWS, LONGEST = 3000, 5000, 20_000
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (3, 5)
#: A feature is known if it occurs in so many toxic documents, copies counted once.
LEAST = 3
#: Probability of a wrong label; weight of the penalties on features and on moves.
NOISE, PENALTY, STILL = 0.02, 0.05, 5.0
#: Share of a toxic document's tokens that say nothing in a round of training, so that others than the plainest are learnt.
MUTED = 0.3
THRESHOLD = 0.7
#: Chunks of text whose potential a worker keeps; tokens that run side by side; tokens of a stretch.
KEPT, SIDE, STRETCH = 300_000, 1 << 18, 256

_CHUNK = re.compile(r"\S+")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha()) + "«»“”‘’„…–—·¡¿"


def token(chunk: str) -> str:
    """What stands between white space, in lower case, without signs and digits at its ends."""
    return chunk.lower().strip(_EDGES)


def features(chunk: str) -> list[str]:
    """The word, beginnings and ends of it, and whether it is in capitals or has other signs inside."""
    tok = token(chunk)
    if not tok:
        return ["#"]
    out = [f"={tok}", *(tok[:n] for n in PREFIXES if len(tok) > n), *(f"-{tok[-n:]}" for n in SUFFIXES if len(tok) > n)]
    if len(tok) > 1 and chunk.isupper():
        out.append("#A")
    if not tok.isalpha():
        out.append("#+")
    return out


def _stretches(step: np.ndarray, first: np.ndarray, m: np.ndarray, begin: float) -> np.ndarray:
    """The ratios r of a chain: r = step * begin where first, else step * (m01 + m11 r') / (m00 + m10 r') from the r' before."""
    n = len(step)
    size = min(STRETCH, max(1, n))
    count = -(-n // size)
    fill = count * size - n
    e = np.concatenate([step, np.ones(fill)]).reshape(count, size).T.copy()
    new = np.concatenate([first, np.ones(fill, dtype=bool)]).reshape(count, size).T.copy()
    # products of the stretches' matrices: (v0, v1) goes to (v0 m00 + v1 m10, (v0 m01 + v1 m11) * step)
    a, b, c, d = np.ones(count), np.zeros(count), np.zeros(count), np.ones(count)
    some = new.any(1)
    for j in range(size):
        a, b = a * m[0, 0] + b * m[1, 0], (a * m[0, 1] + b * m[1, 1]) * e[j]
        c, d = c * m[0, 0] + d * m[1, 0], (c * m[0, 1] + d * m[1, 1]) * e[j]
        if some[j]:
            at = new[j]
            a[at] = c[at] = 1.0
            b[at] = d[at] = e[j, at] * begin
        if j % 4 == 3:
            s = a + b + c + d
            a, b, c, d = a / s, b / s, c / s, d / s
    r, into = 0.0, np.empty(count)
    for i, (a_, b_, c_, d_) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        into[i] = r
        r = (b_ + r * d_) / (a_ + r * c_)
    out = np.empty_like(e)
    r = into
    for j in range(size):
        r = e[j] * (m[0, 1] + m[1, 1] * r) / (m[0, 0] + m[1, 0] * r)
        if some[j]:
            r = np.where(new[j], e[j] * begin, r)
        out[j] = r
    return out.T.ravel()[:n]


@dataclass
class Sums:
    """Of documents one after the other: ratios of forward and backward sums, and what follows from them."""

    p: np.ndarray  # probability of toxic, for each token
    clean: np.ndarray  # log-probability that no token is toxic, for each document
    ahead: np.ndarray
    after: np.ndarray


def chain(x: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> Sums:
    """x are the potentials of toxic of all tokens; documents of sizes[i] tokens begin as if after a clean token."""
    m = np.exp(moves)
    step = np.exp(np.clip(x, -30.0, 30.0))
    first, last = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
    some = sizes > 0
    ends = np.cumsum(sizes)
    first[(ends - sizes)[some]] = True
    last[ends[some] - 1] = True
    ahead = _stretches(step, first, m, m[0, 1] / m[0, 0])
    after = _stretches(step[::-1], last[::-1], m.T, 1.0)[::-1]  # backward ratios times step
    odds = ahead * after / step
    stay = -np.log1p(m[0, 1] / m[0, 0] * after)
    total = np.r_[0.0, np.cumsum(stay)]
    return Sums(odds / (1 + odds), np.minimum(total[ends] - total[ends - sizes], 0.0), ahead, after)


@dataclass
class Crf:
    """Weights of features, the bias of toxic, and moves; and the curve from a document's sums to its score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(3))
    scale: np.ndarray = field(default_factory=lambda: np.ones(3))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))
    level: float = -2.0

    def __post_init__(self) -> None:
        self.cache: dict[str, float] = {}  # of chunks
        self.words: dict[str, float] = {}  # of tokens

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "words": {}}

    def prepare(self) -> None:
        self.cache.clear(), self.words.clear()

    def potential(self, chunk: str) -> float:
        """Bias and weights of features(chunk). A longer beginning or end is known only if the shorter ones are, as it is rarer."""
        tok, get = token(chunk), self.weights.get
        if (x := self.words.get(tok)) is None:
            x = self.bias + (get("#", 0.0) if not tok else 0.0 if tok.isalpha() else get("#+", 0.0))
            known = bool(tok)
            for n in PREFIXES:
                if len(tok) <= n or (v := get(tok[:n])) is None:
                    known &= len(tok) <= n
                    break
                x += v
            if known:
                x += get(f"={tok}", 0.0)
            for n in SUFFIXES:
                if len(tok) <= n or (v := get(f"-{tok[-n:]}")) is None:
                    break
                x += v
            if len(self.words) > KEPT:
                self.words.clear()
            self.words[tok] = x
        return x + get("#A", 0.0) if len(tok) > 1 and chunk.isupper() else x

    def potentials(self, chunks: list[str]) -> list[float]:
        cache = self.cache
        if len(cache) > KEPT:
            cache.clear()
        try:
            return [cache[c] for c in chunks]
        except KeyError:
            for c in set(chunks).difference(cache):
                cache[c] = self.potential(c)
            return [cache[c] for c in chunks]

    def marginals(self, n: int, at: list[int], extra: list[float]) -> tuple[np.ndarray, float]:
        """Probabilities of toxic at the given places of n tokens, which add extra to the bias; and the log-probability that none is toxic."""
        x = np.full(n, self.bias)
        np.add.at(x, at, extra)
        s = chain(x, np.array([n]), self.moves)
        return s.p[at], float(s.clean[0])

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        """For each text its score, and (start, end, probability) of chunks more likely toxic than not, in code points."""
        held: list[list[float]] = []
        at = size = 0
        for i, t in enumerate(texts):
            held.append(self.potentials(t.split()) if t else [])
            size += len(held[-1])
            if size >= SIDE or i == len(texts) - 1:
                yield from self._scored(texts[at : i + 1], held)
                held, at, size = [], i + 1, 0

    def _scored(self, texts: list[str | None], held: list[list[float]]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        sizes = np.array([len(x) for x in held])
        s = chain(np.array([v for x in held for v in x]), sizes, self.moves)
        score = self.curved(sums(s, sizes))
        hot, ends = np.flatnonzero(s.p > 0.5), np.cumsum(sizes)
        per = np.searchsorted(hot, np.r_[0, ends])
        for i, t in enumerate(texts):
            spans: list[tuple[int, int, float]] = []
            if per[i] < per[i + 1]:
                where = {int(k - (ends[i] - sizes[i])): float(s.p[k]) for k in hot[per[i] : per[i + 1]]}
                place = 0
                for j, c in enumerate(t.split()):
                    place = t.index(c, place)
                    if j in where:
                        inner = c.strip(_EDGES) or c
                        a = place + c.index(inner)
                        spans.append((a, a + len(inner), where[j]))
                    place += len(c)
            yield float(score[i]), spans

    def curved(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.curve + self.level, -30, 30)))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        return next(self.scores([text]))


def sums(s: Sums, sizes: np.ndarray) -> np.ndarray:
    """Of each document: expected toxic tokens, the probability of any, and the share, as logarithms."""
    total, ends = np.r_[0.0, np.cumsum(s.p)], np.cumsum(sizes)
    expected = np.maximum(total[ends] - total[ends - sizes], 0.0)
    return np.stack([np.log(1e-4 + expected), np.log(1e-4 - np.expm1(s.clean)), np.log(1e-5 + expected / np.maximum(sizes, 1))], axis=1)


def gradient(x: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, moves: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the log-likelihood of the documents' labels: by the tokens' potentials, by the moves; and the likelihood."""
    s = chain(x, sizes, moves)
    none, some = np.exp(s.clean), -np.expm1(s.clean)
    right = np.where(toxic, (1 - NOISE) * some + NOISE * none, (1 - NOISE) * none + NOISE * some)
    pull = np.where(toxic, 1.0, -1.0) * (1 - 2 * NOISE) * none / right * weight
    each = np.repeat(pull, sizes)
    m = np.exp(moves)
    first = np.zeros(len(x), dtype=bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    before = np.where(first, 0.0, np.r_[0.0, s.ahead[:-1]])
    pairs = np.stack([np.full(len(x), m[0, 0]), m[0, 1] * s.after, before * m[1, 0], before * m[1, 1] * s.after])
    pairs /= pairs.sum(0)
    pairs[0] -= 1.0  # less those of the path without a toxic token
    return each * s.p, (pairs * each).sum(1).reshape(2, 2), float((np.log(right) * weight).sum())


def groups(sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Documents in order, some at a time: about most tokens each."""
    part = (np.cumsum(sizes) - sizes) // most
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1) if len(sizes) else []


def fit(texts: list[str], toxic: list[int], rounds: int = 60) -> Crf:
    """A model for labelled texts. Without texts of both kinds every score is the share of toxic ones (0.1 without any text).

    Texts are held as numbers of their chunks; sums over tokens are made for some documents at a time.
    """
    y = np.array(toxic, dtype=bool)
    crf = Crf()
    if not len(y) or y.all() or not y.any():
        share = float(y.mean()) if len(y) else 0.1
        crf.level = float(np.log((share + 0.01) / (1.01 - share)))
        return crf
    number: dict[str, int] = {}
    ids, firsts = [], {}
    for i, t in enumerate(texts):
        d = t.split()
        ids.append(np.array([number.setdefault(c, len(number)) for c in d], dtype=np.int32))
        # copies of a document count once: documents are known by the least hash of their three-word shingles
        h = min((xxhash.xxh32_intdigest(" ".join(d[j : j + 3]), 7) for j in range(max(1, len(d) - 2))), default=0)
        firsts.setdefault(h * 2 + int(y[i]), i)
    once = sorted(firsts.values())
    chunks = [*number]
    in_toxic: Counter = Counter()
    for i in once:
        if y[i]:
            in_toxic.update({f for k in np.unique(ids[i]).tolist() for f in features(chunks[k])})
    names = {f: n for n, f in enumerate(f for f, k in in_toxic.items() if k >= LEAST)}
    del in_toxic
    feature_of, size_of = array("i"), array("i")
    for c in chunks:
        own = [names[f] for f in features(c) if f in names]
        feature_of.extend(own)
        size_of.append(len(own))
    feature_of, size_of = np.array(feature_of, dtype=np.int32), np.array(size_of, dtype=np.int32)
    chunk_of = np.repeat(np.arange(len(chunks), dtype=np.int32), size_of)
    starts = np.cumsum(size_of) - size_of
    times = np.zeros((2, len(names)))
    for i in once:
        u = np.unique(ids[i])
        at = np.repeat(starts[u] - (np.cumsum(size_of[u]) - size_of[u]), size_of[u]) + np.arange(size_of[u].sum())
        times[int(y[i])][np.unique(feature_of[at])] += 1
    once = np.array(once)
    n_bad, n_good = int(y[once].sum()), int((~y[once]).sum())
    odds = np.log((times[1] + 0.5) / (n_bad + 1)) - np.log((times[0] + 0.5) / (n_good + 1))
    w, bias, moves = np.clip(odds, -1.0, 3.0) * 0.5, -6.0, np.array([[0.5, -0.5], [0.0, 0.0]])
    batches = [once[g] for g in groups(np.array([len(ids[i]) for i in once]), SIDE)]
    rng = np.random.default_rng(11)
    state = [np.zeros(len(w) + 5), np.zeros(len(w) + 5)]
    for r in range(1, rounds + 1):  # Adam on the penalised likelihood
        u = bias + np.bincount(chunk_of, w[feature_of], minlength=len(chunks))
        by_chunk, by_bias, by_moves = np.zeros(len(chunks)), 0.0, -STILL * moves
        for some in batches:
            flat, sizes = np.concatenate([ids[i] for i in some]), np.array([len(ids[i]) for i in some])
            x, mute = u[flat], np.repeat(y[some], sizes) & (rng.random(len(flat)) < MUTED)
            x[mute] = -20.0
            by_token, more, _ = gradient(x, sizes, y[some], moves, np.where(y[some], (n_good / max(1, n_bad)) ** 0.5, 1.0))
            by_token[mute] = 0.0
            by_chunk += np.bincount(flat, by_token, minlength=len(chunks))
            by_bias, by_moves = by_bias + by_token.sum(), by_moves + more
        g = np.concatenate([np.bincount(feature_of, by_chunk[chunk_of], minlength=len(w)) - PENALTY * w, [by_bias], by_moves.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = 0.15 * (state[0] / (1 - 0.9**r)) / (np.sqrt(state[1] / (1 - 0.99**r)) + 1e-8)
        w = w + move[: len(w)]
        bias = min(bias + float(move[len(w)]), -2.0)
        moves = np.clip(moves + move[len(w) + 1 :].reshape(2, 2), -3.0, 3.0)
    crf.weights = {f: float(w[n]) for f, n in names.items()}
    crf.bias, crf.moves = float(bias), moves
    u = bias + np.bincount(chunk_of, w[feature_of], minlength=len(chunks))
    every = np.array([len(x) for x in ids])
    s = np.concatenate([sums(chain(u[np.concatenate([ids[i] for i in some])], every[some], moves), every[some]) for some in groups(every, SIDE)])
    crf.mean, crf.scale = s.mean(0), s.std(0) + 1e-6
    s = (s - crf.mean) / crf.scale
    curve, level = np.zeros(3), 0.0
    each = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    for _ in range(800):
        p = 1 / (1 + np.exp(-np.clip(s @ curve + level, -30, 30)))
        miss = (y - p) * each
        curve = curve + 4.0 * (s.T @ miss - 0.0005 * curve)
        level += 4.0 * miss.sum()
    crf.curve, crf.level = curve, float(level)
    return crf


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Bounded training rows: labelled documents whose crc32(doc_id as text) mod 3 is not 1, picked by a hash of doc_id."""
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    picked = [r for bad, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)) for r in known.where(F.col("toxic") == bad).orderBy("h", "doc_id").limit(most).select("doc_id", "toxic").collect()]
    if not picked:
        return [], []
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int")
    rows = docs.where(F.length("text") <= LONGEST).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows], [r.toxic for r in rows]


def score_toxicity(docs: DataFrame, labels: DataFrame, crf: Crf | None = None) -> DataFrame:
    """docs with toxic_score (double) and toxic_spans (start:end, comma-joined), one row for each row.

    Whole texts are scored; doc_id, lang, source and labels are no inputs of a score. Null and empty texts get
    the score of a text without toxic tokens. Repeated rows and further columns pass through; columns that
    already have the two names are replaced. Empty tables give no rows.
    """
    for_python(docs.sparkSession)
    crf = crf or fit(*sample(docs, labels))
    docs = docs.drop("toxic_score", "toxic_spans")
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema), "toxic_score double, toxic_spans string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [*crf.scores(b.column(b.schema.get_field_index("text")).to_pylist())]
            spans = pa.array([",".join(f"{s}:{e}" for s, e, _ in x[1]) for x in got], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in got], pa.float64()), spans], [*b.schema.names, "toxic_score", "toxic_spans"])

    return docs.mapInArrow(trimmed(run), schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_toxicity() of all documents, learnt from labels of those that are not held out; null doc_ids are not held out."""
    scored = score_toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans"))
