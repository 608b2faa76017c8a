"""Removal of repeated passages: every window of 35 words that also starts elsewhere.

Each window has a minimiser, the run of MMER words in it with the least hash (leftmost among equals). Consecutive
windows with the same minimiser travel as one packed string, a super-k-mer, to the bucket of that minimiser.
Equal windows have equal minimisers at equal places, so they meet there, never from one packed string, and are
told apart word for word.

Three things keep that small. A minimiser that stands in one super-k-mer of all marks windows without a twin:
a bitmap, made from counts over all documents and sized by them, tells which may be left at home (a false hit
costs a row, no result). Equal packed strings of a batch travel as one, with the list of their places, and need
no look inside. And minimisers with more than HOT super-k-mers, known by further bitmaps, are dealt to several
buckets. What repeats within one of these is settled there; a window that is alone in its bucket goes on by its
128-bit hash, with one stand-in for each repeated one of the other buckets, and is counted among them. (There,
and only there, windows are the same if their 128-bit hashes are.)
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, for_python, table

WINDOW, MMER = 35, 6
HOT = 2000
#: Bits of a bitmap: SPARE or more for each minimiser in it, a power of two from LEAST to MOST (256 MB). Beyond that it
#: fills up: more rows travel, and nothing else changes.
SPARE, LEAST_CELLS, MOST_CELLS = 16, 1 << 20, 1 << 31
#: A minimiser with more than HOT * FOLD ** (k - 1) super-k-mers is dealt to FOLD ** k buckets at least.
FOLD = 4
#: Words of one text that are cut into super-k-mers at once, and bytes of one block of texts.
PIECE, BLOCK = 100_000, 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(1234).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    got = known.get(base)
    if got is None or len(got) < n:
        size = max(n, BLOCK + (1 << 16))
        x = np.full(size, base, dtype=np.uint64)
        x[0] = 1
        got = known[base] = np.multiply.accumulate(x)
    return got[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def super_kmers(texts: list[str | None], window: int = WINDOW) -> Iterator[tuple[bytes, dict[str, np.ndarray]]]:
    """Blocks of texts: the words, joined by one space, and the super-k-mers in them.

    Of each: row (in texts), first (word of the text where its first window starts), windows (their number),
    minimiser (hash), and start and end in the bytes.
    """
    held: list[tuple[int, int, list[bytes]]] = []
    size = 0
    for row, t in enumerate(texts):
        words = t.encode().split() if t else []
        for at in range(0, len(words) - window + 1, PIECE):  # pieces share window - 1 words
            part = words[at : at + PIECE + window - 1]
            held.append((row, at, part))
            size += sum(map(len, part)) + len(part)
            if size >= BLOCK:
                yield _block(held, window)
                held, size = [], 0
    if held:
        yield _block(held, window)


def _block(held: list[tuple[int, int, list[bytes]]], window: int) -> tuple[bytes, dict[str, np.ndarray]]:
    raw = b" ".join([b" ".join(p) for _, _, p in held])
    byte = np.frombuffer(raw, dtype=np.uint8)
    space = np.flatnonzero(byte == 32)
    start, end = np.r_[0, space + 1], np.r_[space, len(byte)]
    sums = np.zeros(len(byte) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[byte] * _powers(_BASE, len(byte)), out=sums[1:])
    a, b = start[: 1 - MMER], end[MMER - 1 :]
    h = _mix((sums[b] - sums[a]) * _powers(_BACK, len(byte) + 1)[a])
    key = h & ~np.uint64(0xFFFFFF) | np.arange(len(h), dtype=np.uint64)
    wide, span = window - MMER + 1, 1
    while span * 2 <= wide:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    key = np.minimum(key[: len(key) - (wide - span)], key[wide - span :])
    best = (key & np.uint64(0xFFFFFF)).astype(np.int64)  # of each window, where its minimiser starts
    n = np.array([len(p) for _, _, p in held])
    base = np.cumsum(n) - n
    part = np.repeat(np.arange(len(n)), n)
    valid = part[: len(best)] == part[window - 1 :]
    at = np.flatnonzero(valid)
    new = np.r_[True, (best[at[1:]] != best[at[:-1]]) | (at[1:] != at[:-1] + 1)]
    first = at[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(at)])
    own = part[first]
    return raw, {
        "row": np.array([r for r, _, _ in held])[own],
        "first": first - base[own] + np.array([s for _, s, _ in held])[own],
        "windows": count,
        "minimiser": h[best[first]].view(np.int64),
        "start": start[first],
        "end": end[first + count - 1 + window - 1],
    }


class Marks:
    """A set of minimisers as bits on every executor; it may hold others too."""

    def __init__(self, found: DataFrame, n: int):
        """found (minimiser): n rows. Bits come to the driver in rows of 4096 bytes, however many minimisers there are."""
        size = LEAST_CELLS
        while size < min(SPARE * n, MOST_CELLS):
            size *= 2
        cell = found.select((F.shiftrightunsigned("minimiser", 7).bitwiseAND(size - 1) + 1).alias("c"))
        rows = cell.groupBy(F.expr("bitmap_bucket_number(c)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(c))").alias("bits"))
        out = bytearray(size // 8)
        for r in rows.collect():  # buckets count from 1, for values from 1
            out[(r.n - 1) * 4096 : r.n * 4096] = r.bits
        self.size, self.bits = size, found.sparkSession.sparkContext.broadcast(bytes(out))

    def __call__(self, minimisers: np.ndarray) -> np.ndarray:
        c = (minimisers.view(np.uint64) >> np.uint64(7) & np.uint64(self.size - 1)).astype(np.int64)
        return (np.frombuffer(self.bits.value, dtype=np.uint8)[c >> 3] >> (c & 7)) & 1 == 1


def repeated_ranges(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(doc_id, h, a, b) of docs (doc_id, text, h): words a to b (exclusive) that repeated windows cover; ranges may overlap."""
    for_python(docs.sparkSession)

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, s in super_kmers(b.column(1).to_pylist(), window):
                yield pa.RecordBatch.from_arrays([pa.array(s["minimiser"])], ["minimiser"])

    counts = cut(docs.select("doc_id", "text").mapInArrow(minimisers, "minimiser long").groupBy("minimiser").count().where("count > 1"))
    above = [hot * FOLD**k for k in range(24)]
    n, *busy = counts.agg(F.count("*"), *(F.count(F.when(F.col("count") > x, 1)) for x in above)).first()
    shared, levels = Marks(counts, n), [Marks(counts.where(F.col("count") > x), k) for x, k in zip(above, busy, strict=True) if k]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield _folded(b, window, shared, levels)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _whole(batches, 2, lambda t: _settle(t, window))

    order = ["minimiser", "part"]
    rows = docs.select("doc_id", "text", "h").mapInArrow(packed, "minimiser long, part long, packed binary, times long, places binary")
    found = rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(settled, "doc_id long, h long, a long, b long, k1 long, k2 long, alone boolean")
    if not levels:
        return found.select("doc_id", "h", "a", "b")
    found = cut(found)
    single = found.where("alone").select("doc_id", "h", "a", "b", "k1", "k2")
    twice = found.where("k1 is not null").groupBy("k1", "k2").count().where("count > 1").select("k1", "k2")
    return found.where("k1 is null").select("doc_id", "h", "a", "b").unionAll(single.join(twice, ["k1", "k2"], "left_semi").select("doc_id", "h", "a", "b"))


def _folded(b: pa.RecordBatch, window: int, shared: Marks, levels: list[Marks]) -> pa.RecordBatch:
    """The super-k-mers of a batch (doc_id, text, h) that may have twins, equal packed strings in one row with their places.

    A place is (doc_id, h, twice the first word, and one more where there is no doc_id), 24 bytes; places of equal
    rows are one place that is there several times. Rows of hot minimisers are dealt to parts by doc_id and text;
    of others the part is -1.
    """
    number: dict[bytes, int] = {}
    key, part, times = [], [], []
    places: list[dict[tuple[int, int, int], None]] = []
    gap = b.column(0).is_null().to_numpy(zero_copy_only=False)
    doc = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    hashes = b.column(2).to_numpy(zero_copy_only=False)
    salt = _mix(_mix(doc.astype(np.uint64)) ^ hashes.view(np.uint64))
    for raw, s in super_kmers(b.column(1).to_pylist(), window):
        i = np.flatnonzero(shared(s["minimiser"]))
        if not len(i):
            continue
        m, row, first = s["minimiser"][i], s["row"][i], s["first"][i]
        deal = np.full(len(i), -1, dtype=np.int64)
        if levels and (hot := np.flatnonzero(levels[0](m))).size:
            parts = np.uint64(FOLD) ** np.sum([x(m[hot]) for x in levels], axis=0, dtype=np.uint64)
            deal[hot] = (_mix(salt[row[hot]] + first[hot].astype(np.uint64)) % parts).astype(np.int64)
        place = zip(doc[row].tolist(), hashes[row].tolist(), (first * 2 + gap[row]).tolist(), strict=True)
        for x, y, k, p, where in zip(s["start"][i].tolist(), s["end"][i].tolist(), m.tolist(), deal.tolist(), place, strict=True):
            at = number.setdefault(raw[x:y], len(number))
            if at == len(places):
                key.append(k), part.append(p), places.append({}), times.append(0)
            times[at] += 1
            places[at][where] = None
    flat = np.array([x for p in places for x in p], dtype=np.int64).tobytes()
    ends = np.cumsum([0, *(24 * len(p) for p in places)]).tolist()
    held = pa.array([flat[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(part, pa.int64()), pa.array([*number], pa.binary()), pa.array(times, pa.int64()), held], ["minimiser", "part", "packed", "times", "places"])


def _whole(batches: Iterator[pa.RecordBatch], keys: int, count) -> Iterator[pa.RecordBatch]:
    """count() of whole buckets: rows are sorted by their first columns, and batches may end within a bucket."""
    rest: pa.Table | None = None
    for b in batches:
        if not len(b):
            continue
        rest = pa.concat_tables([rest, pa.Table.from_batches([b])]).combine_chunks() if rest is not None else pa.Table.from_batches([b])
        key = [rest.column(k).to_numpy() for k in range(keys)]
        other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
        if len(other):
            stop = int(other[-1]) + 1
            yield from count(rest.slice(0, stop))
            rest = rest.slice(stop)
    if rest is not None:
        yield from count(rest)


def _windows(packed: bytes, window: int) -> list[bytes]:
    at = np.flatnonzero(np.frombuffer(packed, dtype=np.uint8) == 32).tolist()
    n = len(at) + 2 - window
    starts = [0, *(x + 1 for x in at[: n - 1])]
    return [packed[s:e] for s, e in zip(starts, [*at[window - 1 :], len(packed)], strict=True)]


def covered(times: dict[bytes, int], window: int) -> tuple[dict[bytes, list[tuple[int, int]]], dict[bytes, list[tuple[int, bytes]]], list[bytes]]:
    """Of the packed strings of one bucket and how often each is there: the ranges of words that repeated windows cover;
    the windows that are alone, with their first words; and each repeated window once. Sorted windows tell which repeat."""
    each = {p: _windows(p, window) for p in times}
    order = sorted([w for x in each.values() for w in x])
    repeated = {x for x, y in zip(order, order[1:], strict=False) if x == y}
    repeated.update(w for p, n in times.items() if n > 1 for w in each[p])
    ranges: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    alone: dict[bytes, list[tuple[int, bytes]]] = defaultdict(list)
    for p, x in each.items():
        own = ranges[p]
        for t, w in enumerate(x):
            if w not in repeated:
                alone[p].append((t, w))
            elif own and own[-1][1] == t + window - 1:
                own[-1] = (own[-1][0], t + window)
            else:
                own.append((t, t + window))
    return ranges, alone, sorted(repeated)


def _settle(rows: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows of whole buckets: rows (minimiser, part, packed, times, places).

    For parts of hot buckets also each window that is alone there, and one stand-in for each repeated one, by their hashes.
    """
    keys = [rows.column(k).to_numpy() for k in range(2)]
    edge = [0, *(np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1).tolist(), len(rows)]
    hot = (keys[1] >= 0).tolist()
    packed, there, places = (rows.column(k).to_pylist() for k in range(2, 5))
    size = np.array([len(x) // 24 for x in places])
    begin = (np.cumsum(size) - size).tolist()
    place = np.frombuffer(b"".join(places), dtype=np.int64).reshape(-1, 3)
    at, lo, hi, key, alone = [], [], [], [], []
    for s, e in zip(edge, edge[1:], strict=False):
        if e - s == 1 and there[s] == 1 and not hot[s]:
            continue
        if e - s == 1 and not hot[s]:
            ranges, lone, repeated = {packed[s]: [(0, packed[s].count(b" ") + 1)]}, {}, []
        else:
            times: Counter = Counter()
            for i in range(s, e):
                times[packed[i]] += there[i]
            ranges, lone, repeated = covered(times, window)
        for i in range(s, e):
            for x in range(begin[i], begin[i] + len(places[i]) // 24):
                for a, b in ranges[packed[i]]:
                    at.append(x), lo.append(a), hi.append(b), key.append(None), alone.append(False)
            if hot[s]:
                for t, w in lone.get(packed[i], ()):
                    at.append(begin[i]), lo.append(t), hi.append(t + window), key.append(w), alone.append(True)
        if hot[s]:
            for w in repeated:
                at.append(begin[s]), lo.append(0), hi.append(0), key.append(w), alone.append(False)
    doc, h, first = place[at].T if at else np.empty((3, 0), dtype=np.int64)
    hashes = [None if w is None else xxhash.xxh3_128_intdigest(w) for w in key]
    half = lambda shift: pa.array([None if x is None else (x >> shift & (1 << 64) - 1) - (1 << 63) for x in hashes], pa.int64())
    start = first >> 1
    cols = [pa.array(doc, mask=first & 1 == 1), pa.array(h), pa.array(start + np.array(lo, dtype=np.int64)), pa.array(start + np.array(hi, dtype=np.int64)), half(0), half(64), pa.array(alone, pa.bool_())]
    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "a", "b", "k1", "k2", "alone"])


def kept_words(text: str | None, ranges: list[dict] | None) -> tuple[int, list[bytes]]:
    words = text.encode().split() if text else []
    if not ranges:
        return len(words), words
    out, done = [], 0
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if b > done:
            out += words[done : max(a, done)]
            done = b
    return len(words), out + words[done:]


def remove_repeats(docs: DataFrame, digest: bool = False, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row for each row of docs (doc_id, text); with digest kept_sha256 instead.

    Windows are judged on the input, the same document included. Null, empty and blank texts have no words;
    texts under 35 words lose none. Words are never changed; kept ones are joined by one space. Of rows that
    are equal all lose what repeats. Rows may share a doc_id or have none. Empty tables give no rows.
    """
    for_python(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    found = repeated_ranges(docs, window, hot).groupBy("doc_id", "h").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    found = found.select(F.col("doc_id").alias("i"), F.col("h").alias("g"), "ranges")
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [kept_words(t, r) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            said = [b" ".join(k) for _, k in got]
            last = pa.array([sha256(x).hexdigest() if digest else x.decode() for x in said], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([n - len(k) for n, k in got], pa.int64()), last], ["doc_id", "n_words", "n_removed", name])

    name = "kept_sha256" if digest else "kept_text"
    return both.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats() over all documents; nulls, ties, repeated rows and empty tables as there."""
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), digest=True)
