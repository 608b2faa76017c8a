"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit for each bit of the shingle hashes, set if more than half of them have it. Fingerprints
are cut into segments. Two that differ in at most d bits differ in at most d // segments bits of some segment,
so each is looked up, for every segment, under all values of a small Hamming ball, in a table of exact segment
values; what is found is verified by the complete distance. A pair meets from one side only: of a differing
mask, the fingerprint that has 0 at the mask's lowest bit asks.

A bucket of the complete form gives a spanning forest of its links, nearest first. The similarity form at the
end takes candidates from longer fingerprints and verifies them on the shingle sets themselves.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_words, components, cut, for_python, table, trimmed

SEED = 42
#: Byte k of entry b is bit k of b.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()
#: Up to so many rows of a bucket are compared by shifts; up to HOT as one forest.
FEW, HOT = 16, 2048


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle's UTF-8, repeats included; fewer words: of them all; no word: none."""
    w = ascii_words(text)
    if not w:
        return np.empty(0, dtype=np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) < words:
        return np.array([h(join(w), SEED)], dtype=np.uint64)
    return np.array([h(join(x), SEED) for x in zip(*(w[i:] for i in range(words)), strict=False)], dtype=np.uint64)


def widen(hashes: np.ndarray, width: int) -> np.ndarray:
    """(n, width) words of 64 bits from n hashes: the hash itself, then mixes of it."""
    out = np.empty((len(hashes), width), dtype=np.uint64)
    out[:, 0] = hashes
    for i in range(1, width):  # splitmix64
        x = hashes + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, i] = x ^ (x >> np.uint64(31))
    return out


def fingerprints(texts: list[str | None], words: int, width: int = 1) -> np.ndarray:
    """(len(texts), width) words of 64 bits; zero for texts without a word. Memory is that of one block."""
    return set_fingerprints((shingle_hashes(t, words) for t in texts), width, len(texts))


def set_fingerprints(hashes: Iterable[np.ndarray], width: int, n: int | None = None) -> np.ndarray:
    """The same of n lists of hashes."""
    out = np.zeros((len(hashes) if n is None else n, width), dtype=np.uint64)
    held, sizes, who = [], [], []
    size = 0

    def flush() -> None:
        if not held:
            return
        h, n = np.concatenate(held), np.array(sizes)
        starts = np.concatenate([np.arange(o, o + k, 255) for o, k in zip(np.cumsum(n) - n, n, strict=True)])
        of = np.repeat(np.arange(len(n)), -(-n // 255))
        counts = np.zeros((len(n), width * 64), dtype=np.int64)
        step = max(1, (1 << 11) // width)  # chunks of at most 255 hashes
        for i in range(0, len(starts), step):
            a, b = starts[i], starts[i + step] if i + step < len(starts) else len(h)
            spread = _SPREAD[widen(h[a:b], width).view(np.uint8)]
            sums = np.add.reduceat(spread, starts[i : i + step] - a, axis=0)
            np.add.at(counts, of[i : i + step], sums.view(np.uint8))
        out[who] = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64)
        held.clear(), sizes.clear(), who.clear()

    for i, h in enumerate(hashes):
        if len(h):
            held.append(h), sizes.append(len(h)), who.append(i)
            size += len(h)
            if size >= 1 << 16 or len(held) == 512:
                flush()
                size = 0
    flush()
    return out


def masks(bits: int, radius: int) -> list[int]:
    """Masks of at most radius bits, the empty one first."""
    return [sum(1 << b for b in x) for r in range(radius + 1) for x in combinations(range(bits), r)]


def ball(values: np.ndarray, bits: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(indexes, values asked for, whether they are the values themselves); see the module for who asks."""
    for m in masks(bits, radius):
        if not m:
            yield np.arange(len(values)), values, True
        else:
            i = np.flatnonzero((values >> np.uint64((m & -m).bit_length() - 1)) & np.uint64(1) == 0)
            yield i, values[i] ^ np.uint64(m), False


def forest(check: np.ndarray, own: np.ndarray, most: int, group: np.ndarray) -> list[tuple[int, int]]:
    """Minimum spanning forest over pairs within most bits of which one at least is the bucket's own.

    Rows of one group hang together already: their links come first and are not given back.
    """
    n, out = len(check), []
    left = np.ones(n, dtype=bool)
    near, by = np.full(n, 99, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for _ in range(n):
        at = int(np.where(left, near, 1000).argmin())
        if 0 <= near[at] <= most:
            out.append((int(by[at]), at))
        left[at] = False
        d = np.bitwise_count(check ^ check[at]).astype(np.int64)
        if not own[at]:
            d[~own] = 99
        d[group == group[at]] = -1
        closer = left & (d < near)
        near[closer], by[closer] = d[closer], at
    return out


def _links(key: np.ndarray, ids: np.ndarray, check: np.ndarray, own: np.ndarray, most: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) within buckets, but for pairs of one group; rows are sorted by key and buckets are whole."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    some = np.add.reduceat(own.astype(np.int64), first) > 0
    for s, n in zip(first[some & (size > FEW)].tolist(), size[some & (size > FEW)].tolist(), strict=True):
        for x, y in forest(check[s : s + n], own[s : s + n], most, group[s : s + n]):
            a.append(ids[s + x : s + x + 1])
            b.append(ids[s + y : s + y + 1])
    end = np.repeat(first + size, size)
    i = np.flatnonzero(np.repeat(some & (size > 1) & (size <= FEW), size))
    for shift in range(1, FEW):
        i = i[i + shift < end[i]]
        if not len(i):
            break
        j = i + shift
        ok = (own[i] | own[j]) & (group[i] != group[j]) & (np.bitwise_count(check[i] ^ check[j]) <= most)
        a.append(ids[i[ok]])
        b.append(ids[j[ok]])
    join = lambda x: np.concatenate(x) if x else np.empty(0, dtype=np.int64)
    return join(a), join(b)


def bucket_links(rows: DataFrame, own: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int) -> DataFrame:
    """(a, b) of rows (key, id, fp, grp): links inside buckets of a bounded size, between ids of different groups only.

    Without grp each id is a group of its own.
    """
    if "grp" not in rows.columns:
        rows = rows.withColumn("grp", F.col("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.int64)]

        def give(cols: list[np.ndarray]) -> pa.RecordBatch:
            k, i, f, g = cols
            x, y = _links(k, i, f, own(k, f), most, g) if len(k) else (i, i)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

        for batch in batches:
            k, i, f, g = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(4))
            rest = [np.concatenate([r, c]) for r, c in zip(rest, (k, i, f.view(np.uint64), g), strict=True)]
            stop = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
            if stop:
                yield give([c[:stop] for c in rest])
                rest = [c[stop:] for c in rest]
        yield give(rest)

    return rows.repartition("key").sortWithinPartitions("key").select("key", "id", "fp", "grp").mapInArrow(run, "a long, b long")


# --- complete form: all links within a distance of 64-bit fingerprints ---

DISTANCE, SEGMENTS = 3, 2


def _own64(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    seg = (key >> 32).astype(np.uint64)
    return (fp >> (seg * np.uint64(32)) & np.uint64(0xFFFFFFFF)) == (key & 0xFFFFFFFF).astype(np.uint64)


def _ask64(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, fp = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        u = fp.view(np.uint64)
        for seg in range(SEGMENTS):
            value = u >> np.uint64(32 * seg) & np.uint64(0xFFFFFFFF)
            got = [(i, v) for i, v, _ in ball(value, 32, DISTANCE // SEGMENTS)]
            i, v = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64) | seg << 32), pa.array(ids[i]), pa.array(fp[i])], ["key", "id", "fp"])


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of a hot bucket, the values of the other segment around theirs: within 1, and 2 of the bucket's own."""
    small, wide = masks(32, 1), [m for m in masks(32, 2) if m.bit_count() == 2]
    for b in batches:
        key, ids, fp = (b.column(n).to_numpy(zero_copy_only=False) for n in range(3))
        own = _own64(key, fp.view(np.uint64))
        other = fp.view(np.uint64) >> (np.uint64(32) * (np.uint64(1) - (key >> 32).astype(np.uint64))) & np.uint64(0xFFFFFFFF)
        for ms, centre in ((small, True), (wide, False)):
            for at in range(0, len(ids), 2048):
                pick = np.arange(at, min(at + 2048, len(ids)))
                pick = pick if centre else pick[own[pick]]
                hub = (other[pick][:, None] ^ np.array(ms, dtype=np.uint64)).ravel()
                rep = np.repeat(pick, len(ms))
                yield pa.RecordBatch.from_arrays([pa.array(key[rep]), pa.array(hub.astype(np.int64)), pa.array(ids[rep]), pa.array(own[rep] & centre)], ["key", "hub", "id", "centre"])


def hamming_components(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(fp, rep, component) for each distinct fingerprint of fps (doc_id, fp long).

    rep is its smallest doc_id, component the smallest reachable over links of at most 3 differing bits.
    Buckets of more than hot table entries go another exact way with groups of bounded size: an entry
    stands at all values within 2 bits of its other segment. Entries at a value that some entry is within
    1 bit of are linked to that one: their distance is 3 or less; and a pair within 3 bits has such a value.
    """
    for_python(fps.sparkSession)
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    rows = reps.select("rep", "fp").mapInArrow(_ask64, "key long, id long, fp long")
    both = F.explode(F.array(F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32) + (1 << 32)))
    busy = cut(reps.select(both.alias("key")).groupBy("key").count().where(F.col("count") > hot).select("key"))
    if busy.isEmpty():
        links = bucket_links(rows, _own64, DISTANCE)
    else:
        around = rows.join(busy, "key", "left_semi").select("key", "id", "fp").mapInArrow(_hubs, "key long, hub long, id long, centre boolean")
        near = around.withColumn("b", F.min(F.when(F.col("centre"), F.col("id"))).over(Window.partitionBy("key", "hub")))
        hub = near.where("b is not null and b <> id").select(F.col("id").alias("a"), "b").distinct()
        links = bucket_links(rows.join(busy, "key", "left_anti"), _own64, DISTANCE).unionAll(hub)
    comp = components(links)
    return reps.join(comp, reps.rep == comp.node, "left").select("fp", "rep", F.coalesce("component", "rep").alias("component"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of docs (doc_id, text), one row for each row.

    Words are lower-cased in A-Z; 3-word shingles, repeats included. Null, empty and blank texts have
    fingerprint zero, linked like any other; shorter texts one shingle. Rows with an equal doc_id are all
    kept; a null doc_id gets a fingerprint, and its component is that of its fingerprint (null if only
    nulls have it). Empty tables give no rows; further columns are not looked at.
    """
    for_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1).to_pylist(), 3).ravel().view(np.int64))], ["doc_id", "fp"])

    fps = cut(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long"))
    found = hamming_components(fps)
    return fps.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_groups() of all documents; nulls, ties, repeated rows and empty tables as there."""
    return simhash_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


# --- similarity form: five words, similarity 0.8 and more ---

#: A pair at the similarity is missed by the segments, or by a limit on distances, in MISS of cases at most (each).
WORDS, SIMILARITY, MISS = 5, 0.8, 0.001
#: Words of 64 bits of a fingerprint at least; the first two are the check that travels to the buckets, the others hold the segments.
WIDTH, CHECK = 8, 2
#: Bits of a segment: so many that an average bucket has no more than ROWS entries, and LEAST_BITS at least.
ROWS, LEAST_BITS = 64, 14
#: Segments by which large groups are found early.
EARLY = 4
#: Buckets of more than HOT_ROWS entries, and documents with more than CROWD candidates, are left to prefixes.
HOT_ROWS, CROWD = 4096, 64
#: Pairs that are looked at side by side, and links that are held before they are sorted.
SIDE, HELD = 1 << 20, 1 << 21
#: Prefixes: counters of shingles by the low bits of their hash, given out in slices; rows of a bucket that meet in one
#: place. Bits by which texts that are not asked for stay where they are.
SLOTS, SLICES, BUCKET, BLOCK, MARKS = 1 << 20, 64, 8192, 1024, 1 << 24


def _above(bits: int, p: float, most: int) -> float:
    """Probability that more than most of the bits differ if each does with probability p (from 0 to below 1)."""
    term = total = (1.0 - p) ** bits
    for k in range(1, most + 1):
        term *= (bits - k + 1) / k * p / (1.0 - p)
        total += term
    return 1.0 - total


@dataclass(frozen=True)
class Geometry:
    """How fingerprints are cut: bits of a segment, segments, words in all; and distances that candidates have at most."""

    bits: int
    segments: int
    width: int
    check: int
    full: int


def geometry(n: int, similarity: float = SIMILARITY) -> Geometry:
    """For n documents. Bits of two sets of a similarity s differ with probability acos(2s / (1 + s)) / pi, and less if one is smaller."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / ROWS)))
    meets = 1.0 - _above(bits, p, 1)
    segments = max(EARLY, math.ceil(math.log(MISS) / math.log(1 - meets))) if p else EARLY
    width = max(WIDTH, CHECK + math.ceil(bits * segments / 64))
    limit = lambda size: next(k for k in range(size + 1) if _above(size, p, k) <= MISS)
    return Geometry(bits, segments, width, limit(64 * CHECK), limit(64 * width))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    return [np.unique(shingle_hashes(t, words)) for t in texts]


def segment(fp: np.ndarray, number: int, bits: int) -> np.ndarray:
    """Values of one segment of fingerprints (n, width); the segments follow the check."""
    at, shift = divmod(64 * CHECK + number * bits, 64)
    v = fp[:, at] >> np.uint64(shift)
    if shift + bits > 64:
        v = v | fp[:, at + 1] << np.uint64(64 - shift)
    return v & np.uint64((1 << bits) - 1)


def _words_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, width)


def asked_rows(reps: DataFrame, geo: Geometry, numbers: range, own_only: bool = False) -> DataFrame:
    """(key, own, id, fp, fq, grp) of reps (rep, fp, grp): for each segment a row at its value, and, to ask, at each value of the ball around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            fp = _words_of(b.column(1), geo.width)
            for s in numbers:
                value = segment(fp, s, geo.bits)
                for i, v, own in ball(value, geo.bits, 0 if own_only else 1):
                    if len(i):
                        row = pa.array(i)
                        yield pa.RecordBatch.from_arrays([pa.array((v | np.uint64(s << 40)).view(np.int64)), pa.array(np.full(len(i), own)), b.column(0).take(row), *(pa.array(fp[i, w].view(np.int64)) for w in range(CHECK)), b.column(2).take(row)], ["key", "own", "id", "fp", "fq", "grp"])

    return reps.select("rep", "fp", "grp").mapInArrow(trimmed(run), "key long, own boolean, id long, fp long, fq long, grp long")


def meetings(key: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of a bucket's own row and another row of it, some at a time. Rows are sorted by key."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    mine = np.flatnonzero(own & np.repeat(size > 1, size))
    n, begin = np.repeat(size, size)[mine], np.repeat(first, size)[mine]
    total = np.cumsum(n)
    at = 0
    while at < len(mine):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SIDE, side="right")))
        m = n[at:stop]
        i = np.repeat(mine[at:stop], m)
        j = np.arange(len(i)) + np.repeat(begin[at:stop] - (np.cumsum(m) - m), m)
        yield i[i != j], j[i != j]
        at = stop


def directed(cols: list[np.ndarray], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, distance) for rows (key, own, id, fp, fq, grp) of whole buckets: ids of different groups near by their checks, both ways."""
    key, own, ids, fp, fq, grp = cols
    for i, j in meetings(key, own):
        d = np.bitwise_count(fp[i] ^ fp[j]) + np.bitwise_count(fq[i] ^ fq[j])
        ok = (d <= limit) & (grp[i] != grp[j])
        i, j, d = i[ok], j[ok], d[ok]
        back = ~own[j]  # two own rows meet both ways as it is
        yield np.r_[ids[i], ids[j[back]]], np.r_[ids[j], ids[i[back]]], np.r_[d, d[back]]


def _bucketwise(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows (key, own, id, fp, fq, grp) sorted by key, as arrays of whole buckets; a missing group is the id."""
    rest: list[np.ndarray] | None = None
    for b in batches:
        if not len(b):
            continue
        key, own, ids = (b.column(n).to_numpy(zero_copy_only=False) for n in range(3))
        check = [b.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in (3, 4)]
        cols = [key, own, ids, *check, pc.coalesce(b.column(5), b.column(2)).to_numpy(zero_copy_only=False)]
        rest = cols if rest is None else [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
        if stop := int(np.searchsorted(rest[0], rest[0][-1])):
            yield [c[:stop] for c in rest]
            rest = [c[stop:] for c in rest]
    if rest is not None:
        yield rest


def nearest_links(rows: DataFrame, limit: int) -> DataFrame:
    """(a, b): for each id in a bucket the nearest other one there that is smaller, as a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _bucketwise(batches):
            for x, y, d in directed(cols, limit):
                ok = y < x
                x, y, d = x[ok], y[ok], d[ok]
                order = np.lexsort((y, d, x))
                x, y = x[order], y[order]
                new = np.r_[True, x[1:] != x[:-1]] if len(x) else np.empty(0, dtype=bool)
                yield _two(y[new], x[new])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(run), "a long, b long")


def candidate_lists(rows: DataFrame, limit: int) -> DataFrame:
    """(id, near): the candidates of each id that has some; null for ids with more than CROWD, in this part of the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = np.empty(0, dtype=np.int64)
        held = [np.empty((0, 2), dtype=np.int64)]

        def settled() -> np.ndarray:
            nonlocal crowded
            e = np.unique(np.concatenate(held), axis=0)
            e = e[~np.isin(e[:, 0], crowded)]
            who, n = np.unique(e[:, 0], return_counts=True)
            crowded = np.union1d(crowded, who[n > CROWD])
            return e[~np.isin(e[:, 0], crowded)]

        size = 0
        for cols in _bucketwise(batches):
            for x, y, _ in directed(cols, limit):
                held.append(np.stack([x, y], axis=1))
                size += len(x)
                if size > HELD:
                    held = [settled()]
                    size = 0
        e = settled()
        who, n = np.unique(e[:, 0], return_counts=True)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(e[:, 1], pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), lists], ["id", "near"])
        yield pa.RecordBatch.from_arrays([pa.array(crowded), pa.nulls(len(crowded), pa.list_(pa.int64()))], ["id", "near"])

    parts = rows.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(run), "id long, near array<long>")
    all_ = parts.groupBy("id").agg(F.max(F.col("near").isNull()).alias("crowded"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return cut(all_.select("id", F.when(~F.col("crowded") & (F.size("near") <= CROWD), F.col("near")).alias("near")))


def within(pairs: DataFrame, reps: DataFrame, geo: Geometry) -> DataFrame:
    """The pairs (a, b) whose whole fingerprints are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                d = np.bitwise_count(_words_of(b.column(2), geo.width) ^ _words_of(b.column(3), geo.width)).sum(1, dtype=np.int64)
                yield b.select(["a", "b"]).filter(pa.array(d <= geo.full))

    left, right = reps.select(F.col("rep").alias("a"), F.col("fp").alias("x")), reps.select(F.col("rep").alias("b"), F.col("fp").alias("y"))
    return pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def prefix_length(size: np.ndarray, similarity: float) -> np.ndarray:
    """Two sets this similar share one of so many first elements of both, in any common order."""
    return size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1


def prefixes(sets: list[np.ndarray], counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the set, place, hash) of the elements of each set's prefix, elements with the least counts first."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    h, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    h = h[np.lexsort((h, counts[h & np.uint64(SLOTS - 1)], of))]
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    keep = place < np.repeat(prefix_length(size, similarity), size)
    return of[keep], place[keep], h[keep]


def _may(p: np.ndarray, n: np.ndarray, q: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m elements can be similar if what they share first stands at places p and q."""
    return np.minimum(n - p, m - q) >= similarity / (1 + similarity) * (n + m) - 1e-6


def set_pairs(key: np.ndarray, ids: np.ndarray, at: np.ndarray, group: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a bucket's rows (at is place << 32 | size) that may be similar, of different groups. Rows are sorted by key.

    All pairs are looked at, small buckets side by side and others block by block.
    """
    found: list[np.ndarray] = []
    place, size = at >> 32, at & 0xFFFFFFFF

    def look(i: np.ndarray, j: np.ndarray) -> None:
        i, j = np.broadcast_arrays(i, j)
        ok = (group[i] != group[j]) & _may(place[i], size[i], place[j], size[j], similarity)
        a, b = ids[i[ok]], ids[j[ok]]
        if len(a):
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))

    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[first, len(key)])
    for s, e in zip(first[n > FEW].tolist(), (first + n)[n > FEW].tolist(), strict=True):
        if (group[s:e] == group[s]).all():
            continue
        rows = s + np.argsort(size[s:e], kind="stable")
        for i in range(0, len(rows), BLOCK):
            x = rows[i : i + BLOCK]
            for j in range(i, len(rows), BLOCK):
                y = rows[j : j + BLOCK]
                if size[y[0]] * similarity > size[x[-1]] + 1e-6:
                    break
                look(x[:, None], y[None, :])
    end = np.repeat(first + n, n)
    i = np.flatnonzero(np.repeat((n > 1) & (n <= FEW), n))
    for shift in range(1, FEW):
        i = i[i + shift < end[i]]
        if not len(i):
            break
        look(i, i + shift)
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets, each sorted, reaches the given one."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) >= similarity


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]


def _two(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _mix(h: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Another hash of h for each salt; salt 0 is h itself. Should two buckets fall together, only more pairs are looked at."""
    x = h ^ (np.asarray(salt, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    y = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(np.asarray(salt) == 0, h, y ^ (y >> np.uint64(31)))


def _keyed(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, key, fp) of rows (doc_id, text): the key is that of the shingle set, the fingerprint that of the set too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist(), WORDS)
            keys = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            fp = set_fingerprints(sets, width)
            yield pa.RecordBatch.from_arrays([b.column(0), keys, pa.array([x.tobytes() if len(y) else None for x, y in zip(fp, sets, strict=True)], pa.binary())], ["doc_id", "key", "fp"])

    return run


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the hashes in rows (rep, set, grp), in slices."""
    counts = np.zeros(SLOTS, dtype=np.uint32)
    for b in batches:
        for x in _sets_of(b.column(1)):
            np.add.at(counts, x & np.uint64(SLOTS - 1), 1)
    if counts.any():
        parts = pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), parts], ["slice", "counts"])


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(c), dtype=np.uint32)
            total[k] = total[k] + x if k in total else x.astype(np.int64)
    for k, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "counts"])


def marks_of(ids: DataFrame) -> Broadcast:
    """A bit for each slot (the low bits) that some id of ids (id) has; bits come to the driver in rows of 4096 bytes."""
    slot = ids.select((F.col("id").bitwiseAND(MARKS - 1) + 1).alias("s"))
    rows = slot.groupBy(F.expr("bitmap_bucket_number(s)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits"))
    out = bytearray(MARKS // 8)
    for r in rows.collect():  # buckets count from 1, for values from 1
        out[(r.n - 1) * 4096 : r.n * 4096] = r.bits
    return ids.sparkSession.sparkContext.broadcast(np.frombuffer(bytes(out), dtype=np.uint8))


def sets_of(docs: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, set) of the ids (id) out of reps (rep, key), read from docs (doc_id, text); other texts do not travel."""
    marks = marks_of(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False) & (MARKS - 1)
            b = b.filter(pa.array(marks.value[at >> 3] >> (at & 7) & 1 == 1))
            sets = [x.tobytes() for x in shingle_sets(b.column(1).to_pylist(), WORDS)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], ["rep", "key", "set"])

    asked = ids.select(F.col("id").alias("rep")).distinct().join(reps.select("rep", "key"), "rep")
    found = docs.mapInArrow(trimmed(run), "rep long, key binary, set binary")
    return found.join(asked, ["rep", "key"]).dropDuplicates(["rep", "key"]).select("rep", "set")


def checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (rep, set) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(x, y, similarity) for x, y in zip(_sets_of(b.column(2)), _sets_of(b.column(3)), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), sets.select(F.col("rep").alias("b"), F.col("set").alias("y"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def prefix_links(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all links of similar sets (rep, set, grp) of different groups.

    With a common order of shingles, similar sets share one of the first fifth of both, and there the places tell
    how much more they can share. The order is by counts of hashes in SLOTS counters, rare ones first, so buckets
    are small; any order gives the same links. Buckets that may have more than BUCKET rows are cut, and each two
    of their parts meet in one place. Every pair is compared by its sets.
    """
    slices = sets.mapInArrow(_count_shingles, "slice int, counts binary").repartition("slice").mapInArrow(_add_counts, "slice int, counts binary")
    counts = np.zeros(SLOTS, dtype=np.int64)
    for r in slices.collect():
        np.split(counts, SLICES)[r.slice][:] = np.frombuffer(r.counts, dtype=np.int64)
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            ids, group, held = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False), _sets_of(b.column(1))
            size = np.array([len(s) for s in held], dtype=np.int64)
            of, place, h = prefixes(held, shared.value, similarity)
            parts = -(-shared.value[h & np.uint64(SLOTS - 1)] // BUCKET)
            mine = (_mix(ids.astype(np.uint64), 7)[of] % parts.astype(np.uint64)).astype(np.int64)
            for other in range(int(parts.max())):
                i = np.flatnonzero(parts > other)
                cell = np.minimum(mine[i], other) * parts[i] + np.maximum(mine[i], other)
                cols = [_mix(h[i], cell).view(np.int64), ids[of[i]], place[i] << 32 | size[of[i]], group[of[i]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "id", "at", "grp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, dtype=np.int64)] * 4
        for b in batches:
            rest = [np.concatenate([r, b.column(n).to_numpy(zero_copy_only=False)]) for n, r in enumerate(rest)]
            stop = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
            if stop:
                yield _two(*set_pairs(*(c[:stop] for c in rest), similarity))
                rest = [c[stop:] for c in rest]
        if len(rest[0]):
            yield _two(*set_pairs(*rest, similarity))

    rows = sets.select("rep", "set", "grp").mapInArrow(ask, "key long, id long, at long, grp long")
    pairs = rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")
    return checked(pairs.distinct(), sets.select("rep", "set"), similarity)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, keep) of docs (doc_id, text): keep is true for the smallest doc_id of each near-duplicate group.

    Shingles of five words, each once; documents whose shingle sets have a Jaccard similarity of 0.8 or more are
    linked. Candidates come from multi-index hashing of fingerprints of the sets: see geometry() for the cut, by
    which a pair at the similarity is missed in about 3 * MISS of cases, and pairs above it more rarely. No pair
    is linked without a look at both sets, so documents below the similarity are never linked.

    In a first round a few segments propose to each document its nearest smaller neighbour, which joins large
    groups. In the second round all segments propose all candidates of different groups. Documents with more
    than CROWD of these and those in buckets of more than HOT_ROWS entries (families that share a template) are
    compared among each other by prefixes instead, without a miss. Either way each candidate pair is verified.

    Texts without a word form one group, as equal texts do. Rows that share a doc_id stay or go together.
    Null doc_ids stay. Empty tables give no rows; further columns are not looked at.
    """
    spark = docs.sparkSession
    for_python(spark)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    geo = geometry(docs.select("doc_id").count(), similarity)
    fps = cut(docs.mapInArrow(trimmed(_keyed(geo.width)), "doc_id long, key binary, fp binary"))
    reps = cut(fps.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp")))
    single = reps.where("fp is not null").withColumn("grp", F.lit(None).cast("long"))
    hot = cut(asked_rows(single, geo, range(geo.segments), own_only=True).groupBy("key").count().where(F.col("count") > HOT_ROWS).select("key"))
    busy = not hot.isEmpty()

    def looked(pairs: DataFrame) -> DataFrame:
        pairs = cut(within(pairs, single, geo))
        return checked(pairs, sets_of(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("id"))), similarity)

    rows = asked_rows(single, geo, range(EARLY))
    early = looked(nearest_links(rows.join(hot, "key", "left_anti") if busy else rows, geo.check))
    known = components(early).select(F.col("node").alias("rep"), "component")
    grouped = cut(single.drop("grp").join(known, "rep", "left").withColumnRenamed("component", "grp"))
    rows = asked_rows(grouped, geo, range(geo.segments))
    lists = candidate_lists(rows.join(hot, "key", "left_anti") if busy else rows, geo.check)
    links = early.unionAll(looked(lists.where("near is not null").select("id", F.explode("near").alias("x")).select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))))
    crowd = lists.where("near is null").select("id")
    crowd = cut(crowd.unionAll(rows.join(hot, "key", "left_semi").select("id")).distinct()) if busy else crowd
    if not crowd.isEmpty():
        groups = grouped.select("rep", F.coalesce("grp", "rep").alias("grp"))
        links = links.unionAll(prefix_links(cut(sets_of(docs, reps, crowd).join(groups, "rep")), similarity))
    comp = components(links).withColumnRenamed("node", "rep")
    gone = comp.where("rep <> component").select("rep", F.lit(False).alias("first"))
    marked = fps.select("doc_id", "key").join(reps.select("key", "rep"), "key").join(gone, "rep", "left")
    return marked.select("doc_id", (F.coalesce("first", F.lit(True)) & (F.col("doc_id") == F.col("rep"))).alias("keep")).groupBy("doc_id").agg(F.max("keep").alias("keep"))
