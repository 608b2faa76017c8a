"""Embedding near-duplicates through a pivot-permutation index.

Each vector is described by its NEAREST reference points (pivots) in order of their cosines. Vectors that are nearly
the same have most of these in common at similar ranks: a common pivot counts the more the nearer it is to both, and
pairs that reach NEAR are candidates (see score()); their cosine is verified in double precision. Candidates are
retrieved through inverted lists of pivots: with the pivots of a vector in one global order, two vectors with SHARED
in common meet in a list of the first NEAREST - SHARED + 1 of both, and are compared in the list of their first common
pivot only. Lists are cut into blocks, and each pair of blocks is a group of its own of a bounded size.

Only permutations go to the lists. Vectors follow to the groups in which they have a candidate, and to no others.
Equal vectors are one entry with a count. Pivots are taken from a bounded sample; every vector is indexed. Recall is
measured by the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, for_python, table

COSINE, NEAREST, SHARED, NEAR = 0.95, 8, 3, 28
#: Pivots: twice the root of the number of distinct vectors, LEAST_PIVOTS at least, PIVOT_BYTES of them at most; from a
#: sample of SAMPLE vectors, or twice as many as there are pivots if that is more.
LEAST_PIVOTS, PIVOT_BYTES, SAMPLE = 32, 1 << 26, 4096
#: Entries of one list that form a block. Pivots are further apart than APART allows.
BLOCK, APART = 1024, 0.8


def usable(column: pa.ListArray) -> list[bytes | None]:
    """The components of each vector as doubles; None for vectors that link with nothing."""
    v = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # no negative zeros; nulls are not finite
    at = column.offsets.to_numpy()
    bad, full = np.r_[0, np.cumsum(~np.isfinite(v))], np.r_[0, np.cumsum(v != 0)]
    ok = (bad[at[1:]] == bad[at[:-1]]) & (full[at[1:]] > full[at[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    raw = v.tobytes()
    return [raw[8 * x : 8 * y] if good else None for x, y, good in zip(at[:-1].tolist(), at[1:].tolist(), ok.tolist(), strict=True)]


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=-1, keepdims=True)  # very large and small components
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def choose_pivots(sample: list[bytes], n: int) -> dict[int, np.ndarray]:
    """For each dimension in the sample up to n unit vectors, none nearer to another than APART."""
    by_size: dict[int, list[np.ndarray]] = {}
    for raw in sample:
        by_size.setdefault(len(raw) // 8, []).append(np.frombuffer(raw))
    out = {}
    for dim, own in by_size.items():
        picked, k = np.empty((min(n, len(own)), dim)), 0
        for v in unit(np.stack(own)):
            if k >= len(picked):
                break
            if not k or (picked[:k] @ v).max() < APART:
                picked[k] = v
                k += 1
        out[dim] = np.vstack([picked[:k], _random_pivots(dim, max(NEAREST, min(n, LEAST_PIVOTS)) - k)])
    return out


def _random_pivots(dim: int, n: int) -> np.ndarray:
    return unit(np.random.default_rng(dim).normal(size=(max(n, 0), dim)))


def permutations(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(n, NEAREST) numbers of the nearest pivots of unit vectors, nearest first."""
    near = u @ pivots.T
    at = np.argpartition(-near, NEAREST - 1, axis=1)[:, :NEAREST] if len(pivots) > NEAREST else np.tile(np.arange(NEAREST), (len(u), 1))
    order = np.argsort(-np.take_along_axis(near, at, 1), axis=1, kind="stable")
    return np.take_along_axis(at, order, 1).astype(np.int32)


def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)): what permutations have in common: 2 * (NEAREST - the greater of the two ranks) for each common pivot.

    This is the greatest possible distance of ranks (Spearman's footrule) less the distance.
    """
    out = np.zeros((len(a), len(b)), dtype=np.uint8)
    for i in range(NEAREST):
        for j in range(NEAREST):
            out += (a[:, i, None] == b[None, :, j]) * np.uint8(2 * (NEAREST - max(i, j)))
    return out


def candidates(pivot: int, perm: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs (positions of one from left and one from right) that are candidates, with this pivot as the first common one."""
    i, j = np.nonzero(score(perm[left], perm[right]) >= NEAR)
    i, j = left[i], right[j]
    if left is right:
        i, j = i[i < j], j[i < j]
    out = [np.empty((0, 2), dtype=np.int64)]
    for s in range(0, len(i), 1 << 16):
        x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        common = np.where((perm[x][:, :, None] == perm[y][:, None, :]).any(2), perm[x], np.iinfo(np.int32).max)
        mine = common.min(1) == pivot
        out.append(np.stack([x[mine], y[mine]], axis=1))
    return np.concatenate(out)


def close(u: np.ndarray, pairs: np.ndarray, least: float) -> np.ndarray:
    """The pairs of unit vectors with at least this cosine."""
    parts = [pairs[s : s + (1 << 16)] for s in range(0, len(pairs), 1 << 16)]
    return np.concatenate([x[np.einsum("ij,ij->i", u[x[:, 0]], u[x[:, 1]]) >= least] for x in parts]) if parts else pairs


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first columns, as one table for each group of two rows or more."""
    held: list[pa.RecordBatch] = []

    def split(t: pa.Table) -> Iterator[pa.Table]:
        key = np.stack([t.column(k).to_numpy() for k in range(keys)], axis=1)
        edge = np.r_[np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]), len(key)].tolist()
        yield from (t.slice(s, e - s) for s, e in zip(edge, edge[1:], strict=False) if e - s > 1)

    for b in batches:
        if not len(b):
            continue
        held.append(b)
        last = [b.column(k)[len(b) - 1].as_py() for k in range(keys)]
        if [held[0].column(k)[0].as_py() for k in range(keys)] == last:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.logical_and.reduce([t.column(k).to_numpy() == last[k] for k in range(keys)])
        stop = int(np.flatnonzero(~same)[-1]) + 1
        yield from split(t.slice(0, stop))
        held = t.slice(stop).combine_chunks().to_batches()
    if held:
        yield from split(pa.Table.from_batches(held).combine_chunks())


def sides(rows: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Of a group (dim, pivot, i, j, mine, perm, ..): the pivot, the permutations, and positions of either block."""
    i, j, mine = rows.column(2)[0].as_py(), rows.column(3)[0].as_py(), rows.column(4).to_numpy()
    perm = np.frombuffer(b"".join(rows.column(5).to_pylist()), dtype=np.int32).reshape(-1, NEAREST)
    left = np.flatnonzero(mine == i)
    return rows.column(1)[0].as_py(), perm, left, left if i == j else np.flatnonzero(mine == j)


def tree(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    parent, out = list(range(n)), []
    for a, b in pairs.tolist():
        x, y = a, b
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[y] = x
            out.append((a, b))
    return out


def link_vectors(vectors: DataFrame, least: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors (vec_id, embedding).

    n_links counts other rows linked directly, copies too. Vectors that are null, empty, zero, or hold a null
    or non-finite component link with nothing; vectors of other lengths are never linked to each other. Rows
    may share a vec_id (each counts) or have none (component: the smallest id reachable, null if there is
    none; kept then false). Empty tables give no rows; further columns are not looked at.
    """
    spark = vectors.sparkSession
    for_python(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(usable(b.column(1)), pa.binary())], ["vec_id", "raw"])

    rows = cut(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(read, "vec_id long, raw binary"))
    # an entry for each distinct vector; its key is not null even if no row has an id
    entries = cut(rows.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")).withColumn("entry", F.coalesce("rep", -1 - F.shiftrightunsigned(F.xxhash64("raw"), 1))))
    n, longest = entries.agg(F.count("*"), F.coalesce(F.max(F.length("raw")), F.lit(8))).first()
    count = max(LEAST_PIVOTS, min(PIVOT_BYTES // longest, int(2 * n**0.5)))
    sample = [bytes(r.raw) for r in entries.orderBy(F.xxhash64("raw"), "raw").limit(max(min(SAMPLE, PIVOT_BYTES // longest), 2 * count)).select("raw").collect()]
    pivots = spark.sparkContext.broadcast(choose_pivots(sample, count))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(0).to_pylist()
            size = np.array([len(r) // 8 for r in raw])
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                perm = permutations(unit(np.stack([np.frombuffer(raw[i]) for i in at])), pivots.value.get(dim, _random_pivots(dim, LEAST_PIVOTS)))
                first = np.sort(perm, axis=1)[:, : NEAREST - SHARED + 1]
                said = pa.array([x.tobytes() for x in perm], pa.binary()).take(pa.array(np.repeat(np.arange(len(at)), first.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(first.size, dim), pa.int32()), pa.array(first.ravel(), pa.int32()), b.column(1).take(pa.array(np.repeat(at, first.shape[1]))), said], ["dim", "pivot", "entry", "perm"])

    listed = cut(entries.select("raw", "entry").mapInArrow(lists, "dim int, pivot int, entry long, perm binary"))
    length = cut(listed.groupBy("dim", "pivot").agg(F.count("*").alias("n")).select("dim", "pivot", F.ceil(F.col("n") / F.lit(block)).alias("blocks")))
    dealt = listed.join(length, ["dim", "pivot"]).withColumn("mine", F.pmod(F.xxhash64("entry"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0l, blocks - 1)")))
    groups = dealt.select("dim", "pivot", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "perm", "entry")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 4):
            some = np.unique(candidates(*sides(t)))
            if len(some):
                yield from t.take(pa.array(some)).combine_chunks().to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 4):
            yield _links(t, least)

    order = ["dim", "pivot", "i", "j"]
    asked = groups.repartition(*order).sortWithinPartitions(*order).mapInArrow(meet, "dim int, pivot int, i long, j long, mine long, perm binary, entry long")
    whole = cut(asked).join(entries.select("entry", "times", "raw"), "entry").select(*order, "mine", "perm", "entry", "times", "raw")
    found = cut(whole.repartition(*order).sortWithinPartitions(*order).mapInArrow(verify, "a long, b long, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("entry")).agg(F.sum("n").alias("n"))
    comp = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("entry"), "component")
    # entries without an id are negative; a component takes the smallest id that it has
    known = entries.join(comp, "entry", "left").withColumn("component", F.coalesce("component", "entry"))
    best = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(best, "component").join(counts, "entry", "left").select("raw", "component_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    out = rows.join(known, "raw", "left")
    free = F.col("raw").isNull()
    ids = F.when(free, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.when(free, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), ids.alias("component_id"), F.coalesce(F.col("vec_id") == ids, F.lit(False)).alias("kept"))


def _links(rows: pa.Table, least: float) -> pa.RecordBatch:
    """Of one pair of blocks: (entry, null, copies linked) and (entry, entry, 0) for a spanning forest."""
    ids, times = (rows.column(k).to_numpy() for k in (6, 7))
    u = unit(np.frombuffer(b"".join(rows.column(8).to_pylist())).reshape(len(rows), rows.column(0)[0].as_py()))
    pairs = close(u, candidates(*sides(rows)), least)
    n = np.bincount(pairs[:, 0], times[pairs[:, 1]], len(ids)) + np.bincount(pairs[:, 1], times[pairs[:, 0]], len(ids))
    some = np.flatnonzero(n)
    t = np.array(tree(len(ids), pairs), dtype=np.int64).reshape(-1, 2)
    a = np.r_[ids[some], ids[t[:, 0]]]
    b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[t[:, 1]], pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(np.r_[n[some], np.zeros(len(t))].astype(np.int64))], ["a", "b", "n"])


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link_vectors() of all embeddings; nulls, ties, repeated rows and empty tables as there."""
    return link_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
