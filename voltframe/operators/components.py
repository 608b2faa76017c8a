"""Connected components and minimum spanning forests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltframe.functions.sessions import cut
from voltframe.operators.graph import directed, ends, induced, local_graph


class Union:
    """Disjoint sets: union by size, path halving. Roots are labels only; the smallest member names a set."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.count: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        if p.setdefault(x, x) == x:
            self.count.setdefault(x, 1)
            return x
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.count[a] < self.count[b]:
            a, b = b, a
        self.parent[b] = a
        self.count[a] += self.count.pop(b)
        return True

    def smallest(self) -> list[tuple[int, int]]:
        low: dict[int, int] = {}
        for x in self.parent:
            r = self.find(x)
            low[r] = min(low.get(r, x), x)
        return [(x, low[self.find(x)]) for x in self.parent]


#: Edges that one task joins up by itself.
PACK = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of one task as links of each node to the smallest one that it hangs together with."""
    sets = Union()
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sets.join(u, v)
    found = [(x, low) for x, low in sets.smallest() if x != low]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])


def star_components(edges: DataFrame, rounds: int = 60, pack: int = PACK) -> DataFrame:
    """(node, component) over edges (src, dst): rounds of large-star and small-star steps, checkpointed.

    First tasks join up to pack edges each by themselves; where one task is enough for all, that is the result.
    In the rounds neighbours hang onto the smallest node seen, so chains shrink by a constant factor a round. Minima
    are partial aggregates and the joins back may be split by skew: no node's neighbours come together in one place.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").cast("long").alias("u"), F.least("src", "dst").cast("long").alias("v"))
    e, seen = cut(e.distinct()), None
    n = e.count()
    e = cut((e.coalesce(1) if n <= pack else e.repartition(-(-n // pack), "v")).mapInArrow(_joined, "u long, v long"))
    for _ in range(rounds):
        if n <= pack:
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        e = cut(large.join(low, "u").select(F.explode(pair).alias("x")).select("x.u", "x.v").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(tops)


def components(edges: DataFrame, nodes: DataFrame | None = None, local: bool | None = None) -> DataFrame:
    """(node, component), component the smallest node; nodes (node) without an edge are their own."""
    e = induced(edges, nodes) if nodes is not None else edges
    rows = local_graph(e) if local is not False else None
    if rows is not None:
        u = Union()
        for _, a, b, _ in rows:
            u.join(a, b)
        found = edges.sparkSession.createDataFrame(u.smallest(), "node long, component long")
    else:
        found = star_components(e)
    every = nodes.select("node").distinct() if nodes is not None else ends(e)
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def largest(found: DataFrame) -> DataFrame:
    """Nodes (node) of the component with the most of them; ties go to the smallest."""
    top = found.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return found.join(F.broadcast(top.select("component")), "component", "left_semi").select("node")


def sets(found: DataFrame) -> DataFrame:
    """(component, nodes): members in order. A set is a row, so it has to fit in one."""
    return found.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("nodes"))


def spanning_forest(edges: DataFrame, local: bool | None = None, rounds: int = 64) -> DataFrame:
    """Edges of a minimum spanning forest; among equal lengths the smaller id.

    Small graphs: sorted edges and disjoint sets. Large ones: rounds in which every component takes its least
    outgoing edge and edges inside of components are dropped; their number halves at least each time.
    """
    rows = local_graph(edges) if local is not False else None
    spark = edges.sparkSession
    if rows is not None:
        u = Union()
        kept = [(i,) for i, a, b, _ in sorted(rows, key=lambda r: (r[3], r[0])) if a != b and u.join(a, b)]
        return edges.join(F.broadcast(spark.createDataFrame(kept, "id long")), "id", "left_semi").select(edges.columns)
    live = cut(edges.where("src <> dst").select("id", "src", "dst", "length", F.col("src").alias("a"), F.col("dst").alias("b")))
    picked = spark.createDataFrame([], "id long")
    for _ in range(rounds):
        out = live.select(F.col("a").alias("c"), "length", "id").unionAll(live.select(F.col("b").alias("c"), "length", "id"))
        best = cut(out.groupBy("c").agg(F.min_by("id", F.struct("length", "id")).alias("id")).select("id").distinct())
        if best.isEmpty():
            return edges.join(picked, "id", "left_semi").select(edges.columns)
        picked = cut(picked.unionAll(best))
        comp = star_components(live.join(best, "id", "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst")))
        for c in ("a", "b"):
            to = comp.select(F.col("node").alias(c), "component")
            live = live.join(to, c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
        live = cut(live.where("a <> b"))
    raise RuntimeError("spanning forest did not settle")


def euclidean_forest(points: DataFrame, rounds: int = 100) -> DataFrame:
    """(src, dst, length), src < dst: the minimum spanning tree of all pairs of points (id, x, y), ids below 2 ** 31; of equal lengths the smaller src, then dst.

    Pairs within a radius, joined by cells, hold the tree's edges up to that length; the radius doubles, and only pairs of
    parts that are still apart count, until all hang together. Points at one place hang onto the first of them. Few rounds
    are needed unless dense clusters lie far apart, whose points then meet in pairs.
    """
    from voltframe.functions import exprs
    from voltframe.operators.relational import _cell_sizes

    places = cut(points.groupBy("x", "y").agg(F.min("id").alias("a")))
    out = points.join(places, ["x", "y"]).where("id <> a").select(F.col("a").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("length"))
    p = cut(places.select(F.col("a").cast("long").alias("p"), F.col("a").cast("long").alias("c"), "x", "y"))
    n = p.count()
    size = _cell_sizes(p, []).first()["size"] if n else 1.0
    around = F.explode(F.expr("flatten(transform(sequence(-1l, 1l), a -> transform(sequence(-1l, 1l), b -> struct(a as a, b as b))))"))
    for _ in range(rounds):
        if n < 2:
            return out
        cell = lambda c: F.floor(F.col(c) / (size * (1 + 1e-9))).cast("long")  # noqa: B023, E731
        at = p.withColumn("cx", cell("x")).withColumn("cy", cell("y"))
        # a point whose nine cells hold its own part only meets no other
        cells = at.groupBy("cx", "cy").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).withColumn("o", around)
        mixed = cells.groupBy((F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("cx", "cy")
        live = cut(at.join(mixed, ["cx", "cy"], "left_semi"))
        q = live.withColumn("o", around).select(F.col("p").alias("p2"), F.col("c").alias("c2"), F.col("x").alias("x2"), F.col("y").alias("y2"), (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"))
        pairs = live.join(q, ["cx", "cy"]).where("p < p2 and c <> c2").withColumn("length", exprs.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))).where(F.col("length") <= size)
        e = cut(pairs.select((F.col("p") * (1 << 31) + F.col("p2")).alias("id"), F.col("c").alias("src"), F.col("c2").alias("dst"), "length", "p", "p2"))
        kept = cut(spanning_forest(e))
        out = out.unionAll(kept.select(F.col("p").alias("src"), F.col("p2").alias("dst"), "length"))
        found = kept.count()
        if found:
            to = components(kept.select("id", "src", "dst", "length"))
            p = cut(p.join(to.withColumnRenamed("node", "c"), "c", "left").select("p", F.coalesce("component", "c").alias("c"), "x", "y"))
        n, size = n - found, size * 2
    raise RuntimeError("points are too far apart for this grid")


def contract_chains(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """(id, src, dst, length): chains of nodes with two edges, none of them in keep (node), as single edges.

    The removable nodes' components are the chains. A chain ends at two kept nodes (chains that end at one, and
    rings without a kept node, vanish). Between two nodes only the shortest stays. Ids count from 0 by (src, dst).
    """
    simple = edges.where("src <> dst")
    d = degree_of(simple)
    gone = cut(d.where("degree = 2").select("node").join(keep.select("node"), "node", "left_anti"))
    inner = components(simple, gone)
    e = simple.join(inner.select(F.col("node").alias("src"), F.col("component").alias("cs")), "src", "left").join(inner.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst", "left")
    plain = e.where("cs is null and cd is null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "length")
    part = e.where("cs is not null or cd is not null").withColumn("chain", F.coalesce("cs", "cd"))
    a, b = F.when(F.col("cs").isNull(), F.col("src")), F.when(F.col("cd").isNull(), F.col("dst"))  # tips; a chain has at most two
    chain = part.groupBy("chain").agg(F.sum("length").alias("length"), F.min(F.least(a, b)).alias("src"), F.max(F.greatest(a, b)).alias("dst"))
    long = chain.where("src <> dst").select("src", "dst", "length")
    best = cut(plain.unionAll(long).groupBy("src", "dst").agg(F.min("length").alias("length")))
    return numbered(best, ["src", "dst"])


def degree_of(edges: DataFrame) -> DataFrame:
    return directed(edges).groupBy("node").agg(F.count("*").alias("degree"))


def numbered(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """rows with a dense number from 0 in the given order, without sorting all of them in one task.

    Rows are range-partitioned; each partition's offset comes from the counts of those before it.
    """
    from pyspark.sql import Window

    ranged = cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    count = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}
    offsets, total = [], 0
    for p in sorted(count):
        offsets.append((p, total))
        total += count[p]
    o = rows.sparkSession.createDataFrame(offsets, "_p int, _o long")
    n = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(F.broadcast(o), "_p").select((F.col("_o") + n - 1).alias(name), *rows.columns)
