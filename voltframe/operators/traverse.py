"""Breadth-first search and shortest paths from many roots at once.

Graphs of a bounded size are broadcast, and roots are dealt out to tasks that run Dijkstra's algorithm. Larger
ones are stripped of their branches first (Stripped); a core that is still large goes through rounds of joins in which only
rows improved last time spread (Bellman-Ford), checkpointed.
Both give the same rows: the shortest path, then the fewest hops, then the smallest predecessor.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltframe.functions.sessions import LOCAL_EDGES, cut, cut_by
from voltframe.operators.graph import directed, local_graph

SCHEMA = "root long, node long, dist double, hops long, parent long, edge long"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of SCHEMA, those without a predecessor with nulls."""
    out = pd.DataFrame(rows, columns=["root", "node", "dist", "hops", "parent", "edge"])
    top = out.parent < 0
    out["parent"], out["edge"] = out.parent.astype("Int64").mask(top), out.edge.astype("Int64").mask(top)
    return out


class Kernel:
    """Adjacency arrays of a small graph."""

    def __init__(self, rows: list[tuple]):
        ids, src, dst, length = (np.array(c) for c in zip(*rows, strict=True)) if rows else (np.empty(0, dtype=np.int64),) * 4
        nodes = np.unique(np.r_[src, dst]).astype(np.int64)
        a, b = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
        frm, to, eid, size = np.r_[a, b], np.r_[b, a], np.r_[ids, ids], np.r_[length, length]
        order = np.lexsort((eid, frm))
        self.names = nodes.tolist()
        self.nodes, self.start = nodes, np.searchsorted(frm[order], np.arange(len(nodes) + 1)).tolist()
        self.to, self.edge, self.length = to[order].tolist(), eid[order].tolist(), size[order].tolist()

    def reached(self, root: int) -> list[tuple]:
        """(root, node, dist, hops, parent, edge) of all nodes that a root reaches, -1 for none. Takes no longer than these."""
        at = int(np.searchsorted(self.nodes, root))
        if at >= len(self.nodes) or self.nodes[at] != root:
            return [(root, root, 0.0, 0, -1, -1)]
        names, best, heap = self.names, {}, [(0.0, 0, -1, at, -1)]
        while heap:
            d, hops, parent, v, e = heapq.heappop(heap)
            if v in best:
                continue
            own = names[v]
            best[v] = (root, own, d, hops, parent, e)
            for k in range(self.start[v], self.start[v + 1]):
                w = self.to[k]
                if w not in best:
                    heapq.heappush(heap, (d + self.length[k], hops + 1, own, w, self.edge[k]))
        return [best[v] for v in sorted(best)]

    def sssp(self, root: int) -> pd.DataFrame:
        return _frame(self.reached(root))

    def nearest_rows(self, labels: pd.DataFrame) -> pd.DataFrame:
        """Rows of SCHEMA, one for each node that labels (rows of SCHEMA) lead to: the least by distance, root, hops, predecessor and edge."""
        best: dict[int, tuple] = {}
        start = zip(labels.dist.tolist(), labels.root.tolist(), labels.hops.tolist(), labels.parent.fillna(-1).astype("int64").tolist(), labels.node.tolist(), labels.edge.fillna(-1).astype("int64").tolist(), strict=True)
        heap = list(start)
        heapq.heapify(heap)
        while heap:
            d, r, hops, parent, node, e = heapq.heappop(heap)
            if node in best:
                continue
            best[node] = (r, node, d, hops, parent, e)
            v = int(np.searchsorted(self.nodes, node))
            if v < len(self.nodes) and self.nodes[v] == node:
                for k in range(self.start[v], self.start[v + 1]):
                    w = int(self.nodes[self.to[k]])
                    if w not in best:
                        heapq.heappush(heap, (d + self.length[k], r, hops + 1, node, w, self.edge[k]))
        return _frame([*best.values()])

    def nearest(self, roots: list[int]) -> pd.DataFrame:
        """(node, root, dist): of these roots the nearest one of each node; ties go to the smaller one."""
        at = np.searchsorted(self.nodes, roots)
        inside = [(r, int(a)) for r, a in zip(roots, at.tolist(), strict=True) if a < len(self.nodes) and self.nodes[a] == r]
        best: list = [None] * len(self.nodes)
        heap = [(0.0, r, a) for r, a in inside]
        heapq.heapify(heap)
        while heap:
            d, r, v = heapq.heappop(heap)
            if best[v] is not None:
                continue
            best[v] = (d, r)
            for k in range(self.start[v], self.start[v + 1]):
                if best[self.to[k]] is None:
                    heapq.heappush(heap, (d + self.length[k], r, self.to[k]))
        seen = [i for i in range(len(best)) if best[i] is not None]
        alone = [r for r in roots if r not in {x for x, _ in inside}]
        return pd.DataFrame({"node": [*self.nodes[seen].tolist(), *alone], "root": [*(best[i][1] for i in seen), *alone], "dist": [*(best[i][0] for i in seen), *[0.0] * len(alone)]})


#: Edges down to which branches are stripped off a large graph; what is left is searched in one task.
CORE_EDGES = 100_000
#: Labels of so many rows are sent to all tasks rather than dealt out.
FEW_LABELS = 50_000


class Stripped:
    """A large graph without its branches: leaves are taken off in levels until the core fits a local kernel or has hardly any.

    Trees shrink by a constant share a level, so all levels together are about as large as the graph. levels have
    (leaf, nb, id, length), core has edges (id, src, dst, length). Of parallel edges the shortest stays; no self loops.
    """

    def __init__(self, edges: DataFrame, most: int):
        pair = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min(F.struct("length", "id")).alias("e"))
        live = cut(pair.select("e.id", F.col("src").cast("long"), F.col("dst").cast("long"), "e.length"))
        n, self.levels = live.count(), []
        while n > min(most, CORE_EDGES):
            one = directed(live).groupBy("node").agg(F.count("*").alias("n"), F.max(F.struct("other", "id", "length")).alias("e")).where("n = 1")
            # the ends of a line of its own are both leaves: one of them stays
            leaves = cut(one.groupBy("e.id").agg(F.max(F.struct(F.col("node").alias("leaf"), F.col("e.other").alias("nb"), F.col("e.length").alias("length"))).alias("l")).select("l.leaf", "l.nb", "id", "l.length"))
            gone = leaves.count()
            if gone:
                self.levels.append(leaves)
                live = cut(live.join(leaves.select("id"), "id", "left_anti"))
            if gone * 10 < n:
                break
            n -= gone
        self.core = live
        self.rows = local_graph(live, max(most, 1))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW_LABELS else df


def _searched(graph: Stripped, start: DataFrame, key: list[str], rounds: int) -> DataFrame:
    """The least rows (root, node, dist, hops, parent, edge) by key that a graph's edges lead to from start.

    Rows pass from leaves inwards, level by level; the core is searched; the outcome passes outwards again.
    """
    value = ["root", "node", "dist", "hops", "parent", "edge"]
    rank = F.struct("dist", "root", "hops", F.coalesce("parent", F.lit(-1)), F.coalesce("edge", F.lit(-1)))
    on = lambda end, other, frm: frm.select("root", F.col(other).alias("node"), (F.col("dist") + F.col("length")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col(end).alias("parent"), F.col("id").alias("edge"))
    labels, own = cut(start.select(*value)), []
    for level in graph.levels:
        few = _few(labels)
        at = cut(level.join(few, F.col("leaf") == F.col("node")))
        own.append(at.select(*value))
        rest = labels.join(_few(at.select("node")), "node", "left_anti").select(*value)
        moved = rest.unionAll(on("leaf", "nb", at))
        labels = cut(moved.groupBy(*key).agg(F.min_by(F.struct(*value), rank).alias("x")).select("x.*"))
    if graph.rows is None:
        d = cut_by(directed(graph.core), "node")
        known = _relaxed(labels, d, key, rounds)
    else:
        kernel = start.sparkSession.sparkContext.broadcast(Kernel(graph.rows))

        def one(g: pd.DataFrame) -> pd.DataFrame:
            return kernel.value.nearest_rows(g)

        parts = labels.groupBy("root").applyInPandas(one, SCHEMA) if "root" in key else labels.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda g: one(g.drop(columns="_g")), SCHEMA)
        known = parts
    known = cut(known)
    for level, mine in zip(reversed(graph.levels), reversed(own), strict=True):
        new = on("nb", "leaf", known.join(level, F.col("node") == F.col("nb")))
        if not mine.isEmpty():
            old = mine.select(*key, F.struct(*value).alias("o"), rank.alias("ro"))
            both = new.join(_few(old), key, "left")
            new = both.select(F.when(F.col("ro") <= rank, F.col("o")).otherwise(F.struct(*value)).alias("x")).select("x.*")
        known = known.unionAll(cut(new))
    return known


def _starts(roots: DataFrame) -> DataFrame:
    none, node = F.lit(None).cast("long"), F.col("node").cast("long")
    return roots.select(node.alias("root"), node.alias("node"), F.lit(0.0).alias("dist"), F.lit(0).cast("long").alias("hops"), none.alias("parent"), none.alias("edge")).distinct()


def stripped(edges: DataFrame, local: bool | None = None) -> Stripped | None:
    """What several searches of one large graph share; None for one that fits a local kernel."""
    return Stripped(edges, 0) if local is False else Stripped(edges, LOCAL_EDGES) if edges.count() > LOCAL_EDGES else None


def sssp(edges: DataFrame, roots: DataFrame, local: bool | None = None, rounds: int = 100_000, shape: Stripped | None = None) -> DataFrame:
    """(root, node, dist, hops, parent, edge) for each node that each root (node) reaches, itself included."""
    spark = edges.sparkSession
    shape = shape or (stripped(edges, local) if local is not True else None)
    if shape is None:
        kernel = spark.sparkContext.broadcast(Kernel(_local_rows(edges)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows: list[tuple] = []
            for b in batches:
                for r in b["node"].tolist():
                    rows += kernel.value.reached(r)
                    if len(rows) > 50_000:
                        yield _frame(rows)
                        rows = []
            if rows:
                yield _frame(rows)

        # a number of tasks of its own: few roots are few bytes, but not little work
        own = cut(roots.select(F.col("node").cast("long")).distinct())
        return own.repartition(max(1, min(256, own.count())), "node").mapInPandas(run, SCHEMA)
    return _searched(shape, _starts(roots), ["root", "node"], rounds)


def _local_rows(edges: DataFrame) -> list[tuple]:
    return [tuple(r) for r in edges.select("id", "src", "dst", "length").collect()]


def _all(pieces: list[DataFrame]) -> DataFrame:
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionAll(p)
    return out


def nearest_root(edges: DataFrame, roots: DataFrame, local: bool | None = None, rounds: int = 100_000, shape: Stripped | None = None) -> DataFrame:
    """(node, root, dist) for each node that any root (node) reaches: the nearest root; ties go to the smaller one.

    One search from all roots at once, however many there are.
    """
    spark = edges.sparkSession
    shape = shape or (stripped(edges, local) if local is not True else None)
    if shape is not None:
        return _searched(shape, _starts(roots), ["node"], rounds).select("node", "root", "dist")
    kernel = spark.sparkContext.broadcast(Kernel(_local_rows(edges)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [r for b in batches for r in b["node"].tolist()]
        if own:
            yield kernel.value.nearest(own)

    # a task with roots of its own; the parts' nearest roots are compared afterwards
    parts = roots.select(F.col("node").cast("long")).distinct().repartition("node").mapInPandas(run, "node long, root long, dist double")
    return parts.groupBy("node").agg(F.min_by(F.struct("root", "dist"), F.struct("dist", "root")).alias("x")).select("node", "x.root", "x.dist")


def _relaxed(start: DataFrame, d: DataFrame, key: list[str], rounds: int) -> DataFrame:
    """The least rows (root, node, dist, hops, parent, edge) by key that lines d lead to from start.

    Each round takes the rows improved last time a line further and keeps those that are better than all before.
    What was found is kept in pieces, one a round; only new rows move, and a round looks up its own keys in the pieces.
    """
    value = ["root", "node", "dist", "hops", "parent", "edge"]
    rank = F.struct("dist", "root", "hops", F.coalesce("parent", F.lit(-1)), F.coalesce("edge", F.lit(-1)))
    best = lambda rows: rows.groupBy(*key).agg(F.min_by(F.struct(*value), rank).alias("x")).select("x.*")
    pieces, front = [cut_by(start.select(*value), *key)], start
    for n in range(rounds):
        step = front.join(d, "node").select("root", F.col("other").alias("node"), (F.col("dist") + F.col("length")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("node").alias("parent"), F.col("id").alias("edge"))
        found = cut(best(step))
        known = _all(pieces).join(found.select(*key), key, "left_semi")
        old = known.groupBy(*key).agg(F.min(rank).alias("old"))
        front = cut(found.withColumn("now", rank).join(old, key, "left").where("old is null or now < old").select(*value))
        if front.isEmpty():
            return best(_all(pieces))
        pieces.append(front)
        if n % 8 == 7:
            pieces = [cut_by(best(_all(pieces)), *key)]
    raise RuntimeError("shortest paths did not settle")


def bfs(edges: DataFrame, roots: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(node, hops) from the nearest of all roots."""
    d, near = directed(edges).select("node", "other"), cut(roots.select("node").distinct().withColumn("hops", F.lit(0).cast("long")))
    front = near
    for hop in range(1, rounds):
        found = front.join(d, "node").select(F.col("other").alias("node")).distinct().join(near.select("node"), "node", "left_anti")
        front = cut(found.withColumn("hops", F.lit(hop).cast("long")))
        if front.isEmpty():
            return near
        near = cut(near.unionAll(front)) if hop % 8 == 0 else near.unionAll(front)
    raise RuntimeError("search did not end")


def bfs_edges(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, level): the step at which a search that visits each edge once comes to it: one more than its nearer end's hops."""
    hops = bfs(edges, roots)
    e = directed(edges).join(hops, "node")
    return e.groupBy("id").agg((F.min("hops") + 1).alias("level"))


def paths(tree: DataFrame, targets: DataFrame, rounds: int = 64) -> DataFrame:
    """(root, target, step, node, edge, cum) along shortest paths to targets (node), from the root (step 0) on.

    Predecessors are doubled, so as many rounds are needed as the longest path's hops have binary digits: after
    round k all predecessors less than 2 ** (k + 1) hops back are known.
    """
    t = targets.select(F.col("node").alias("target")).distinct()
    tree = cut(tree.select("root", "node", "parent", "edge", "hops", "dist"))
    found = cut(tree.join(t, tree.node == t.target).select("root", "target", "node"))
    up = cut(tree.where("parent is not null").select("root", "node", F.col("parent").alias("up")))
    for _ in range(rounds):
        if up.isEmpty():
            break
        more = found.join(up, ["root", "node"]).select("root", "target", F.col("up").alias("node"))
        found = cut(found.unionAll(more))
        up = cut(up.join(up.select("root", F.col("node").alias("up"), F.col("up").alias("higher")), ["root", "up"]).select("root", "node", F.col("higher").alias("up")))
    return found.join(tree, ["root", "node"]).select("root", "target", F.col("hops").alias("step"), "node", "edge", F.col("dist").alias("cum"))


def path_sums(tree: DataFrame, values: DataFrame, rounds: int = 64) -> DataFrame:
    """(root, node, v): for each node but the root the sum of values (edge, v) over its path.

    Predecessors and sums are doubled: rows are those of the tree in each round, never those of its paths.
    """
    up = cut(tree.where("parent is not null").join(values.select("edge", "v"), "edge", "left").select("root", "node", F.col("parent").alias("up"), F.coalesce("v", F.lit(0.0)).alias("v")))
    for _ in range(rounds):
        on = up.select("root", F.col("node").alias("up"), F.col("up").alias("higher"), F.col("v").alias("more"))
        up = cut(up.join(on, ["root", "up"], "left").select("root", "node", F.col("higher").alias("up"), (F.col("v") + F.coalesce("more", F.lit(0.0))).alias("v")))
        if up.where("up is not null").isEmpty():
            return up.select("root", "node", "v")
    raise RuntimeError("paths did not end")


def path_arrays(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """(root, target, edges, nodes, length, hops): the same, a row a path; from = to: an empty list of edges."""
    p = paths(tree, targets)
    x = p.groupBy("root", "target").agg(F.sort_array(F.collect_list(F.struct("step", "node", "edge"))).alias("x"), F.max("cum").alias("length"), F.max("step").alias("hops"))
    return x.select("root", "target", F.expr("transform(filter(x, e -> e.edge is not null), e -> e.edge)").alias("edges"), F.expr("transform(x, e -> e.node)").alias("nodes"), "length", "hops")


def farthest(tree: DataFrame, metric: str = "dist") -> DataFrame:
    """(root, node, dist, hops): the farthest node of each root; ties go to the smallest id."""
    return tree.groupBy("root").agg(F.max_by(F.struct("node", "dist", "hops"), F.struct(metric, -F.col("node"))).alias("x")).select("root", "x.*")


def longest_path(edges: DataFrame, start: DataFrame, local: bool | None = None) -> DataFrame:
    """(root, node, dist, hops): ends of the longest path of a tree, by two sweeps from start (node, one row)."""
    shape = stripped(edges, local) if local is not True else None
    first = cut(farthest(sssp(edges, start, local, shape=shape)).select("node"))
    return farthest(sssp(edges, first, local, shape=shape))


def median_node(edges: DataFrame, start: DataFrame, local: bool | None = None) -> DataFrame:
    """(node): on the longest path the node nearest to half its length; ties go to the smallest id."""
    shape = stripped(edges, local) if local is not True else None
    first = cut(farthest(sssp(edges, start, local, shape=shape)).select("node"))
    tree = cut(sssp(edges, first, local, shape=shape))
    end = farthest(tree)
    p = paths(tree, end.select("node")).join(end.select(F.col("root").alias("r"), F.col("dist").alias("total")), F.col("root") == F.col("r"))
    return p.groupBy("root").agg(F.min_by("node", F.struct(F.abs(F.col("cum") - F.col("total") / 2), "node")).alias("node")).select("node")


def group_distance(edges: DataFrame, start: DataFrame, group: DataFrame, members: DataFrame) -> DataFrame:
    """(node, dist): distance of start (node) from group: 0 inside, else the least to a member."""
    t = sssp(edges, start).join(members.select(F.col("node")), "node", "left_semi")
    inside = start.join(group, "node", "left_semi").select(F.col("node").alias("i"))
    best = t.groupBy("root").agg(F.min("dist").alias("dist"))
    return best.join(inside, F.col("root") == F.col("i"), "left").select(F.col("root").alias("node"), F.when(F.col("i").isNotNull(), 0.0).otherwise(F.col("dist")).alias("dist"))
