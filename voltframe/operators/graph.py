"""Undirected weighted graphs as edge tables (id, src, dst, length[, voltage]). Identity of nodes and edges is their id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltframe.functions.sessions import bounded, cut


def directed(edges: DataFrame) -> DataFrame:
    """(node, other, id, length): each edge from both ends; a self loop once."""
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "id", "length")
    back = edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), "id", "length")
    return there.unionAll(back)


def ends(edges: DataFrame) -> DataFrame:
    """Distinct nodes (node) of edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    n = nodes.select("node")
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select(edges.columns)


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with at least one end among nodes; two semi-joins rather than a join on either column."""
    n = nodes.select("node")
    one = edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").select(edges.columns)
    two = edges.join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select(edges.columns)
    return one.unionByName(two).dropDuplicates(["id"])


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree): incident edges, parallel ones too."""
    return directed(edges).groupBy("node").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(i, j, v): the 0/1 matrix as its ones; parallel edges fall together."""
    return directed(edges).select(F.col("node").alias("i"), F.col("other").alias("j"), F.lit(1).alias("v")).distinct()


def simple_pairs(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair, the one with the smallest id; no self loops."""
    e = edges.where("src <> dst").withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    first = e.groupBy("a", "b").agg(F.min_by(F.struct("id", "length"), "id").alias("e"))
    return first.select("e.id", F.col("a").alias("src"), F.col("b").alias("dst"), "e.length")


def border_nodes(edges: DataFrame, group: DataFrame) -> DataFrame:
    """Members of group (node) with a neighbour outside."""
    return _crossing(edges, group).select("node").distinct()


def nodes_beyond(edges: DataFrame, group: DataFrame) -> DataFrame:
    """Neighbours of group outside of it."""
    return _crossing(edges, group).select(F.col("other").alias("node")).distinct()


def _crossing(edges: DataFrame, group: DataFrame) -> DataFrame:
    g = group.select("node").distinct()
    return directed(edges).join(g, "node", "left_semi").join(g.withColumnRenamed("node", "other"), "other", "left_anti")


def ball(edges: DataFrame, seeds: DataFrame, steps: int) -> DataFrame:
    """(node, hops) within so many hops of any seed; no step: the seeds."""
    near, d = seeds.select("node").distinct().withColumn("hops", F.lit(0)), directed(edges).select("node", "other")
    front = near
    for hop in range(1, steps + 1):
        found = front.join(d, "node").select(F.col("other").alias("node")).distinct().join(near.select("node"), "node", "left_anti")
        front = cut(found.withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        near = near.unionAll(front)
    return near


def randic(edges: DataFrame, group: DataFrame | None = None) -> DataFrame:
    """(randic): sum of 1 / sqrt(product of degrees) over edges inside group; degrees are those of the whole graph."""
    d = degree(edges)
    e = induced(edges, group) if group is not None else edges
    e = e.join(d.select(F.col("node").alias("src"), F.col("degree").alias("du")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dv")), "dst")
    return e.agg(F.sum(1.0 / F.sqrt(F.col("du") * F.col("dv"))).alias("randic"))


def attach(edges: DataFrame, more: DataFrame) -> DataFrame:
    """edges and those of more whose id is new."""
    return edges.unionByName(more.join(edges.select("id"), "id", "left_anti"), allowMissingColumns=True)


def detach(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("id"), "id", "left_anti").select(edges.columns)


def replace_ends(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """edges with nodes renamed by mapping (old, new); unmapped ones stay."""
    out = edges
    for end in ("src", "dst"):
        m = mapping.select(F.col("old").alias(end), F.col("new").alias("_new"))
        out = out.join(m, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return out.select(edges.columns)


def local_graph(edges: DataFrame, most: int | None = None) -> list[tuple] | None:
    """(id, src, dst, length) of a graph small enough for a local kernel, else None."""
    e = edges.select("id", "src", "dst", "length")
    rows = bounded(e) if most is None else bounded(e, most)
    return None if rows is None else [tuple(r) for r in rows]
