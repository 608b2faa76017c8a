"""Summaries of a grid, and rows for a plot of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Colours from weak to strong flow (fixed values).
COLOURS = ("navy", "blue", "cyan", "green", "yellow", "orange", "red", "darkred")


def totals(loads: DataFrame, generators: DataFrame) -> DataFrame:
    """(load, power)"""
    return loads.agg(F.sum("load").alias("load")).join(generators.agg(F.sum("power").alias("power")))


def subtree_totals(tree: DataFrame, loads: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, nodes, length, load): of each node of a search tree, what hangs below it, itself included."""
    from voltframe.operators.flow import subtree_sums

    t = tree.join(loads.select("node", F.col("load").alias("own")), "node", "left").join(edges.select(F.col("id").alias("edge"), F.col("length")), "edge", "left")
    parts = {"nodes": F.lit(1.0), "length": F.coalesce("length", F.lit(0.0)), "load": F.coalesce("own", F.lit(0.0))}
    out = tree.where("edge is not null").select("root", "node", "edge")
    for name, value in parts.items():
        out = out.join(subtree_sums(tree, t.select("root", "node", value.alias("supply"))).withColumnRenamed("flow", name), ["root", "edge"])
    return out.select("root", "node", F.col("nodes").cast("long").alias("nodes"), "length", "load")


def info_lines(summary: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, line): the text of a report: lines and their length, load, loss, power and generators, frequency."""
    size = edges.agg(F.count("*").alias("lines"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"))
    said = [
        F.format_string("%d lines of %.2f in all", "lines", "length"),
        F.format_string("load %.2f, loss %.2f (%.2f %%)", "load", "loss", F.coalesce("loss_percent", F.lit(0.0))),
        F.format_string("power %.2f of %d generators", "power", "generators"),
        F.format_string("frequency %.4f", "frequency"),
    ]
    return summary.join(F.broadcast(size)).select(F.posexplode(F.array(*said)).alias("place", "line"))


def plot_segments(flows: DataFrame, edges: DataFrame, points: DataFrame, n: int = 10) -> DataFrame:
    """(edge, x1, y1, x2, y2, bin, colour): lines coloured by the bin of their flow."""
    from voltframe.operators.relational import with_ends

    span = flows.agg(F.min("flow").alias("a"), F.max("flow").alias("b"))
    at = F.least(F.floor((F.col("flow") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0)) * n), F.lit(n - 1)).cast("int")
    binned = flows.join(F.broadcast(span)).select("edge", F.coalesce(at, F.lit(0)).alias("bin"))
    colour = F.element_at(F.array(*[F.lit(c) for c in COLOURS]), (F.floor((F.col("bin") + 1) * len(COLOURS) / F.lit(n + 1)) + 1).cast("int"))
    return with_ends(edges, points).join(binned, F.col("id") == F.col("edge")).select("edge", "x1", "y1", "x2", "y2", "bin", colour.alias("colour"))


def untread(edges: DataFrame, flows: DataFrame) -> DataFrame:
    """Lines without flow."""
    return edges.join(flows.select(F.col("edge").alias("id")), "id", "left_anti")


def restricted(points: DataFrame, edges: DataFrame, flows: DataFrame, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points strictly within a box, lines between them, and their flows."""
    from voltframe.operators.graph import induced
    from voltframe.operators.relational import points_strictly_within

    p = points_strictly_within(points, box)
    e = induced(edges, p.select(F.col("id").alias("node")))
    return p, e, flows.join(e.select(F.col("id").alias("edge")), "edge", "left_semi")


def plot_script(segments: DataFrame, points: DataFrame | None = None, title: str = "grid") -> DataFrame:
    """(place, line): a plotting script of segments (edge, x1, y1, x2, y2, colour), and of points (id, x, y) as small circles.

    Lines come in order of their ids after the head, circles in order of theirs after them.
    """
    spark = segments.sparkSession
    head = spark.createDataFrame([(0, 0, f'set title "{title}"'), (0, 1, "unset key")], "part int, n long, line string")
    arrow = F.format_string('set arrow from %.4f,%.4f to %.4f,%.4f nohead lc rgb "%s"', "x1", "y1", "x2", "y2", "colour")
    out = head.unionAll(segments.select(F.lit(1), F.col("edge"), arrow))
    if points is not None:
        out = out.unionAll(points.select(F.lit(2), F.col("id"), F.format_string("set object circle at %.4f,%.4f size 0.02", "x", "y")))
    return out.select(F.struct("part", "n").alias("place"), "line")
