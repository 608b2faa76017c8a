"""Proportional power flow: loads draw from all generators in inverse proportion to path resistance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltframe.functions import exprs
from voltframe.functions.sessions import LOCAL_EDGES, cut


def total_resistance(tree: DataFrame) -> DataFrame:
    """tree with the resistance of each shortest path."""
    return tree.withColumn("resistance", exprs.resistance(F.col("dist")))


def fractional_shares(tree: DataFrame, loads: DataFrame) -> DataFrame:
    """(root, node, load, share, demand) for loads (node, load): shares of a load over the roots sum to 1.

    A root at the load itself takes it all (shared equally if there are more such). Unreached loads give no row.
    """
    t = tree.join(loads.select("node", "load"), "node").select("root", "node", "load", exprs.resistance(F.col("dist")).alias("r"))
    w = Window.partitionBy("node")
    t = t.withColumn("here", F.sum((F.col("r") == 0).cast("int")).over(w))
    weight = F.when(F.col("here") > 0, (F.col("r") == 0).cast("double")).otherwise(1.0 / F.nullif(F.col("r"), F.lit(0.0)))
    t = t.withColumn("w", weight)
    share = F.col("w") / F.sum("w").over(w)
    return t.select("root", "node", "load", share.alias("share"), (share * F.col("load")).alias("demand"))


def supplied(shares: DataFrame, generators: DataFrame) -> DataFrame:
    """shares with ratio and supply: each generator (node, power) serves all its demand alike, as far as its power goes."""
    total = shares.groupBy("root").agg(F.sum("demand").alias("total"))
    g = generators.select(F.col("node").alias("root"), "power").join(total, "root")
    g = g.select("root", F.least(F.col("power") / F.nullif(F.col("total"), F.lit(0.0)), F.lit(1.0)).alias("ratio"))
    return shares.join(g, "root").withColumn("supply", F.col("demand") * F.col("ratio"))


def subtree_sums(tree: DataFrame, values: DataFrame, local: bool | None = None) -> DataFrame:
    """(root, edge, flow): over each edge of each shortest-path tree the sum of values (root, node, supply) beyond it.

    Trees of a bounded size are summed up in one group each; larger ones from the leaves, a level of hops a round.
    """
    t = tree.join(values.select("root", "node", "supply"), ["root", "node"], "left").select("root", "node", "parent", "edge", "hops", F.coalesce("supply", F.lit(0.0)).alias("supply"))
    if local is None:
        most = tree.groupBy("root").count().agg(F.max("count")).first()[0] or 0
        local = most <= LOCAL_EDGES
    if local:

        def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["hops", "node"]).reset_index(drop=True)
            place = pd.Series(np.arange(len(g)), index=g.node)
            up = place.reindex(g.parent.fillna(-1).astype("int64")).to_numpy()
            flow = g.supply.to_numpy(dtype=float).copy()
            hops = g.hops.to_numpy()
            for h in range(int(hops.max()), 0, -1):
                lo, hi = np.searchsorted(hops, [h, h + 1])
                np.add.at(flow, up[lo:hi].astype(int), flow[lo:hi])
            keep = hops > 0
            return pd.DataFrame({"root": key[0], "edge": g.edge[keep].astype("int64"), "flow": flow[keep]})

        return t.groupBy("root").applyInPandas(run, "root long, edge long, flow double")
    t = cut(t)
    height = t.agg(F.max("hops")).first()[0] or 0
    out, below = None, None
    for h in range(height, 0, -1):
        level = t.where(F.col("hops") == h)
        if below is not None:
            level = level.join(below, ["root", "node"], "left").withColumn("supply", F.col("supply") + F.coalesce("more", F.lit(0.0))).drop("more")
        level = cut(level)
        below = level.groupBy("root", F.col("parent").alias("node")).agg(F.sum("supply").alias("more"))
        flows = level.select("root", "edge", F.col("supply").alias("flow"))
        out = flows if out is None else out.unionAll(flows)
    return out


def edge_flows(tree: DataFrame, loads: DataFrame, generators: DataFrame, edges: DataFrame, local: bool | None = None) -> DataFrame:
    """(edge, flow, loss): magnitudes of all generators add up; edges without flow give no row."""
    tree = cut(tree)  # shares, the largest tree's size and the sums all read it
    s = supplied(fractional_shares(tree, loads), generators)
    per = subtree_sums(tree, s, local).groupBy("edge").agg(F.sum("flow").alias("flow")).where("flow > 0")
    return per.join(edges.select(F.col("id").alias("edge"), "length"), "edge").select("edge", "flow", exprs.power_loss(F.col("flow"), F.col("length")).alias("loss"))


def summary(flows: DataFrame, loads: DataFrame, generators: DataFrame) -> DataFrame:
    """One row: load, loss, loss_percent, power, generators, frequency."""
    f = flows.agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("loss"))
    n = loads.agg(F.coalesce(F.sum("load"), F.lit(0.0)).alias("load"))
    g = generators.agg(F.coalesce(F.sum("power"), F.lit(0.0)).alias("power"), F.count("*").alias("generators"))
    x = n.join(f).join(g)
    share = F.round(F.lit(100.0) * F.col("loss") / F.nullif(F.col("load") + F.col("loss"), F.lit(0.0)), 2)
    return x.select("load", "loss", share.alias("loss_percent"), "power", "generators", (exprs.frequency_drop(F.col("load") + F.col("loss"), F.col("power")) + F.lit(exprs.NOMINAL_HZ)).alias("frequency"))


def unserved(shares: DataFrame) -> DataFrame:
    """(node, load, left): what generators short of power leave of each load; from supplied()."""
    return shares.groupBy("node").agg(F.max("load").alias("load"), (F.max("load") - F.sum("supply")).alias("left"))


def path_losses(paths: DataFrame, flows: DataFrame, edges: DataFrame, extra: float) -> DataFrame:
    """(root, target, loss): what more flow (extra) over each path (root, target, edge) loses more on its lines, all in all."""
    return paths.where("edge is not null").join(_more_loss(flows, edges, extra), "edge").groupBy("root", "target").agg(F.sum("v").alias("loss"))


def _more_loss(flows: DataFrame, edges: DataFrame, extra: float) -> DataFrame:
    known = edges.select(F.col("id").alias("edge"), "length").join(flows.select("edge", "flow"), "edge", "left")
    return known.select("edge", exprs.marginal_loss(F.coalesce("flow", F.lit(0.0)), F.lit(extra), F.col("length")).alias("v"))


def tree_losses(tree: DataFrame, targets: DataFrame, flows: DataFrame, edges: DataFrame, extra: float) -> DataFrame:
    """path_losses() for targets (node) of a search tree, summed up along it: no path is ever rows."""
    from voltframe.operators.traverse import path_sums

    s = path_sums(tree, _more_loss(flows, edges, extra))
    return s.join(targets.select("node").distinct(), "node", "left_semi").select("root", F.col("node").alias("target"), F.col("v").alias("loss"))


def nearest_generator(tree: DataFrame) -> DataFrame:
    """(node, root, dist): the generator nearest by lines; ties go to the smaller id."""
    return tree.groupBy("node").agg(F.min_by(F.struct("root", "dist"), F.struct("dist", "root")).alias("x")).select("node", "x.root", "x.dist")


def histogram(values: DataFrame, column: str, n: int) -> DataFrame:
    """(bin, low, high, count, percent) of n bins of equal width from the least to the greatest value, both included."""
    span = values.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count(column).alias("all"))
    width = F.nullif(F.col("b") - F.col("a"), F.lit(0.0)) / n
    at = F.least(F.coalesce(F.floor((F.col(column) - F.col("a")) / width), F.lit(0)), F.lit(n - 1)).cast("int")
    each = values.where(F.col(column).isNotNull()).join(F.broadcast(span)).select(at.alias("bin"), "a", "b", "all")
    g = each.groupBy("bin").agg(F.count("*").alias("count"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("all").alias("all"))
    step = (F.col("b") - F.col("a")) / n
    return g.select("bin", (F.col("a") + step * F.col("bin")).alias("low"), (F.col("a") + step * (F.col("bin") + 1)).alias("high"), "count", (F.lit(100.0) * F.col("count") / F.col("all")).alias("percent"))


def decile_slice(flows: DataFrame, low: int = 5, high: int = 8) -> DataFrame:
    """Flows whose rank among the distinct values lies between two tenths, both ends included.

    Ranks are those of the distinct values: numbered without one task that sorts them all.
    """
    from voltframe.operators.components import numbered

    d = numbered(flows.select(F.round("flow", 9).alias("v")).distinct(), ["v"], "rank")
    g = d.agg(F.count("*").alias("g"))
    d = d.join(F.broadcast(g)).where(F.expr(f"rank between {low} * g div 10 and {high} * g div 10")).select("v")
    return flows.join(d, F.round("flow", 9) == F.col("v"), "left_semi")

