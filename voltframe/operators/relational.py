"""Filters, joins, ranking and sampling over points, lines, loads and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltframe.functions import exprs

Box = tuple[float, float, float, float]


def points_between(points: DataFrame, box: Box) -> DataFrame:
    """Points (id, x, y) in a box (n, s, e, w), its edges included."""
    return points.where(exprs.between_box(F.col("x"), F.col("y"), *box))


def points_strictly_within(points: DataFrame, box: Box) -> DataFrame:
    return points.where(exprs.strictly_within(F.col("x"), F.col("y"), *box))


def located(items: DataFrame, points: DataFrame, box: Box) -> DataFrame:
    """Items (…, point_id) whose point lies in a box, with its x and y."""
    p = points_between(points, box).select(F.col("id").alias("point_id"), "x", "y")
    return items.join(p, "point_id")


def lines_touching(lines: DataFrame, points: DataFrame, box: Box) -> DataFrame:
    """Lines with one end in a box at least, as a union of two semi-joins."""
    from voltframe.operators.graph import touching

    return touching(lines, points_between(points, box).select(F.col("id").alias("node")))


def with_ends(lines: DataFrame, points: DataFrame) -> DataFrame:
    """Lines with the coordinates of both ends (x1, y1, x2, y2)."""
    a = points.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = points.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return lines.join(a, "src").join(b, "dst").select(*lines.columns, "x1", "y1", "x2", "y2")


def node_loads(points: DataFrame, loads: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, load): a load of unknown size is 1; of several at a point the one with the greatest id; sources have 0, points without load too."""
    one = loads.groupBy(F.col("point_id").alias("node")).agg(F.max_by(F.coalesce("max_peak_load", F.lit(1.0)), "id").alias("load"))
    s = sources.select(F.col("point_id").alias("node"), F.lit(True).alias("source")).distinct()
    p = points.select(F.col("id").alias("node")).join(one, "node", "left").join(s, "node", "left")
    return p.select("node", F.when(F.col("source"), 0.0).otherwise(F.coalesce("load", F.lit(0.0))).alias("load"))


#: Rows of one block of paired().
BLOCK = 2000


def paired(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """All pairs of rows that meet a condition, with the columns of both; the two have no column in common.

    Both are dealt to blocks, and each pair of blocks is a group of its own: no task holds more than some blocks, and
    there are as many tasks as pairs of blocks, up to 2000. The work is quadratic all the same.
    """
    m, n = (max(1, -(-t.count() // BLOCK)) for t in (left, right))
    k = min(2000, m * n)
    blocks = lambda t, own, of, other, to: t.withColumn(own, F.pmod(F.xxhash64(*t.columns), F.lit(of)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(to - 1))))
    a = blocks(left, "_i", m, "_j", n).repartition(k, "_i", "_j")
    b = blocks(right, "_j", n, "_i", m).repartition(k, "_i", "_j")
    return a.join(b, ["_i", "_j"]).where(condition).drop("_i", "_j")


def complete_edges(points: DataFrame) -> DataFrame:
    """(src, dst, length) of all pairs of points, src < dst. As many rows as pairs, dealt out by pairs of blocks."""
    a, b = points.toDF("src", "x1", "y1"), points.toDF("dst", "x2", "y2")
    return paired(a, b, F.col("src") < F.col("dst")).select("src", "dst", exprs.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("length"))


def subsets(items: DataFrame, most: int) -> DataFrame:
    """(items) of all subsets of 1 to most of the ids (id), in order, however many there are."""
    from voltframe.functions.sessions import cut

    items = cut(items.select("id"))
    level = items.select(F.array("id").alias("items"))
    out = level
    for _ in range(most - 1):
        level = paired(level, items, F.col("id") > F.element_at("items", -1)).select(F.concat("items", F.array("id")).alias("items"))
        out = out.unionAll(level)
    return out


#: Ids of which combinations() makes all subsets; their number grows with a power of this.
MOST_ITEMS = 1000


def combinations(items: DataFrame, most: int) -> DataFrame:
    """(items) of all subsets of 1 to most of the ids (id) of a short list; more than MOST_ITEMS ids are refused."""
    if items.limit(MOST_ITEMS + 1).count() > MOST_ITEMS:
        raise ValueError(f"subsets of more than {MOST_ITEMS} items")
    level = items.select(F.array("id").alias("items"))
    out = level
    for _ in range(most - 1):
        level = level.join(items.select("id"), F.col("id") > F.element_at("items", -1)).select(F.concat("items", F.array("id")).alias("items"))
        out = out.unionAll(level)
    return out


def _cell(v: Column, size: Column | float) -> Column:
    return F.floor(v / size).cast("long")


#: Points that a cell of nearest()'s grid holds about, where they lie evenly.
IN_CELL = 4


def _cell_sizes(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, size): for each group the width of a cell with about IN_CELL points. The box is that of the middle four fifths both ways, so that a few far points don't widen all cells."""
    span = lambda c: F.percentile_approx(c, F.lit(0.9), F.lit(1000)) - F.percentile_approx(c, F.lit(0.1), F.lit(1000))
    s = points.groupBy(*by).agg((F.count("*") * 0.64).alias("n"), span("x").alias("w"), span("y").alias("h"))
    wide = F.greatest("w", "h")
    return s.select(*by, F.when((F.col("w") > 0) & (F.col("h") > 0), F.sqrt(F.col("w") * F.col("h") * IN_CELL / F.col("n"))).when(wide > 0, wide * IN_CELL / F.col("n")).otherwise(0.25).alias("size"))


def nearest(queries: DataFrame, points: DataFrame, size: float | None = None, rounds: int = 200, by: list[str] | None = None) -> DataFrame:
    """(qid, pid, dist): for each query (qid, x, y) the nearest point (pid, x, y) by the square of the distance; ties go to the smaller id.

    Points are joined by cells of a grid: first the nine cells around a query, then, for queries whose best is
    not certain yet, cells twice as wide, and so on. Cells are as wide as the points are dense (or size), so a query meets
    some tens of points however many there are; of points at one place only the first counts. With columns
    by, which both have, only points of a query's own group count; they come first in the result.
    """
    from voltframe.functions.sessions import cut

    by = by or []
    left, out = cut(queries.select(*by, "qid", F.col("x").alias("qx"), F.col("y").alias("qy"))), None
    points = cut(points.where("x is not null and y is not null").groupBy(*by, "x", "y").agg(F.min("pid").alias("pid")))
    if by:
        left = cut(left.join(points.select(*by).distinct(), by, "left_semi"))
    elif points.isEmpty():
        return left.select("qid", F.lit(None).cast("long").alias("pid"), F.lit(None).cast("double").alias("dist")).where("false")
    wide = F.lit(size) if size else F.col("size")
    if not size:
        sizes = _cell_sizes(points, by)
        if by:
            points, left = cut(points.join(sizes, by)), cut(left.join(sizes, by))
        else:
            wide = F.lit(sizes.first()["size"])
    own = [] if size or not by else ["size"]
    for n in range(rounds):
        s = wide * F.lit(2.0**n)
        p = points.select(*by, "pid", "x", "y", _cell(F.col("x"), s).alias("cx"), _cell(F.col("y"), s).alias("cy"))
        around = F.explode(F.expr("flatten(transform(sequence(-1l, 1l), a -> transform(sequence(-1l, 1l), b -> struct(a as a, b as b))))"))
        q = left.withColumn("o", around).select(*by, *own, "qid", "qx", "qy", (_cell(F.col("qx"), s) + F.col("o.a")).alias("cx"), (_cell(F.col("qy"), s) + F.col("o.b")).alias("cy"))
        d = q.join(p, [*by, "cx", "cy"]).select(*by, *own, "qid", "pid", exprs.square(F.col("qx"), F.col("qy"), F.col("x"), F.col("y")).alias("square"))
        best = cut(d.groupBy(*by, *own, "qid").agg(F.min_by(F.struct("pid", "square"), F.struct("square", "pid")).alias("b")).select(*by, *own, "qid", "b.pid", F.sqrt("b.square").alias("dist")))
        sure = best.where(F.col("dist") <= s * (1 - 1e-9)).select(*by, "qid", "pid", "dist")
        out = sure if out is None else out.unionAll(sure)
        left = cut(left.join(sure, [*by, "qid"], "left_anti"))
        if left.isEmpty():
            return out
    raise RuntimeError("points are too far apart for this grid")


def nearest_within(queries: DataFrame, points: DataFrame, cutoff: float) -> DataFrame:
    return nearest(queries, points).where(F.col("dist") < cutoff)


def disconnected(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Items (…, point_id) whose point is no end of a line."""
    from voltframe.operators.graph import ends

    return items.join(ends(lines).withColumnRenamed("node", "point_id"), "point_id", "left_anti").select(items.columns)


def closest_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, dist): the closest points of two sets (id, x, y); ties go to smaller ids."""
    n = nearest(left.select(F.col("id").alias("qid"), "x", "y"), right.select(F.col("id").alias("pid"), "x", "y"))
    return n.orderBy("dist", "qid", "pid").limit(1).select(F.col("qid").alias("a"), F.col("pid").alias("b"), "dist")


def closest_pairs(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, dist): the same for each group of two sets (by, id, x, y) that both have it."""
    n = nearest(left.select(*by, F.col("id").alias("qid"), "x", "y"), right.select(*by, F.col("id").alias("pid"), "x", "y"), by=by)
    best = n.groupBy(*by).agg(F.min_by(F.struct("qid", "pid", "dist"), F.struct("dist", "qid", "pid")).alias("m"))
    return best.select(*by, F.col("m.qid").alias("a"), F.col("m.pid").alias("b"), "m.dist")


def nodes_near(points: DataFrame, segments: DataFrame, distance: float) -> DataFrame:
    """(segment, id, dist): points in the box around each segment (segment, x1, y1, x2, y2), and that near to its line.

    A box is cut into grid cells so that the join is on equal cells, with the exact test behind it.
    """
    size = max(distance * 2, 1e-6)
    s = segments.withColumn("lx", F.least("x1", "x2") - distance).withColumn("hx", F.greatest("x1", "x2") + distance).withColumn("ly", F.least("y1", "y2") - distance).withColumn("hy", F.greatest("y1", "y2") + distance)
    s = s.withColumn("cx", F.explode(F.sequence(_cell(F.col("lx"), size), _cell(F.col("hx"), size)))).withColumn("cy", F.explode(F.sequence(_cell(F.col("ly"), size), _cell(F.col("hy"), size))))
    p = points.withColumn("cx", _cell(F.col("x"), size)).withColumn("cy", _cell(F.col("y"), size))
    near = s.join(p, ["cx", "cy"]).where(F.col("x").between(F.col("lx"), F.col("hx")) & F.col("y").between(F.col("ly"), F.col("hy")))
    d = exprs.line_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return near.select("segment", "id", d.alias("dist")).where(F.col("dist") <= distance)


def fuel_sample(sources: DataFrame, mix: dict[str, float] = exprs.FUEL_MIX) -> DataFrame:
    """(id, fuel): of each fuel floor(share * number) sources without replacement, the first by a hash of their id."""
    s = sources.select("id", exprs.fuel_code(F.col("naics_desc")).alias("fuel"))
    table = F.create_map(*[F.lit(v) for kv in mix.items() for v in kv])
    n = s.groupBy("fuel").agg(F.count("*").alias("n"))
    s = s.join(F.broadcast(n), "fuel").withColumn("place", F.row_number().over(Window.partitionBy("fuel").orderBy((F.col("id") * 7919) % 10007, "id")))
    return s.where(F.col("place") <= F.floor(F.try_element_at(table, F.col("fuel")) * F.col("n") + 1e-9)).select("id", "fuel")


def trial_rank(trials: DataFrame) -> DataFrame:
    """trials (trial, loss_percent, length) in order of l ** 1.35 + l * length, best first (rank)."""
    score = F.pow("loss_percent", F.lit(1.35)) + F.col("loss_percent") * F.col("length")
    return trials.withColumn("score", score).orderBy("score", "trial")


def flow_per_length(flows: DataFrame, edges: DataFrame, longest: float) -> DataFrame:
    """(edge, ratio): flow per length of lines shorter than a limit, least first."""
    e = edges.where(F.col("length") < longest).select(F.col("id").alias("edge"), "length")
    return flows.join(e, "edge").select("edge", (F.col("flow") / F.col("length")).alias("ratio")).orderBy("ratio", "edge")


def top_farthest(tree: DataFrame, n: int = 2) -> DataFrame:
    """(root, node, dist, place): the n farthest nodes of each root, one after the other by partial aggregates."""
    out, left = None, tree.select("root", "node", "dist")
    for place in range(1, n + 1):
        best = left.groupBy("root").agg(F.max_by(F.struct("node", "dist"), F.struct("dist", -F.col("node"))).alias("x")).select("root", "x.node", "x.dist", F.lit(place).alias("place"))
        out = best if out is None else out.unionAll(best)
        left = left.join(best.select("root", "node"), ["root", "node"], "left_anti")
    return out


def possible(edges: DataFrame) -> DataFrame:
    """Lines with two different ends."""
    return edges.where("src <> dst")


def shorter(edges: DataFrame, limit: float) -> DataFrame:
    """Lines shorter than a limit."""
    return edges.where(F.col("length") < limit)


def average(values: DataFrame, column: str) -> DataFrame:
    """One row: the mean of a column, null without values."""
    return values.agg(F.avg(column).alias(column))


def total_length(edges: DataFrame) -> DataFrame:
    """One row: the sum of all lengths, 0 without lines."""
    return edges.agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"))


def extremes(edges: DataFrame) -> DataFrame:
    """(shortest, longest): ids of the shortest and the longest line; ties go to the smaller id."""
    return edges.agg(F.min_by("id", F.struct("length", "id")).alias("shortest"), F.max_by("id", F.struct("length", -F.col("id"))).alias("longest"))


def by_length(edges: DataFrame) -> DataFrame:
    """(id, place): lines from the shortest on, counted from 1, without one task that sorts them all."""
    from voltframe.operators.components import numbered

    return numbered(edges.select("id", "length"), ["length", "id"], "place").select("id", (F.col("place") + 1).cast("long").alias("place"))


def line_details(edges: DataFrame) -> DataFrame:
    """(id, low, high, length): what an info box says of a line, the smaller end first."""
    return edges.select("id", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"), "length")


def sizes(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, rows in tables.items():
        n = rows.agg(F.count("*").alias(name))
        out = n if out is None else out.join(n)
    return out


def name_parts(items: DataFrame, name: str, head: int) -> DataFrame:
    """items with number (digits at the end of a name, null if there are none) and head (its first letters)."""
    digits = F.regexp_extract(name, r"([0-9]+)$", 1)
    return items.withColumn("number", F.nullif(digits, F.lit("")).cast("long")).withColumn("head", F.substring(name, 1, head))


def stacked(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, v): the columns of a table under each other, as text."""
    return table.select(key, F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("v"))


def placed_nodes(ids: DataFrame, load: int = 10) -> DataFrame:
    """(id, x, y, load): pseudorandom places in the unit square for ids (id), the same each time."""
    i = F.col("id")
    return ids.select("id", (i * 7919 % 10007 / 10007.0).alias("x"), (i * 104729 % 10009 / 10009.0).alias("y"), F.lit(load).alias("load"))


def same_ending(left: DataFrame, left_name: str, right: DataFrame, right_name: str, at: int) -> DataFrame:
    """Rows of two tables whose names agree from a place on (counted from 1)."""
    k = "_ending"
    return left.withColumn(k, F.substring(left_name, at, 1 << 20)).join(right.withColumn(k, F.substring(right_name, at, 1 << 20)), k).drop(k)


def looked_up(items: DataFrame, *tables: tuple[DataFrame, str, str]) -> DataFrame:
    """items joined to each table (table, its key, the items' column) in turn; items without a match stay."""
    for table, key, column in tables:
        items = items.join(table, F.col(key) == F.col(column), "left")
    return items


def missing_codes(codes: DataFrame, code: str, used: DataFrame, column: str) -> DataFrame:
    """Rows of codes whose code no row of used has in a column."""
    return codes.join(used.select(F.col(column).alias(code)), code, "left_anti").select(codes.columns)


def request_size(places: DataFrame, attributes: int, years: int, hours: int = 8760) -> DataFrame:
    """(cells): values that a download for all places would hold."""
    return places.agg((F.count("*") * attributes * years * hours).alias("cells"))


def popularity(edges_of_paths: DataFrame, top: int = 51) -> DataFrame:
    """(node, n): nodes that occur on most paths (nodes array)."""
    return edges_of_paths.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(top)
