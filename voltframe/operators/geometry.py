"""Polylines and point sets: simplification, junctions, merging, hit tests, screen transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltframe.functions import exprs
from voltframe.operators.components import components


def simplified_places(x: list[float], y: list[float], eps: float, fixed: list[bool]) -> list[int]:
    """Places of the vertices that stay: the ends, fixed ones, and those farther than eps from the chord, again and again."""
    n = len(x)
    if n <= 2:
        return list(range(n))
    keep, work = {0, n - 1}, [(0, n - 1)]
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        at = next((i for i in range(a + 1, b) if fixed[i]), -1)
        if at < 0:
            dx, dy = x[b] - x[a], y[b] - y[a]
            size = (dx * dx + dy * dy) ** 0.5
            best = eps
            for i in range(a + 1, b):
                d = abs(dx * (y[a] - y[i]) - (x[a] - x[i]) * dy) / size if size else ((x[i] - x[a]) ** 2 + (y[i] - y[a]) ** 2) ** 0.5
                if d > best:
                    best, at = d, i
        if at >= 0:
            keep.add(at)
            work += [(a, at), (at, b)]
    return sorted(keep)


def smooth(lines: DataFrame, eps: float = 2e-4) -> DataFrame:
    """(line, seq, x, y) of lines (line, seq, x, y[, fixed]) that are left by Ramer, Douglas and Peucker's rule.

    A line is handled in one place, so it has to fit there. A closed line's chord is a point: distances are then to it.
    """
    fixed = F.col("fixed") if "fixed" in lines.columns else F.lit(False)
    v = lines.select(F.col("line").cast("long"), F.struct(F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), fixed.alias("fixed")).alias("v"))
    v = v.groupBy("line").agg(F.sort_array(F.collect_list("v")).alias("v")).select("line", *[F.col(f"v.{c}").alias(c) for c in ("seq", "x", "y", "fixed")])

    def run(batches):
        import pandas as pd

        for b in batches:
            out: dict[str, list] = {c: [] for c in ("line", "seq", "x", "y")}
            for line, seq, xs, ys, stays in zip(b.line.tolist(), b.seq, b.x, b.y, b.fixed, strict=True):
                x, y = xs.tolist(), ys.tolist()
                at = simplified_places(x, y, eps, stays.tolist())
                out["line"] += [line] * len(at)
                for c, of in (("seq", seq), ("x", x), ("y", y)):
                    out[c] += [of[k] for k in at]
            yield pd.DataFrame(out)

    # a row a line, and thousands of lines a batch: a group of its own for each line takes longer than its vertices
    return v.mapInPandas(run, "line long, seq long, x double, y double")


def junctions(lines: DataFrame) -> DataFrame:
    """(x, y, n): places that occur more than once."""
    return lines.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1")


def marked_junctions(lines: DataFrame) -> DataFrame:
    """lines with fixed: whether a vertex is a junction."""
    return lines.join(junctions(lines).select("x", "y", F.lit(True).alias("fixed")), ["x", "y"], "left").select("line", "seq", "x", "y", F.coalesce("fixed", F.lit(False)).alias("fixed"))


def simplify(lines: DataFrame, eps: float = 2e-3) -> DataFrame:
    """smooth() that keeps all junctions."""
    return smooth(marked_junctions(lines), eps)


def super_simplify(lines: DataFrame) -> DataFrame:
    """Only first and last vertices and junctions."""
    w = Window.partitionBy("line")
    ends = marked_junctions(lines).withColumn("a", F.min("seq").over(w)).withColumn("b", F.max("seq").over(w))
    return ends.where("fixed or seq = a or seq = b").select("line", "seq", "x", "y")


def line_edges(lines: DataFrame) -> DataFrame:
    """(line, seq, x1, y1, x2, y2, length): each vertex with the next one."""
    w = Window.partitionBy("line").orderBy("seq")
    e = lines.select("line", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")
    return e.withColumn("length", exprs.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


def line_colours(lines: DataFrame) -> DataFrame:
    """(line, colour): lines that share a vertex, directly or through others, have one colour, the smallest line."""
    p = lines.groupBy("x", "y").agg(F.min("line").alias("dst"))
    e = lines.join(p, ["x", "y"]).where("line <> dst").select(F.col("line").alias("src"), "dst").distinct()
    e = e.withColumn("id", F.lit(0).cast("long")).withColumn("length", F.lit(0.0))
    return components(e, lines.select(F.col("line").alias("node")).distinct()).select(F.col("node").alias("line"), F.col("component").alias("colour"))


#: Points of one tile of merge_points() where they lie evenly.
IN_TILE = 5000


def _group_heads(places: DataFrame, distance: float, rounds: int = 1000) -> DataFrame:
    """(id, x, y) of the points that no earlier head lies near, in order of ids (id, x, y), all at different places.

    Tiles are handled side by side, each with the points just outside of it: a point is a head if no earlier point near it
    can be one, and it is taken if an earlier head lies near. What hangs on points outside of its tile waits for the next
    round, whose tiles lie elsewhere. The first point left is settled in each round, and nearly all are in the first.
    """
    from voltframe.functions.sessions import cut
    from voltframe.operators.relational import IN_CELL, _cell_sizes

    cell = distance * (1 + 1e-9)
    wide = _cell_sizes(places, []).first()
    side = max(8 * cell, (wide["size"] if wide else 1.0) * (IN_TILE / IN_CELL) ** 0.5)

    def run(g):
        import pandas as pd

        heads: dict[tuple, list] = {}
        open_: dict[tuple, list] = {}
        out = []
        g = g.sort_values("id")
        for i, x, y, kind in zip(g.id.tolist(), g.x.tolist(), g.y.tolist(), g.kind.tolist(), strict=True):
            a, b = int(x // cell), int(y // cell)
            around = [(p, q) for p in (a - 1, a, a + 1) for q in (b - 1, b, b + 1)]
            near = lambda of: any(((x - u) * (x - u) + (y - v) * (y - v)) ** 0.5 < distance for k in around if k in of for u, v in of[k])  # noqa: B023, E731
            if kind == 2 or not near(heads):
                head = kind == 2 or (kind == 0 and not near(open_))
                (heads if head else open_).setdefault((a, b), []).append((x, y))
                if kind == 0:
                    out.append((i, x, y, head))
        return pd.DataFrame(out, columns=["id", "x", "y", "head"])

    left, heads = cut(places.select("id", "x", "y")), places.select("id", "x", "y").where("false")
    for n in range(rounds):
        off = side * (n % 3) / 3
        at = lambda c, by: F.floor((F.col(c) + off + by) / side).cast("long")  # noqa: B023, E731
        every = left.withColumn("kind", F.lit(0)).unionAll(heads.withColumn("kind", F.lit(2)))
        tiles = every.withColumn("tx", F.explode(F.array_distinct(F.array(at("x", -cell), at("x", 0.0), at("x", cell))))).withColumn("ty", F.explode(F.array_distinct(F.array(at("y", -cell), at("y", 0.0), at("y", cell)))))
        outside = (F.col("tx") != at("x", 0.0)) | (F.col("ty") != at("y", 0.0))
        dealt = tiles.withColumn("kind", F.when(outside & (F.col("kind") == 0), 1).otherwise(F.col("kind")))
        found = cut(dealt.groupBy("tx", "ty").applyInPandas(run, "id long, x double, y double, head boolean"))
        heads, left = heads.unionAll(found.where("head").drop("head")), found.where("not head").drop("head")
        if left.isEmpty():
            return heads
    raise RuntimeError("points did not settle")


def merge_points(points: DataFrame, distance: float) -> DataFrame:
    """(id, into, x, y): each point (id, x, y) with the group it merges into and the group's centroid.

    The greedy rule: in order of ids, a point not taken yet takes all later ones nearer than distance. So the points that
    take others are no nearer to each other than that, few lie near any point, and all others go to the first of these.
    """
    from voltframe.functions.sessions import cut

    own = points.select(F.col("id").cast("long").alias("id"), "x", "y")
    if distance <= 0:
        return own.select("id", F.col("id").alias("into"), "x", "y")
    placed = own.where("x is not null and y is not null")
    heads = cut(_group_heads(cut(placed.groupBy("x", "y").agg(F.min("id").alias("id"))), distance))
    size = distance * (1 + 1e-9)
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    around = F.explode(F.expr("flatten(transform(sequence(-1l, 1l), a -> transform(sequence(-1l, 1l), b -> struct(a as a, b as b))))"))
    h = heads.withColumn("o", around).select(F.col("id").alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1"), (cell("x") + F.col("o.a")).alias("cx"), (cell("y") + F.col("o.b")).alias("cy"))
    near = placed.withColumn("cx", cell("x")).withColumn("cy", cell("y")).join(h, ["cx", "cy"]).where((F.col("i") <= F.col("id")) & (exprs.distance(F.col("x1"), F.col("y1"), F.col("x"), F.col("y")) < distance))
    into = cut(near.groupBy("id").agg(F.min("i").alias("into"), F.first("x").alias("x"), F.first("y").alias("y")))
    mean = into.groupBy("into").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    alone = own.where("x is null or y is null").select("id", F.col("id").alias("into"), "x", "y")
    return into.select("id", "into").join(mean, "into").select("id", "into", "x", "y").unionAll(alone)


def merged_map(lines: DataFrame, eps: float, distance: float) -> tuple[DataFrame, DataFrame]:
    """Points (id, x, y) and edges (src, dst, length) of a map of lines (line, seq, x, y): lines are smoothed, then vertices near to each other merged.

    Vertices count from 0 by line and place; edges join merged points that follow each other on some line, each pair once.
    """
    from voltframe.operators.components import numbered

    v = numbered(smooth(lines, eps), ["line", "seq"])
    merged = merge_points(v.select("id", "x", "y"), distance)
    at = v.select("id", "line", "seq").join(merged, "id")
    w = Window.partitionBy("line").orderBy("seq")
    e = at.select(F.col("into").alias("a"), F.lead("into").over(w).alias("b")).where("b is not null and a <> b")
    points = merged.groupBy(F.col("into").alias("id")).agg(F.min("x").alias("x"), F.min("y").alias("y"))
    pairs = e.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    p, q = points.toDF("src", "x1", "y1"), points.toDF("dst", "x2", "y2")
    return points, pairs.join(p, "src").join(q, "dst").select("src", "dst", exprs.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("length"))


def connect(items: DataFrame, points: DataFrame, lines: DataFrame) -> DataFrame:
    """(src, dst, length): for each item's point that no line ends at, a line to the nearest point where one does."""
    from voltframe.operators.graph import ends
    from voltframe.operators.relational import disconnected, nearest

    loose = disconnected(items.select("point_id").distinct(), lines).join(points.withColumnRenamed("id", "point_id"), "point_id")
    on = points.join(ends(lines).withColumnRenamed("node", "id"), "id", "left_semi")
    n = nearest(loose.select(F.col("point_id").alias("qid"), "x", "y"), on.select(F.col("id").alias("pid"), "x", "y"))
    return n.select(F.col("qid").alias("src"), F.col("pid").alias("dst"), F.col("dist").alias("length"))


def hit(points: DataFrame, segments: DataFrame, x: float, y: float, radius: float = 3.0, tolerance: float = 5.0) -> DataFrame:
    """(kind, id, dist): the point under a place, else the segment (id, x1, y1, x2, y2) near it; at most one row."""
    px, py = F.lit(x), F.lit(y)
    a = points.select(F.lit("node").alias("kind"), "id", exprs.distance(F.col("x"), F.col("y"), px, py).alias("dist")).where(F.col("dist") <= radius)
    inside = px.between(F.least("x1", "x2") - tolerance, F.greatest("x1", "x2") + tolerance) & py.between(F.least("y1", "y2") - tolerance, F.greatest("y1", "y2") + tolerance)
    b = segments.where(inside).select(F.lit("edge").alias("kind"), "id", exprs.line_distance(px, py, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("dist")).where(F.col("dist") <= tolerance)
    return a.unionAll(b).orderBy(F.desc("kind"), "dist", "id").limit(1)


def padded_range(values: DataFrame, column: str, share: float = 0.1) -> DataFrame:
    """(low, high): least and greatest value, each a share of the range further out."""
    r = F.max(column) - F.min(column)
    return values.agg((F.min(column) - r * share).alias("low"), (F.max(column) + r * share).alias("high"))


def on_screen(points: DataFrame, width: float, height: float) -> DataFrame:
    """(id, sx, sy): points fitted into a screen, y downwards."""
    r = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    p = points.join(F.broadcast(r))
    sx = (F.col("x") - F.col("x0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0)) * width
    sy = F.lit(height) - (F.col("y") - F.col("y0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0)) * height
    return p.select("id", sx.alias("sx"), sy.alias("sy"))
