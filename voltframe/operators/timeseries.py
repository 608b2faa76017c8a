"""Nodal price series: spines, bins, gaps, coverage, daylight saving time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine(spark, start: str, end: str, minutes: int) -> DataFrame:
    """(ts): a regular grid, both ends included."""
    return spark.sql(f"SELECT explode(sequence(timestamp'{start}', timestamp'{end}', interval {int(minutes)} minutes)) AS ts")


def node_spine(prices: DataFrame, start: str, end: str, minutes: int) -> DataFrame:
    """(node, ts): the grid of each node; the grid is made per node, not joined."""
    steps = F.expr(f"sequence(timestamp'{start}', timestamp'{end}', interval {int(minutes)} minutes)")
    return prices.select("node").distinct().select("node", F.explode(steps).alias("ts"))


def binned(ts: Column, minutes: int) -> Column:
    """Start of the bin of so many minutes."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / (minutes * 60)) * (minutes * 60))


def first_per_bin(prices: DataFrame, minutes: int) -> DataFrame:
    """(node, ts, lmp): of equal times the last value, of each bin the first time."""
    w = Window.partitionBy("node", "bin").orderBy("ts", F.desc("lmp"))
    b = prices.withColumn("bin", binned(F.col("ts"), minutes)).withColumn("n", F.row_number().over(w))
    return b.where("n = 1").select("node", F.col("bin").alias("ts"), "lmp")


def on_spine(prices: DataFrame, start: str, end: str, minutes: int) -> DataFrame:
    """(node, ts, lmp): series on the grid, null in gaps; what is off the grid is gone."""
    return node_spine(prices, start, end, minutes).join(prices, ["node", "ts"], "left").select("node", "ts", "lmp")


def filled(series: DataFrame, limit: int | None = None) -> DataFrame:
    """series with gaps filled in proportion to time; at most limit rows on from a known value, the last value carried on.

    Gaps before the first value stay.
    """
    w = Window.partitionBy("node").orderBy("ts")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("lmp").isNotNull(), F.struct(F.unix_timestamp("ts").alias("t"), "lmp", F.col("i")))
    s = series.withColumn("i", F.row_number().over(w))
    s = s.withColumn("p", F.last(known, ignorenulls=True).over(back)).withColumn("q", F.first(known, ignorenulls=True).over(ahead))
    t = F.unix_timestamp("ts")
    line = F.col("p.lmp") + (F.col("q.lmp") - F.col("p.lmp")) * (t - F.col("p.t")) / F.nullif(F.col("q.t") - F.col("p.t"), F.lit(0))
    value = F.coalesce(F.col("lmp"), line, F.col("p.lmp"))
    near = F.lit(True) if limit is None else (F.col("i") - F.col("p.i")) <= limit
    return s.select("node", "ts", F.when(F.col("lmp").isNotNull() | near, value).alias("lmp"))


def coverage(prices: DataFrame) -> DataFrame:
    """(node, points): known values of each node."""
    return prices.groupBy("node").agg(F.count("lmp").alias("points"))


def full_days(prices: DataFrame, per_day: int) -> DataFrame:
    """(day, nodes): nodes with all points of a day, at one of each time."""
    d = prices.where("lmp is not null").groupBy("node", F.to_date("ts").alias("day")).agg(F.count_distinct("ts").alias("n"))
    return d.where(F.col("n") >= per_day).groupBy("day").agg(F.count("*").alias("nodes"))


def full_time_nodes(prices: DataFrame, hours: int, minutes: int) -> DataFrame:
    """(node): nodes with hours * 60 / minutes known values."""
    return coverage(prices).where(F.col("points") == hours * 60 // minutes).select("node")


def missing_nodes(expected: DataFrame, prices: DataFrame) -> DataFrame:
    return expected.join(prices.where("lmp is not null").select("node"), "node", "left_anti").select("node").distinct()


#: Percentiles of a description (fixed values).
PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.95, 0.99)


def across_nodes(prices: DataFrame, every: Column) -> DataFrame:
    """(at, mean, median, p): over all values of a time mean, median, and exact percentiles with linear interpolation."""
    return prices.groupBy(every.alias("at")).agg(F.avg("lmp").alias("mean"), F.median("lmp").alias("median"), F.percentile("lmp", list(PERCENTILES)).alias("p"))


def location_index(places: DataFrame) -> DataFrame:
    """places (node, lat, lon) with latlonindex: a dense number of distinct places by lat and lon, from 0."""
    from voltframe.operators.components import numbered

    n = numbered(places.select("lat", "lon").distinct(), ["lat", "lon"], "latlonindex")
    return places.join(n, ["lat", "lon"])


def wide_to_long(wide: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return wide.unpivot(keys, columns, name, value)


def to_local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def shifted_in_dst(ts: Column, start: str, end: str) -> Column:
    """An hour earlier from start up to, but not at, end."""
    return F.when((ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp")), ts - F.expr("interval 1 hour")).otherwise(ts)


def tagged_fall_back(rows: DataFrame) -> DataFrame:
    """rows (node, ts, seq, lmp) with tag: of a time given twice the first half by seq is 'DST'."""
    w = Window.partitionBy("node", "ts")
    n = F.count("*").over(w)
    place = F.row_number().over(w.orderBy("seq"))
    return rows.withColumn("tag", F.when((n > 1) & (place <= n / 2), F.lit("DST")))


def label_times(labels: DataFrame, grid: DataFrame) -> DataFrame:
    """(label, ts): the n-th distinct label belongs to the n-th time of a day's grid."""
    from voltframe.operators.components import numbered

    return numbered(labels.select("label").distinct(), ["label"], "n").join(numbered(grid.select("ts"), ["ts"], "n"), "n").select("label", "ts")


def of_component(prices: DataFrame, column: str, component: str) -> DataFrame:
    """Rows of one kind of price."""
    return prices.where(F.col(column) == component)


def distinct_union(*tables: DataFrame) -> DataFrame:
    """Rows of all tables once, by column names; rows with a null are left out."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct().dropna()


def month(prices: DataFrame, start: str, end: str, margin_hours: int = 1) -> DataFrame:
    """Rows from start to end, and an hour to either side."""
    m = F.expr(f"interval {int(margin_hours)} hours")
    return prices.where(F.col("ts").between(F.lit(start).cast("timestamp") - m, F.lit(end).cast("timestamp") + m))


def sane_places(places: DataFrame) -> DataFrame:
    """Places of North America's west: -180 < lon < 0 and lat > 20, by node."""
    return places.where("lon > -180 and lon < 0 and lat > 20").orderBy("node")


def batches(ids: DataFrame, size: int) -> DataFrame:
    """(id, batch): distinct ids in batches of so many, in order."""
    from voltframe.operators.components import numbered

    n = numbered(ids.select("id").distinct(), ["id"], "n")
    return n.select("id", F.expr(f"n div {int(size)}").alias("batch"))


def check_rows(prices: DataFrame, expected: int) -> DataFrame:
    """(node, n): nodes whose number of rows is not as expected; none if all is well."""
    return prices.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") != expected)


def wide_full_nodes(prices: DataFrame) -> DataFrame:
    """(node): nodes with a value at every time that occurs."""
    n = prices.select("ts").distinct().agg(F.count("*").alias("all"))
    c = prices.where("lmp is not null").groupBy("node").agg(F.count_distinct("ts").alias("n"))
    return c.join(F.broadcast(n)).where("n = all").select("node")
