"""Queries of price series; the events table serves as prices, its users as nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltframe.operators import timeseries as ts
from voltframe.plans.base import query, r9
from voltframe.sources import tables as T

A, B = "2024-01-01 00:00:00", "2024-01-03 00:00:00"
_GRID = f"grid AS (SELECT unnest(generate_series(TIMESTAMP '{A}', TIMESTAMP '{B}', INTERVAL 60 MINUTE)) AS ts)"
_BIN = "bins AS (SELECT node, ts, lmp FROM (SELECT node, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '2000-01-01') AS ts, lmp, row_number() OVER (PARTITION BY node, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '2000-01-01') ORDER BY prices.ts, lmp DESC) AS n FROM prices) WHERE n = 1)"
_SPINE = f"{_GRID}, {_BIN}, on_grid AS (SELECT n.node, g.ts, lmp FROM (SELECT DISTINCT node FROM prices) n CROSS JOIN grid g LEFT JOIN bins b ON b.node = n.node AND b.ts = g.ts)"


def at(name: str = "ts"):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def shown(name: str = "ts") -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


def hourly(s, d):
    return ts.first_per_bin(T.prices(s, d).withColumn("ts", F.col("ts").cast("timestamp")), 60)


def gridded(s, d):
    return ts.on_spine(hourly(s, d), A, B, 60)


@query("ts_1_spine", f"WITH {_GRID} SELECT {shown()} FROM grid")
def _(s, d):
    return ts.spine(s, A, B, 60).select(at())


@query("ts_2_label_times", "SELECT n_name AS label, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (row_number() OVER (ORDER BY n_name) - 1), '%Y-%m-%d %H:%M:%S') AS ts FROM nation")
def _(s, d):
    return ts.label_times(T.read(s, d, "nation").select(F.col("n_name").alias("label")), ts.spine(s, A, "2024-01-02 23:00:00", 60)).select("label", at())


@query("ts_3_wide_to_long", "SELECT s_suppkey, 'nation' AS k, s_nationkey::DOUBLE AS v FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")
def _(s, d):
    w = T.read(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return ts.wide_to_long(w, ["s_suppkey"], ["nation", "balance"], "k", "v")


@query("ts_4_component", "SELECT event_id FROM events WHERE event_type = 'click'")
def _(s, d):
    return ts.of_component(T.read(s, d, "events"), "event_type", "click").select("event_id")


@query("ts_5_local", "SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def _(s, d):
    e = T.read(s, d, "events")
    return e.select("event_id", ts.to_local(F.col("ts").cast("timestamp"), "America/New_York").alias("ts")).select("event_id", at())


@query("ts_6_fall_back", "SELECT event_id, CASE WHEN n > 1 AND k <= n / 2 THEN 'DST' END AS tag FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, ts::DATE) AS n, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS k FROM events)")
def _(s, d):
    e = T.read(s, d, "events").select("event_id", F.col("user_id").alias("node"), F.to_date("ts").alias("ts"), F.col("event_id").alias("seq"))
    return ts.tagged_fall_back(e).select("event_id", "tag")


@query("ts_7_dst_shift", "SELECT event_id, strftime(CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' THEN ts - INTERVAL 1 HOUR ELSE ts END, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def _(s, d):
    e = T.read(s, d, "events")
    return e.select("event_id", ts.shifted_in_dst(F.col("ts").cast("timestamp"), "2024-01-10 00:00:00", "2024-01-20 00:00:00").alias("ts")).select("event_id", at())


@query("ts_8_bins", f"SELECT event_id, {shown()} FROM (SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') AS ts FROM events)")
def _(s, d):
    e = T.read(s, d, "events")
    return e.select("event_id", ts.binned(F.col("ts").cast("timestamp"), 5).alias("ts")).select("event_id", at())


@query("ts_9_13_first_per_bin", f"+{_BIN} SELECT node, {shown()}, round(lmp, 9) AS lmp FROM bins", "prices")
def _(s, d):
    return hourly(s, d).select("node", at(), *r9("lmp"))


@query("jon_13_ts_12_on_spine", f"+{_SPINE} SELECT node, {shown()}, round(lmp, 9) AS lmp FROM on_grid", "prices")
def _(s, d):
    return gridded(s, d).select("node", at(), *r9("lmp"))


_FILL = f"{_SPINE}, i AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts) AS k FROM on_grid), f AS (SELECT node, ts, lmp, k, last_value(CASE WHEN lmp IS NOT NULL THEN k END IGNORE NULLS) OVER b AS pk, last_value(lmp IGNORE NULLS) OVER b AS p, first_value(CASE WHEN lmp IS NOT NULL THEN k END IGNORE NULLS) OVER a AS qk, first_value(lmp IGNORE NULLS) OVER a AS q FROM i WINDOW b AS (PARTITION BY node ORDER BY ts ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY node ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
_VALUE = "coalesce(lmp, p + (q - p) * (k - pk) / nullif(qk - pk, 0), p)"


@query("ts_10_filled", f"+{_FILL} SELECT node, {shown()}, round({_VALUE}, 9) AS lmp FROM f", "prices")
def _(s, d):
    return ts.filled(gridded(s, d)).select("node", at(), *r9("lmp"))


@query("ts_11_filled_limit", f"+{_FILL} SELECT node, {shown()}, round(CASE WHEN lmp IS NOT NULL OR k - pk <= 12 THEN {_VALUE} END, 9) AS lmp FROM f", "prices")
def _(s, d):
    return ts.filled(gridded(s, d), 12).select("node", at(), *r9("lmp"))


@query("ts_14_month", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-04 23:00:00' AND TIMESTAMP '2024-01-10 01:00:00'")
def _(s, d):
    e = T.read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ts.month(e, "2024-01-05 00:00:00", "2024-01-10 00:00:00").select("event_id")


@query("ts_15_wrong_counts", "SELECT user_id AS node, count(*) AS n FROM events GROUP BY 1 HAVING count(*) <> 60")
def _(s, d):
    return ts.check_rows(T.prices(s, d), 60)


@query("ts_16_sane_places", "SELECT id AS node FROM (SELECT id, x * 20 - 150 AS lon, y * 8 AS lat FROM points) WHERE lon > -180 AND lon < 0 AND lat > 20", "points")
def _(s, d):
    p = T.points(s, d).select(F.col("id").alias("node"), (F.col("x") * 20 - 150).alias("lon"), (F.col("y") * 8).alias("lat"))
    return ts.sane_places(p).select("node")


@query("ts_17_union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT s_nationkey FROM supplier")
def _(s, d):
    a, b = T.read(s, d, "nation").select(F.col("n_regionkey").alias("k")), T.read(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return ts.distinct_union(a, b)


@query("ts_18_batches", "SELECT c_custkey AS id, (row_number() OVER (ORDER BY c_custkey) - 1) // 1000 AS batch FROM customer")
def _(s, d):
    return ts.batches(T.read(s, d, "customer").select(F.col("c_custkey").alias("id")), 1000)


@query("agg_17_coverage", f"+{_SPINE} SELECT node, count(lmp) AS points FROM on_grid GROUP BY node", "prices")
def _(s, d):
    return ts.coverage(gridded(s, d))


@query("agg_18_full_days", f"+{_BIN}, c AS (SELECT node, ts::DATE AS day, count(DISTINCT ts) AS n FROM bins GROUP BY 1, 2) SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS nodes FROM c WHERE n >= 2 GROUP BY 1", "prices")
def _(s, d):
    return ts.full_days(hourly(s, d), 2).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "nodes")


@query("agg_19_full_time", f"+{_BIN} SELECT node FROM bins GROUP BY node HAVING count(lmp) = 64", "prices")
def _(s, d):
    return ts.full_time_nodes(hourly(s, d), 64, 60)


_QS = ", ".join(f"round(quantile_cont(lmp, {p}), 9) AS p{round(p * 100)}" for p in ts.PERCENTILES)


@query("agg_20_across_nodes", f"+{_BIN} SELECT {shown()}, round(avg(lmp), 9) AS mean, round(median(lmp), 9) AS median, {_QS} FROM bins GROUP BY bins.ts", "prices")
def _(s, d):
    x = ts.across_nodes(hourly(s, d), F.col("ts"))
    return x.select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("ts"), *r9("mean", "median"), *[F.round(F.col("p")[i], 9).alias(f"p{round(p * 100)}") for i, p in enumerate(ts.PERCENTILES)])


@query("agg_21_missing_nodes", "SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def _(s, d):
    return ts.missing_nodes(T.read(s, d, "customer").select(F.col("c_custkey").alias("node")), T.prices(s, d))


@query("agg_22_location_index", "SELECT id AS node, dense_rank() OVER (ORDER BY floor(y), floor(x)) - 1 AS latlonindex FROM points", "points")
def _(s, d):
    p = T.points(s, d).select(F.col("id").alias("node"), F.floor("y").alias("lat"), F.floor("x").alias("lon"))
    return ts.location_index(p).select("node", "latlonindex")


@query("src_18_todo", "SELECT s_nationkey AS latlonindex, min(s_name) AS file FROM supplier GROUP BY 1 HAVING right(min(s_name), 1) <> '3'")
def _(s, d):
    from voltframe.sources import files

    w = T.read(s, d, "supplier").select(F.col("s_nationkey").alias("latlonindex"), F.col("s_name").alias("file"))
    return files.todo(w, w.where(F.col("file").endswith("3")).select("file"))


@query("snk_2_relocated", "SELECT id, CASE WHEN id % 10 = 0 THEN id + 1 ELSE point_id END AS point_id FROM loads", "loads")
def _(s, d):
    from voltframe.sources import files

    x = T.loads(s, d)
    return files.relocated(x, x.where("id % 10 = 0").select("id", (F.col("id") + 1).alias("new_point"))).select("id", "point_id")


@query("msc_20_full_nodes", "+b AS (SELECT DISTINCT node, time_bucket(INTERVAL 2880 MINUTE, ts, TIMESTAMP '1970-01-01') AS ts FROM prices) SELECT node FROM b GROUP BY node HAVING count(*) = (SELECT count(DISTINCT ts) FROM b)", "prices")
def _(s, d):
    return ts.wide_full_nodes(ts.first_per_bin(T.prices(s, d).withColumn("ts", F.col("ts").cast("timestamp")), 2880))
