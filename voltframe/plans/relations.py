"""Queries of filters, scalar formulas, joins, aggregates and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltframe.functions import exprs
from voltframe.operators import flow, graph, relational
from voltframe.plans.base import ADJ, BOX, FLOW, GENS, IN_BOX, LOAD, STRICT, customers, demand, generators, query, r9, walk
from voltframe.sources import tables as T

SHOWN = "round(x, 9) AS x, round(y, 9) AS y"


@query("src_1_points", f"SELECT id, {SHOWN} FROM points", "points")
def _(s, d):
    return T.points(s, d).select("id", *r9("x", "y"))


@query("src_2_lines", "SELECT id, src, dst, round(length, 9) AS length, voltage FROM mesh", "mesh")
def _(s, d):
    return T.mesh(s, d).select("id", "src", "dst", *r9("length"), "voltage")


@query("flt_1_between", f"SELECT id FROM points WHERE {IN_BOX}", "points")
def _(s, d):
    return relational.points_between(T.points(s, d), BOX).select("id")


@query("flt_2_strictly_within", f"SELECT id FROM points WHERE {STRICT}", "points")
def _(s, d):
    return relational.points_strictly_within(T.points(s, d), BOX).select("id")


@query("flt_4_restricted_lines", f"+p AS (SELECT id FROM points WHERE {STRICT}) SELECT e.id, src, dst FROM mesh e JOIN p a ON a.id = src JOIN p b ON b.id = dst", "mesh")
def _(s, d):
    p = relational.points_strictly_within(T.points(s, d), BOX)
    return graph.induced(T.mesh(s, d), p.select(F.col("id").alias("node"))).select("id", "src", "dst")


@query("flt_5_with_load", f"+{LOAD} SELECT node, round(load, 9) AS load FROM demand", "points")
def _(s, d):
    return demand(s, d).select("node", *r9("load"))


@query("flt_6_induced", "SELECT id FROM mesh WHERE src < 1000000000 AND src % 2 = 0 AND dst < 1000000000 AND dst % 2 = 0", "mesh")
def _(s, d):
    return graph.induced(T.mesh(s, d), customers(s, d, 2)).select("id")


@query("flt_7_possible", "SELECT o_orderkey FROM orders, (SELECT count(*) AS n FROM customer) WHERE o_custkey <> (o_custkey * 31 + 7) % n")
def _(s, d):
    n = T.read(s, d, "customer").agg(F.count("*").alias("n"))
    e = T.read(s, d, "orders").join(F.broadcast(n)).selectExpr("o_orderkey", "o_custkey as src", "(o_custkey * 31 + 7) % n as dst")
    return relational.possible(e).select("o_orderkey")


@query("flt_8_short_lines", "SELECT id FROM mesh WHERE length < 1.5", "mesh")
def _(s, d):
    return relational.shorter(T.mesh(s, d), 1.5).select("id")


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in exprs.FUELS.items())


@query("flt_9_fuel", f"SELECT id, CASE naics_desc {_CASES} END AS fuel FROM sources", "sources")
def _(s, d):
    return T.sources(s, d).select("id", exprs.fuel_code(F.col("naics_desc")).alias("fuel"))


@query("mth_1_distance", "SELECT id, round(sqrt(x * x + y * y), 9) AS d FROM points", "points")
def _(s, d):
    return T.points(s, d).select("id", F.round(exprs.distance(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0)), 9).alias("d"))


@query("mth_2_buffer", "SELECT id, round(y + 0.25, 9) AS n, round(y - 0.25, 9) AS s, round(x + 0.25, 9) AS e, round(x - 0.25, 9) AS w FROM points", "points")
def _(s, d):
    b = T.points(s, d).select("id", exprs.buffer_box(F.col("x"), F.col("y"), 15.0).alias("b")).select("id", "b.*")
    return b.select("id", *r9("n", "s", "e", "w"))


@query("mth_3_line_distance", "SELECT id, round(abs((5 - 1) * (2 - y) - (1 - x) * (8 - 2)) / sqrt(52.0::DOUBLE), 9) AS d FROM points", "points")
def _(s, d):
    q = [F.lit(v) for v in (1.0, 2.0, 5.0, 8.0)]
    return T.points(s, d).select("id", F.round(exprs.line_distance(F.col("x"), F.col("y"), *q), 9).alias("d"))


@query("mth_4_5_6_losses", "SELECT id, round(length * 0.4247::DOUBLE, 9) AS resistance, round(voltage * voltage * 0.4247::DOUBLE * length * 0.001::DOUBLE, 9) AS loss, round(sqrt(2.0::DOUBLE / nullif(0.4247::DOUBLE * length * 0.001::DOUBLE, 0)), 9) AS carried, round(greatest(((voltage + 1) * (voltage + 1) - voltage * voltage) * 0.4247::DOUBLE * length * 0.001::DOUBLE, 0), 9) AS more FROM tree", "tree")
def _(s, d):
    e, size, v = T.tree(s, d), F.col("length"), F.col("voltage")
    return e.select("id", F.round(exprs.resistance(size), 9).alias("resistance"), F.round(exprs.power_loss(v, size), 9).alias("loss"), F.round(exprs.inverse_loss(F.lit(2.0), size), 9).alias("carried"), F.round(exprs.marginal_loss(v, F.lit(1.0), size), 9).alias("more"))


@query("mth_7_frequency_drop", "SELECT r_regionkey, round((p - l) / (p / 3.0::DOUBLE + l * 0.02::DOUBLE), 9) AS drop FROM (SELECT r_regionkey, 100.0::DOUBLE + r_regionkey AS p, 90.0::DOUBLE + 5 * r_regionkey AS l FROM region)")
def _(s, d):
    k = F.col("r_regionkey")
    return T.read(s, d, "region").select("r_regionkey", F.round(exprs.frequency_drop(90.0 + 5 * k, 100.0 + k), 9).alias("drop"))


@query("mth_8_9_sphere", "SELECT k, round(degrees(atan2(z, sqrt(x * x + y * y))), 9) AS lat, round(degrees(atan2(y, x)), 9) AS lon FROM (SELECT id % 5 AS k, avg(cos(radians(y + 40)) * cos(radians(x - 75))) AS x, avg(cos(radians(y + 40)) * sin(radians(x - 75))) AS y, avg(sin(radians(y + 40))) AS z FROM points GROUP BY 1)", "points")
def _(s, d):
    p = T.points(s, d).select((F.col("id") % 5).alias("k"), exprs.unit_xyz(F.col("y") + 40, F.col("x") - 75).alias("u"))
    m = p.groupBy("k").agg(*[F.avg(f"u.{c}").alias(c) for c in "xyz"])
    return m.select("k", exprs.lat_lon(F.col("x"), F.col("y"), F.col("z")).alias("p")).select("k", F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon"))


@query("mth_10_average", "SELECT round(avg(length), 9) AS length FROM mesh", "mesh")
def _(s, d):
    return relational.average(T.mesh(s, d), "length").select(*r9("length"))


@query("mth_11_colours", "SELECT p_partkey, '#' || lower(lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0')) AS code, r, g, b FROM (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b FROM part)")
def _(s, d):
    k = F.col("p_partkey")
    c = T.read(s, d, "part").select("p_partkey", exprs.hex_rgb(k * 7 % 256, k * 13 % 256, k * 29 % 256).alias("code"))
    return c.withColumn("x", exprs.rgb_of_hex(F.col("code"))).select("p_partkey", "code", *[F.col(f"x.{n}").cast("long").alias(n) for n in "rgb"])


@query("str_1_hour_stamp", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H') AS stamp FROM orders")
def _(s, d):
    return T.read(s, d, "orders").select("o_orderkey", exprs.hour_stamp(F.col("o_orderdate")).alias("stamp"))


@query("str_2_padded", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'nan' ELSE lpad(c_custkey::VARCHAR, 5, '0') END AS code FROM customer")
def _(s, d):
    k = F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey"))
    return T.read(s, d, "customer").select("c_custkey", exprs.padded(k, 5).alias("code"))


@query("str_3_tidy", "SELECT n_nationkey, CASE upper(trim(n_name)) WHEN 'FRANCE' THEN 'GAUL' ELSE upper(trim(n_name)) END AS name FROM nation")
def _(s, d):
    return T.read(s, d, "nation").select("n_nationkey", exprs.tidy_name(F.concat(F.lit("  "), F.lower("n_name")), {"FRANCE": "GAUL"}).alias("name"))


@query("str_4_query_and_wkt", "SELECT id, 'lat=' || (id % 90)::VARCHAR || '&lon=' || (id % 180)::VARCHAR AS q, printf('POINT(%.4f %.4f)', x, y) AS wkt FROM points", "points")
def _(s, d):
    i = F.col("id")
    return T.points(s, d).select("id", exprs.query_string(lat=i % 90, lon=i % 180).alias("q"), exprs.wkt_point(F.col("x"), F.col("y")).alias("wkt"))


@query("str_5_renamed", "SELECT p_partkey, list_aggregate(list_transform(string_split(replace(p_type, ' ', ','), ','), lambda x: CASE x WHEN 'STEEL' THEN 'iron' ELSE x END), 'string_agg', ',') AS names FROM part")
def _(s, d):
    return T.read(s, d, "part").select("p_partkey", exprs.renamed_list(F.replace("p_type", F.lit(" "), F.lit(",")), {"STEEL": "iron"}).alias("names"))


@query("str_6_from_name", "SELECT s_suppkey, regexp_extract(s_name, '([0-9]+)$', 1)::BIGINT AS number, substring(s_name, 1, 4) AS head FROM supplier")
def _(s, d):
    return relational.name_parts(T.read(s, d, "supplier").select("s_suppkey", "s_name"), "s_name", 4).select("s_suppkey", "number", "head")


@query("arr_1_stacked", "SELECT n_nationkey, n_name AS v FROM nation UNION ALL SELECT n_nationkey, n_regionkey::VARCHAR FROM nation")
def _(s, d):
    return relational.stacked(T.read(s, d, "nation"), "n_nationkey", ["n_name", "n_regionkey"])


@query("gen_1_placed_nodes", "SELECT c_custkey AS id, round(((c_custkey * 7919) % 10007) / 10007.0::DOUBLE, 9) AS x, round(((c_custkey * 104729) % 10009) / 10009.0::DOUBLE, 9) AS y, 10 AS load FROM customer")
def _(s, d):
    return relational.placed_nodes(T.read(s, d, "customer").select(F.col("c_custkey").alias("id"))).select("id", *r9("x", "y"), "load")


@query("jon_1_located_loads", f"SELECT l.id, name, {SHOWN} FROM loads l JOIN points p ON p.id = point_id WHERE {IN_BOX}", "points", "loads")
def _(s, d):
    return relational.located(T.loads(s, d), T.points(s, d), BOX).select("id", "name", *r9("x", "y"))


@query("jon_1_located_sources", f"SELECT o.id, name, round(oper_cap, 9) AS oper_cap FROM sources o JOIN points p ON p.id = point_id WHERE {IN_BOX}", "points", "sources")
def _(s, d):
    return relational.located(T.sources(s, d), T.points(s, d), BOX).select("id", "name", *r9("oper_cap"))


@query("jon_2_lines_touching", f"+p AS (SELECT id FROM points WHERE {IN_BOX}) SELECT id FROM mesh WHERE src IN (SELECT id FROM p) OR dst IN (SELECT id FROM p)", "mesh")
def _(s, d):
    return relational.lines_touching(T.mesh(s, d), T.points(s, d), BOX).select("id")


@query("jon_3_with_ends", "SELECT e.id, round(p.x, 9) AS x1, round(p.y, 9) AS y1, round(q.x, 9) AS x2, round(q.y, 9) AS y2 FROM mesh e JOIN points p ON p.id = src JOIN points q ON q.id = dst", "mesh")
def _(s, d):
    return relational.with_ends(T.mesh(s, d), T.points(s, d)).select("id", *r9("x1", "y1", "x2", "y2"))


@query("jon_4_node_loads", "SELECT p.id AS node, round(CASE WHEN p.id >= 1000000000 THEN 0 ELSE coalesce(max_peak_load, 1) END, 9) AS load FROM points p LEFT JOIN loads l ON l.point_id = p.id", "points", "loads")
def _(s, d):
    return relational.node_loads(T.points(s, d), T.loads(s, d), T.sources(s, d)).select("node", *r9("load"))


@query("jon_5_complete", "SELECT a.id AS src, b.id AS dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS length FROM points a JOIN points b ON a.id < b.id WHERE a.id >= 1000000000 AND b.id >= 1000000000", "points")
def _(s, d):
    return relational.complete_edges(T.points(s, d).where(f"id >= {T.SUPPLIERS}")).select("src", "dst", *r9("length"))


@query("jon_6_combinations", "SELECT a.r_regionkey::VARCHAR AS items FROM region a UNION ALL SELECT a.r_regionkey::VARCHAR || ',' || b.r_regionkey FROM region a, region b WHERE a.r_regionkey < b.r_regionkey UNION ALL SELECT a.r_regionkey::VARCHAR || ',' || b.r_regionkey || ',' || c.r_regionkey FROM region a, region b, region c WHERE a.r_regionkey < b.r_regionkey AND b.r_regionkey < c.r_regionkey")
def _(s, d):
    c = relational.combinations(T.read(s, d, "region").select(F.col("r_regionkey").alias("id")), 3)
    return c.select(F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


_NEAR = "near AS (SELECT c.id AS qid, first(p.id ORDER BY (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), p.id) AS pid, min(sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y))) AS dist FROM points c, points p WHERE c.id >= 1000000000 AND p.id < 1000000000 GROUP BY c.id)"


def _nearest(s, d):
    p = T.points(s, d)
    return relational.nearest(p.where(f"id >= {T.SUPPLIERS}").withColumnRenamed("id", "qid"), p.where(f"id < {T.SUPPLIERS}").withColumnRenamed("id", "pid"))


@query("jon_7_nearest", f"+{_NEAR} SELECT qid, pid, round(dist, 9) AS dist FROM near", "points")
def _(s, d):
    return _nearest(s, d).select("qid", "pid", *r9("dist"))


@query("jon_8_nearest_within", f"+{_NEAR} SELECT qid, pid FROM near WHERE dist < 0.3", "points")
def _(s, d):
    return _nearest(s, d).where("dist < 0.3").select("qid", "pid")


@query("jon_9_disconnected", "SELECT id FROM loads WHERE point_id NOT IN (SELECT src FROM mesh WHERE id >= 2000000000 UNION ALL SELECT dst FROM mesh WHERE id >= 2000000000)", "loads", "mesh")
def _(s, d):
    return relational.disconnected(T.loads(s, d), T.mesh(s, d).where("id >= 2000000000")).select("id")


@query("jon_10_closest_pair", f"+{_NEAR} SELECT qid AS a, pid AS b, round(dist, 9) AS dist FROM near ORDER BY near.dist, qid, pid LIMIT 1", "points")
def _(s, d):
    p = T.points(s, d)
    return relational.closest_pair(p.where(f"id >= {T.SUPPLIERS}"), p.where(f"id < {T.SUPPLIERS}")).select("a", "b", *r9("dist"))


@query("jon_11_nodes_near", "SELECT id, round(d, 9) AS dist FROM (SELECT id, abs((8 - 1) * (2 - y) - (1 - x) * (5 - 2)) / sqrt(58.0::DOUBLE) AS d FROM points WHERE x BETWEEN 0.25 AND 8.75 AND y BETWEEN 1.25 AND 5.75) WHERE d <= 0.75", "points")
def _(s, d):
    seg = s.createDataFrame([(0, 1.0, 2.0, 8.0, 5.0)], "segment int, x1 double, y1 double, x2 double, y2 double")
    return relational.nodes_near(T.points(s, d), seg, 0.75).select("id", *r9("dist"))


@query("jon_12_named_weights", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON substring(c_name, 10) = substring(s_name, 10)")
def _(s, d):
    c, p = T.read(s, d, "customer").select("c_custkey", "c_name"), T.read(s, d, "supplier").select("s_suppkey", "s_name")
    return relational.same_ending(c, "c_name", p, "s_name", 10).select("c_custkey", "s_suppkey")


@query("jon_14_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def _(s, d):
    of = lambda name: T.read(s, d, name)
    return relational.looked_up(of("customer"), (of("nation"), "n_nationkey", "c_nationkey"), (of("region"), "r_regionkey", "n_regionkey")).select("c_custkey", "n_name", "r_name")


@query("jon_15_missing_codes", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9800)")
def _(s, d):
    return relational.missing_codes(T.read(s, d, "nation"), "n_nationkey", T.read(s, d, "customer").where("c_acctbal > 9800"), "c_nationkey").select("n_nationkey")


@query("jon_16_common_nodes", "SELECT node FROM (SELECT src AS node FROM mesh UNION SELECT dst FROM mesh) INTERSECT SELECT src FROM mesh WHERE id >= 2000000000", "mesh")
def _(s, d):
    m = T.mesh(s, d)
    return graph.ends(m).intersect(m.where("id >= 2000000000").select(F.col("src").alias("node")))


@query("jon_17_adjacent", "SELECT DISTINCT dst AS node FROM mesh WHERE src = 5 UNION SELECT src FROM mesh WHERE dst = 5", "mesh")
def _(s, d):
    return graph.directed(T.mesh(s, d)).where("node = 5").select(F.col("other").alias("node")).distinct()


@query("agg_1_totals", f"+{GENS}, {LOAD} SELECT round((SELECT sum(load) FROM demand), 9) AS load, round((SELECT sum(power) FROM gens), 9) AS power", "sources")
def _(s, d):
    from voltframe.operators import report

    return report.totals(demand(s, d), generators(s, d)).select(*r9("load", "power"))


@query("agg_2_incident", "SELECT id FROM mesh WHERE src % 5 = 0 AND src < 1000000000 OR dst % 5 = 0 AND dst < 1000000000", "mesh")
def _(s, d):
    return graph.touching(T.mesh(s, d), customers(s, d, 5)).select("id")


@query("agg_3_4_summary", f"{FLOW} SELECT round(l, 9) AS load, round(x, 9) AS loss, round(100 * x / (l + x), 2) AS loss_percent, round(p, 9) AS power, 3::BIGINT AS generators, round(60 + (p - l - x) / (p / 3 + (l + x) * 0.02::DOUBLE), 9) AS frequency FROM (SELECT (SELECT sum(load) FROM demand) AS l, (SELECT sum(loss) FROM flows) AS x, (SELECT sum(power) FROM gens) AS p)", "sources", "tree", recursive=True)
def _(s, d):
    f = flows(s, d)
    return flow.summary(f, demand(s, d), generators(s, d)).select(*r9("load", "loss"), "loss_percent", *r9("power"), "generators", *r9("frequency"))


def search(s, d):
    from voltframe.operators import traverse

    return traverse.sssp(T.tree(s, d), generators(s, d))


def flows(s, d):
    return flow.edge_flows(search(s, d), demand(s, d), generators(s, d), T.tree(s, d))


_BINS = "SELECT least(floor((v - a) / ((b - a) / {n})), {n} - 1)::INTEGER AS bin, a, b, c FROM (SELECT length AS v, min(length) OVER () AS a, max(length) OVER () AS b, count(*) OVER () AS c FROM mesh)"


@query("agg_5_6_7_histogram", f"SELECT bin, round(a + (b - a) / 5 * bin, 9) AS low, round(a + (b - a) / 5 * (bin + 1), 9) AS high, count(*) AS count, round(100.0::DOUBLE * count(*) / c, 9) AS percent FROM ({_BINS.format(n=5)}) GROUP BY bin, a, b, c", "mesh")
def _(s, d):
    return flow.histogram(T.mesh(s, d), "length", 5).select("bin", *r9("low", "high"), "count", *r9("percent"))


@query("agg_8_total_length", "SELECT round(sum(length), 4) AS length FROM mesh", "mesh")
def _(s, d):
    return relational.total_length(T.mesh(s, d)).select(F.round("length", 4).alias("length"))


@query("agg_9_randic", "+deg AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM mesh UNION ALL SELECT dst FROM mesh) GROUP BY node) SELECT round(sum(1 / sqrt(a.k * b.k)), 9) AS randic FROM mesh JOIN deg a ON a.node = src JOIN deg b ON b.node = dst", "mesh")
def _(s, d):
    return graph.randic(T.mesh(s, d)).select(*r9("randic"))


@query("agg_10_degree", "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM mesh UNION ALL SELECT dst FROM mesh) GROUP BY node", "mesh")
def _(s, d):
    return graph.degree(T.mesh(s, d))


@query("agg_11_subtrees", f"+{ADJ}, {walk('SELECT 0::BIGINT AS node', True)}, x AS (SELECT w.node, w.edge, unnest(path) AS up, c_acctbal AS bal FROM walk w LEFT JOIN customer ON c_custkey = node), {LOAD} SELECT t.node, count(*) AS nodes, round(sum(length), 9) AS length, round(sum(coalesce(load, 0)), 9) AS load FROM x JOIN walk t ON t.edge = x.up JOIN tree ON tree.id = x.edge LEFT JOIN demand ON demand.node = x.node GROUP BY t.node", "tree", recursive=True)
def _(s, d):
    from voltframe.operators import report, traverse

    t = traverse.sssp(T.tree(s, d), s.range(1).select(F.col("id").alias("node")))
    return report.subtree_totals(t, demand(s, d), T.tree(s, d)).select("node", "nodes", *r9("length", "load"))


_MIX = "CASE fuel " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in exprs.FUEL_MIX.items()) + " END"


@query("agg_12_fuel_sample", f"+f AS (SELECT id, CASE naics_desc {_CASES} END AS fuel FROM sources) SELECT id, fuel FROM (SELECT id, fuel, row_number() OVER (PARTITION BY fuel ORDER BY (id * 7919) % 10007, id) AS place, count(*) OVER (PARTITION BY fuel) AS n FROM f) WHERE place <= floor(({_MIX})::DOUBLE * n + 1e-9)", "sources")
def _(s, d):
    return relational.fuel_sample(T.sources(s, d))


@query("agg_13_distinct_ends", "SELECT src AS node FROM mesh UNION SELECT dst FROM mesh", "mesh")
def _(s, d):
    return graph.ends(T.mesh(s, d))


@query("agg_15_simple_pairs", "SELECT min(id) AS id, least(src, dst) AS src, greatest(src, dst) AS dst FROM mesh WHERE src <> dst GROUP BY 2, 3", "mesh")
def _(s, d):
    return graph.simple_pairs(T.mesh(s, d)).select("id", "src", "dst")


@query("agg_16_popularity", f"+{ADJ}, {walk('SELECT 3::BIGINT AS node', True)}, v AS (SELECT unnest(path) AS edge FROM walk WHERE node < 1000000000), n AS (SELECT w.node, count(*) AS n FROM v JOIN walk w USING (edge) GROUP BY 1 UNION ALL SELECT 3, (SELECT count(*) FROM walk WHERE node < 1000000000)) SELECT node, n FROM n ORDER BY n DESC, node LIMIT 51", "tree", recursive=True)
def _(s, d):
    from voltframe.operators import traverse

    t = traverse.sssp(T.tree(s, d), s.createDataFrame([(3,)], "node long"))
    return relational.popularity(traverse.path_arrays(t, customers(s, d, 1)))


@query("agg_23_request_size", "SELECT (SELECT count(*) FROM supplier) * 4 * 2 * 8760 AS cells")
def _(s, d):
    return relational.request_size(T.read(s, d, "supplier"), 4, 2)


@query("srt_1_by_length", "SELECT id, row_number() OVER (ORDER BY length, id) AS place FROM mesh", "mesh")
def _(s, d):
    return relational.by_length(T.mesh(s, d))


@query("srt_2_decile_slice", f"{FLOW}, r AS (SELECT edge, dense_rank() OVER (ORDER BY round(flow, 9)) - 1 AS k FROM flows) SELECT edge FROM r, (SELECT count(DISTINCT k) AS g FROM r) WHERE k BETWEEN 5 * g // 10 AND 8 * g // 10", "sources", "tree", recursive=True)
def _(s, d):
    return flow.decile_slice(flows(s, d)).select("edge")


_TRIALS = "SELECT p_partkey AS trial, round(p_retailprice / 100, 2) AS loss_percent, p_size / 10.0::DOUBLE AS length FROM part"


@query("srt_3_4_trial_rank", f"SELECT trial, round(loss_percent ** 1.35 + loss_percent * length, 9) AS score FROM ({_TRIALS}) ORDER BY loss_percent ** 1.35 + loss_percent * length, trial LIMIT 10")
def _(s, d):
    t = T.read(s, d, "part").select(F.col("p_partkey").alias("trial"), F.round(F.col("p_retailprice") / 100, 2).alias("loss_percent"), (F.col("p_size") / 10.0).alias("length"))
    return relational.trial_rank(t).limit(10).select("trial", *r9("score"))


@query("srt_5_extremes", "SELECT min_by(id, (length, id)) AS shortest, max_by(id, (length, -id)) AS longest FROM mesh", "mesh")
def _(s, d):
    return relational.extremes(T.mesh(s, d))


@query("srt_6_two_farthest", f"+{GENS}, {ADJ}, {walk('SELECT node FROM gens')} SELECT root, node, round(dist, 9) AS dist, place FROM (SELECT root, node, dist, row_number() OVER (PARTITION BY root ORDER BY dist DESC, node) AS place FROM walk) WHERE place <= 2", "sources", "tree", recursive=True)
def _(s, d):
    return relational.top_farthest(search(s, d)).select("root", "node", *r9("dist"), F.col("place").cast("long").alias("place"))


@query("srt_7_flow_per_length", f"{FLOW} SELECT edge, round(flow / length, 9) AS ratio FROM flows JOIN tree ON id = edge WHERE length < 2.0", "sources", "tree", recursive=True)
def _(s, d):
    return relational.flow_per_length(flows(s, d), T.tree(s, d), 2.0).select("edge", *r9("ratio"))
