"""Queries of traversal, components, power flow, clustering, siting, congestion, resilience and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltframe.operators import cluster, components, congestion, flow, geometry, graph, report, resilience, traverse
from voltframe.plans.base import ADJ, BOX, FLOW, GENS, LOAD, STRICT, customers, demand, generators, query, r9, walk
from voltframe.plans.relations import flows, search
from voltframe.sources import tables as T
from voltframe.sources.tables import SUPPLIERS

MADJ = "madj AS (SELECT id, src AS node, dst AS other, length FROM mesh UNION ALL SELECT id, dst, src, length FROM mesh WHERE src <> dst)"
_UNI = "SELECT DISTINCT node AS i, other AS j FROM madj"


def one(s, node: int):
    return s.createDataFrame([(node,)], "node long")


@query("grf_1_2_3_adjacency", f"+{MADJ} SELECT i, j, 1 AS v FROM ({_UNI})", "mesh")
def _(s, d):
    return graph.adjacency(T.mesh(s, d))


_BFS = "hop AS (SELECT 0::BIGINT AS node, 0 AS hops UNION SELECT m.other, h.hops + 1 FROM hop h JOIN {adj} m ON m.node = h.node WHERE h.hops < {most})"


@query("grf_4_edges_visited", f"+{ADJ}, {walk('SELECT 0::BIGINT AS node')} SELECT edge AS id, hops AS level FROM walk WHERE edge IS NOT NULL", "tree", recursive=True)
def _(s, d):
    return traverse.bfs_edges(T.tree(s, d), one(s, 0))


@query("grf_5_nodes_visited", f"+{ADJ}, {walk('SELECT 0::BIGINT AS node')} SELECT node, hops FROM walk", "tree", recursive=True)
def _(s, d):
    return traverse.bfs(T.tree(s, d), one(s, 0))


@query("grf_6_7_shortest_paths", f"+{MADJ}, near(node, dist) USING KEY (node) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION (SELECT m.other, min(n.dist + m.length) FROM near n JOIN madj m ON m.node = n.node LEFT JOIN recurring.near r ON r.node = m.other WHERE r.dist IS NULL OR n.dist + m.length < r.dist - 1e-12 GROUP BY m.other)) SELECT node, round(dist, 9) AS dist FROM near", "mesh", recursive=True)
def _(s, d):
    return traverse.sssp(T.mesh(s, d), one(s, 0)).select("node", *r9("dist"))


@query("grf_8_farthest", f"+{GENS}, {ADJ}, {walk('SELECT node FROM gens')} SELECT root, first(node ORDER BY dist DESC, node) AS node, round(max(dist), 9) AS dist FROM walk GROUP BY root", "sources", "tree", recursive=True)
def _(s, d):
    return traverse.farthest(search(s, d)).select("root", "node", *r9("dist"))


_FAR = f"+{ADJ}, {walk('SELECT 0::BIGINT AS node')}, one AS (SELECT node FROM walk ORDER BY dist DESC, node LIMIT 1), " + walk("SELECT node FROM one", True).replace("walk", "back")


@query("grf_9_longest_path", f"{_FAR} SELECT root, node, round(dist, 9) AS dist, hops FROM back ORDER BY dist DESC, node LIMIT 1", "tree", recursive=True)
def _(s, d):
    return traverse.longest_path(T.tree(s, d), one(s, 0)).select("root", "node", *r9("dist"), "hops")


@query("grf_10_12_median", f"{_FAR}, far AS (SELECT * FROM (SELECT * FROM back ORDER BY dist DESC, node LIMIT 1)) SELECT b.node FROM back b, far WHERE b.edge IS NULL OR list_contains(far.path, b.edge) ORDER BY abs(b.dist - far.dist / 2), b.node LIMIT 1", "tree", recursive=True)
def _(s, d):
    return traverse.median_node(T.tree(s, d), one(s, 0))


@query("grf_11_13_paths", f"+{ADJ}, {walk('SELECT 1::BIGINT AS node', True)} SELECT node AS target, array_to_string(path, ',') AS edges, hops, round(dist, 9) AS length FROM walk WHERE node < 1000000000", "tree", recursive=True)
def _(s, d):
    p = traverse.path_arrays(traverse.sssp(T.tree(s, d), one(s, 1)), customers(s, d, 1))
    return p.select("target", F.array_join(F.col("edges").cast("array<string>"), ",").alias("edges"), "hops", *r9("length"))


@query("grf_14_ball", f"+{MADJ}, {_BFS.format(adj='madj', most=3)} SELECT node, min(hops) AS hops FROM hop GROUP BY node", "mesh", recursive=True)
def _(s, d):
    return graph.ball(T.mesh(s, d), one(s, 0), 3)


_GROUP = "g AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 2 = 0)"


@query("grf_15_border", f"+{MADJ}, {_GROUP} SELECT DISTINCT node FROM madj WHERE node IN (FROM g) AND other NOT IN (FROM g)", "mesh")
def _(s, d):
    return graph.border_nodes(T.mesh(s, d), customers(s, d, 2))


@query("grf_16_beyond", f"+{MADJ}, {_GROUP} SELECT DISTINCT other AS node FROM madj WHERE node IN (FROM g) AND other NOT IN (FROM g)", "mesh")
def _(s, d):
    return graph.nodes_beyond(T.mesh(s, d), customers(s, d, 2))


@query("grf_17_18_group_distance", f"+{ADJ}, {walk('SELECT c_custkey AS node FROM customer WHERE c_custkey IN (3, 5, 20)')} SELECT root AS node, round(CASE WHEN root % 10 = 0 THEN 0 ELSE min(dist) END, 9) AS dist FROM walk WHERE node < 1000000000 AND node % 10 = 0 GROUP BY root", "tree", recursive=True)
def _(s, d):
    g = customers(s, d, 10)
    return traverse.group_distance(T.tree(s, d), s.createDataFrame([(3,), (5,), (20,)], "node long"), g, g).select("node", *r9("dist"))


@query("grf_19_attach_detach", "SELECT id FROM mesh WHERE NOT (id < 2000000000 AND id % 7 = 0)", "mesh")
def _(s, d):
    t, m = T.tree(s, d), T.mesh(s, d)
    return graph.attach(graph.detach(t, t.where("id % 7 = 0").select("id")), m.where("id >= 2000000000")).select("id")


@query("grf_20_replace_ends", "SELECT id, CASE WHEN src < 1000000000 AND src % 11 = 1 THEN src - 1 ELSE src END AS src, CASE WHEN dst < 1000000000 AND dst % 11 = 1 THEN dst - 1 ELSE dst END AS dst FROM mesh", "mesh")
def _(s, d):
    m = customers(s, d, 11, 1).select(F.col("node").alias("old"), (F.col("node") - 1).alias("new"))
    return graph.replace_ends(T.mesh(s, d), m).select("id", "src", "dst")


@query("grf_21_contracted", f"+{ADJ}, deg AS (SELECT node, count(*) AS k FROM adj GROUP BY node), gone AS (SELECT node FROM deg WHERE k = 2 AND node % 5 <> 0), chain AS (SELECT a.node AS src, a.other AS tip, a.length, a.id AS edge FROM adj a WHERE a.node NOT IN (FROM gone) UNION ALL SELECT c.src, a.other, c.length + a.length, a.id FROM chain c JOIN adj a ON a.node = c.tip AND a.id <> c.edge WHERE c.tip IN (FROM gone)) SELECT row_number() OVER (ORDER BY src, tip) - 1 AS id, src, tip AS dst, round(length, 9) AS length FROM (SELECT src, tip, min(length) AS length FROM chain WHERE tip NOT IN (FROM gone) AND src < tip GROUP BY src, tip)", "tree", recursive=True)
def _(s, d):
    t = T.tree(s, d)
    return components.contract_chains(t, graph.ends(t).where("node % 5 = 0")).select("id", "src", "dst", *r9("length"))


#: Components of the islands: a node's top is the customer whose edge upwards is missing, or customer 0.
_ROOTS = "up AS (SELECT c_custkey AS node, c_custkey AS top FROM customer WHERE c_custkey = 0 OR c_custkey % 97 = 0 UNION ALL SELECT c_custkey, u.top FROM up u JOIN customer c ON (c.c_custkey - 1) // 2 = u.node AND c.c_custkey % 97 <> 0), comp AS (SELECT node, top AS component FROM up UNION ALL SELECT s_suppkey + 1000000000, top FROM supplier, (SELECT count(*) AS n FROM customer), up WHERE up.node = s_suppkey % n)"


def island_components(s, d):
    return components.components(T.islands(s, d), T.points(s, d).select(F.col("id").alias("node")))


@query("cmp_1_components", f"+{_ROOTS} SELECT node, component FROM comp", "points", recursive=True)
def _(s, d):
    return island_components(s, d)


@query("cmp_2_sets", f"+{_ROOTS} SELECT component, count(*) AS n, max(node) AS last FROM comp GROUP BY component", "points", recursive=True)
def _(s, d):
    return components.sets(island_components(s, d)).select("component", F.size("nodes").cast("long").alias("n"), F.array_max("nodes").alias("last"))


@query("cmp_3_marked", "SELECT n_nationkey AS node, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS component FROM nation")
def _(s, d):
    n = T.read(s, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("src"), "n_regionkey"), n.select(F.col("n_nationkey").alias("dst"), "n_regionkey")
    e = a.join(b, "n_regionkey").where("src < dst").select(F.lit(0).alias("id"), "src", "dst", F.lit(0.0).alias("length"))
    c = components.components(e, n.select(F.col("n_nationkey").cast("long").alias("node")))
    return c.select(F.col("node").cast("int").alias("node"), F.col("component").cast("int").alias("component"))


@query("cmp_4_induced_components", "SELECT s_suppkey + 1000000000 AS node, s_suppkey + 1000000000 AS component FROM supplier", "points")
def _(s, d):
    return components.components(T.mesh(s, d), T.read(s, d, "supplier").select((F.col("s_suppkey") + SUPPLIERS).alias("node")))


@query("cmp_5_largest", f"+{_ROOTS} SELECT node FROM comp WHERE component = (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)", "points", recursive=True)
def _(s, d):
    return components.largest(island_components(s, d))


@query("cmp_6_7_8_spanning_tree", f"+p AS (SELECT s_suppkey AS id, x, y FROM supplier JOIN points ON points.id = s_suppkey + 1000000000), e AS (SELECT a.id AS src, b.id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS length FROM p a JOIN p b ON a.id < b.id), grow AS (SELECT 1 AS n, [0::BIGINT] AS inside, 0::BIGINT AS src, 0::BIGINT AS dst UNION ALL SELECT g.n + 1, list_append(g.inside, CASE WHEN list_contains(g.inside, k.src) THEN k.dst ELSE k.src END), k.src, k.dst FROM grow g, LATERAL (SELECT src, dst FROM e WHERE list_contains(g.inside, e.src) <> list_contains(g.inside, e.dst) ORDER BY length, src, dst LIMIT 1) k) SELECT src, dst FROM grow WHERE n > 1", "points", recursive=True)
def _(s, d):
    p = T.points(s, d).where(f"id >= {SUPPLIERS}").select((F.col("id") - SUPPLIERS).alias("id"), "x", "y")
    return components.euclidean_forest(p).select("src", "dst")


@query("cmp_9_line_colours", "+pts AS (SELECT DISTINCT line, x, y FROM polylines), col(line, colour) USING KEY (line) AS (SELECT DISTINCT line, line FROM pts UNION (SELECT b.line, min(c.colour) FROM col c JOIN pts a ON a.line = c.line JOIN pts b ON a.x = b.x AND a.y = b.y LEFT JOIN recurring.col r ON r.line = b.line WHERE c.colour < r.colour GROUP BY b.line)) SELECT line, colour FROM col", "polylines", recursive=True)
def _(s, d):
    return geometry.line_colours(T.polylines(s, d))


@query("flow_edges", f"{FLOW} SELECT edge, round(flow, 9) AS flow, round(loss, 9) AS loss FROM flows", "sources", "tree", recursive=True)
def _(s, d):
    return flows(s, d).select("edge", *r9("flow", "loss"))


@query("flw_1_2_resistance", f"+{GENS}, {ADJ}, {walk('SELECT node FROM gens')} SELECT root, node, round(dist * 0.4247::DOUBLE, 9) AS resistance, hops FROM walk", "sources", "tree", recursive=True)
def _(s, d):
    return flow.total_resistance(search(s, d)).select("root", "node", *r9("resistance"), "hops")


@query("flw_3_4_shares", f"{FLOW} SELECT root, node, round(share, 9) AS share, round(share * load, 9) AS demand FROM shares", "sources", "tree", recursive=True)
def _(s, d):
    return flow.fractional_shares(search(s, d), demand(s, d)).select("root", "node", *r9("share", "demand"))


@query("flw_5_ratios", f"{FLOW} SELECT root, round(ratio, 9) AS ratio FROM ratios", "sources", "tree", recursive=True)
def _(s, d):
    return flow.supplied(flow.fractional_shares(search(s, d), demand(s, d)), generators(s, d)).select("root", *r9("ratio")).distinct()


@query("flw_9_nearest_generator", f"+{GENS}, {ADJ}, {walk('SELECT node FROM gens')} SELECT node, first(root ORDER BY dist, root) AS root, round(min(dist), 9) AS dist FROM walk GROUP BY node", "sources", "tree", recursive=True)
def _(s, d):
    return flow.nearest_generator(search(s, d)).select("node", "root", *r9("dist"))


@query("flw_10_unserved", f"{FLOW} SELECT node, round(max(load) - sum(share * load * ratio), 9) AS missing FROM shares JOIN ratios USING (root) GROUP BY node", "sources", "tree", recursive=True)
def _(s, d):
    x = flow.supplied(flow.fractional_shares(search(s, d), demand(s, d)), generators(s, d))
    return flow.unserved(x).select("node", F.round("left", 9).alias("missing"))


@query("flw_11_untread", f"{FLOW} SELECT id FROM tree WHERE id NOT IN (SELECT edge FROM flows)", "sources", "tree", recursive=True)
def _(s, d):
    return report.untread(T.tree(s, d), flows(s, d)).select("id")


@query("flt_4_restricted_flows", f"{FLOW}, p AS (SELECT id FROM points WHERE {STRICT}) SELECT edge, round(flow, 9) AS flow FROM flows JOIN tree t ON t.id = edge WHERE src IN (FROM p) AND dst IN (FROM p)", "sources", "tree", recursive=True)
def _(s, d):
    return report.restricted(T.points(s, d), T.tree(s, d), flows(s, d), BOX)[2].select("edge", *r9("flow"))


@query("plot_segments", f"{FLOW}, b AS (SELECT edge, coalesce(least(floor((flow - min(flow) OVER ()) / nullif(max(flow) OVER () - min(flow) OVER (), 0) * 10), 9), 0)::INTEGER AS bin FROM flows) SELECT edge, bin, ['navy', 'blue', 'cyan', 'green', 'yellow', 'orange', 'red', 'darkred'][floor((bin + 1) * 8 / 11.0::DOUBLE)::INTEGER + 1] AS colour FROM b", "sources", "tree", recursive=True)
def _(s, d):
    return report.plot_segments(flows(s, d), T.tree(s, d), T.points(s, d)).select("edge", "bin", "colour")


_SEEDS = "(VALUES (0, 0::BIGINT), (1, 5::BIGINT), (2, 40::BIGINT), (3, 77::BIGINT)) AS v(cluster, node)"


def seeds(s):
    return s.createDataFrame([(0, 0), (1, 5), (2, 40), (3, 77)], "cluster int, node long")


@query("clu_4_5_voronoi", f"+{ADJ}, {walk(f'SELECT node FROM {_SEEDS}')} SELECT w.node, first(cluster ORDER BY dist, cluster) AS cluster, round(min(dist), 9) AS dist FROM walk w JOIN {_SEEDS} ON v.node = w.root GROUP BY w.node", "tree", recursive=True)
def _(s, d):
    return cluster.voronoi(T.tree(s, d), seeds(s)).select("node", "cluster", *r9("dist"))


@query("clu_2_11_clusters")
def _(s, d):
    t = T.tree(s, d)
    return cluster.voronoi(t, cluster.spread_seeds(t, customers(s, d, 1), 5)).select("node", "cluster", *r9("dist"))


@query("clu_12_cluster_medians")
def _(s, d):
    t = T.tree(s, d)
    return cluster.cluster_medians(t, cluster.voronoi(t, seeds(s)))


def suppliers(s, d):
    return T.points(s, d).where(f"id >= {SUPPLIERS}")


@query("clu_1_kmeans")
def _(s, d):
    return cluster.kmeans(T.points(s, d), 4).select("cluster", *r9("x", "y"))


_CENTRES = "(VALUES (0, 2.0::DOUBLE, 2.0::DOUBLE), (1, 5.0::DOUBLE, 7.0::DOUBLE), (2, 8.0::DOUBLE, 3.0::DOUBLE)) AS c(cluster, cx, cy)"
_PRED = f"pred AS (SELECT id, x, y, first(cluster ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), cluster) AS cluster, min(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS dist FROM points, {_CENTRES} GROUP BY id, x, y)"


def centres(s):
    return s.createDataFrame([(0, 2.0, 2.0), (1, 5.0, 7.0), (2, 8.0, 3.0)], "cluster int, x double, y double")


@query("clu_3_7_predict", f"+{_PRED} SELECT id, cluster, round(dist, 9) AS dist FROM pred", "points")
def _(s, d):
    return cluster.predict(T.points(s, d), centres(s)).select("id", "cluster", *r9("dist"))


@query("clu_6_9_ranked", f"+{_PRED} SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY dist, id) AS place FROM pred", "points")
def _(s, d):
    return cluster.ranked_members(cluster.predict(T.points(s, d), centres(s))).select("cluster", "id", F.col("place").cast("long").alias("place"))


@query("clu_8_silhouette", f"+{_PRED}, q AS (SELECT * FROM pred), m AS (SELECT a.id, a.cluster AS c, b.cluster AS o, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM q a, q b GROUP BY 1, 2, 3), ab AS (SELECT id, max(d) FILTER (c = o) AS a, min(d) FILTER (c <> o) AS b FROM m GROUP BY id) SELECT round(avg((b - a) / greatest(a, b)), 9) AS silhouette FROM ab", "points")
def _(s, d):
    p = T.points(s, d)
    near = cluster.predict(p, centres(s)).select("id", "cluster")
    return cluster.silhouette(p.join(near, "id")).select(*r9("silhouette"))


@query("clu_10_scaled", "SELECT id, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 9) AS x, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 9) AS y FROM points", "points")
def _(s, d):
    return cluster.scaled(T.points(s, d), ["x", "y"]).select("id", *r9("x", "y"))


@query("gen_2_sited")
def _(s, d):
    return cluster.site_generators(T.tree(s, d), customers(s, d, 1), 60)


@query("gen_3_grown", "SELECT id AS node, round(greatest(p, least(p + 4, p + 5, 200)), 9) AS power FROM (SELECT id, oper_cap * 30 AS p FROM sources)", "sources")
def _(s, d):
    return cluster.grown(T.sources(s, d).select(F.col("id").alias("node"), (F.col("oper_cap") * 30).alias("power")), 4).select("node", *r9("power"))


@query("sit_1_on_premises")
def _(s, d):
    t = T.tree(s, d)
    return cluster.site_on_premises(t, graph.ball(t, one(s, 0), 4).select("node"), one(s, 0))


@query("sit_2_new_location", "+c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM points), n AS (SELECT id, row_number() OVER (ORDER BY sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), id) AS k FROM points, c) SELECT round(cx, 9) AS x, round(cy, 9) AS y, (SELECT id FROM n WHERE k = 1) AS first, (SELECT id FROM n WHERE k = 2) AS second FROM c", "points")
def _(s, d):
    return cluster.site_new_location(T.points(s, d)).select(*r9("x", "y"), "first", "second")


@query("cng_1_mid_flow_groups", f"{FLOW}, r AS (SELECT edge, dense_rank() OVER (ORDER BY round(flow, 9)) - 1 AS k FROM flows), m AS (SELECT src, dst FROM r JOIN tree t ON t.id = edge, (SELECT count(DISTINCT k) AS g FROM r) WHERE k BETWEEN 5 * g // 10 AND 8 * g // 10), n AS (SELECT src AS node FROM m UNION SELECT dst FROM m), e AS (SELECT src AS a, dst AS b FROM tree WHERE src IN (FROM n) AND dst IN (FROM n)), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), col(node, component) USING KEY (node) AS (SELECT node, node FROM n UNION (SELECT w.b, min(c.component) FROM col c JOIN both_ways w ON w.a = c.node LEFT JOIN recurring.col k ON k.node = w.b WHERE c.component < k.component GROUP BY w.b)) SELECT node, component FROM col", "sources", "tree", recursive=True)
def _(s, d):
    return congestion.mid_flow_groups(flows(s, d), T.tree(s, d))


_MID = "r AS (SELECT edge, dense_rank() OVER (ORDER BY round(flow, 9)) - 1 AS k FROM flows), m AS (SELECT src, dst FROM r JOIN tree t ON t.id = edge, (SELECT count(DISTINCT k) AS g FROM r) WHERE k BETWEEN 5 * g // 10 AND 8 * g // 10), n AS (SELECT src AS node FROM m UNION SELECT dst FROM m), e AS (SELECT src AS a, dst AS b, length FROM tree WHERE src IN (FROM n) AND dst IN (FROM n)), both_ways AS (SELECT a, b, length FROM e UNION ALL SELECT b, a, length FROM e), col(node, component) USING KEY (node) AS (SELECT node, node FROM n UNION (SELECT w.b, min(c.component) FROM col c JOIN both_ways w ON w.a = c.node LEFT JOIN recurring.col k ON k.node = w.b WHERE c.component < k.component GROUP BY w.b))"
_WALK = "{name} AS (SELECT component AS root, node, 0.0::DOUBLE AS dist, NULL::BIGINT AS parent, [node]::BIGINT[] AS nodes, [0.0::DOUBLE] AS dists FROM ({start}) UNION ALL SELECT w.root, a.b, w.dist + a.length, w.node, list_append(w.nodes, a.b), list_append(w.dists, w.dist + a.length) FROM {name} w JOIN both_ways a ON a.a = w.node WHERE w.parent IS NULL OR a.b <> w.parent)"


@query("cng_2_bounds", f"{FLOW}, {_MID}, {_WALK.format(name='w1', start='SELECT component, min(node) AS node FROM col GROUP BY component')}, far AS (SELECT root AS component, max_by(node, (dist, -node)) AS node FROM w1 GROUP BY root), {_WALK.format(name='w2', start='SELECT component, node FROM far')}, fin AS (SELECT root, max_by(nodes, (dist, -node)) AS nodes, max_by(dists, (dist, -node)) AS dists, max(dist) AS total FROM w2 GROUP BY root), mid AS (SELECT root AS component, min_by(node, (abs(cum - total / 2), node)) AS node FROM (SELECT root, total, unnest(nodes) AS node, unnest(dists) AS cum FROM fin) GROUP BY root), near AS (SELECT node, min_by(root, (dist, root)) AS root, min_by(hops, (dist, root)) AS hops FROM walk GROUP BY node) SELECT component, node, root, hops FROM mid JOIN near USING (node)", "sources", "tree", recursive=True)
def _(s, d):
    t, tree = T.tree(s, d), search(s, d)
    groups = congestion.mid_flow_groups(flows(s, d), t)
    return congestion.bounds(congestion.group_centres(groups, t), tree)


@query("cng_3_link_along_line")
def _(s, d):
    t = T.tree(s, d)
    left, right = (graph.ball(t, one(s, n), 2).select("node") for n in (3, 60))
    return congestion.link_along_line(left, right, t, T.points(s, d), 0.3).select("a", "b", *r9("length"))


@query("cng_4_relief_lines")
def _(s, d):
    lines = congestion.relief_lines(flows(s, d), T.tree(s, d), T.points(s, d), search(s, d))
    return lines.select("component", "generator", "a", "b", *r9("length", "cost"))


def candidates(s, d):
    """Tie lines, one for each pair of nodes; those shorter than the ceiling are tried."""
    return graph.simple_pairs(T.mesh(s, d).where("id >= 2000000000"))


_CAND = "cand AS (SELECT min(id) AS id FROM mesh WHERE id >= 2000000000 AND src <> dst GROUP BY least(src, dst), greatest(src, dst) HAVING min(length) < 0.7)"


@query("cng_5_trials", f"+{_CAND} SELECT id::VARCHAR AS items FROM cand UNION ALL SELECT a.id::VARCHAR || ',' || b.id FROM cand a JOIN cand b ON a.id < b.id", "mesh")
def _(s, d):
    from voltframe.operators.relational import subsets

    t = subsets(candidates(s, d).where("length < 0.7").select("id"), 2)
    return t.select(F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("cng_5_6_7_trial_losses")
def _(s, d):
    c = candidates(s, d)
    return congestion.trial_losses(T.tree(s, d), c, congestion.trials(c, 2, 0.7), demand(s, d), generators(s, d)).select(F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "loss_percent", *r9("length"))


@query("cng_8_corridors", f"+{ADJ}, walk AS (SELECT 99::BIGINT AS node, NULL::BIGINT AS parent, [99]::BIGINT[] AS nodes UNION ALL SELECT a.other, w.node, list_append(w.nodes, a.other) FROM walk w JOIN adj a ON a.node = w.node WHERE w.parent IS NULL OR a.other <> w.parent), p AS (SELECT node AS target, nodes, list_position(nodes, 0::BIGINT) AS hub, len(nodes) AS n, 2 * (len(nodes) // 6) AS step FROM walk WHERE node < 1000000000 AND len(nodes) > 8 AND list_contains(nodes, 0::BIGINT)) SELECT DISTINCT 99::BIGINT AS root, target, nodes[greatest(hub - step, 1)] AS first, nodes[least(hub + step, n)] AS last FROM p", "tree", recursive=True)
def _(s, d):
    p = traverse.path_arrays(traverse.sssp(T.tree(s, d), one(s, 99)), customers(s, d, 1))
    return congestion.corridor_links(p, one(s, 0), 8)


_SUB = "+sub AS (SELECT src AS a, dst AS b FROM mesh WHERE src <> dst), u AS (SELECT a AS i, b AS j FROM sub UNION SELECT b, a FROM sub)"


@query("res_1_walks", f"{_SUB} SELECT x.i, y.j, count(*) AS v FROM u x JOIN u y ON x.j = y.i GROUP BY 1, 2", "mesh")
def _(s, d):
    return resilience.walks(T.mesh(s, d), 2)


_P3 = f"{_SUB}, p3 AS (SELECT a.i, c.j, count(*) AS v FROM u a JOIN u b ON b.i = a.j AND b.j <> a.i JOIN u c ON c.i = b.j AND c.j <> a.i AND c.j <> a.j GROUP BY 1, 2)"


@query("res_2_paths3", f"{_P3} SELECT i, j, v FROM p3", "mesh")
def _(s, d):
    return resilience.simple_paths3(T.mesh(s, d))


@query("res_3_4_paths_from", f"{_P3} SELECT i AS node, sum(v)::BIGINT AS paths FROM p3 GROUP BY i", "mesh")
def _(s, d):
    return resilience.paths_from(resilience.simple_paths3(T.mesh(s, d)))


@query("res_5_paths_total", f"{_P3} SELECT sum(v)::BIGINT AS paths FROM p3 WHERE i <= j", "mesh")
def _(s, d):
    return resilience.paths_total(resilience.simple_paths3(T.mesh(s, d)))


_TRI = "tri AS (SELECT a.i AS node, count(*) AS closed FROM u a JOIN u b ON b.i = a.j JOIN u c ON c.i = b.j AND c.j = a.i GROUP BY 1)"


@query("res_6_triangles", f"{_SUB}, {_TRI} SELECT node, closed FROM tri", "mesh")
def _(s, d):
    return resilience.triangle_walks(T.mesh(s, d))


@query("res_7_sigma", f"{_P3}, {_TRI}, t AS (SELECT i, sum(v) AS v FROM p3 GROUP BY i) SELECT n.i AS node, round(0.5 * coalesce(t.v * t.v / (SELECT sum(v) FROM p3 WHERE i <= j), 0) + 0.5 * coalesce(closed / ((SELECT sum(closed) FROM tri) / 3.0::DOUBLE), 0), 9) AS sigma FROM (SELECT DISTINCT i FROM u) n LEFT JOIN t ON t.i = n.i LEFT JOIN tri ON tri.node = n.i", "mesh")
def _(s, d):
    return resilience.sigma(T.mesh(s, d), 0.5).select("node", *r9("sigma"))


@query("res_8_evenness", f"{_P3}, {_TRI}, t AS (SELECT i, sum(v) AS v FROM p3 GROUP BY i), sig AS (SELECT 0.5 * coalesce(t.v * t.v / (SELECT sum(v) FROM p3 WHERE i <= j), 0) + 0.5 * coalesce(closed / ((SELECT sum(closed) FROM tri) / 3.0::DOUBLE), 0) AS sigma FROM (SELECT DISTINCT i FROM u) n LEFT JOIN t ON t.i = n.i LEFT JOIN tri ON tri.node = n.i) SELECT 'paths' AS kind, round(CASE WHEN min(sigma) = 0 THEN 0 ELSE max(sigma) / min(sigma) END, 9) AS value FROM sig", "mesh")
def _(s, d):
    return resilience.resiliency(T.mesh(s, d), "paths", 0.5).select("kind", *r9("value"))


@query("res_9_10_estrada")
def _(s, d):
    return resilience.estrada(T.mesh(s, d)).select("nodes", *r9("estrada"))


@query("res_11_inverse", "SELECT s_suppkey AS i, s_suppkey AS j, 1.0::DOUBLE AS v FROM supplier")
def _(s, d):
    k = F.col("s_suppkey")
    rows = T.read(s, d, "supplier").select(k.alias("i"), F.explode(F.array(F.struct(k.alias("j"), F.lit(3.0).alias("v")), F.struct(F.greatest(k - 1, F.lit(0)).alias("j"), F.lit(1.0).alias("v")))).alias("e"))
    a = rows.groupBy("i", F.col("e.j").alias("j")).agg(F.sum("e.v").alias("v"))
    return resilience.product(a, resilience.inverse(a)).select("i", "j", *r9("v")).where("v <> 0")


def _kept(fixed: str) -> str:
    """Vertices that stay by Ramer, Douglas and Peucker's rule; fixed tells a vertex p that stays anyway."""
    dx, dy = "(pb.x - pa.x)", "(pb.y - pa.y)"
    size = f"sqrt({dx} * {dx} + {dy} * {dy})"
    flat = f"abs({dx} * (pa.y - p.y) - (pa.x - p.x) * {dy}) / {size}"
    far = f"CASE WHEN {size} > 0 THEN {flat} ELSE sqrt((p.x - pa.x) * (p.x - pa.x) + (p.y - pa.y) * (p.y - pa.y)) END"
    inner = f"SELECT g.line, g.a, g.b, p.seq, {fixed} AS fixed, {far} AS d FROM seg g JOIN polylines p ON p.line = g.line AND p.seq > g.a AND p.seq < g.b JOIN polylines pa ON pa.line = g.line AND pa.seq = g.a JOIN polylines pb ON pb.line = g.line AND pb.seq = g.b"
    cut = f"SELECT line, a, b, CASE WHEN bool_or(fixed) THEN min(seq) FILTER (fixed) ELSE min_by(seq, (-d, seq)) END AS m, bool_or(fixed) OR max(d) > 2.0 AS split FROM ({inner}) GROUP BY line, a, b"
    return f"seg AS (SELECT line, 0::BIGINT AS a, max(seq) AS b FROM polylines GROUP BY line UNION ALL SELECT line, unnest([a, m]) AS a, unnest([m, b]) AS b FROM ({cut}) WHERE split) SELECT line, seq, x, y FROM polylines SEMI JOIN (SELECT line, a AS seq FROM seg UNION SELECT line, b FROM seg) USING (line, seq)"


@query("geo_1_smooth", f"+{_kept('false')}", "polylines", recursive=True)
def _(s, d):
    return geometry.smooth(T.polylines(s, d), 2.0)


@query("geo_2_simplify", f"+j AS (SELECT x, y FROM polylines GROUP BY x, y HAVING count(*) > 1), {_kept('(p.x, p.y) IN (SELECT (x, y) FROM j)')}", "polylines", recursive=True)
def _(s, d):
    return geometry.simplify(T.polylines(s, d), 2.0)


_JUNC = "j AS (SELECT x, y, count(*) AS n FROM polylines GROUP BY x, y HAVING count(*) > 1)"


@query("agg_14_junctions", f"+{_JUNC} SELECT round(x, 9) AS x, round(y, 9) AS y, n FROM j", "polylines")
def _(s, d):
    return geometry.junctions(T.polylines(s, d)).select(*r9("x", "y"), "n")


@query("geo_3_super_simplify", f"+{_JUNC} SELECT line, seq FROM (SELECT line, seq, x, y, max(seq) OVER (PARTITION BY line) AS b FROM polylines) p WHERE seq = 0 OR seq = b OR (x, y) IN (SELECT (x, y) FROM j)", "polylines")
def _(s, d):
    return geometry.super_simplify(T.polylines(s, d)).select("line", "seq")


@query("geo_4_line_edges", "SELECT line, seq, round(length, 9) AS length FROM (SELECT line, seq, sqrt((x - lead(x) OVER w) * (x - lead(x) OVER w) + (y - lead(y) OVER w) * (y - lead(y) OVER w)) AS length FROM polylines WINDOW w AS (PARTITION BY line ORDER BY seq)) WHERE length IS NOT NULL", "polylines")
def _(s, d):
    return geometry.line_edges(T.polylines(s, d)).select("line", "seq", *r9("length"))


@query("geo_5_merged_points", '+near AS (SELECT a.id, list(b.id ORDER BY b.id) AS before FROM points a JOIN points b ON b.id < a.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 0.05 GROUP BY a.id), ord AS (SELECT id, before, row_number() OVER (ORDER BY id) AS k FROM near), firsts(k, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.k, CASE WHEN len(list_filter(o.before, lambda x: NOT list_contains(f.taken, x))) > 0 THEN list_append(f.taken, o.id) ELSE f.taken END FROM firsts f JOIN ord o ON o.k = f.k + 1), gone AS (SELECT taken FROM firsts ORDER BY k DESC LIMIT 1), into_ AS (SELECT p.id, p.x, p.y, coalesce(list_min(list_filter(n.before, lambda x: NOT list_contains(taken, x))), p.id) AS "into" FROM points p LEFT JOIN near n USING (id), gone) SELECT id, "into", round(avg(x) OVER (PARTITION BY "into"), 9) AS x, round(avg(y) OVER (PARTITION BY "into"), 9) AS y FROM into_', "points", recursive=True)
def _(s, d):
    return geometry.merge_points(T.points(s, d), 0.05).select("id", "into", *r9("x", "y"))


@query("geo_6_7_connected", "+on_line AS (SELECT id, x, y FROM points WHERE id IN (SELECT src FROM mesh WHERE id >= 2000000000 UNION SELECT dst FROM mesh WHERE id >= 2000000000)), loose AS (SELECT id, x, y FROM points WHERE id IN (SELECT point_id FROM sources)) SELECT l.id AS src, first(o.id ORDER BY (o.x - l.x) * (o.x - l.x) + (o.y - l.y) * (o.y - l.y), o.id) AS dst, round(min(sqrt((o.x - l.x) * (o.x - l.x) + (o.y - l.y) * (o.y - l.y))), 9) AS length FROM loose l, on_line o GROUP BY l.id", "sources", "mesh")
def _(s, d):
    return geometry.connect(T.sources(s, d), T.points(s, d), T.mesh(s, d).where("id >= 2000000000")).select("src", "dst", *r9("length"))


@query("geo_8_hit", "SELECT 'node' AS kind, id, round(sqrt((x - 5) * (x - 5) + (y - 5) * (y - 5)), 9) AS dist FROM points WHERE sqrt((x - 5) * (x - 5) + (y - 5) * (y - 5)) <= 3 ORDER BY sqrt((x - 5) * (x - 5) + (y - 5) * (y - 5)), id LIMIT 1", "points")
def _(s, d):
    from voltframe.operators.relational import with_ends

    return geometry.hit(T.points(s, d), with_ends(T.tree(s, d), T.points(s, d)), 5.0, 5.0).select("kind", "id", *r9("dist"))


@query("geo_9_screen", "SELECT id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) * 800, 9) AS sx, round(600 - (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) * 600, 9) AS sy FROM points", "points")
def _(s, d):
    return geometry.on_screen(T.points(s, d), 800.0, 600.0).select("id", *r9("sx", "sy"))


@query("geo_10_padded_range", "SELECT round(min(x) - 0.1::DOUBLE * (max(x) - min(x)), 9) AS low, round(max(x) + 0.1::DOUBLE * (max(x) - min(x)), 9) AS high FROM points", "points")
def _(s, d):
    return geometry.padded_range(T.points(s, d), "x").select(*r9("low", "high"))


@query("flw_8_path_losses", f"{FLOW}, {walk('SELECT 3::BIGINT AS node', True).replace('walk', 'trip')}, steps AS (SELECT node AS target, unnest(path) AS edge FROM trip WHERE node < 1000000000) SELECT target, round(sum(greatest((coalesce(f.flow, 0) + 0.5::DOUBLE) * (coalesce(f.flow, 0) + 0.5::DOUBLE) * 0.4247::DOUBLE * length * 0.001::DOUBLE - coalesce(f.flow, 0) * coalesce(f.flow, 0) * 0.4247::DOUBLE * length * 0.001::DOUBLE, 0)), 9) AS loss FROM steps JOIN tree t ON t.id = steps.edge LEFT JOIN flows f ON f.edge = steps.edge GROUP BY target", "sources", "tree", recursive=True)
def _(s, d):
    t = T.tree(s, d)
    return flow.tree_losses(traverse.sssp(t, one(s, 3)), customers(s, d, 1), flows(s, d), t, 0.5).select("target", *r9("loss"))


@query("snk_5_plot_script", "SELECT 1 AS part, t.id AS n, printf('set arrow from %.4f,%.4f to %.4f,%.4f nohead lc rgb \"%s\"', a.x, a.y, b.x, b.y, 'navy') AS line FROM tree t JOIN points a ON a.id = src JOIN points b ON b.id = dst UNION ALL SELECT 2, id, printf('set object circle at %.4f,%.4f size 0.02', x, y) FROM points UNION ALL SELECT 0, 0, 'set title \"tree\"' UNION ALL SELECT 0, 1, 'unset key'", "tree")
def _(s, d):
    from voltframe.operators.relational import with_ends

    e = with_ends(T.tree(s, d), T.points(s, d)).select(F.col("id").alias("edge"), "x1", "y1", "x2", "y2", F.lit("navy").alias("colour"))
    return report.plot_script(e, T.points(s, d), "tree").select("place.part", "place.n", "line")


@query("snk_6_report", f"{FLOW}, x AS (SELECT (SELECT count(*) FROM tree) AS lines, (SELECT sum(length) FROM tree) AS length, (SELECT sum(load) FROM demand) AS load, (SELECT sum(loss) FROM flows) AS loss, (SELECT sum(power) FROM gens) AS power) SELECT 0 AS place, printf('%d lines of %.2f in all', lines, length) AS line FROM x UNION ALL SELECT 1, printf('load %.2f, loss %.2f (%.2f %%)', load, loss, round(100 * loss / (load + loss), 2)) FROM x UNION ALL SELECT 2, printf('power %.2f of %d generators', power, (SELECT count(*) FROM gens)) FROM x", "sources", "tree", recursive=True)
def _(s, d):
    known = flow.summary(flows(s, d), demand(s, d), generators(s, d))
    return report.info_lines(known, T.tree(s, d)).where("place < 3").select("place", "line")


@query("msc_11_merged_map")
def _(s, d):
    points, lines = geometry.merged_map(T.polylines(s, d), 2.0, 0.03)
    return lines.select("src", "dst", *r9("length"))


@query("msc_1_accessors", f"+{LOAD} SELECT (SELECT count(*) FROM points) AS nodes, (SELECT count(*) FROM mesh) AS lines, (SELECT count(*) FROM demand) AS loads", "mesh")
def _(s, d):
    from voltframe.operators import relational

    return relational.sizes(nodes=T.points(s, d), lines=T.mesh(s, d), loads=demand(s, d))


@query("msc_9_line_details", "SELECT id, least(src, dst) AS low, greatest(src, dst) AS high, round(length, 9) AS length FROM mesh", "mesh")
def _(s, d):
    from voltframe.operators import relational

    return relational.line_details(T.mesh(s, d)).select("id", "low", "high", *r9("length"))
