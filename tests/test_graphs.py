"""Hand-built graphs, and both forms (local kernel, distributed rounds) of each iterative operator."""

import random

import numpy as np
import pytest

from tests.conftest import SF
from voltframe.operators import cluster, components, congestion, flow, geometry, graph, resilience, traverse
from voltframe.plans import base, relations
from voltframe.sources import tables

GRAPHS = {
    "path4": [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)],
    "star5": [(0, i, 1.0) for i in range(1, 5)],
    "ring6": [(i, (i + 1) % 6, 1.0) for i in range(6)],
    "detour": [(0, 2, 5.0), (0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)],
    "triangle_tail": [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, 3, 1.0)],
    "islands": [(0, 1, 1.0), (2, 3, 1.0)],
    "multi": [(0, 1, 2.0), (0, 1, 1.0), (1, 1, 3.0), (1, 2, 1.0)],
}


def edges_of(spark, rows):
    return spark.createDataFrame([(n, a, b, x) for n, (a, b, x) in enumerate(rows)], "id long, src long, dst long, length double")


def nodes_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def random_graph(seed, n=40, m=70):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), r.randrange(1, 9) / 4) for _ in range(m)]


@pytest.mark.parametrize("name", [*GRAPHS, "random"])
def test_local_and_distributed_forms_agree(spark, name):
    e = edges_of(spark, GRAPHS.get(name) or random_graph(3))
    got = [{(r.root, r.node): (round(r.dist, 9), r.hops, r.parent) for r in traverse.sssp(e, nodes_of(spark, 0, 1), local=x).collect()} for x in (True, False)]
    assert got[0] == got[1]
    assert sorted(components.components(e, local=True).collect()) == sorted(components.components(e, local=False).collect())
    trees = [sorted(r.id for r in components.spanning_forest(e, local=x).collect()) for x in (True, False)]
    assert trees[0] == trees[1]
    parts = components.components(e).select("component").distinct().count()
    assert len(trees[0]) == graph.ends(e).count() - parts


def test_shortest_is_not_fewest_hops(spark):
    t = {r.node: (r.dist, r.hops) for r in traverse.sssp(edges_of(spark, GRAPHS["detour"]), nodes_of(spark, 0)).collect()}
    assert t == {0: (0.0, 0), 1: (1.0, 1), 2: (2.0, 2), 3: (3.0, 3)}


def test_small_facts(spark):
    star, path, tri = (edges_of(spark, GRAPHS[k]) for k in ("star5", "path4", "triangle_tail"))
    assert {r.node: r.degree for r in graph.degree(star).collect()} == {0: 4, 1: 1, 2: 1, 3: 1, 4: 1}
    assert graph.randic(star).first().randic == pytest.approx(4 / 2)
    assert [r.node for r in traverse.median_node(path, nodes_of(spark, 1)).collect()] == [1]
    assert [(r.src, r.dst, r.length) for r in components.contract_chains(path, nodes_of(spark, 0, 3)).collect()] == [(0, 3, 3.0)]
    assert {r.node: r.closed for r in resilience.triangle_walks(tri).collect()} == {0: 2, 1: 2, 2: 2}
    assert [r.id for r in graph.simple_pairs(edges_of(spark, GRAPHS["multi"])).orderBy("id").collect()] == [0, 3]
    p = {(r.i, r.j): r.v for r in resilience.simple_paths3(tri).collect()}
    assert p == {(0, 3): 1, (3, 0): 1, (1, 3): 1, (3, 1): 1}
    assert resilience.estrada(path).first().estrada == pytest.approx(np.exp(np.linalg.eigvalsh(np.diag([1.0] * 3, 1) + np.diag([1.0] * 3, -1))).sum())


def test_flow_has_known_sums_in_both_forms(spark):
    t, load, gens = relations.search(spark, SF), base.demand(spark, SF), base.generators(spark, SF)
    e = tables.tree(spark, SF)
    for local in (True, False):
        rows = flow.edge_flows(t, load, gens, e, local=local).collect()
        assert len(rows) == 149
        assert sum(r.flow for r in rows) == pytest.approx(42.676527, abs=1e-6)
        assert max(r.flow for r in rows) == pytest.approx(3.609619, abs=1e-6)
        assert sum(r.loss for r in rows) == pytest.approx(0.181644, abs=1e-6)
    s = flow.fractional_shares(t, load).groupBy("node").sum("share").collect()
    assert all(r[1] == pytest.approx(1.0) for r in s)


def test_trial_without_new_lines_has_the_loss_of_the_grid(spark):
    e, load, gens = tables.tree(spark, SF), base.demand(spark, SF), base.generators(spark, SF)
    none = spark.createDataFrame([([],)], "items array<long>")
    got = congestion.trial_losses(e, e.limit(1), none, load, gens).first()
    assert got.loss_percent == 2.69


def test_greedy_merge_and_simplification(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.4, 0.0), (2, 0.8, 0.0), (3, 5.0, 5.0)], "id long, x double, y double")
    got = {r.id: (r.into, round(r.x, 6)) for r in geometry.merge_points(p, 0.5).collect()}
    assert got == {0: (0, 0.2), 1: (0, 0.2), 2: (2, 0.8), 3: (3, 5.0)}
    x, y = [0.0, 1.0, 2.0, 3.0, 4.0], [0.0, 0.05, 0.0, 2.0, 0.0]
    assert geometry.simplified_places(x, y, 0.1, [False] * 5) == [0, 2, 3, 4]
    assert geometry.simplified_places(x, y, 9.0, [False, True, False, False, False]) == [0, 1, 4]
    assert geometry.simplified_places([1.0, 2.0, 1.0], [0.0, 0.0, 0.0], 0.1, [False] * 3) == [0, 1, 2]


def test_kmeans_separates_groups(spark):
    r = random.Random(1)
    rows = [(i, cx + r.random(), cy + r.random()) for i, (cx, cy) in enumerate([(0, 0), (50, 0), (0, 50)] * 30)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    start = spark.createDataFrame([(0, 1.0, 1.0), (1, 40.0, 1.0), (2, 1.0, 40.0)], "cluster int, x double, y double")
    c = cluster.kmeans(p, 3, start=start)
    near = cluster.predict(p, c).select("id", "cluster")
    assert {x.cluster: x["count"] for x in near.groupBy("cluster").count().collect()} == {0: 30, 1: 30, 2: 30}
    assert cluster.silhouette(p.join(near, "id")).first().silhouette > 0.9


def test_kmeans_takes_the_best_of_several_starts(spark):
    r, ids = random.Random(3), sorted(range(100), key=lambda i: (i * 7919 % 10007, i))
    rows = [(i, 100.0 * (n // 20) + r.random(), r.random()) for n, i in enumerate(ids)]  # the first of a hash are all in one group
    p = spark.createDataFrame(rows, "id long, x double, y double").coalesce(1)
    near = cluster.predict(p, cluster.kmeans(p, 5, runs=2))
    assert near.selectExpr("sum(dist * dist) AS e").first().e < 100 and near.groupBy("cluster").count().count() == 5


def test_relief_lines_handle_all_groups(spark, monkeypatch):
    groups = spark.createDataFrame([(n, n) for n in range(30)], "node long, component long")
    tree = spark.createDataFrame([(100, n, 1, 2.0) for n in range(30)] + [(100, 100, 0, 0.0)], "root long, node long, hops long, dist double")
    monkeypatch.setattr(congestion, "mid_flow_groups", lambda *a: groups)
    monkeypatch.setattr(congestion, "group_centres", lambda *a: groups.select("component", "node"))
    monkeypatch.setattr(congestion, "bounds", lambda c, t: c.selectExpr("component", "node", "100L AS root", "5L AS hops"))
    monkeypatch.setattr(congestion, "links_along_lines", lambda left, right, e, p, d, by: left.selectExpr("component", "generator", "node AS a", "100L AS b", "1.5D AS length"))
    got = congestion.relief_lines(groups, tree, groups, tree).collect()
    assert sorted((r.component, r.generator, r.a, r.b, r.length, r.cost) for r in got) == [(n, 100, n, 100, 1.5, 1.5) for n in range(30)]
