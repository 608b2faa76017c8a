"""Ties, dense inputs and sizes beyond those of the smallest tables."""

import math

import numpy as np
import pytest

from voltframe.functions import sessions
from voltframe.operators import cluster, components, congestion, flow, geometry, relational, traverse
from voltframe.sources import files


def test_nearest_centroid_by_squares(spark):
    # both squares have one root in double precision; the lesser one counts
    p = spark.createDataFrame([(38813, (38813 * 7919 % 10007) / 1000.0, (38813 * 104729 % 10009) / 1000.0)], "id long, x double, y double")
    c = spark.createDataFrame([(0, 2.0, 2.0), (1, 5.0, 7.0), (2, 8.0, 3.0)], "cluster int, x double, y double")
    x, y = p.first().x, p.first().y
    square = {k: (x - a) * (x - a) + (y - b) * (y - b) for k, a, b in ((0, 2.0, 2.0), (2, 8.0, 3.0))}
    assert square[2] < square[0] and math.sqrt(square[0]) == math.sqrt(square[2])
    assert [r.cluster for r in cluster.predict(p, c).collect()] == [2]
    q = spark.createDataFrame([(1, x, y)], "qid long, x double, y double")
    assert [r.pid for r in relational.nearest(q, c.selectExpr("cast(cluster as long) as pid", "x", "y")).collect()] == [2]


@pytest.mark.parametrize("far", [[], [(9999, 1e6, -1e6)]])
def test_cells_follow_the_density_of_points(spark, far):
    rng = np.random.default_rng(1)
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.random((3000, 2)))] + far
    p = spark.createDataFrame(rows, "pid long, x double, y double")
    size = relational._cell_sizes(p, []).first()["size"]
    most = p.groupBy((p.x / size).cast("long"), (p.y / size).cast("long")).count().agg({"count": "max"}).first()[0]
    assert most <= 6 * relational.IN_CELL
    q = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(3 * rng.random((60, 2)))], "qid long, x double, y double")
    want = {r.qid: min(((r.x - x) ** 2 + (r.y - y) ** 2, k) for k, x, y in rows)[1] for r in q.collect()}
    assert {r.qid: r.pid for r in relational.nearest(q, p).collect()} == want


def test_nearest_in_groups_with_sizes_of_their_own(spark):
    rng = np.random.default_rng(2)
    p = [(g, k, float(x), float(y)) for g, wide in ((1, 1.0), (2, 1000.0), (3, 0.0)) for k, (x, y) in enumerate(wide * rng.random((80, 2)))]
    q = [(g, k, float(x), float(y)) for g in (1, 2, 3, 4) for k, (x, y) in enumerate(10 * rng.random((9, 2)))]
    got = relational.nearest(spark.createDataFrame(q, "g long, qid long, x double, y double"), spark.createDataFrame(p, "g long, pid long, x double, y double"), by=["g"]).collect()
    want = {(g, k): min(((a - x) ** 2 + (b - y) ** 2, i) for h, i, a, b in p if h == g)[1] for g, k, x, y in q if g < 4}
    assert {(r.g, r.qid): r.pid for r in got} == want


def test_stripped_graphs_give_the_rows_of_the_local_kernel(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, k, (k - 1) // 2, float(rng.integers(1, 5))) for k in range(1, 150)]
    rows += [(1000 + k, int(a), int(b), float(rng.integers(1, 9))) for k, (a, b) in enumerate(rng.integers(0, 20, (8, 2)))] + [(2000, 500, 501, 1.0)]
    e = spark.createDataFrame(rows, "id long, src long, dst long, length double")
    r = spark.createDataFrame([(x,) for x in (0, 120, 33, 500, 999)], "node long")
    shape = traverse.Stripped(e, 0)
    assert len(shape.levels) > 3 and shape.core.count() < 20
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert same(traverse.sssp(e, r, True), traverse.sssp(e, r, shape=shape))
    assert same(traverse.nearest_root(e, r, True), traverse.nearest_root(e, r, shape=shape))


def test_large_graphs_do_not_come_to_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("rows collected"))
    assert sessions.bounded(spark.range(11), 10) is None


def test_losses_summed_up_along_a_tree_are_those_of_its_paths(spark):
    rows = [(k, k, (k - 1) // 2, 1.0 + k % 5) for k in range(1, 40)] + [(100 + k, 40 + k, 39 + k, 2.0) for k in range(9)]
    e = spark.createDataFrame(rows, "id long, src long, dst long, length double")
    f = spark.createDataFrame([(k, k / 7.0) for k in range(1, 30)], "edge long, flow double")
    t, to = traverse.sssp(e, spark.createDataFrame([(3,)], "node long")), spark.range(0, 49, 2).toDF("node")
    want = {r.target: r.loss for r in flow.path_losses(traverse.paths(t, to), f, e, 0.5).collect()}
    assert {r.target: r.loss for r in flow.tree_losses(t, to, f, e, 0.5).collect()} == pytest.approx(want)


def test_dense_points_merge_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(geometry, "IN_TILE", 40)
    rng = np.random.default_rng(9)
    xy = np.round(rng.random((600, 2)), 2)  # some at one place, all hang together
    order = rng.permutation(600)
    into: dict[int, int] = {}
    for i in range(600):
        if i not in into:
            d = np.sqrt(((xy - xy[i]) ** 2).sum(1))
            into |= {j: i for j in range(i, 600) if j not in into and (j == i or d[j] < 0.12)}
    p = spark.createDataFrame([(int(i), float(xy[i, 0]), float(xy[i, 1])) for i in order] + [(900, None, None)], "id long, x double, y double")
    got = {r.id: r for r in geometry.merge_points(p, 0.12).collect()}
    assert got.pop(900).into == 900 and {i: r.into for i, r in got.items()} == into
    first = [i for i in into if into[i] == 0]
    assert got[0].x == pytest.approx(xy[first, 0].mean())


def test_lines_are_smoothed_in_batches(spark):
    rows = [(line, seq, float(seq), float((seq * (3 + line)) % 5) * (line % 2)) for line in range(40) for seq in range(12)][::-1]
    df = spark.createDataFrame([(*r, r[1] == 5) for r in rows], "line long, seq long, x double, y double, fixed boolean")
    got = geometry.smooth(df, 0.5)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    want = set()
    for line in range(40):
        v = sorted(r for r in rows if r[0] == line)
        want |= {v[k] for k in geometry.simplified_places([r[2] for r in v], [r[3] for r in v], 0.5, [r[1] == 5 for r in v])}
    assert {tuple(r) for r in got.collect()} == want and len(want) < len(rows)


def test_spanning_tree_of_points_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate([*np.round(rng.random((70, 2)), 1), (40.0, 1.0), (40.0, 1.0)])]
    sets, want = components.Union(), set()
    for _, a, b in sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), i, j) for i, x, y in rows for j, u, v in rows if i < j):
        if sets.join(a, b):
            want.add((a, b))
    got = components.euclidean_forest(spark.createDataFrame(rows, "id long, x double, y double")).collect()
    assert {(r.src, r.dst) for r in got} == want and len(got) == 71


def test_pairs_and_subsets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(relational, "BLOCK", 7)
    monkeypatch.setattr(relational, "MOST_ITEMS", 5)
    c = spark.range(20).selectExpr("id", "0.1 as length")
    got = {tuple(r["items"]) for r in congestion.trials(c, 2).collect()}
    assert got == {(a,) for a in range(20)} | {(a, b) for a in range(20) for b in range(a + 1, 20)}
    p = spark.range(30).selectExpr("id", "double(id) as x", "0D as y")
    e = relational.complete_edges(p).collect()
    assert len(e) == 435 and all(r.length == r.dst - r.src > 0 for r in e)


def test_one_file_for_each_node_and_documents_of_bounded_size(spark, tmp_path, monkeypatch):
    p = spark.range(400).repartition(8).selectExpr("id % 5 as node", "timestamp'2024-01-01' as ts", "double(id) as lmp")
    files.write_nodes(p, str(tmp_path / "nodes"))
    assert len(list((tmp_path / "nodes").rglob("*.csv.gz"))) == 5
    monkeypatch.setattr(files, "IN_DOCUMENT", 10)
    j = [f'{{"type": "node", "id": {k}, "lat": {k}.5, "lon": 1.0}}' for k in range(60)] + [f'{{"type": "way", "id": {w}, "nodes": [{w}, 59, 99]}}' for w in range(9)]
    where = files.write_documents(spark.createDataFrame([(x,) for x in j], "j string"), str(tmp_path / "docs"))
    assert len(list((tmp_path / "docs").glob("part-*"))) > 3
    assert {(r.way, r.seq, r.node, r.lat) for r in files.overpass_ways(spark, where).collect()} == {(w, k, n, n + 0.5) for w in range(9) for k, n in ((0, w), (1, 59))}


def test_silhouette_in_passes_shuffles_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(cluster, "MOST_SENT", 40)
    p = spark.range(100).selectExpr("id", "double(id * 7 % 31) as x", "double(id * 5 % 17) as y", "int(id % 3) as cluster")
    whole = cluster.silhouette(p)
    r = p.collect()
    d = np.array([[math.hypot(a.x - b.x, a.y - b.y) for b in r] for a in r])
    c = np.array([a.cluster for a in r])
    m = np.stack([d[:, c == k].mean(1) for k in range(3)], 1)
    a, b = m[np.arange(100), c], np.where(np.arange(3) == c[:, None], np.inf, m).min(1)
    assert whole.first().silhouette == pytest.approx(((b - a) / np.maximum(a, b)).mean())
    assert "FlatMapGroups" not in whole._jdf.queryExecution().toString()


def test_many_roots_take_no_longer_than_what_they_reach(spark):
    e = spark.range(300).selectExpr("id", "2 * id as src", "2 * id + 1 as dst", "1D as length")
    kernel = traverse.Kernel([tuple(r) for r in e.collect()])
    assert kernel.reached(4) == [(4, 4, 0.0, 0, -1, -1), (4, 5, 1.0, 1, 4, 2)] and kernel.reached(900) == [(900, 900, 0.0, 0, -1, -1)]
    t = traverse.sssp(e, spark.range(0, 600, 2).toDF("node"), True)
    assert t.rdd.getNumPartitions() > 100 and t.count() == 600
