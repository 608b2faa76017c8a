"""Operators against plain versions on small graphs, matrices and maps."""

import math

import numpy as np
import pytest

from voltframe.operators import cluster, components, congestion, flow, geometry, relational, report, resilience, traverse
from voltframe.sources import files

GRAPHS = {
    "path4": [(0, 0, 1, 1.0), (1, 1, 2, 1.0), (2, 2, 3, 1.0)],
    "star5": [(k, 0, k, 1.0 + k) for k in range(1, 5)],
    "detour": [(0, 0, 2, 5.0), (1, 0, 1, 1.0), (2, 1, 2, 1.0), (3, 2, 3, 1.0)],
    "triangle_tail": [(0, 0, 1, 1.0), (1, 1, 2, 1.0), (2, 2, 0, 1.0), (3, 2, 3, 1.0)],
    "islands": [(0, 0, 1, 1.0), (1, 2, 3, 2.0)],
    "chain": [(k, k, k + 1, 0.5 + k % 3) for k in range(60)],
}


def edges_of(spark, name):
    return spark.createDataFrame(GRAPHS[name], "id long, src long, dst long, length double")


def nodes_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def distances(name, root):
    """All-pairs relaxation, again and again."""
    best = {root: 0.0}
    for _ in range(70):
        for _, a, b, size in GRAPHS[name]:
            for x, y in ((a, b), (b, a)):
                if x in best and best[x] + size < best.get(y, math.inf):
                    best[y] = best[x] + size
    return best


@pytest.mark.parametrize("name", sorted(GRAPHS))
@pytest.mark.parametrize("local", [True, False])
def test_nearest_of_many_roots(spark, name, local):
    if name == "chain" and not local:
        pytest.skip("a round for each of sixty lines")
    roots = [0, 3, 99]
    got = {r.node: (r.dist, r.root) for r in traverse.nearest_root(edges_of(spark, name), nodes_of(spark, roots), local).collect()}
    want = {}
    for r in roots:
        for n, d in distances(name, r).items():
            want[n] = min(want.get(n, (math.inf, 0)), (d, r))
    assert got == want


def test_paths_by_doubling(spark):
    tree = traverse.sssp(edges_of(spark, "chain"), nodes_of(spark, [0]))
    rows = traverse.paths(tree, nodes_of(spark, [0, 37, 60])).collect()
    for t in (0, 37, 60):
        own = sorted((r.step, r.node, r.edge) for r in rows if r.target == t)
        assert own == [(k, k, k - 1 if k else None) for k in range(t + 1)]


def test_distributed_distances_on_a_random_graph(spark):
    rng = np.random.default_rng(5)
    GRAPHS["random"] = [(k, int(a), int(b), float(1 + rng.integers(0, 9))) for k, (a, b) in enumerate(rng.integers(0, 25, (60, 2))) if a != b]
    far = traverse.sssp(edges_of(spark, "random"), nodes_of(spark, [0, 7]), local=False).collect()
    for r in (0, 7):
        assert {x.node: x.dist for x in far if x.root == r} == distances("random", r)
    assert sorted(map(tuple, far), key=str) == sorted(map(tuple, traverse.sssp(edges_of(spark, "random"), nodes_of(spark, [0, 7]), local=True).collect()), key=str)
    del GRAPHS["random"]


def test_components_when_tasks_take_few_edges(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    e = spark.createDataFrame(pairs, "src long, dst long")
    whole = {tuple(r) for r in components.star_components(e).collect()}
    assert whole == {tuple(r) for r in components.star_components(e, pack=30).collect()}
    sets = components.Union()
    for a, b in pairs:
        if a != b:
            sets.join(a, b)
    assert whole == set(sets.smallest())


def test_many_seeds_in_few_rounds(spark, monkeypatch):
    calls = []
    real = traverse.nearest_root
    monkeypatch.setattr(traverse, "nearest_root", lambda *a, **k: calls.append(1) or real(*a, **k))
    e = edges_of(spark, "chain")
    seeds = cluster.spread_seeds(e, nodes_of(spark, range(61)), 30).collect()
    assert sorted(r.cluster for r in seeds) == list(range(30)) and len({r.node for r in seeds}) == 30 and len(calls) <= cluster.ROUNDS
    assert cluster.spread_seeds(e, nodes_of(spark, []), 3).collect() == []
    assert len(cluster.spread_seeds(e, nodes_of(spark, [4, 5]), 9).collect()) == 2


def test_silhouette_of_blocks_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(7)
    x, c = rng.random((90, 2)), rng.integers(0, 3, 90)
    rows = [(i, float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(x, c, strict=True))]
    df = spark.createDataFrame(rows, "id long, x double, y double, cluster int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    mean = np.stack([d[:, c == k].mean(1) for k in range(3)], 1)
    a = mean[np.arange(90), c]
    mean[np.arange(90), c] = np.inf
    want = ((mean.min(1) - a) / np.maximum(mean.min(1), a)).mean()
    for block in (20, 4096):
        assert cluster.silhouette(df, block).first().silhouette == pytest.approx(want)
    assert cluster.silhouette(df.withColumn("cluster", df["cluster"] * 0)).first().silhouette == 1.0


def test_trace_of_the_exponential_is_the_sum_over_eigenvalues(spark):
    for name in ("path4", "star5", "triangle_tail", "chain"):
        n = 1 + max(max(a, b) for _, a, b, _ in GRAPHS[name])
        m = np.zeros((n, n))
        for _, a, b, _ in GRAPHS[name]:
            m[a, b] = m[b, a] = 1
        r = resilience.estrada(edges_of(spark, name), block=3).first()
        assert r.nodes == n and r.estrada == pytest.approx(np.exp(np.linalg.eigvalsh(m)).sum(), rel=1e-12)
    assert tuple(resilience.estrada(edges_of(spark, "path4").where("false")).first()) == (0, 0.0)


def test_inverse_and_product(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(7, 7)) + 4 * np.eye(7)
    a = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(7) for j in range(7)], "i long, j long, v double")
    got = {(r.i, r.j): r.v for r in resilience.inverse(a).collect()}
    assert np.allclose([[got[i, j] for j in range(7)] for i in range(7)], np.linalg.inv(m))
    one = {(r.i, r.j): r.v for r in resilience.product(a, resilience.inverse(a)).collect()}
    assert np.allclose([[one[i, j] for j in range(7)] for i in range(7)], np.eye(7))


def test_losses_over_a_path(spark):
    e = edges_of(spark, "path4")
    p = traverse.paths(traverse.sssp(e, nodes_of(spark, [0])), nodes_of(spark, [0, 2]))
    f = spark.createDataFrame([(0, 2.0, 0.0)], "edge long, flow double, loss double")
    got = {r.target: r.loss for r in flow.path_losses(p, f, e, 0.5).collect()}
    assert got == {2: pytest.approx(0.4247e-3 * ((2.5**2 - 2.0**2) + 0.5**2))}


def test_a_map_of_crossing_lines(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.001), (1, 2, 2.0, 0.0), (2, 0, 2.01, 0.0), (2, 1, 2.0, 3.0)]
    points, lines = geometry.merged_map(spark.createDataFrame(rows, "line long, seq long, x double, y double"), 0.1, 0.03)
    assert sorted((r.src, r.dst, round(r.length, 6)) for r in lines.collect()) == [(0, 1, 2.005), (1, 3, round(math.hypot(0.005, 3.0), 6))]
    assert {r.id: (round(r.x, 4), r.y) for r in points.collect()} == {0: (0.0, 0.0), 1: (2.005, 0.0), 3: (2.0, 3.0)}


def test_report_text(spark):
    s = spark.createDataFrame([(10.0, 0.5, 4.76, 12.0, 3, 60.1)], "load double, loss double, loss_percent double, power double, generators long, frequency double")
    got = [r.line for r in report.info_lines(s, edges_of(spark, "path4")).orderBy("place").collect()]
    assert got == ["3 lines of 3.00 in all", "load 10.00, loss 0.50 (4.76 %)", "power 12.00 of 3 generators", "frequency 60.1000"]


def test_bounds_are_refused_beyond(spark, monkeypatch):
    monkeypatch.setattr(relational, "MOST_ITEMS", 2)
    with pytest.raises(ValueError):
        relational.combinations(spark.range(3), 2)
    monkeypatch.setattr(resilience, "MOST_INVERTED", 1)
    with pytest.raises(ValueError):
        resilience.inverse(spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "i long, j long, v double"))


def test_two_lines_for_two_groups_at_once(spark):
    e = spark.createDataFrame([(0, 0, 1, 1.0), (1, 2, 3, 1.0), (2, 4, 5, 1.0)], "id long, src long, dst long, length double")
    p = spark.createDataFrame([(k, float(k), 0.0) for k in range(6)], "id long, x double, y double")
    left = spark.createDataFrame([(7, 0), (7, 1), (8, 4)], "k2 long, node long")
    right = spark.createDataFrame([(7, 3), (8, 5), (9, 2)], "k2 long, node long")
    got = congestion.links_along_lines(left, right, e, p, 0.0, ["k2"]).collect()
    assert [tuple(r) for r in got] == [(7, 1, 2, 1.0)]  # 2 lies on the line and belongs to 3; 4 and 5 hang together


def test_datum_shift(spark):
    from pyspark.sql import functions as F

    def cartesian(lat, lon, a, f):
        e2, s = f * (2 - f), math.sin(lat)
        n = a / math.sqrt(1 - e2 * s * s)
        return np.array([n * math.cos(lat) * math.cos(lon), n * math.cos(lat) * math.sin(lon), n * (1 - e2) * s])

    (dx, dy, dz), turns, ppm = files.DHDN
    rx, ry, rz = (math.radians(t / 3600) for t in turns)
    turn = np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]])
    for lat, lon in ((48.0, 9.0), (54.3, 12.5), (47.4, 10.9)):
        x, y, z = (1 + ppm * 1e-6) * turn @ cartesian(math.radians(lat), math.radians(lon), *files.BESSEL) + np.array([dx, dy, dz])
        a, f = files.WGS84
        e2, want = f * (2 - f), math.atan2(z, math.hypot(x, y))
        for _ in range(20):
            n = a / math.sqrt(1 - e2 * math.sin(want) ** 2)
            want = math.atan2(z + e2 * n * math.sin(want), math.hypot(x, y))
        r = spark.range(1).select(files.shifted(F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))).alias("p")).first().p
        assert r.lat == pytest.approx(math.degrees(want), abs=1e-8) and r.lon == pytest.approx(math.degrees(math.atan2(y, x)), abs=1e-9)
        assert 1e-4 < abs(r.lat - lat) + abs(r.lon - lon) < 1e-2
