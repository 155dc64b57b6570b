"""Networks on small graphs with known answers, and file readers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.columns import described
from cairn.operators import centrality, community, describe, distribution, lexical, network, shipped, walks
from cairn.plans import catalogue, lineage
from cairn.sources import graph_files


def net(spark, edges, nodes=None):
    rows = [(str(a), str(b), 0, i, float(w)) for i, (a, b, w) in enumerate(edges)]
    e = spark.createDataFrame(rows, "src string, dst string, key int, ord long, weight double")
    names = sorted(nodes if nodes is not None else {x for r in rows for x in r[:2]})
    return spark.createDataFrame(list(enumerate(map(str, names))), "idx long, node string"), e


@pytest.fixture(scope="module")
def triangle(spark):
    return net(spark, [(0, 1, 1), (1, 2, 3), (0, 2, 1)])


def test_projections(spark):
    _, e = net(spark, [("a", "b", 1), ("a", "b", 2), ("b", "a", 5), ("c", "c", 1)])
    assert {tuple(r) for r in network.digraph(e).collect()} == {("a", "b", 2.0), ("b", "a", 5.0), ("c", "c", 1.0)}
    assert {tuple(r) for r in network.undirected(e).collect()} == {("a", "b", 5.0), ("c", "c", 1.0)}
    assert network.both_ways(network.undirected(e)).count() == 3


def test_subgraphs(spark):
    v, e = net(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "a", 1)])
    pick = spark.createDataFrame([("a",), ("b",), ("z",)], "node string")
    ends = lambda df: {(r.src, r.dst) for r in df.collect()}
    assert ends(network.induced(e, pick)) == {("a", "b")} and ends(network.boundary(e, pick)) == {("b", "c")}
    assert ends(network.subgraph(e, pick, True)) == {("a", "b"), ("b", "c")}
    lone = spark.createDataFrame([("z",)], "node string")
    assert network.neighbourhood(e, lone, False).count() == 0 and network.neighbourhood(e, lone).count() == 1
    assert {r.node: r.cluster for r in network.labels(spark.createDataFrame([(300, ["a", "b"])], "cluster int, members array<string>")).collect()} == {"a": 300, "b": 300}
    assert [r.node for r in network.top(spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "node string, s int"), "s", 2).collect()] == ["a", "b"]
    assert network.sliced(v.withColumnRenamed("node", "tag"), 2).count() == 2 and network.counts(v, e).first().edges == 4


def test_degrees_are_cut(spark):
    _, e = net(spark, [("a", "b", 1.7), ("a", "c", 1.1)])
    assert {r.node: r.degree for r in network.degrees(e, "weight").collect()} == {"a": 2, "b": 1, "c": 1}


def test_descriptors_without_known_values(spark):
    df = spark.createDataFrame([(-1.0, 1.0), (-1.0, 2.0)], "v double, weight double")
    for what in ("max", "mean", "weighted average", "weighted std"):
        assert described(df, what, "v").first().value == -1.0
    x, w = np.array([1.0, 4.0, 6.0]), np.array([1.0, 2.0, 3.0])
    df = spark.createDataFrame([*zip(x.tolist(), w.tolist()), (-1.0, 9.0)], "v double, weight double")
    m = (x * w).sum() / w.sum()
    assert described(df, "weighted std", "v").first().value == pytest.approx(math.sqrt((w * (x - m) ** 2).sum() / w.sum()))


def test_unit_bins_of_any_number(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.integers(0, 97_000, 500) + 0.1, [0.1, 30_000.4, 30_000.4]))
    got = distribution.distribution({"m": spark.createDataFrame([(float(a),) for a in [*x, -1.0]], "value double")})
    rows = got.where("bins = 'unit'").orderBy("bin").collect()
    edges = np.array(distribution.unit_edges(x.min(), x.max()))
    want = np.histogram(x, edges)[0]
    assert len(rows) == len(edges) - 1 > 10_000 and [r["count"] for r in rows] == want.tolist()
    assert np.allclose([r.lo for r in rows], edges[:-1]) and np.allclose([r.pdf for r in rows], want / want.sum()) and np.allclose([r.ccdf for r in rows], 1 - np.cumsum(want) / want.sum())
    few = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (4.5,), (7.0,)], "value double")
    a = distribution.unit_histogram(few, 1.0, 7.0).orderBy("bin").collect()
    assert a == distribution.histogram(few, distribution.unit_edges(1.0, 7.0)).orderBy("bin").collect()


def test_principal_coordinates_take_all_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "LEAST", 1)
    names = [a + b for a in "abcdef" for b in "uvwxyz"]
    texts = [" ".join(names), "au av au av au aw ax", "bu cu du"]
    spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    w = np.zeros((36, 36))
    pairs = [p for t in texts for p in zip(t.split(), t.split()[1:])]
    for a, b in pairs:
        w[names.index(a), names.index(b)] += 1
    w = np.where(np.tril(w) > 0, np.tril(w), np.triu(w).T)  # the later arc by name gives a pair's weight
    w = w + w.T
    p = w / w.sum(1, keepdims=True)
    space = np.eye(36) + p + p @ p
    space -= space.mean(0)
    u, s, _ = np.linalg.svd(space)
    want = u[:, :2] * s[:2]
    got = {r.start: r.coordinates for r in catalogue.QUERIES["principal_coordinates"](spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(names)
    xy = np.array([got[n] for n in names])
    assert np.allclose(xy * np.sign((xy * want).sum(0)), want, atol=1e-6)


def test_whole_network_has_rare_pairs_of_all_languages(spark, tmp_path):
    texts = [("the cat the cat", "en")] * 60 + [("once seen", "en"), ("ein Ärger, ein ärger", "de"), (None, "en"), ("alone", None)]
    spark.createDataFrame(texts, "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["whole_word_network"](spark, str(tmp_path)).collect()}
    assert got == {("the", "cat", 120.0), ("cat", "the", 60.0), ("once", "seen", 1.0), ("ein", "ärger", 2.0), ("ärger", "ein", 1.0)}
    kept = {tuple(r) for r in catalogue.QUERIES["word_network"](spark, str(tmp_path)).collect()}
    assert kept == {("the", "cat", 120.0), ("cat", "the", 60.0)}
    score = {r.node: r.score for r in catalogue.QUERIES["whole_pagerank"](spark, str(tmp_path)).collect()}
    assert len(score) == 6 and abs(sum(score.values()) - 1) < 1e-6


def test_walks_go_by_weight_whatever_the_degree(spark):
    """A hub with one heavy and many light arcs: a row a walker, and shares as the weights are."""
    arcs = spark.createDataFrame([("hub", "heavy", 300.0)] + [("hub", f"n{i:03d}", 1.0 + i % 2) for i in range(200)], "src string, dst string, weight double")
    guide = walks.guided(arcs).collect()
    assert len(guide) <= 2 * 201 and {r.slot for r in guide} == set(range(201)) and max(r.hi for r in guide) == 1.0 and min(r.lo for r in guide) == 0.0
    starts = spark.createDataFrame([("hub",), ("alone",)], "node string")
    got = walks.walks(starts, arcs, 1, 4000, 3).where("step = 1").collect()
    assert len(got) == 8000 and {r.node for r in got if r.start == "alone"} == {"alone"}
    heavy = sum(r.node == "heavy" for r in got)
    assert abs(heavy - 2000) < 4 * (4000 * 0.25) ** 0.5 and len({r.node for r in got}) > 190


def test_two_valued_bins_are_for_zero_and_one_only(spark):
    one = lambda x: distribution.distribution({"m": spark.createDataFrame([(float(a),) for a in x], "value double")}).collect()
    assert [(r.bins, r.lo, r.hi, r["count"]) for r in sorted(one([0, 1, 1]), key=lambda r: r.bin)] == [("unit", 0.0, 0.5, 1), ("unit", 0.5, 1.0, 2)]
    rows = one([5, 9, 9])
    assert {r.bins for r in rows} == {"linear", "unit", "log"} and sum(r["count"] for r in rows if r.bins == "linear") == 3 and all(r.pdf is not None for r in rows if r.bins != "unit")
    assert [(r.lo, r["count"]) for r in sorted(rows, key=lambda r: r.bin) if r.bins == "unit"] == [(5.0, 1), (6.0, 0), (7.0, 0)]


def test_scratch_tables_go(spark):
    with lineage.scratch(spark):
        rows = lineage.cut(spark.range(5), "gone")
        at = rows.inputFiles()
        assert rows.count() == 5
    import os

    assert at and not any(os.path.exists(f.removeprefix("file://")) for f in at)


def test_histograms(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 1, 2, 4, 10)], "value double")
    edges = distribution.linear_edges(1, 10)
    want, at = np.histogram([1, 1, 2, 4, 10], np.linspace(1, 10, 10))
    got = distribution.densities(distribution.histogram(v, edges)).orderBy("bin").collect()
    assert [r["count"] for r in got] == want.tolist() and np.allclose(edges, at)
    assert sum(r.pdf for r in got) == pytest.approx(1) and got[-1].ccdf == pytest.approx(0)
    assert distribution.unit_edges(1, 4) == [1, 2, 3] and distribution.unit_edges(0, 1, True) == [0, 0.5, 1] and distribution.log_edges(0.1, 0.9) == []
    assert distribution.log_edges(1, 1000)[-1] == pytest.approx(1000)
    assert distribution.power_law(v).first().gamma == pytest.approx(1 + 5 / sum(math.log(x / 0.5) for x in (1, 1, 2, 4, 10)))
    assert distribution.unknown_share(spark.createDataFrame([(-1.0,), (3.0,)], "value double")).first()[0] == 0.5
    m = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (0.0, 5.0)], "x double, mass double")
    assert {r.bin: r.mass for r in distribution.rebinned(m, [0.0, 1.0, 2.0]).collect()} == {0: 2.0, 1: 3.0}
    assert distribution.distribution({"x": v}).select("bins").distinct().count() == 3


def test_clustering_and_neighbours(spark, triangle):
    v, e = net(spark, [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1)], "abcdz")
    got = {r.node: r.clustering for r in centrality.clustering(v, e).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": pytest.approx(1 / 3), "d": 0.0, "z": 0.0}
    assert centrality.mean_neighbour_degree(e).first().value == pytest.approx((1.5 + 0.5) / 2)


def test_distances(spark):
    v, e = net(spark, [(i, i + 1, 1) for i in range(4)])
    ecc = centrality.eccentricity(v, e)
    assert {r.node: r.ecc for r in ecc.collect()} == {"0": 4, "1": 3, "2": 2, "3": 3, "4": 4}
    r = centrality.radius_diameter(ecc).first()
    assert (r.radius, r.diameter) == (2, 4)
    s = {r.node: r.score for r in centrality.scaled_eccentricity(ecc).collect()}
    assert s["2"] == pytest.approx(1.0) and s["0"] == pytest.approx(0.1)
    v, e = net(spark, [("a", "b", 1), ("c", "d", 1), ("d", "e", 1)])
    with pytest.raises(ValueError):
        centrality.eccentricity(v, e)
    w, f = net(spark, [(f"{i:02d}", f"{i + 1:02d}", 1) for i in range(30)] + [("05", f"x{i}", 1) for i in range(9)])
    whole = {r.source: r.d for r in centrality.hops(f).groupBy("source").agg(F.max("depth").alias("d")).collect()}
    assert {r.node: r.ecc for r in centrality.eccentricity(w, f, 4).collect()} == whole
    assert {r.node for r in centrality.largest_component(v, e).collect()} == {"c", "d", "e"}


def test_hops_of_all_nodes_are_those_of_joins(spark, monkeypatch):
    """More sources than a word has bits, two parts, a loop; a path longer than allowed."""
    edges = [(f"{i:03d}", f"{i * 7 % 150:03d}", 1) for i in range(150)] + [("x", "y", 1), ("y", "z", 1), ("x", "x", 1)]
    _, e = net(spark, edges)
    got = centrality._all_hops(network.both_ways(network.undirected(e)).select("src", "dst").where("src <> dst"), 1000)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in centrality.hops(e).collect()}
    monkeypatch.setattr(shipped, "MOST_ARCS", 0)
    joined = centrality.hops(e)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in joined.collect()} and got.count() == joined.count() and got.schema.names == joined.schema.names
    with pytest.raises(RuntimeError):
        shipped.depths(shipped.Arcs(3, np.array([0, 1, 1, 2]), np.array([1, 0, 2, 1]), np.ones(4)), np.array([0]), 1)


def test_pagerank_and_eigenvector_are_numpy(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 4)]
    v, e = net(spark, edges + [("c", "z", 1)])
    names = [r.node for r in v.orderBy("idx").collect()]
    a = np.zeros((5, 5))
    for x, y, w in edges + [("c", "z", 1)]:
        a[names.index(x), names.index(y)] = w
    p, out = np.full(5, 0.2), a.sum(1)
    for _ in range(200):
        flow = sum(p[i] * (a[i] / out[i] if out[i] else np.full(5, 0.2)) for i in range(5))
        p = 0.85 * flow + 0.15 / 5
    got = {r.node: r.score for r in centrality.pagerank(v, e, tol=1e-10, normalise=False).collect()}
    assert np.allclose([got[n] for n in names], p, atol=1e-6) and sum(got.values()) == pytest.approx(1)
    v, e = net(spark, edges[:4])
    m = a[:3, :3]
    w, vec = np.linalg.eig(m.T)
    lead = np.abs(vec[:, w.real.argmax()].real)
    got = {r.node: r.score for r in centrality.eigenvector(v, e, 300, 1e-10).collect()}
    assert np.allclose([got[n] for n in "abc"], lead / lead.max(), atol=1e-5)


def test_betweenness_by_all_paths(spark):
    v, e = net(spark, [("a", "b", 1), ("b", "c", 1), ("a", "d", 1), ("d", "c", 1), ("c", "f", 2)])
    got = {r.node: r.score for r in centrality.betweenness(v, e, False).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 3.0, "d": 1.0, "f": 0.0}


def test_betweenness_of_many_sources_at_once_is_that_of_each():
    """With ties, loops, parts that don't reach each other, and an arc that no path takes; and without the order by a hub."""
    rng = np.random.default_rng(5)
    for n, m, top in ((40, 300, 4), (60, 120, 30), (30, 200, 1)):
        a, b = rng.integers(0, n, (2, m))
        key = np.unique((a * n + b)[a != b])
        net = shipped.Arcs(n, key // n, key % n, rng.integers(1, top + 1, len(key)) * 10.0)
        want = np.zeros(n)
        for s in range(n):
            centrality._brandes(net.first, net.dst, net.weight, s, want)
        paths = centrality.Paths(net)
        got = sum(centrality.dependencies(paths, np.arange(i, min(n, i + 7))) for i in range(0, n, 7))
        assert np.allclose(got, want) and want.max() > 0
    assert centrality.dependencies(paths, np.arange(3), 1) is None
    net.weight[0] = 0.0
    assert centrality.dependencies(centrality.Paths(net), np.arange(3)) is None


def test_expected_visits(spark, triangle):
    v, e = triangle
    got = {(r.start, r.visited): r.avg_visits for r in walks.expected(v.select("node"), walks.undirected_arcs(e), 4).collect()}
    want = [[1.640625, 1.6796875, 1.6796875], [0.83984375, 2.43359375, 1.7265625], [0.83984375, 1.7265625, 2.43359375]]
    assert all(got[str(i), str(j)] == pytest.approx(want[i][j]) for i in range(3) for j in range(3))


def test_relevance_without_a_table_of_all_pairs(spark, tmp_path, monkeypatch):
    """Column sums of the space come from rows that are never written, and are those of the space; joins give the same."""
    monkeypatch.setattr(catalogue, "LEAST", 1)
    texts = ["a b c a d a e a f", "b c d", "x y x z", "f g g h"]
    spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    v, e, s = catalogue._space(spark, str(tmp_path), 2)
    want = {r.visited: (round(r.relevance, 6), round(r.uncertainty, 6)) for r in describe.relevance(s, v.count()).collect()}
    score = lambda: {r.visited: (round(r.relevance, 6), round(r.uncertainty, 6)) for r in catalogue.QUERIES["relevance_uncertainty"](spark, str(tmp_path)).collect()}
    with monkeypatch.context() as m:
        m.setattr(shipped, "MOST_ARCS", 0)
        assert score() == want
    monkeypatch.setattr(walks, "expected", None)
    monkeypatch.setattr(shipped, "PORTION", 7)
    assert score() == want and len(want) == 11


def test_walks(spark, triangle):
    v, e = triangle
    v = v.union(spark.createDataFrame([(3, "lone")], v.schema))
    paths = walks.walks(v.select("node"), walks.undirected_arcs(e), 4, 300, 2)
    space = walks.association(paths, 300)
    assert all(r.s == pytest.approx(5) for r in space.groupBy("start").agg(F.sum("avg_visits").alias("s")).collect())
    got = {(r.start, r.visited): r.avg_visits for r in space.collect()}
    assert got["lone", "lone"] == 5 and got["1", "1"] == pytest.approx(2.43, abs=0.2)
    with pytest.raises(ValueError):
        walks.walks(v, e, (4, 7))
    rel = {r.visited: r for r in describe.relevance(space, 4).collect()}
    assert max(r.relevance for r in rel.values()) == pytest.approx(1)


def test_communities(spark):
    two = [(a, b, 1) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("a", "w", 1)]
    v, e = net(spark, two)
    got = {r.node: r.cluster for r in community.greedy(v, e).collect()}
    assert len({got[x] for x in "abcd"}) == 1 and len({got[x] for x in "wxyz"}) == 1 and got["a"] != got["w"]
    m = community.modularity(e, community.greedy(v, e)).first().modularity
    assert m == pytest.approx(12 / 13 - 2 * (13 / 26) ** 2)
    fluid = {r.node: r.cluster for r in community.fluid(v, e, 2, 3).collect()}
    assert set(fluid.values()) <= {0, 1} and len(fluid) == 8
    space = community.vectors(walks.expected(v.select("node"), walks.undirected_arcs(e), 2), v)
    k = {r.node: r.cluster for r in community.clustered(space, 2, 1).collect()}
    assert k["b"] == k["c"] == k["d"] != k["x"]
    xy = np.array([r.coordinates for r in community.principal(space, 2).collect()])
    assert xy.shape == (8, 2) and np.abs(xy.mean(0)).max() < 1e-9
    assert len(community.principal(space).first().coordinates) >= 1


def test_greedy_merging_of_any_size(spark):
    """The pair of the largest gain merges each time, also of more than 20,000 nodes."""
    rng = np.random.default_rng(2)
    for n, m in ((12, 30), (25, 60), (9, 8)):
        key = np.unique((lambda a, b: np.minimum(a, b) * n + np.maximum(a, b))(*rng.integers(0, n, (2, m))))
        a, b, w = key // n, key % n, rng.random(len(key)) + 0.1
        sets, total = [{i} for i in range(n)], 2 * w.sum()
        degree = np.bincount(a, w, n) + np.bincount(b, w, n)
        while True:
            gain = {}
            for i, x in enumerate(sets):
                for j in range(i + 1, len(sets)):
                    between = sum(c for p, q, c in zip(a, b, w) if (p in x and q in sets[j]) or (q in x and p in sets[j]))
                    if between:
                        gain[i, j] = 2 * (between / total - degree[list(x)].sum() * degree[list(sets[j])].sum() / total**2)
            if not gain or max(gain.values()) <= 0:
                break
            i, j = max(gain, key=gain.get)
            sets[i] |= sets.pop(j)
        assert sorted(map(sorted, community.merged(n, a, b, w))) == sorted(map(sorted, sets))
    ring = spark.range(20_004).select(F.format_string("%05d", "id").alias("src"), F.format_string("%05d", (F.col("id") + 1) % 20_004).alias("dst"), F.lit(0).alias("key"), F.col("id").alias("ord"), F.lit(1.0).alias("weight"))
    nodes = spark.range(20_004).select(F.col("id").alias("idx"), F.format_string("%05d", "id").alias("node"))
    got = community.greedy(nodes, ring)
    assert got.count() == 20_004 and 10 < got.select("cluster").distinct().count() < 2000


def test_principal_coordinates_of_more_columns_than_a_covariance_matrix(spark, monkeypatch):
    """Also where components are alike: two equal halves."""
    monkeypatch.setattr(community, "MOST_COLUMNS", 3)
    half = [(a, b, w) for g in "xy" for a, b, w in ((g + "1", g + "2", 1), (g + "2", g + "3", 2), (g + "3", g + "4", 1), (g + "1", g + "4", 5))]
    v, e = net(spark, [*half, ("z", "x1", 3), ("z", "y1", 3)], ["alone", *(g + i for g in "xy" for i in "1234"), "z"])
    names = [r.node for r in v.orderBy("idx").collect()]
    x = np.zeros((10, 10))
    for r in walks.expected(v.select("node"), walks.undirected_arcs(e), 2).collect():
        x[names.index(r.start), names.index(r.visited)] = r.avg_visits
    x -= x.mean(0)
    u, s, _ = np.linalg.svd(x)
    for k in (2, 5, 10):
        got = {r.start: r.coordinates for r in community.principal_walks(v, walks.undirected_arcs(e), 2, k).collect()}
        xy = np.array([got[n] for n in names])
        assert np.allclose(np.linalg.norm(xy, axis=0), s[:k], atol=1e-7) and np.allclose(xy @ xy.T, x @ x.T if k == 10 else (u[:, :k] * s[:k] ** 2) @ u[:, :k].T, atol=1e-6)


def test_clusters_of_more_columns_than_vectors(spark, monkeypatch):
    """Each row is with the mean that is nearest to it."""
    monkeypatch.setattr(community, "MOST_COLUMNS", 3)
    monkeypatch.setattr(shipped, "PORTION", 20)
    rng = np.random.default_rng(4)
    v, e = net(spark, [(f"{g}{a}", f"{g}{b}", int(rng.integers(1, 9))) for g in "pqr" for a, b in rng.integers(0, 6, (12, 2)) if a != b] + [("p0", "q0", 1), ("q0", "r0", 1)])
    names = [r.node for r in v.orderBy("idx").collect()]
    x = np.zeros((len(names), len(names)))
    for r in walks.expected(v.select("node"), walks.undirected_arcs(e), 2).collect():
        x[names.index(r.start), names.index(r.visited)] = r.avg_visits
    got = {r.node: r.cluster for r in community.clustered_walks(v, walks.undirected_arcs(e), 2, 3, 1).collect()}
    label = np.array([got[n] for n in names])
    assert sorted(set(label)) == [0, 1, 2]
    d = ((x[:, None] - np.stack([x[label == c].mean(0) for c in range(3)])) ** 2).sum(2)
    assert (d.argmin(1) == label).all()
    assert {r.cluster for r in community.clustered_walks(v, walks.undirected_arcs(e), 2, 1).collect()} == {0}


def lexicon(spark):
    lex = spark.createDataFrame([("hot", "h1", 2), ("warm", "h1", 3), ("cold", "c1", 4), ("cat", "k1", 5), ("dog", "d1", 5)], "word string, synset string, min_depth int")
    lemmas = spark.createDataFrame([("h1", "hot"), ("c1", "cold"), ("k1", "cat"), ("d1", "dog")], "synset string, lemma string")
    anti = spark.createDataFrame([("hot", "cold")], "lemma string, antonym string")
    up = spark.createDataFrame([("k1", "animal", 1), ("d1", "animal", 1)], "synset string, parent string, hops int")
    return lex, lemmas, anti, up


def test_lexical_enrichment(spark):
    v, e = net(spark, [("hot", "warm", 1), ("cold", "hot", 1), ("cat", "dog", 2), ("cat", "blorp", 1), ("kitten", "sitting", 1)])
    v, e = lexical.enriched(v, e, *lexicon(spark))
    got = {(r.src, r.dst): r for r in e.collect()}
    assert (got["hot", "warm"].synonyms, got["hot", "warm"].antonyms, got["hot", "warm"].path_similarity) == (1, 0, 1.0)
    assert (got["cold", "hot"].synonyms, got["cold", "hot"].antonyms) == (0, 1)
    assert got["cat", "dog"].path_similarity == 0.333 and got["cat", "dog"].edit_distance == 3
    assert got["cat", "blorp"].synonyms is None and got["kitten", "sitting"].edit_distance is None
    _, always = lexical.enriched(v, e.select("src", "dst", "key", "ord", "weight"), *lexicon(spark), always_distance=True)
    assert {(r.src, r.dst): r.edit_distance for r in always.collect()}["kitten", "sitting"] == 3
    assert {r.node: r.depth for r in v.collect()} | {"blorp": None} == {"hot": 2, "warm": 3, "cold": 4, "cat": 5, "dog": 5, "blorp": None, "kitten": None, "sitting": None}
    n = {r.node: r for r in describe.node_lexical(v, e).collect()}
    assert n["hot"].path_max == 1.0 and n["blorp"].path_max == -1.0 and n["cat"].edit_avg == 3.0
    m = {r.metric: r.value for r in describe.lexical(v, e).collect()}
    assert m["depth_max"] == 5 and m["synonyms_avg"] == pytest.approx(0.25)
    assert describe.restricted(v, e, 5).select("subgraph").distinct().count() == 5 and describe.restricted(v, e, 2, True).count() > 0
    assert lexical.with_marks(e).where("synonyms = -1").count() == 2
    tags = v.select("node", (F.col("idx") % 2).cast("int").alias("tag"))
    clusters = v.select("node", F.when(F.col("node").isin("hot", "warm", "cold"), 0).otherwise(1).alias("cluster"))
    report = describe.cluster_report(e, clusters, v.select("node", F.lit(1.0).alias("relevance")), tags)
    assert report.count() == 2 and report.where("cluster = 0").first().edges_inside == 2


def test_numeric_bundle(spark, triangle):
    got = {r.metric: r.value for r in describe.numeric(*triangle).collect()}
    assert got["nodes"] == 3 and got["edges"] == 3 and got["max_strength"] == 4 and got["avg_clustering"] == 1 and got["max_weight"] == 3 and len(got) == 16


def test_pajek(spark, tmp_path):
    path = tmp_path / "g.net"
    path.write_text('% note\r\n*Vertices 3\r\n1 "a b"\r\n2 "c"\r\n3 d 0.1 0.2\r\n*Arcs\r\n1 2 2.5\r\n1 2 3\r\n2 3\r\n*Edges\r\n1 3 4\r\n')
    v, e = graph_files.pajek(spark, f"file://{path}")
    assert {(r.idx, r.node) for r in v.collect()} == {(0, "a b"), (1, "c"), (2, "d")}
    assert sorted((r.src, r.dst, r.key, r.weight) for r in e.collect()) == [("a b", "c", 0, 2.5), ("a b", "c", 1, 3.0), ("a b", "d", 0, 4.0), ("c", "d", 0, 1.0), ("d", "a b", 0, 4.0)]
    assert graph_files.without_artefacts(v, e)[0].count() == 3
    bad = v.union(spark.createDataFrame([(9, "*Arcs"), (10, ":2")], v.schema))
    assert graph_files.without_artefacts(bad, e)[0].count() == 3
    v2, e2 = graph_files.graph(e.select("src", "dst", "weight"))
    assert v2.count() == 3 and e2.count() == 5


def test_partition_and_arrays(spark, tmp_path):
    path = tmp_path / "p.clu"
    path.write_text("% a\r\n*vertices 4\r\n0\r\n1\r\n9\r\n1\r\n")
    tags = graph_files.partition(spark, f"file://{path}")
    assert [(r.idx, r.tag) for r in tags.orderBy("idx").collect()] == [(0, 0), (1, 1), (2, 9), (3, 1)]
    assert {r.tag: (r.n, r.share) for r in describe.tag_frequency(tags).collect()} == {0: (1, 0.25), 1: (2, 0.5), 9: (1, 0.25)}
    assert describe.tag_text(tags, graph_files.TAGS).first().text == "None: 0.25, N: 0.5, A: 0.25"
    np.save(tmp_path / "x.npy", np.arange(6.0).reshape(3, 2))
    got = graph_files.arrays(spark, f"file://{tmp_path / 'x.npy'}")
    assert [(r.id, r.features) for r in got.orderBy("id").collect()] == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    graph_files.descriptors_text(tags, f"file://{tmp_path / 'out'}")
    assert spark.read.text(f"file://{tmp_path / 'out'}").count() == 4
    assert graph_files.pretty({"a": {"b": 1}}) == "a:\n  b:\n    1"


def test_cache_is_keyed_by_rows(spark):
    made = []

    def compute(n):
        made.append(n)
        return spark.range(n).withColumnRenamed("id", "x")

    a, b = spark.range(3), spark.range(4)
    for df, n in ((a, 1), (a, 1), (b, 2), (a.repartition(5), 1)):
        assert lineage.cached("t", [df], {"k": 1}, lambda n=n: compute(n)).count() == n
    assert made == [1, 2]
