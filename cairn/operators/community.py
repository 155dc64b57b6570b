"""Communities of networks and clusters of association spaces."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import network, shipped
from cairn.plans.lineage import cut

#: Columns up to which spaces become vectors.
MOST_COLUMNS = 4_096


def fluid(vertices: DataFrame, edges: DataFrame, k: int, seed: int = 0, most: int = 100) -> DataFrame:
    """(node, cluster): k communities spread from k seeds by synchronous propagation.

    A node takes the community with the largest density among itself and its neighbours, a community's density being one
    over its size; ties go to the node's own, then to the lowest number. Nodes that no community has reached wait. Half
    of the nodes, by hash of round and node, may move in a round, which keeps pairs from swapping for ever.
    """
    arcs = cut(network.both_ways(network.undirected(edges)).where("src <> dst").select("src", "dst"), "arcs")
    first = vertices.select("node").orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(k).collect()  # k rows
    start = vertices.sparkSession.createDataFrame([(r.node, i) for i, r in enumerate(first)], "node string, cluster int")
    state = cut(vertices.select("node").join(start, "node", "left"), "fluid")
    rest = 0
    for t in range(most):
        size = state.where("cluster is not null").groupBy("cluster").agg((1.0 / F.count("*")).alias("density"))
        votes = arcs.unionByName(vertices.select(F.col("node").alias("src"), F.col("node").alias("dst"))).join(state.withColumnRenamed("node", "dst"), "dst").where("cluster is not null").join(size, "cluster").groupBy(F.col("src").alias("node"), "cluster").agg(F.sum("density").alias("v"))
        own = votes.join(state.withColumnRenamed("cluster", "own"), "node")
        best = own.groupBy("node").agg(F.max_by("cluster", F.struct(F.round("v", 12), (F.col("own").eqNullSafe(F.col("cluster"))).cast("int"), -F.col("cluster"))).alias("best"))
        may = (F.pmod(F.xxhash64("node", F.lit(seed), F.lit(t)), F.lit(2)) == 0) | F.col("cluster").isNull()
        new = cut(state.join(best, "node", "left").select("node", F.when(may, F.coalesce("best", "cluster")).otherwise(F.col("cluster")).alias("cluster"), F.col("cluster").alias("old")), "fluid")
        rest = rest + 1 if new.where(~F.col("cluster").eqNullSafe(F.col("old"))).isEmpty() else 0
        state = new.select("node", "cluster")
        if rest >= 3:
            break
    return state


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(modularity) of a partition (node, cluster) of the weighted undirected network."""
    pairs = network.undirected(edges)
    ends = pairs.select(F.col("a").alias("node"), "weight").unionByName(pairs.select(F.col("b").alias("node"), "weight"))
    degree = ends.join(clusters, "node").groupBy("cluster").agg(F.sum("weight").alias("d"))
    c = clusters.select("node", "cluster")
    inside = pairs.join(c.withColumnsRenamed({"node": "a", "cluster": "ca"}), "a").join(c.withColumnsRenamed({"node": "b", "cluster": "cb"}), "b").where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.sum("weight").alias("w"))
    m = pairs.agg(F.sum("weight").alias("m"))
    both = degree.join(inside, "cluster", "left").crossJoin(F.broadcast(m))  # one row
    return both.agg(F.sum(F.coalesce("w", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


def merged(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> list[list[int]]:
    """Members of the communities of greedy merging for modularity, of n nodes and undirected edges (a, b, weight); the largest first.

    Of the two that merge, the one with more neighbours stays, so an edge moves a logarithmic number of times. A pair's
    gain falls as its communities grow, and rises only with its weight, when it gets a new entry: what the heap holds is
    an upper bound, which is corrected when it comes up.
    """
    degree = np.bincount(a, weight, n) + np.bincount(b, weight, n)
    total = float(degree.sum()) or 1.0
    share = (degree / total).tolist()
    w: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, x in zip(a.tolist(), b.tolist(), (weight / total).tolist(), strict=True):
        if i != j:
            w[i][j] = w[j][i] = x
    heap = [(-2 * (x - share[i] * share[j]), i, j) for i in range(n) for j, x in w[i].items() if i < j]
    heapq.heapify(heap)
    members, alive = [[i] for i in range(n)], [True] * n
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound >= 0:
            break
        if not (alive[i] and alive[j]):
            continue
        gain = -2 * (w[i][j] - share[i] * share[j])
        if gain != bound:
            if gain < 0:
                heapq.heappush(heap, (gain, i, j))
            continue
        # j joins i
        if len(w[j]) > len(w[i]):
            i, j = j, i
        own, s = w[i], share[i] + share[j]
        share[i], alive[j] = s, False
        del own[j]
        for k, x in w[j].items():
            if k != i:
                del w[k][j]
                own[k] = w[k][i] = x = own.get(k, 0.0) + x
                if (gain := -2 * (x - s * share[k])) < 0:
                    heapq.heappush(heap, (gain, min(i, k), max(i, k)))
        w[j] = {}
        members[i] += members[j]
        members[j] = []
    return sorted((m for m, here in zip(members, alive, strict=True) if here), key=lambda m: (-len(m), min(m)))


def greedy(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, cluster) by greedy merging for modularity; larger communities have lower numbers.

    Merging is a sequence, so it runs on the driver, which holds the network: some 300 bytes an edge, whatever their number.
    """
    rows = network.relabelled(network.undirected(edges).withColumnsRenamed({"a": "src", "b": "dst"}), vertices).select("src", "dst", F.col("weight").cast("double")).toArrow()
    communities = merged(vertices.count(), *(rows[c].to_numpy() for c in ("src", "dst", "weight")))
    idx = np.array([i for m in communities for i in m], np.int64)
    return _named(vertices, idx, "cluster", pa.array(np.repeat(np.arange(len(communities), dtype=np.int32), [len(m) for m in communities])))


def _named(vertices: DataFrame, idx: np.ndarray, name: str, values: pa.Array, node: str = "node") -> DataFrame:
    """(node, name) of values by the numbers of vertices (idx, node)."""
    rows = vertices.sparkSession.createDataFrame(pa.table({"idx": pa.array(idx, pa.int64()), name: values}))
    return vertices.select("idx", F.col("node").alias(node)).join(rows, "idx").select(node, name)


def vectors(space: DataFrame, columns: DataFrame) -> DataFrame:
    """(start, features) of an association space, as sparse vectors over columns (idx, node), at most MOST_COLUMNS."""
    from pyspark.ml.functions import array_to_vector

    n = columns.count()
    if n > MOST_COLUMNS:
        raise ValueError(f"{n} columns are more than a covariance matrix holds ({MOST_COLUMNS})")
    rows = space.join(columns.select(F.col("node").alias("visited"), "idx"), "visited").groupBy("start").agg(F.map_from_entries(F.collect_list(F.struct("idx", "avg_visits"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return rows.select("start", array_to_vector(dense).alias("features"))


def clustered(space: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(node, cluster) of an association space's rows (start, features) by k-means."""
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(space).transform(space).select(F.col("start").alias("node"), "cluster")


def principal(space: DataFrame, components: int | None = None, variance: float = 0.98) -> DataFrame:
    """(start, coordinates): centered projection on the first components; without a number, on as many as have a cumulative share of variance below variance, one at least."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    first = space.select(F.size(vector_to_array("features")).alias("n")).first()
    if first is None:
        return space.select("start", F.array().cast("array<double>").alias("coordinates"))
    width = first.n
    model = PCA(k=components or width, inputCol="features", outputCol="out").fit(space)
    keep = components or max(1, int((np.cumsum(model.explainedVariance.toArray()) < variance).sum()))
    mean = space.select(Summarizer.mean(F.col("features")).alias("m")).first().m.toArray()
    shift = mean @ model.pc.toArray()[:, :keep]
    out = F.slice(vector_to_array("out"), 1, keep)
    return model.transform(space).select("start", F.zip_with(out, F.array(*[F.lit(float(x)) for x in shift]), lambda x, m: x - m).alias("coordinates"))


def _transitions(vertices: DataFrame, arcs: DataFrame) -> shipped.Arcs:
    net = shipped.collected(vertices, arcs)
    if net is None:
        raise ValueError(f"there are more arcs than the driver holds ({shipped.MOST_ARCS})")
    return shipped.transitions(net)


def clustered_walks(vertices: DataFrame, arcs: DataFrame, steps: int, k: int, seed: int = 0, most: int = 100) -> DataFrame:
    """(node, cluster): k-means of the rows of walks.expected() from all vertices, of any number of columns, without a table of them.

    A center is a mean of rows, so its products with all rows, and the means of clusters, are products with the network's
    arcs; tasks make the rows once, for their norms. Starts are drawn by squared distance; ends when no row moves.
    """
    p = _transitions(vertices, arcs)
    if not p.n:
        return _named(vertices, np.zeros(0, np.int64), "cluster", pa.array([], pa.int32()))
    t = shipped.moments(vertices, p, steps).select("idx", "norm").toArrow()
    norm = np.empty(p.n)
    norm[t["idx"].to_numpy()] = t["norm"].to_numpy()
    space, rng = shipped.Space(p, steps), np.random.default_rng(seed)
    one = lambda i: space.transposed((np.arange(p.n) == i).astype(float))
    away = lambda c: norm - 2 * space.times(c) + c @ c
    centers = [one(rng.integers(p.n))]
    near = away(centers[0])
    while len(centers) < k and (near > 1e-9 * norm.max()).any():
        share = np.where(near > 1e-9 * norm.max(), near, 0.0)
        centers.append(one(rng.choice(p.n, p=share / share.sum())))
        near = np.minimum(near, away(centers[-1]))
    label = np.full(p.n, -1)
    for _ in range(most):
        d = np.stack([away(c) for c in centers])
        new = d.argmin(0)
        for c in np.flatnonzero(np.bincount(new, minlength=len(centers)) == 0):
            new[d.min(0).argmax()] = c  # an empty cluster gets the row that is farthest off
        if (new == label).all():
            break
        label = new
        centers = [space.transposed((label == c) / max(1, (label == c).sum())) for c in range(len(centers))]
    return _named(vertices, np.arange(p.n), "cluster", pa.array(label.astype(np.int32)))


def _component(times, n: int, found: list[np.ndarray], rng, steps: int = 200, tol: float = 1e-12) -> np.ndarray:
    """The leading eigenvector, orthogonal to those found, of a positive matrix that times() multiplies with: Lanczos with full orthogonalisation, restarted from its best vector."""

    def clean(x: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            for b in (*found, *basis):
                x = x - (b @ x) * b
        return x

    v = clean(rng.standard_normal(n), [])
    v /= np.linalg.norm(v)
    while True:
        basis, on, off = [v], [], []
        while True:
            x = times(basis[-1])
            on.append(basis[-1] @ x)
            x = clean(x, basis)
            beta = np.linalg.norm(x)
            value, vector = np.linalg.eigh(np.diag(on) + np.diag(off, 1) + np.diag(off, -1))
            done = beta * abs(vector[-1, -1]) <= tol * max(value[-1], np.finfo(float).tiny) or len(basis) + len(found) >= n
            if done or len(basis) == steps:
                break
            off.append(beta)
            basis.append(x / beta)
        v = clean(sum(c * b for c, b in zip(vector[:, -1], basis, strict=True)), [])
        v /= np.linalg.norm(v)
        if done:
            return v


def principal_walks(vertices: DataFrame, arcs: DataFrame, steps: int, components: int) -> DataFrame:
    """(start, coordinates): principal() of the rows of walks.expected() from all vertices, of any number of columns, without a table of them: products with the network's arcs give the components."""
    p = _transitions(vertices, arcs)
    space, rng = shipped.Space(p, steps), np.random.default_rng(0)
    mean = space.transposed(np.ones(p.n)) / max(1, p.n)
    centered = lambda x: space.times(x) - mean @ x
    back = lambda y: space.transposed(y) - mean * y.sum()
    found: list[np.ndarray] = []
    for _ in range(min(components, p.n)):
        found.append(_component(lambda x: back(centered(x)), p.n, found, rng))
    xy = np.stack([centered(v) for v in found], 1) if found else np.zeros((0, 0))
    values = pa.array(xy.tolist(), pa.list_(pa.float64()))
    return _named(vertices, np.arange(p.n), "coordinates", values, "start")
