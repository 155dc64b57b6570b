"""Centralities and distances of networks, by joins and aggregations that the driver repeats until they rest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import max_normalised, ordinal
from cairn.operators import network, shipped
from cairn.plans.lineage import cut

#: Arcs up to which betweenness ships the network to every task.
MOST_ARCS = 5_000_000


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles) of the simple undirected network: paths over the end of lower degree, closed by a third edge."""
    pairs = network.undirected(edges).where("a <> b").select("a", "b")
    deg = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    d = pairs.join(deg.withColumnsRenamed({"node": "a", "count": "da"}), "a").join(deg.withColumnsRenamed({"node": "b", "count": "db"}), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    up = cut(d.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v")), "oriented")
    wedge = up.join(up.withColumnRenamed("v", "w"), "u").where("v < w")
    third = pairs.select(F.col("a").alias("v"), F.col("b").alias("w"))
    return wedge.join(third, ["v", "w"]).select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, clustering): closed share of each node's pairs of neighbours; 0 with fewer than two."""
    pairs = network.undirected(edges).where("a <> b")
    deg = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("k"))
    both = vertices.select("node").join(deg, "node", "left").join(triangles(edges), "node", "left").fillna(0, ["k", "triangles"])
    return both.select("node", F.when(F.col("k") >= 2, 2 * F.col("triangles") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))


def average_clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return clustering(vertices, edges).agg(F.avg("clustering").alias("value"))


def mean_neighbour_degree(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """(value): for each out-degree the mean out-degree of successors (weighted by edges where asked), then the mean of those."""
    arcs = network.digraph(edges)
    out = arcs.groupBy("src").agg(F.count("*").alias("k"), F.sum("weight").alias("s"))
    ends = arcs.join(out.select("src", "k", "s"), "src").join(out.select(F.col("src").alias("dst"), F.col("k").alias("kd")), "dst", "left").fillna(0, ["kd"])
    w = F.col("weight") if weighted else F.lit(1.0)
    by = ends.groupBy("k").agg((F.sum(w * F.col("kd")) / F.sum(w)).alias("m"))
    return by.agg(F.avg("m").alias("value"))


def hops(edges: DataFrame, most: int = 1000, sources: DataFrame | None = None) -> DataFrame:
    """(source, node, depth) of all pairs connected in the undirected network, or of those from sources (node): a frontier joined to its neighbours, level by level.

    A neighbour of a level is in it or in one beside it, so new pairs are told by the last two levels alone.
    From all nodes of a network of up to shipped.MOST_ARCS arcs, tasks go level by level for 64 sources at once instead.
    """
    arcs = cut(network.both_ways(network.undirected(edges)).select("src", "dst").where("src <> dst"), "arcs")
    if sources is None and (got := _all_hops(arcs, most)) is not None:
        return got
    starts = arcs.select(F.col("src").alias("source")).distinct() if sources is None else sources.select(F.col("node").alias("source")).distinct()
    seen = cut(starts.select("source", F.col("source").alias("node"), F.lit(0).alias("depth")), "hops")
    before, front, levels = seen.limit(0), seen, [seen]
    for depth in range(1, most + 1):
        step = front.select("source", F.col("node").alias("src")).join(arcs, "src").select("source", F.col("dst").alias("node")).distinct()
        last = before.unionByName(front).select("source", "node")
        before, front = front, cut(step.join(last, ["source", "node"], "left_anti").withColumn("depth", F.lit(depth)), "hops")
        if front.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(front)
    raise RuntimeError(f"distances above {most}")


def _all_hops(arcs: DataFrame, most: int) -> DataFrame | None:
    """hops() from all nodes, a row a source until the end; none where there are too many arcs (src, dst) to ship."""
    vertices = cut(ordinal(arcs.select(F.col("src").alias("node")).distinct(), "node").select("idx", "node"), "vertices")
    net = shipped.collected(vertices, arcs.withColumn("weight", F.lit(1.0)))
    if net is None:
        return None
    shared = arcs.sparkSession.sparkContext.broadcast(net)

    def f(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for part in parts:
            for i in range(0, len(part), 64):
                d = shipped.depths(net, part[i : i + 64], most)
                for j in range(0, len(d), 8):
                    x = np.ascontiguousarray(d[j : j + 8])
                    yield pa.RecordBatch.from_arrays([pa.array(part[i + j : i + j + len(x)]), pa.ListArray.from_arrays(np.arange(0, x.size + 1, net.n, dtype=np.int32), x.ravel())], ["source", "depths"])

    rows = shipped.over(vertices, f, "source long, depths array<smallint>")
    pairs = rows.select("source", F.posexplode("depths").alias("place", "depth")).where("depth >= 0")
    # a network of MOST_ARCS arcs at most
    named = F.broadcast(vertices)
    out = pairs.join(named.select(F.col("idx").alias("source"), F.col("node").alias("_source")), "source")
    out = out.join(named.select(F.col("idx").cast("int").alias("place"), "node"), "place")
    return out.select(F.col("_source").alias("source"), "node", F.col("depth").cast("int").alias("depth"))


def components(vertices: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """(node, component): the least name reachable, by spreading minima and shortcuts."""
    arcs = cut(network.both_ways(network.undirected(edges)).select("src", "dst"), "arcs")
    state = cut(vertices.select("node", F.col("node").alias("component")), "component")
    for _ in range(most):
        least = arcs.join(state.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("m"))
        new = state.join(least, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        # jump to the component of one's component
        jump = new.join(new.select(F.col("node").alias("component"), F.col("component").alias("far")), "component").select("node", F.least("component", "far").alias("component"), "old")
        jump = cut(jump, "component")
        state = jump.select("node", "component")
        if jump.where("component <> old").isEmpty():
            return state
    raise RuntimeError("components didn't settle")


def largest_component(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) of the component with the most nodes; the least name among ties."""
    c = components(vertices, edges)
    best = c.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return c.join(F.broadcast(best), "component").select("node")  # one row


def eccentricity(vertices: DataFrame, edges: DataFrame, batch: int = 256) -> DataFrame:
    """(node, ecc): the largest hop distance; raises where the network isn't connected.

    By bounds, not from all pairs: a source's distances d and eccentricity e bound a node's between max(d, e - d) and e + d.
    Each round takes sources among the nodes whose bounds differ, those with the highest upper and the lowest lower ones,
    twice as many as the round before, until all bounds meet. A round holds a row a node and source.
    """
    n = vertices.count()
    state = cut(vertices.select("node", F.lit(0).alias("lo"), F.lit(1 << 30).alias("hi")), "bounds")
    while not (open_ := state.where("lo < hi")).isEmpty():
        high, low = open_.orderBy(F.desc("hi"), "lo", "node").limit(batch // 2), open_.orderBy("lo", F.desc("hi"), F.desc("node")).limit(batch // 2)
        d = cut(hops(edges, sources=high.union(low).select("node").distinct()), "hops")
        own = d.groupBy("source").agg(F.max("depth").alias("e"), F.count("*").alias("reached"))
        if not own.where(F.col("reached") < n).isEmpty():
            raise ValueError("the network isn't connected; take one component")
        by = d.join(own, "source").groupBy("node").agg(F.max(F.greatest(F.col("depth"), F.col("e") - F.col("depth"))).alias("a"), F.min(F.col("e") + F.col("depth")).alias("b"))
        state = cut(state.join(by, "node", "left").select("node", F.greatest("lo", F.coalesce("a", F.lit(0))).alias("lo"), F.least("hi", F.coalesce("b", "hi")).alias("hi")), "bounds")
        batch *= 2
    return state.select("node", F.col("lo").alias("ecc"))


def radius_diameter(ecc: DataFrame) -> DataFrame:
    return ecc.agg(F.min("ecc").alias("radius"), F.max("ecc").alias("diameter"))


def scaled_eccentricity(ecc: DataFrame) -> DataFrame:
    """(node, score): 1 at the radius, 0.1 at the diameter."""
    r = radius_diameter(ecc)
    return ecc.crossJoin(F.broadcast(r)).select("node", (((F.col("diameter") - F.col("ecc")) / F.expr("nullif(diameter - radius, 0)")) * 0.9 + 0.1).alias("score"))  # one row


def pagerank(vertices: DataFrame, edges: DataFrame, alpha: float = 0.85, iterations: int = 100, tol: float = 1e-6, normalise: bool = True) -> DataFrame:
    """(node, score): weighted, dangling mass spread evenly; until the L1 change is below n tol."""
    arcs = network.digraph(edges)
    total = arcs.groupBy("src").agg(F.sum("weight").alias("total"))
    p = cut(arcs.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "transitions")
    n = vertices.count()
    dangling = vertices.select("node").join(p.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("dangling", F.lit(True))
    state = cut(vertices.select("node").join(dangling, "node", "left").select("node", F.coalesce("dangling", F.lit(False)).alias("dangling"), F.lit(1.0 / max(1, n)).alias("score")), "rank")
    for _ in range(iterations):
        lost = state.where("dangling").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        flow = p.join(state.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("score")).alias("flow"))
        new = state.join(flow, "node", "left").select("node", "dangling", (alpha * (F.coalesce("flow", F.lit(0.0)) + lost / n) + (1 - alpha) / n).alias("score"), F.col("score").alias("old"))
        new = cut(new, "rank")
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        state = new.drop("old")
        if change < n * tol:
            break
    out = state.select("node", "score")
    return max_normalised(out, "score") if normalise else out


def eigenvector(vertices: DataFrame, edges: DataFrame, iterations: int = 100, tol: float = 1e-6) -> DataFrame:
    """(node, score): dominant left eigenvector of the weighted adjacency by power iteration on A + I, over its maximum."""
    arcs = cut(network.digraph(edges), "arcs")
    n = vertices.count()
    state = cut(vertices.select("node", F.lit(1.0 / max(1, n)).alias("score")), "vector")
    for _ in range(iterations):
        flow = arcs.join(state.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("score")).alias("flow"))
        new = cut(state.join(flow, "node", "left").select("node", (F.col("score") + F.coalesce("flow", F.lit(0.0))).alias("score"), F.col("score").alias("old")), "vector")
        norm = new.agg(F.sqrt(F.sum(F.col("score") * F.col("score")))).first()[0] or 1.0
        new = new.withColumn("score", F.col("score") / norm)
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        state = cut(new.select("node", "score"), "vector")
        if change < n * tol:
            break
    return max_normalised(state, "score")


def _brandes(first: np.ndarray, to: np.ndarray, weight: np.ndarray, s: int, out: np.ndarray) -> None:
    """Adds the dependencies of source s: Dijkstra with path counts, then the nodes from the farthest back."""
    import heapq

    n = len(first) - 1
    dist, sigma = np.full(n, np.inf), np.zeros(n)
    before: list[list[int]] = [[] for _ in range(n)]
    dist[s], sigma[s] = 0.0, 1.0
    order, done, heap = [], np.zeros(n, bool), [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        done[u] = True
        order.append(u)
        for i in range(first[u], first[u + 1]):
            v, far = to[i], d + weight[i]
            if far < dist[v]:
                dist[v], sigma[v], before[v] = far, sigma[u], [u]
                heapq.heappush(heap, (far, v))
            elif far == dist[v] and not done[v]:
                sigma[v] += sigma[u]
                before[v].append(u)
    delta = np.zeros(n)
    for v in reversed(order):
        for u in before[v]:
            delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
        if v != s:
            out[v] += delta[v]


class Paths:
    """A network for shortest paths from many sources. A way over a hub bounds each distance from above, and each node's arcs are ordered so that those a bound leaves come first.

    An arc (u, v) is on a shortest path from s only where dist(s, u) + weight <= dist(s, hub) + dist(hub, v). slack is
    dist(hub, v) - weight, and many[u, j] counts u's arcs with a slack of lo + j * width or more: all of them for j = 0.
    """

    STEPS = 64

    def __init__(self, net: shipped.Arcs) -> None:
        self.net, self.step = net, net.weight.min(initial=np.inf)
        if not len(net.src) or self.step <= 0:
            return
        hub = int(np.argmax(np.minimum(np.bincount(net.src, minlength=net.n), np.bincount(net.dst, minlength=net.n))))
        self.to_hub = self.distances(net.dst, net.src, hub)
        slack = self.distances(net.src, net.dst, hub)[net.dst] - net.weight
        order = np.lexsort((-slack, net.src))
        net.dst, net.weight, slack = net.dst[order], net.weight[order], slack[order]
        some = slack[np.isfinite(slack)]
        self.lo, hi = np.quantile(some, (0.01, 0.999)) if len(some) else (0.0, 0.0)
        self.width = max(hi - self.lo, self.step) / self.STEPS
        j = np.clip(np.floor((slack - self.lo) / self.width * (1 + 1e-9) + 1e-6), 0, self.STEPS - 1).astype(np.int64)
        by = np.bincount(net.src * np.int64(self.STEPS) + j, minlength=net.n * self.STEPS).reshape(net.n, -1)
        self.many = by[:, ::-1].cumsum(1)[:, ::-1].astype(np.int32).ravel()

    def distances(self, of: np.ndarray, to: np.ndarray, s: int) -> np.ndarray:
        dist = np.full(self.net.n, np.inf)
        dist[s] = 0.0
        while True:
            new = dist.copy()
            np.minimum.at(new, to, dist[of] + self.net.weight)
            if (new == dist).all():
                return dist
            dist = new

    def out(self, u: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs.out() of nodes u, without the arcs that no shortest path takes where u lies beyond farther from the source than the hub."""
        j = np.clip((beyond - self.lo) / self.width - 1e-3, 0, self.STEPS - 1).astype(np.int64)
        k = self.many[u * self.STEPS + j]
        return k, np.arange(k.sum(dtype=np.int64)) + np.repeat(self.net.first[u] - (np.cumsum(k, dtype=np.int64) - k), k)


def dependencies(paths: Paths, sources: np.ndarray, most: int = 2000) -> np.ndarray | None:
    """The dependencies of sources, added up: shortest paths from all of them at once, in bands as wide as the least weight.

    An arc is at least that long, so what is nearest within a band has its distance and its number of paths, whatever the
    order in the band. None where weights aren't above 0 or there would be more than most bands.
    """
    net, n, base = paths.net, paths.net.n, np.arange(len(sources)) * paths.net.n
    dist, sigma, slot = np.full(len(sources) * n, np.inf), np.zeros(len(sources) * n), np.empty(len(sources) * n, np.int32)
    own = base + sources
    dist[own], sigma[own] = 0.0, 1.0
    if not len(net.src):
        return np.zeros(n)
    if paths.step <= 0:
        return None
    hub = paths.to_hub[sources]
    left, trail = own, []
    while len(left):
        if len(trail) >= most:
            return None
        d = dist[left]
        near = d < d.min() + paths.step
        now, d, left = left[near], d[near], left[~near]
        row = now // n
        u = now - row * n
        k, at = paths.out(u, d - hub[row])
        far = np.repeat(d, k)
        far += net.weight[at]
        v = np.repeat(now - u, k)
        v += net.dst[at]
        good = np.flatnonzero(far <= dist[v])
        v, far, a = v[good], far[good], np.repeat(now, k)[good]
        old = dist[v]
        np.minimum.at(dist, v, far)
        best = dist[v]
        sigma[v[best < old]] = 0.0
        tight = far == best
        first = v[tight & np.isinf(old)]
        slot[first] = np.arange(len(first))
        left = np.concatenate((left, first[slot[first] == np.arange(len(first))]))
        a, v, far = a[tight], v[tight], far[tight]
        np.add.at(sigma, v, sigma[a])
        trail.append((a, v, far))
    delta = np.zeros(len(dist))
    for a, v, far in reversed(trail):
        last = far == dist[v]  # no shorter path was found since
        a, v = a[last], v[last]
        np.add.at(delta, a, sigma[a] / sigma[v] * (1 + delta[v]))
    delta[own] = 0.0
    return delta.reshape(-1, n).sum(0)


def betweenness(vertices: DataFrame, edges: DataFrame, normalise: bool = True) -> DataFrame:
    """(node, score): weighted directed betweenness, weights as distances. Sources are dealt to tasks, each with the network's arrays, checked against MOST_ARCS."""
    spark = vertices.sparkSession
    net = shipped.collected(vertices, network.digraph(edges).where("src <> dst"), MOST_ARCS)
    if net is None:
        raise ValueError(f"there are more arcs than a task holds ({MOST_ARCS})")
    shared = spark.sparkContext.broadcast(Paths(net))

    def f(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        paths = shared.value
        net = paths.net
        out, size = np.zeros(net.n), max(1, shipped.PORTION // net.n)
        for part in parts:
            for i in range(0, len(part), size):
                if (got := dependencies(paths, part[i : i + size])) is not None:
                    out += got
                    continue
                for s in part[i : i + size]:
                    _brandes(net.first, net.dst, net.weight, int(s), out)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(net.n)), pa.array(out)], ["idx", "score"])

    got = shipped.over(vertices, f, "idx long, score double").groupBy("idx").agg(F.sum("score").alias("score"))
    out = cut(vertices.select("idx", "node").join(got, "idx", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score")), "betweenness")
    return max_normalised(out, "score") if normalise else out
