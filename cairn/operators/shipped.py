"""Networks as arrays that every task gets, for what looks at the network from every node: no table of all pairs is shuffled or written.

A network of up to MOST_ARCS arcs is collected and broadcast, 16 bytes an arc; callers have joins for larger ones, or raise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import network

#: Arcs up to which a network is shipped to every task.
MOST_ARCS = 5_000_000
#: Elements of the arrays that a task works on at a time.
PORTION = 1 << 20


class Arcs:
    """Arcs (src, dst, weight) between n nodes, by number, in order of src; first holds where each node's begin."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> None:
        order = np.lexsort((dst, src))
        self.n, self.src, self.dst, self.weight = n, src[order].astype(np.int32), dst[order].astype(np.int32), weight[order]
        self.first = np.searchsorted(self.src, np.arange(n + 1))

    def out(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of arcs of each of nodes, the places of all of them, one node after the other)."""
        k = self.first[nodes + 1] - self.first[nodes]
        return k, np.arange(k.sum()) + np.repeat(self.first[nodes] - (np.cumsum(k) - k), k)


def collected(vertices: DataFrame, arcs: DataFrame, most: int | None = None) -> Arcs | None:
    """The arcs (src, dst, weight) between vertices (idx from 0, node); none where there are more than most."""
    rows = network.relabelled(arcs, vertices).select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("weight").cast("double").alias("weight"))
    if arcs.count() > (MOST_ARCS if most is None else most):
        return None
    t = rows.toArrow()
    return Arcs(vertices.count(), *(t[c].to_numpy() for c in ("src", "dst", "weight")))


def over(vertices: DataFrame, f: Callable[[Iterator[np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over the numbers of the vertices, dealt by hash to at least as many tasks as run at once."""
    spark = vertices.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(b.column(0).to_numpy() for b in batches if b.num_rows)

    return vertices.select("idx").repartition(tasks, "idx").mapInArrow(g, schema)


def transitions(arcs: Arcs) -> Arcs:
    """Shares of each node's weight; a node without arcs stays."""
    total = np.bincount(arcs.src, arcs.weight, arcs.n)
    stay = np.flatnonzero(np.diff(arcs.first) == 0)
    return Arcs(arcs.n, np.concatenate((arcs.src, stay)), np.concatenate((arcs.dst, stay)), np.concatenate((arcs.weight / total[arcs.src], np.ones(len(stay)))))


def spread(p: Arcs, x: np.ndarray) -> np.ndarray:
    """Rows x times the transitions."""
    rows, out = len(x), np.zeros(x.size)
    r, v = np.nonzero(x)
    ends = np.cumsum(p.first[v + 1] - p.first[v])
    i = 0
    while i < len(v):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 2 * PORTION, "right")))
        k, at = p.out(v[i:j])
        out += np.bincount(np.repeat(r[i:j] * p.n, k) + p.dst[at], np.repeat(x[r[i:j], v[i:j]], k) * p.weight[at], x.size)
        i = j
    return out.reshape(rows, p.n)


def space(p: Arcs, starts: np.ndarray, steps: int) -> np.ndarray:
    """Rows of the association space of walks.expected(), dense."""
    now = np.zeros((len(starts), p.n))
    now[np.arange(len(starts)), starts] = 1
    out = now.copy()
    for _ in range(steps):
        now = spread(p, now)
        out += now
    return out


def moments(vertices: DataFrame, p: Arcs, steps: int) -> DataFrame:
    """(idx, s, q, norm) of the association space: sums and sums of squares of each column, and of squares of each row."""
    shared = vertices.sparkSession.sparkContext.broadcast(p)

    def f(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        s, q, norm = np.zeros(p.n), np.zeros(p.n), np.zeros(p.n)
        size = max(1, PORTION // p.n)
        for part in parts:
            for i in range(0, len(part), size):
                x = space(p, part[i : i + size], steps)
                s += x.sum(0)
                x *= x
                q += x.sum(0)
                norm[part[i : i + size]] = x.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.n)), pa.array(s), pa.array(q), pa.array(norm)], ["idx", "s", "q", "norm"])

    return over(vertices, f, "idx long, s double, q double, norm double").groupBy("idx").agg(*[F.sum(c).alias(c) for c in ("s", "q", "norm")])


class Space:
    """The association space as a linear map: the sum of the transitions' powers 0 to steps."""

    def __init__(self, p: Arcs, steps: int) -> None:
        self.p, self.steps = p, steps

    def _sum(self, x: np.ndarray, to: np.ndarray, of: np.ndarray) -> np.ndarray:
        out, now = x.copy(), x
        for _ in range(self.steps):
            now = np.bincount(to, self.p.weight * now[of], self.p.n)
            out += now
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        """Each row's product with x."""
        return self._sum(x, self.p.src, self.p.dst)

    def transposed(self, y: np.ndarray) -> np.ndarray:
        """The sum of the rows, weighted by y."""
        return self._sum(y, self.p.dst, self.p.src)


def depths(arcs: Arcs, starts: np.ndarray, most: int = 1000) -> np.ndarray:
    """Hops from each of starts, 64 at most, to every node; -1 where there is no path; raises beyond most. A bit a start: a level is one pass over the arcs, which must go both ways."""
    out = np.full((arcs.n, 64), -1, np.int16)
    seen = np.zeros(arcs.n, np.uint64)
    np.bitwise_or.at(seen, starts, np.uint64(1) << np.arange(len(starts), dtype=np.uint64))
    some = np.flatnonzero(np.diff(arcs.first))
    front, depth = seen.copy(), 0
    while True:
        new = np.flatnonzero(front)
        if not len(new):
            return out.T[: len(starts)]
        if depth > most:
            raise RuntimeError(f"distances above {most}")
        bits = np.unpackbits(front[new].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(bool)
        rows = out[new]
        rows[bits] = depth
        out[new] = rows
        depth += 1
        near = np.zeros_like(seen)
        near[some] = np.bitwise_or.reduceat(front[arcs.dst], arcs.first[some])
        front = near & ~seen
        seen |= front
