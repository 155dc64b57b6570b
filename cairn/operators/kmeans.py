"""Clustering: recursive-partition k-means on grid summaries, with Lloyd, seeded and mini-batch baselines.

Centers are at most a few thousand vectors, checked against MAX_CENTERS, and travel as literals; points never leave the
executors. Each Lloyd iteration is one job: assignment is a projection, the update one hash aggregation of K rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import clip, squared_distance
from cairn.operators import grid
from cairn.plans.lineage import cut

MAX_CENTERS = 4096
Centers = list[list[float]]


@dataclass(frozen=True)
class Fit:
    """centers, labels (id, label), and metrics of a fit."""

    centers: Centers
    labels: DataFrame
    inertia: int
    n_part: int
    n_iter: int
    iterations: int
    distances: int
    partitions: int
    error: float

    def metrics(self, spark) -> DataFrame:
        return spark.createDataFrame([(self.inertia, self.n_part, self.n_iter, self.iterations, self.distances, self.partitions, self.error)], "inertia long, n_part int, n_iter int, iterations int, distances long, partitions long, error double")

    def predict(self, points: DataFrame) -> DataFrame:
        return predict(points, self.centers)


def checked(points: DataFrame, clusters: int, max_part: int, max_iter: int, seed: int | None, tol: float, verbose: int) -> int:
    """The dimension of points; raises ValueError for parameters out of range."""
    for name, value in (("clusters", clusters), ("max_part", max_part), ("max_iter", max_iter)):
        if value <= 0:
            raise ValueError(f"{name} must be above 0, not {value}")
    if seed is not None and seed < 0:
        raise ValueError(f"seed must not be negative: {seed}")
    if tol < 0:
        raise ValueError(f"tol must not be negative: {tol}")
    if verbose not in (0, 1):
        raise ValueError(f"verbose must be 0 or 1, not {verbose}")
    if clusters > MAX_CENTERS:
        raise ValueError(f"more than {MAX_CENTERS} centers")
    size = points.agg(F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi"), F.count("*").alias("n")).first()
    if size.n and (size.lo != size.hi or size.lo < 1):
        raise ValueError("points must all have the same dimension, 1 or more")
    if size.n < clusters:
        raise ValueError(f"{size.n} points for {clusters} clusters")
    return size.lo


def sampled(rows: DataFrame, k: int, seed: int, *by: str) -> DataFrame:
    """k rows drawn without replacement by hash: the same in every partitioning."""
    return rows.orderBy(F.xxhash64(*by, F.lit(seed)), *by).limit(k)


def _literal(centers: Centers) -> Column:
    """All centers as one literal, which the optimiser makes of the text."""
    return F.from_json(F.lit(json.dumps([[float(x) for x in c] for c in centers])), "array<array<double>>")


def nearest(features: str, centers: Centers) -> Column:
    """(d2, cluster) of the nearest center; the lowest number among ties."""
    near = F.transform(_literal(centers), lambda c, i: F.struct(squared_distance(F.col(features), c).alias("d2"), i.alias("cluster")))
    return F.array_min(near)


def assign(rows: DataFrame, centers: Centers, features: str = "features") -> DataFrame:
    """rows with label and d2, the squared distance to the label's center."""
    return rows.withColumn("_n", nearest(features, centers)).withColumns({"label": F.col("_n.cluster").cast("int"), "d2": F.col("_n.d2")}).drop("_n")


def updated(labelled: DataFrame, centers: Centers, features: str = "features", card: str | None = None) -> Centers:
    """Weighted means by label; a cluster without points keeps its center."""
    f, w, dims = F.col(features), F.col(card) if card else F.lit(1), len(centers[0])
    got = labelled.groupBy("label").agg(*[(F.sum(f[i] * w) / F.sum(w)).alias(f"x{i}") for i in range(dims)]).collect()  # K rows
    out = [list(c) for c in centers]
    for r in got:
        out[r.label] = [r[f"x{i}"] for i in range(dims)]
    return out


def shift(before: Centers, after: Centers) -> float:
    """Squared Frobenius norm of the centers' movement."""
    return float(((np.array(before) - np.array(after)) ** 2).sum())


def inertia(reps: DataFrame, centers: Centers, features: str = "rep") -> int:
    """Sum over representatives, each counted once, of the squared distance to the nearest center, rounded half to even."""
    return int(assign(reps, centers, features).agg(F.bround(F.coalesce(F.sum("d2"), F.lit(0.0)), 0)).first()[0])


def error(labelled: DataFrame, centers: Centers, features: str = "features") -> float:
    """Sum of the distances (not squared) of points to their labels' centers."""
    own = F.element_at(_literal(centers), F.col("label") + 1)
    return float(labelled.agg(F.coalesce(F.sum(F.sqrt(squared_distance(F.col(features), own))), F.lit(0.0))).first()[0])


def lloyd(rows: DataFrame, centers: Centers, max_iter: int, tol: float, features: str = "features", card: str | None = None) -> tuple[Centers, Centers, int, bool]:
    """(centers, the centers of the last assignment, iterations, whether it converged)."""
    last = centers
    for i in range(max_iter):
        last, centers = centers, updated(assign(rows, centers, features), centers, features, card)
        if shift(last, centers) < tol:
            return centers, last, i + 1, True
    return centers, last, max_iter, False


def summarised(points: DataFrame, dims: int, clusters: int, growth: int | None = None) -> tuple[int, list[float], list[float], DataFrame]:
    """(m, lo, hi, cells) of the first grid with at least as many cells as clusters.

    The resolution grows by the dimension. In one dimension, or with fewer distinct points than clusters, it can't reach
    that number: that raises.
    """
    lo, hi = grid.bounds(points, dims)
    m, step = grid.smallest_resolution(dims, clusters), growth or dims
    while True:
        cells = cut(grid.representatives(points, m, lo, hi), "cells")
        if cells.count() >= clusters:
            return m, lo, hi, cells
        if step < 2 or m * step > grid.MAX_RESOLUTION:
            raise ValueError(f"no grid of the points gives {clusters} cells")
        m *= step


def fit(points: DataFrame, clusters: int = 8, max_part: int = 2, max_iter: int = 300, seed: int | None = None, tol: float = 1e-4, verbose: int = 0, growth: int | None = None, start: Centers | None = None) -> Fit:
    """Recursive-partition k-means: Lloyd on a grid's weighted means, then on finer grids, until the centers rest.

    The first centers are cells drawn by the seed, or start where it is given.

    Labels are those of each point's cell in the last assignment. n_iter is the zero-based number of the last iteration
    of the last round, iterations the number of all.
    """
    dims = checked(points, clusters, max_part, max_iter, seed, tol, verbose)
    m, lo, hi, cells = summarised(points, dims, clusters, growth)
    n_part = m.bit_length() - 1
    centers = start or [list(r.rep) for r in sampled(cells, clusters, seed or 0, "cell").collect()]  # K rows
    used, done, total, distances, rounds = centers, 0, 0, 0, 0
    while True:
        before = centers
        centers, used, done, _ = lloyd(cells, centers, max_iter, tol, "rep", "card")
        total, rounds, distances = total + done, rounds + 1, distances + done * cells.count() * clusters
        if shift(before, centers) < tol or n_part >= max_part:
            break
        n_part += 1
        m *= growth or dims
        cells = cut(grid.representatives(points, m, lo, hi), "cells")
    labelled = propagated(points, cells, m, lo, hi, used, clusters)
    return Fit(centers, labelled.select("id", "label"), inertia(cells, centers), n_part, done - 1, total, distances, cells.count(), error(labelled, centers))


def propagated(points: DataFrame, cells: DataFrame, m: int, lo: list[float], hi: list[float], centers: Centers, clusters: int) -> DataFrame:
    """points with their cell's label: an equi-join on the cell."""
    own = assign(cells, centers, "rep").select("cell", clip(F.col("label"), F.lit(0), F.lit(clusters - 1)).alias("label"))
    return points.withColumn("cell", grid.cell(m, lo, hi)).join(own, "cell").drop("cell")


def fit_predict(points: DataFrame, **how) -> DataFrame:
    return fit(points, **how).labels


def predict(points: DataFrame, centers: Centers) -> DataFrame:
    """(id, label) of the nearest center."""
    return assign(points, centers).select("id", "label")


def seeded(points: DataFrame, centers: Centers, max_iter: int = 300, tol: float = 1e-4) -> tuple[Centers, int]:
    """Lloyd on the points themselves from given centers."""
    out, _, n, _ = lloyd(points, centers, max_iter, tol)
    return out, n


def plus_plus(points: DataFrame, clusters: int, seed: int = 0, max_iter: int = 300, tol: float = 1e-4) -> tuple[Centers, int]:
    """The distributed k-means|| of Spark ML: centers and iterations."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=clusters, seed=seed, maxIter=max_iter, tol=tol, initMode="k-means||").fit(points.select(array_to_vector("features").alias("features")))
    return [list(map(float, c)) for c in model.clusterCenters()], model.summary.numIter


def mini_batch(points: DataFrame, clusters: int, batch: int = 100, max_iter: int = 300, tol: float = 1e-4, seed: int = 0) -> tuple[Centers, int]:
    """Mini-batch k-means: each iteration moves centers to the running means of hashed samples of about batch points."""
    n = points.count()
    centers = [list(r.features) for r in sampled(points, clusters, seed, "id").select("features").collect()]
    counts = np.zeros(clusters)
    share = min(1.0, batch / max(1, n))
    for i in range(max_iter):
        draw = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 30)) < int(share * (1 << 30))
        dims = len(centers[0])
        f = F.col("features")
        got = assign(points.where(draw), centers).groupBy("label").agg(F.count("*").alias("n"), *[F.sum(f[j]).alias(f"x{j}") for j in range(dims)]).collect()
        before = [list(c) for c in centers]
        for r in got:
            counts[r.label] += r.n
            c, s = np.array(centers[r.label]), np.array([r[f"x{j}"] for j in range(dims)])
            centers[r.label] = (c + (s - r.n * c) / counts[r.label]).tolist()
        if got and shift(before, centers) < tol:
            return centers, i + 1
    return centers, max_iter
