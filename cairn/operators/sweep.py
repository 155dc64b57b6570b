"""Experiments over clusters, dimensions, sizes and methods, as one fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import kmeans

SCHEMA = "k int, d int, n long, method string, rep int, distances long, error double, partitions long, status string"


def blobs(spark: SparkSession, n: int, centers: int, dims: int, seed: int = 0, spread: float = 1.0) -> DataFrame:
    """(id, features): n points around centers drawn in [-10, 10]; a point's numbers depend on its id and the seed."""
    from cairn.functions.columns import uniform

    c = (F.col("id") % centers).alias("c")
    at = [20 * uniform(c, F.lit(i), seed=seed) - 10 for i in range(dims)]
    noise = [F.sqrt(-2 * F.ln(uniform("id", F.lit(i), seed=seed + 1))) * F.cos(F.lit(6.283185307179586) * uniform("id", F.lit(i), seed=seed + 2)) for i in range(dims)]
    return spark.range(n).select("id", F.array(*[a + spread * z for a, z in zip(at, noise, strict=True)]).alias("features"))


def subset(points: DataFrame, columns: list[int], rows: int, seed: int = 0) -> DataFrame:
    """Chosen dimensions of rows drawn without replacement."""
    f = F.col("features")
    return kmeans.sampled(points, rows, seed, "id").select("id", F.array(*[f[i] for i in columns]).alias("features"))


def full_cost(iterations: int, k: int, n: int) -> int:
    return iterations * k * n


def batch_cost(iterations: int, k: int, batch: int) -> int:
    return iterations * k * batch


def relative_error(summarised: float, full: float) -> float | None:
    """(full - summarised) / full."""
    return (full - summarised) / full if full else None


def sweep(make, ks: list[int], ds: list[int], ns: list[int], reps: int, max_part: int = 6, batches: tuple[int, ...] = (100, 500, 1000), tol: float = 1e-4, max_iter: int = 300) -> DataFrame:
    """The fact table of make(n, d, k, rep)'s points for all combinations; a run that fails says so in status."""
    rows, spark = [], SparkSession.getActiveSession()
    for k in ks:
        for d in ds:
            for n in ns:
                for rep in range(reps):
                    points = make(n, d, k, rep)
                    runs = {f"summary-{p}": lambda p=p: kmeans.fit(points, k, p, max_iter, rep, tol) for p in range(1, max_part + 1)}
                    runs["full"] = lambda: kmeans.plus_plus(points, k, rep, max_iter, tol)
                    runs |= {f"batch-{b}": lambda b=b: kmeans.mini_batch(points, k, b, max_iter, tol, rep) for b in batches if b <= n}
                    for method, run in runs.items():
                        try:
                            got = run()
                        except ValueError as e:
                            rows.append((k, d, n, method, rep, None, None, None, str(e)[:200]))
                            continue
                        if method.startswith("summary"):
                            rows.append((k, d, n, method, rep, got.distances, got.error, got.partitions, "ok"))
                        else:
                            centers, it = got
                            cost = full_cost(it, k, n) if method == "full" else batch_cost(it, k, int(method.split("-")[1]))
                            rows.append((k, d, n, method, rep, cost, kmeans.error(kmeans.assign(points, centers), centers), None, "ok"))
    return spark.createDataFrame(rows, SCHEMA)


def means(facts: DataFrame) -> DataFrame:
    """Averages over repetitions, with partitions per point."""
    return facts.where("status = 'ok'").groupBy("k", "d", "n", "method").agg(F.avg("distances").alias("distances"), F.avg("error").alias("error"), F.avg(F.col("partitions") / F.col("n")).alias("compression"), F.count("*").alias("runs"))
