"""Distributions: histograms on given, linear, unit or logarithmic edges, with density, tail and power-law exponent."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def span(values: DataFrame, value: str = "value") -> tuple[float, float, int]:
    """(least, largest, number) of the known values, those of 0 or more."""
    r = values.where(F.col(value) >= 0).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n")).first()
    return (float(r.lo), float(r.hi), r.n) if r.n else (math.nan, math.nan, 0)


def linear_edges(lo: float, hi: float, edges: int = 10) -> list[float]:
    """edges positions from lo to hi: one bin fewer."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return [lo + (hi - lo) * i / (edges - 1) for i in range(edges)]


def unit_edges(lo: float, hi: float, two_valued: bool = False) -> list[float]:
    """Steps of 1 from lo, ending below hi: larger values fall off. Data of exactly 0 and 1 have halves of [0, 1]."""
    return [0.0, 0.5, 1.0] if two_valued else [lo + i for i in range(max(0, math.ceil(hi - lo)))]


def log_edges(lo: float, hi: float, most: int = 10) -> list[float]:
    """Geometric steps from lo to hi; none where lo isn't above 0 or hi is below 2."""
    n = min(most, int(hi))
    if lo <= 0 or n < 2 or lo == hi:
        return []
    a, b = math.log10(lo), math.log10(hi)
    return [10 ** (a + (b - a) * i / (n - 1)) for i in range(n)]


def histogram(values: DataFrame, edges: list[float], value: str = "value") -> DataFrame:
    """(bin, lo, hi, count) of every bin of rising edges; bins are closed below, the last one above as well."""
    spark, n = values.sparkSession, len(edges) - 1
    if n < 1:
        return spark.createDataFrame([], "bin int, lo double, hi double, count long")
    bins = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(n)], "bin int, lo double, hi double")
    x = F.col(value).cast("double")
    cases = F.when(x == F.lit(edges[n]), F.lit(n - 1))
    at = F.array(*[F.lit(e) for e in edges])
    place = F.size(F.filter(at, lambda e: e <= x)) - 1
    got = values.where((x >= edges[0]) & (x <= edges[n])).select(cases.otherwise(place).alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))
    return bins.join(got, "bin", "left").fillna(0, ["count"])


def unit_histogram(values: DataFrame, lo: float, hi: float, value: str = "value") -> DataFrame:
    """histogram() on unit_edges(lo, hi), for any number of bins: edges are computed in tasks."""
    n = math.ceil(hi - lo) - 1
    if n >= 1 << 31:
        raise ValueError(f"{n} bins are more than an int numbers")
    bins = values.sparkSession.range(max(0, n)).select(F.col("id").cast("int").alias("bin"), (F.lit(lo) + F.col("id")).alias("lo"), (F.lit(lo) + F.col("id") + 1).alias("hi"))
    x = F.col(value).cast("double")
    by = F.floor(x - F.lit(lo))
    place = F.when(F.lit(lo) + by > x, by - 1).when(F.lit(lo) + by + 1 <= x, by + 1).otherwise(by)  # where x - lo was rounded
    got = values.where((x >= lo) & (x <= lo + n)).select(F.least(place, F.lit(n - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))
    return bins.join(got, "bin", "left").fillna(0, ["count"])


def densities(bins: DataFrame) -> DataFrame:
    """bins with pdf, counts over their sum, and ccdf, 1 less the sum of pdf up to the bin. Bins are few."""
    total = F.sum("count").over(W.partitionBy(F.lit(1)))
    out = bins.withColumn("pdf", F.col("count") / F.when(total > 0, total))
    return out.withColumn("ccdf", 1 - F.sum("pdf").over(W.partitionBy(F.lit(1)).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))


def many_densities(bins: DataFrame, run: int = 4096) -> DataFrame:
    """densities() of any number of bins: sums run within runs of bins, and over the runs' totals."""
    runs = bins.withColumn("run", F.floor(F.col("bin") / run))
    totals = runs.groupBy("run").agg(F.sum("count").alias("own"))
    over = W.partitionBy(F.lit(1))
    before = totals.select("run", F.sum("own").over(over).alias("total"), (F.sum("own").over(over.orderBy("run").rowsBetween(W.unboundedPreceding, 0)) - F.col("own")).alias("before"))
    upto = F.col("before") + F.sum("count").over(W.partitionBy("run").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    some = F.when(F.col("total") > 0, F.col("total"))
    return runs.join(before, "run").select(*bins.columns, (F.col("count") / some).alias("pdf"), (1 - upto / some).alias("ccdf"))


def rebinned(masses: DataFrame, edges: list[float]) -> DataFrame:
    """Mass of an outside histogram (x, mass) by bin, open below and closed above."""
    at = F.array(*[F.lit(float(e)) for e in edges])
    place = F.size(F.filter(at, lambda e: e < F.col("x"))) - 1
    return masses.withColumn("bin", place).where((F.col("bin") >= 0) & (F.col("x") <= float(edges[-1]))).groupBy("bin").agg(F.sum("mass").alias("mass"))


def unknown_share(values: DataFrame, value: str = "value") -> DataFrame:
    return values.agg(F.avg((F.col(value) < 0).cast("double")).alias("unknown_share"))


def power_law(values: DataFrame, value: str = "value") -> DataFrame:
    """(gamma): 1 + n / sum(ln(x / (least - 1/2))) of the values above 0; null where undefined."""
    x = values.where(F.col(value) > 0).select(F.col(value).cast("double").alias("x"))
    least = x.agg(F.min("x").alias("least"))
    s = x.crossJoin(F.broadcast(least)).agg(F.count("*").alias("n"), F.sum(F.when(F.col("least") > 0.5, F.ln(F.col("x") / F.when(F.col("least") > 0.5, F.col("least") - 0.5)))).alias("s"))  # one row
    return s.select(F.when(F.col("s") > 0, 1 + F.col("n") / F.col("s")).alias("gamma"))


def distribution(metrics: dict[str, DataFrame], edges: int = 10) -> DataFrame:
    """(metric, bins, bin, lo, hi, count, pdf, ccdf, gamma, unknown_share) of each metric's values on linear, unit and log bins.

    Values that are exactly 0 and 1 have two unit bins and no others. Else there are no unit bins of a range of 1 or less, and
    log bins only as log_edges() has them; the number of unit bins has no limit.
    """
    parts = []
    for name, values in metrics.items():
        lo, hi, n = span(values)
        if not n:
            continue
        known = values.where("value >= 0")
        gamma = power_law(known).first().gamma
        share = unknown_share(values).first().unknown_share
        if (lo, hi) == (0.0, 1.0) and known.where("value not in (0, 1)").isEmpty():
            bins = {"unit": densities(histogram(known, unit_edges(lo, hi, True)))}
        else:
            bins = {"linear": densities(histogram(known, linear_edges(lo, hi, edges)))}
            if math.ceil(hi - lo) > 1:
                bins["unit"] = many_densities(unit_histogram(known, lo, hi))
            if len(at := log_edges(lo, hi, edges)) > 1:
                bins["log"] = densities(histogram(known, at))
        parts += [b.select(F.lit(name).alias("metric"), F.lit(kind).alias("bins"), "bin", "lo", "hi", "count", "pdf", "ccdf", F.lit(gamma).cast("double").alias("gamma"), F.lit(share).alias("unknown_share")) for kind, b in bins.items()]
    return reduce(DataFrame.unionByName, parts)
