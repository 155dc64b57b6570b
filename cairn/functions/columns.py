"""Column functions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.plans.lineage import cut


def floor_div(a: Column, b: Column) -> Column:
    """Floor division of floats by the remainder, as floats divide: 1.0 // 0.1 is 9, where floor(1.0 / 0.1) is 10."""
    return F.rint((a - (a % b)) / b)


def uniform(*keys: Column | str, seed: int) -> Column:
    """A number in (0, 1) drawn by hash of the keys: the same in every partitioning."""
    return (F.xxhash64(*keys, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) + 1) / F.lit(float((1 << 53) + 1))


def clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def squared_distance(a: Column, b: Column) -> Column:
    """Of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


#: Aggregates by name, each of (value, weight). Deviations are the population's.
AGGREGATES: dict[str, Callable[[Column, Column], Column]] = {
    "max": lambda v, w: F.max(v),
    "min": lambda v, w: F.min(v),
    "mean": lambda v, w: F.avg(v),
    "std": lambda v, w: F.stddev_pop(v),
    "weighted average": lambda v, w: F.sum(v * w) / F.sum(w),
}


def described(df: DataFrame, what: str, value: str, weight: str = "weight", by: tuple[str, ...] = (), empty: float = -1.0) -> DataFrame:
    """An aggregate of the values that are 0 or more (others are unknown); without any, empty."""
    v, w = F.col(value).cast("double"), F.col(weight).cast("double") if weight in df.columns else F.lit(1.0)
    known = df.where(v >= 0)
    if what == "weighted std":  # two passes: the mean first
        mean = known.groupBy(*by).agg((F.sum(v * w) / F.sum(w)).alias("_mean"))
        known = known.join(mean, list(by)) if by else known.join(F.broadcast(mean))  # one row
        return known.groupBy(*by).agg(F.coalesce(F.sqrt(F.sum(w * F.pow(v - F.col("_mean"), 2)) / F.sum(w)), F.lit(empty)).alias("value"))
    return known.groupBy(*by).agg(F.coalesce(AGGREGATES[what](v, w), F.lit(empty)).alias("value"))


def max_normalised(df: DataFrame, value: str) -> DataFrame:
    """df with value over its maximum: one row of a maximum, joined by broadcast."""
    top = df.agg(F.max(value).alias("_top"))
    return df.join(F.broadcast(top)).withColumn(value, F.col(value) / F.col("_top")).drop("_top")


def ordinal(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """df with 0-based places in a total order: by range partitions and the numbers of rows before them, not in one task."""
    s = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_pid", F.spark_partition_id())
    s = cut(s, "ordinal")
    counts = {r["_pid"]: r["count"] for r in s.groupBy("_pid").count().collect()}  # a row a partition
    before, total = [], 0
    for pid in sorted(counts):
        before += [F.lit(pid), F.lit(total)]
        total += counts[pid]
    place = F.row_number().over(W.partitionBy("_pid").orderBy(*order)) - 1
    return s.withColumn(name, ((F.create_map(*before)[F.col("_pid")] if before else F.lit(0)) + place).cast("long")).drop("_pid")
