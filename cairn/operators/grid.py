"""Grid summaries of points: cells of equal boxes, with their means and numbers of points.

Points are (id long, features array<double>). A cell is an array of coordinates, so cells never collide whatever the
dimension and resolution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import floor_div

MAX_RESOLUTION = 1 << 40


def smallest_resolution(dims: int, clusters: int) -> int:
    """The least power of two that gives clusters cells: at least ceil(clusters ** (1 / dims)) a dimension."""
    need = math.ceil(round(clusters ** (1 / dims), 9))
    return 1 << max(0, math.ceil(math.log2(need)))


def bounds(points: DataFrame, dims: int) -> tuple[list[float], list[float]]:
    """Least and largest value of each dimension, in one pass."""
    f = F.col("features")
    row = points.agg(*[F.min(f[i]).alias(f"lo{i}") for i in range(dims)], *[F.max(f[i]).alias(f"hi{i}") for i in range(dims)]).first()
    return [row[f"lo{i}"] for i in range(dims)], [row[f"hi{i}"] for i in range(dims)]


def cell(m: int, lo: list[float], hi: list[float]) -> Column:
    """The cell of features at m boxes a dimension; the last box is closed, and a constant dimension has one box."""
    f = F.col("features")

    def one(i: int) -> Column:
        width = (hi[i] - lo[i]) / m
        return F.least(floor_div(f[i] - F.lit(lo[i]), F.lit(width)), F.lit(float(m - 1))).cast("long") if width > 0 else F.lit(0).cast("long")

    return F.array(*[one(i) for i in range(len(lo))])


def representatives(points: DataFrame, m: int, lo: list[float], hi: list[float]) -> DataFrame:
    """(cell, rep, card): each non-empty cell's mean and number of points, by one hash aggregation."""
    f = F.col("features")
    by = points.select(cell(m, lo, hi).alias("cell"), "features").groupBy("cell")
    return by.agg(F.array(*[F.avg(f[i]) for i in range(len(lo))]).alias("rep"), F.count("*").alias("card"))


def split(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of several points, and of one."""
    return cells.where("card > 1"), cells.where("card = 1")


def grid_lines(lo: float, hi: float, index: int) -> list[float]:
    """Positions of a dimension's lines after index halvings."""
    n = 1 << index
    return [lo + (hi - lo) * i / n for i in range(n + 1)]


def compression(points: DataFrame, cells: DataFrame) -> float:
    """Cells per point."""
    return cells.count() / points.count()
