"""Projections and subgraphs of networks.

A network is vertices (idx long, node string) and edges (src, dst, key, ord, weight and attributes); ord is the order of
insertion, which decides between parallel edges: the last wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def digraph(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): parallel edges as one."""
    return edges.groupBy("src", "dst").agg(F.max_by("weight", "ord").alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a <= b: parallel and opposite edges as one."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max_by("weight", "ord").alias("weight"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(src, dst, weight): each undirected edge in either direction, loops once."""
    there = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    return there.unionByName(pairs.where("a <> b").select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def relabelled(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """edges with idx for names."""
    v = vertices.select("idx", "node")
    out = edges.join(v.withColumnsRenamed({"idx": "_s", "node": "src"}), "src").join(v.withColumnsRenamed({"idx": "_d", "node": "dst"}), "dst")
    return out.withColumns({"src": F.col("_s"), "dst": F.col("_d")}).drop("_s", "_d")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes (node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def neighbourhood(edges: DataFrame, nodes: DataFrame, keep_seeds: bool = True) -> DataFrame:
    """(node): ends of the out-edges of nodes; with keep_seeds, nodes without out-edges as well."""
    out = edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    ends = out.select(F.explode(F.array("src", "dst")).alias("node"))
    return (ends.unionByName(nodes.select("node")) if keep_seeds else ends).distinct()


def subgraph(edges: DataFrame, nodes: DataFrame, include_neighbours: bool = False, keep_seeds: bool = True) -> DataFrame:
    return induced(edges, neighbourhood(edges, nodes, keep_seeds) if include_neighbours else nodes)


def edge_subgraph(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges whose (src, dst) is among the chosen."""
    return edges.join(chosen.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def boundary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Out-edges that leave the nodes."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_anti")


def out_edges(edges: DataFrame, nodes: DataFrame | None, value: str) -> DataFrame:
    """(src, dst, value) of the out-edges of nodes, of all without."""
    rows = edges if nodes is None else edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    return rows.select("src", "dst", F.col(value).cast("double").alias("value"))


def known(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value isn't the mark of the unknown, below 0."""
    return rows.where(F.col(value) >= 0)


def above(scores: DataFrame, value: str, threshold: float) -> DataFrame:
    """Nodes strictly above a threshold."""
    return scores.where(F.col(value) > threshold)


def counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges)."""
    return vertices.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # a row each


def sliced(tags: DataFrame, n: int) -> DataFrame:
    return tags.where(F.col("idx") < n)


def labels(communities: DataFrame) -> DataFrame:
    """(node, cluster) of rows (cluster, members)."""
    return communities.select(F.explode("members").alias("node"), F.col("cluster").cast("int").alias("cluster"))


def top(scores: DataFrame, value: str, k: int, tie: str = "node") -> DataFrame:
    """The k rows of the largest values; ties by name. A limit is the feature here."""
    return scores.orderBy(F.desc(value), F.asc(tie)).limit(k)


def degrees(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(node, degree): in and out, by edges or by weight; a strength is cut to a whole number."""
    w = F.col(weight) if weight else F.lit(1)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), w.alias("w"))
    return ends.groupBy("node").agg(F.sum("w").cast("long").alias("degree"))


def visual_scales(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes of nodes (20 to 100 by degree) and widths of edges (0 to 1 by weight) for drawing."""
    d = degrees(edges)
    most = d.agg(F.max("degree").alias("m"))
    nodes = vertices.join(d, "node", "left").fillna(0, ["degree"]).crossJoin(F.broadcast(most)).select("node", (F.col("degree") / F.col("m") * 80 + 20).alias("size"))
    heavy = edges.agg(F.max("weight").alias("m"))
    return nodes, edges.crossJoin(F.broadcast(heavy)).select("src", "dst", (F.col("weight") / F.col("m")).alias("width"))  # one row each


def ranked(scores: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """The k largest of each group, ties by node."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc(value), F.asc("node")))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)
