"""Descriptors of networks: bundles of numbers, per-node bundles, clusters' reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import AGGREGATES, described
from cairn.operators import centrality, network
from cairn.plans.lineage import cut

#: Edge attributes of lexical enrichment.
PATH, WUP, SYNONYM, ANTONYM, EDIT = "path_similarity", "wup_similarity", "synonyms", "antonyms", "edit_distance"


def degree_descriptor(edges: DataFrame, what: str, weight: str | None = None) -> DataFrame:
    """(value) over degrees, or strengths cut to whole numbers."""
    d = network.degrees(edges, weight)
    return d.agg(AGGREGATES[what](F.col("degree").cast("double"), F.lit(1.0)).alias("value"))


def edge_descriptor(edges: DataFrame, what: str, data: str, nodes: DataFrame | None = None) -> DataFrame:
    """(value) over an attribute of the edges, of nodes' out-edges where given; -1 where none is known."""
    if nodes is not None:
        edges = edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    return described(edges, what, data)


def node_descriptor(vertices: DataFrame, what: str, data: str) -> DataFrame:
    return described(vertices, what, data)


def _table(parts: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) of one-row frames."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("metric"), F.col("value").cast("double").alias("value")) for k, df in parts.items()])


def numeric(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): sizes, degrees, strengths, true edge weights, neighbours and clustering.

    Strength metrics are over nodes' whole-number strengths, weight metrics over edges.
    """
    degree, strength = network.degrees(edges), network.degrees(edges, "weight")
    d, s = F.col("degree").cast("double"), F.col("degree").cast("double")
    one = degree.agg(F.max(d).alias("max_degree"), F.min(d).alias("min_degree"), F.avg(d).alias("avg_degree"))
    two = strength.agg(F.max(s).alias("max_strength"), F.min(s).alias("min_strength"), F.avg(s).alias("avg_strength"), F.stddev_pop(s).alias("std_strength"))
    three = edges.agg(F.count("*").cast("double").alias("edges"), F.max("weight").alias("max_weight"), F.min("weight").alias("min_weight"), F.avg("weight").alias("avg_weight"), F.stddev_pop("weight").alias("std_weight"))
    long = [x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in x.columns])).alias("m")).select("m.*") for x in (one, two, three)]
    rest = _table({"nodes": vertices.agg(F.count("*").alias("value")), "avg_neighbour_degree": centrality.mean_neighbour_degree(edges), "avg_neighbour_weight": centrality.mean_neighbour_degree(edges, True), "avg_clustering": centrality.average_clustering(vertices, edges)})
    return reduce(DataFrame.unionByName, [*long, rest])


def lexical(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): depths of nodes, and weighted mean and deviation of five edge attributes; -1 where none is known."""
    edges = cut(edges, "enriched")  # read once for each number
    parts = {f"depth_{w}": node_descriptor(vertices, w, "depth") for w in ("max", "min", "mean", "std")}
    for name in (PATH, WUP, SYNONYM, ANTONYM, EDIT):
        parts[f"{name}_avg"] = edge_descriptor(edges, "weighted average", name)
        parts[f"{name}_std"] = edge_descriptor(edges, "weighted std", name)
    return _table(parts)


def node_lexical(vertices: DataFrame, edges: DataFrame, compat: bool = False) -> DataFrame:
    """Per node, over its out-edges, means first and then deviations from them: max, mean and deviation of the similarities, mean and max of synonymy and antonymy, mean edit distance; -1 where unknown.

    compat: the wup columns hold path similarity, as the original definition has it.
    """
    w = F.col("weight")

    def known(c: str):
        return F.when(F.col(c) >= 0, F.col(c).cast("double"))

    def mean(c: str):
        return F.sum(known(c) * w) / F.sum(F.when(F.col(c) >= 0, w))

    cols = {}
    for name, data in (("path", PATH), ("wup", PATH if compat else WUP)):
        x = known(data)
        cols |= {f"{name}_max": F.max(x), f"{name}_avg": mean(data), f"{name}_std": F.sqrt(F.sum(w * F.pow(x - F.col(f"_{data}"), 2)) / F.sum(F.when(F.col(data) >= 0, w)))}
    for name, data in (("synonym", SYNONYM), ("antonym", ANTONYM)):
        cols |= {f"{name}_mean": F.avg(known(data)), f"{name}_max": F.max(known(data)), f"{name}_avg": mean(data)}
    cols["edit_avg"] = mean(EDIT)
    means = edges.groupBy("src").agg(*[mean(c).alias(f"_{c}") for c in ((PATH,) if compat else (PATH, WUP))])
    by = edges.join(means, "src").groupBy(F.col("src").alias("node")).agg(*[c.alias(k) for k, c in cols.items()])
    out = vertices.select("node").join(by, "node", "left")
    return out.select("node", *[F.coalesce(k, F.lit(-1.0)).alias(k) for k in cols])


def maximising(bundle: DataFrame, edges: DataFrame, column: str, k: int = 20, include_neighbours: bool = False) -> DataFrame:
    """Edges of the subgraph of the k nodes with the largest value of a column of node_lexical()."""
    return network.subgraph(edges, network.top(bundle, column, k).select("node"), include_neighbours)


def restricted(vertices: DataFrame, edges: DataFrame, k: int = 20, include_neighbours: bool = False) -> DataFrame:
    """The subgraphs that maximise five descriptors, named in column subgraph."""
    edges = cut(edges, "enriched")
    bundle = cut(node_lexical(vertices, edges), "bundle")
    parts = {"path": "path_avg", "wup": "wup_avg", "antonym": "antonym_avg", "synonym": "synonym_avg", "edit": "edit_avg"}
    return reduce(DataFrame.unionByName, [maximising(bundle, edges, c, k, include_neighbours).withColumn("subgraph", F.lit(name)) for name, c in parts.items()])


def tag_frequency(tags: DataFrame) -> DataFrame:
    """(tag, n, share) of each tag, share rounded half to even to two digits."""
    by = tags.groupBy("tag").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("tag", "n", F.bround(F.col("n") / F.col("total"), 2).alias("share"))  # one row


def tag_text(tags: DataFrame, names: dict[int, str]) -> DataFrame:
    """(text): shares by tag, as one line."""
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    rows = tag_frequency(tags).withColumn("name", F.coalesce(name[F.col("tag").cast("int")], F.col("tag").cast("string")))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tag", "name", "share"))), lambda x: F.concat(x["name"], F.lit(": "), x["share"].cast("string"))), ", ").alias("text"))


def relevance(space: DataFrame, n: int) -> DataFrame:
    """(visited, relevance, uncertainty): column sums and population deviations of the association space over n starts, zeros counted, each over its maximum."""
    return scaled_relevance(space.groupBy("visited").agg(F.sum("avg_visits").alias("s"), F.sum(F.col("avg_visits") * F.col("avg_visits")).alias("q")), n)


def scaled_relevance(moments: DataFrame, n: int) -> DataFrame:
    """relevance() from each column's sum s and sum of squares q."""
    s = moments.withColumns({"relevance": F.col("s"), "uncertainty": F.sqrt(F.greatest(F.lit(0.0), F.col("q") / n - F.pow(F.col("s") / n, 2)))})
    top = s.agg(F.max("relevance").alias("r"), F.max("uncertainty").alias("u"))
    return s.crossJoin(F.broadcast(top)).select("visited", (F.col("relevance") / F.col("r")).alias("relevance"), (F.col("uncertainty") / F.when(F.col("u") != 0, F.col("u"))).alias("uncertainty"))  # one row


def cluster_relevance(relevances: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster: mean and deviation of relevance, number and share above one half."""
    r = F.col("relevance")
    return clusters.join(relevances, "node").groupBy("cluster").agg(F.count("*").alias("nodes"), F.avg(r).alias("mean_relevance"), F.stddev_pop(r).alias("std_relevance"), F.sum((r > 0.5).cast("long")).alias("relevant"), F.avg((r > 0.5).cast("double")).alias("relevant_share"))


def between_clusters(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster, over the edges that leave it: number, weighted mean and deviation of path similarity and edit distance."""
    c = clusters.select("node", "cluster")
    out = edges.join(c.withColumnsRenamed({"node": "src", "cluster": "cluster"}), "src").join(c.withColumnsRenamed({"node": "dst", "cluster": "other"}), "dst").where("cluster <> other")
    w, first, cols = F.col("weight"), [], [F.count("*").alias("boundary")]
    for name in (PATH, EDIT):
        x = F.when(F.col(name) >= 0, F.col(name).cast("double"))
        total = F.sum(F.when(F.col(name) >= 0, w))
        first.append((F.sum(x * w) / total).alias(f"_{name}"))
        cols += [F.coalesce(F.max(f"_{name}"), F.lit(-1.0)).alias(f"{name}_avg"), F.coalesce(F.sqrt(F.sum(w * F.pow(x - F.col(f"_{name}"), 2)) / total), F.lit(-1.0)).alias(f"{name}_std")]
    return out.join(out.groupBy("cluster").agg(*first), "cluster").groupBy("cluster").agg(*cols)


def cluster_report(edges: DataFrame, clusters: DataFrame, relevances: DataFrame, tags: DataFrame) -> DataFrame:
    """One row a cluster: relevance, tags by share, edges inside, edges that leave and their descriptors."""
    c = clusters.select("node", "cluster")
    inside = edges.join(c.withColumnRenamed("node", "src"), "src").join(c.withColumnsRenamed({"node": "dst", "cluster": "other"}), "dst").where("cluster = other").groupBy("cluster").agg(F.count("*").alias("edges_inside"), F.avg("weight").alias("avg_weight"))
    by = clusters.join(tags, "node").groupBy("cluster", "tag").agg(F.count("*").alias("n"))
    # at most a row a tag and cluster
    tagged = by.groupBy("cluster").agg(F.sum("n").alias("t"), F.collect_list(F.struct("n", "tag")).alias("all")).select("cluster", F.array_join(F.transform(F.sort_array("all", asc=False), lambda x: F.concat(x["tag"].cast("string"), F.lit(": "), F.bround(x["n"] / F.col("t"), 2).cast("string"))), ", ").alias("tags"))
    return cluster_relevance(relevances, clusters).join(inside, "cluster", "left").join(between_clusters(edges, clusters), "cluster", "left").join(tagged, "cluster", "left")
