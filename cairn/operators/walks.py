"""Random-walk association: visits of walks from every node, sampled or exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.functions.columns import uniform
from cairn.operators import network, shipped
from cairn.plans.lineage import cut


def transitions(edges: DataFrame) -> DataFrame:
    """(src, dst, p): shares of each node's weight."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    return edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p"))


def undirected_arcs(edges: DataFrame) -> DataFrame:
    return network.both_ways(network.undirected(edges))


def guided(arcs: DataFrame) -> DataFrame:
    """(src, slots, slot, dst, lo, hi): each node's arcs as intervals of [0, 1) in proportion to their weights, with one slot of [0, 1) an arc and each arc in all slots that it reaches into.

    A number drawn for a node lies in one slot, and a slot holds two arcs on average over the numbers, whatever the degree.
    """
    by = W.partitionBy("src").orderBy("dst")
    whole = W.partitionBy("src")
    upto = arcs.withColumn("upto", F.sum("weight").over(by.rowsBetween(W.unboundedPreceding, 0)))
    upto = upto.withColumns({"before": F.coalesce(F.lag("upto").over(by), F.lit(0.0)), "total": F.max("upto").over(whole), "slots": F.count("*").over(whole)})
    cut_ = upto.select("src", "dst", "slots", (F.col("before") / F.col("total")).alias("lo"), (F.col("upto") / F.col("total")).alias("hi"))
    slot = lambda x: F.least(F.floor(x * F.col("slots")), F.col("slots") - 1)
    return cut_.select("src", "slots", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))).alias("slot"), "dst", "lo", "hi")


def walks(starts: DataFrame, arcs: DataFrame, steps: int, repetitions: int = 1, seed: int = 0) -> DataFrame:
    """(rep, start, step, node) of walks from every start (node). The next node is drawn by weight, with a number hashed from
    walk and step: one row a walker, whatever the node's degree. Without an arc the walker stays."""
    if not isinstance(steps, int) or steps < 0:
        raise ValueError(f"steps must be a whole number of 0 or more, not {steps!r}")
    arcs = cut(arcs.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight")).where("weight > 0"), "arcs")
    guide = cut(guided(arcs), "guide")
    slots = guide.where("slot = 0").select("src", "slots").distinct()
    now = cut(starts.select(F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("rep"), F.col("node").alias("start"), F.lit(0).alias("step"), "node"), "walk")
    out = now
    for t in range(1, steps + 1):
        at = now.withColumnRenamed("node", "src").join(slots, "src", "left").withColumn("u", uniform("rep", "start", F.lit(t), seed=seed))
        at = at.withColumn("slot", F.least(F.floor(F.col("u") * F.col("slots")), F.col("slots") - 1)).drop("slots")
        g = guide.select(F.col("src").alias("_src"), F.col("slot").alias("_slot"), "dst", "lo", "hi")
        step = at.join(g, (F.col("src") == F.col("_src")) & (F.col("slot") == F.col("_slot")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")), "left")
        now = cut(step.select("rep", "start", F.lit(t).alias("step"), F.coalesce("dst", "src").alias("node")), "walk")
        out = out.unionByName(now)
        if t % 16 == 0:
            out = cut(out, "walks")
    return out


def association(paths: DataFrame, repetitions: int) -> DataFrame:
    """(start, visited, avg_visits): visits, the start's among them, by repetition; each start's sum to steps + 1."""
    return paths.groupBy("start", F.col("node").alias("visited")).agg((F.count("*") / F.lit(repetitions)).alias("avg_visits"))


def expected(starts: DataFrame, arcs: DataFrame, steps: int) -> DataFrame:
    """The exact expectation of association(): the sum of the transition matrix's powers 0 to steps, as triples."""
    p = transitions(arcs)
    stay = starts.select(F.col("node").alias("src")).join(p.select("src").distinct(), "src", "left_anti").select("src", F.col("src").alias("dst"), F.lit(1.0).alias("p"))
    p = cut(p.unionByName(stay), "transitions")
    guide = cut(guided(arcs), "guide")
    slots = guide.where("slot = 0").select("src", "slots").distinct()
    now = cut(starts.select(F.col("node").alias("start"), F.col("node").alias("visited"), F.lit(1.0).alias("x")), "power")
    out = now
    for _ in range(steps):
        now = cut(now.withColumnRenamed("visited", "src").join(p, "src").groupBy("start", F.col("dst").alias("visited")).agg(F.sum(F.col("x") * F.col("p")).alias("x")), "power")
        out = out.unionByName(now)
    return out.groupBy("start", "visited").agg(F.sum("x").alias("avg_visits"))


def moments(vertices: DataFrame, arcs: DataFrame, steps: int) -> DataFrame:
    """(visited, s, q): sums and sums of squares of the columns of expected() from all vertices (idx, node). Tasks make the rows and add them up; beyond shipped.MOST_ARCS joins do."""
    net = shipped.collected(vertices, arcs)
    if net is None:
        return expected(vertices.select("node"), arcs, steps).groupBy("visited").agg(F.sum("avg_visits").alias("s"), F.sum(F.col("avg_visits") * F.col("avg_visits")).alias("q"))
    return cut(shipped.moments(vertices, shipped.transitions(net), steps), "moments").join(vertices, "idx").select(F.col("node").alias("visited"), "s", "q")
