"""Named queries over the driver's tables, with SQL for the same rows.

Points are line items (l_quantity, l_extendedprice) and embeddings. The network is English words in sequence: cue, next word,
number of times, kept where that number reaches LEAST, so it grows with the texts. Queries named whole_... take all pairs of
all texts. Node sets are words of at most three letters; the lexicon knows words that don't end in e.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.columns import AGGREGATES, described, floor_div, max_normalised, ordinal
from cairn.operators import centrality, community, describe, distribution, grid, kmeans, lexical, network, sweep, walks
from cairn.plans.lineage import cached, cut, shared_folder
from cairn.sources import graph_files

QUERIES: dict = {}
ORACLES: dict = {}
#: Occurrences from which on a pair of words is an edge of the word network.
LEAST = 20


def query(name: str, sql: str | None = None):
    """Registers a query of (spark, sf_dir), with its SQL where there is some."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points of two dimensions."""
    t = table(spark, sf_dir, "lineitem")
    return t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array("l_quantity", "l_extendedprice").alias("features"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points of all their dimensions."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


def sequences(docs: DataFrame, word: str) -> DataFrame:
    """(src, dst, weight): all pairs of different words in sequence and their number."""
    w = docs.select(F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(1)).alias("w")).where(F.size("w") > 1)
    pairs = w.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p"))
    return pairs.where("p.a <> p.b").groupBy(F.col("p.a").alias("src"), F.col("p.b").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


def whole_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequences() of words of letters in all texts, whatever their language."""
    return sequences(table(spark, sf_dir, "documents"), r"(\p{L}+)")


def whole_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of whole_sequences(), however few of a pair there are."""
    e = cut(whole_sequences(spark, sf_dir), "sequences")
    v = ordinal(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node").select("idx", "node")
    return v, e.select("*", F.concat_ws(" ", "src", "dst").alias("ord"), F.lit(0).alias("key"))


def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight, ord) of the word network."""
    by = sequences(table(spark, sf_dir, "documents").where("lang = 'en'"), "([a-z]+)")
    return by.where(F.col("weight") >= LEAST).select("src", "dst", "weight", F.concat_ws(" ", "src", "dst").alias("ord"))


def words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the word network."""
    e = cut(bigrams(spark, sf_dir), "bigrams")
    v = ordinal(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node").select("idx", "node")
    return v, e.withColumn("key", F.lit(0))


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of nations: from customers' to suppliers', by number of line items."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = rows.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").cast("double").alias("weight"))
    n = t("nation").select(F.col("n_nationkey").cast("long").alias("idx"), F.col("n_name").alias("node"))
    named = e.join(n.withColumnsRenamed({"idx": "c_nationkey", "node": "src"}), "c_nationkey").join(n.withColumnsRenamed({"idx": "s_nationkey", "node": "dst"}), "s_nationkey")
    return n, named.select("src", "dst", "weight", F.concat_ws(" ", "src", "dst").alias("ord"), F.lit(0).alias("key"))


#: CTEs that several oracles start with.
NET = f"""WITH RECURSIVE tok AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE lang = 'en'),
two AS (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM tok)),
e AS (SELECT a AS src, b AS dst, CAST(count(*) AS DOUBLE) AS weight FROM two WHERE a <> b GROUP BY ALL HAVING count(*) >= {LEAST}),
v AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)),
u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_max(weight, src || ' ' || dst) AS weight FROM e GROUP BY ALL),
arcs AS (SELECT a AS src, b AS dst, weight FROM u UNION ALL SELECT b, a, weight FROM u WHERE a <> b)
"""
GRID = """WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x, l_extendedprice AS y FROM lineitem),
b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p),
g AS (SELECT id, x, y, CAST(least(round(((x - lx) - ((x - lx) % ((hx - lx) / {m}))) / ((hx - lx) / {m})), {m} - 1) AS BIGINT) AS cx,
  CAST(least(round(((y - ly) - ((y - ly) % ((hy - ly) / {m}))) / ((hy - ly) / {m})), {m} - 1) AS BIGINT) AS cy FROM p, b)
"""
CENTERS = [[10.0, 15000.0], [25.0, 40000.0], [45.0, 70000.0]]
NEAR = """WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x, l_extendedprice AS y FROM lineitem),
c AS (SELECT * FROM (VALUES (0, 10.0, 15000.0), (1, 25.0, 40000.0), (2, 45.0, 70000.0)) AS t(k, cx, cy)),
n AS (SELECT id, x, y, min((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d2, arg_min(k, (x - cx) * (x - cx) + (y - cy) * (y - cy)) AS label FROM p, c GROUP BY ALL)
"""


def r6(c):
    return F.bround(c, 6)


def f32(c):
    """Single precision: hides the order of summation, and means of prices have no ties there as they have at decimal digits."""
    return c.cast("float").cast("double")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["grid_summary"](spark, sf_dir)


# --- grid summaries and clustering


@query("bounding_box", "SELECT min(l_quantity) AS lo0, min(l_extendedprice) AS lo1, max(l_quantity) AS hi0, max(l_extendedprice) AS hi1 FROM lineitem")
def _(spark, d):
    lo, hi = grid.bounds(items(spark, d), 2)
    return spark.createDataFrame([(*lo, *hi)], "lo0 double, lo1 double, hi0 double, hi1 double")


@query("grid_assignment", GRID.format(m=16) + "SELECT id, cx AS c0, cy AS c1 FROM g")
def _(spark, d):
    p = items(spark, d)
    cell = grid.cell(16, *grid.bounds(p, 2))
    return p.select("id", cell.alias("c")).select("id", F.col("c")[0].alias("c0"), F.col("c")[1].alias("c1"))


@query("grid_summary", GRID.format(m=16) + "SELECT cx AS c0, cy AS c1, CAST(CAST(avg(x) AS FLOAT) AS DOUBLE) AS m0, CAST(CAST(avg(y) AS FLOAT) AS DOUBLE) AS m1, count(*) AS card FROM g GROUP BY ALL")
def _(spark, d):
    p = items(spark, d)
    r = grid.representatives(p, 16, *grid.bounds(p, 2))
    return r.select(F.col("cell")[0].alias("c0"), F.col("cell")[1].alias("c1"), f32(F.col("rep")[0]).alias("m0"), f32(F.col("rep")[1]).alias("m1"), "card")


@query("grid_singletons", GRID.format(m=64) + "SELECT count(*) AS cells, count(*) FILTER (card > 1) AS heavy, count(*) FILTER (card = 1) AS single FROM (SELECT cx, cy, count(*) AS card FROM g GROUP BY ALL)")
def _(spark, d):
    p = items(spark, d)
    r = grid.representatives(p, 64, *grid.bounds(p, 2))
    return r.agg(F.count("*").alias("cells"), F.count_if(F.col("card") > 1).alias("heavy"), F.count_if(F.col("card") == 1).alias("single"))


@query("compression_ratio", GRID.format(m=16) + "SELECT round_even(count(DISTINCT (cx, cy)) / count(*), 9) AS ratio FROM g")
def _(spark, d):
    p = items(spark, d)
    return spark.createDataFrame([(grid.compression(p, grid.representatives(p, 16, *grid.bounds(p, 2))),)], "ratio double").select(F.bround("ratio", 9).alias("ratio"))


@query("grid_lines", "SELECT i AS line, round_even(lo + (hi - lo) * i / 8, 6) AS at FROM (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), range(9) AS t(i)")
def _(spark, d):
    lo, hi = grid.bounds(items(spark, d), 1)
    return spark.createDataFrame(list(enumerate(grid.grid_lines(lo[0], hi[0], 3))), "line long, at double").select("line", r6("at").alias("at"))


@query("nearest_center", NEAR + "SELECT id, label, CAST(CAST(d2 AS FLOAT) AS DOUBLE) AS d2 FROM n")
def _(spark, d):
    return kmeans.assign(items(spark, d), CENTERS).select("id", "label", f32(F.col("d2")).alias("d2"))


@query("center_update", NEAR + "SELECT label, CAST(CAST(avg(x) AS FLOAT) AS DOUBLE) AS x, CAST(CAST(avg(y) AS FLOAT) AS DOUBLE) AS y, count(*) AS n FROM n GROUP BY label")
def _(spark, d):
    f = F.col("features")
    return kmeans.assign(items(spark, d), CENTERS).groupBy("label").agg(f32(F.avg(f[0])).alias("x"), f32(F.avg(f[1])).alias("y"), F.count("*").alias("n"))


@query("weighted_center_update", GRID.format(m=16) + """, r AS (SELECT cx AS i, cy AS j, avg(x) AS x, avg(y) AS y, count(*) AS w FROM g GROUP BY ALL),
c AS (SELECT * FROM (VALUES (0, 10.0, 15000.0), (1, 25.0, 40000.0), (2, 45.0, 70000.0)) AS t(k, cx, cy)),
n AS (SELECT i, j, x, y, w, arg_min(k, (x - cx) * (x - cx) + (y - cy) * (y - cy)) AS label FROM r, c GROUP BY ALL)
SELECT label, CAST(CAST(sum(x * w) / sum(w) AS FLOAT) AS DOUBLE) AS x, CAST(CAST(sum(y * w) / sum(w) AS FLOAT) AS DOUBLE) AS y FROM n GROUP BY label""")
def _(spark, d):
    p = items(spark, d)
    r = grid.representatives(p, 16, *grid.bounds(p, 2))
    c = kmeans.updated(kmeans.assign(r, CENTERS, "rep"), CENTERS, "rep", "card")
    return spark.createDataFrame([(i, *x) for i, x in enumerate(c)], "label int, x double, y double").select("label", f32(F.col("x")).alias("x"), f32(F.col("y")).alias("y"))


@query("inertia_of_cells", GRID.format(m=16) + """, r AS (SELECT avg(x) AS x, avg(y) AS y FROM g GROUP BY cx, cy),
c AS (SELECT * FROM (VALUES (0, 10.0, 15000.0), (1, 25.0, 40000.0), (2, 45.0, 70000.0)) AS t(k, cx, cy)),
n AS (SELECT x, y, min((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d2 FROM r, c GROUP BY ALL)
SELECT CAST(round_even(sum(d2), 0) AS BIGINT) AS inertia FROM n""")
def _(spark, d):
    p = items(spark, d)
    return spark.createDataFrame([(kmeans.inertia(grid.representatives(p, 16, *grid.bounds(p, 2)), CENTERS),)], "inertia long")


@query("clustering_error", NEAR + "SELECT round_even(sum(sqrt(d2)), 2) AS error FROM n")
def _(spark, d):
    return spark.createDataFrame([(kmeans.error(kmeans.assign(items(spark, d), CENTERS), CENTERS),)], "error double").select(F.bround("error", 2).alias("error"))


@query("lloyd_two_steps", NEAR + """, c1 AS (SELECT label AS k, avg(x) AS cx, avg(y) AS cy FROM n GROUP BY label),
n1 AS (SELECT id, x, y, arg_min(k, (x - cx) * (x - cx) + (y - cy) * (y - cy)) AS label FROM p, c1 GROUP BY ALL)
SELECT label, CAST(CAST(avg(x) AS FLOAT) AS DOUBLE) AS x, CAST(CAST(avg(y) AS FLOAT) AS DOUBLE) AS y FROM n1 GROUP BY label""")
def _(spark, d):
    c, *_ = kmeans.lloyd(items(spark, d), CENTERS, 2, 0.0)
    return spark.createDataFrame([(i, *x) for i, x in enumerate(c)], "label int, x double, y double").select("label", f32(F.col("x")).alias("x"), f32(F.col("y")).alias("y"))


@query("label_propagation", GRID.format(m=16) + """, r AS (SELECT cx, cy, avg(x) AS mx, avg(y) AS my FROM g GROUP BY cx, cy),
c AS (SELECT * FROM (VALUES (0, 10.0, 15000.0), (1, 25.0, 40000.0), (2, 45.0, 70000.0)) AS t(k, kx, ky)),
l AS (SELECT cx, cy, arg_min(k, (mx - kx) * (mx - kx) + (my - ky) * (my - ky)) AS label FROM r, c GROUP BY cx, cy)
SELECT id, label FROM g JOIN l USING (cx, cy)""")
def _(spark, d):
    p = items(spark, d)
    lo, hi = grid.bounds(p, 2)
    return kmeans.propagated(p, grid.representatives(p, 16, lo, hi), 16, lo, hi, CENTERS, 3).select("id", "label")


def _lloyd_sql(rounds: list[int], steps: int, k: int = 3) -> str:
    """CTEs of recursive-partition k-means from CENTERS: cells r of each grid, centers c after each step; a cluster without cells keeps its center."""
    out = ["WITH p AS MATERIALIZED (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x, l_extendedprice AS y FROM lineitem)", "b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p)"]
    out.append("c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(CENTERS)) + ") AS t(k, cx, cy))")
    n = 0
    for j, m in enumerate(rounds):
        cell = lambda v: f"CAST(least(round((({v} - l{v}) - (({v} - l{v}) % ((h{v} - l{v}) / {m}))) / ((h{v} - l{v}) / {m})), {m} - 1) AS BIGINT)"
        out.append(f"g{j} AS MATERIALIZED (SELECT id, x, y, {cell('x')} AS i, {cell('y')} AS j FROM p, b)")
        out.append(f"r{j} AS MATERIALIZED (SELECT i, j, avg(x) AS x, avg(y) AS y, count(*) AS w FROM g{j} GROUP BY i, j)")
        for _ in range(steps):
            out.append(f"l{n} AS MATERIALIZED (SELECT i, j, x, y, w, arg_min(k, (x - cx) * (x - cx) + (y - cy) * (y - cy)) AS label FROM r{j}, c{n} GROUP BY ALL)")
            out.append(f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(x, cx) AS cx, coalesce(y, cy) AS cy FROM c{n} LEFT JOIN (SELECT label, sum(x * w) / sum(w) AS x, sum(y * w) / sum(w) AS y FROM l{n} GROUP BY label) ON label = k)")
            n += 1
    return ",\n".join(out)


_FIT = {"clusters": 3, "max_part": 5, "max_iter": 4, "tol": 0.0, "start": CENTERS}
_GRIDS = [2, 4, 8, 16, 32]
_DONE = _lloyd_sql(_GRIDS, 4)


@query("summary_kmeans_fit", _DONE + f""", z AS (SELECT id, p.x AS x, p.y AS y, label FROM g4 p JOIN l19 USING (i, j))
SELECT (SELECT CAST(round_even(sum(d), 0) AS BIGINT) FROM (SELECT min((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM r4, c20 GROUP BY i, j)) AS inertia, 5 AS n_part, 3 AS n_iter, 20 AS iterations,
  CAST(4 * 3 * ({' + '.join(f'(SELECT count(*) FROM r{j})' for j in range(5))}) AS BIGINT) AS distances, (SELECT count(*) FROM r4) AS partitions,
  (SELECT round_even(sum(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 2) FROM z JOIN c20 ON k = label) AS error""")
def _(spark, d):
    return kmeans.fit(items(spark, d), **_FIT).metrics(spark).withColumn("error", F.bround("error", 2))


@query("summary_kmeans_labels", _DONE + " SELECT id, label FROM g4 JOIN l19 USING (i, j)")
def _(spark, d):
    return kmeans.fit_predict(items(spark, d), **_FIT)


@query("summary_kmeans_predict", _DONE + " SELECT id, arg_min(k, (x - cx) * (x - cx) + (y - cy) * (y - cy)) AS label FROM p, c20 GROUP BY id, x, y")
def _(spark, d):
    p = items(spark, d)
    return kmeans.fit(p, **_FIT).predict(p)


@query("summary_kmeans_drawn_start")
def _(spark, d):
    """Whole embeddings, from cells drawn by the seed."""
    return kmeans.fit_predict(embedded(spark, d), clusters=4, max_part=2, max_iter=10, seed=3)


@query("lloyd_to_rest", NEAR + """, s0(t, k, cx, cy) AS (SELECT 0, k, cx, cy FROM c), """ + ", ".join(f"s{t + 1} AS MATERIALIZED (SELECT {t + 1} AS t, label AS k, avg(x) AS cx, avg(y) AS cy FROM (SELECT id, x, y, arg_min(k, (x - cx) * (x - cx) + (y - cy) * (y - cy)) AS label FROM p, s{t} GROUP BY ALL) GROUP BY label)" for t in range(15)) + """, a AS (""" + " UNION ALL ".join(f"SELECT * FROM s{t}" for t in range(16)) + """),
m AS (SELECT b.t AS t, sum((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS shift FROM a JOIN a b ON b.t = a.t + 1 AND b.k = a.k GROUP BY b.t),
f AS (SELECT coalesce(min(t) FILTER (shift < 1e6), 15) AS t, count(*) FILTER (shift < 1e6) > 0 AS rests FROM m)
SELECT k AS label, CAST(CAST(cx AS FLOAT) AS DOUBLE) AS x, CAST(CAST(cy AS FLOAT) AS DOUBLE) AS y, CAST(f.t AS INT) AS iterations, rests FROM a JOIN f USING (t)""")
def _(spark, d):
    c, _, n, rests = kmeans.lloyd(items(spark, d), CENTERS, 15, 1e6)
    return spark.createDataFrame([(i, *x, n, rests) for i, x in enumerate(c)], "label int, x double, y double, iterations int, rests boolean").withColumns({"x": f32(F.col("x")), "y": f32(F.col("y"))})


_CELLS = {m: GRID.format(m=m).split("AS (", 3)[3].rsplit(")", 1)[0] for m in (16, 32, 64, 128)}


@query("grown_summary", GRID.format(m=16).rsplit("g AS (", 1)[0] + ", ".join(f"g{m} AS (SELECT count(DISTINCT (cx, cy)) AS n FROM ({q}))" for m, q in _CELLS.items()) + " SELECT CAST(m AS BIGINT) AS m, n AS cells FROM (" + " UNION ALL ".join(f"SELECT {m} AS m, n FROM g{m}" for m in _CELLS) + ") WHERE n >= 2000 ORDER BY m LIMIT 1")
def _(spark, d):
    """From 64 boxes a dimension on, as 2,000 cells are asked for."""
    m, _, _, cells = kmeans.summarised(items(spark, d), 2, 2000)
    return spark.createDataFrame([(m, cells.count())], "m long, cells long")


@query("smallest_resolutions", "SELECT CAST(d AS INT) AS dims, CAST(k AS INT) AS clusters, CAST(pow(2, greatest(0, ceil(log2(ceil(round(pow(k, 1.0 / d), 9)))))) AS BIGINT) AS m FROM range(1, 9) a(d), range(1, 65) b(k)")
def _(spark, d):
    return spark.createDataFrame([(a, k, grid.smallest_resolution(a, k)) for a in range(1, 9) for k in range(1, 65)], "dims int, clusters int, m long")


_WRONG = {"clusters": 0, "max_part": -1, "max_iter": 0, "seed": -1, "tol": -0.5, "verbose": 2}


@query("refused_parameters", "SELECT * FROM (VALUES ('clusters', 'clusters must be above 0, not 0'), ('max_part', 'max_part must be above 0, not -1'), ('max_iter', 'max_iter must be above 0, not 0'), ('seed', 'seed must not be negative: -1'), ('tol', 'tol must not be negative: -0.5'), ('verbose', 'verbose must be 0 or 1, not 2'), ('points', (SELECT count(*) || ' points for 4096 clusters' FROM nation))) AS t(parameter, reason)")
def _(spark, d):
    points, out = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.col("n_nationkey").cast("double")).alias("features")), []
    for name, how in [*((k, {"clusters": 3, k: v}) for k, v in _WRONG.items()), ("points", {"clusters": 4096})]:
        try:
            kmeans.fit(points, **how)
        except ValueError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "parameter string, reason string")


@query("baseline_costs", "SELECT CAST(i AS INT) AS iterations, CAST(k AS INT) AS k, n, i * k * n AS full_cost, i * k * 100 AS batch_cost, round_even((i * k * n - i * k * 100) / (i * k * n), 9) AS saved FROM range(1, 6) a(i), range(2, 10) b(k), (SELECT count(*) AS n FROM lineitem)")
def _(spark, d):
    n = items(spark, d).count()
    rows = [(i, k, n, sweep.full_cost(i, k, n), sweep.batch_cost(i, k, 100)) for i in range(1, 6) for k in range(2, 10)]
    return spark.createDataFrame([(*r, sweep.relative_error(r[4], r[3])) for r in rows], "iterations int, k int, n long, full_cost long, batch_cost long, saved double").withColumn("saved", F.bround("saved", 9))


def _centers(spark, centers, n):
    """A row a component: clusters of any number of dimensions."""
    return spark.createDataFrame([(i, j, float(x), n) for i, c in enumerate(centers) for j, x in enumerate(c)], "cluster int, dimension int, value double, iterations int")


@query("kmeans_full_baseline")
def _(spark, d):
    return _centers(spark, *kmeans.plus_plus(embedded(spark, d), 4, 1, 20))


@query("kmeans_mini_batch")
def _(spark, d):
    return _centers(spark, *kmeans.mini_batch(embedded(spark, d), 3, 100, 5))


@query("kmeans_seeded_baseline", """WITH p AS MATERIALIZED (SELECT id, j, v[j]::DOUBLE AS x FROM (SELECT vec_id AS id, embedding AS v, unnest(range(1, len(embedding) + 1)) AS j FROM embeddings)),
c0 AS (SELECT id AS k, j, x AS c FROM p WHERE id < 4), """ + ", ".join(f"""l{t} AS MATERIALIZED (SELECT id, arg_min(k, d) AS k FROM (SELECT id, k, sum((x - c) * (x - c)) AS d FROM p JOIN c{t} USING (j) GROUP BY id, k) GROUP BY id),
c{t + 1} AS MATERIALIZED (SELECT k, j, avg(x) AS c FROM p JOIN l{t} USING (id) GROUP BY k, j)""" for t in range(4)) + """
SELECT CAST(k AS INT) AS cluster, CAST(j - 1 AS INT) AS dimension, CAST(CAST(c AS FLOAT) AS DOUBLE) AS value, 4 AS iterations FROM c4""")
def _(spark, d):
    p = embedded(spark, d)
    start = [r.features for r in p.where("id < 4").orderBy("id").collect()]  # four vectors
    return _centers(spark, *kmeans.seeded(p, start, 4, 0.0)).withColumn("value", f32(F.col("value")))


@query("sweep_means")
def _(spark, d):
    n = items(spark, d).count() // 100
    return sweep.means(sweep.sweep(lambda n, dims, k, rep: sweep.blobs(spark, n, k, dims, rep), [3], [2], [n], 2, 2, (100,), max_iter=5))


@query("synthetic_blobs")
def _(spark, d):
    return sweep.blobs(spark, items(spark, d).count(), 3, 2, 1)


@query("row_subset")
def _(spark, d):
    return sweep.subset(embedded(spark, d), [0, 3], 50, 1)


@query("feature_subset", "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[64]::DOUBLE AS y FROM embeddings")
def _(spark, d):
    p = embedded(spark, d)
    return sweep.subset(p, [0, 63], p.count(), 1).select("id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))


# --- networks


@query("word_network", NET + "SELECT src, dst, weight FROM e")
def _(spark, d):
    return bigrams(spark, d).select("src", "dst", "weight")


@query("whole_word_network")
def _(spark, d):
    return whole_sequences(spark, d)


@query("whole_pagerank")
def _(spark, d):
    return centrality.pagerank(*whole_words(spark, d), iterations=20, tol=0.0, normalise=False).select("node", F.bround("score", 9).alias("score"))


@query("word_vertices", NET + "SELECT idx, node FROM v")
def _(spark, d):
    return words(spark, d)[0]


@query("undirected_projection", NET + "SELECT * FROM u")
def _(spark, d):
    return network.undirected(words(spark, d)[1])


@query("digraph_projection", "WITH e AS (SELECT user_id, event_type, arg_max(value, event_id) AS weight FROM events GROUP BY ALL) SELECT CAST(user_id AS VARCHAR) AS src, event_type AS dst, weight FROM e")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"), F.col("value").alias("weight"), F.col("event_id").alias("ord"))
    return network.digraph(e)


@query("integer_relabel", NET + "SELECT s.idx AS src, t.idx AS dst, weight FROM e JOIN v s ON s.node = src JOIN v t ON t.node = dst")
def _(spark, d):
    v, e = words(spark, d)
    return network.relabelled(e, v).select("src", "dst", "weight")


_SEEDS = "(SELECT node FROM v WHERE length(node) <= 3)"


def _seeds(v):
    return v.where("length(node) <= 3").select("node")


@query("induced_subgraph", NET + f"SELECT src, dst, weight FROM e WHERE src IN {_SEEDS} AND dst IN {_SEEDS}")
def _(spark, d):
    v, e = words(spark, d)
    return network.induced(e, _seeds(v)).select("src", "dst", "weight")


@query("subgraph_with_neighbours", NET + f", k AS (SELECT node FROM {_SEEDS} UNION SELECT src FROM e WHERE src IN {_SEEDS} UNION SELECT dst FROM e WHERE src IN {_SEEDS}) SELECT src, dst, weight FROM e WHERE src IN (FROM k) AND dst IN (FROM k)")
def _(spark, d):
    v, e = words(spark, d)
    return network.subgraph(e, _seeds(v), True).select("src", "dst", "weight")


@query("edge_subgraph", NET + ", h AS (SELECT src, dst FROM e WHERE weight > (SELECT avg(weight) FROM e)) SELECT src, dst, weight FROM e JOIN h USING (src, dst)")
def _(spark, d):
    e = words(spark, d)[1]
    mean = e.agg(F.avg("weight").alias("m"))
    return network.edge_subgraph(e, e.crossJoin(F.broadcast(mean)).where("weight > m")).select("src", "dst", "weight")  # one row


@query("boundary_edges", NET + f"SELECT src, dst, weight FROM e WHERE src IN {_SEEDS} AND dst NOT IN {_SEEDS}")
def _(spark, d):
    v, e = words(spark, d)
    return network.boundary(e, _seeds(v)).select("src", "dst", "weight")


@query("out_edges", NET + f"SELECT src, dst, weight AS value FROM e WHERE src IN {_SEEDS}")
def _(spark, d):
    v, e = words(spark, d)
    return network.out_edges(e, _seeds(v), "weight")


@query("network_counts", NET + "SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges")
def _(spark, d):
    return network.counts(*words(spark, d))


@query("node_degrees", NET + "SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def _(spark, d):
    return network.degrees(words(spark, d)[1])


@query("node_strengths", NET + "SELECT node, CAST(sum(weight) AS BIGINT) AS degree FROM (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY node")
def _(spark, d):
    return network.degrees(words(spark, d)[1], "weight")


@query("top_nodes", NET + "SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node ORDER BY degree DESC, node LIMIT 8")
def _(spark, d):
    return network.top(network.degrees(words(spark, d)[1]), "degree", 8)


@query("max_normalised_degree", NET + ", g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT node, round_even(n / max(n) OVER (), 9) AS score FROM g")
def _(spark, d):
    return max_normalised(network.degrees(words(spark, d)[1]).withColumnRenamed("degree", "score"), "score").select("node", F.bround("score", 9).alias("score"))


@query("above_threshold", NET + ", g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT node FROM (SELECT node, n / max(n) OVER () AS score FROM g) WHERE score > 0.4")
def _(spark, d):
    s = max_normalised(network.degrees(words(spark, d)[1]).withColumnRenamed("degree", "score"), "score")
    return network.above(s, "score", 0.4).select("node")


@query("visual_scales", NET + ", g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT node, round_even(n / max(n) OVER () * 80 + 20, 6) AS size FROM g")
def _(spark, d):
    return network.visual_scales(*words(spark, d))[0].select("node", r6("size").alias("size"))


@query("visual_widths", NET + "SELECT src, dst, round_even(weight / max(weight) OVER (), 9) AS width FROM e")
def _(spark, d):
    return network.visual_scales(*words(spark, d))[1].select("src", "dst", F.bround("width", 9).alias("width"))


# --- descriptors and distributions


@query("aggregates_by_name", "SELECT max(l_quantity) AS a0, min(l_quantity) AS a1, round_even(avg(l_quantity), 6) AS a2, round_even(stddev_pop(l_quantity), 6) AS a3, round_even(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 6) AS a4 FROM lineitem")
def _(spark, d):
    t, v, w = table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice")
    names = ("max", "min", "mean", "std", "weighted average")
    return t.agg(*[(AGGREGATES[n](v, w) if i < 2 else r6(AGGREGATES[n](v, w))).alias(f"a{i}") for i, n in enumerate(names)])


@query("weighted_std", "WITH m AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_extendedprice) AS m FROM lineitem) SELECT round_even(sqrt(sum(l_extendedprice * (l_quantity - m) * (l_quantity - m)) / sum(l_extendedprice)), 6) AS value FROM lineitem, m")
def _(spark, d):
    return described(table(spark, d, "lineitem"), "weighted std", "l_quantity", "l_extendedprice").select(r6("value").alias("value"))


@query("degree_descriptor", NET + ", g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT round_even(avg(n), 6) AS value FROM g")
def _(spark, d):
    return describe.degree_descriptor(words(spark, d)[1], "mean").select(r6("value").alias("value"))


@query("edge_descriptor", NET + f"SELECT round_even(avg(weight), 6) AS value FROM e WHERE src IN {_SEEDS}")
def _(spark, d):
    v, e = words(spark, d)
    return describe.edge_descriptor(e, "mean", "weight", _seeds(v)).select(r6("value").alias("value"))


@query("node_descriptor", "SELECT coalesce(round_even(avg(c_acctbal), 6), -1) AS value FROM customer WHERE c_acctbal >= 0")
def _(spark, d):
    return describe.node_descriptor(table(spark, d, "customer"), "mean", "c_acctbal").select(r6("value").alias("value"))


@query("numeric_descriptors", NET + """, g AS (SELECT node, count(*) AS n, sum(weight) AS s FROM (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY node),
o AS (SELECT src, count(*) AS k FROM e GROUP BY src),
x AS (SELECT s.k AS k, coalesce(t.k, 0) AS kd, weight FROM e JOIN o s ON s.src = e.src LEFT JOIN o t ON t.src = e.dst),
nb AS (SELECT avg(m) AS a, avg(mw) AS b FROM (SELECT k, avg(kd) AS m, sum(weight * kd) / sum(weight) AS mw FROM x GROUP BY k)),
tri AS (SELECT a.src AS node, count(*) AS t FROM arcs a JOIN arcs b ON b.src = a.dst JOIN arcs c ON c.src = b.dst AND c.dst = a.src GROUP BY a.src),
dg AS (SELECT src AS node, count(*) AS k FROM arcs GROUP BY src),
cl AS (SELECT avg(CASE WHEN k >= 2 THEN coalesce(t, 0) / (k * (k - 1)) ELSE 0 END) AS c FROM dg LEFT JOIN tri USING (node)),
m AS (SELECT 'max_degree' AS metric, max(n) AS value FROM g UNION ALL SELECT 'min_degree', min(n) FROM g UNION ALL SELECT 'avg_degree', avg(n) FROM g UNION ALL SELECT 'max_strength', max(s) FROM g
  UNION ALL SELECT 'min_strength', min(s) FROM g UNION ALL SELECT 'avg_strength', avg(s) FROM g UNION ALL SELECT 'std_strength', stddev_pop(s) FROM g UNION ALL SELECT 'edges', count(*) FROM e
  UNION ALL SELECT 'max_weight', max(weight) FROM e UNION ALL SELECT 'min_weight', min(weight) FROM e UNION ALL SELECT 'avg_weight', avg(weight) FROM e UNION ALL SELECT 'std_weight', stddev_pop(weight) FROM e
  UNION ALL SELECT 'nodes', count(*) FROM v UNION ALL SELECT 'avg_neighbour_degree', a FROM nb UNION ALL SELECT 'avg_neighbour_weight', b FROM nb UNION ALL SELECT 'avg_clustering', c FROM cl)
SELECT metric, round_even(CAST(value AS DOUBLE), 6) AS value FROM m""")
def _(spark, d):
    return describe.numeric(*words(spark, d)).select("metric", r6("value").alias("value"))


_HIST = NET + ", g AS (SELECT node, count(*) AS value FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node), s AS (SELECT min(value) AS lo, max(value) AS hi FROM g)"


def _degree_values(spark, d):
    return network.degrees(words(spark, d)[1]).withColumnRenamed("degree", "value")


@query("linear_histogram", _HIST + """, b AS (SELECT i AS bin, lo + (hi - lo) * i / 9 AS l, lo + (hi - lo) * (i + 1) / 9 AS h FROM s, range(9) AS t(i)),
c AS (SELECT bin, l, h, count(value) AS n FROM b LEFT JOIN g ON value >= l AND (value < h OR (bin = 8 AND value <= h)) GROUP BY ALL)
SELECT CAST(bin AS INT) AS bin, round_even(l, 6) AS lo, round_even(h, 6) AS hi, n AS count, round_even(n / sum(n) OVER (), 9) AS pdf, round_even(1 - sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 9) + 0.0 AS ccdf FROM c""")
def _(spark, d):
    v = _degree_values(spark, d)
    lo, hi, _ = distribution.span(v)
    h = distribution.densities(distribution.histogram(v, distribution.linear_edges(lo, hi)))
    return h.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "count", F.bround("pdf", 9).alias("pdf"), (F.bround("ccdf", 9) + 0.0).alias("ccdf"))


@query("unit_histogram", _HIST + ", b AS (SELECT i AS bin, lo + i AS l, lo + i + 1 AS h, hi - lo - 1 AS n FROM s, range((SELECT hi - lo - 1 FROM s)) AS t(i)) SELECT CAST(bin AS INT) AS bin, CAST(l AS DOUBLE) AS lo, CAST(h AS DOUBLE) AS hi, count(value) AS count FROM b LEFT JOIN g ON value >= l AND (value < h OR (bin = n - 1 AND value <= h)) GROUP BY ALL")
def _(spark, d):
    v = _degree_values(spark, d)
    lo, hi, _ = distribution.span(v)
    return distribution.histogram(v, distribution.unit_edges(lo, hi))


@query("power_law_exponent", _HIST + "SELECT round_even(1 + count(*) / sum(ln(value / (lo - 0.5))), 6) AS gamma FROM g, s")
def _(spark, d):
    return distribution.power_law(_degree_values(spark, d)).select(r6("gamma").alias("gamma"))


@query("unknown_share", "SELECT round_even(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END), 9) AS unknown_share FROM customer")
def _(spark, d):
    return distribution.unknown_share(table(spark, d, "customer"), "c_acctbal").select(F.bround("unknown_share", 9).alias("unknown_share"))


@query("rebinned_histogram", "SELECT CAST(floor((ceil(p_size) - 1) / 10) AS INT) AS bin, sum(p_retailprice > 1000) + 0.0 AS mass FROM part WHERE p_size > 0 AND p_size <= 50 GROUP BY ALL")
def _(spark, d):
    m = table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") > 1000).cast("double").alias("mass"))
    return distribution.rebinned(m, [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]).select("bin", "mass")


def _distribution_sql(metric: str, values: str) -> str:
    """CTEs and a query of one metric's bins; values is a query of (value)."""
    m = metric
    return f"""{m}_g AS MATERIALIZED ({values}), {m}_s AS MATERIALIZED (SELECT min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi, CAST(least(10, max(value)) AS BIGINT) AS n FROM {m}_g),
{m}_y AS (SELECT 1 + count(*) / sum(ln(value / (lo - 0.5))) AS gamma FROM {m}_g, {m}_s),
{m}_e AS MATERIALIZED (SELECT 'linear' AS bins, i, lo + (hi - lo) * i / 9 AS x FROM {m}_s, range(10) t(i) UNION ALL SELECT 'unit', i, lo + i FROM {m}_s, range((SELECT CAST(ceil(hi - lo) AS BIGINT) FROM {m}_s)) t(i)
  UNION ALL SELECT 'log', i, pow(10, log10(lo) + (log10(hi) - log10(lo)) * i / (n - 1)) FROM {m}_s, range(10) t(i) WHERE i < n),
{m}_b AS MATERIALIZED (SELECT a.bins, a.i AS bin, a.x AS lo, b.x AS hi, a.i = max(a.i) OVER (PARTITION BY a.bins) AS last FROM {m}_e a JOIN {m}_e b ON b.bins = a.bins AND b.i = a.i + 1),
{m}_c AS (SELECT bins, bin, lo, hi, count(value) AS n FROM {m}_b LEFT JOIN {m}_g ON value >= lo AND (value < hi OR (last AND value = hi)) GROUP BY ALL),
{m}_d AS (SELECT '{metric}' AS metric, bins, CAST(bin AS INT) AS bin, round_even(lo, 6) AS lo, round_even(hi, 6) AS hi, n AS count, round_even(n / sum(n) OVER (PARTITION BY bins), 9) AS pdf, round_even(1 - sum(n) OVER (PARTITION BY bins ORDER BY bin) / sum(n) OVER (PARTITION BY bins), 9) + 0.0 AS ccdf, round_even(gamma, 6) AS gamma, 0.0::DOUBLE AS unknown_share FROM {m}_c, {m}_y)"""


@query("distributions", NET + ", " + _distribution_sql("degree", "SELECT count(*) AS value FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node") + ", " + _distribution_sql("strength", "SELECT CAST(sum(weight) AS BIGINT) AS value FROM (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY node") + " SELECT * FROM degree_d UNION ALL SELECT * FROM strength_d")
def _(spark, d):
    e = words(spark, d)[1]
    got = distribution.distribution({"degree": network.degrees(e).withColumnRenamed("degree", "value"), "strength": network.degrees(e, "weight").withColumnRenamed("degree", "value")})
    return got.withColumns({"lo": r6("lo"), "hi": r6("hi"), "pdf": F.bround("pdf", 9), "ccdf": F.bround("ccdf", 9) + 0.0, "gamma": r6("gamma")})


@query("two_valued_distribution", "WITH g AS (SELECT CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS value FROM part) SELECT 'large' AS metric, 'unit' AS bins, CAST(b AS INT) AS bin, b / 2.0::DOUBLE AS lo, (b + 1) / 2.0::DOUBLE AS hi, count(value) AS count, round_even(count(value) / (SELECT count(*) FROM g), 9) AS pdf FROM range(2) t(b) LEFT JOIN g ON value = b GROUP BY b")
def _(spark, d):
    v = table(spark, d, "part").select((F.col("p_size") > 25).cast("double").alias("value"))
    return distribution.distribution({"large": v}).select("metric", "bins", "bin", "lo", "hi", "count", F.bround("pdf", 9).alias("pdf"))


@query("tag_frequency", "WITH t AS (SELECT p_size % 10 AS tag, count(*) AS n FROM part GROUP BY ALL) SELECT tag, n, round_even(n / sum(n) OVER (), 2) AS share FROM t")
def _(spark, d):
    return describe.tag_frequency(table(spark, d, "part").select((F.col("p_size") % 10).alias("tag")))


# --- graph algorithms


@query("clustering_coefficients", NET + """, tri AS (SELECT a.src AS node, count(*) AS t FROM arcs a JOIN arcs b ON b.src = a.dst JOIN arcs c ON c.src = b.dst AND c.dst = a.src GROUP BY a.src),
dg AS (SELECT src AS node, count(*) AS k FROM arcs GROUP BY src)
SELECT node, round_even(CASE WHEN k >= 2 THEN coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 9) AS clustering FROM dg LEFT JOIN tri USING (node)""")
def _(spark, d):
    return centrality.clustering(*words(spark, d)).select("node", F.bround("clustering", 9).alias("clustering"))


@query("mean_neighbour_degree", NET + ", o AS (SELECT src, count(*) AS k FROM e GROUP BY src), x AS (SELECT s.k AS k, avg(coalesce(t.k, 0)) AS m FROM e JOIN o s ON s.src = e.src LEFT JOIN o t ON t.src = e.dst GROUP BY s.k) SELECT round_even(avg(m), 6) AS value FROM x")
def _(spark, d):
    return centrality.mean_neighbour_degree(words(spark, d)[1]).select(r6("value").alias("value"))


_BFS = NET + ", h(source, node, depth) AS (SELECT src, src, 0 FROM arcs UNION SELECT source, arcs.dst, depth + 1 FROM h JOIN arcs ON arcs.src = node WHERE depth < 20), dist AS (SELECT source, node, min(depth) AS depth FROM h GROUP BY ALL)"


@query("hop_distances", _BFS + "SELECT source, node, CAST(depth AS INT) AS depth FROM dist")
def _(spark, d):
    return centrality.hops(words(spark, d)[1])


@query("connected_components", _BFS + "SELECT source AS node, min(node) AS component FROM dist GROUP BY source")
def _(spark, d):
    return centrality.components(*words(spark, d))


_BIG = _BFS + ", comp AS (SELECT source AS node, min(node) AS c FROM dist GROUP BY source), big AS (SELECT c FROM comp GROUP BY c ORDER BY count(*) DESC, c LIMIT 1), ecc AS (SELECT source AS node, max(depth) AS ecc FROM dist WHERE source IN (SELECT node FROM comp WHERE c IN (FROM big)) GROUP BY source)"


def _largest(spark, d):
    v, e = words(spark, d)
    n = cut(centrality.largest_component(v, e), "largest")
    return n, network.induced(e, n)


@query("eccentricity", _BIG + "SELECT node, CAST(ecc AS INT) AS ecc FROM ecc")
def _(spark, d):
    return centrality.eccentricity(*_largest(spark, d))


@query("radius_diameter", _BIG + "SELECT CAST(min(ecc) AS INT) AS radius, CAST(max(ecc) AS INT) AS diameter FROM ecc")
def _(spark, d):
    return centrality.radius_diameter(centrality.eccentricity(*_largest(spark, d)))


@query("scaled_eccentricity", _BIG + "SELECT node, round_even((d - ecc) / nullif(d - r, 0) * 0.9 + 0.1, 9) AS score FROM ecc, (SELECT min(ecc) AS r, max(ecc) AS d FROM ecc)")
def _(spark, d):
    return centrality.scaled_eccentricity(cut(centrality.eccentricity(*_largest(spark, d)), "ecc")).select("node", F.bround("score", 9).alias("score"))


@query("pagerank", NET + """, n AS (SELECT count(*) AS n FROM v), tot AS (SELECT src, sum(weight) AS t FROM e GROUP BY src),
p AS (SELECT src, dst, weight / t AS p FROM e JOIN tot USING (src) UNION ALL SELECT d.node, v.node, 1.0 / n FROM v d, v, n WHERE d.node NOT IN (SELECT src FROM tot) UNION ALL SELECT node, node, 0.0 FROM v),
r(t, node, x) AS (SELECT 0, node, 1.0 / n FROM v, n UNION ALL SELECT t + 1, p.dst, 0.15 / any_value(n) + 0.85 * sum(x * p) FROM r JOIN p ON p.src = r.node, n WHERE t < 20 GROUP BY t + 1, p.dst)
SELECT node, round_even(x, 9) AS score FROM r WHERE t = 20""")
def _(spark, d):
    return centrality.pagerank(*words(spark, d), iterations=20, tol=0.0, normalise=False).select("node", F.bround("score", 9).alias("score"))


@query("betweenness_centrality", NET + """, d(t, s, v, x) AS (SELECT 0, node, node, 0.0::DOUBLE FROM v UNION ALL SELECT t + 1, s, y, min(x) FROM (SELECT d.t AS t, d.s AS s, f.dst AS y, d.x + f.weight AS x FROM d JOIN (SELECT src, dst, weight FROM e UNION ALL SELECT node, node, 0.0 FROM v) f ON f.src = d.v) WHERE t < 40 GROUP BY t, s, y),
dist AS MATERIALIZED (SELECT s, v, x FROM d WHERE t = 40),
tight AS MATERIALIZED (SELECT a.s AS s, e.src AS u, e.dst AS v FROM dist a JOIN e ON e.src = a.v JOIN dist b ON b.s = a.s AND b.v = e.dst WHERE a.x + e.weight = b.x),
n(t, s, v, c) AS (SELECT 0, node, node, 1.0::DOUBLE FROM v UNION ALL SELECT n.t + 1, n.s, tight.v, sum(c) FROM n JOIN tight ON tight.s = n.s AND tight.u = n.v WHERE n.t < 40 GROUP BY n.t + 1, n.s, tight.v),
sigma AS MATERIALIZED (SELECT s, v, sum(c) AS c FROM n GROUP BY s, v),
w AS MATERIALIZED (SELECT s, v, x, c FROM dist JOIN sigma USING (s, v) WHERE s <> v),
b AS (SELECT a.v AS node, sum(a.c * z.c / w.c) AS b FROM w a JOIN w z ON z.s = a.v JOIN w ON w.s = a.s AND w.v = z.v WHERE a.x + z.x = w.x GROUP BY a.v)
SELECT node, round_even(coalesce(b, 0) / max(b) OVER (), 9) AS score FROM v LEFT JOIN b USING (node)""")
def _(spark, d):
    return centrality.betweenness(*words(spark, d)).select("node", F.bround("score", 9).alias("score"))


_TRADE = """WITH RECURSIVE e AS (SELECT c.n_name AS src, s.n_name AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation c ON c.n_nationkey = c_nationkey JOIN nation s ON s.n_nationkey = s_nationkey GROUP BY ALL)
"""


@query("eigenvector_centrality", _TRADE + """, v AS (SELECT n_name AS node FROM nation), r(t, node, x) AS (SELECT 0, node, 1.0::DOUBLE / count(*) OVER () FROM v UNION ALL
  SELECT t, node, x / sqrt(sum(x * x) OVER ()) FROM (SELECT r.t + 1 AS t, f.dst AS node, sum(r.x * f.weight) AS x FROM r JOIN (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM e UNION ALL SELECT node, node, 1.0 FROM v) GROUP BY ALL) f ON f.src = r.node WHERE r.t < 12 GROUP BY r.t + 1, f.dst))
SELECT node, round_even(x / max(x) OVER (), 9) AS score FROM r WHERE t = 12""")
def _(spark, d):
    return centrality.eigenvector(*trade(spark, d), iterations=12, tol=0.0).select("node", F.bround("score", 9).alias("score"))


@query("trade_network", _TRADE + "SELECT * FROM e")
def _(spark, d):
    return trade(spark, d)[1].select("src", "dst", "weight")


@query("expected_visits", _TRADE + """, p AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM e),
r(t, a, b, x) AS (SELECT DISTINCT 0, src, src, 1.0::DOUBLE FROM p UNION ALL SELECT t + 1, a, p.dst, sum(x * p) FROM r JOIN p ON p.src = b WHERE t < 4 GROUP BY t + 1, a, p.dst)
SELECT a AS start, b AS visited, round_even(sum(x), 9) AS avg_visits FROM r GROUP BY ALL""")
def _(spark, d):
    v, e = trade(spark, d)
    n = cut(e.select("src", "dst", "weight"), "trade")
    return walks.expected(n.select(F.col("src").alias("node")).distinct(), n, 4).select("start", "visited", F.bround("avg_visits", 9).alias("avg_visits"))


@query("sampled_visits")
def _(spark, d):
    v, e = words(spark, d)
    return walks.association(walks.walks(v.select("node"), walks.undirected_arcs(e), 4, 5, 1), 5)


def _space(spark, d, steps=4):
    v, e = words(spark, d)
    return v, e, cut(walks.expected(v.select("node"), walks.undirected_arcs(e), steps), "space")


@query("relevance_uncertainty", NET + """, p AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM arcs),
r(t, a, b, x) AS (SELECT DISTINCT 0, src, src, 1.0::DOUBLE FROM p UNION ALL SELECT t + 1, a, p.dst, sum(x * p) FROM r JOIN p ON p.src = b WHERE t < 2 GROUP BY t + 1, a, p.dst),
sp AS (SELECT a, b, sum(x) AS x FROM r GROUP BY ALL), n AS (SELECT count(*) AS n FROM v),
s AS (SELECT b AS visited, sum(x) AS r, sqrt(greatest(0, sum(x * x) / any_value(n) - (sum(x) / any_value(n)) * (sum(x) / any_value(n)))) AS u FROM sp, n GROUP BY b)
SELECT visited, round_even(r / max(r) OVER (), 8) AS relevance, round_even(u / max(u) OVER (), 6) AS uncertainty FROM s""")
def _(spark, d):
    v, e = words(spark, d)
    m = walks.moments(v, cut(walks.undirected_arcs(e), "arcs"), 2)
    return describe.scaled_relevance(m, v.count()).select("visited", F.bround("relevance", 8).alias("relevance"), r6("uncertainty").alias("uncertainty"))


def _bands(v):
    return v.select("node", (F.col("idx") % 4).cast("int").alias("cluster"))


@query("modularity", NET + """, c AS (SELECT node, idx % 4 AS k FROM v), m AS (SELECT sum(weight) AS m FROM u),
i AS (SELECT x.k AS k, sum(weight) AS w FROM u JOIN c x ON x.node = a JOIN c y ON y.node = b WHERE x.k = y.k GROUP BY x.k),
dg AS (SELECT k, sum(weight) AS d FROM (SELECT a AS node, weight FROM u UNION ALL SELECT b, weight FROM u) JOIN c USING (node) GROUP BY k)
SELECT round_even(sum(coalesce(w, 0) / m - (d / (2 * m)) * (d / (2 * m))), 9) AS modularity FROM dg LEFT JOIN i USING (k), m""")
def _(spark, d):
    v, e = words(spark, d)
    return community.modularity(e, _bands(v)).select(F.bround("modularity", 9).alias("modularity"))


@query("greedy_modularity")
def _(spark, d):
    return community.greedy(*words(spark, d))


@query("fluid_communities")
def _(spark, d):
    n, e = _largest(spark, d)
    return community.fluid(n, e, 4, 1, 20)


@query("clustered_space")
def _(spark, d):
    v, e = words(spark, d)
    return community.clustered_walks(v, cut(walks.undirected_arcs(e), "arcs"), 2, 4, 1)


@query("principal_coordinates")
def _(spark, d):
    v, e = words(spark, d)
    return community.principal_walks(v, cut(walks.undirected_arcs(e), "arcs"), 2, 2)


@query("cluster_relevance", "WITH r AS (SELECT p_size % 4 AS cluster, p_retailprice / max(p_retailprice) OVER () AS r FROM part) SELECT cluster, count(*) AS nodes, round_even(avg(r), 9) AS mean_relevance, round_even(stddev_pop(r), 9) AS std_relevance, CAST(sum(CASE WHEN r > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS relevant, round_even(avg(CASE WHEN r > 0.5 THEN 1.0 ELSE 0.0 END), 9) AS relevant_share FROM r GROUP BY cluster")
def _(spark, d):
    p = table(spark, d, "part")
    r = max_normalised(p.select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("relevance")), "relevance")
    out = describe.cluster_relevance(r, p.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 4).alias("cluster")))
    return out.select("cluster", "nodes", *[F.bround(c, 9).alias(c) for c in ("mean_relevance", "std_relevance")], "relevant", F.bround("relevant_share", 9).alias("relevant_share"))


# --- lexical relations; words' first letters stand in for a lexicon: the longer a prefix, the deeper the synset


def lexicon(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, lexicon, lemmas, antonyms, hypernyms): a word's synsets are its first three letters and, for words of an even number of letters, its first two; shorter prefixes are their ancestors."""
    v, e = words(spark, sf_dir)
    known = v.where("node not like '%e'")
    lex = known.select(F.col("node").alias("word"), F.substring("node", 1, 3).alias("synset")).union(known.where("length(node) % 2 = 0").select("node", F.substring("node", 1, 2))).distinct().withColumn("min_depth", F.length("synset"))
    lemmas = lex.select("synset", F.substring("word", 1, 4).alias("lemma")).distinct()
    anti = lemmas.select("lemma", F.reverse("lemma").alias("antonym")).distinct()
    above = lex.select("synset").distinct().where("length(synset) > 1").withColumn("n", F.explode(F.sequence(F.lit(1), F.length("synset") - 1)))
    hyper = above.select("synset", F.expr("substring(synset, 1, n)").alias("parent"), (F.length("synset") - F.col("n")).alias("hops"))
    return v, e, lex, lemmas, anti, hyper


_LEX = NET + """, lex AS MATERIALIZED (SELECT word, syn, length(syn) AS depth FROM (SELECT node AS word, substr(node, 1, 3) AS syn FROM v WHERE node NOT LIKE '%e' UNION SELECT node, substr(node, 1, 2) FROM v WHERE node NOT LIKE '%e' AND length(node) % 2 = 0)),
lem AS (SELECT DISTINCT syn, substr(word, 1, 4) AS lemma FROM lex), wl AS MATERIALIZED (SELECT DISTINCT word, lemma FROM lex JOIN lem USING (syn)),
anc AS (SELECT DISTINCT syn, substr(syn, 1, i) AS a, length(syn) - i AS hops FROM lex, range(1, 4) t(i) WHERE i <= length(syn)), dep AS (SELECT syn AS a, min(depth) AS depth FROM lex GROUP BY syn),
k AS (SELECT src, dst, weight, src IN (SELECT word FROM lex) AND dst IN (SELECT word FROM lex) AS known FROM e),
sy AS MATERIALIZED (SELECT DISTINCT x.word AS src, y.word AS dst FROM wl x JOIN wl y ON x.lemma = y.lemma), an AS MATERIALIZED (SELECT DISTINCT x.word AS src, y.word AS dst FROM wl x JOIN wl y ON reverse(x.lemma) = y.lemma),
sim AS MATERIALIZED (SELECT k.src, k.dst, max(1 / (1.0::DOUBLE + x.hops + y.hops)) AS path, max(2.0::DOUBLE * (coalesce(dep.depth, 0) + 1) / (2 * (coalesce(dep.depth, 0) + 1) + x.hops + y.hops)) AS wup
  FROM k JOIN lex s ON s.word = k.src JOIN anc x ON x.syn = s.syn JOIN lex t ON t.word = k.dst JOIN anc y ON y.syn = t.syn AND y.a = x.a LEFT JOIN dep ON dep.a = x.a GROUP BY k.src, k.dst),
f AS MATERIALIZED (SELECT k.src, k.dst, k.weight, CASE WHEN known THEN CAST((k.src, k.dst) IN (SELECT (src, dst) FROM sy) AS INT) END AS synonyms, CASE WHEN known THEN CAST((k.src, k.dst) IN (SELECT (src, dst) FROM an) AS INT) END AS antonyms,
  CASE WHEN known THEN round_even(coalesce(path, 0), 3) END AS path_similarity, CASE WHEN known THEN round_even(coalesce(wup, 0), 3) END AS wup_similarity, CASE WHEN known THEN levenshtein(k.src, k.dst) END AS edit_distance FROM k LEFT JOIN sim ON sim.src = k.src AND sim.dst = k.dst),
dp AS (SELECT node, min(depth) AS depth FROM v LEFT JOIN lex ON word = node GROUP BY node)
"""
_ATTRIBUTES = ("path_similarity", "wup_similarity", "synonyms", "antonyms", "edit_distance")


@query("lexical_enrichment", _LEX + "SELECT src, dst, weight, coalesce(synonyms, -1) AS synonyms, coalesce(antonyms, -1) AS antonyms, CAST(coalesce(path_similarity, -1) AS DOUBLE) AS path_similarity, CAST(coalesce(wup_similarity, -1) AS DOUBLE) AS wup_similarity, CAST(coalesce(edit_distance, -1) AS INT) AS edit_distance FROM f")
def _(spark, d):
    return lexical.with_marks(lexical.enriched(*lexicon(spark, d))[1]).select("src", "dst", "weight", "synonyms", "antonyms", "path_similarity", "wup_similarity", "edit_distance")


@query("node_depths", _LEX + "SELECT idx, node, CAST(coalesce(depth, -1) AS INT) AS depth FROM v JOIN dp USING (node)")
def _(spark, d):
    v, e, lex, *_ = lexicon(spark, d)
    return lexical.depths(v, lex).select("idx", "node", F.coalesce("depth", F.lit(-1)).alias("depth"))


def _moments(name: str) -> str:
    mean = f"(SELECT sum({name} * weight) / sum(weight) FROM f WHERE {name} IS NOT NULL)"
    return f"SELECT '{name}_avg' AS metric, {mean} AS value UNION ALL SELECT '{name}_std', sqrt(sum(weight * pow({name} - {mean}, 2)) / sum(weight)) FROM f WHERE {name} IS NOT NULL"


@query("lexical_descriptors", _LEX + "SELECT metric, round_even(CAST(coalesce(value, -1) AS DOUBLE), 6) AS value FROM (" + " UNION ALL ".join([*(f"SELECT 'depth_{n}' AS metric, {f}(depth)::DOUBLE AS value FROM dp" for n, f in (("max", "max"), ("min", "min"), ("mean", "avg"), ("std", "stddev_pop"))), *map(_moments, _ATTRIBUTES)]) + ")")
def _(spark, d):
    return describe.lexical(*lexical.enriched(*lexicon(spark, d))).select("metric", r6("value").alias("value"))


_PARTS = {f"{n}_{w}": x for n, c in (("path", "path_similarity"), ("wup", "wup_similarity")) for w, x in (("max", f"max({c})"), ("avg", f"sum({c} * weight) / sum(weight) FILTER ({c} IS NOT NULL)"), ("std", f"sqrt(sum(weight * pow({c} - m_{c}, 2)) / sum(weight) FILTER ({c} IS NOT NULL))"))}
_PARTS |= {f"{n}_{w}": x for n, c in (("synonym", "synonyms"), ("antonym", "antonyms")) for w, x in (("mean", f"avg({c})"), ("max", f"max({c})"), ("avg", f"sum({c} * weight) / sum(weight) FILTER ({c} IS NOT NULL)"))}
_PARTS["edit_avg"] = "sum(edit_distance * weight) / sum(weight) FILTER (edit_distance IS NOT NULL)"
_MEANS = ", ".join(f"sum({c} * weight) FILTER ({c} IS NOT NULL) OVER w / sum(weight) FILTER ({c} IS NOT NULL) OVER w AS m_{c}" for c in ("path_similarity", "wup_similarity"))
_NODES = f""", fm AS (SELECT *, {_MEANS} FROM f WINDOW w AS (PARTITION BY src)), bundle AS MATERIALIZED (SELECT v.node AS node, {', '.join(f'coalesce(CAST(any_value(b.{k}) AS DOUBLE), -1) AS {k}' for k in _PARTS)} FROM v LEFT JOIN (SELECT src AS node, {', '.join(f'{x} AS {k}' for k, x in _PARTS.items())} FROM fm GROUP BY src) b USING (node) GROUP BY v.node)
"""


@query("node_lexical_bundle", _LEX + _NODES + "SELECT node, " + ", ".join(f"round_even({k}, 6) AS {k}" for k in _PARTS) + " FROM bundle")
def _(spark, d):
    n = describe.node_lexical(*lexical.enriched(*lexicon(spark, d)))
    return n.select("node", *[r6(k).alias(k) for k in _PARTS])


def _best(neighbours: bool) -> str:
    """The five subgraphs of the eight nodes with the largest values each, ties by name."""
    out = []
    for name in ("path", "wup", "antonym", "synonym", "edit"):
        top = f"(SELECT node FROM bundle ORDER BY round_even({name}_avg, 9) DESC, node LIMIT 8)"
        keep = f"(SELECT node FROM {top} UNION SELECT src FROM f WHERE src IN {top} UNION SELECT dst FROM f WHERE src IN {top})" if neighbours else top
        out.append(f"SELECT '{name}' AS subgraph, src, dst, weight FROM f WHERE src IN {keep} AND dst IN {keep}")
    return " UNION ALL ".join(out)


@query("restricted_networks", _LEX + _NODES + _best(False))
def _(spark, d):
    return describe.restricted(*lexical.enriched(*lexicon(spark, d)), 8).select("subgraph", "src", "dst", "weight")


@query("restricted_networks_with_neighbours", _LEX + _NODES + _best(True))
def _(spark, d):
    return describe.restricted(*lexical.enriched(*lexicon(spark, d)), 8, True).select("subgraph", "src", "dst", "weight")


_REPORT = {c: f"coalesce(max(m_{c}), -1) AS {c}_avg, coalesce(sqrt(sum(weight * pow({c} - m_{c}, 2)) / sum(weight) FILTER ({c} IS NOT NULL)), -1) AS {c}_std" for c in ("path_similarity", "edit_distance")}


@query("cluster_report", _LEX + f""", c AS MATERIALIZED (SELECT node, CAST(idx % 4 AS INT) AS cluster, idx % 3 AS tag FROM v), g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node), r AS (SELECT node, n / max(n) OVER () AS r FROM g),
rel AS (SELECT cluster, count(*) AS nodes, avg(r) AS mean_relevance, stddev_pop(r) AS std_relevance, CAST(sum(CASE WHEN r > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS relevant, avg(CASE WHEN r > 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS relevant_share FROM c JOIN r USING (node) GROUP BY cluster),
ins AS (SELECT x.cluster AS cluster, count(*) AS edges_inside, avg(weight) AS avg_weight FROM f JOIN c x ON x.node = src JOIN c y ON y.node = dst WHERE x.cluster = y.cluster GROUP BY x.cluster),
out_ AS (SELECT x.cluster AS cluster, f.*, {', '.join(f'sum({c} * weight) FILTER ({c} IS NOT NULL) OVER w / sum(weight) FILTER ({c} IS NOT NULL) OVER w AS m_{c}' for c in _REPORT)} FROM f JOIN c x ON x.node = src JOIN c y ON y.node = dst WHERE x.cluster <> y.cluster WINDOW w AS (PARTITION BY x.cluster)),
bnd AS (SELECT cluster, count(*) AS boundary, {', '.join(_REPORT.values())} FROM out_ GROUP BY cluster),
tgs AS (SELECT cluster, string_agg(tag || ': ' || CAST(round_even(n / t, 2) AS VARCHAR), ', ' ORDER BY n DESC, tag DESC) AS tags FROM (SELECT cluster, tag, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster) AS t FROM c GROUP BY cluster, tag) GROUP BY cluster)
SELECT cluster, nodes, round_even(mean_relevance, 6) AS mean_relevance, round_even(std_relevance, 6) AS std_relevance, relevant, round_even(relevant_share, 6) AS relevant_share, edges_inside, round_even(avg_weight, 6) AS avg_weight, boundary,
  {', '.join(f'round_even({c}_{w}, 6) AS {c}_{w}' for c in _REPORT for w in ('avg', 'std'))}, tags FROM rel LEFT JOIN ins USING (cluster) LEFT JOIN bnd USING (cluster) LEFT JOIN tgs USING (cluster)""")
def _(spark, d):
    v, e = lexical.enriched(*lexicon(spark, d))
    e = cut(e, "enriched")
    r = max_normalised(network.degrees(e).withColumnRenamed("degree", "relevance"), "relevance")
    got = describe.cluster_report(e, _bands(v), r, v.select("node", (F.col("idx") % 3).alias("tag")))
    return got.withColumns({c: r6(c) for c, t in got.dtypes if t == "double"})


# --- files, caches and texts, written to the shared folder and read back


def _written(lines: DataFrame, name: str) -> str:
    """lines (at, value) as one text file in the shared folder: its path."""
    at = f"{shared_folder(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lines.orderBy("at").coalesce(1).select("value").write.text(at)
    return at


def _pajek(spark, d):
    v, e = trade(spark, d)
    e = network.relabelled(e, v).select((F.lit(1000) + F.col("src") * 100 + F.col("dst")).alias("at"), F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, "weight").alias("value"))
    marks = spark.createDataFrame([(-1, "% nations"), (0, "*Vertices 25"), (999, "*Arcs")], "at long, value string")
    names = v.select((F.col("idx") + 1).alias("at"), F.format_string('%d "%s"', F.col("idx") + 1, "node").alias("value"))
    return graph_files.pajek(spark, _written(marks.unionByName(names).unionByName(e.select(F.col("at").cast("long").alias("at"), "value")), "pajek"))


@query("pajek_vertices", "SELECT CAST(n_nationkey AS BIGINT) AS idx, n_name AS node FROM nation")
def _(spark, d):
    return _pajek(spark, d)[0]


@query("pajek_edges", _TRADE + "SELECT src, dst, 0 AS key, weight FROM e")
def _(spark, d):
    return _pajek(spark, d)[1].select("src", "dst", "key", "weight")


@query("without_artefacts", _TRADE + "SELECT src, dst, weight FROM e")
def _(spark, d):
    """A header among the nodes goes, with the arcs of it."""
    v, e = trade(spark, d)
    bad = spark.createDataFrame([(98, "*Arcs"), (99, ":2")], "idx long, node string")
    more = e.unionByName(e.limit(3).withColumn("src", F.lit("*Arcs"))).unionByName(e.limit(2).withColumn("dst", F.lit(":2")))
    return graph_files.without_artefacts(v.unionByName(bad), more)[1].select("src", "dst", "weight")


def _tags(spark, d):
    tags = table(spark, d, "part").select(F.col("p_partkey").alias("at"), (F.col("p_size") % 10).cast("string").alias("value"))
    heads = spark.createDataFrame([(-3, "% parts"), (-2, "% by size"), (-1, "*vertices")], "at long, value string")
    return graph_files.partition(spark, _written(heads.unionByName(tags), "partition"))


_TAGS = "WITH g AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, CAST(p_size % 10 AS TINYINT) AS tag FROM part)"


@query("partition_tags", _TAGS + " SELECT * FROM g")
def _(spark, d):
    return _tags(spark, d)


@query("first_tags", _TAGS + " SELECT * FROM g WHERE idx < 1000")
def _(spark, d):
    """The slice by place that goes with a network of fewer nodes: its limit is the feature."""
    return network.sliced(_tags(spark, d), 1000)


@query("tag_text", _TAGS + ", n AS (SELECT tag, count(*) AS n, (SELECT count(*) FROM g) AS t FROM g GROUP BY tag) SELECT string_agg((['None', 'N', 'V', 'AJ', 'AD', 'P', 'PP', 'I', 'C', 'A'])[tag + 1] || ': ' || CAST(round_even(n / t, 2) AS VARCHAR), ', ' ORDER BY tag) AS text FROM n")
def _(spark, d):
    return describe.tag_text(_tags(spark, d), graph_files.TAGS)


@query("array_points", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part")
def _(spark, d):
    rows = table(spark, d, "part").orderBy("p_partkey").select(F.col("p_size").cast("double"), "p_retailprice").toPandas().to_numpy()  # a fixture: an array file is one writer's
    at = f"{shared_folder(spark)}/points-{uuid.uuid4().hex}.npy"
    held = io.BytesIO()
    np.save(held, rows)
    fs, path = pafs.FileSystem.from_uri(at if ":" in at else f"file://{at}")
    with fs.open_output_stream(path) as f:
        f.write(held.getvalue())
    return graph_files.arrays(spark, at).select("id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))


@query("graph_edges", "SELECT CAST(user_id AS VARCHAR) AS src, event_type AS dst, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS INT) AS key, value AS weight FROM events")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"), F.col("value").alias("weight"), F.col("event_id").alias("ord"))
    return graph_files.graph(e)[1].select("src", "dst", "key", "weight")


@query("graph_vertices", "SELECT row_number() OVER (ORDER BY node) - 1 AS idx, node FROM (SELECT CAST(user_id AS VARCHAR) AS node FROM events UNION SELECT event_type FROM events)")
def _(spark, d):
    return graph_files.graph(table(spark, d, "events").select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"), F.col("value").alias("weight")))[0]


@query("labels_of_communities", "SELECT n_name AS node, n_regionkey AS cluster FROM nation")
def _(spark, d):
    return network.labels(table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("cluster")).agg(F.collect_list("n_name").alias("members")))  # a region's nations


@query("cached_degrees", NET + "SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def _(spark, d):
    """Computed once, read twice; another network is another key."""
    e = words(spark, d)[1]
    first = cached("degrees", [e], {"by": "edges"}, lambda: network.degrees(e))
    other = cached("degrees", [e.where("weight > 1e9")], {"by": "edges"}, lambda: network.degrees(e.where("weight > 1e9")))
    again = cached("degrees", [e], {"by": "edges"}, lambda: first.limit(0))
    return again.join(other.select("node"), "node", "left_anti")


@query("descriptors_text", NET + "SELECT 'nodes' AS metric, CAST((SELECT count(*) FROM v) AS DOUBLE) AS value UNION ALL SELECT 'edges', CAST((SELECT count(*) FROM e) AS DOUBLE)")
def _(spark, d):
    c = network.counts(*words(spark, d))
    at = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    graph_files.descriptors_text(c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in ("nodes", "edges")])).alias("m")).select("m.*"), at)
    return spark.read.text(at).select(F.from_json("value", "metric string, value double").alias("m")).select("m.*")


@query("printed_counts", NET + "SELECT 'network:' || chr(10) || '  nodes:' || chr(10) || '    ' || (SELECT count(*) FROM v) || chr(10) || '  edges:' || chr(10) || '    ' || (SELECT count(*) FROM e) AS text")
def _(spark, d):
    r = network.counts(*words(spark, d)).first()
    return spark.createDataFrame([(graph_files.pretty({"network": {"nodes": r.nodes, "edges": r.edges}}),)], "text string")


@query("float_floor_division", "SELECT l_orderkey, l_linenumber, CAST(round((l_extendedprice - (l_extendedprice % 0.1)) / 0.1) AS BIGINT) AS q FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", floor_div(F.col("l_extendedprice"), F.lit(0.1).cast("double")).cast("long").alias("q"))
