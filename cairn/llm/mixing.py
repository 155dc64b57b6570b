"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source whose target is r times its size takes r copies: floor(r) for sure, the rest is a fraction to be
rounded. The pivotal method pairs two fractional documents and moves words from one to the other, at random and without
bias, until one of them has a whole number of copies; the other goes on to the next pairing. Words are conserved in each
pairing, so a source misses its target by less than its last document.

Distribution: every source is dealt by a hash of doc_id into buckets of about BUCKET rows, whatever the source's share
of the table; each bucket leaves at most one fractional document, and those meet in the buckets of the next level of a
reduction tree, until each source has one left, which is rounded alone.

Defined cases: a null text has size 0; documents of size 0 take nothing; a null source is a source of its own, the last;
repeated rows are documents of their own; a null doc_id is hashed like any other value. Draws depend only on the seed,
the bucket and the documents in it, so reruns and other partitionings agree.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, cut, table, unused

WEIGHTS, SHARE, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 20240917
#: Rows that one task rounds in sequence.
BUCKET = 16384


def sizes(docs: DataFrame) -> DataFrame:
    """docs with size: words of the whole text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, rank, rows, source_size, target): weights go round the sources in code point order, null last.

    The mix has share times all words. Sources above most times their size stop there, and the excess is dealt again by
    weight until none is above; each round needs two sums only.
    """
    by = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    by = by.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("pid", F.spark_partition_id())
    by = cut(by, "sources")
    # ranks without gathering the sources: rows of the range partitions before, then the place in one's own
    counts = {r.pid: r.n for r in by.groupBy("pid").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for pid in sorted(counts):
        before[pid], total = total, total + counts[pid]
    if not before:
        return by.select("source", F.lit(0).alias("rank"), "rows", "source_size", F.lit(0.0).alias("target"))
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("pid")]
    by = by.withColumn("rank", (offset + F.row_number().over(W.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    by = by.withColumn("weight", F.array(*map(F.lit, weights))[F.pmod("rank", F.lit(len(weights)))]).withColumn("full", most * F.col("source_size"))
    by = cut(by.select("source", "rank", "rows", "source_size", "weight", "full"), "sources")
    words = by.agg(F.sum("source_size")).first()[0]
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * level > F.col("full")
        now = by.agg(F.coalesce(F.sum(F.when(over, F.col("full"))), F.lit(0.0)).alias("stopped"), F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free")).first()
        if now.n == capped or not now.free:
            break
        capped, level = now.n, (share * words - now.stopped) / now.free
    return by.select("source", "rank", "rows", "source_size", F.least(F.col("weight") * level, F.col("full")).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounded fractions, and the index of the one left fractional (-1: none). Words, p times size, are conserved."""
    out, draws, held = p.tolist(), rng.random(len(p)), -1
    s = size.tolist()
    for j in range(len(out)):
        if not 1e-12 < out[j] < 1 - 1e-12:
            out[j] = float(round(out[j]))
            continue
        if held < 0:
            held = j
            continue
        i = held
        up, down = min((1 - out[i]) * s[i], out[j] * s[j]), min(out[i] * s[i], (1 - out[j]) * s[j])
        move = up if draws[j] < down / (up + down) else -down
        out[i] += move / s[i]
        out[j] -= move / s[j]
        left = [k for k in (i, j) if 1e-9 < out[k] < 1 - 1e-9]
        for k in (i, j):
            if k not in left:
                out[k] = float(round(out[k]))
        held = left[0] if left else -1
    return np.array(out), held


def rounded(seed: int, level: int, last: bool):
    """A grouped map: one bucket's documents with their copies; whole, or still open for the next level."""

    def f(t: pa.Table) -> pa.Table:
        rank, bucket = t["rank"][0].as_py(), t["bucket"][0].as_py()
        ids = t["order"].to_numpy()
        size, p = t["size"].to_numpy(), t["p"].to_numpy()
        at = np.lexsort((p, size, ids))
        rng = np.random.Generator(np.random.Philox([seed & 0xFFFFFFFF, rank * 64 + level * 2, bucket]))
        got, held = pivot(p[at], size[at], rng)
        if held >= 0 and last:
            got[held] = float(rng.random() < got[held])
            held = -1
        still = np.zeros(len(at), bool)
        if held >= 0:
            still[held] = True
        t = t.take(pa.array(at))
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(got)).set_column(t.schema.get_field_index("open"), "open", pa.array(still))

    return f


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, bucket: int = BUCKET, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, size, source_size, target, copies and taken (copies times size) of every row of docs (text, source and keep). Measures whose name keep has get underscores before it."""
    named = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], "source", "text", F.xxhash64(*keep, F.lit(seed)).alias("order"), F.monotonically_increasing_id().alias("row"))
    sized = sizes(named).drop("text")
    sized = cut(sized, "sizes")  # row numbers hold from here on; only they, sources and sizes go through the tree
    by = targets(sized, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    # sources are far fewer than documents, but not bounded: Spark picks the join, and AQE splits a hot source
    rows = sized.select("row", "order", "source", "size").join(by.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    rows = rows.withColumn("ratio", F.when(F.col("size") > 0, ratio).otherwise(0.0)).withColumn("base", F.floor(F.col("ratio") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("base")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("order", F.lit(1)), F.ceil(F.col("rows") / bucket)).cast("long")).withColumn("open", F.lit(False))
    rows = rows.select("row", "size", "source_size", "target", "rank", "rows", "base", "p", "order", "bucket", "open")
    whole = F.col("p") <= 1e-12
    largest = by.agg(F.max("rows")).first()[0] or 0
    done, level, left = [rows.where(whole)], 0, -(-largest // bucket)
    rows = rows.where(~whole)
    while True:
        got = rows.groupBy("rank", "bucket").applyInArrow(rounded(seed, level, left <= 1), rows.schema)
        got = cut(got, "rounded")
        done.append(got.where("not open"))
        if left <= 1:
            break
        left, level = -(-left // bucket), level + 1
        rows = got.where("open").withColumn("bucket", F.floor(F.col("bucket") / bucket).cast("long")).withColumn("open", F.lit(False))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("base") + F.round("p")).cast("long")
    out = out.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return sized.select("row", *[f"k_{c}" for c in keep]).join(out, "row").select(*[F.col(f"k_{c}").alias(c) for c in keep], *[F.col(c).alias(unused(c, list(keep))) for c in ("size", "source_size", "target", "copies", "taken")])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the words that the mix takes of it."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
