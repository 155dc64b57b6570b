"""Graph and vector files: Pajek networks, partition lists, array files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.columns import ordinal


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line) of a text file: its lines and their numbers. The file is read in splits, whose first bytes put them in order."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"))
    return ordinal(rows, "_split", "_row", name="at").select("at", "line")


def pajek(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices (idx, node), edges (src, dst, key, ord, weight)) of a Pajek file.

    Sections start with a star. Vertices are `number "label"`; arcs and edges `from to weight`, weight 1 if absent; an edge
    is an arc each way. Parallel arcs are numbered by key in file order.
    """
    lines = _lines(spark, path).withColumn("line", F.trim("line")).where("line <> '' and not startswith(line, '%')")
    # the section of a line: the last star line before it; a file has a few, so their places travel as an array
    marks = lines.where("startswith(line, '*')").select("at", F.lower(F.regexp_extract("line", r"^\*\s*(\w+)", 1)).alias("kind"))
    marks = marks.agg(F.array_sort(F.collect_list(F.struct("at", "kind"))).alias("marks"))
    body = lines.where("not startswith(line, '*')").crossJoin(F.broadcast(marks))  # one row of section starts
    body = body.select("at", "line", F.element_at(F.filter("marks", lambda m: m["at"] < F.col("at")), -1)["kind"].alias("kind"))
    label = F.regexp_extract("line", r'^\d+\s+(?:"([^"]*)"|(\S+))', 1)
    bare = F.regexp_extract("line", r"^\d+\s+(\S+)", 1)
    vertices = body.where("kind = 'vertices'").select((F.regexp_extract("line", r"^(\d+)", 1).try_cast("long") - 1).alias("idx"), F.when(label != "", label).when(bare.startswith('"'), "").otherwise(bare).alias("node"))
    fields = F.split("line", r"\s+")
    arcs = body.where("kind in ('arcs', 'edges')").select("at", "kind", (F.try_element_at(fields, F.lit(1)).try_cast("long") - 1).alias("s"), (F.try_element_at(fields, F.lit(2)).try_cast("long") - 1).alias("d"), F.coalesce(F.try_element_at(fields, F.lit(3)).try_cast("double"), F.lit(1.0)).alias("weight"))
    both = arcs.select((2 * F.col("at")).alias("ord"), "s", "d", "weight").unionByName(arcs.where("kind = 'edges' and s <> d").select((2 * F.col("at") + 1).alias("ord"), F.col("d").alias("s"), F.col("s").alias("d"), "weight"))
    named = both.join(vertices.select(F.col("idx").alias("s"), F.col("node").alias("src")), "s").join(vertices.select(F.col("idx").alias("d"), F.col("node").alias("dst")), "d")
    return vertices, keyed(named.select("src", "dst", "ord", "weight"))


def keyed(edges: DataFrame) -> DataFrame:
    """edges (src, dst, ord, weight) with key, the number of parallel ones before."""
    from pyspark.sql import Window as W

    return edges.withColumn("key", (F.row_number().over(W.partitionBy("src", "dst").orderBy("ord")) - 1).cast("int")).select("src", "dst", "key", "ord", "weight")


def without_artefacts(vertices: DataFrame, edges: DataFrame, marker: str = "*Arcs", other: str = ":2") -> tuple[DataFrame, DataFrame]:
    """The graph without nodes that a lenient parser makes of a section header, where the header is among the nodes."""
    if vertices.where(F.col("node") == marker).isEmpty():
        return vertices, edges
    bad = [marker, other]
    return vertices.where(~F.col("node").isin(bad)), edges.where(~F.col("src").isin(bad) & ~F.col("dst").isin(bad))


def graph(edges: DataFrame, vertices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) from a table (src, dst, weight): missing weights are 1, vertices in code point order unless given."""
    rows = edges.select("src", "dst", (F.col("weight") if "weight" in edges.columns else F.lit(1.0)).cast("double").alias("weight"))
    if vertices is None:
        nodes = rows.select(F.col("src").alias("node")).union(rows.select("dst")).distinct()
        vertices = ordinal(nodes, "node").select("idx", "node")
    return vertices, keyed(rows.withColumn("ord", F.xxhash64("src", "dst", "weight"))) if "ord" not in edges.columns else keyed(edges.select("src", "dst", "ord", F.col("weight").cast("double").alias("weight")))


def partition(spark: SparkSession, path: str) -> DataFrame:
    """(idx, tag) of a partition list: leading lines that start with % or * are left out, then a whole number a line."""
    lines = _lines(spark, path).withColumn("line", F.trim("line")).where("line <> ''")
    first = lines.where("not (startswith(line, '%') or startswith(line, '*'))").agg(F.min("at").alias("first"))
    body = lines.crossJoin(F.broadcast(first)).where("at >= first")  # one row
    # places are line numbers less the empty lines before: none is in the middle of such a file
    return body.select((F.col("at") - F.col("first")).cast("long").alias("idx"), F.col("line").try_cast("tinyint").alias("tag"))


#: The tags of a partition of words by part of speech (fixed values).
TAGS = {0: "None", 1: "N", 2: "V", 3: "AJ", 4: "AD", 5: "P", 6: "PP", 7: "I", 8: "C", 9: "A"}


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """(id, features) of a two-dimensional array file, one row of points each. One file is one task's."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                x = np.atleast_2d(np.load(io.BytesIO(data.as_py()), allow_pickle=False)).astype(float)
                for i in range(0, len(x), 4096):
                    part = x[i : i + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array(list(part), pa.list_(pa.float64()))], ["id", "features"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(f, "id long, features array<double>")


def descriptors_text(rows: DataFrame, path: str) -> None:
    """Text sink of descriptor rows: one JSON line each."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def pretty(value: object, indent: int = 0) -> str:
    """Nested dicts as indented lines."""
    if not isinstance(value, dict):
        return "  " * indent + str(value)
    return "\n".join("  " * indent + str(k) + ":\n" + pretty(v, indent + 1) for k, v in value.items())
