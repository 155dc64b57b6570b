"""What the operators share: table access, scratch tables in the shared folder, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python's bytes.split() splits at exactly these bytes: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z (no other letter) in lower case; a null text is empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER)


_HERE: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of this machine only where it is unset and Spark runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _HERE:
            _HERE[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="cairn-")
        at = _HERE[context.applicationId]
    return at.rstrip("/")


def placed(spark: SparkSession, name: str, keep: bool = False, outer: bool = False) -> str:
    """A new path in the shared folder. Within scratch(), removed at its end unless keep is set, or at the end of the scratch() around that one if outer is."""
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES[:-1] if outer else _SCOPES
    if scopes and not keep:
        scopes[-1].append(at)
    return at


def cut(df: DataFrame, name: str = "cut", compression: str = "snappy", keep: bool = False, outer: bool = False) -> DataFrame:
    """Written to a placed() path and read back: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    at = placed(spark, name, keep, outer)
    df.write.option("compression", compression).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def dropped(spark: SparkSession, at: str) -> None:
    """Removes what lies at a path, if anything does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what cut() wrote within: results that read those tables must have been written or collected by then."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for at in made:
            dropped(spark, at)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a folder or file in the shared folder, for tasks that stream files themselves.

    Local paths and file:, s3:, s3a:, s3n:, gs:, abfs: and hdfs: work where pyarrow has the store; dbfs: by its mount.
    """
    for known, own in (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "/dbfs/")):
        if uri.startswith(known):
            uri = own + uri[len(known) :].lstrip("/" if known == "dbfs:/" else "")
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:/") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def shards(spark: SparkSession) -> int:
    """Shuffle partitions, which the user sets by the size of the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about most bytes in a column of texts, or one longer text. Spark bounds a batch's bytes itself; this bounds what is made of it in Python, whatever the session's number of rows a batch."""
    for b in batches:
        if b.num_rows:
            size = pc.fill_null(pc.binary_length(b.columns[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
            edge = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows], strict=True):
                yield b.slice(i, j - i)


def release() -> None:
    """Returns a process's freed memory to the system, where the C library can: a worker's before its next task, the driver's after a fit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of queries that nothing refers to any more: it does so when the driver's memory is collected.

    Twice: what the first collection releases on its way through Spark's cleaner still refers to shuffles.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b), for every node that has an edge.

    Alternates large-star and small-star steps: each node's neighbours link to the least node among them, so that a
    component becomes a star in a logarithmic number of rounds. Every step is an aggregation with map-side combining
    and a join; no adjacency list is gathered in one row.
    """
    e = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v and u is not null and v is not null").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u links down to smaller neighbours only
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0)).alias("h")).first()
        if state == (now.n, now.h):
            break
        state = (now.n, now.h)
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
