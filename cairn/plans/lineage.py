"""Cutting lineage: results of iterations are written to the session's shared folder and read back."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_HERE: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and Spark runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context = spark.sparkContext.applicationId
        if context not in _HERE:
            _HERE[context] = "file://" + tempfile.mkdtemp(prefix="cairn-")
        at = _HERE[context]
    return at.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, written once and read from there on; survives the loss of executors. Within scratch(), removed at its end."""
    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    if _SCOPES:
        _SCOPES[-1].append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


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
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fingerprint(df: DataFrame) -> str:
    """A key of a table's rows, whatever their order or partitioning."""
    row = F.xxhash64(*df.columns)
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.shiftright(row, 24)), F.lit(0)).alias("a"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("b")).first()
    return f"{got.n}-{got.a}-{got.b}"


def cached(name: str, inputs: list[DataFrame], params: dict, compute) -> DataFrame:
    """compute()'s result, kept in the shared folder under its inputs' rows and parameters: another graph never gets it."""
    spark = inputs[0].sparkSession
    key = hashlib.sha256(json.dumps([name, params, *(fingerprint(x) for x in inputs)], sort_keys=True).encode()).hexdigest()[:24]
    at = f"{shared_folder(spark)}/cache-{name}-{key}"
    try:
        spark.read.parquet(f"{at}/done")  # written last: a result without it is a failed attempt's
    except AnalysisException:
        compute().write.mode("overwrite").parquet(f"{at}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{at}/done")
    return spark.read.parquet(f"{at}/rows")
