"""The corpus pipeline: quality filter, near-copy removal, decontamination, secret redaction, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read back as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontamination, jaccard_join, mixing, quality_classifier, secret_scans
from cairn.llm.common import cut, scratch, table, unused

#: Near copies share words in shingles of five with a similarity of 0.8 or more.
SHINGLE, SIMILAR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity and marks of toxic texts are within their language's limits."""
    return quality_classifier.filtered(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id. Rows without a doc_id stay; rows that share one are one document, and go or stay together."""
    return jaccard_join.representatives(docs, size=SHINGLE, per_cent=SIMILAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the kind of each secret in its place."""
    return secret_scans.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, numbered from 1 in copy, with its size."""
    taken = mixing.mix(docs, keep=tuple(docs.columns))
    many, copy = unused("copies", docs.columns), unused("copy", docs.columns)
    copies = taken.where(F.col(many) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many).cast("int"))))
    return copies.select(*docs.columns, copy, *[unused(c, docs.columns) for c in ("size", "source_size", "target")])


STAGES = [("quality_classifier", quality), ("jaccard_join", near_copies), ("decontamination", decontaminate), ("secret_scans", redact), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder and read back; what a stage wrote besides is removed then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = cut(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A model's perplexities and random rounding are beyond SQL.
ORACLE_SQL = None
