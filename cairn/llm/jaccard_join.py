"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

A document is its set of distinct word shingles. Two sets of similarity t or more share one of their first n - ceil(t n) + 1
shingles in any common order. The order is rare first, by a sketch of document frequencies of fixed size (a count for
each of SLOTS hash slots), so that frequent shingles of common passages are outside prefixes; a slot's rarer shingles only
lose their place in the order, no link. Documents with equal sets are one entry.

Groups of a shared prefix shingle may be of any size, so no group's pairs are all emitted. Each group's least edited
member (first in the order of the shingle's position) is its hub: members are paired with the hub only, those pairs are
filtered, made distinct and verified on the texts, and links become components. Pairs within one component need no more
tests. Groups that still hold several components get a next hub, HUB_ROUNDS times, and then every pair left between
different components is tested: no link is lost, and a group of near copies costs about a test for each member.

Memory: one portion of texts a task; joins and windows spill, and AQE splits hot hubs.

Defined cases: a null text or one without words has an empty set and links with nothing; a null doc_id links with nothing
and has a null component; rows that share a doc_id are one node; hashes of 64 bits stand for words and shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LOWER, UPPER, components, cut, lower_bytes, slices, table, tidy, unused
from .hashing import A, B, mixed, shingles

SLOTS, SLICE, FAN_IN, PORTION, HUB_ROUNDS = 1 << 18, 1 << 12, 64, 1 << 20, 3
EMPTY = 0
#: Different sets that a task keeps, to tell equal ones before they are shuffled.
SEEN = 1 << 18


def portions(batches: Iterator[pa.RecordBatch], size: int, most: int = PORTION) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(first columns as lists, sets) of about most bytes of text at a time; the text is the last column."""
    held, texts, n = [], [], 0
    for b in slices(batches, -1):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append(row[:-1])
            texts.append(lower_bytes(row[-1]))
            n += len(texts[-1])
            if n >= most:
                yield held, shingles(texts, size)
                held, texts, n = [], [], 0
    if held:
        yield held, shingles(texts, size)


def fingerprint(s: np.ndarray) -> int:
    """64 bits of a set; 0 for the empty one only."""
    if not len(s):
        return EMPTY
    with np.errstate(over="ignore"):
        x = np.array([s.sum() * A + mixed(s * B).sum() + np.uint64(len(s))], np.uint64)
    return int(mixed(x).view(np.int64)[0]) or 1


def slots(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def surveyed(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """((id, n, f, lead): of every row of docs (id, text), lead the first id with an equal set in its task; (slice, counts): document frequencies by slot)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = np.zeros(SLOTS, np.int64), ["id", "n", "f", "lead", "slice", "task", "counts"]
        first: dict[int, int] = {}
        for held, sets in portions(batches, size):
            for s in sets:
                if len(s):
                    np.add.at(total, slots(s), 1)
            none, prints, lead = pa.nulls(len(held), pa.int32()), [fingerprint(s) for s in sets], []
            for (ident,), x in zip(held, prints, strict=True):
                if ident is not None and x != EMPTY and len(first) < SEEN:
                    first.setdefault(x, ident)
                lead.append(None if ident is None else first.get(x, ident))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.int64()), pa.array(lead, pa.int64()), none, none, pa.nulls(len(held), pa.binary())], names)
        n = SLOTS // SLICE
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 4, pa.array(range(n), pa.int32()), pa.array([task] * n, pa.int32()), pa.array([x.tobytes() for x in total.reshape(n, SLICE)], pa.binary())], names)

    got = cut(docs.mapInArrow(f, "id long, n long, f long, lead long, slice int, task int, counts binary"), "survey")

    def add(t: pa.Table) -> pa.Table:
        x = sum(np.frombuffer(c.as_py(), np.int64) for c in t["counts"])
        return pa.table({"slice": t["slice"].slice(0, 1), "task": pa.array([t["task"][0].as_py() // FAN_IN], pa.int32()), "counts": pa.array([x.tobytes()], pa.binary())})

    sketch = got.where("slice is not null").select("slice", "task", "counts")
    top = (sketch.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        sketch = sketch.groupBy("slice", F.floor(F.col("task") / FAN_IN).alias("g")).applyInArrow(add, "slice int, task int, counts binary")
        if (top := -(-top // FAN_IN)) <= 1:
            break
        sketch = cut(sketch, "sketch")
    return got.where("slice is null").select("id", "n", "f", "lead"), sketch


def prefixes(docs: DataFrame, size: int, per_cent: int, frequency: np.ndarray) -> DataFrame:
    """(h, id, f, n, pos) of the prefix shingles of every set; one id of those with equal sets in a portion."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency.astype(np.int64))  # SLOTS numbers, whatever the data

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value, set()
        for held, sets in portions(batches, size):
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for (ident,), s in zip(held, sets, strict=True):
                if not len(s) or ident is None or (own := fingerprint(s)) in seen:
                    continue
                if len(seen) < SEEN:  # equal sets meet later anyway
                    seen.add(own)
                n = len(s)
                p = n - -(-per_cent * n // 100) + 1
                first = s[np.argsort(often[slots(s)], kind="stable")[:p]]  # s is sorted by hash: ties too are in one order
                for c, x in zip(cols, (first.view(np.int64), np.full(p, ident), np.full(p, own), np.full(p, n), np.arange(p)), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], ["h", "id", "f", "n", "pos"])

    return docs.mapInArrow(f, "h long, id long, f long, n long, pos long")


def possible(a: str, b: str, per_cent: int):
    """Length and positional filter for rows a and b of one shingle, as SQL: false only where it is their first shared one and they can't link."""
    need = f"({per_cent} * ({a}.n + {b}.n) + {99 + per_cent}) div {100 + per_cent}"
    return F.expr(f"100 * least({a}.n, {b}.n) >= {per_cent} * greatest({a}.n, {b}.n) and 1 + least({a}.n - {a}.pos, {b}.n - {b}.pos) - 1 >= {need}")


def suffix_may(x: np.ndarray, y: np.ndarray, need: int, depth: int = 2) -> bool:
    """Suffix filter: splits both sorted sets at a probe of one; what the parts' sizes differ by can't be shared."""

    def most(x: np.ndarray, y: np.ndarray, depth: int) -> int:
        if not depth or len(x) < 8 or len(y) < 8:
            return min(len(x), len(y))
        probe = y[len(y) // 2]
        i, j = int(np.searchsorted(x, probe)), len(y) // 2
        return most(x[:i], y[:j], depth - 1) + most(x[i:], y[j:], depth - 1)

    return most(x, y, depth) >= need


def verified(pairs: DataFrame, texts: DataFrame, size: int, per_cent: int) -> DataFrame:
    """(a, b) of the pairs (a, fa, b, fb) whose sets link, from texts (id, text)."""
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "fa", "b", "fb", "ta", "tb")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in slices(batches, 4):
            left, right = [], []
            for a, fa, b, fb, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last[0] != (b, fb):  # rows come by b: a hub's set is made once
                    last = ((b, fb), shingles([lower_bytes(tb)], size)[0])
                y, x = last[1], shingles([lower_bytes(ta)], size)[0]
                if fingerprint(x) != fa or fingerprint(y) != fb:  # another text of the same id
                    continue
                need = -(-per_cent * (len(x) + len(y)) // (100 + per_cent))
                if suffix_may(x, y, need):
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    if int((y[at] == x).sum()) >= need:
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.mapInArrow(f, "a long, b long")


def joined(docs: DataFrame, key: str = "doc_id", size: int = 3, per_cent: int = 90) -> DataFrame:
    """key, n_shingles and component_id (the least key reachable by links) of every row of docs (key, text)."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).cast("long").alias("id"), "text")
    rows, sketch = surveyed(own, size)
    frequency = np.zeros((SLOTS // SLICE, SLICE), np.int64)
    for r in sketch.collect():  # SLOTS numbers
        frequency[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    # equal sets: a task's own meet in its first one, those of different tasks by fingerprint, so a group has a row a task there
    sets = rows.where(F.col("id").isNotNull() & (F.col("f") != EMPTY))
    leads = sets.where("id = lead").select("id", "f").distinct()
    equal = leads.groupBy("f").agg(F.min("id").alias("b"), F.count("*").alias("copies")).where("copies > 1")
    links = leads.join(equal, "f").where("id <> b").select(F.col("id").alias("a"), "b").unionByName(sets.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")))

    # members of groups of more than one set; the window is one shuffle of prefix shingles
    by = W.partitionBy("h")
    packed = prefixes(own, size, per_cent, frequency.ravel()).select("h", "id", "f", F.shiftleft("n", 32).bitwiseOR(F.col("pos")).alias("at"))
    several = packed.withColumn("several", F.min("f").over(by) != F.max("f").over(by)).where("several")
    member = several.groupBy("h", "f").agg(F.min("id").alias("id"), F.first("at").alias("at"))
    member = cut(member.select("h", "id", "f", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND((1 << 32) - 1).alias("pos")), "members")
    texts = cut(own.join(member.select("id").distinct(), "id"), "texts", "zstd")
    del packed, several

    comp, done = components(links), None
    for round_ in range(HUB_ROUNDS + 1):
        lead = member.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        lead = lead.withColumn("open", F.min("component").over(by) != F.max("component").over(by)).where("open").drop("open")
        if round_ < HUB_ROUNDS:
            first = W.partitionBy("h").orderBy("turn", "pos", "f")
            # the hub of this round: the first member after those that were hubs, by position
            lead = lead.withColumn("turn", F.row_number().over(W.partitionBy("h").orderBy("pos", "f")) <= round_).withColumn("hub", F.first(F.struct("id", "f", "n", "pos", "component")).over(first))
            pairs = lead.select(F.struct("id", "f", "n", "pos", "component").alias("x"), F.col("hub").alias("y"))
            pairs = pairs.where((F.col("x.component") != F.col("y.component")) & possible("x", "y", per_cent))
        else:
            lead = cut(lead, "open")
            s = F.struct("id", "f", "n", "pos", "component")
            pairs = lead.select("h", s.alias("x")).join(lead.select("h", s.alias("y")), "h").where((F.col("x.f") < F.col("y.f")) & (F.col("x.component") != F.col("y.component")) & possible("x", "y", per_cent))
        pairs = pairs.groupBy(F.col("x.f").alias("fa"), F.col("y.f").alias("fb")).agg(F.min("x.id").alias("a"), F.min("y.id").alias("b"))
        if done is not None:
            pairs = pairs.join(done, ["fa", "fb"], "left_anti").join(done.select(F.col("fa").alias("fb"), F.col("fb").alias("fa")), ["fa", "fb"], "left_anti")
        pairs = cut(pairs, "pairs")
        del lead
        tidy(spark)
        if pairs.isEmpty():
            continue
        found = cut(verified(pairs.select("a", "fa", "b", "fb"), texts, size, per_cent), "links")
        done = pairs.select("fa", "fb") if done is None else done.unionByName(pairs.select("fa", "fb"))
        if not found.isEmpty():
            # components so far are stars: they stand for all links before
            comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
    out = rows.join(comp.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def representatives(docs: DataFrame, size: int = 3, per_cent: int = 90) -> DataFrame:
    """The rows of docs (doc_id, text and more) with the least doc_id of their component; of rows that repeat doc_id and text, one. A null doc_id is kept; rows that share a doc_id are one node of the join, and go together."""
    gone = joined(docs, "doc_id", size, per_cent).where("doc_id <> component_id").select("doc_id").distinct()
    copy = unused("copy", docs.columns)
    once = W.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    kept = docs.join(gone, "doc_id", "left_anti").withColumn(copy, F.row_number().over(once))
    return kept.where((F.col(copy) == 1) | F.col("doc_id").isNull()).select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies."""
    return joined(table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d)),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 90 * (u.n + v.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT x AS doc_id, any_value(n.n) AS n_shingles, min(y) AS component_id FROM r JOIN n ON n.doc_id = r.x GROUP BY x
"""
