"""Embedding near-dedup by lattice hashing.

Each table projects vectors of length 1 onto eight random orthonormal directions, scales and shifts them, and decodes the
result to the nearest point of the E8 lattice: that cell, hashed, is the table's bucket. Each vector also probes the
neighbouring cells (of the 240 around its own) that it lies nearest to. Two vectors meet where one's cell is the other's
cell or probe, and every pair that meets is verified by its cosine in double precision.

Equal vectors are one class with a multiplicity before anything is hashed, so copies are never paired with each other.
Buckets are shuffled without vectors first; only rows of buckets that hold a pair get theirs. Buckets of more than CELL
rows are split: blocks of their members meet pairwise, each pair of blocks in a task of its own.

No pair leaves a task, so a group of n different near copies costs rows in proportion to n, not n squared. A pair may meet
in several tables; it is counted in the first, which each task can tell from the two vectors' bucket numbers. A task gives
each vector's number of links that it counted, and a spanning forest of the links that it saw.

At cosine 0.9, the least that counts, a pair of 64 components meets in one table with probability of about 0.4, and in
one of TABLES with more than 0.99; tests measure recall against brute force.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as does a null
vec_id; vectors of different lengths don't link; rows that repeat a vec_id are vectors of their own under one node.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, shards, table
from .hashing import A, mixed

TABLES, PROBES, SCALE, SEED, CELL, LEAST = 10, 2, 5.0, 7, 4096, 0.9


@lru_cache(1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled so that they are whole: permutations of (±1, ±1, 0...) and (±1/2...) with an even number of minuses."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


def nearest(x: np.ndarray) -> np.ndarray:
    """The E8 point nearest to each row, doubled. E8 is D8 (whole numbers of even sum) and D8 shifted by 1/2."""

    def d8(x: np.ndarray) -> np.ndarray:
        r = np.rint(x)
        odd = np.flatnonzero(r.sum(1) % 2)
        off = x[odd] - r[odd]
        j = np.abs(off).argmax(1)
        r[odd, j] += np.where(off[np.arange(len(odd)), j] >= 0, 1, -1)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(closer[:, None], a, b)).astype(np.int64)


@lru_cache(8)
def directions(dims: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections [table, dims, 8], shifts, and odd numbers that hash lattice points."""
    rng = np.random.default_rng([seed, dims])
    width = max(dims, 8)
    q = np.stack([np.linalg.qr(rng.normal(size=(width, 8)))[0][:dims] for _ in range(tables)])
    return q, rng.random((tables, 8)), rng.integers(1, 1 << 62, size=8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """Bucket numbers [row, table, own cell and probes], 32 bits each, of vectors of length 1; probes that repeat a number are 0."""
    q, shift, odd = directions(unit.shape[1], tables, seed)
    out = np.empty((len(unit), tables, 1 + probes), np.uint32)
    near = roots()
    for t in range(tables):
        y = unit @ q[t] * scale + shift[t]
        c = nearest(y)
        # distance to the neighbours' centres, up to what all have in common
        far = (near**2).sum(1) / 4 - (y - c / 2) @ near.T
        best = np.argsort(far, axis=1, kind="stable")[:, :probes]
        points = np.concatenate((c[:, None], c[:, None] + near[best]), axis=1)
        out[:, t] = np.maximum(mixed((points.astype(np.uint64) * odd).sum(2) + np.uint64(unit.shape[1])) >> np.uint64(32), np.uint64(1))
    for j in range(1, 1 + probes):
        out[:, :, j] *= (out[:, :, j, None] != out[:, :, :j]).all(2)
    return out


def units(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    most = np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v / most, axis=1, keepdims=True) / most


def packed(kind: type):
    """A map of (id, v, m) to (id, m, v in bytes of kind)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([np.array(x.as_py(), kind).tobytes() for x in b.column(1)], pa.binary())], ["id", "m", "v"])

    return f


def hashed(tables: int, probes: int, scale: float, seed: int, kind: type):
    """A map of (id, v) to (id, buckets): a vector's bucket numbers, own cell and probes of table after table."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x) for x in b.column(1)])
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                for part in np.array_split(at, max(1, len(at) // 2048)):
                    unit = units(np.array([b.column(1)[int(i)].as_py() for i in part]).astype(kind).astype(np.float64))
                    keys = cells(unit, tables, probes, scale, seed).reshape(len(part), -1)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel().view(np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(part)), flat], ["id", "buckets"])

    return f


def _met(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether pairs of vectors meet in a table, from their bucket numbers [pair, own cell and probes]."""
    return ((x[:, :1] == y) | (x == y[:, :1])).any(1)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes the least one that edges (a, b) reach: minima spread over edges and along their own paths."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def linked(least: float, tables: int, kind: type):
    """A grouped map: one share of the buckets to links counted (a, n) and edges of a spanning forest of links seen (a, b)."""

    def one(table_: int, x: np.ndarray, keys: np.ndarray, ids: np.ndarray, own: np.ndarray, m: np.ndarray, block: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(links counted of each member, forest of the links seen) of a bucket, or of two blocks of a split one."""
        seen, many, mine = [], np.zeros(len(ids), np.int64), np.flatnonzero(own)
        for part in np.array_split(mine, max(1, len(mine) * len(ids) >> 20)):
            a, b = np.nonzero(x[part] @ x.T >= least)
            a = part[a]
            keep = ids[a] != ids[b]
            if block is not None:  # only across
                keep &= block[a] != block[b]
            a, b = a[keep], b[keep]
            seen.append(_thin(a, b, len(ids)))
            # a pair counts in its first table; there, in the smaller id's cell if each is the other's probe
            keep = ~own[b] | (ids[a] < ids[b])
            a, b = a[keep], b[keep]
            for before in range(table_):
                keep = ~_met(keys[a, before], keys[b, before])
                a, b = a[keep], b[keep]
            twice = ~own[b] & (keys[b, table_, :1] == keys[a, table_]).any(1) & (ids[b] < ids[a])
            a, b = a[~twice], b[~twice]
            many += np.bincount(a, m[b], len(ids)).astype(np.int64) + np.bincount(b, m[a], len(ids)).astype(np.int64)
        return many, _thin(*np.concatenate(seen, 1), len(ids))

    def f(t: pa.Table) -> pa.Table:
        bucket, ids, own, m, left, other, block = (t[c].to_numpy() for c in ("bucket", "id", "own", "m", "part", "other", "block"))
        v = t["v"].combine_chunks()
        offset = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1].astype(np.int64)
        data, size = np.frombuffer(v.buffers()[2], np.uint8), np.diff(offset)
        keys = t["buckets"].combine_chunks().flatten().to_numpy().reshape(len(ids), tables, -1)
        links, ends = [], []
        for d in np.unique(size):  # vectors of other lengths may share a bucket's number
            of = np.flatnonzero(size == d)
            x = units(data[offset[of, None] + np.arange(d)].view(kind).astype(np.float64))
            order = np.lexsort((other[of], left[of], bucket[of]))
            of, x = of[order], x[order]
            edge = np.flatnonzero((np.diff(bucket[of]) != 0) | (np.diff(left[of]) != 0) | (np.diff(other[of]) != 0)) + 1
            for lo, hi in zip([0, *edge], [*edge, len(of)], strict=True):
                at = of[lo:hi]
                if len(at) < 2 or not own[at].any():
                    continue
                many, forest = one(int(bucket[at[0]] >> 32), x[lo:hi], keys[at], ids[at], own[at], m[at], block[at] if left[at[0]] != other[at[0]] else None)
                some = np.flatnonzero(many)
                links.append((ids[at[some]], many[some]))
                ends.append((ids[at[forest[0]]], ids[at[forest[1]]]))
        none = (np.zeros(0, np.int64),) * 2
        (a, n), (p, q) = (tuple(np.concatenate(z) for z in zip(*rows, strict=True)) if rows else none for rows in (links, ends))
        b, many = np.concatenate((np.zeros(len(a), np.int64), q)), np.concatenate((n, np.zeros(len(p), np.int64)))
        edge_ = np.arange(len(b)) >= len(a)
        return pa.table({"a": np.concatenate((a, p)), "b": pa.array(b, mask=~edge_), "n": pa.array(many, mask=edge_)})

    return f


def _thin(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """A spanning forest of edges (a, b) among n nodes."""
    root = _forest(a, b, n)
    there = np.flatnonzero(root != np.arange(n))
    return np.stack([there, root[there]])


def links(classes: DataFrame, least: float = LEAST, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED, cell_rows: int = CELL, single: bool = False) -> DataFrame:
    """Of classes (id, v, m), v an array of doubles and m its multiplicity: (a, null, n), links of a that a task counted, to be summed; (a, b, null), links that span all components. single: v holds single precision."""
    kind = np.float32 if single else np.float64
    spark = classes.sparkSession
    vectors = cut(classes.select("id", "v", "m").mapInArrow(packed(kind), "id long, m long, v binary"), "vectors")
    keys = cut(classes.select("id", "v").mapInArrow(hashed(tables, probes, scale, seed, kind), "id long, buckets array<int>"), "buckets")
    each = 1 + probes
    rows = keys.select("id", F.posexplode("buckets").alias("at", "number")).where("number <> 0")
    rows = rows.select("id", F.shiftleft(F.floor(F.col("at") / each).cast("long"), 32).bitwiseOR(F.col("number").cast("long").bitwiseAND(0xFFFFFFFF)).alias("bucket"), (F.col("at") % each == 0).alias("own"))
    # buckets that hold a pair, with the number of blocks; no vector is shuffled for the others
    live = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("own").alias("some")).where("n > 1 and some").select("bucket", F.ceil(F.col("n") / cell_rows).cast("int").alias("blocks"))
    rows = rows.join(live, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.join(vectors.join(keys, "id"), "id").withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", "id", "own", "m", "v", "buckets", "block", F.least("block", "peer").alias("part"), F.greatest("block", "peer").alias("other"))
    rows = rows.withColumn("share", F.pmod(F.xxhash64("bucket", "part", "other"), F.lit(8 * shards(spark))))
    return rows.groupBy("share").applyInArrow(linked(least, tables, kind), "a long, b long, n long")


def neardup(vectors: DataFrame, key: str = "vec_id", value: str = "embedding", **how) -> DataFrame:
    """key, n_links, component_id and kept of every row of vectors (key, value)."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(value).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = cut(rows.withColumn("v", F.when(good, F.col("v"))), "vectors")
    classes = cut(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("m")).select("id", "m", "v"), "classes")
    single = vectors.schema[value].dataType.simpleString() == "array<float>"
    found = cut(links(classes, single=single, **how), "links")
    others = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("others"))
    comp = components(found.where("b is not null").select("a", "b").unionByName(rows.where("v is not null").join(classes.select("v", F.col("id").alias("b")), "v").select(F.col("id").alias("a"), "b")))
    own = classes.join(others.withColumnRenamed("a", "id"), "id", "left").select("v", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n"))
    out = rows.join(own, "v", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op2_lattice_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    return neardup(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.n > 0 AND b.n > 0 WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r(x, y) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x) USING (vec_id)
"""
