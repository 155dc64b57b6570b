"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text, by language.

Halves. A hash of doc_id deals all documents to two halves. Every trusted text (labelled of quality and not toxic) trains
the model of the other half, so that no text is judged by a model that saw it, no trusted text is left out of training and
none out of the limits. A model is known by its half and language (told()).

Training. Tasks count trigrams in arrays, which meet in shards by their middle word: all that a word is the nearest context
of lies in its shard, trigrams and, by their kinds, bigrams with their continuation counts, contexts and totals. Only words
(first orders) come from all shards, in a second, small shuffle. A shard's trigrams are written once, sorted, as places among its
words; discounts come from the counts of counts of each order, half and language. Halves train one after the other.

Scoring. Tasks cut texts into blocks of BLOCK bytes and send each shard the tokens whose word before it holds, with their documents; the
shard gives each document the sum of their logarithms, and a block adds up its shards' sums. Nothing is collected or broadcast but
discounts and marks. Models above MOST_MODEL bytes are asked in WAVES of documents, to take less disk at once. Every whole document
gets its perplexity. The tokens after one word meet in one task, a block at a time; a shard's trigrams must fit its memory.

Marks. Toxic texts may be well formed, and a perplexity doesn't tell them. All texts labelled toxic and all trusted texts of
the other half give each word the logarithm of how much more often toxic documents hold it (the MARKS words that tell most);
a document's mark is the largest among its words.

Thresholds. A document is rejected above the QUANTILE of the perplexities of all trusted texts of its half and language, or
above the same quantile of their marks (LEAST_MARK at least).

Words are case-sensitive; n-grams are known by 64-bit hashes, with their language. Defined cases: a null text is empty,
and its one token is the end; a null lang is a language of its own; a language without trusted texts has no model, null
perplexity, and keeps its documents; labels that repeat or contradict each other count where all trust the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dropped, placed, release, scratch, shards, slices, store, table, tidy, unused
from .decontamination import terms_of
from .hashing import mixed, words

ORDER, QUANTILE, SEED, PORTION, MOST_MODEL = 3, 0.995, 11, 1 << 18, 64 << 20
#: Bytes of text in a block, and of texts whose n-grams a task counts at once.
BLOCK = 16 << 20
#: Parts of the documents that are scored one after the other where a model is above MOST_MODEL bytes.
WAVES = 6
#: Trusted texts whose numbers Spark is told to broadcast (8 bytes each); beyond, texts are shuffled to meet them.
MOST_TOLD = 1_000_000
#: Words that may mark toxic texts, the toxic documents that must hold one, and the least mark to reject.
MARKS, MARK_DOCS, LEAST_MARK = 4096, 3, 1.5
START, END = np.uint64(0x51AB), np.uint64(0xE2D5)


def language(lang: str | None) -> np.uint64:
    """A number of a language, from its whole name."""
    name = b"" if lang is None else b"." + lang.encode("utf-8", "surrogatepass")
    return np.uint64(int.from_bytes(hashlib.blake2b(name, digest_size=8).digest()))


def sequence(texts: list[bytes], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(words' hashes, with their language, of texts one after the other: starts, words, an end; each text's number of them)."""
    ends = np.cumsum([len(t) for t in texts])
    h, row = words(np.frombuffer(b"".join(texts), np.uint8), ends, lower=False)
    pad = ORDER - 1
    n = np.bincount(row, minlength=len(texts))
    # each text: pad starts, its words, the end
    size = n + pad + 1
    first = np.cumsum(size) - size
    w = np.full(size.sum(), START, np.uint64)
    w[np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first + pad, n)] = h
    w[first + size - 1] = END
    number = {x: language(x) for x in set(langs)}
    return mixed(w + np.repeat(np.array([number[x] for x in langs], np.uint64), size)), size


def tokens(w: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(text of each token, its word and the words before it, the newest first) of a sequence()."""
    first = np.cumsum(size) - size
    which = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(np.arange(len(w)) - first[which] >= ORDER - 1)
    return which[at], [w[at - k] for k in range(ORDER)]


def batched(batches: Iterator[pa.RecordBatch], text: int, lang: int, most: int = PORTION):
    """(batch's slice, texts, languages) of about most bytes of text."""
    for b in slices(batches, text):
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in b.column(text).to_pylist()]
        langs = b.column(lang).to_pylist()
        at = n = 0
        for i, t in enumerate(texts):
            n += len(t)
            if n >= most or i + 1 == len(texts):
                yield b.slice(at, i + 1 - at), texts[at : i + 1], langs[at : i + 1]
                at, n = i + 1, 0


class Lookup:
    """Values by 64-bit key: open addressing in arrays, built and asked for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.mask = np.uint64((1 << max(4, int(1.4 * len(keys)).bit_length())) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.values = np.zeros(int(self.mask) + 1, np.float32)
        keys = np.where(keys == 0, np.uint64(1), keys)
        left, slot = np.arange(len(keys)), keys & self.mask
        while len(left):
            free = self.keys[slot] == 0
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, slot = left[stay], (slot[stay] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        keys = np.where(keys == 0, np.uint64(1), keys)
        out = np.full(len(keys), default, np.float32)
        slot, left = keys & self.mask, np.arange(len(keys))
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        return out


#: Arrays of words and marks by half; those of "" are for all.
Marks = dict[str, tuple[np.ndarray, np.ndarray]]


@dataclass
class Tables:
    """Fitted models: rows of the trigrams by model and shard (by half, where models have halves), the words in files by model, and what tasks need of all. entries is the number of n-grams and contexts, n that of a model's shards."""

    trigrams: list[DataFrame] = field(default_factory=list)
    n: int = 1
    #: By name: number, discounts of trigrams, of bigrams and of words, all words' continuations, floor.
    models: dict[str | None, tuple] = field(default_factory=dict)
    entries: int = 0
    marks: Marks = field(default_factory=dict)
    #: Where all that lies; the words last.
    paths: list[str] = field(default_factory=list)

    def fits(self, most: int) -> bool:
        return 12 * self.entries <= most

    def dropped(self, spark: SparkSession) -> None:
        """Removes the tables, once all is scored."""
        for at in self.paths:
            dropped(spark, at)


class Marker:
    def __init__(self, marks: Marks) -> None:
        self.of = {half: Lookup(*x) for half, x in marks.items()}

    def __call__(self, texts: list[bytes], langs: list[str | None]) -> np.ndarray:
        """The largest mark among each text's words, in its half; minus infinity without one."""
        h, row = terms_of([t.decode("utf-8", "surrogatepass") for t in texts])
        out = np.full(len(texts), -np.inf)
        for half, of in self.of.items():
            here = slice(None) if not half else np.array([x[:1] == half for x in langs], bool)[row]
            np.maximum.at(out, row[here], of.get(h[here], -np.inf))
        return out


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of the texts that all their labels trust."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good and doc_id is not null").select("doc_id")


def draw(key: str = "doc_id") -> Column:
    """A number in [0, 1) of a document."""
    return F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams seen once to four times; safe where some are none."""
    n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    clip = lambda x, k: min(max(x, 0.05), k - 0.05)
    return clip(1 - 2 * y * n2 / n1, 1), clip(2 - 3 * y * n3 / n2, 2), clip(3 - 4 * y * n4 / n3, 3) if n3 else 2.0


def shares(docs: DataFrame, labels: DataFrame) -> dict[str | None, float]:
    """By language with trusted texts, the share of them in the first half."""
    return {r.lang: 0.5 for r in labelled(docs.select("doc_id", "lang"), trusted(labels)).select("lang").distinct().collect()}  # a row a language


def picked(share: dict[str | None, float], lang: str = "lang") -> Column:
    """Whether a trusted text is one of the first half."""
    out = F.lit(0.0)
    for k, v in share.items():
        out = F.when(F.col(lang).eqNullSafe(F.lit(k)), F.lit(v)).otherwise(out)
    return draw() < out


def told(other: bool = False) -> Column:
    """The name of a document's model, by its half (or by the other one, which it may train) and language; a null one has no dot."""
    half = (draw() < 0.5) != F.lit(other)
    return F.concat(F.when(half, "0").otherwise("1"), F.coalesce(F.concat(F.lit("."), "lang"), F.lit("")))


def labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids; a moderate number of them is broadcast, so that texts stay where they are."""
    ids = cut(ids, "labelled")
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_TOLD else ids, "doc_id", "left_semi")


def halves(n: int) -> list[Column]:
    """Whether a row's model is of each half; of the only one, where models have none."""
    return [F.substring("lang", 1, 1) == h for h in "01"] if n == 2 else [F.lit(True)]


GRAMS = "lang string, shard int, words binary, n binary"
_GRAMS = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("words", pa.binary()), ("n", pa.binary())])
SUMS = GRAMS + ", three array<long>, two array<long>, ends binary, many binary"
_SUMS = pa.schema([*_GRAMS, ("three", pa.list_(pa.int64())), ("two", pa.list_(pa.int64())), ("ends", pa.binary()), ("many", pa.binary())])
ENDS = "lang string, shard int, ends binary, many binary"
_ENDS = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("ends", pa.binary()), ("many", pa.binary())])


def shard_of(key: np.ndarray, n: int) -> np.ndarray:
    """Shards in the order of keys."""
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def planes(key: np.ndarray) -> bytes:
    """Sorted keys, byte by byte of all of them: the high bytes hardly change, so that they compress."""
    return np.ascontiguousarray(key.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def opened(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def packed(own: np.ndarray, at: np.ndarray) -> bytes:
    """Sorted words, and rows of places among them."""
    return squeezed(np.int64(len(own)).tobytes() + planes(own) + at.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32).tobytes())


def unpacked(data: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    data = opened(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return unplaned(data[8 : 8 + 8 * n]), np.frombuffer(data[8 + 8 * n :], np.uint16 if n <= 1 << 16 else np.uint32).reshape(rows, -1)


def numbers(n: np.ndarray) -> bytes:
    """Counts, mostly small."""
    n = n.astype(np.uint8 if n.max(initial=0) < 256 else np.int64)
    return squeezed(n.dtype.char.encode() + n.tobytes())


def counted(data: bytes) -> np.ndarray:
    data = opened(data)
    return np.frombuffer(data[1:], data[:1].decode()).astype(np.int64)


def width(own: np.ndarray) -> int:
    """Bits that tell a place among words."""
    return max(1, int(len(own)).bit_length())


def ordered(at: np.ndarray, bits: int) -> np.ndarray:
    """The order of trigrams (middle, first and last word, as places of so many bits)."""
    middle, first, last = at.astype(np.int64)
    both = middle << bits | first
    return np.argsort(both << bits | last) if 3 * bits <= 63 else np.lexsort((last, both))


def starts(*w: np.ndarray) -> np.ndarray:
    """Where others begin, of rows of which equal ones lie together."""
    new = np.ones(len(w[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in w], axis=0)
    return np.flatnonzero(new)


def dealt(own: np.ndarray, at: np.ndarray, n: int) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """(shard, rows, words, places among them) of sorted trigrams, by the shard of the middle word."""
    edge = np.searchsorted(at[0], np.searchsorted(shard_of(own, n), np.arange(n + 1)))
    for s, (i, j) in enumerate(zip(edge, edge[1:], strict=False)):
        if j > i:
            used = np.zeros(len(own), bool)
            used[at[:, i:j].ravel()] = True
            yield s, slice(i, j), own[used], (np.cumsum(used) - 1)[at[:, i:j]]


def trigrams(w: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, places of middle, first and last among them, sorted; text of each) of the tokens of a sequence()."""
    own, at = np.unique(w, return_inverse=True)
    row, (last, middle, first) = tokens(at, size)
    at = np.stack((middle, first, last))
    order = ordered(at, width(own))
    return own, at[:, order], row[order]


def by_model(w: np.ndarray, size: np.ndarray, langs: list[str | None]) -> Iterator[tuple[str | None, np.ndarray, np.ndarray, np.ndarray]]:
    """(model, its texts, their part of a sequence(), their sizes)."""
    for x in set(langs):
        here = np.array([y == x for y in langs])
        yield x, np.flatnonzero(here), w[np.repeat(here, size)], size[here]


def sums(n: np.ndarray, contexts: int) -> list[int]:
    """Numbers of n-grams seen once to four times, of all occurrences, n-grams and contexts."""
    return [*(int((n == i).sum()) for i in (1, 2, 3, 4)), int(n.sum()), len(n), contexts]


def summed(t: pa.Table) -> pa.Table:
    """A grouped map: one shard's trigrams with their counts, what the model needs of them and of their bigrams, and the words that bigrams end in."""
    got = [unpacked(x.as_py(), 3) for x in t["words"]]
    own = np.unique(np.concatenate([x for x, _ in got]))
    at = np.concatenate([np.searchsorted(own, x)[y] for x, y in got], 1)
    del got
    bits, n = width(own), np.concatenate([counted(x.as_py()) for x in t["n"]])
    order = ordered(at, bits)
    at, n = at[:, order], n[order]
    first = starts(*at)
    at, n = at[:, first], np.add.reduceat(n, first)
    # bigrams by the number of words before them, then words by the number of those before them
    pair, many = np.unique(at[0].astype(np.int64) << bits | at[2], return_counts=True)
    ends = np.bincount(pair & ((1 << bits) - 1), minlength=len(own))
    some = np.flatnonzero(ends)
    one = [t["lang"][0].as_py(), t["shard"][0].as_py(), packed(own, at), numbers(n), sums(n, len(starts(at[0], at[1]))), sums(many, len(starts(pair >> bits))), squeezed(planes(own[some])), numbers(ends[some])]
    return pa.table([pa.array([x], y.type) for x, y in zip(one, _SUMS, strict=True)], schema=_SUMS)


def added(t: pa.Table) -> pa.Table:
    """A grouped map: one shard's words that bigrams end in, with the numbers of those bigrams."""
    own, which = np.unique(np.concatenate([unplaned(opened(x.as_py())) for x in t["ends"]]), return_inverse=True)
    n = np.bincount(which, np.concatenate([counted(x.as_py()) for x in t["many"]]), len(own)).astype(np.int64)
    one = [t["lang"][0].as_py(), t["shard"][0].as_py(), squeezed(planes(own)), numbers(n), sums(n, 0)]
    return pa.table([pa.array([x], y) for x, y in zip(one, [*_ENDS.types, pa.list_(pa.int64())], strict=True)], [*_ENDS.names, "one"])


def totals(rows: DataFrame, column: str) -> dict[str | None, list[int]]:
    """By model, the sums of sums(): a row a model."""
    return {r.lang: list(r)[1:] for r in rows.groupBy("lang").agg(*[F.sum(F.col(column)[i]).alias(f"s{i}") for i in range(7)]).collect()}


def fit(docs: DataFrame, labels: DataFrame, share: dict[str | None, float] | None) -> Tables:
    """The models of the picked trusted texts of docs (doc_id, text, lang); of all of them, where docs has other names of models than languages and share is None."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "lang")
    texts = labelled(docs if share is None else docs.where(picked(share)), trusted(labels))
    # few large rows of n-grams take less than many small ones, which repeat words
    names = sorted((r.lang for r in texts.select("lang").distinct().collect()), key=lambda x: (x is not None, x))  # a row a model
    n = -(-2 * shards(spark) // max(1, len(names)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str | None, list] = {}

        def done(lang: str | None) -> pa.RecordBatch:
            own, at, _ = trigrams(*(np.concatenate(x) for x in zip(*kept.pop(lang), strict=True)))
            first = starts(*at)
            many = np.diff(np.append(first, at.shape[1]))
            rows = [(lang, s, packed(x, y), numbers(many[here])) for s, here, x, y in dealt(own, at[:, first], n)]
            return pa.RecordBatch.from_arrays([pa.array(x, y.type) for x, y in zip(zip(*rows, strict=True), _GRAMS, strict=True)], schema=_GRAMS)

        for _, data, langs in batched(batches, 1, 2):
            for x, _, *own in by_model(*sequence(data, langs), langs):
                kept.setdefault(x, []).append(own)
                if sum(len(w) for w, _ in kept[x]) >= BLOCK // 8:
                    yield done(x)
        for x in list(kept):
            yield done(x)
        release()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, ends, many in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ends, many = unplaned(opened(ends)), counted(many)
                edge = np.searchsorted(shard_of(ends, n), np.arange(n + 1))
                rows = [(lang, s, squeezed(planes(ends[i:j])), numbers(many[i:j])) for s, (i, j) in enumerate(zip(edge, edge[1:], strict=False)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array(x, y.type) for x, y in zip(zip(*rows, strict=True), _ENDS, strict=True)], schema=_ENDS)

    number = F.lit(None).cast("int")
    for i, x in enumerate(names):
        number = F.when(F.col("lang").eqNullSafe(F.lit(x)), F.lit(i)).otherwise(number)
    model = Tables(n=n, marks=marks(docs, labels, texts, share is None))
    tidy(spark)
    parts = []
    for half in halves(1 if share is not None else 2):  # one shuffle at a time
        model.paths.append(placed(spark, "trigrams", outer=True))
        texts.where(half).mapInArrow(count, GRAMS).groupBy("lang", "shard").applyInArrow(summed, SUMS).write.parquet(model.paths[-1])
        parts.append(spark.read.schema(SUMS).parquet(model.paths[-1]))
        tidy(spark)
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    model.paths.append(placed(spark, "ends", outer=True))
    words = every.select("lang", "ends", "many").mapInArrow(spread, ENDS).groupBy("lang", "shard").applyInArrow(added, ENDS + ", one array<long>")
    words.withColumn("model", number).write.partitionBy("model").parquet(model.paths[-1])
    tidy(spark)
    three, two, one = totals(every, "three"), totals(every, "two"), totals(spark.read.schema(words.schema).parquet(model.paths[-1]), "one")
    for i, x in enumerate(names):
        r, off = one[x], [discounts(dict(enumerate(y[x][:4], 1))) for y in (three, two, one)]
        # the discounted mass is spread over the words seen and one unseen
        d = off[2][0] * r[0] + off[2][1] * r[1] + off[2][2] * (r[5] - r[0] - r[1])
        model.models[x] = (i, *off, r[4], d / r[4] / (r[5] + 1))
    model.entries = sum(r[5] + r[6] for y in (three, two, one) for r in y.values())
    model.trigrams = [x.select((number * n + F.col("shard")).cast("long").alias("of"), "words", "n") for x in parts]
    return model


def marks(docs: DataFrame, labels: DataFrame, texts: DataFrame, halves: bool = False) -> Marks:
    """(hashes, marks) of the words that mark toxic texts most, against the training texts; by half where lang holds names of models."""
    some = labelled(docs, labels.where("toxic = 1 and doc_id is not null").select("doc_id").distinct())
    half = F.substring("lang", 1, 1) if halves else F.lit("")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            which = b.column(2).to_numpy(zero_copy_only=False)
            for x in set(which.tolist()):
                h, row = terms_of(b.column(0).filter(pa.array(which == x)).to_pylist())
                both = np.unique(np.stack([row.astype(np.uint64), h], 1), axis=0)
                found, n = np.unique(np.concatenate((both[:, 1], np.zeros((which == x).sum(), np.uint64))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(np.full(len(found), b.column(1)[0].as_py())), pa.array(n.astype(np.int64))], ["half", "word", "toxic", "n"])

    # numbers of documents that hold a word; word 0 counts the documents
    held = lambda x, toxic: x.select("text", F.lit(toxic).alias("toxic"), half.alias("half")).mapInArrow(f, "half string, word long, toxic boolean, n long")
    sums = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(x) for x, c in (("t", F.col("toxic")), ("g", ~F.col("toxic")))]
    by = cut(held(some, True).unionByName(held(texts, False)).groupBy("half", "word").agg(*sums), "marks")
    out = {}
    for n in by.where("word = 0 and t > 0 and g > 0").collect():  # a row a half
        weight = F.log10((F.col("t") + 0.5) / (n.t + 1)) - F.log10((F.col("g") + 0.5) / (n.g + 1))
        top = by.where(f"word <> 0 and t >= {MARK_DOCS}").where(F.col("half") == n.half).select("word", weight.alias("mark")).where("mark > 0").orderBy(F.desc("mark"), "word").limit(MARKS).collect()
        out[n.half] = np.array([r.word for r in top], np.int64).view(np.uint64), np.array([r.mark for r in top], np.float32)
    return out


def perplexity(log10: np.ndarray, n: np.ndarray) -> np.ndarray:
    return 10 ** np.minimum(300.0, -log10 / n)


class Ready:
    """Fitted models, ready to score, and the number of parts of documents that are scored one after the other."""

    def __init__(self, spark: SparkSession, model: Tables, most: int = MOST_MODEL) -> None:
        self.tables, self.waves = model, 1 if model.fits(most) else WAVES


NEW = ("_log10_prob", "_tokens", "_perplexity", "_mark")
ASKS = "of long, block long, words binary, n binary, rows binary"
_ASKS = pa.schema([("of", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("n", pa.binary()), ("rows", pa.binary())])
ANSWERS = "block long, docs binary, sums binary, rows binary"
_ANSWERS = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary()), ("rows", pa.binary())])


def found(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of asked among sorted known; -1 where they aren't there."""
    if not len(known):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


class Shard:
    """Discounted probabilities and weights of the lower order of one shard's trigrams and bigrams."""

    def __init__(self, words: bytes | None, n: bytes | None, three: tuple, two: tuple) -> None:
        self.own, at = unpacked(words, 3) if words else (np.zeros(0, np.uint64), np.zeros((3, 0), np.int64))
        n = counted(n) if n else np.zeros(0, np.int64)
        self.bits = bits = width(self.own)
        middle, first, last = at.astype(np.int64)
        self.context, more, which, p = self._valued(middle << bits | first, n, three)
        self.three, self.p3, self.more = which << bits | last, np.append(p, 0.0), np.append(more, 1.0)  # place -1: not seen
        pair, n = np.unique(middle << bits | last, return_counts=True)
        at, more, _, p = self._valued(pair >> bits, n, two)
        self.two, self.p2, self.less = pair, np.append(p, 0.0), np.ones(len(self.own) + 1)  # an unseen context says nothing: all weight is the lower order's
        self.less[at] = more

    @staticmethod
    def _valued(context: np.ndarray, n: np.ndarray, off: tuple) -> tuple[np.ndarray, ...]:
        """(contexts, weights of the lower order, context's place and probability of each n-gram)."""
        if not len(n):
            return context, np.zeros(0), context, np.zeros(0)
        at, less = starts(context), np.array(off)[np.minimum(n, 3) - 1]
        total = np.add.reduceat(n, at)
        which = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(n))))
        return context[at], np.add.reduceat(less, at) / total, which, (n - less) / total[which]

    def __call__(self, own: np.ndarray, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities of trigrams (places of middle, first and last among own words, whose own probabilities are p)."""
        to, bits = found(self.own, own), self.bits
        middle, first, last = to[at]
        p, there = self.less[to][at[0]] * p[at[2]], last >= 0
        p += self.p2[found(self.two, np.where(there & (middle >= 0), middle << bits | last, -1))]
        i = found(self.context, np.where((middle >= 0) & (first >= 0), middle << bits | first, -1))
        p *= self.more[i]
        return p + self.p3[found(self.three, np.where((i >= 0) & there, i << bits | last, -1))]


def answered(model: Tables):
    """A cogrouped map: one shard's trigrams, and the blocks' tokens that follow its words, to sums of logarithms by document. Blocks' rows only pass."""
    models, n, path = {r[0]: r[1:] for r in model.models.values()}, model.n, model.paths[-1]

    def f(known: pa.Table, asks: pa.Table) -> pa.Table:
        blocks, rows = asks["block"].to_pylist(), asks["rows"].to_pylist()
        if not blocks or asks["of"][0].as_py() < 0:
            return pa.table([pa.array(blocks, pa.int64()), pa.nulls(len(blocks), pa.binary()), pa.nulls(len(blocks), pa.binary()), pa.array(rows, pa.binary())], schema=_ANSWERS)
        number = asks["of"][0].as_py() // n
        three, two, one, whole, floor = models[number]
        shard = Shard(*((known["words"][0].as_py(), known["n"][0].as_py()) if known.num_rows else (None, None)), three, two)
        got = [unpacked_asks(x.as_py()) for x in asks["words"]]
        ps = [np.full(len(own), floor) for own, _ in got]
        files, at = store(f"{path}/model={number}")
        for b in (b for x in files.get_file_info(pafs.FileSelector(at)) if x.path.endswith(".parquet") for b in pq.ParquetFile(files.open_input_file(x.path)).iter_batches(1, columns=["ends", "many"])):
            word, many = unplaned(opened(b.column(0)[0].as_py())), counted(b.column(1)[0].as_py())
            value = (many - np.array(one)[np.minimum(many, 3) - 1]) / whole
            for (own, _), p in zip(got, ps, strict=True):
                i, j = np.searchsorted(own, word[0]), np.searchsorted(own, word[-1], "right")
                to = found(word, own[i:j])
                p[i:j] += np.where(to >= 0, value[to], 0.0)
        docs, sums_ = [], []
        for (own, at), p in zip(got, ps, strict=True):
            doc, which = np.unique(at[3], return_inverse=True)
            docs.append(doc.astype(np.uint32).tobytes())
            sums_.append(np.bincount(which, np.log10(shard(own, at[:3], p)), len(doc)).tobytes())
        return pa.table([pa.array(blocks, pa.int64()), pa.array(docs, pa.binary()), pa.array(sums_, pa.binary()), pa.nulls(len(blocks), pa.binary())], schema=_ANSWERS)

    return f


def scored(docs: DataFrame, ready: Ready, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all) of docs (text, lang), with _log10_prob and _perplexity (null without a model), _tokens and _mark (null without one). Columns whose names docs has get underscores before them."""
    spark, model = docs.sparkSession, ready.tables
    keep = docs.columns if keep is None else keep
    new = [unused(c, docs.columns) for c in NEW]
    docs = docs.select(*[c for c in docs.columns if c in keep or c in ("text", "lang")])
    text, lang = docs.columns.index("text"), docs.columns.index("lang")
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + f"{new[0]} double, {new[1]} long, {new[2]} double, {new[3]} double"
    names, marks_, n = {x: r[0] for x, r in model.models.items()}, model.marks, model.n

    def asks(block: int, held: list[pa.RecordBatch], mark: Marker) -> Iterator[pa.RecordBatch]:
        """A block's tokens by model and shard, and its rows."""
        ws, rows, base = {}, [], 0
        for part, data, langs in batched(iter(held), text, lang):
            w, size = sequence(data, langs)
            for x, here, *own in by_model(w, size, langs):
                if x in names:
                    ws.setdefault(x, []).append((*own, here + base))
            m = mark(data, langs)
            new_ = [pa.array([x in names for x in langs]), pa.array(size - ORDER + 1, pa.int64()), pa.array(m, mask=np.isinf(m))]
            rows.append(pa.RecordBatch.from_arrays([*part.select(keep).columns, *new_], [*keep, new[0], new[1], new[3]]))
            base += len(langs)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            for x in rows:
                to.write_batch(x)
        yield pa.RecordBatch.from_arrays([pa.array([x], y.type) for x, y in zip([-1 - block, block, None, None, sink.getvalue().to_pybytes()], _ASKS, strict=True)], schema=_ASKS)
        for x, own in ws.items():
            w, size, doc = (np.concatenate(y) for y in zip(*own, strict=True))
            word, at, row = trigrams(w, size)
            doc, out = doc[row], []
            for s, here, mine, places in dealt(word, at, n):
                out.append((names[x] * n + s, block, packed_asks(mine, places, doc[here]), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, y.type) for c, y in zip(zip(*out, strict=True), _ASKS, strict=True)], schema=_ASKS)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size, mark = TaskContext.get().partitionId() << 24, [], 0, Marker(marks_)
        for b in slices(batches, text):
            held.append(b)
            size += b.nbytes
            if size >= BLOCK:
                yield from asks(block, held, mark)
                block, held, size = block + 1, [], 0
        if held:
            yield from asks(block, held, mark)
        del held
        release()

    def ended(t: pa.Table) -> pa.Table:
        """A grouped map: a block's rows with the sums of their logarithms."""
        rows = pa.ipc.open_stream(next(x.as_py() for x in t["rows"] if x.is_valid)).read_all()
        log = np.zeros(rows.num_rows)
        for d, x in zip(t["docs"].to_pylist(), t["sums"].to_pylist(), strict=True):
            if d is not None:
                log[np.frombuffer(d, np.uint32)] += np.frombuffer(x)
        size, none = rows[new[1]].to_numpy(), ~rows[new[0]].to_numpy()
        return pa.table([*(rows[c] for c in keep), pa.array(log, mask=none), rows[new[1]], pa.array(perplexity(log, size), mask=none), rows[new[3]]], [*keep, *new])

    def wave(known: DataFrame, some: DataFrame) -> DataFrame:
        with scratch(spark):
            got = known.groupBy("of").cogroup(some.mapInArrow(blocked, ASKS).groupBy("of")).applyInArrow(answered(model), ANSWERS)
            got = cut(got, "answers", "zstd")
            tidy(spark)
            out = cut(got.groupBy("block").applyInArrow(ended, fields), "scored", "zstd", outer=True)
            tidy(spark)
            return out

    # a half's documents ask its own models only
    many = -(-ready.waves // len(model.trigrams))
    own = F.pmod(F.xxhash64(F.col("text"), F.lit(SEED)), F.lit(many))
    out = [wave(known, docs.where(half & (own == i))) for known, half in zip(model.trigrams, halves(len(model.trigrams)), strict=True) for i in range(many)]
    return reduce(DataFrame.unionByName, out)


def packed_asks(own: np.ndarray, at: np.ndarray, doc: np.ndarray) -> bytes:
    """packed(), with each token's document as a fourth row."""
    kind = np.uint16 if len(own) <= 1 << 16 and doc.max(initial=0) < 1 << 16 else np.uint32
    return squeezed(np.array([len(own), np.dtype(kind).itemsize]).tobytes() + planes(own) + np.concatenate((at, doc[None])).astype(kind).tobytes())


def unpacked_asks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = opened(data)
    n, size = (int(x) for x in np.frombuffer(data, np.int64, 2))
    return unplaned(data[16 : 16 + 8 * n]), np.frombuffer(data[16 + 8 * n :], f"u{size}").reshape(4, -1)


Limits = dict[str | None, tuple[float, float]]


def limits(got: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> Limits:
    """The limits of each model's perplexities and marks, from scored rows (doc_id, lang, _perplexity, _mark) of texts that their models didn't see."""
    unseen = labelled(got.select("doc_id", "lang", "_perplexity", "_mark"), trusted(labels))
    mark = F.coalesce("_mark", F.lit(0.0))  # texts without one count
    rows = unseen.groupBy("lang").agg(F.percentile_approx("_perplexity", quantile, 100000).alias("t"), F.percentile_approx(mark, quantile, 100000).alias("m")).collect()  # a row a model
    return {r.lang: (np.inf if r.t is None else r.t, max(LEAST_MARK, r.m or 0.0)) for r in rows}


def verdicts(got: DataFrame, most: Limits, new: dict[str, str] | None = None) -> DataFrame:
    """Scored rows with _threshold and _mark_threshold, of their model, and _kept."""
    new = new or {c: c for c in (*NEW, "_threshold", "_mark_threshold", "_kept")}
    limit, mark = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, (t, m) in most.items():
        here = F.col("lang").eqNullSafe(F.lit(k))
        limit, mark = F.when(here, F.lit(t)).otherwise(limit), F.when(here, F.lit(m)).otherwise(mark)
    got = got.withColumns({new["_threshold"]: limit, new["_mark_threshold"]: mark})
    kept = F.coalesce(F.col(new["_perplexity"]) <= F.col(new["_threshold"]), F.lit(True)) & F.coalesce(F.col(new["_mark"]) <= F.col(new["_mark_threshold"]), F.lit(True))
    return got.withColumn(new["_kept"], kept)


def crossed(docs: DataFrame, labels: DataFrame) -> Tables:
    """The models of both halves, each of all trusted texts of the other."""
    return fit(docs.select("doc_id", "text", told(other=True).alias("lang")), labels, None)


def filtered(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, most_model: int = MOST_MODEL) -> DataFrame:
    """The rows of docs (doc_id, text, lang and more) that aren't rejected."""
    own = unused("own", docs.columns)  # the language, while lang names a model
    named = docs.withColumn(own, F.col("lang")).withColumn("lang", told())
    back = [F.col(own).alias(c) if c == "lang" else F.col(c) for c in docs.columns]
    new = {c: unused(c, named.columns) for c in (*NEW, "_threshold", "_mark_threshold", "_kept")}
    with scratch(docs.sparkSession):
        ready = Ready(docs.sparkSession, crossed(docs, labels), most_model)
    got = scored(named, ready)
    ready.tables.dropped(docs.sparkSession)
    plain = got.select("doc_id", "lang", F.col(new["_perplexity"]).alias("_perplexity"), F.col(new["_mark"]).alias("_mark"))
    return verdicts(got, limits(plain, labels, quantile), new).where(new["_kept"]).select(*back)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity and verdict."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels")
    with scratch(spark):
        ready = Ready(spark, crossed(docs, labels))
    got = scored(docs.select("doc_id", F.col("lang").alias("own"), told().alias("lang"), "text"), ready, ["doc_id", "own", "lang"])
    ready.tables.dropped(spark)
    cols = {"_tokens": "n_tokens", "_log10_prob": "log10_prob", "_perplexity": "perplexity", "_threshold": "threshold", "_mark": "mark", "_mark_threshold": "mark_threshold", "_kept": "kept"}
    return verdicts(got, limits(got, labels)).select("doc_id", F.col("own").alias("lang"), *[F.col(a).alias(b) for a, b in cols.items()])
