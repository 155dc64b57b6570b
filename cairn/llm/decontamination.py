"""Benchmark decontamination by a positional inverted index distributed over the documents.

The index is partitioned by document, as search engines do it: each block of documents stores, for every term of its
texts, the sorted list of its token positions, in the shared folder. A benchmark window is answered from its rarest term
in a block: the term's positions, less its offset in the window, are the candidate starts, which are intersected with the
other terms' offset-adjusted lists in the order of their frequency, by binary search. What is left is an exact phrase
match. A proximity match holds for a window if some NEAR_SPAN words of a document hold all of its words but one in
NEAR_MISS, each as often as the window does, in any order: reordered, interrupted and edited passages. It asks for no rarity,
so it is the same in any block; candidates come from as many of the block's rarest terms of the window as can't all be missing.
Nothing is shuffled, and a window that one third of the documents holds costs its block no more than its own matches.

The benchmark is written to the shared folder in chunks of bounded size; each block is asked chunk after chunk, so
neither the benchmark's nor the corpus's size is bounded by a worker's memory. A block is BLOCK bytes of text, or one
longer text. Terms are known by 64-bit hashes.

Defined cases: null or empty texts have no words and hit nothing; an item without words has no window; items with one
item_id are one item; a null item_id is the empty string; repeated documents are judged each for itself.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, shared_folder, slices, store, table
from .hashing import words

WINDOW, BLOCK, CHUNK, PORTION = 10, 4 << 20, 8 << 20, 1 << 19
#: Span in words for a proximity match, and one in how many of a window's words may be missing in it.
NEAR_SPAN, NEAR_MISS = 20, 5
#: Word bytes: 0-9, a-z and all above 0x7F; A-Z become a-z; all others end a word.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SHIFT = 32
_PARTS = ("starts", "sizes", "terms", "first", "positions")


def terms_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of every word; about PORTION bytes are hashed at a time."""
    data = [(t or "").encode("utf-8", "surrogatepass").translate(_WORDS) for t in texts]
    parts, at = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    while at < len(data):
        size, stop = len(data[at]), at + 1
        while stop < len(data) and size + len(data[stop]) <= PORTION:
            size += len(data[stop])
            stop += 1
        own = data[at:stop]
        h, row = words(np.frombuffer(b"".join(own), np.uint8), np.cumsum([len(d) for d in own]).astype(np.int64), lower=False)
        parts.append((h, row + at))
        at = stop
    h, row = zip(*parts, strict=True)
    return np.concatenate(h), np.concatenate(row)


class Questions:
    """A chunk of the benchmark: its terms, distinct windows by length, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        h, row = terms_of([t for _, t in items])
        self.terms, ids = np.unique(h, return_inverse=True)
        first = np.searchsorted(row, np.arange(len(items) + 1))
        by: dict[tuple[int, ...], set[int]] = {}
        names: dict[str, int] = {}
        for i, (ident, _) in enumerate(items):
            own = tuple(ids[first[i] : first[i + 1]].tolist())
            k = names.setdefault(ident, len(names))
            n = min(window, len(own))
            if n:
                for j in range(len(own) - n + 1):
                    by.setdefault(own[j : j + n], set()).add(k)
        self.names = list(names)
        self.lengths = {}
        for n in sorted({len(w) for w in by}):
            rows = [w for w in by if len(w) == n]
            self.lengths[n] = (np.array(rows, np.int64), [sorted(by[w]) for w in rows])


class Postings:
    """A block's index: its documents' first positions and numbers of words, its terms, and each term's positions in turn.

    Documents are NEAR_SPAN positions apart, so no match crosses them.
    """

    def __init__(self, starts: np.ndarray, sizes: np.ndarray, terms: np.ndarray, first: np.ndarray, positions: np.ndarray) -> None:
        self.starts, self.sizes, self.terms, self.first, self.positions = starts, sizes, terms, first, positions

    @classmethod
    def of(cls, texts: list[str | None]) -> Postings:
        h, row = terms_of(texts)
        sizes = np.bincount(row, minlength=len(texts))
        starts = np.cumsum(sizes + NEAR_SPAN) - sizes - NEAR_SPAN
        at = np.arange(len(h)) + NEAR_SPAN * row
        order = np.argsort(h, kind="stable")
        terms, first = np.unique(h[order], return_index=True)
        return cls(starts, sizes, terms, np.append(first, len(h)), at[order])

    def packed(self) -> list[bytes]:
        return [self.starts.astype(np.uint32).tobytes(), self.sizes.astype(np.uint32).tobytes(), self.terms.tobytes(), self.first.astype(np.uint32).tobytes(), self.positions.astype(np.uint32).tobytes()]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Postings:
        kinds = (np.uint32, np.uint32, np.uint64, np.uint32, np.uint32)
        return cls(*(np.frombuffer(p, k) if k is np.uint64 else np.frombuffer(p, k).astype(np.int64) for p, k in zip(parts, kinds, strict=True)))


class Index:
    """A block's postings of a chunk's terms, by the chunk's numbers: keys of (term, position), sorted."""

    def __init__(self, block: Postings, terms: np.ndarray) -> None:
        at = np.searchsorted(block.terms, terms)
        there = np.flatnonzero(at < len(block.terms))
        there = there[block.terms[at[there]] == terms[there]]
        lo, hi = block.first[at[there]], block.first[at[there] + 1]
        n = hi - lo
        self.count = np.zeros(len(terms), np.int64)
        self.count[there] = n
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        take = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.keys = np.repeat(there, n) << _SHIFT | block.positions[take]

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys

    def phrases(self, windows: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of every exact match, in portions of about most candidates."""
        count = self.count[windows]
        live = np.flatnonzero((count > 0).all(1))
        if not len(live):
            return
        order = np.argsort(count[live], axis=1, kind="stable")
        rare = count[live, order[:, 0]]
        part = np.cumsum(rare) // most
        for k in np.unique(part):
            own = np.flatnonzero(part == k)
            n = rare[own]
            w = np.repeat(own, n)
            term = windows[live[own], order[own, 0]]
            at = np.repeat(self.first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start = (self.keys[at] & ((1 << _SHIFT) - 1)) - order[w, 0]
            for j in range(1, windows.shape[1]):
                off = order[w, j]
                ok = self.has((windows[live[w], off] << _SHIFT) + start + off) & (start >= 0)
                w, start = w[ok], start[ok]
            yield live[w], start

    def near(self, windows: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position of one of its words) of every proximity match, in portions of about most candidates; a match may come more than once.

        A span that lacks at most m words of a window holds one of its m + 1 rarest ones. The first that it holds is the
        candidate, so that those before it count as missing.
        """
        width, mask = windows.shape[1], (1 << _SHIFT) - 1
        miss = width // NEAR_MISS
        nth = np.array([[(w[:j] == w[j]).sum() for j in range(width)] for w in windows])  # how many of the word must be there before
        live = np.flatnonzero((self.count[windows] > nth).sum(1) >= width - miss)
        if not len(live):
            return
        order = np.argsort(self.count[windows[live]], axis=1, kind="stable")
        terms, nth = np.take_along_axis(windows[live], order, 1), np.take_along_axis(nth[live], order, 1)
        words_ = np.full(int((self.keys & mask).max()) + 2 * NEAR_SPAN, -1, np.int64)  # by position, NEAR_SPAN further on
        words_[(self.keys & mask) + NEAR_SPAN] = self.keys >> _SHIFT
        for j in range(miss + 1):
            rare = np.where(nth[:, j] == 0, self.count[terms[:, j]], 0)
            part = np.cumsum(rare) // most
            for k in np.unique(part):
                own = np.flatnonzero((part == k) & (rare > 0))
                n = rare[own]
                w = np.repeat(own, n)
                at = self.keys[np.repeat(self.first[terms[own, j]] - (np.cumsum(n) - n), n) + np.arange(n.sum())] & mask
                lacks = np.full(len(w), j)
                for i in range(j + 1, width):
                    t = terms[w, i]
                    to = np.searchsorted(self.keys, (t << _SHIFT) + np.maximum(at - NEAR_SPAN + 1, 0)) + nth[w, i]
                    lacks += ~((to < self.first[t + 1]) & (self.keys[np.minimum(to, len(self.keys) - 1)] <= (t << _SHIFT) + at + NEAR_SPAN - 1))
                    ok = lacks <= miss
                    w, at, lacks = w[ok], at[ok], lacks[ok]
                for a in range(0, len(w), 1 << 14):  # all spans of NEAR_SPAN words with the candidate in them
                    x, y = w[a : a + (1 << 14)], at[a : a + (1 << 14)]
                    there = words_[y[:, None] + np.arange(1, 2 * NEAR_SPAN)][:, None] == terms[x][:, :, None]
                    sums = np.concatenate((np.zeros((*there.shape[:2], 1), np.int8), np.cumsum(there, 2, dtype=np.int8)), 2)
                    full = ((sums[:, :, NEAR_SPAN:] - sums[:, :, :-NEAR_SPAN]) > nth[x][:, :, None]).sum(1).max(1) >= width - miss
                    yield live[x[full]], y[full]


def answers(block: Postings, q: Questions, near: bool) -> tuple[list[np.ndarray], list[set[str]], list[set[str]]]:
    """Of each document of a block: hit word positions, items with exact matches, items with proximity matches."""
    many = len(block.starts)
    exact: list[set[str]] = [set() for _ in range(many)]
    close: list[set[str]] = [set() for _ in range(many)]
    index = Index(block, q.terms)
    if not len(index.keys):
        return [np.zeros(0, np.int64) for _ in range(many)], exact, close
    change = np.zeros(int(block.starts[-1] + block.sizes[-1]) + 2, np.int32)
    for n, (windows, items) in q.lengths.items():
        for w, start in index.phrases(windows):
            np.add.at(change, start, 1)
            np.add.at(change, start + n, -1)
            doc = np.searchsorted(block.starts, start, "right") - 1
            for d, x in {*zip(doc.tolist(), w.tolist(), strict=True)}:
                exact[d].update(q.names[i] for i in items[x])
    if near:
        for windows, items in q.lengths.values():
            for w, at in index.near(windows):
                doc = np.searchsorted(block.starts, at, "right") - 1
                for d, x in {*zip(doc.tolist(), w.tolist(), strict=True)}:
                    close[d].update(q.names[i] for i in items[x])
    hit = np.cumsum(change) > 0
    return [np.flatnonzero(hit[s : s + n]) for s, n in zip(block.starts, block.sizes, strict=True)], exact, close


def chunks(benchmark: DataFrame, chunk_bytes: int = CHUNK) -> list[str]:
    """benchmark (item_id, text) in the shared folder; paths of chunks of about chunk_bytes."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))
    at = f"{shared_folder(spark)}/benchmark-{uuid.uuid4().hex}"
    items.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.lit(n))).repartition(F.col("chunk")).write.partitionBy("chunk").parquet(at)
    return [f"{at}/chunk={r.chunk}" for r in spark.read.parquet(at).select("chunk").distinct().toLocalIterator()] if total else []


_HERE: dict[tuple, Questions] = {}


def questions(path: str, window: int) -> Questions:
    """The chunk's questions; a worker keeps one chunk."""
    if (path, window) not in _HERE:
        fs, at = store(path)
        t = pads.dataset(at, filesystem=fs, format="parquet").to_table(columns=["item_id", "text"])
        _HERE.clear()
        _HERE[path, window] = Questions(list(zip(*t.to_pydict().values(), strict=True)), window)
    return _HERE[path, window]


def indexed(docs: DataFrame, key: str = "doc_id", block_bytes: int = BLOCK) -> DataFrame:
    """The index of docs (key, text), a row a block, in the shared folder."""
    rows = docs.select(F.col(key).alias("key"), "text")
    names = ["keys", *_PARTS]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size, kind = [], [], 0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(kind)), *(pa.array([x], pa.binary()) for x in Postings.of(texts).packed())], names)

        for b in slices(batches, 1):
            kind = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(k)
                texts.append(t)
                size += len(t or "") + 64
                if size >= block_bytes:
                    yield done()
                    keys, texts, size = [], [], 0
        if keys:
            yield done()

    kind = rows.schema["key"].dataType.simpleString()
    return cut(rows.mapInArrow(f, f"keys array<{kind}>, " + ", ".join(f"{c} binary" for c in _PARTS)), "index", "zstd")


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: bool = True, chunk_bytes: int = CHUNK) -> DataFrame:
    """Of every document of an index: key, n_words, n_hit, hits (start and stop of hit runs, in words), items and near_items, sorted."""
    spark = index.sparkSession
    paths = chunks(benchmark, chunk_bytes)
    runs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    names = ["key", "n_words", "n_hit", "hits", "items", "near_items"]

    def done(keys: pa.Array, block: Postings) -> pa.RecordBatch:
        hits: list = [np.zeros(0, np.int64) for _ in keys]
        exact: list[set[str]] = [set() for _ in keys]
        close: list[set[str]] = [set() for _ in keys]
        for p in paths:
            a, b, c = answers(block, questions(p, window), near)
            for i in range(len(keys)):
                hits[i] = np.union1d(hits[i], a[i]) if len(paths) > 1 else a[i]
                exact[i] |= b[i]
                close[i] |= c[i]
        spans = []
        for h in hits:
            edge = np.flatnonzero(np.diff(h) > 1)
            spans.append([{"start": int(x), "stop": int(y) + 1} for x, y in zip(h[np.concatenate(([0], edge + 1))], h[np.concatenate((edge, [len(h) - 1]))], strict=True)] if len(h) else [])
        cols = [keys, pa.array(block.sizes, pa.int64()), pa.array([len(h) for h in hits], pa.int64()), pa.array(spans, runs), pa.array([sorted(x) for x in exact], pa.list_(pa.string())), pa.array([sorted(x) for x in close], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(cols, names)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield done(b.column(0)[i].values, Postings.unpacked([b.column(j)[i].as_py() for j in range(1, b.num_columns)]))

    kind = index.schema["keys"].dataType.elementType.simpleString()
    out = index.mapInArrow(f, f"key {kind}, n_words long, n_hit long, hits array<struct<start:long,stop:long>>, items array<string>, near_items array<string>")
    return out


def matched(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW, near: bool = True, block_bytes: int = BLOCK, chunk_bytes: int = CHUNK) -> DataFrame:
    """search() of the index of docs, a row for every row of docs (key, text)."""
    return search(indexed(docs, key, block_bytes), benchmark, window, near, chunk_bytes).withColumnRenamed("key", key)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any benchmark window, all columns kept. A slice of BLOCK bytes of a batch is a block, indexed and asked at once."""
    spark = docs.sparkSession
    paths, at = chunks(benchmark), docs.columns.index("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, BLOCK):
            if b.num_rows:
                block, clean = Postings.of(b.column(at).to_pylist()), np.ones(b.num_rows, bool)
                for p in paths:
                    clean &= [not len(h) for h in answers(block, questions(p, WINDOW), False)[0]]
                yield b.filter(pa.array(clean))

    return docs.mapInArrow(f, docs.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's benchmark words and items, and the items that it holds in proximity."""
    got = matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    count, sha = (lambda c: F.size(c).cast("long")), (lambda c: F.sha2(F.array_join(c, ","), 256))
    return got.select("doc_id", "n_words", "n_hit", count("items").alias("n_items"), sha("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), count("near_items").alias("n_near"), sha("near_items").alias("near_sha256"))


OP9_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
win AS MATERIALIZED (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM n)),
ls AS (SELECT DISTINCT l FROM win),
dw AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
m AS MATERIALIZED (SELECT dw.doc_id, dw.i, dw.l, win.item_id FROM dw JOIN win USING (l, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
-- windows for proximity: the words with the number of the same before them, all but one in five of which 20 words must hold
g AS MATERIALIZED (SELECT row_number() OVER () AS win, l, g FROM (SELECT DISTINCT l, g FROM win)),
tok AS MATERIALIZED (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
gw AS (SELECT win, l, unnest(string_split(g, ' ')) AS word FROM g),
gc AS MATERIALIZED (SELECT win, any_value(l) AS l, word, count(*) AS need FROM gw GROUP BY win, word),
freq AS (SELECT word, count(*) AS f FROM tok WHERE word IN (SELECT word FROM gc) GROUP BY word),
-- a span that lacks at most l / 5 words of a window holds one of as many words and one more, whichever are rarest
rk AS MATERIALIZED (SELECT win, l, word FROM (SELECT gc.win, gc.l, gc.word, sum(need) OVER (PARTITION BY gc.win ORDER BY coalesce(f, 0), gc.word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM gc LEFT JOIN freq USING (word)) WHERE coalesce(before, 0) <= l // 5),
cand AS MATERIALIZED (SELECT DISTINCT tok.doc_id, tok.p, rk.win, rk.l FROM tok JOIN rk USING (word)),
-- occurrences of the window's words near a candidate
occ AS (SELECT c.doc_id, c.p, c.win, c.l, gc.word, gc.need, tok.p AS q FROM cand c JOIN gc ON gc.win = c.win JOIN tok ON tok.doc_id = c.doc_id AND tok.word = gc.word AND tok.p BETWEEN c.p - 19 AND c.p + 19),
near AS MATERIALIZED (SELECT doc_id, p, win, l FROM (SELECT doc_id, p, win, any_value(l) AS l, word, least(any_value(need), count(*)) AS have FROM occ GROUP BY doc_id, p, win, word) GROUP BY doc_id, p, win, l HAVING sum(have) >= l - l // 5),
-- each span of 20 words with the candidate in it
span AS (SELECT n.doc_id, n.win, n.l, n.p, s.s, gc.word, least(any_value(gc.need), count(*)) AS have FROM near n, range(20) AS s(s), gc, tok
  WHERE gc.win = n.win AND tok.doc_id = n.doc_id AND tok.word = gc.word AND tok.p BETWEEN n.p - s.s AND n.p - s.s + 19 GROUP BY ALL),
full_ AS (SELECT DISTINCT doc_id, win FROM (SELECT doc_id, win, p, s, l FROM span GROUP BY doc_id, win, p, s, l HAVING sum(have) >= l - l // 5)),
c AS (SELECT doc_id, count(*) AS n_near, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT full_.doc_id, CAST(win.item_id AS VARCHAR) AS item FROM full_ JOIN g ON g.win = full_.win JOIN win ON win.l = g.l AND win.g = g.g) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(t.s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near, coalesce(c.s, sha256('')) AS near_sha256
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""
