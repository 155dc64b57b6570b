"""Scoring whole documents by a gated recurrent language model.

Blocks. Each task cuts its rows into blocks of about BLOCK bytes of text, as they come, whatever their doc_id: no key
decides where a row goes, so none can be hot. A block's texts are split into words once; its distinct words and, for each
token, the number of its word are written to the shared folder, and everything after reads those.

Counts. A block asks shards of the word space for the corpus counts of its distinct words, telling its own counts in
training documents; each shard adds them up and answers each block in the order of its question. So what is gathered
grows with the corpus, a word's count is exact, and a word that every document holds costs one entry a block.

Model. One recurrence reads the most frequent VOCABULARY words; all other words are one of a few shapes (length, letters
beyond ASCII, punctuation at the end), and the end is a token too. A gate mixes the old state with a new one; both come
from the state and the last token. The output softmax is factored by class: first the class, then the member. A word known
by its shape only gets its share of the shape's words, (c + 1) of all of theirs plus one.

Training is truncated backpropagation in numpy over every token of every training document, in ROUNDS rounds: documents are
dealt to rounds by their place in the block, in a round each task trains from the round's start, and the tasks' parameters are averaged by their
numbers of tokens, in a tree, for the next one. No task sees more than its own partition. A task's documents run in LANES
lanes side by side, window by window of WINDOW tokens (of more where few lanes are left), the state carried from one to the
next up to a document's end.

Scores. Each block runs its documents side by side, longest first, window by window, with the state carried to the end
of each document, so the likelihood is the whole document's, however long it is.

Defined cases: a null text is empty and has one token, the end; a null doc_id counts as the empty text for the hash;
repeated rows are documents of their own; without training documents all counts are 0 and the model is untrained.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_bytes, shards, table
from .hashing import words
from .quality_classifier import Lookup

BLOCK, PORTION, WINDOW, STEP, SEED = 16 << 20, 1 << 20, 16, 8192, 5
SHAPES, CLASSES, MEMBERS, HIDDEN, LANES, RATE, FAN_IN = 16, 64, 64, 32, 512, 0.1, 16
OUTPUTS = CLASSES * MEMBERS
VOCABULARY = OUTPUTS - SHAPES - 1
#: Of 16 documents, those of each round.
ROUNDS = ((0, 1), (1, 5), (5, 16))
END, END_SHAPE = np.uint64(0xE2D5E2D5), 255
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:!?|)\"'")] = True
_KINDS = {"x": (OUTPUTS + 1, 2 * HIDDEN), "u": (HIDDEN, 2 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wm": (CLASSES, HIDDEN, MEMBERS), "bm": (CLASSES, MEMBERS)}


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique() with where each is first and each one's place, of hashes: one sort of their high bits with their places in the low ones, where that tells them apart."""
    bits = np.uint64(max(1, len(h).bit_length()))
    at = np.sort((h >> bits << bits) | np.arange(len(h), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))
    at = at.astype(np.int64)
    by = h[at]
    if (by[1:] < by[:-1]).any():  # different hashes with equal high bits
        return np.unique(h, return_index=True, return_inverse=True)
    new = np.ones(len(h), bool)
    new[1:] = by[1:] != by[:-1]
    which = np.empty(len(h), np.int64)
    which[at] = np.cumsum(new) - 1
    return by[new], at[new], which


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, row) of the tokens of lower-cased texts, an end after each."""
    parts, row0, at = [], 0, 0
    while at < len(texts) or not parts:
        n, stop = 0, at
        while stop < len(texts) and (stop == at or n + len(texts[stop]) <= PORTION):
            n += len(texts[stop])
            stop += 1
        own = texts[at:stop]
        data, ends = np.frombuffer(b"".join(own), np.uint8), np.cumsum([len(t) for t in own]).astype(np.int64)
        h, row = words(data, ends, lower=False)
        space = np.zeros(len(data), bool)
        for b in (9, 10, 11, 12, 13, 32):
            space |= data == b
        word = ~space
        begin, stop_ = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        inner = ends[ends < len(data)]
        begin[inner] = word[inner]
        stop_[:-1] &= ~word[1:] | begin[1:]
        start, end = np.flatnonzero(begin), np.flatnonzero(stop_) + 1
        high = np.concatenate(([0], np.cumsum(data >= 128, dtype=np.int32)))
        shape = (np.minimum((end - start - 1) // 4, 3) + 4 * (high[end] > high[start]) + 8 * _STOPS[data[end - 1]]).astype(np.uint8) if len(h) else np.zeros(0, np.uint8)
        count = np.bincount(row, minlength=len(own))
        size = count + 1
        first = np.cumsum(size) - size
        hh, ss = np.full(size.sum(), END, np.uint64), np.full(size.sum(), END_SHAPE, np.uint8)
        to = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        hh[to], ss[to] = h, shape
        parts.append((hh, ss, np.repeat(np.arange(len(own)) + row0, size)))
        row0, at = row0 + len(own), stop
        if at >= len(texts):
            break
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


BLOCKS = "block long, ids array<long>, held array<boolean>, sizes binary, tokens binary, shard int, words binary, counts binary, shapes binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("tokens", pa.binary()), ("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("shapes", pa.binary())])


def blocks(n: int, block_bytes: int):
    """A map of (doc_id, text, held_out) to blocks: one row of the documents' sizes and tokens, numbers of distinct words, and rows of the words and their counts in training documents by shard of the word space."""

    def done(block: int, ids: list, held: list, texts: list) -> Iterator[pa.RecordBatch]:
        h, shape, row = tokens([lower_bytes(x) for x in texts])
        own, first, which = distinct(h)
        count = np.bincount(which, ~np.array(held, bool)[row], len(own)).astype(np.int64)
        sizes, shape = np.bincount(row, minlength=len(ids)).astype(np.int32), shape[first]
        yield pa.RecordBatch.from_pydict({"block": [block], "ids": [ids], "held": [held], "sizes": [sizes.tobytes()], "tokens": [which.astype(np.uint32).tobytes()], "shard": [None], "words": [own.tobytes()], "counts": [None], "shapes": [shape.tobytes()]}, _BLOCKS)
        edge = np.searchsorted(own, (np.arange(n + 1, dtype=np.float64) / n * 2.0**64).clip(0, 2.0**64 - 2048).astype(np.uint64))
        edge[-1] = len(own)
        some = [(s, a, b) for s, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if b > a]
        cols = [[x[a:b].tobytes() for _, a, b in some] for x in (own, count, shape)]
        none = [None] * len(some)
        yield pa.RecordBatch.from_pydict({"block": [block] * len(some), "ids": none, "held": none, "sizes": none, "tokens": none, "shard": [s for s, _, _ in some], "words": cols[0], "counts": cols[1], "shapes": cols[2]}, _BLOCKS)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held, texts, size = TaskContext.get().partitionId() << 24, [], [], [], 0
        for b in batches:
            for i, t, o in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids.append(i)
                texts.append(t)
                held.append(o)
                size += len(t or "") + 64
                if size >= block_bytes:
                    yield from done(block, ids, held, texts)
                    block, ids, held, texts, size = block + 1, [], [], [], 0
        if ids:
            yield from done(block, ids, held, texts)

    return f


def answered(vocabulary: int):
    """A grouped map: one shard's counts, in the order each block asked, and what the model needs of all."""

    def f(t: pa.Table) -> pa.Table:
        asked_ = [np.frombuffer(x.as_py(), np.uint64) for x in t["words"]]
        every = np.concatenate(asked_)
        own, first, which = distinct(every)
        total = np.bincount(which, np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t["counts"]]), len(own)).astype(np.int64)
        shape = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t["shapes"]])[first]
        ends = np.cumsum([len(x) for x in asked_])
        back = [total[which[e - len(x) : e]].tobytes() for e, x in zip(ends, asked_, strict=True)]
        n = np.bincount(shape, total, 256).astype(np.int64)
        v = np.bincount(shape, total > 0, 256).astype(np.int64)
        top = np.lexsort((own, -total))[:vocabulary]
        top = top[(total[top] > 0) & (own[top] != END)]
        rows, none = len(back), [None] * len(back)
        return pa.table({
            "block": pa.array([*t["block"].to_pylist(), None], pa.int64()), "shard": pa.array([t["shard"][0].as_py()] * (rows + 1), pa.int32()), "counts": pa.array([*back, total[top].tobytes()], pa.binary()),
            "words": pa.array([*none, own[top].tobytes()], pa.binary()), "shapes": pa.array([*none, shape[top].tobytes()], pa.binary()), "sums": pa.array([*none, np.stack([n, v]).tobytes()], pa.binary()),
        })

    return f


def best(rows: list[dict], vocabulary: int) -> tuple[np.ndarray, ...]:
    """(words, counts, shapes, sums): the most frequent words of shards' summaries, and the sums by shape."""
    sums = sum((np.frombuffer(r["sums"], np.int64).reshape(2, 256) for r in rows), np.zeros((2, 256), np.int64))
    word, count, shape = (np.concatenate([np.frombuffer(r[c], t) for r in rows] or [np.zeros(0, t)]) for c, t in (("words", np.uint64), ("counts", np.int64), ("shapes", np.uint8)))
    top = np.lexsort((word, -count))[:vocabulary]
    return word[top], count[top], shape[top], sums


def merged(vocabulary: int):
    """A grouped map: summaries of up to FAN_IN shards as one."""

    def f(t: pa.Table) -> pa.Table:
        word, count, shape, sums = best(t.to_pylist(), vocabulary)
        return pa.table({"shard": pa.array([t["shard"][0].as_py() // FAN_IN], pa.int32()), "words": [word.tobytes()], "counts": [count.tobytes()], "shapes": [shape.tobytes()], "sums": [sums.tobytes()]})

    return f


class Known:
    """What counting gives: N, V, the model's words with counts, and the mass of each shape's other words."""

    def __init__(self, rows: list, vocabulary: int) -> None:
        self.words, self.counts, self.shapes, sums = best(rows, vocabulary)
        self.n, self.v = int(sums[0].sum()), int(sums[1].sum())
        mass = (sums[0] + sums[1]).astype(np.float64)
        np.subtract.at(mass, self.shapes, (self.counts + 1).astype(np.float64))
        self.mass = mass[:SHAPES] + 1
        self.ends = int(sums[0, END_SHAPE])

    def frequencies(self) -> np.ndarray:
        """Of the model's tokens, by id, smoothed."""
        out = np.zeros(OUTPUTS)
        out[: len(self.counts)] = self.counts
        out[VOCABULARY : VOCABULARY + SHAPES], out[-1] = self.mass, self.ends
        return out + 0.5

    def ids(self, lookup: Lookup, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """The model's token ids: words by frequency, then shapes, then the end."""
        own = lookup.get(h, -1.0).astype(np.int32)
        return np.where(shape == END_SHAPE, OUTPUTS - 1, np.where(own >= 0, own, VOCABULARY + (shape & (SHAPES - 1)).astype(np.int32))).astype(np.int32)

    def lookup(self) -> Lookup:
        return Lookup(self.words, np.arange(len(self.words), dtype=np.float32))


def run_sums(rows: np.ndarray, first: np.ndarray, long: int = 8) -> np.ndarray:
    """Sums of the runs of rows that begin at first: a product for each run of more than long rows, the others together, row by row of a run."""
    size = np.diff(np.append(first, len(rows)))
    out, one = rows[first], np.ones(size.max(initial=0), rows.dtype)
    for i in np.flatnonzero(size > long):
        out[i] = one[: size[i]] @ rows[first[i] : first[i] + size[i]]
    for j in range(1, long):
        at = np.flatnonzero((size > j) & (size <= long))
        out[at] += rows[first[at] + j]
    return out


class Gated:
    """Parameters: gate and new state by token (x) and by state (u), outputs of class (wc, bc) and member (wm, bm). Ids are dealt to classes in turn of their number.

    With a and b the two halves of x[token] + h u: z = (1 + tanh a) / 2, and the state is z h + (1 - z) tanh b. Steps are
    Adagrad's, whose sums (v) travel with the parameters; of x only the window's rows are touched.
    """

    def __init__(self, p: dict[str, np.ndarray] | None = None, v: dict[str, np.ndarray] | None = None, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.p = p or {k: (rng.normal(size=s) * 0.15).astype(np.float32) if len(s) > 1 and k != "bm" else np.zeros(s, np.float32) for k, s in _KINDS.items()}
        self.v = v or {k: np.full(s, 1e-10, np.float32) for k, s in _KINDS.items()}

    @classmethod
    def start(cls, known: Known) -> Gated:
        """Untrained, but with outputs that begin at the tokens' frequencies."""
        new = cls()
        by = known.frequencies().reshape(CLASSES, MEMBERS)
        new.p["bc"] = np.log(by.sum(1) / by.sum()).astype(np.float32)
        new.p["bm"] = np.log(by / by.sum(1, keepdims=True)).astype(np.float32)
        return new

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The next states, from rows x of the table and states h."""
        g = h @ self.p["u"]
        g += x
        np.tanh(g, out=g)
        z, new = g[:, :HIDDEN], g[:, HIDDEN:]
        z += 1
        z *= 0.5
        return new + z * (h - new)

    def output(self, h: np.ndarray, y: np.ndarray, back: bool = False):
        """ln P(y | h) of rows, and gradients of their negative sum where asked."""
        klass, member = np.divmod(y, MEMBERS)
        rows, one = np.arange(len(y)), np.ones(max(CLASSES, MEMBERS, len(y)), h.dtype)
        # states are within 1, so that the parameters bound what is raised to a power
        high = not all((np.abs(self.p[w]).sum(-2) + np.abs(self.p[b])).max() <= 60 for w, b in (("wc", "bc"), ("wm", "bm")))

        def soft(q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(logarithms at the targets, sums of exponentials); q becomes exponentials."""
            if high:
                np.minimum(q, 60, out=q)  # exponentials stay finite; nothing real is cut
            own = q[rows[: len(q)], at]
            np.exp(q, out=q)
            total = q @ one[: q.shape[1]]
            return own - np.log(total), total

        q = h @ self.p["wc"]
        q += self.p["bc"]
        out, total = soft(q, klass)
        order = np.argsort(klass.astype(np.uint8), kind="stable")
        edge = np.searchsorted(klass[order], np.arange(CLASSES + 1))
        inner, hs, ms = np.empty(len(y), h.dtype), h[order], member[order]
        if back:
            q /= total[:, None]
            q[rows, klass] -= 1
            grad = {"wc": h.T @ q, "bc": one[: len(q)] @ q, "wm": np.zeros_like(self.p["wm"]), "bm": np.zeros_like(self.p["bm"])}
            dh, di = q @ self.p["wc"].T, np.empty_like(hs)
        for k in np.flatnonzero(np.diff(edge)):
            a, b = edge[k], edge[k + 1]
            f = hs[a:b] @ self.p["wm"][k]
            f += self.p["bm"][k]
            inner[a:b], sums = soft(f, ms[a:b])
            if back:
                f /= sums[:, None]
                f[rows[: b - a], ms[a:b]] -= 1
                grad["wm"][k], grad["bm"][k] = hs[a:b].T @ f, one[: b - a] @ f
                di[a:b] = f @ self.p["wm"][k].T
        out[order] += inner
        if not back:
            return out
        dh[order] += di
        return out, grad, dh

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict, np.ndarray]:
        """(state to carry, gradients of the mean loss, losses) of one window [time, lane]; x's gradient is (rows, values).

        The state is cleared where x is the start; a y below 0 is no target.
        """
        steps, lanes = x.shape
        cleared = x == OUTPUTS
        goes_on, some = (~cleared)[:, :, None].astype(h.dtype), cleared.any(1)
        # gates and new states apart: each lies in one piece
        g = np.ascontiguousarray(self.p["x"].take(x.ravel(), 0).reshape(steps, lanes, 2, HIDDEN).transpose(2, 0, 1, 3))
        befores, afters = np.empty((2, steps, lanes, HIDDEN), h.dtype)
        ut, part = np.ascontiguousarray(self.p["u"].T), np.empty((lanes, HIDDEN), h.dtype)
        us = [np.ascontiguousarray(self.p["u"][:, i : i + HIDDEN]) for i in (0, HIDDEN)]
        for t in range(steps):
            before = befores[t]
            if some[t]:
                np.multiply(h, goes_on[t], out=before)
            else:
                before[:] = h
            gate, new = g[:, t]
            for now, u in ((gate, us[0]), (new, us[1])):
                now += np.matmul(before, u, out=part)
                np.tanh(now, out=now)
            h = afters[t]
            # ((1 + gate) before + (1 - gate) new) / 2
            np.subtract(before, new, out=h)
            h *= gate
            h += before
            h += new
            h *= 0.5
        targets, states = y.ravel(), afters.reshape(-1, HIDDEN)
        real = np.flatnonzero(targets >= 0)
        log, grad, part = self.output(states[real], targets[real], True)
        dh = np.zeros((steps * lanes, HIDDEN), h.dtype)
        dh[real] = part
        dh = dh.reshape(steps, lanes, HIDDEN)
        d = np.empty((steps, lanes, 2, HIDDEN), h.dtype)
        carry = np.zeros((lanes, HIDDEN), h.dtype)
        keep, less, own = np.empty((3, lanes, HIDDEN), h.dtype)
        for t in range(steps - 1, -1, -1):
            gate, new = g[:, t]
            carry += dh[t]
            np.add(gate, 1, out=keep)
            keep *= 0.5
            np.subtract(1, keep, out=less)
            less *= carry
            # of the new state: less (1 - new²); of the gate: 2 less keep (before - new)
            np.multiply(less, new, out=own)
            own *= new
            np.subtract(less, own, out=d[t, :, 1])
            np.subtract(befores[t], new, out=own)
            own *= keep
            own *= less
            np.multiply(own, 2, out=d[t, :, 0])
            carry *= keep
            carry += np.matmul(d[t].reshape(lanes, -1), ut, out=own)
            if some[t]:
                carry *= goes_on[t]
        flat = d.reshape(-1, 2 * HIDDEN)
        grad["u"] = befores.reshape(-1, HIDDEN).T @ flat
        ids = x.ravel()
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        scale = 1 / len(real)
        grad = {k: v * np.float32(scale) for k, v in grad.items()}
        grad["x"] = ids[order[first]], run_sums(flat[order], first) * np.float32(scale)
        return h, grad, log

    def learn(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
        """One window of truncated backpropagation and a step; the state to carry and the mean loss."""
        h, grad, log = self.gradients(x, y, h)
        at, g = grad.pop("x")
        v = self.v["x"][at] + g * g
        self.v["x"][at] = v
        self.p["x"][at] -= rate * g / np.sqrt(v)
        for k, g in grad.items():
            self.v[k] += g * g
            g /= np.sqrt(self.v[k])
            g *= rate
            self.p[k] -= g
        return h, -float(log.mean())

    def packed(self) -> bytes:
        return b"".join(x[k].astype(np.float32).tobytes() for x in (self.p, self.v) for k in _KINDS)

    @classmethod
    def unpacked(cls, data: bytes) -> Gated:
        flat, out, at = np.frombuffer(data, np.float32), [], 0
        for _ in range(2):
            out.append({})
            for k, s in _KINDS.items():
                n = int(np.prod(s))
                out[-1][k], at = flat[at : at + n].reshape(s).copy(), at + n
        return cls(*out)


class Lanes:
    """Documents' tokens in lanes, one document after the other in each."""

    def __init__(self, lanes: int = LANES) -> None:
        self.kept: list[list[np.ndarray]] = [[] for _ in range(lanes)]
        self.size = np.zeros(lanes, np.int64)

    def add(self, ids: np.ndarray, row: np.ndarray) -> None:
        """Documents of ids by row, the longest first, each to the shortest lane."""
        first = np.flatnonzero(np.diff(row, prepend=-1))
        size = np.diff(np.append(first, len(row)))
        both = np.stack((np.concatenate(([OUTPUTS], ids[:-1])), ids)).astype(np.int32)  # inputs, targets
        both[0, first] = OUTPUTS  # the start
        for i in np.argsort(-size, kind="stable"):
            to = int(self.size.argmin())
            self.kept[to].append(both[:, first[i] : first[i] + size[i]])
            self.size[to] += size[i]

    def windows(self, rest: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(lanes, inputs [time, lane], targets) of every window that fills all lanes, and of all that is left where asked; targets behind a lane's last token are -1."""
        while True:
            live = np.flatnonzero(self.size) if rest else np.arange(len(self.size))
            if not len(live):
                return
            window = max(WINDOW, STEP // len(live)) if rest else WINDOW  # fewer lanes, longer windows
            many = int(self.size[live].min()) // window
            if not many and not rest:
                return
            n = max(1, many) * window
            got = np.full((2, n, len(live)), -1, np.int32)
            got[0] = OUTPUTS
            for j, i in enumerate(live):
                own = np.concatenate(self.kept[i], 1)
                have = min(n, own.shape[1])
                got[:, :have, j] = own[:, :n]
                self.kept[i] = [own[:, n:]] if own.shape[1] > n else []
                self.size[i] -= have
            for a in range(0, n, window):
                yield live, got[0, a : a + window], got[1, a : a + window]


def train(model: Gated, lanes: Lanes, state: np.ndarray, rate: float, rest: bool = False) -> tuple[int, float]:
    """Learns the lanes' windows, changing state; (tokens, sum of their losses). A window that isn't full takes as much smaller a step."""
    tokens_, loss = 0, 0.0
    for live, x, y in lanes.windows(rest):
        n = int((y >= 0).sum())
        state[live], one = model.learn(x, y, state[live], rate * min(1.0, n / STEP))
        tokens_, loss = tokens_ + n, loss + n * one
    return tokens_, loss


def learned(params: bytes, rate: float, shared, places: tuple[int, int] = (0, 16)):
    """A map of blocks (held, sizes, tokens, words, shapes) to one row: this task's parameters after all tokens of the training documents whose places, by 16, are in the range, and their number."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know: Known = shared.value
        lookup, model = know.lookup(), Gated.unpacked(params)
        lanes, state, n = Lanes(), np.zeros((LANES, HIDDEN), np.float32), 0
        for b in batches:
            for i in range(b.num_rows):
                held, sizes, which, own, shapes = (b.column(j)[i].as_py() for j in range(5))
                sizes, ids = np.frombuffer(sizes, np.int32), know.ids(lookup, np.frombuffer(own, np.uint64), np.frombuffer(shapes, np.uint8))
                place = np.arange(len(sizes)) % 16
                chosen = np.flatnonzero(~np.array(held, bool) & (place >= places[0]) & (place < places[1]))
                which, first = np.frombuffer(which, np.uint32), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
                for part in np.array_split(chosen, max(1, sizes[chosen].sum(dtype=np.int64) // (8 * STEP))):
                    if len(part):
                        lanes.add(ids[np.concatenate([which[first[d] : first[d + 1]] for d in part])], np.repeat(part, sizes[part]))
                    if int(lanes.size.sum()) >= 16 * STEP:
                        n += train(model, lanes, state, rate)[0]
        n += train(model, lanes, state, rate, True)[0]
        if n:
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([float(n)]), "params": pa.array([model.packed()], pa.binary())})

    return f


def averaged(t: pa.Table) -> pa.Table:
    n = t["n"].to_numpy()
    mean = sum(w * np.frombuffer(p.as_py(), np.float32).astype(np.float64) for w, p in zip(n, t["params"], strict=True)) / n.sum()
    return pa.table({"task": pa.array([t["task"][0].as_py() // FAN_IN], pa.int64()), "n": [n.sum()], "params": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def tree(rows: DataFrame, number: str, merge, last: int) -> DataFrame:
    """rows numbered up to last, merged FAN_IN at a time until one is left."""
    left = last + 1
    while left > 1:
        rows = cut(rows.groupBy(F.floor(F.col(number) / FAN_IN).alias("g")).applyInArrow(merge, rows.schema), "tree")
        left = -(-left // FAN_IN)
    return rows


def trained(texts: DataFrame, known: Known, shared) -> bytes:
    """The model's parameters, from the training documents of blocks (held, sizes, tokens, words, shapes)."""
    schema, params = "task long, n double, params binary", Gated.start(known).packed()
    for places in ROUNDS:
        got = cut(texts.select("held", "sizes", "tokens", "words", "shapes").mapInArrow(learned(params, RATE, shared, places), schema), "models")
        one = tree(got, "task", averaged, got.agg(F.max("task")).first()[0] or 0).first()
        params = bytes(one["params"]) if one else params
    return params


def likelihood(model: Gated, ids: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """ln probability of each row's whole token sequence; rows run side by side, the longest first, state carried."""
    first = np.searchsorted(row, np.arange(rows + 1))
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], first[:-1][order]
    out, h, before = np.zeros(rows), np.zeros((rows, HIDDEN), np.float32), np.full(rows, OUTPUTS, np.int32)
    table_ = model.p["x"]
    t, longest = 0, int(size[0]) if rows else 0
    active = rows
    while t < longest:
        states, targets, whose, held = [], [], [], 0
        while held < 4 * STEP:
            while active and size[active - 1] <= t:
                active -= 1
            if not active:
                break
            h = model.step(table_[before[:active]], h[:active])
            before = ids[first[:active] + t]
            states.append(h)
            targets.append(before)
            whose.append(active)
            held += active
            t += 1
        log = model.output(np.concatenate(states), np.concatenate(targets))
        out[: whose[0]] += np.bincount(np.concatenate([np.arange(n) for n in whose]), log, whose[0])
    back = np.empty(rows)
    back[order] = out
    return back


def scored(params: bytes, shared):
    """A cogrouped map: a block and its answers to each document's scores."""

    def f(block: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not block.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        known: Known = shared.value
        docs, held = (block[c].combine_chunks().flatten() for c in ("ids", "held"))
        n, which, own, shapes = (np.frombuffer(block[c][0].as_py(), t) for c, t in (("sizes", np.int32), ("tokens", np.uint32), ("words", np.uint64), ("shapes", np.uint8)))
        counts = np.concatenate([np.frombuffer(answers["counts"][int(i)].as_py(), np.int64) for i in np.argsort(answers["shard"].to_numpy())])
        rows = len(docs)
        row = np.repeat(np.arange(rows), n)
        # of each word, then of each token
        log, word = np.log10(counts + 1.0), known.ids(known.lookup(), own, shapes)
        base = np.bincount(row, log[which], rows) - n * np.log10(known.n + known.v + 1.0)
        tail = (word >= VOCABULARY) & (word < OUTPUTS - 1)
        inside = np.where(tail, log - np.log10(known.mass)[np.where(tail, word - VOCABULARY, 0)], 0.0)
        score = likelihood(Gated.unpacked(params), word[which], row, rows) / np.log(10) + np.bincount(row, inside[which], rows)
        return pa.table([docs, held, pa.array(n, pa.int64()), pa.array(np.bincount(row, (counts > 0)[which], rows).astype(np.int64)), pa.array(np.full(rows, known.n)), pa.array(base), pa.array(score)], names)

    return f


def score(docs: DataFrame, key: str = "doc_id", block_bytes: int = BLOCK) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (key, text)."""
    spark = docs.sparkSession
    ident = F.col(key).cast("long")
    rows = docs.select(ident.alias("doc_id"), "text", (F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % 7 == 2).alias("held_out"))
    parts = shards(spark)
    dealt = cut(rows.mapInArrow(blocks(parts, block_bytes), BLOCKS), "blocks", "zstd")
    texts, questions = dealt.where("shard is null").drop("shard", "counts"), dealt.where("shard is not null").select("block", "shard", "words", "counts", "shapes")
    answers = cut(questions.groupBy("shard").applyInArrow(answered(VOCABULARY), "block long, shard int, counts binary, words binary, shapes binary, sums binary"), "answers")
    summary = tree(answers.where("block is null").select("shard", "words", "counts", "shapes", "sums"), "shard", merged(VOCABULARY), parts - 1)
    known = Known([r.asDict() for r in summary.collect()], VOCABULARY)  # a row of VOCABULARY words
    shared = spark.sparkContext.broadcast(known)  # VOCABULARY words
    params = trained(texts, known, shared)
    out = texts.groupBy("block").cogroup(answers.where("block is not null").select("block", "shard", "counts").groupBy("block")).applyInArrow(scored(params, shared), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", key)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-likelihood."""
    return score(table(spark, sf_dir, "documents"))
