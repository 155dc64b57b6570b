"""Secret scans by one combined deterministic automaton.

All rules' expressions are compiled together: parsed into one nondeterministic automaton over bytes, made deterministic
by subset construction, minimised by partition refinement, and kept as one array of transitions, 256 a state.

A text is scanned in a single byte pass for all rules at once, from its end: the combined automaton of the reversed
expressions tells at each byte which rules have a match that starts there. Accepting states have the highest numbers, so a
byte costs one array lookup and one comparison. From a start on, the combined automaton of the expressions finds the longest
match; starts that lie in a rule's last match are passed over, so matches are leftmost, longest and don't overlap.

Expressions hold whole matches; a rule's least length is checked after matching, as matches that fail it still use up their
text. A rule without a head is a run of one class: its longest match holds all starts in it, so only starts of runs that are
long enough are looked for.

Defined cases: a null text is empty and has no spans; offsets are code points, the end exclusive; repeated rows are
scanned each for itself. Memory: one Arrow batch of texts; the automaton is a fixed table.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table


@dataclass(frozen=True)
class Rule:
    """kind; its expression; the tail whose repeat must reach least to count (the expression's last class with +)."""

    kind: str
    head: str
    tail: str
    least: int
    fold: bool = False

    def whole(self, least: int = 1) -> str:
        return f"{self.head}{self.tail}{{{least},}}" if self.tail else self.head


#: The rules that every result has. least counts the tail's characters: AKIA and 12 more make 16.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 8, fold=True),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32),
)
#: What the method adds: public formats of access tokens and private keys.
MORE = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 16),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", "", 0),
)


class _Nfa:
    """Thompson's construction over bytes, for literals, classes, groups, |, ?, *, +, {n}, {n,} and \\xHH."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.on.append(None)
        return len(self.on) - 1

    def add(self, pattern: str, fold: bool) -> tuple[int, int]:
        self.p, self.i, self.fold = pattern, 0, fold
        out = self.either()
        if self.i != len(pattern):
            raise ValueError(f"can't read {pattern!r} at {self.i}")
        return out

    def either(self) -> tuple[int, int]:
        ways = [self.row()]
        while self.p[self.i : self.i + 1] == "|":
            self.i += 1
            ways.append(self.row())
        if len(ways) == 1:
            return ways[0]
        a, b = self.state(), self.state()
        for x, y in ways:
            self.empty[a].append(x)
            self.empty[y].append(b)
        return a, b

    def row(self) -> tuple[int, int]:
        a = b = self.state()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            x, y = self.times()
            self.empty[b].append(x)
            b = y
        return a, b

    def times(self) -> tuple[int, int]:
        at = self.i
        x, y = self.one()
        mark = self.p[self.i : self.i + 1]
        if mark and mark in "?*+":
            self.i += 1
            a, b = self.state(), self.state()
            self.empty[a].append(x)
            self.empty[y].append(b)
            if mark in "?*":
                self.empty[a].append(b)
            if mark in "*+":
                self.empty[y].append(x)
            return a, b
        if mark == "{":
            end = self.p.index("}", self.i)
            least, more, most = self.p[self.i + 1 : end].partition(",")
            if most:
                raise ValueError("{n,m} isn't read")
            for _ in range(int(least) - 1):
                self.i = at
                u, v = self.one()
                self.empty[y].append(u)
                y, last = v, u
            if more:
                self.empty[y].append(last if int(least) > 1 else x)
            self.i = end + 1
        return x, y

    def one(self) -> tuple[int, int]:
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            out = self.either()
            self.i += 1
            return out
        if c == "[":
            end = self.p.index("]", self.i + 1)
            self.i += 1
            found: set[int] = set()
            while self.i < end:
                lo = self.byte()
                if self.p[self.i] == "-" and self.i + 1 < end:
                    self.i += 1
                    found.update(range(lo, self.byte() + 1))
                else:
                    found.add(lo)
            self.i = end + 1
        else:
            found = {self.byte()}
        if self.fold:
            found |= {b ^ 32 for b in found if 65 <= b & ~32 <= 90}
        a, b = self.state(), self.state()
        self.on[a] = (frozenset(found), b)
        return a, b

    def byte(self) -> int:
        if self.p[self.i] == "\\" and self.p[self.i + 1] == "x":
            self.i += 4
            return int(self.p[self.i - 2 : self.i], 16)
        self.i += 1 + (self.p[self.i] == "\\")
        return ord(self.p[self.i - 1])


def compiled(patterns: list[tuple[str, bool]], backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(next states [state, byte], bit mask of patterns by state) of the least automaton; it starts in state 0.

    Backward: reads a text from its end, and the mask tells which patterns have a match that starts at the byte read last.
    Forward: reads from a match's first byte, and the mask tells which patterns the bytes so far are; nothing leaves state 1.
    """
    n = _Nfa()
    ends = [n.add(p, fold) for p, fold in patterns]
    if backward:
        goal, roots = {a: 1 << k for k, (a, _) in enumerate(ends)}, [b for _, b in ends]
        into: list[list[tuple[frozenset[int], int]]] = [[] for _ in n.on]
        empty: list[list[int]] = [[] for _ in n.on]
        for s, on in enumerate(n.on):
            if on:
                into[on[1]].append((on[0], s))
            for t in n.empty[s]:
                empty[t].append(s)
    else:
        goal, roots = {b: 1 << k for k, (_, b) in enumerate(ends)}, [a for a, _ in ends]
        into, empty = [[on] if on else [] for on in n.on], n.empty
    # bytes that no class tells apart are one letter
    kinds = {s[0] for s in n.on if s}
    marks = [tuple(b in k for k in kinds) for b in range(256)]
    letters = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    letter, by_letter = np.array([letters[m] for m in marks]), [marks.index(m) for m in letters]

    @lru_cache(None)
    def closed(s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(t for t in seen if into[t] or t in goal)

    first = frozenset().union(*map(closed, roots))
    always = first if backward else frozenset()
    known, rows, todo = {first: 0}, [], [first]
    if not backward:
        known[frozenset()] = 1
        todo.append(frozenset())
    for states in todo:  # grows
        row = []
        for b in by_letter:
            to = set(always)
            for s in states:
                for on, t in into[s]:
                    if b in on:
                        to |= closed(t)
            to = frozenset(to)
            if to not in known:
                known[to] = len(known)
                todo.append(to)
            row.append(known[to])
        rows.append(row)
    move = np.array(rows)
    accept = np.array([sum({goal[s] for s in states if s in goal}) for states in todo], np.int64)
    # refine by accepted rules, then by the classes that each letter leads to, until nothing splits
    part = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[move]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    # states 0 and 1 stay first, accepting ones go last
    order = sorted(dict.fromkeys(part.tolist()), key=lambda x: accept[np.argmax(part == x)] > 0)
    rank = np.empty(len(order), int)
    rank[order] = range(len(order))
    part = rank[part]
    pick = np.unique(part, return_index=True)[1]
    return part[move[pick]][:, letter], accept[pick]


@lru_cache(4)
def tables(rules: tuple[Rule, ...]) -> tuple:
    """The combined automata's arrays, backward and forward; made once, on the driver. Forward, heads follow the rules' whole matches."""
    starts = compiled([(r.whole() if r.head or not r.tail else r.whole(r.least), r.fold) for r in rules], True)
    heads = [(r.head, r.fold) if r.head and r.tail else None for r in rules]
    return rules, starts, compiled([*((r.whole(), r.fold) for r in rules), *filter(None, heads)], False), [h is not None for h in heads]


class Scanner:
    """Scans texts by the arrays of tables(); states are numbered in steps of 256, so a state and a byte add up to a place."""

    def __init__(self, made: tuple) -> None:
        self.rules, (move, starts), (onward, self.ends), heads = made
        self.back, self.onward = array("l", (move * 256).ravel().tolist()), array("l", (onward * 256).ravel().tolist())
        self.low, self.starts = 256 * int(np.argmax(starts > 0)), starts.tolist()
        if not (starts[self.low // 256 :] > 0).all() or starts[0]:
            raise ValueError("a rule matches the empty text")
        self.ends = self.ends.tolist()
        place = iter(range(len(self.rules), 2 * len(self.rules)))
        self.heads = [1 << next(place) if h else 0 for h in heads]

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then by the rules' order."""
        data = (text or "").encode("utf-8", "surrogatepass")
        move, low, state, hits = self.back, self.low, 0, []
        for at, b in zip(range(len(data) - 1, -1, -1), reversed(data), strict=True):
            state = move[state + b]
            if state >= low:
                hits.append((at, state))
        if not hits:
            return []
        points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
        used, out = [0] * len(self.rules), []
        for at, state in reversed(hits):
            mask = self.starts[state >> 8]
            for k, r in enumerate(self.rules):
                if mask >> k & 1 and at >= used[k]:
                    end, tail = self.match(data, at, k)
                    used[k] = end
                    if not r.least or end - tail >= r.least:
                        out.append((int(points[at]), k, r.kind, int(points[end])))
        return [(kind, a, b) for a, _, kind, b in sorted(out)]

    def match(self, data: bytes, at: int, k: int) -> tuple[int, int]:
        """(end of rule k's longest match from at on, start of its tail: where its longest head ends that leaves a tail)."""
        move, ends, whole, head = self.onward, self.ends, 1 << k, self.heads[k]
        state, end, tail, last = 0, at, at, at
        for i in range(at, len(data)):
            state = move[state + data[i]]
            if state == 256:
                break
            mask = ends[state >> 8]
            if mask & whole:
                end, tail = i + 1, last
            if mask & head:
                last = i + 1
        return end, tail


_HERE: dict = {}


def scanner(shared) -> Scanner:
    """The worker's scanner for the driver's broadcast tables (bounded by the rules, not by the data)."""
    made = shared.value
    if made[0] not in _HERE:
        _HERE[made[0]] = Scanner(made)
    return _HERE[made[0]]


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, key: str = "doc_id") -> DataFrame:
    """key and found, an array of (kind, start, stop), for every row of docs (key, text)."""
    rows = docs.select(F.col(key).alias("key"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(tables(rules))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(shared).spans
        for b in slices(batches, 1):
            found = [[{"kind": k, "start": x, "stop": y} for k, x, y in find(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["key", "found"])

    return rows.mapInArrow(f, f"key {rows.schema['key'].dataType.simpleString()}, found array<struct<kind:string,start:bigint,stop:bigint>>").withColumnRenamed("key", key)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with each found span of text replaced by its kind in brackets; overlapping spans are replaced as one. n_chars, where there is one, follows."""

    shared = docs.sparkSession.sparkContext.broadcast(tables(rules))

    def clean(text: str | None, find) -> str | None:
        if not text or not (found := find(text)):
            return text
        out, at, end = [], 0, 0
        for k, a, b in found:
            if a >= end:
                out += [text[end:a], f"[{k}]"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    at = docs.columns.index("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(shared).spans
        for b in slices(batches, at):
            yield b.set_column(at, b.schema.field(at), pa.array([clean(t.as_py(), find) for t in b.column(at)], b.schema.field(at).type))

    out = docs.mapInArrow(f, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    docs = table(spark, sf_dir, "documents")
    base, shared = {r.kind for r in BASE}, spark.sparkContext.broadcast(tables(BASE + MORE))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(shared).spans
        for b in slices(batches, 1):
            found = [find(t.as_py()) for t in b.column(1)]
            own = [[s for s in x if s[0] in base] for x in found]
            counts = [pa.array([sum(s[0] == r.kind for s in x) for x in own], pa.int64()) for r in BASE]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in own]), pa.array([joined(x) for x in found])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(f, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _sql() -> str:
    """Every rule by DuckDB's own expressions: matches are put between marks, and lengths before a mark give its place."""
    letters = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    head = {"assign": "(?:" + "|".join(map(letters, ("password", "passwd", "secret", "token"))) + "|" + letters("api") + "_?" + letters("key") + r""")["']?\x20*[:=]\x20*["']?"""}
    parts = []
    for k, r in enumerate(BASE + MORE):
        first, tail = head.get(r.kind, r.head).replace("'", "''"), r.tail + "+" if r.tail else ""
        good = f"length(regexp_extract(hit, '^{first}({tail})', 1)) >= {r.least}" if r.tail else "true"
        parts.append(f"SELECT r, kind, k, since AS a, since + length(hit) AS b FROM (SELECT r, '{r.kind}' AS kind, {k} AS k, x[1] AS hit, i, since FROM (SELECT r, i, string_split(x, chr(57345)) AS x, sum(length(replace(x, chr(57345), ''))) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM (SELECT r, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (SELECT r, string_split(regexp_replace(t, '({first}{tail})', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS a FROM d) WHERE len(a) > 1))) WHERE i > 1 AND {good}")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
s AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) FILTER (kind IN ({base})) AS base, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) AS spans FROM m GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (r)
"""


OP6_SQL = _sql()
