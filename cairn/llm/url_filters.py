"""Exact URL filtering by a cascade of Bloom filters, in SQL functions only.

Level 0 encodes the listed keys. Unlisted keys of the universe that pass it are its false positives: level 1 encodes
those. Listed keys that pass level 1 go to level 2, and so on until a level has no false positive. As every key of the
universe was tried, the cascade answers exactly for all of them, and rows are judged without a join.

Memory: a level holds bits_per_key bits for each of its keys and travels as a scalar subquery. At most keys_per_pass
listed keys share a cascade; longer lists are split by key hash and the rows judged in as many passes.

Defined cases: a null key counts as the empty key; an empty list lists nothing; repeated keys count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, table, unused

BITS_PER_KEY, HASHES, KEYS_PER_PASS, MAX_LEVELS = 10, 4, 1 << 22, 40
#: A bitmap of bitmap_construct_agg has so many bits.
BITMAP = 32768
#: (verdict, host, path). A rule fits its host and all subdomains where the path starts with the rule's; the longest wins.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: host between the first :// and the next of / ? #, A-Z lower-cased; path from there to ? or #.

    Null, or no :// at all: both empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def positions(key: Column, bits: int, level: int, shard: int) -> list[Column]:
    """1-based bit positions of a key."""
    return [F.pmod(F.xxhash64(key, F.lit(HASHES * level + i), F.lit(shard)), F.lit(bits)) + 1 for i in range(HASHES)]


def level_filter(keys: DataFrame, n: int, level: int, shard: int) -> tuple[Column, int]:
    """The level's bits as a scalar subquery, and their number."""
    bits = max(64, n * BITS_PER_KEY)
    buckets = -(-bits // BITMAP)
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, level, shard))).alias("p"))
    maps = at.groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m"))
    whole = keys.sparkSession.range(1, buckets + 1).withColumnRenamed("id", "b").join(maps, "b", "left").select("b", F.coalesce(F.hex("m"), F.lit("00" * (BITMAP // 8))).alias("m"))
    row = whole.agg(F.array_sort(F.collect_list(F.struct("b", "m"))).alias("all")).select(F.unhex(F.array_join(F.transform("all", lambda x: x["m"]), "")).alias("bits"))
    return cut(row, "bloom").scalar(), bits


def holds(bits: Column, size: int, key: Column, level: int, shard: int) -> Column:
    """Whether all of the key's bits are set."""

    def one(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.floor((p - 1) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.bit_get(byte, F.pmod(p - 1, F.lit(8)).cast("int")) == 1

    return reduce(lambda x, y: x & y, (one(p) for p in positions(key, size, level, shard)))


def cascade(listed: DataFrame, universe: DataFrame, key: Column, keys_per_pass: int = KEYS_PER_PASS) -> Column:
    """A boolean column, true where key is among the listed ones: exact for every key of the universe. Both frames have a column key."""
    clean = F.coalesce(F.col("key"), F.lit("")).alias("key")
    # one row a key: a sum instead of a join marks the listed ones
    marked = universe.select(clean, F.lit(0).alias("l")).unionByName(listed.select(clean, F.lit(1).alias("l"))).groupBy("key").agg((F.max("l") == 1).alias("listed"))
    marked = cut(marked, "keys")
    n = marked.where("listed").count()
    passes = max(1, -(-n // keys_per_pass))
    out = F.lit(False)
    for shard in range(passes):
        own = marked.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == shard) if passes > 1 else marked
        inside = F.pmod(F.xxhash64(key), F.lit(passes)) == shard if passes > 1 else F.lit(True)
        levels: list[Column] = []
        new, old, k = own.where("listed").select("key"), own.where("not listed").select("key"), 0
        while (n := new.count()) and k < MAX_LEVELS:
            bits, size = level_filter(new, n, k, shard)
            levels.append(holds(bits, size, key, k, shard))
            wrong = cut(old.where(holds(bits, size, F.col("key"), k, shard)), "passed")
            new, old, k = wrong, new, k + 1
        if k == MAX_LEVELS and n:
            raise RuntimeError("the cascade doesn't end")
        answer = F.lit(False)
        for here in reversed(levels):
            answer = here & ~answer
        out = out | (inside & answer)
    return out


def judged(rows: DataFrame, host: str, path: str, key: Column, listed: DataFrame, universe: DataFrame, rules=RULES, keys_per_pass: int = KEYS_PER_PASS) -> DataFrame:
    """rows with rule (null where none fits) and verdict: the longest fitting rule's, else block for listed keys and allow for the rest. Where rows has columns of these names, the new ones get underscores before them."""
    rule, verdict = F.lit(None).cast("string"), F.when(cascade(listed, universe, key, keys_per_pass), "block").otherwise("allow")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rows.withColumns({unused("rule", rows.columns): rule, unused("verdict", rows.columns): verdict})


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict. The list that the cascade encodes: host and path of all pages of mobile mirrors, m.*, among those of all pages."""
    host, path = parts(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    key = F.concat("host", "path")
    universe = pages.select(key.alias("key")).distinct()
    return judged(pages, "host", "path", key, universe.where(F.col("key").startswith("m.")), universe)


OP7_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p),
q AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN starts_with(host, 'm.') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
