"""Lexical enrichment of networks from relations of words that the user brings.

lexicon (word, synset, min_depth), lemmas (synset, lemma), antonyms (lemma, antonym), hypernyms (synset, parent, hops).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def depths(vertices: DataFrame, lexicon: DataFrame) -> DataFrame:
    """vertices with depth: the least depth of the word's synsets; null for unknown words."""
    d = lexicon.groupBy(F.col("word").alias("node")).agg(F.min("min_depth").cast("int").alias("depth"))
    return vertices.drop("depth").join(d, "node", "left")


def word_lemmas(lexicon: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(word, lemma) over all of a word's synsets."""
    return lexicon.select("word", "synset").join(lemmas, "synset").select("word", "lemma").distinct()


def synonyms(pairs: DataFrame, lexicon: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Pairs (u, v) that share a lemma: semi-joins, no lists."""
    wl = word_lemmas(lexicon, lemmas)
    return pairs.join(wl.withColumnRenamed("word", "u"), "u").join(wl.withColumnRenamed("word", "v"), ["v", "lemma"]).select("u", "v").distinct()


def antonyms(pairs: DataFrame, lexicon: DataFrame, lemmas: DataFrame, opposite: DataFrame) -> DataFrame:
    """Pairs (u, v) where a lemma of one has an antonym among the other's, in either direction."""
    wl = word_lemmas(lexicon, lemmas)
    anti = wl.join(opposite, "lemma").select("word", F.col("antonym").alias("lemma")).distinct()

    def one(a: str, b: str) -> DataFrame:
        return pairs.join(anti.withColumnRenamed("word", a), a).join(wl.withColumnRenamed("word", b), [b, "lemma"]).select("u", "v")

    return one("u", "v").union(one("v", "u")).distinct()


def ancestors(hypernyms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(synset, ancestor, hops), each synset its own at 0 hops. hypernyms holds all ancestors with their hops."""
    own = lexicon.select("synset", F.col("synset").alias("ancestor"), F.lit(0).alias("hops")).distinct()
    return own.unionByName(hypernyms.select("synset", F.col("parent").alias("ancestor"), F.col("hops").cast("int").alias("hops")))


def similarities(pairs: DataFrame, lexicon: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """(u, v, path, wup): over all pairs of synsets the largest 1 / (1 + distance) and 2 depth / (depths from the common ancestor); 0 without one."""
    up = ancestors(hypernyms, lexicon)
    depth = lexicon.groupBy("synset").agg(F.min("min_depth").alias("depth"))
    wide = lexicon.select("word", "synset").distinct().join(up, "synset")
    a = wide.select(F.col("word").alias("u"), F.col("synset").alias("su"), "ancestor", F.col("hops").alias("hu"))
    b = wide.select(F.col("word").alias("v"), F.col("synset").alias("sv"), "ancestor", F.col("hops").alias("hv"))
    both = pairs.join(a, "u").join(b, ["v", "ancestor"]).join(depth.withColumnRenamed("synset", "ancestor"), "ancestor", "left")
    d = F.coalesce("depth", F.lit(0)) + 1
    got = both.groupBy("u", "v").agg(F.max(1.0 / (1 + F.col("hu") + F.col("hv"))).alias("path"), F.max(2.0 * d / (2.0 * d + F.col("hu") + F.col("hv"))).alias("wup"))
    return pairs.join(got, ["u", "v"], "left").fillna(0.0, ["path", "wup"])


def enriched(vertices: DataFrame, edges: DataFrame, lexicon: DataFrame, lemmas: DataFrame, opposite: DataFrame, hypernyms: DataFrame, always_distance: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices with depth, edges with synonyms, antonyms, path_similarity, wup_similarity, edit_distance).

    Attributes are null where a word is unknown (edit distance too, unless always_distance), and for parallel edges after
    the first, key 0.
    """
    words = lexicon.select("word").distinct()
    pairs = edges.where("key = 0").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    known = pairs.join(words.withColumnRenamed("word", "u"), "u", "left_semi").join(words.withColumnRenamed("word", "v"), "v", "left_semi").select("u", "v")
    syn = synonyms(known, lexicon, lemmas).withColumn("s", F.lit(1))
    ant = antonyms(known, lexicon, lemmas, opposite).withColumn("a", F.lit(1))
    sim = similarities(known, lexicon, hypernyms)
    facts = sim.join(syn, ["u", "v"], "left").join(ant, ["u", "v"], "left").select(
        F.col("u").alias("src"), F.col("v").alias("dst"), F.coalesce("s", F.lit(0)).alias("synonyms"), F.coalesce("a", F.lit(0)).alias("antonyms"),
        F.bround("path", 3).alias("path_similarity"), F.bround("wup", 3).alias("wup_similarity"), F.lit(0).alias("key"),
    )
    out = edges.join(facts, ["src", "dst", "key"], "left")
    distance = F.levenshtein("src", "dst")
    out = out.withColumn("edit_distance", distance if always_distance else F.when(F.col("path_similarity").isNotNull(), distance))
    return depths(vertices, lexicon), out


def with_marks(edges: DataFrame) -> DataFrame:
    """Edges with -1 for unknown attributes, for outside tools that know no null."""
    return edges.fillna(-1, ["synonyms", "antonyms", "path_similarity", "wup_similarity", "edit_distance"])
