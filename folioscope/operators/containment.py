"""Which documents may hold a passage: candidates by a global order of words, with a bound instead of a hope.

A passage of n words that a document holds with coverage c has m = ceil(c n) of its words or more there, and with density
d these lie within n / d words of the document. However the words are ordered, the n - m + l that come first include at
least l of any m of them. So words are put in the order of how often documents use them, rarest first; only the first
n - m + l of a passage are looked for; and a document goes on if l of them stand within n / d words. Of those that do, all
words are counted: in two neighbouring stretches of n / d words there must be m of the passage's, a word as often as the
passage has it at most. No pair that reaches coverage and density is left out.

Documents are cut into words once; those that some passage has are written with their places and serve both the counts
and the join, which is by word. Nothing is collected or broadcast by hand; a word of very many documents is looked for
only where a passage has nothing rarer, and Spark splits its join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.scratch import written

#: Words of a passage that must meet; more of them make fewer candidates of more frequent words.
MEET = 3


def vocabulary_hits(docs: DataFrame, doc: str, items: DataFrame) -> DataFrame:
    """A written table of doc, pos and w for the words (hashes) of docs that some passage has."""
    known = items.select(F.explode("words").alias("w")).distinct()
    return written(docs.select(doc, F.posexplode("words").alias("pos", "w")).join(known, "w"))


def rare_words(items: DataFrame, item: str, hits: DataFrame, coverage: float, density: float, meet: int = MEET) -> DataFrame:
    """item, w, meet and reach: the words of each passage to look for, how many must meet and within how many words."""
    used = hits.groupBy("w").agg(F.count(F.lit(1)).alias("used"))
    words = items.select(item, F.size("words").alias("n"), F.explode("words").alias("w")).join(used, "w", "left")
    rank = F.row_number().over(Window.partitionBy(item).orderBy(F.coalesce("used", F.lit(0)), "w"))
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * coverage - 1e-9))
    least = F.least(F.lit(meet), need)
    reach = F.floor(F.col("n") / density + 1e-9)
    words = words.select(item, "w", "used", rank.alias("rank"), (F.col("n") - need + least).alias("first"), least.alias("meet"), reach.alias("reach"))
    return words.filter("rank <= first AND used IS NOT NULL").select(item, "w", "meet", "reach").distinct()


def containment_candidates(items: DataFrame, item: str, docs: DataFrame, doc: str, coverage: float, density: float, meet: int = MEET) -> DataFrame:
    """(item, doc) of all pairs in which m = ceil(coverage n) words of a passage can stand in a document with this density.

    items has item and words, docs has doc and words: arrays of word hashes. A clash of hashes costs a comparison.
    """
    hits = vocabulary_hits(docs, doc, items)
    found = hits.join(rare_words(items, item, hits, coverage, density, meet), "w").select(item, doc, "pos", "meet", "reach")
    near = Window.partitionBy(item, doc).orderBy("pos")
    back = F.coalesce(*[F.when(F.col("meet") == k, F.lag("pos", k - 1).over(near)) for k in range(1, meet + 1)])
    pairs = written(found.withColumn("back", back).filter("pos - back < reach").select(item, doc).distinct())
    size = F.size("words")
    own = items.select(item, F.greatest(F.lit(1), F.ceil(size * coverage - 1e-9)).alias("need"), F.greatest(F.lit(1), F.ceil(size / density)).alias("wide"), F.explode("words").alias("w"))
    own = own.groupBy(item, "need", "wide", "w").agg(F.count(F.lit(1)).alias("times"))
    met = pairs.join(own, item).join(hits, [doc, "w"])
    at = F.floor(F.col("pos") / F.col("wide"))
    met = met.withColumn("stretch", F.explode(F.array(at, at - 1))).groupBy(item, doc, "stretch", "need", "w").agg(F.least(F.count(F.lit(1)), F.max("times")).alias("met"))
    return met.groupBy(item, doc, "stretch", "need").agg(F.sum("met").alias("met")).filter("met >= need").select(item, doc).distinct()


def grams(text: Column, k: int) -> Column:
    """All runs of k characters of a text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * k}))"), F.lit(1))


def verbatim(items: DataFrame, item: str, passage: str, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(item, doc) of all documents that hold a passage as it is, also inside words.

    A document with the passage has its inner words whole; the rarest of these is its key. A passage without an inner word
    is found by its first three characters (all of them, if it has fewer), among all such runs of the documents.
    """
    parts = F.split(F.col(passage), "[ \n]")
    p = items.select(item, F.col(passage).alias("_p"), F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 2)).alias("_inner")).filter("_p IS NOT NULL")
    p = p.withColumn("_inner", F.filter("_inner", lambda w: w != ""))
    t = docs.select(doc, F.col(text).alias("_t"))
    long = p.filter(F.size("_inner") > 0).select(item, F.explode(F.array_distinct("_inner")).alias("k"))
    words = t.select(doc, F.explode(F.array_distinct(F.split("_t", "[ \n]"))).alias("k"))
    words = written(words.join(long.select("k").distinct(), "k"))
    used = words.groupBy("k").agg(F.count(F.lit(1)).alias("used"))
    rarest = long.join(used, "k", "left").groupBy(item).agg(F.min(F.struct(F.coalesce("used", F.lit(0)).alias("used"), "k")).alias("r"))
    pairs = words.join(rarest.select(item, "r.k"), "k").select(item, doc)
    short = p.filter(F.size("_inner") == 0).select(item, F.left("_p", F.lit(3)).alias("k"), F.least(F.length("_p"), F.lit(3)).alias("n"))
    for n in sorted(r["n"] for r in short.select("n").distinct().collect()):  # 0 to 3
        runs = F.array(F.lit("")) if n == 0 else F.array_distinct(grams(F.col("_t"), n))
        keyed = t.filter("_t IS NOT NULL").select(doc, F.explode(runs).alias("k"))
        pairs = pairs.union(keyed.join(short.filter(F.col("n") == n).select(item, "k"), "k").select(item, doc))
    held = pairs.join(p.select(item, "_p"), item).join(t, doc)
    return held.filter(F.contains("_t", "_p")).select(item, doc)
