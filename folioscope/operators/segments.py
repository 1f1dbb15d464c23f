"""Front, body and references of a document over its lines, and checks of line alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import normalize as n

#: Headings that open the body and the references.
INTRODUCTION = ("giriş", "introduction", "genel bilgiler", "olgu sunumu", "olgu")
REFERENCES = ("kaynakça", "kaynaklar", "referanslar", "bibliyografya", "references", "reference", "kaynakca")
LONGEST_HEADING = 60


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line and start (offset in code points) of every line."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("long"))


def first_heading(rows: DataFrame, key: str, words: tuple[str, ...], alias: str) -> DataFrame:
    """The first line, short enough, that is one of the words once numbers are taken off."""
    hit = rows.filter((F.length("line") <= LONGEST_HEADING) & n.heading_norm(F.col("line")).isin(*words))
    return hit.groupBy(key).agg(F.min("pos").alias(alias))


def zones(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_lines, front_end, references_start: the body begins at its first heading, else after a quarter."""
    rows = lines(docs, key, text)
    n_lines = docs.select(key, F.size(F.split(text, "\n")).alias("n_lines"))
    out = n_lines.join(first_heading(rows, key, INTRODUCTION, "intro"), key, "left").join(first_heading(rows, key, REFERENCES, "refs"), key, "left")
    front = F.coalesce("intro", F.floor(F.col("n_lines") * 0.25).cast("int"))
    refs = F.when(F.col("refs") > front, F.col("refs"))
    return out.select(key, "n_lines", front.alias("front_end"), refs.alias("references_start"))


def zone_text(text: Column, front_end: Column, references_start: Column) -> Column:
    """struct(front, body, references): the three zones, which join to the whole text again."""
    ls = F.split(text, "\n")
    end = F.coalesce(references_start, F.size(ls))
    return F.struct(
        F.array_join(F.slice(ls, F.lit(1), front_end), "\n").alias("front"),
        F.array_join(F.slice(ls, front_end + 1, F.greatest(F.lit(0), end - front_end)), "\n").alias("body"),
        F.array_join(F.slice(ls, end + 1, F.greatest(F.lit(0), F.size(ls) - end)), "\n").alias("references"),
    )


def retag(regions: DataFrame, spans: DataFrame, key: str, kept: tuple[str, ...]) -> DataFrame:
    """Spans (key, start, end, tag) cut by regions (key, low, high, tag) and given the region's tag unless theirs is kept;
    neighbours of equal tag are merged."""
    cut = spans.join(regions.withColumnRenamed("tag", "region"), key).select(
        key, F.greatest("start", "low").alias("start"), F.least("end", "high").alias("end"), F.when(F.col("tag").isin(*kept), F.col("tag")).otherwise(F.col("region")).alias("tag")
    )
    cut = cut.filter("start < end")
    w = Window.partitionBy(key).orderBy("start")
    fresh = F.coalesce((F.lag("tag").over(w) != F.col("tag")) | (F.lag("end").over(w) != F.col("start")), F.lit(True)).cast("int")
    runs = cut.withColumn("_f", fresh).withColumn("_r", F.sum("_f").over(w))
    return runs.groupBy(key, "_r").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("tag").alias("tag")).drop("_r")


def misaligned(a: DataFrame, b: DataFrame, key: str, most: int = 20) -> DataFrame:
    """key, n_bad and the first ``most`` places where the non-blank lines of two versions differ."""

    def numbered(x, name):
        full = x.filter(F.trim("line") != "")
        w = Window.partitionBy(key).orderBy("pos")
        return full.select(key, F.row_number().over(w).alias("i"), F.trim("line").alias(name))

    both = numbered(a, "x").join(numbered(b, "y"), [key, "i"], "full_outer")
    bad = both.filter(~F.col("x").eqNullSafe(F.col("y")))
    first = bad.select(key, "i", F.row_number().over(Window.partitionBy(key).orderBy("i")).alias("_n")).filter(F.col("_n") <= most)
    places = first.groupBy(key).agg(F.array_sort(F.collect_list("i")).alias("places"))
    return bad.groupBy(key).agg(F.count(F.lit(1)).alias("n_bad")).join(places, key)


#: The heading that ends a front part; how a running header shows; lengths of the snippets looked for.
BODY_HEADING = r"^1\.?\s*(?:[Gg][İIiı][Rr][İIiı][ŞSşs]|(?i:INTRODUCTION))(?![\p{L}\p{N}_])"
LEAST_REPEATS, SHORTEST_HEADER, SNIPPET, TAIL = 3, 8, 40, 15


def front_end(docs: DataFrame, key: str, text: str, titles: str, abstracts: str) -> DataFrame:
    """key, front_end: the line of the first numbered introduction; else the line behind the last hit of a known title
    (its first five words, where they stand first, outside running headers) or abstract (the beginning of its last six
    words); else a quarter of the lines, one at least."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    head = F.trim("line")
    repeated = rows.filter(F.length(head) > SHORTEST_HEADER).groupBy(key, head.alias("head")).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= LEAST_REPEATS).select(key, "head", F.lit(True).alias("running"))
    split = lambda t: F.split(F.trim(t), r"\s+")
    title_bits = F.transform(F.filter(titles, lambda t: F.size(split(t)) >= 3), lambda t: n.turkish_upper(F.substring(F.array_join(F.slice(split(t), 1, 5), " "), 1, SNIPPET)))
    tails = F.transform(F.filter(abstracts, lambda t: F.size(split(t)) >= 6), lambda t: F.substring(F.array_join(F.slice(split(t), -6, 6), " "), 1, TAIL))
    known = docs.select(key, F.size(F.split(text, "\n")).alias("n"), title_bits.alias("bits"), tails.alias("tails"))
    x = rows.withColumn("head", head).join(repeated, [key, "head"], "left").join(known, key)
    up = n.turkish_upper(F.col("line"))
    # for each title the first line that has it: a map from its number to the least position, kept as an array of minima
    hits = F.transform("bits", lambda b: F.when(F.col("running").isNull() & F.contains(up, b), F.col("pos")))
    places = x.select(key, "n", "pos", F.when(F.col("head").rlike(BODY_HEADING), F.col("pos")).alias("intro"), F.when(F.exists("tails", lambda t: F.contains("line", t)), F.col("pos")).alias("tail"), F.posexplode_outer(hits).alias("i", "hit"))
    first = places.groupBy(key, "i").agg(F.min("hit").alias("hit"), F.min("intro").alias("intro"), F.max("tail").alias("tail"), F.first("n").alias("n"))
    per = first.groupBy(key).agg(F.max("hit").alias("hit"), F.min("intro").alias("intro"), F.max("tail").alias("tail"), F.first("n").alias("n"))
    return per.select(key, F.coalesce("intro", F.greatest("hit", "tail") + 1, F.greatest(F.lit(1), F.floor(F.col("n") / 4))).cast("int").alias("front_end"))
