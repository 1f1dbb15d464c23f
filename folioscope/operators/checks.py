"""Checks of parser output against known records, and merging the output of two parsers.

Everything is a Column or a join; the only shuffles are those of the joins on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import normalize as n

#: How much of a title or journal must stand in the known reference; lengths that title checks compare.
CITED_PREFIX, TITLE_PREFIX, SAMPLE = 40, 20, 80
#: Headings that have no place in a figure, and the longest figure that is not suspicious.
LEAKED_HEADING, LONGEST_FIGURE = r"H\s*\d+\s*:|(?:^|\D)\d\.\d+\.\s+[A-ZÇĞİÖŞÜ]", 800
#: Endings and words that give away a piece of a title among names.
TITLE_ENDINGS = (
    "nin", "nın", "nun", "nün", "leri", "ları", "lerin", "ların", "masi", "mesi", "sinin", "ının", "incelenmesi", "degerlendirilmesi", "etkisi",
    "etkileri", "analizi", "uzerine", "acisindan", "iliskisi", "ornegi", "karsilastirilmasi", "belirlenmesi", "arastirilmasi", "uygulamasi",
)
TITLE_WORDS = (
    "ve", "ile", "bir", "icin", "uzerine", "ozet", "abstract", "giris", "anahtar", "kelimeler", "key", "words", "the", "of", "and", "universitesi",
    "dergisi", "fakultesi", "bolumu",
)


def citation_fields(title: Column, journal: Column, year: Column, gold: Column) -> Column:
    """For title, journal and year of a matched reference: struct(produced, right). The beginning of a title or journal
    must stand in the known reference; a year must be one and stand there."""
    known = n.bibliography_norm(gold)

    def stands(value: Column) -> Column:
        start = F.substring(n.bibliography_norm(value), 1, CITED_PREFIX)
        return (start != "") & F.contains(known, start)

    def one(value: Column, right: Column) -> Column:
        filled = F.coalesce(value != "", F.lit(False))
        return F.struct(filled.alias("produced"), (filled & F.coalesce(right, F.lit(False))).alias("right"))

    return F.struct(one(title, stands(title)).alias("title"), one(journal, stands(journal)).alias("journal"), one(year, year.rlike(r"^(?:19|20)\d\d$") & F.contains(gold, year)).alias("year"))


def citation_totals(rows: DataFrame, fields: Column) -> DataFrame:
    """field, n, produced, right over all matched references."""
    x = rows.select(fields.alias("_x"))
    kinds = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_x.{f}.produced").alias("p"), F.col(f"_x.{f}.right").alias("r")) for f in ("title", "journal", "year")])
    return x.select(F.inline(kinds)).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if("p").alias("produced"), F.count_if("r").alias("right"))


def plain(markup: Column) -> Column:
    return n.unescape_markup(F.regexp_replace(markup, "<[^>]*>", " "))


def leaked_figures(markup: Column) -> Column:
    """array<struct(nth, chars, sample)> of the figures that hold a section heading and are longer than figures are."""
    figures = F.transform(F.regexp_extract_all(markup, F.lit("(?s)<figure>.*?</figure>"), F.lit(0)), lambda x, i: F.struct(i.alias("nth"), plain(x).alias("text")))
    bad = F.filter(figures, lambda x: x["text"].rlike(LEAKED_HEADING) & (F.length(x["text"]) > LONGEST_FIGURE))
    return F.transform(bad, lambda x: F.struct(x["nth"].alias("nth"), F.length(x["text"]).alias("chars"), F.substring(F.trim(x["text"]), 1, SAMPLE).alias("sample")))


def header_check(markup: Column, titles: Column, authors: Column) -> Column:
    """struct(title_differs, missing_authors): what a header part lacks of the known titles (alternatives) and names.

    A title agrees if its beginning stands in a known one or the other way round. A name is missing if its last word
    does not stand in the author part."""
    def part(tag):
        return F.trim(plain(F.regexp_extract(markup, f"(?s)<{tag}>(.*?)</{tag}>", 1)))

    def flat(c):
        return n.turkish_upper(F.regexp_replace(c, r"\s+", " "))

    own, names = flat(part("titlePart")), n.turkish_upper(part("docAuthor"))
    agrees = F.exists(titles, lambda t: F.contains(own, F.substring(flat(t), 1, TITLE_PREFIX)) | F.contains(flat(t), F.substring(own, 1, TITLE_PREFIX)))
    last = lambda a: n.turkish_upper(F.element_at(F.split(F.trim(a), r"\s+"), -1))
    missing = F.filter(authors, lambda a: (F.trim(a) != "") & ~F.contains(names, last(a)))
    return F.struct(((F.size(titles) > 0) & ~agrees).alias("title_differs"), missing.alias("missing_authors"))


def telling_words(c: Column) -> Column:
    """The distinct words of three letters or more: lowered, folded, without punctuation."""
    low = F.translate(n.turkish_lower(F.coalesce(c, F.lit(""))), "çğıöşü", "cgiosu")
    return F.array_distinct(F.filter(F.split(F.regexp_replace(low, r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: F.length(w) > 2))


def is_title_piece(name: Column) -> Column:
    """Whether what stands as a name is the rest of a title: no telling word, one of a title, or four words or more."""
    words = telling_words(name)
    endings = "(?:" + "|".join(TITLE_ENDINGS) + ")$"
    return (F.size(words) == 0) | F.arrays_overlap(words, F.array(*map(F.lit, TITLE_WORDS))) | F.exists(words, lambda w: w.rlike(endings)) | (F.size(F.split(F.trim(name), r"\s+")) >= 4)


def merge_outputs(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Output of two parsers (key, title, abstract, keywords, doi strings, authors array) in one.

    Names are those of base, or those of other without pieces of titles. The title is the one with more telling words,
    that of other at ties, and what was a piece of a title among the names follows it. The other fields are those of
    base, or of other where base has none."""
    fields = ("title", "abstract", "keywords", "doi", "authors")
    both = base.select(key, F.struct(*fields).alias("a")).join(other.select(key, F.struct(*fields).alias("b")), key, "full_outer")
    none = F.array().cast("array<string>")
    own, theirs = F.coalesce("a.authors", none), F.coalesce("b.authors", none)
    pieces = F.when(F.size(own) == 0, F.filter(theirs, is_title_piece)).otherwise(none)
    names = F.when(F.size(own) > 0, own).otherwise(F.filter(theirs, lambda x: ~is_title_piece(x)))
    longer = F.when(F.size(telling_words(F.col("a.title"))) > F.size(telling_words(F.col("b.title"))), F.col("a.title")).otherwise(F.coalesce("b.title", "a.title"))
    title = F.trim(F.concat_ws(" ", F.coalesce(longer, F.lit("")), F.array_join(pieces, " ")))

    def filled(f):
        return F.coalesce(F.nullif(F.col(f"a.{f}"), F.lit("")), F.col(f"b.{f}"), F.lit(""))

    return both.select(key, title.alias("title"), names.alias("authors"), *[filled(f).alias(f) for f in ("abstract", "keywords", "doi")])
