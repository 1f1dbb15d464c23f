"""Span and segment queries: benchmark passages in documents, page fields, zones of texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import normalize as n
from folioscope.functions import similarity as s
from folioscope.operators import segments as g
from folioscope.operators import spans as p
from folioscope.operators.containment import containment_candidates
from folioscope.operators.sweep import sweep
from folioscope.plans.evaluation import page_fields
from folioscope.plans.registry import query, table
from folioscope.sources.scratch import written


def _canvas():
    return F.replace("text", F.lit("\n"), F.lit(" <lb/>"))


_SPACE = r"(?U)[\s\x1c-\x1f<]"


def _hashes(words):
    return F.transform(words, lambda w: F.xxhash64(w))


def _keys(text):
    """Words as the span search compares them: lowered, folded, without signs."""
    plain = F.regexp_replace(F.translate(n.glyph_lower(F.regexp_replace(text, _SPACE + "+", " ")), *n.TURKISH_FOLD), r"[^\p{L}\p{N}_ ]+", "")
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def document_keys(text):
    """Words of a text; what a hyphen joins to the next piece is one word."""
    return _keys(F.regexp_replace(F.replace(text, F.lit("<lb/>"), F.lit(" ")), f"-{_SPACE}+", ""))


def passage_keys(text):
    """Words of a passage that count: those of more than two characters."""
    return F.filter(_keys(F.replace(text, F.lit("<"), F.lit(""))), lambda w: F.length(w) > 2)


def candidates(spark, sf_dir, coverage, density, value=None, keys=(document_keys, passage_keys)):
    """item_id, doc_id and value where a document can hold a passage with this coverage and density."""
    items = table(spark, sf_dir, "benchmark").select("item_id", (F.col("text") if value is None else value).alias("value"))
    words = items.select("item_id", _hashes(keys[1](F.col("value"))).alias("words"))
    docs = table(spark, sf_dir, "documents").select("doc_id", _hashes(keys[0](F.col("text"))).alias("words"))
    pairs = containment_candidates(words, "item_id", docs, "doc_id", coverage, density)
    return written(pairs.join(items, "item_id"))  # of a known size, so that Spark can send them to the texts


def _located(spark, sf_dir, *args, **kwargs):
    d = table(spark, sf_dir, "documents").select("doc_id", _canvas().alias("canvas"))
    return candidates(spark, sf_dir, *args, **kwargs).join(d, "doc_id")


@query()
def find_spans(spark, sf_dir):
    """Where passages are in documents, by matching blocks of words."""
    x = _located(spark, sf_dir, *p.REACH).select("doc_id", "item_id", p.measure_span("canvas", "value").alias("x"))
    return x.filter(p.reaches(F.col("x"))).select("doc_id", "item_id", "x.start", "x.end", "x.matched", "x.coverage", "x.density", F.array_join("x.places", " ").alias("places"))


#: Steps of the sweep: least coverage and density.
STEPS = ((0.45, 0.34), (0.45, 0.20), (0.35, 0.20), (0.25, 0.20), (0.15, 0.20))


def altered(value):
    """A passage in which as many of each ten words as item_id % 10 are exchanged for words that stand nowhere."""
    words = F.split(F.regexp_replace(value, r"\s+", " "), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when(i % 10 < F.col("item_id") % 10, F.concat(F.lit("qq"), i.cast("string"), F.lit("qq"))).otherwise(w)), " ")


@query()
def span_threshold_sweep(spark, sf_dir):
    """How many altered passages are found as thresholds are relaxed. A pair is measured once for all steps; n is the number
    of pairs that can reach the last."""
    items = table(spark, sf_dir, "benchmark").select(altered(F.col("text")).alias("value"))
    x = sweep(table(spark, sf_dir, "documents"), _canvas(), items, STEPS)
    return x.select("n", *[F.col(f"x_{k}").alias(f"at_{round(c * 100)}_{round(d * 100)}") for k, (c, d) in enumerate(STEPS)])


def labelled(spark, sf_dir):
    """Pages as documents: a canvas of address, heading, first paragraph and text; known values from the markup."""
    f = page_fields(spark, sf_dir)
    lead = F.substring_index("lead", ".", 4)
    canvas = F.concat_ws(" <lb/>", F.lit("Dergi 2019 10.1234/abc.567"), "h1", F.concat(F.lit("Yazar "), "slug"), F.concat(F.lit("Özet: "), "lead"), F.concat(F.lit("Anahtar Kelimeler: "), lead))
    rows = f.select("id", canvas.alias("canvas"), "title", "lead", "slug")
    meta = p.known(title=F.col("title"), abstract=F.col("lead"), authors=F.col("slug"), doi=F.lit("10.1234/abc.567"), year=F.lit("2019"))
    return rows.withColumn("spans", p.label("canvas", meta))


def _span_text(field):
    one = F.try_element_at(F.filter("spans", lambda x: x["field"] == field), F.lit(1))
    return F.substring(F.col("canvas"), one["start"] + 1, one["end"] - one["start"])


@query()
def label_documents(spark, sf_dir):
    """Labelled spans of each page."""
    x = labelled(spark, sf_dir).select("id", F.explode("spans").alias("x"))
    return x.select("id", "x.field", "x.start", "x.end", "x.source")


@query()
def label_gate(spark, sf_dir):
    """Gold or the first reason for quarantine, and whether the tagged text without tags is the canvas."""
    intact = p.strip_spans(p.apply_spans(F.col("canvas"), F.col("spans"))) == F.col("canvas")
    x = labelled(spark, sf_dir).withColumns({"overlap": p.overlap_share(_span_text("author"), F.col("slug")), "intact": intact})
    return x.select("id", p.gate(F.col("spans"), F.col("overlap"), F.col("intact")).alias("gate"), F.round("overlap", 6).alias("overlap"), "intact")


@query()
def gate_counts(spark, sf_dir):
    x = label_gate(spark, sf_dir).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query()
def resolve_spans(spark, sf_dir):
    """Overlapping spans of four fields, derived from doc_id, settled by priority."""
    i = F.col("doc_id").cast("int")
    raw = F.array(*[F.struct((i % a).alias("start"), (i % a + b).cast("int").alias("end"), F.lit(f).alias("field"), F.lit("x").alias("source")) for f, a, b in (("title", 50, 40), ("author", 70, 60), ("affiliation", 60, 12), ("reference", 10, 200))])
    x = table(spark, sf_dir, "documents").select("doc_id", F.explode(p.resolve(raw)).alias("x"))
    return x.select("doc_id", "x.field", "x.start", "x.end")


@query()
def title_language(spark, sf_dir):
    """Titles found by shape go to the language whose known title they have more words in common with."""
    f = page_fields(spark, sf_dir).select("id", "title", "h1", "lead")
    canvas = F.concat_ws(" <lb/>", "h1", F.concat(F.lit("Özet: "), "lead"), F.lit("Anahtar Kelimeler: bir, iki"))
    meta = p.known(title=F.concat_ws(" ", F.lit("zzz yyy xxx"), F.substring_index("title", " ", 1)), title_en=F.concat_ws(" ", "h1", F.lit("zzz yyy xxx qqq vvv")))
    x = f.select("id", p.label(canvas, meta).alias("spans"))
    own = F.filter("spans", lambda q: q["field"].isin("title", "title_en"))
    return x.select("id", F.array_join(F.transform(own, lambda q: F.concat_ws(":", q["field"], q["source"])), " ").alias("titles"))


@query()
def subsequence_match(spark, sf_dir):
    """Where the words of a passage agree position by position with a document's."""
    flat = lambda c: F.replace(c, F.lit("\n"), F.lit(" <lb/>"))
    pieces = lambda c: F.filter(F.split(F.lower(flat(c)), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    x = _located(spark, sf_dir, 0.75, 0.75, keys=(pieces, pieces)).select("doc_id", "item_id", s.subsequence_at(F.lower("canvas"), F.lower(flat(F.col("value")))).alias("x"))
    return x.select("doc_id", "item_id", F.get("x", 0).alias("first"), F.get("x", 1).alias("last"))


@query()
def word_alignment(spark, sf_dir):
    """How many words of a page's heading and title stand in matching blocks."""
    x = page_fields(spark, sf_dir).select("id", p.align_words("h1", "lead").alias("x"))
    return x.select("id", F.size("x").alias("n"))


@query()
def greedy_references(spark, sf_dir):
    """Turns of a conversation as references: user turns find the assistant's, one to one."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def run(batches):
        for b in batches:
            rows = []
            for conv, turns in zip(b.conv_id, b.t, strict=True):
                gold, found = ([t["text"] for t in turns if t["role"] == r] for r in ("user", "assistant"))
                rows += [(conv, i, j, round(x, 6)) for i, j, x in p.greedy_pairs(gold, found, 0.3)]
            yield pd.DataFrame(rows, columns=["conv_id", "gold", "found", "score"])

    return c.mapInPandas(run, "conv_id long, gold long, found long, score double")


@query("""WITH l AS (SELECT doc_id, line, pos - 1 AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l""")
def line_offsets(spark, sf_dir):
    return g.lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "pos", "start")


_BODY = "text || chr(10) || '2. ' || lang || chr(10) || 'References' || chr(10) || source"


def _sectioned(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    intro = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Title of it\n1. Introduction\n"), "text")).otherwise(F.col("text"))
    return d.select("doc_id", F.concat(intro, F.lit("\n2. "), "lang", F.lit("\nReferences\n"), "source").alias("text"))


_HEAD = r"trim(regexp_replace(trim(lower(translate(line, '{0}', '{1}'))), '^[iıvxlcdm0-9]{{1,4}}[.)]?\s*', ''))".format("".join(n.HEADING_LOWER), "".join(n.HEADING_LOWER.values()))
_ZONES = f"""body AS (SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN 'Title of it' || chr(10) || '1. Introduction' || chr(10) || text ELSE text END) || chr(10) || '2. ' || lang || chr(10) || 'References' || chr(10) || source AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM body),
z AS (SELECT doc_id, count(*) AS k, min(CASE WHEN length(line) <= 60 AND {_HEAD} IN ({', '.join("'" + w + "'" for w in g.INTRODUCTION)}) THEN pos END) AS intro,
  min(CASE WHEN length(line) <= 60 AND {_HEAD} IN ({', '.join("'" + w + "'" for w in g.REFERENCES)}) THEN pos END) AS refs FROM l GROUP BY doc_id),
f AS (SELECT doc_id, k, CAST(coalesce(intro, floor(k * 0.25)) AS INTEGER) AS front_end, refs FROM z)"""


@query(f"WITH {_ZONES} SELECT doc_id, CAST(k AS INTEGER) AS n_lines, front_end, CAST(CASE WHEN refs > front_end THEN refs END AS INTEGER) AS references_start FROM f")
def find_heading(spark, sf_dir):
    """Ends of front matter and starts of references."""
    return g.zones(_sectioned(spark, sf_dir), "doc_id", "text")


@query(f"""WITH {_ZONES}, e AS (SELECT b.doc_id, text, front_end, CASE WHEN refs > front_end THEN refs ELSE k END AS last, k FROM body b JOIN f USING (doc_id))
SELECT doc_id, md5(array_to_string(list_slice(string_split(text, chr(10)), 1, front_end), chr(10))) AS front, md5(array_to_string(list_slice(string_split(text, chr(10)), front_end + 1, last), chr(10))) AS body,
 md5(array_to_string(list_slice(string_split(text, chr(10)), last + 1, k), chr(10))) AS refs FROM e""")
def three_zones(spark, sf_dir):
    """Front, body, references of each text."""
    d = _sectioned(spark, sf_dir)
    z = d.join(g.zones(d, "doc_id", "text"), "doc_id").select("doc_id", g.zone_text(F.col("text"), F.col("front_end"), F.col("references_start")).alias("z"))
    return z.select("doc_id", F.md5("z.front").alias("front"), F.md5("z.body").alias("body"), F.md5("z.references").alias("refs"))


@query("""WITH s AS (SELECT conv_id, turn * 10 AS start_, turn * 10 + 10 AS end_, role AS tag FROM conversations), r AS (SELECT DISTINCT conv_id, 0 AS low, 15 AS high, 'front' AS region FROM conversations UNION ALL SELECT DISTINCT conv_id, 15, 100000, 'body' FROM conversations),
c AS (SELECT conv_id, greatest(start_, low) AS a, least(end_, high) AS b, CASE WHEN tag = 'system' THEN tag ELSE region END AS tag FROM s JOIN r USING (conv_id) WHERE greatest(start_, low) < least(end_, high)),
f AS (SELECT *, CASE WHEN lag(tag) OVER w = tag AND lag(b) OVER w = a THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY a)), q AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY a) AS run FROM f)
SELECT conv_id, min(a) AS start, max(b) AS "end", min(tag) AS tag FROM q GROUP BY conv_id, run""")
def retag_regions(spark, sf_dir):
    """Spans cut at region borders, retagged but for protected tags, neighbours merged."""
    c = table(spark, sf_dir, "conversations")
    spans = c.select("conv_id", (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 10).alias("end"), F.col("role").alias("tag"))
    regions = c.select("conv_id").distinct().select("conv_id", F.inline(F.array(*[F.struct(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high"), F.lit(t).alias("tag")) for a, b, t in ((0, 15, "front"), (15, 100000, "body"))])))
    return g.retag(regions, spans, "conv_id", ("system",))


@query("""WITH a AS (SELECT doc_id, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(line) <> ''),
b AS (SELECT doc_id, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM (SELECT doc_id, replace(text, 'the ', 'The ') AS t FROM documents)) WHERE trim(line) <> '')
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, count(*) AS n_bad FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.i = b.i WHERE a.line IS DISTINCT FROM b.line GROUP BY 1""")
def align_validate(spark, sf_dir):
    """Lines that differ between two versions of a text."""
    d = table(spark, sf_dir, "documents")
    changed = d.select("doc_id", F.replace("text", F.lit("the "), F.lit("The ")).alias("text"))
    return g.misaligned(g.lines(d, "doc_id", "text"), g.lines(changed, "doc_id", "text"), "doc_id").select("doc_id", "n_bad")


@query("""SELECT page_id, md5(regexp_replace(replace(html, '<h1>', '<docTitle>'), '\\b(19|20)\\d{2}\\b', '<date>\\0</date>')) AS digest FROM pages""")
def tag_substitution(spark, sf_dir):
    """Tags put in place: the first year, every heading."""
    h = F.replace("html", F.lit("<h1>"), F.lit("<docTitle>"))
    year = F.regexp_extract(h, r"\b(19|20)\d{2}\b", 0)
    at = F.regexp_instr(h, F.lit(r"\b(19|20)\d{2}\b"))
    first = F.when(year == "", h).otherwise(F.concat(F.substring(h, F.lit(1), at - 1), F.lit("<date>"), year, F.lit("</date>"), F.substring(h, at + 4, F.length(h))))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(first).alias("digest"))
