"""One query per normalisation, over whole texts. A result is its digest and its length."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import normalize as n
from folioscope.plans.registry import add, query, table


def _sql_translate(expr: str, a: str, b: str) -> str:
    return f"translate({expr}, '{a}', '{b}')"


def _table(expr: str, t: dict[str, str]) -> str:
    return _sql_translate(expr, "".join(t), "".join(t.values()))


def _low(expr: str) -> str:
    return f"lower({_sql_translate(expr, 'Iİ', 'ıi')})"


def _collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{n.SPACES}', ' ', 'g'))"


def _drop(expr: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({expr}, '{pattern}', '{by}', 'g')"


T = "text"
_soft = _drop(_low(T), n.NON_WORD)
_soft_fold = _drop(_sql_translate(_low(T), *n.SOFT_FOLD), n.NON_WORD)

#: name -> (Column function, SQL expression over a column named text)
FUNCTIONS = {
    "norm_word": (n.norm_word, _drop(_sql_translate(_low(_table(T, n.GLYPHS)), *n.TURKISH_FOLD), n.NON_WORD)),
    "norm_glyph_lower": (n.glyph_lower, _low(_table(T, n.GLYPHS))),
    "norm_soft": (n.soft_norm, _soft),
    "norm_soft_folded": (lambda c: n.soft_norm(c, fold=True), _soft_fold),
    "norm_soft_composed": (lambda c: n.soft_norm(c, compose=True), _drop(_low(f"nfc_normalize({T})"), n.NON_WORD)),
    "norm_strict": (n.strict_norm, _collapse(T)),
    "norm_list": (n.list_norm, f"array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array({T}, '[;,]'), lambda x: {_soft.replace(T, 'x')}), lambda x: x <> '')), ' ')"),
    "norm_score": (n.score_norm, _collapse(_drop(f"strip_accents(lower({_sql_translate(T, *n.SCORE_FOLD)}))", "[^a-z0-9 ]+", " "))),
    "norm_token": (n.token_norm, _collapse(_drop(_sql_translate(_low(_table(T, n.SHORT_GLYPHS)), *n.TURKISH_FOLD), r"[^\p{L}\p{N}_\s]", " "))),
    "norm_bibliography": (n.bibliography_norm, f"trim({_drop(_sql_translate(f'lower({T})', *n.BIBLIOGRAPHY_FOLD), '[^0-9a-zà-ÿ]+', ' ')})"),
    "norm_heading_lower": (n.heading_lower, f"lower({_table(T, n.HEADING_LOWER)})"),
    "norm_heading": (n.heading_norm, f"trim(regexp_replace(trim(lower({_table(T, n.HEADING_LOWER)})), '^[iıvxlcdm0-9]{{1,4}}[.)]?\\s*', ''))"),
    "norm_mojibake": (n.mojibake_fix, _table(T, n.MOJIBAKE)),
    "norm_alnum": (n.alnum_ascii, _drop(f"lower({T})", "[^a-z0-9]")),
    "norm_join_hyphens": (n.join_hyphens, _drop(T, r"-(<lb/>|\s)+")),
    "norm_escape": (n.escape_markup, f"replace(replace(replace({T}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"),
    "norm_doi": (n.clean_doi, rf"regexp_replace(regexp_replace(trim(lower({T})), '^(https?://)?(dx\.)?doi\.org/', ''), '^doi:\s*', '')"),
    "norm_crlf": (n.crlf_to_lf, f"replace({T}, chr(13) || chr(10), chr(10))"),
}


def _digest(function):
    def run(spark, sf_dir):
        out = table(spark, sf_dir, "documents").select("doc_id", function(F.col("text")).alias("out"))
        return out.select("doc_id", F.md5("out").alias("digest"), F.length("out").cast("long").alias("n"))

    return run


for _name, (_function, _expr) in FUNCTIONS.items():
    add(_name, _digest(_function), f"SELECT doc_id, md5(out) AS digest, CAST(length(out) AS BIGINT) AS n FROM (SELECT doc_id, {_expr} AS out FROM documents)")


@query("SELECT doc_id, CAST(length(text) - length(translate(text, '" + "".join(n.MOJIBAKE) + "', '')) AS BIGINT) AS n_changed FROM documents")
def mojibake_changes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", n.mojibake_count(F.col("text")).cast("long").alias("n_changed"))


@query("SELECT o_orderkey, regexp_extract(strftime(o_orderdate, '%d %B, %Y'), '\\b(19|20)\\d{2}\\b', 0) AS year FROM orders")
def year_from_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", n.year_of(F.date_format("o_orderdate", "dd MMMM, yyyy")).alias("year"))


@query("SELECT s_suppkey, upper(translate(s_name, 'iı', 'İI')) AS name FROM supplier")
def norm_turkish_upper(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", n.turkish_upper(F.col("s_name")).alias("name"))


@query("""
SELECT page_id, md5(regexp_replace(replace(regexp_replace(replace(html, '<br>', chr(1)), '<[^>]*>', '', 'g'), chr(1), '<lb/>'), 'x^', '', 'g')) AS digest FROM pages
""")
def strip_tags_keep_breaks(spark, sf_dir):
    """Markup goes, line breaks stay."""
    lines = F.replace(F.col("html"), F.lit("<br>"), F.lit("<lb/>"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(n.strip_tags(lines)).alias("digest"))


@query("""
SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''')) AS digest FROM pages
""")
def norm_unescape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(n.unescape_markup(F.col("html"))).alias("digest"))


_titles = ", ".join(f"'{t}'" for t in n.ACADEMIC_TITLES)


@query(f"""
WITH names AS (SELECT p_partkey, string_split('Dr. ' || p_name || ';Prof. Dr.;' || p_brand || ';uzm', ';') AS raw FROM part),
kept AS (
  SELECT p_partkey, list_filter(raw, lambda x: x <> '' AND (
    len(list_filter(list_transform(regexp_split_to_array(x, '\\s+'), lambda w: lower(regexp_replace(w, '^[.,;:]+|[.,;:]+$', '', 'g'))), lambda w: w <> '')) = 0 OR
    len(list_filter(list_transform(regexp_split_to_array(x, '\\s+'), lambda w: lower(regexp_replace(w, '^[.,;:]+|[.,;:]+$', '', 'g'))), lambda w: w <> '' AND w NOT IN ({_titles}))) > 0)) AS names FROM names
)
SELECT p_partkey, array_to_string(names, '; ') AS names, CAST(len(names) AS INTEGER) AS n FROM kept
""")
def drop_title_only_names(spark, sf_dir):
    """Entries made of academic titles only are no names."""
    part = table(spark, sf_dir, "part")
    raw = F.split(F.concat(F.lit("Dr. "), "p_name", F.lit(";Prof. Dr.;"), "p_brand", F.lit(";uzm")), ";")
    kept = part.select("p_partkey", n.drop_title_names(raw).alias("names"))
    return kept.select("p_partkey", F.array_join("names", "; ").alias("names"), F.size("names").alias("n"))


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z0-9ığüşöçİĞÜŞÖÇ]+') AS words FROM documents)
SELECT doc_id, CAST(len(words) AS INTEGER) AS n_spans, CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS covered FROM w
""")
def word_spans(spark, sf_dir):
    spans = table(spark, sf_dir, "documents").select("doc_id", n.word_spans("text").alias("s"))
    covered = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return spans.select("doc_id", F.size("s").alias("n_spans"), covered.alias("covered"))
