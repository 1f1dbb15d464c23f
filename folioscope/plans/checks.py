"""Queries of checks, merges, front ends, alternatives and bounded collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import normalize as n
from folioscope.functions import similarity as s
from folioscope.operators import checks as c
from folioscope.operators import evaluate as e
from folioscope.operators import segments as g
from folioscope.plans.evaluation import _PAGES, _collapse, _soft, page_fields
from folioscope.plans.registry import query, table
from folioscope.streaming.incremental import collect_until


def _bib(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^0-9a-zà-ÿ]+', ' ', 'g'))"


_REFERENCES = """refs AS (SELECT p_partkey, p_name || '. ' || p_brand || ' ' || p_type || ' (' || (1990 + p_size % 20) || ')' AS gold, CASE p_partkey % 3 WHEN 0 THEN 'Another title' WHEN 1 THEN upper(p_name) ELSE '' END AS title,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS journal, CASE p_partkey % 5 WHEN 0 THEN '2050' WHEN 1 THEN 'n.d.' ELSE CAST(1990 + p_size % 20 AS VARCHAR) END AS year FROM part)"""


def _cited(field):
    return f"coalesce({field} <> '' AND left({_bib(field)}, 40) <> '' AND contains({_bib('gold')}, left({_bib(field)}, 40)), false)"


@query(f"""WITH {_REFERENCES}, x AS (SELECT 'title' AS field, coalesce(title <> '', false) AS p, {_cited('title')} AS r FROM refs UNION ALL SELECT 'journal', coalesce(journal <> '', false), {_cited('journal')} FROM refs
 UNION ALL SELECT 'year', coalesce(year <> '', false), regexp_full_match(year, '(19|20)[0-9][0-9]') AND contains(gold, year) FROM refs) SELECT field, count(*) AS n, count(*) FILTER (WHERE p) AS produced, count(*) FILTER (WHERE r) AS "right" FROM x GROUP BY field""")
def citation_field_check(spark, sf_dir):
    """Fields of matched references that are produced, and that are right."""
    k, y = F.col("p_partkey"), (1990 + F.col("p_size") % 20).cast("string")
    rows = table(spark, sf_dir, "part").select(
        F.concat("p_name", F.lit(". "), "p_brand", F.lit(" "), "p_type", F.lit(" ("), y, F.lit(")")).alias("gold"), F.when(k % 3 == 0, "Another title").when(k % 3 == 1, F.upper("p_name")).otherwise("").alias("title"),
        F.when(k % 4 != 0, F.col("p_brand")).alias("journal"), F.when(k % 5 == 0, "2050").when(k % 5 == 1, "n.d.").otherwise(y).alias("year"),
    )
    return c.citation_totals(rows, c.citation_fields(F.col("title"), F.col("journal"), F.col("year"), F.col("gold")))


@query("""WITH m AS (SELECT doc_id, '<figure>' || text || '</figure> <p>x</p> <figure>H 1 : ' || lang || ' <b>' || text || '</b></figure>' AS markup FROM documents),
f AS (SELECT doc_id, unnest(regexp_extract_all(markup, '(?s)<figure>.*?</figure>')) AS x, generate_subscripts(regexp_extract_all(markup, '(?s)<figure>.*?</figure>'), 1) - 1 AS nth FROM m),
t AS (SELECT doc_id, nth, replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''') AS text FROM f)
SELECT doc_id, CAST(nth AS INTEGER) AS nth, CAST(length(text) AS INTEGER) AS chars FROM t WHERE length(text) > 800 AND regexp_matches(text, 'H\\s*\\d+\\s*:|(?:^|\\D)\\d\\.\\d+\\.\\s+[A-ZÇĞİÖŞÜ]')""")
def figure_leakage(spark, sf_dir):
    """Figures that hold body text."""
    d = table(spark, sf_dir, "documents")
    markup = F.concat(F.lit("<figure>"), "text", F.lit("</figure> <p>x</p> <figure>H 1 : "), "lang", F.lit(" <b>"), "text", F.lit("</b></figure>"))
    return d.select("doc_id", F.inline(c.leaked_figures(markup))).select("doc_id", "nth", "chars")


_UP = "upper(translate({0}, 'iı', 'İI'))"


@query(f"""WITH r AS (SELECT c_custkey, upper(translate(CASE WHEN c_custkey % 3 = 0 THEN 'Something else' ELSE c_name || ' & more' END, 'iı', 'İI')) AS own, upper(translate(c_mktsegment || ' Yılmaz', 'iı', 'İI')) AS names, c_name, c_mktsegment FROM customer)
SELECT c_custkey, NOT (contains(own, left({_UP.format('c_name')}, 20)) OR contains({_UP.format('c_name')}, left(own, 20)) OR contains(own, left({_UP.format("'Other title of it all here'")}, 20)) OR contains({_UP.format("'Other title of it all here'")}, left(own, 20))) AS title_differs,
 concat_ws(';', CASE WHEN NOT contains(names, {_UP.format('c_mktsegment')}) THEN 'Ali ' || c_mktsegment END, 'Ayşe Kaya', CASE WHEN NOT contains(names, {_UP.format("'yılmaz'")}) THEN 'Can yılmaz' END) AS missing FROM r""")
def header_cross_check(spark, sf_dir):
    """What parsed headers lack of known titles and names."""
    k = F.col("c_custkey")
    title = F.when(k % 3 == 0, "Something else").otherwise(F.concat("c_name", F.lit(" &amp; more")))
    markup = F.concat(F.lit("<docTitle><titlePart>"), title, F.lit("</titlePart></docTitle><docAuthor>"), "c_mktsegment", F.lit(" <lb/>Yılmaz</docAuthor>"))
    x = c.header_check(markup, F.array("c_name", F.lit("Other title of it all here")), F.array(F.concat(F.lit("Ali "), "c_mktsegment"), F.lit("Ayşe Kaya"), F.lit("Can yılmaz")))
    return table(spark, sf_dir, "customer").select("c_custkey", x.alias("x")).select("c_custkey", "x.title_differs", F.array_join("x.missing_authors", ";").alias("missing"))


def _telling(x: str) -> str:
    low = f"translate(lower(translate(coalesce({x}, ''), 'Iİ', 'ıi')), 'çğıöşü', 'cgiosu')"
    return f"list_distinct(list_filter(regexp_split_to_array(regexp_replace({low}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2))"


_PIECE = "(len({0}) = 0 OR list_has_any({0}, [" + ", ".join(f"'{w}'" for w in c.TITLE_WORDS) + "]) OR len(list_filter({0}, lambda w: regexp_matches(w, '(" + "|".join(c.TITLE_ENDINGS) + ")$'))) > 0 OR len(regexp_split_to_array(trim({1}), '\\s+')) >= 4)"


@query(f"""WITH {_PAGES}, a AS (SELECT id, h1 AS title, CASE WHEN id % 2 = 0 THEN slug END AS author, CASE WHEN id % 3 = 0 THEN lead ELSE '' END AS abstract FROM pf WHERE id % 5 <> 0),
b AS (SELECT id, title, CASE id % 4 WHEN 1 THEN slug WHEN 3 THEN 'verinin incelenmesi' END AS author, lead AS abstract FROM pf WHERE id % 7 <> 0),
j AS (SELECT coalesce(a.id, b.id) AS id, a.title AS ta, b.title AS tb, a.author AS aa, b.author AS ba, a.abstract AS aab, b.abstract AS bab FROM a FULL JOIN b ON a.id = b.id),
k AS (SELECT *, aa IS NULL AND ba IS NOT NULL AND {_PIECE.format(_telling('ba'), 'ba')} AS piece, CASE WHEN len({_telling('ta')}) > len({_telling('tb')}) THEN ta ELSE coalesce(tb, ta) END AS longer FROM j)
SELECT id, md5(trim(concat_ws(' ', coalesce(longer, ''), CASE WHEN piece THEN ba ELSE '' END))) AS title, coalesce(aa, CASE WHEN NOT piece THEN ba END, '') AS authors, md5(coalesce(nullif(aab, ''), bab, '')) AS abstract FROM k""")
def merge_parser_outputs(spark, sf_dir):
    """Two parsers' output of each page in one: longer title, names, fallbacks."""
    p, i, none = page_fields(spark, sf_dir), F.col("id"), F.array().cast("array<string>")
    blank = F.lit("")
    a = p.filter(i % 5 != 0).select("id", F.col("h1").alias("title"), F.when(i % 2 == 0, F.array("slug")).otherwise(none).alias("authors"), F.when(i % 3 == 0, F.col("lead")).otherwise("").alias("abstract"), blank.alias("keywords"), blank.alias("doi"))
    b = p.filter(i % 7 != 0).select("id", "title", F.when(i % 4 == 1, F.array("slug")).when(i % 4 == 3, F.array(F.lit("verinin incelenmesi"))).otherwise(none).alias("authors"), F.col("lead").alias("abstract"), blank.alias("keywords"), blank.alias("doi"))
    m = c.merge_outputs(a, b, "id")
    return m.select("id", F.md5("title").alias("title"), F.array_join("authors", ";").alias("authors"), F.md5("abstract").alias("abstract"))


_WORDS_OF = "regexp_split_to_array(trim({0}), '\\s+')"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || '1. Giriş' || chr(10) || 'x' ELSE text END AS text FROM documents),
g AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM d), k AS (SELECT doc_id, ls, coalesce(ls[2], '') AS title, CASE WHEN doc_id % 3 = 0 THEN coalesce(ls[3], '') ELSE 'no such abstract is in any text' END AS abstract FROM g),
q AS (SELECT doc_id, len(ls) AS n, CASE WHEN len({_WORDS_OF.format('title')}) >= 3 THEN {_UP.format("left(array_to_string(list_slice(" + _WORDS_OF.format('title') + ", 1, 5), ' '), 40)")} END AS bit,
 CASE WHEN len({_WORDS_OF.format('abstract')}) >= 6 THEN left(array_to_string(list_slice({_WORDS_OF.format('abstract')}, -6, -1), ' '), 15) END AS tail FROM k),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM k),
h AS (SELECT doc_id, trim(line) AS head FROM l WHERE length(trim(line)) > 8 GROUP BY 1, 2 HAVING count(*) >= 3),
x AS (SELECT l.doc_id, any_value(q.n) AS n, min(CASE WHEN regexp_matches(trim(line), '^1\\.?\\s*([Gg][İIiı][Rr][İIiı][ŞSşs]|(?i:INTRODUCTION))([^\\p{{L}}\\p{{N}}_]|$)') THEN pos END) AS intro,
 min(CASE WHEN h.head IS NULL AND contains({_UP.format('line')}, q.bit) THEN pos END) AS hit, max(CASE WHEN contains(line, q.tail) THEN pos END) AS tail FROM l JOIN q ON q.doc_id = l.doc_id LEFT JOIN h ON h.doc_id = l.doc_id AND h.head = trim(line) GROUP BY l.doc_id)
SELECT doc_id, CAST(coalesce(intro, greatest(hit, tail) + 1, greatest(1, n // 4)) AS INTEGER) AS front_end FROM x""")
def front_end_located(spark, sf_dir):
    """Ends of front matter by the numbered introduction, known titles and abstracts, or a quarter."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\n1. Giriş\nx"))).otherwise(F.col("text")).alias("text"))
    ls = F.split("text", "\n")
    abstract = F.when(F.col("doc_id") % 3 == 0, F.coalesce(F.get(ls, 2), F.lit(""))).otherwise("no such abstract is in any text")
    return g.front_end(d.select("doc_id", "text", F.array(F.coalesce(F.get(ls, 1), F.lit(""))).alias("titles"), F.array(abstract).alias("abstracts")), "doc_id", "text", "titles", "abstracts")


_ANY = f"""{_PAGES}, pairs AS (SELECT id, 'title' AS field, h1 AS pred, unnest([slug, title]) AS gold FROM pf UNION ALL SELECT id, 'lead', lead, unnest([h1, lead, '']) FROM pf),
known AS (SELECT id, field, pred, {_soft('pred')} AS a, {_soft('gold')} AS b, {_collapse('pred')} = {_collapse('gold')} AS strict FROM pairs WHERE trim(gold) <> ''),
best AS (SELECT id, field, bool_or(trim(pred) <> '') AS predicted, bool_or(trim(pred) <> '' AND strict) AS strict, bool_or(trim(pred) <> '' AND a = b) AS soft FROM known GROUP BY id, field),
long AS (SELECT 'strict' AS mode, field, predicted, strict AS m FROM best UNION ALL SELECT 'soft', field, predicted, soft FROM best)"""


@query(f"WITH {_ANY} SELECT mode, field, count(*) AS support, count(*) FILTER (WHERE predicted) AS predicted, count(*) FILTER (WHERE m) AS matched FROM long GROUP BY mode, field")
def eval_alternatives(spark, sf_dir):
    """Two and three references for a field, of which any may match; one of them is blank."""
    p = page_fields(spark, sf_dir)
    rows = p.select("id", F.inline(F.array(F.struct(F.lit("title").alias("field"), F.col("h1").alias("pred"), F.array("slug", "title").alias("golds")), F.struct(F.lit("lead").alias("field"), F.col("lead").alias("pred"), F.array("h1", "lead", F.lit("")).alias("golds")))))
    return e.prf(e.long_matches(rows, ("strict", "soft"), True)).select("mode", "field", "support", "predicted", "matched")


@query()
def best_abstract(spark, sf_dir):
    """The best similarity of a page's lead over variants: the lead again on every third page, or other fields."""
    p, i = page_fields(spark, sf_dir), F.col("id")
    golds = F.when(i % 7 == 0, F.array().cast("array<string>")).when(i % 3 == 0, F.array(n.score_norm(F.col("h1")), n.score_norm(F.col("lead")))).otherwise(F.array(n.score_norm(F.col("h1")), n.score_norm(F.col("title"))))
    return p.select("id", s.best_similarity(n.score_norm(F.when(i % 5 == 0, "").otherwise(F.col("lead"))), golds).alias("similarity"))


@query("""WITH o AS (SELECT o_orderstatus, o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'P') OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS got FROM orders)
SELECT o_orderstatus, count(*) AS n FROM o WHERE got < 25 GROUP BY o_orderstatus""")
def collection_counts(spark, sf_dir):
    """What was tried, by status, until twenty-five rows of one status were collected."""
    return collect_until(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "P", 25, ["o_orderkey"])[1]
