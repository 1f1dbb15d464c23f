"""Report parsing, the run registry, sources and sinks as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.functions import normalize as n
from folioscope.operators import reports as r
from folioscope.plans.registry import dealt_out, query, table
from folioscope.sources import readers, writers
from folioscope.sources.scratch import folder
from folioscope.sources.store import KeyedStore

_FILES = (("run_a", 3), ("run_b", 5), ("run_c", 7))


def _report_lines(spark, sf_dir):
    """Reports written from the orders table: three files, two modes, a field per priority."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    rows = o.select("k", "c", F.inline(F.array(*[F.struct(F.lit(f).alias("file"), F.lit(m).alias("m"), F.lit(i).alias("b"), F.lit(w).alias("w")) for f, w in _FILES for i, m in enumerate(("Strict", "Soft"))])))
    field = F.regexp_replace(F.substring("k", 3, 99), r"\W", "_")
    body = rows.select("file", (F.col("b") * 100 + F.substring("k", 1, 1).cast("int")).alias("pos"), F.concat(F.lit("| "), field, F.lit(" | "), F.col("c") % 97, F.lit(".5 | "), F.col("c") % 89, F.lit(".25 | "), F.col("c") % 83 + F.col("w"), F.lit(".0 | "), "c", F.lit(" |")).alias("line"))
    heads = rows.select("file", (F.col("b") * 100).alias("pos"), F.concat(F.lit("=== "), "m", F.lit(" Matching ===")).alias("line")).distinct()
    return body.union(heads)


_PARSED = """o AS (SELECT o_orderpriority AS k, count(*) AS c FROM orders GROUP BY 1), f(file, w) AS (VALUES ('run_a', 3), ('run_b', 5), ('run_c', 7)), m(mode) AS (VALUES ('strict'), ('soft')),
parsed AS (SELECT file, mode, regexp_replace(substr(k, 3), '\\W', '_', 'g') AS field, c % 97 + 0.5 AS p, c % 89 + 0.25 AS r, CAST(c % 83 + w AS DOUBLE) AS f1, c AS support FROM o, f, m)"""


@query(f"WITH {_PARSED} SELECT file, mode, field, CAST(p AS DOUBLE) AS p, CAST(r AS DOUBLE) AS r, f1, support FROM parsed")
def parse_reports(spark, sf_dir):
    return r.parse_reports(_report_lines(spark, sf_dir))


def _registry(spark):
    return spark.createDataFrame([("run_a", "stock", "TR", "crf", "1", False, "gecerli", ""), ("run_b", "trained", "TR", "crf", "2", True, "gecerli", "")], r.REGISTRY_SCHEMA)


@query(f"WITH {_PARSED} SELECT file, CASE file WHEN 'run_a' THEN 'stock' ELSE 'trained' END AS label, mode, field, f1 FROM parsed WHERE file IN ('run_a', 'run_b')")
def registered_runs(spark, sf_dir):
    return r.registered(parse_reports(spark, sf_dir), _registry(spark)).select("file", "label", "mode", "field", "f1")


@query("SELECT 'run_c' AS file")
def unregistered_runs(spark, sf_dir):
    return r.unregistered(parse_reports(spark, sf_dir), _registry(spark))


@query(f"WITH {_PARSED} SELECT s.file, s.mode, s.field, s.f1, round(s.f1 - b.f1, 4) AS difference FROM parsed s JOIN parsed b ON b.file = 'run_a' AND b.mode = s.mode AND b.field = s.field")
def runs_to_baseline(spark, sf_dir):
    return r.to_baseline(parse_reports(spark, sf_dir), "run_a").select("file", "mode", "field", "f1", "difference")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, 'makale_' || c_custkey || '.pdf' AS dosya_adi, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS gercek_baslik,
 CASE WHEN c_custkey % 4 = 0 THEN 'Eksik:ozet' ELSE 'Tam' END AS durum FROM customer""")
def api_records(spark, sf_dir):
    """Nested records, written from customers and read back, to flat rows."""
    k = F.col("c_custkey")
    tr = F.struct(F.lit("TUR").alias("language"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("title"), F.when(k % 4 == 0, F.lit(None)).otherwise(F.lit("metin")).alias("abstract"))
    src = F.struct(k.cast("string").alias("id"), F.col("c_mktsegment").alias("orderTitle"), F.array(tr).alias("abstracts"), F.array(F.struct(F.col("c_name").alias("name"))).alias("authors"))
    value = F.to_json(F.struct(F.struct(F.array(F.struct(src.alias("_source"))).alias("hits")).alias("hits")))
    return readers.api_record(table(spark, sf_dir, "customer").select(value.alias("value"))).select("id", "dosya_adi", "gercek_baslik", "durum")


@query("""SELECT p_partkey, p_name AS title, p_brand AS journal, CAST(1990 + p_size % 20 AS VARCHAR) AS year, 'A ' || p_type AS surname FROM part""")
def article_records(spark, sf_dir):
    """Article markup to fields by paths."""
    x = F.format_string("<article><journal-title>%s</journal-title><article-meta><article-title>%s</article-title><contrib contrib-type='author'><name><surname>%s</surname><given-names>A</given-names></name></contrib><pub-date><year>%s</year></pub-date></article-meta></article>", "p_brand", "p_name", "p_type", (1990 + F.col("p_size") % 20).cast("string"))
    rows = dealt_out(table(spark, sf_dir, "part").select("p_brand", "p_name", "p_type", "p_size", "p_partkey")).select(x.alias("text"), "p_partkey")
    r = readers.article_record(rows, "p_partkey")
    return r.select("p_partkey", "title", "journal", "year", F.array_join("authors", ", ").alias("surname"))


@query("""SELECT p_partkey, p_name AS title, 'Dr. ' || p_brand || '; ' || p_type AS authors, 'Dr. ' || p_brand AS first_author, p_brand || '; ' || p_type AS keywords FROM part""")
def header_records(spark, sf_dir):
    """Parser output to title, names and keywords; a name made of titles only is dropped."""
    x = F.format_string('<TEI><teiHeader><titleStmt><title level="a" type="main">%s</title></titleStmt><persName>Dr. %s</persName><persName>Prof. Dr.</persName><persName>%s</persName><term>%s</term><term>%s</term></teiHeader><title>no</title></TEI>', "p_name", "p_brand", "p_type", "p_brand", "p_type")
    rows = table(spark, sf_dir, "part").select("p_partkey", x.alias("text"))
    return readers.header_record(rows, "p_partkey").select("p_partkey", "title", "authors", "first_author", "keywords")


@query("""SELECT o_custkey, o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS title, o_orderpriority AS journal, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders""")
def bibliography_entries(spark, sf_dir):
    """References exploded from one document per customer."""
    entry = F.format_string('<biblStruct><title level="a">%s</title><title level="j">%s</title><date when="%s"/></biblStruct>', F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.year("o_orderdate").cast("string"))
    docs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(entry), "").alias("text"))
    b = readers.bibliography(docs, "o_custkey")
    return b.select("o_custkey", F.col("title").cast("long").alias("k"), "title", "journal", "year")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'dogru' WHEN 1 THEN 'atla' ELSE 'duzeltildi' END AS status, CASE WHEN c_custkey % 3 = 2 THEN c_name END AS value FROM customer""")
def decisions(spark, sf_dir):
    k = F.col("c_custkey") % 3
    v = F.when(k == 0, '"dogru"').when(k == 1, '"atla"').otherwise(F.format_string('["duzeltildi","%s"]', "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", readers.decision(v).alias("d")).select("c_custkey", "d.status", "d.value")


@query("SELECT p_partkey, p_name || chr(10) || p_brand || ' & ' || p_type AS cover FROM part")
def cover_texts(spark, sf_dir):
    x = F.format_string("<tei><front>%s<lb/> <lb/><b>%s</b> &amp; %s</front><body>x</body></tei>", "p_name", "p_brand", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", readers.cover_text(x).alias("cover"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS n_titles, CAST(CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_abstracts FROM pages")
def gold_alternatives(spark, sf_dir):
    """Records of two generations in one shape."""
    k = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(k % 2 == 0, F.array("url", "url")).alias("titles"), F.col("url").alias("title"), F.lit(None).cast("array<string>").alias("abstracts"), F.when(k % 5 != 0, F.col("url")).otherwise("").alias("abstract"))
    g = readers.gold_alternatives(rows)
    return g.select("page_id", F.size("titles").alias("n_titles"), F.size("abstracts").alias("n_abstracts"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer")
def upsert_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return writers.upsert(c, c.filter("c_custkey % 2 = 0").withColumn("c_name", F.lit("new")), "c_custkey")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def keyed_store(spark, sf_dir):
    """A stored table of each customer's latest order, filled by three batches of which one comes twice."""
    store = KeyedStore(spark, f"{folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}", "o_custkey", ["o_orderdate", "o_orderkey"], 8)
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    for number, part in ((0, 2), (1, 0), (2, 1), (1, 0)):
        store.upsert(orders.filter(F.col("o_orderkey") % 3 == part), number)
    return store.rows().select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH r AS (SELECT *, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 20 AS block FROM customer)
SELECT c_nationkey, block, '[' || string_agg('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}', ',' ORDER BY c_custkey) || ']' AS data FROM r GROUP BY c_nationkey, block""")
def json_payload(spark, sf_dir):
    return writers.payload(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name"), "c_nationkey", 20)


@query("SELECT p_partkey, '%PDF-' || p_name || '%%EOF' AS content FROM part")
def pdf_repair(spark, sf_dir):
    """Bytes around a document are cut off."""
    c = F.encode(F.concat(F.lit("junk"), F.lit("%PDF-"), "p_name", F.lit("%%EOF"), F.lit("tail")), "ISO-8859-1")
    return table(spark, sf_dir, "part").select("p_partkey", F.decode(readers.cut_pdf(readers.cut_pdf(c)), "ISO-8859-1").alias("content"))


@query("SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]*)', 1) AS title FROM pages")
def embedded_value(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title[^>]*>([^<]*)", 1).alias("title"))


@query(f"""WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS a, regexp_extract(html, '(?s)<p>(.*?)</p>', 1) AS b FROM pages)
SELECT page_id, contains(regexp_replace(lower(b), '[^a-z0-9]', '', 'g'), regexp_replace(lower(array_to_string(list_slice(string_split(a, ' '), 1, 4), ' ')), '[^a-z0-9]', '', 'g')) AS inside FROM t""")
def prefix_containment(spark, sf_dir):
    """Whether the first four words of the title stand in the first paragraph."""
    a, b = F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1), F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.contains(n.alnum_ascii(b), n.alnum_ascii(F.array_join(F.slice(F.split(a, " "), 1, 4), " "))).alias("inside"))
