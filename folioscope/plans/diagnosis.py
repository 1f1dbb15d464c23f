"""Diagnosis queries: measures of whole texts, and the ladders on them.

The driver's documents have no parser measures; those are derived from doc_id and n_chars in the same way in
both engines, so that every rung of every ladder is reached.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import rules as r
from folioscope.operators.sets import complete
from folioscope.plans.registry import query, table
from folioscope.sources import writers


def _hits(words) -> str:
    return f"len(regexp_extract_all(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', '  ', 'g'), '(^| )({'|'.join(words)})( |$)'))"


_LETTERS = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"
_MEASURED = f"""measured AS (SELECT doc_id, source, lang AS tongue, n_chars,
  CAST(n_chars % 2400 AS DOUBLE) AS chars, {_LETTERS} * 100.0 / greatest(length(regexp_replace(text, '\\s', '', 'g')), 1) - CASE WHEN doc_id % 17 = 0 THEN 75 WHEN doc_id % 19 = 0 THEN 40 ELSE 0 END AS letters,
  CAST(doc_id % 9 AS DOUBLE) AS replaced, CAST(doc_id % 20 AS DOUBLE) AS anomalies, CAST(n_chars * 3 AS DOUBLE) AS body, (doc_id % 101) / 100.0 AS title,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id * 3 % 101) / 100.0 END AS abstract, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id * 7 % 11) / 10.0 END AS authors,
  doc_id % 13 <> 0 AS ok, CAST(1 + doc_id % 45 AS INTEGER) AS pages, CASE WHEN {_hits(r.TURKISH_WORDS)} > {_hits(r.ENGLISH_WORDS)} * 1.3 THEN 'tr' WHEN {_hits(r.ENGLISH_WORDS)} > {_hits(r.TURKISH_WORDS)} * 1.3 THEN 'en' ELSE 'mix' END AS dil,
  string_split(CASE doc_id % 5 WHEN 0 THEN 'temiz' WHEN 1 THEN 'a' WHEN 2 THEN 'a;b' WHEN 3 THEN 'a;b;a;c' ELSE '' END, ';') AS flags FROM documents)"""


def measured(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    d = d.withColumns({"_tr": r.word_hits(F.col("text"), r.TURKISH_WORDS), "_en": r.word_hits(F.col("text"), r.ENGLISH_WORDS), "_letters": r.letter_share(F.col("text"))})
    flags = F.when(i % 5 == 0, "temiz").when(i % 5 == 1, "a").when(i % 5 == 2, "a;b").when(i % 5 == 3, "a;b;a;c").otherwise("")
    return d.select(
        "doc_id", "source", F.col("lang").alias("tongue"), "n_chars",
        (F.col("n_chars") % 2400).cast("double").alias("chars"),
        (F.col("_letters") - F.when(i % 17 == 0, 75).when(i % 19 == 0, 40).otherwise(0)).alias("letters"),
        (i % 9).cast("double").alias("replaced"), (i % 20).cast("double").alias("anomalies"), (F.col("n_chars") * 3).cast("double").alias("body"),
        ((i % 101) / 100.0).alias("title"), F.when(i % 7 != 0, (i * 3 % 101) / 100.0).alias("abstract"), F.when(i % 11 != 0, (i * 7 % 11) / 10.0).alias("authors"),
        (i % 13 != 0).alias("ok"), (1 + i % 45).cast("int").alias("pages"), r.vote(F.col("_tr"), F.col("_en")).alias("dil"), F.split(flags, ";").alias("flags"),
    )


def _c(*names):
    return [F.col(n) for n in names]


_SCORE = """round_even((CASE WHEN scanned THEN 45.0 WHEN letters < 45 THEN 32.0 WHEN letters < 60 THEN 10.0 ELSE 0.0 END)
  + (CASE WHEN NOT ok AND NOT scanned THEN 28.0 ELSE 0.0 END)
  + (CASE WHEN NOT scanned AND ok THEN coalesce((1 - title) * 22, 0.0) + (CASE WHEN abstract IS NULL THEN 10.0 WHEN abstract < 0.45 THEN (1 - abstract) * 12 ELSE 0.0 END)
     + coalesce((1 - authors) * 10, 0.0) + (CASE WHEN body <> 0 AND body < 500 THEN 14.0 ELSE 0.0 END) + (least(anomalies, 15.0) + least(replaced * 1.5, 10.0)) ELSE 0.0 END)
  + greatest(0, len(list_distinct(list_filter(flags, lambda x: x <> '' AND x <> 'temiz'))) - 1) * 4, 0)"""
_SCORED = f"""{_MEASURED}, scored AS (SELECT *, CAST(least(100, {_SCORE}) AS INTEGER) AS score FROM (SELECT *, (chars <> 0 AND chars < 120) OR letters < 8 AS scanned FROM measured))"""
_BAND = "CASE WHEN score < 20 THEN 'hafif' WHEN score <= 50 THEN 'orta' ELSE 'agir' END"
_PRIMARY = """CASE WHEN dil = 'en' THEN NULL WHEN (chars < 200 OR letters < 20) AND pages BETWEEN 3 AND 60 AND letters < 8 THEN 'taranmis'
  WHEN (chars < 200 OR letters < 20) AND pages BETWEEN 3 AND 60 THEN 'bozuk-font' WHEN NOT ok OR pages NOT BETWEEN 3 AND 40 THEN NULL
  WHEN chars < 120 OR letters < 8 THEN 'taranmis' WHEN letters < 45 THEN 'bozuk-font' WHEN replaced > 4 THEN 'karakter-anomali' WHEN title < 0.30 THEN 'header-title-yok'
  WHEN title < 0.72 THEN 'baslik-yanlis' WHEN body < 500 THEN 'govde-yok' WHEN abstract IS NULL OR abstract < 0.45 THEN 'ozet-eksik' WHEN authors < 0.5 THEN 'yazar-eksik' END"""
_TIER = "CASE WHEN primary_ IN ('baslik-yanlis', 'ozet-eksik', 'yazar-eksik') THEN 'orta' WHEN primary_ IS NOT NULL THEN 'zor' END"


def scored(spark, sf_dir):
    m = measured(spark, sf_dir)
    s = r.severity(*_c("chars", "letters", "replaced", "anomalies", "body", "title", "abstract", "authors"), ~F.col("ok"), F.col("flags"))
    return m.withColumn("score", s)


def classed(spark, sf_dir):
    m = measured(spark, sf_dir)
    return m.withColumn("x", r.taxonomy(*_c("dil", "ok", "chars", "letters", "pages", "replaced", "title", "body", "abstract", "authors")))


@query(f"SELECT doc_id, CAST({_hits(r.TURKISH_WORDS)} AS INTEGER) AS tr, CAST({_hits(r.ENGLISH_WORDS)} AS INTEGER) AS en, CASE WHEN {_hits(r.TURKISH_WORDS)} > {_hits(r.ENGLISH_WORDS)} * 1.3 THEN 'tr' WHEN {_hits(r.ENGLISH_WORDS)} > {_hits(r.TURKISH_WORDS)} * 1.3 THEN 'en' ELSE 'mix' END AS dil FROM documents")
def lang_vote(spark, sf_dir):
    t = F.col("text")
    d = table(spark, sf_dir, "documents").select("doc_id", r.word_hits(t, r.TURKISH_WORDS).alias("tr"), r.word_hits(t, r.ENGLISH_WORDS).alias("en"))
    return d.select("doc_id", "tr", "en", r.vote(F.col("tr"), F.col("en")).alias("dil"))


@query(f"SELECT doc_id, {_LETTERS} * 100.0 / greatest(length(regexp_replace(text, '\\s', '', 'g')), 1) AS letters, CAST(length(text) - length(translate(text, '{r.TURKISH_LETTERS}', '')) AS INTEGER) AS tr_letters, CAST(length(text) - length(translate(text, chr(65533), '')) AS INTEGER) AS replaced FROM documents")
def letter_ratio(spark, sf_dir):
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", r.letter_share(t).alias("letters"), (F.length(t) - F.length(F.translate(t, r.TURKISH_LETTERS, ""))).alias("tr_letters"), (F.length(t) - F.length(F.translate(t, "�", ""))).alias("replaced"))


@query(f"""WITH g AS (SELECT doc_id, (length(text) - length(regexp_replace(text, '{r.GLYPH_NAME}', '', 'g'))) / CAST(greatest(length(text), 1) AS DOUBLE) AS glyphs, {_LETTERS} / CAST(greatest(length(text), 1) AS DOUBLE) AS letters, length(trim(text)) AS n FROM documents)
SELECT doc_id, glyphs, CASE WHEN n < 100 THEN 'metinsiz' WHEN glyphs >= 0.30 OR letters < 0.45 THEN 'bozuk_kodlama' WHEN glyphs >= 0.03 THEN 'kismen_bozuk' ELSE 'saglam' END AS layer FROM g""")
def text_layer_class(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", r.glyph_share(F.col("text")).alias("glyphs"), r.text_layer(F.col("text")).alias("layer"))


@query(f"WITH {_SCORED} SELECT doc_id, score, {_BAND} AS band FROM scored")
def severity_score(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "score", r.severity_band(F.col("score")).alias("band"))


@query(f"WITH {_MEASURED}, c AS (SELECT doc_id, {_PRIMARY} AS primary_ FROM measured) SELECT doc_id, primary_ AS primary_label, {_TIER} AS tier FROM c")
def primary_taxonomy(spark, sf_dir):
    return classed(spark, sf_dir).select("doc_id", F.col("x.primary").alias("primary_label"), F.col("x.tier").alias("tier"))


@query(f"""WITH {_MEASURED}, c AS (SELECT doc_id, {_PRIMARY} AS primary_ FROM measured)
SELECT CASE WHEN primary_ IN ('taranmis', 'bozuk-font') THEN 'agir' WHEN primary_ IS NULL THEN 'kolay' WHEN primary_ IN ('baslik-yanlis', 'ozet-eksik', 'yazar-eksik') THEN 'orta' ELSE 'zor' END AS bucket, count(*) AS n FROM c GROUP BY 1""")
def bucket_map(spark, sf_dir):
    p = F.col("x.primary")
    b = r.first_of((p.isin("taranmis", "bozuk-font"), "agir"), (p.isNull(), "kolay"), (p.isin("baslik-yanlis", "ozet-eksik", "yazar-eksik"), "orta"), otherwise="zor")
    return classed(spark, sf_dir).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_MEASURED} SELECT doc_id, CASE WHEN NOT ok THEN 'grobid-calismadi' WHEN dil = 'en' THEN 'ingilizce' WHEN chars < 400 OR letters < 55 THEN 'taranmis' WHEN pages NOT BETWEEN 5 AND 28 THEN 'sayfa-araligi'
 WHEN replaced > 4 THEN 'karakter-bozuk' WHEN body < 1500 THEN 'govde-kisa' WHEN title < 0.4 THEN 'baslik-cok-yanlis' END AS reason FROM measured""")
def reject_reason(spark, sf_dir):
    return measured(spark, sf_dir).select("doc_id", r.reject_reason(*_c("ok", "dil", "chars", "letters", "pages", "replaced", "body", "title")).alias("reason"))


@query(f"""WITH {_MEASURED} SELECT doc_id, concat_ws(';', CASE WHEN chars < 400 OR letters < 55 THEN 'taranmis/dusuk-metin' END, CASE WHEN pages NOT BETWEEN 4 AND 30 THEN 'sayfa=' || pages END,
 CASE WHEN anomalies < 30 OR dil = 'en' THEN 'turkce-degil' END, CASE WHEN replaced > 4 THEN 'karakter-bozuk' END, CASE WHEN NOT ok THEN 'grobid-crash' END, CASE WHEN title < 0.75 THEN 'baslik_sim' END,
 CASE WHEN abstract IS NULL THEN 'ozet-yok' END, CASE WHEN abstract < 0.45 THEN 'ozet_sim' END, CASE WHEN authors < 0.5 THEN 'yazar_rec' END, CASE WHEN body < 1500 THEN 'govde-kisa' END) AS reasons FROM measured""")
def reject_reasons(spark, sf_dir):
    m = measured(spark, sf_dir)
    x = r.reject_reasons(*_c("chars", "letters", "pages", "anomalies", "dil", "replaced", "ok", "title", "abstract", "authors", "body"))
    return m.select("doc_id", F.array_join(x, ";").alias("reasons"))


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1994 THEN 'early' ELSE 'late' END AS half,
 CASE WHEN CAST(year(o_orderdate) + 16 AS INTEGER) <= 2012 THEN '<=2012' WHEN CAST(year(o_orderdate) + 16 AS INTEGER) <= 2018 THEN '2013-2018' ELSE '2019+' END AS band FROM orders""")
def year_bands(spark, sf_dir):
    y = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(y <= 1994, "early").otherwise("late").alias("half"), r.year_band((y + 16).cast("string")).alias("band"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'pdfTeX-1.40' WHEN 1 THEN 'Adobe InDesign CS6' WHEN 2 THEN 'Microsoft Word 2016' WHEN 3 THEN 'ABBYY FineReader' WHEN 4 THEN p_name ELSE '' END AS producer, p_size, p_retailprice FROM part),
k AS (SELECT *, CASE WHEN regexp_matches(lower(producer), 'latex|pdftex|tex live|dvips|xetex|luatex') THEN 'latex' WHEN regexp_matches(lower(producer), 'indesign|quark') THEN 'indesign' WHEN regexp_matches(lower(producer), 'word|libreoffice|openoffice|writer') THEN 'word'
 WHEN regexp_matches(lower(producer), 'scan|abbyy|finereader|omnipage|paper capture') THEN 'scan' WHEN trim(producer) <> '' THEN 'other' ELSE 'bos' END AS kind FROM p)
SELECT p_partkey, kind, (1 + p_size % 2 = 2) AND p_size / 500.0 < 0.11 AND p_retailprice / 1000 < 1.8 AND (p_size / 50.0) > 0.33 AND (p_size / 50.0) < 0.67 AND kind IN ('word', 'other', 'bos') AND p_partkey % 2 = 1 AS imitation FROM k""")
def producer_and_imitation(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    producer = F.when(k == 0, "pdfTeX-1.40").when(k == 1, "Adobe InDesign CS6").when(k == 2, "Microsoft Word 2016").when(k == 3, "ABBYY FineReader").when(k == 4, F.col("p_name")).otherwise("")
    kind, z = r.producer_class(producer), F.col("p_size")
    x = r.template_imitation(1 + z % 2, z / 500.0, F.col("p_retailprice") / 1000, z / 50.0, F.lit(0), kind, F.col("p_partkey") % 2)
    return p.select("p_partkey", kind.alias("kind"), x.alias("imitation"))


@query(f"""WITH {_MEASURED}, c AS (SELECT m.doc_id, {_PRIMARY} AS p, CASE WHEN m.doc_id % 4 = 0 THEN 'metinsiz' WHEN m.doc_id % 4 = 1 THEN 'bozuk_kodlama' WHEN m.doc_id % 4 = 2 THEN 'kismen_bozuk' ELSE 'saglam' END AS layer FROM measured m),
q AS (SELECT doc_id, coalesce(p, 'temiz-tr-taze') AS p, layer FROM c)
SELECT doc_id, CASE WHEN layer = 'metinsiz' AND p NOT IN ('grobid-crash', 'taranmis') THEN 'gercekten metinsiz -> taranmis/OCR sinifi' WHEN layer = 'bozuk_kodlama' AND p = 'taranmis' THEN 'taranmis DEGIL: metin katmani var ama kodlamasi bozuk -> bozuk-font'
 WHEN layer = 'bozuk_kodlama' AND p = 'temiz-tr-taze' THEN 'temiz DEGIL: kodlamasi bozuk -> bozuk-font (kolay katmandan cikarilmali)' WHEN layer = 'bozuk_kodlama' AND p <> 'bozuk-font' THEN 'kodlama bozuk -> FLAGS''e bozuk-font eklenmeli'
 WHEN layer = 'kismen_bozuk' AND p = 'temiz-tr-taze' THEN 'kismi glif bozulmasi (govdede); baslik etkilenmiyorsa kolay kalabilir' ELSE '' END AS hint FROM q""")
def layer_contradiction(spark, sf_dir):
    i = F.col("doc_id") % 4
    layer = F.when(i == 0, "metinsiz").when(i == 1, "bozuk_kodlama").when(i == 2, "kismen_bozuk").otherwise("saglam")
    return classed(spark, sf_dir).select("doc_id", r.layer_hint(F.coalesce("x.primary", F.lit("temiz-tr-taze")), layer).alias("hint"))


_REASON_TEXT = "CASE doc_id % 4 WHEN 0 THEN 'yazar: EKSIK SOYAD, sira farkli; ' WHEN 1 THEN 'kelime: ayni terimler, SIRA degismis; ' WHEN 2 THEN 'baslik: BOSLUK EKSIK; ' ELSE '' END || text"
_REASON_ROWS = ", ".join("('" + "', '".join(x.replace("'", "''") for x in rule) + "')" for rule in r.REASON_RULES)


@query(f"WITH rules(field, category, pattern) AS (VALUES {_REASON_ROWS}), reasons AS (SELECT doc_id, {_REASON_TEXT} AS reason FROM documents) SELECT field, category, count(*) AS n FROM reasons, rules WHERE regexp_matches(reason, '(?i)' || pattern) GROUP BY field, category")
def reason_categories(spark, sf_dir):
    """Free-text reasons to categories by pattern; a reason may fall in several. The rules are columns, not a join."""
    i = F.col("doc_id") % 4
    text = F.concat(F.when(i == 0, "yazar: EKSIK SOYAD, sira farkli; ").when(i == 1, "kelime: ayni terimler, SIRA degismis; ").when(i == 2, "baslik: BOSLUK EKSIK; ").otherwise(""), F.col("text"))
    found = table(spark, sf_dir, "documents").select(text.alias("reason")).select(F.array_compact(F.array(*[F.when(F.col("reason").rlike(f"(?i){p}"), F.struct(F.lit(f).alias("field"), F.lit(c).alias("category"))) for f, c, p in r.REASON_RULES])).alias("hits"))
    return found.select(F.explode("hits").alias("h")).groupBy("h.field", "h.category").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_MEASURED}, e AS (SELECT doc_id, unnest(list_distinct(list_filter(flags, lambda x: x <> ''))) AS flag FROM measured),
r AS (SELECT flag, doc_id, (row_number() OVER (PARTITION BY flag ORDER BY doc_id) - 1) // 100 AS block FROM e)
SELECT flag, block, count(*) AS n, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS ids FROM r GROUP BY flag, block""")
def flags_inverted_index(spark, sf_dir):
    """Label -> sorted ids (as a digest), a hundred in a block."""
    e = measured(spark, sf_dir).select("doc_id", F.filter("flags", lambda x: x != "").alias("flags"))
    lists = writers.inverted_index(e, "doc_id", "flags", 100)
    return lists.select(F.col("label").alias("flag"), "block", "n", F.md5(F.array_join("ids", ",")).alias("ids"))


@query(f"""WITH {_MEASURED}, f AS (SELECT len(list_distinct(list_filter(flags, lambda x: x <> ''))) AS k FROM measured) SELECT CAST(k AS INTEGER) AS n_flags, count(*) AS n FROM f GROUP BY k""")
def flags_per_row(spark, sf_dir):
    return measured(spark, sf_dir).groupBy(F.size(F.array_distinct(F.filter("flags", lambda x: x != ""))).alias("n_flags")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SCORED}, c AS (SELECT score, coalesce({_PRIMARY}, 'temiz') AS p FROM scored) SELECT p AS primary_label, count(*) AS n, round(avg(score), 6) AS mean, min(score) AS low, max(score) AS high FROM c GROUP BY p""")
def severity_by_class(spark, sf_dir):
    x = scored(spark, sf_dir).withColumn("x", r.taxonomy(*_c("dil", "ok", "chars", "letters", "pages", "replaced", "title", "body", "abstract", "authors")))
    return x.groupBy(F.coalesce("x.primary", F.lit("temiz")).alias("primary_label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))


@query(f"""WITH {_SCORED}, c AS (SELECT tongue, {_BAND} AS band FROM scored) SELECT tongue, count(*) FILTER (WHERE band = 'hafif') AS hafif, count(*) FILTER (WHERE band = 'orta') AS orta, count(*) FILTER (WHERE band = 'agir') AS agir FROM c GROUP BY tongue""")
def crosstab_severity(spark, sf_dir):
    return scored(spark, sf_dir).select("tongue", r.severity_band(F.col("score")).alias("band")).groupBy("tongue").pivot("band", ["hafif", "orta", "agir"]).count().na.fill(0)


@query(f"""WITH {_MEASURED}, g AS (SELECT CASE WHEN NOT ok THEN '1-parser' WHEN dil = 'en' THEN '2-language' WHEN letters < 55 THEN '3-letters' WHEN title < 0.4 THEN '4-title' ELSE '5-passed' END AS gate FROM measured)
SELECT gate, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM g GROUP BY gate""")
def first_failing_gate(spark, sf_dir):
    g = measured(spark, sf_dir).select(r.first_of((~F.col("ok"), "1-parser"), (F.col("dil") == "en", "2-language"), (F.col("letters") < 55, "3-letters"), (F.col("title") < 0.4, "4-title"), otherwise="5-passed").alias("gate"))
    n = g.groupBy("gate").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


_CAUSE = "CASE WHEN n_text < 50 THEN 'no-text' WHEN xml IS NULL THEN 'no-output' WHEN length(trim(xml)) < 100 THEN 'short-output' WHEN NOT front THEN 'no-front' WHEN trim(title) = '' THEN 'empty-title' ELSE 'other' END"
_OUTPUTS = """outputs AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 20 ELSE length(trim(html)) END AS n_text, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 7 = 1 THEN '<x/>' ELSE html END AS xml,
 contains(html, '<h1') AND page_id % 5 <> 0 AS front, CASE WHEN page_id % 3 = 0 THEN '  ' ELSE regexp_extract(html, '<title[^>]*>([^<]*)', 1) END AS title FROM pages)"""


@query(f"WITH {_OUTPUTS}, c AS (SELECT {_CAUSE} AS cause FROM outputs) SELECT cause, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM c GROUP BY cause")
def root_cause(spark, sf_dir):
    """The first rung that explains why a document has no title, and the shares of the rungs."""
    i, h = F.col("page_id"), F.col("html")
    x = table(spark, sf_dir, "pages").select(
        F.when(i % 11 == 0, 20).otherwise(F.length(F.trim(h))).alias("n_text"), F.when(i % 7 == 0, None).when(i % 7 == 1, "<x/>").otherwise(h).alias("xml"),
        (h.contains("<h1") & (i % 5 != 0)).alias("front"), F.when(i % 3 == 0, "  ").otherwise(F.regexp_extract(h, "<title[^>]*>([^<]*)", 1)).alias("title"),
    )
    n = x.groupBy(r.root_cause(*_c("n_text", "xml", "front", "title")).alias("cause")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


_CONV_PAGES = "per AS (SELECT conv_id, count(*) AS pages, avg(CASE WHEN nth <= 3 THEN length(text) END) < 100 AS scanned FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations) GROUP BY conv_id)"


@query(f"WITH {_CONV_PAGES} SELECT conv_id, pages, scanned FROM per")
def scanned_documents(spark, sf_dir):
    """Documents, with turns as their pages: number of pages, and whether the first three hold less than 100 characters on average."""
    return r.page_measures(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(f"WITH {_CONV_PAGES} SELECT count(*) AS n, count(*) FILTER (WHERE scanned) AS scanned, count(*) FILTER (WHERE pages = 1) AS one_page, round(avg(pages), 6) AS mean_pages, median(pages) AS median_pages FROM per")
def page_summary(spark, sf_dir):
    x = scanned_documents(spark, sf_dir)
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if("scanned").alias("scanned"), F.count_if(F.col("pages") == 1).alias("one_page"), F.round(F.avg("pages"), 6).alias("mean_pages"), F.median("pages").alias("median_pages"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'none' WHEN c_acctbal / 100 >= 70 THEN 'high' WHEN c_acctbal / 100 >= 40 THEN 'medium' ELSE 'low' END AS colour,
 CASE WHEN c_custkey % 3 = 0 THEN 'Eksik:segment' || CASE WHEN c_custkey % 2 = 0 THEN '+name' ELSE '' END WHEN c_custkey % 2 = 0 THEN 'Eksik:name' ELSE 'Tam' END AS status,
 coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, ''), c_mktsegment) AS title FROM customer""")
def completeness_and_colour(spark, sf_dir):
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name, segment = F.when(i % 2 == 0, "").otherwise(F.col("c_name")), F.when(i % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", r.score_class(F.col("c_acctbal") / 100).alias("colour"), r.completeness(segment=segment, name=name).alias("status"), r.first_filled(name, F.col("c_mktsegment")).alias("title"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0")
def completeness_filter(spark, sf_dir):
    """Rows whose name and segment are filled; every third name is blank and every fifth segment missing."""
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.select("c_custkey", "c_name", F.when(i % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(i % 5 != 0, F.col("c_mktsegment")).alias("segment"))
    return complete(rows, "name", "segment").select("c_custkey", "c_name")


@query("""WITH d AS (SELECT doc_id, text FROM documents), e AS (SELECT unnest(regexp_extract_all(text, '[^\\x00-\\x7Fa-zA-ZçğıöşüÇĞİÖŞÜ]')) AS ch FROM d) SELECT ch, count(*) AS n FROM e GROUP BY ch""")
def char_anomaly(spark, sf_dir):
    """How often each character outside ASCII and the Turkish letters occurs."""
    found = F.regexp_extract_all("text", F.lit("[^\\x00-\\x7Fa-zA-ZçğıöşüÇĞİÖŞÜ]"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.explode(found).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
