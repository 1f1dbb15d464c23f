"""Evaluation queries: pages as parser output, conversations as ordered lists, labels as decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import normalize as n
from folioscope.functions import similarity as s
from folioscope.operators import evaluate as e
from folioscope.operators.layout import layout_features
from folioscope.operators.spans import overlap_share
from folioscope.plans.normalization import _collapse, _drop, _low, _sql_translate, _table
from folioscope.plans.registry import query, table


def _first(tag: str):
    return n.strip_all_tags(F.regexp_extract("html", f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))


def page_fields(spark, sf_dir):
    """id, title, h1, first paragraph and address words of each page."""
    slug = F.regexp_replace(F.regexp_extract("url", "://([^/?#]*)", 1), "[.]", " ")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), _first("title").alias("title"), _first("h1").alias("h1"), _first("p").alias("lead"), slug.alias("slug"))


def _sql_first(tag: str) -> str:
    return _collapse(f"regexp_replace(regexp_extract(html, '(?s)<{tag}[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', ' ', 'g')")


_PAGES = f"""pf AS (SELECT page_id AS id, {_sql_first('title')} AS title, {_sql_first('h1')} AS h1, {_sql_first('p')} AS lead,
  replace(regexp_extract(url, '://([^/?#]*)', 1), '.', ' ') AS slug FROM pages)"""


def _soft(x: str, fold: bool = True) -> str:
    return _drop(_sql_translate(_low(x), *n.SOFT_FOLD) if fold else _low(x), n.NON_WORD)


def _coded(x: str) -> str:
    """One byte for each different character of a pair of texts (126 at most), as the distance of bytes is that of characters then."""
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: chr(CAST(list_position(chars, c) AS INTEGER))), '')"


def _pairs(fold: bool) -> str:
    return f"""{_PAGES}, rows AS (
  SELECT id, 'title' AS field, h1 AS pred, title AS gold FROM pf UNION ALL
  SELECT id, 'lead', lead, title FROM pf UNION ALL
  SELECT id, 'host', slug, h1 FROM pf
), folded AS (SELECT id, field, pred, gold, {_soft('pred', fold)} AS a, {_soft('gold', fold)} AS b FROM rows WHERE trim(gold) <> ''),
known AS (SELECT *, list_distinct(regexp_extract_all(a || b, '(?s).')) AS chars FROM folded),
decided AS (SELECT id, field, trim(pred) <> '' AS predicted, {_collapse('pred')} = {_collapse('gold')} AS strict, a = b AS soft,
  CASE WHEN greatest(length(a), length(b)) = 0 THEN true WHEN least(length(a), length(b)) = 0 THEN false
       WHEN least(length(a), length(b)) * 5 < greatest(length(a), length(b)) * 4 THEN false
       ELSE levenshtein({_coded('a')}, {_coded('b')}) <= greatest(length(a), length(b)) // 5 END AS levenshtein FROM known),
long AS (
  SELECT 'strict' AS mode, field, predicted, predicted AND strict AS m FROM decided UNION ALL
  SELECT 'soft', field, predicted, predicted AND soft FROM decided UNION ALL
  SELECT 'levenshtein', field, predicted, predicted AND levenshtein FROM decided
), sums AS (SELECT mode, field, count(*) AS support, count(*) FILTER (WHERE predicted) AS predicted, count(*) FILTER (WHERE m) AS matched FROM long GROUP BY mode, field)"""

_PRF = """SELECT mode, field, support, predicted, matched,
  CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(matched AS DOUBLE) / predicted END AS precision, CAST(matched AS DOUBLE) / support AS recall,
  CASE WHEN matched = 0 THEN 0.0 ELSE 2 * (CAST(matched AS DOUBLE) / predicted) * (CAST(matched AS DOUBLE) / support) / ((CAST(matched AS DOUBLE) / predicted) + (CAST(matched AS DOUBLE) / support)) END AS f1 FROM sums"""


def _rows(spark, sf_dir):
    p = page_fields(spark, sf_dir)
    parts = [("title", "h1", "title"), ("lead", "lead", "title"), ("host", "slug", "h1")]
    return p.select("id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(a).alias("pred"), F.array(b).alias("golds")) for f, a, b in parts])))


@query(f"WITH {_pairs(True)} {_PRF}")
def eval_prf_pages(spark, sf_dir):
    """Three fields of pages in three match modes: support, predicted, matched, precision, recall, F1."""
    return e.prf(e.long_matches(_rows(spark, sf_dir), ("strict", "soft", "levenshtein"), fold=True))


@query()
def eval_prf_four_modes(spark, sf_dir):
    """All four modes, diacritics folded; longest-match has no SQL form."""
    return e.prf(e.long_matches(_rows(spark, sf_dir), fold=True))


@query(f"""SELECT mode, field, k.f1 AS base, f.f1 AS other, f.f1 - k.f1 AS gain
  FROM (WITH {_pairs(False)} {_PRF}) k JOIN (WITH {_pairs(True)} {_PRF}) f USING (mode, field)""")
def eval_fold_gain(spark, sf_dir):
    """F1 with and without folding of diacritics, and the difference."""
    rows = _rows(spark, sf_dir)
    kept = e.prf(e.long_matches(rows, ("strict", "soft", "levenshtein"), False)).withColumn("run", F.lit("kept"))
    folded = e.prf(e.long_matches(rows, ("strict", "soft", "levenshtein"), True)).withColumn("run", F.lit("folded"))
    return e.run_difference(kept.union(folded), "run", "kept", "folded")


_WORDS = "list_filter(list_distinct(string_split({0}, ' ')), lambda x: length(x) > 1)"


def _tok(x: str) -> str:
    return _collapse(_drop(_sql_translate(_low(_sql_translate(x, "".join(n.SHORT_GLYPHS), "".join(n.SHORT_GLYPHS.values()))), *n.TURKISH_FOLD), r"[^\p{L}\p{N}_\s]", " "))


_TURNS = f"""turns AS (SELECT conv_id, turn, text AS gold, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS pred FROM conversations),
sets AS (SELECT conv_id, turn, {_WORDS.format(_tok("coalesce(pred, '')"))} AS p, {_WORDS.format(_tok("coalesce(gold, '')"))} AS g FROM turns)"""


def _turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("gold"), F.lag("text").over(w).alias("pred"))


@query(f"""WITH {_TURNS} SELECT conv_id, turn,
  CASE WHEN len(g) = 0 THEN NULL WHEN len(p) = 0 THEN 0.0 ELSE round(CAST(len(list_intersect(p, g)) AS DOUBLE) / len(g) * 100, 6) END AS recall,
  CASE WHEN len(g) = 0 THEN NULL WHEN len(p) = 0 THEN 0.0 ELSE round(CAST(len(list_intersect(p, g)) AS DOUBLE) / len(p) * 100, 6) END AS precision FROM sets""")
def token_overlap(spark, sf_dir):
    """Words of a turn found in the turn before it."""
    sets = table(spark, sf_dir, "conversations").select("conv_id", "turn", s.token_set(F.col("text")).alias("g"))
    before = F.coalesce(F.lag("g").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>"))
    out = sets.withColumn("p", before).select("conv_id", "turn", s.token_sets(F.col("p"), F.col("g")).alias("x"))
    return out.select("conv_id", "turn", F.round("x.recall", 6).alias("recall"), F.round("x.precision", 6).alias("precision"))


@query(f"""WITH turns AS (SELECT conv_id, turn, list_filter(list_distinct(string_split({_tok('text')}, ' ')), lambda x: x <> '') AS g,
    list_filter(list_distinct(string_split({_tok("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)")}, ' ')), lambda x: x <> '') AS p FROM conversations)
  SELECT conv_id, turn, CASE WHEN len(g) = 0 THEN NULL WHEN len(p) = 0 OR p IS NULL THEN 0.0
    ELSE round(CAST(len(list_intersect(p, g)) AS DOUBLE) / len(list_distinct(list_concat(p, g))) * 100, 6) END AS jaccard FROM turns""")
def jaccard_turns(spark, sf_dir):
    """Words in common of neighbouring turns."""
    t = _turns(spark, sf_dir).select("conv_id", "turn", n.token_norm(F.coalesce("pred", F.lit(""))).alias("p"), n.token_norm(F.col("gold")).alias("g"))
    return t.select("conv_id", "turn", F.round(s.jaccard(F.col("p"), F.col("g")), 6).alias("jaccard"))


@query(f"""WITH {_PAGES}, sets AS (SELECT id, {_WORDS.format(_tok('lead'))} AS p, {_WORDS.format(_tok('title'))} AS a, {_WORDS.format(_tok('slug'))} AS b FROM pf),
scores AS (SELECT id, CASE WHEN len(a) = 0 THEN NULL WHEN len(p) = 0 THEN 0.0 ELSE CAST(len(list_intersect(p, a)) AS DOUBLE) / len(a) * 100 END AS r1,
  CASE WHEN len(a) = 0 THEN NULL WHEN len(p) = 0 THEN 0.0 ELSE CAST(len(list_intersect(p, a)) AS DOUBLE) / len(p) * 100 END AS p1,
  CASE WHEN len(b) = 0 THEN NULL WHEN len(p) = 0 THEN 0.0 ELSE CAST(len(list_intersect(p, b)) AS DOUBLE) / len(b) * 100 END AS r2,
  CASE WHEN len(b) = 0 THEN NULL WHEN len(p) = 0 THEN 0.0 ELSE CAST(len(list_intersect(p, b)) AS DOUBLE) / len(p) * 100 END AS p2 FROM sets)
SELECT id, CASE WHEN r1 IS NULL OR r2 > r1 THEN r2 ELSE r1 END AS recall, CASE WHEN r1 IS NULL OR r2 > r1 THEN p2 ELSE p1 END AS precision FROM scores""")
def best_of_two_references(spark, sf_dir):
    """The better of two alternative references by recall."""
    p = page_fields(spark, sf_dir)
    out = p.select("id", s.better_by_recall(s.token_recall_precision(F.col("lead"), F.col("title")), s.token_recall_precision(F.col("lead"), F.col("slug"))).alias("x"))
    return out.select("id", "x.recall", "x.precision")


@query("""
WITH y AS (SELECT o_orderkey, regexp_extract(CAST(o_orderdate AS VARCHAR), '\\b(19|20)\\d{2}\\b', 0) AS gold,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(1992 + o_orderkey % 7 AS VARCHAR) END AS pred FROM orders)
SELECT o_orderkey, CASE WHEN gold = '' THEN NULL WHEN pred = gold THEN 100.0 ELSE 0.0 END AS score FROM y""")
def exact_year_score(spark, sf_dir):
    """100 for the same year, 0 for another or none."""
    o = table(spark, sf_dir, "orders")
    pred = F.when(F.col("o_orderstatus") == "P", "").otherwise((F.lit(1992) + F.col("o_orderkey") % 7).cast("string"))
    return o.select("o_orderkey", s.exact_score(pred, n.year_of(F.col("o_orderdate").cast("string"))).cast("double").alias("score"))


_NAMES = "list_filter(list_distinct(string_split(replace({0}, '#', ' '), ' ')), lambda t: length(t) >= 3)"


_ANY_NAMES = """
WITH per AS (SELECT p_brand, p_type, list_sort(list_distinct(list(p_name))) AS names FROM part GROUP BY p_brand, p_type),
g AS (SELECT p_brand, list_sort(list_distinct(list(p_name))) AS gold FROM part GROUP BY p_brand),
pair AS (SELECT per.p_brand, p_type, list_transform(names, lambda x: list_filter(string_split(x, ' '), lambda t: length(t) >= 3)) AS p,
  list_transform(gold, lambda x: list_filter(string_split(x, ' '), lambda t: length(t) >= 3)) AS g FROM per JOIN g USING (p_brand))
SELECT p_brand, p_type, round(CAST(len(list_filter(g, lambda x: len(list_filter(p, lambda y: list_has_any(x, y))) > 0)) AS DOUBLE) / len(g), 6) AS recall,
  round(CAST(len(list_filter(p, lambda x: len(list_filter(g, lambda y: list_has_any(x, y))) > 0)) AS DOUBLE) / len(p), 6) AS precision FROM pair"""


@query(f"SELECT p_brand, p_type, CAST(floor(recall * 100 + 0.5) / 100 AS DOUBLE) AS recall FROM ({_ANY_NAMES})")
def author_recall(spark, sf_dir):
    """Recall of names that share a token, at two decimals."""
    return names_any_overlap(spark, sf_dir).select("p_brand", "p_type", F.round("recall", 2).alias("recall"))


@query(_ANY_NAMES)
def names_any_overlap(spark, sf_dir):
    """Names that share a token of three letters: recall and precision of each brand and type against its brand."""
    part = table(spark, sf_dir, "part")
    per = part.groupBy("p_brand", "p_type").agg(F.collect_set("p_name").alias("pred"))
    gold = part.groupBy("p_brand").agg(F.collect_set("p_name").alias("gold"))
    x = per.join(gold, "p_brand").select("p_brand", "p_type", s.author_scores(F.col("pred"), F.col("gold")).alias("x"))
    return x.select("p_brand", "p_type", F.round("x.recall", 6).alias("recall"), F.round("x.precision", 6).alias("precision"))


@query("""
WITH n AS (SELECT DISTINCT p_brand, p_type, p_name, (list_sort(list_transform(list_filter(string_split(p_name, ' '), lambda t: length(t) >= 3), lambda t: {'l': -length(t), 't': t})))[1].t AS k FROM part),
gold AS (SELECT DISTINCT p_brand, p_name, k FROM n), size AS (SELECT p_brand, count(*) AS n FROM gold GROUP BY 1),
hit AS (SELECT t.p_brand, t.p_type, count(*) AS h FROM (SELECT DISTINCT p_brand, p_type, k FROM n) t JOIN gold g ON g.p_brand = t.p_brand AND g.k = t.k GROUP BY 1, 2),
own AS (SELECT p_brand, p_type, CAST(count(k) AS DOUBLE) / count(*) AS p FROM n GROUP BY 1, 2),
x AS (SELECT p_brand, p_type, CAST(coalesce(h, 0) AS DOUBLE) / size.n AS r, p FROM own LEFT JOIN hit USING (p_brand, p_type) JOIN size USING (p_brand))
SELECT p_brand, p_type, round(r, 6) AS recall, round(p, 6) AS precision, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM x""")
def names_strict_overlap(spark, sf_dir):
    """Names whose longest token is the same."""
    part = table(spark, sf_dir, "part")
    per = part.groupBy("p_brand", "p_type").agg(F.collect_set("p_name").alias("pred"))
    gold = part.groupBy("p_brand").agg(F.collect_set("p_name").alias("gold"))
    x = per.join(gold, "p_brand").select("p_brand", "p_type", s.author_scores(F.col("pred"), F.col("gold")).alias("x"))
    return x.select("p_brand", "p_type", F.round("x.strict_recall", 6).alias("recall"), F.round("x.strict_precision", 6).alias("precision"), F.round(s.f1(F.col("x.strict_precision"), F.col("x.strict_recall")), 6).alias("f1"))


@query()
def title_decision(spark, sf_dir):
    """Similarity, coverage, excess and decision of each page's lead and heading against two alternatives."""
    p = page_fields(spark, sf_dir).select("id", n.score_norm(F.concat_ws(" ", "h1", "slug")).alias("pred"), F.array(n.score_norm(F.col("title")), n.score_norm(F.col("slug"))).alias("golds"))
    best = F.greatest(s.score_similarity("pred", F.col("golds")[0]), s.score_similarity("pred", F.col("golds")[1]))
    d = p.withColumn("similarity", best).withColumn("x", s.title_decision(F.col("pred"), F.col("golds"), F.col("similarity")))
    return d.select("id", "similarity", "x.coverage", "x.excess", "x.ok", "x.merged")


@query()
def longest_match_turns(spark, sf_dir):
    """Longest-match ratio of each turn with the one before it (the order of arguments matters)."""
    t = _turns(spark, sf_dir).filter("pred IS NOT NULL")
    return t.select("conv_id", "turn", s.longest_match_ratio(n.soft_norm(F.col("pred")), n.soft_norm(F.col("gold"))).alias("ratio"))


@query()
def reference_similarity(spark, sf_dir):
    """Similarity of the first 300 characters of neighbouring turns, as references are compared."""
    t = _turns(spark, sf_dir).filter("pred IS NOT NULL")
    return t.select("conv_id", "turn", s.reference_similarity(n.bibliography_norm(F.col("gold")), n.bibliography_norm(F.col("pred"))).alias("ratio"))


@query("""
SELECT a.p_partkey, CASE WHEN greatest(length(a.p_name), length(b.p_name)) = 0 THEN 1.0
   ELSE 1 - CAST(levenshtein(a.p_name, b.p_name) AS DOUBLE) / greatest(length(a.p_name), length(b.p_name)) END AS ratio
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def levenshtein_ratio(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return part.join(other, "p_partkey").select("p_partkey", s.levenshtein_ratio(F.col("p_name"), F.col("other")).alias("ratio"))


_DECIDED = """decided AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.quality = 1 AS gold,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) * 20 <= length(text) AS a, n_chars >= 600 AS b FROM documents d JOIN labels l USING (doc_id))"""


def _decided(spark, sf_dir):
    """Two heuristics as runs, labels as gold."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = F.length(F.regexp_replace("text", "[^#*$%&|<>]", ""))
    return d.join(l, "doc_id").select("doc_id", "lang", "source", "quality", (F.col("quality") == 1).alias("gold"), (marks * 20 <= F.length("text")).alias("a"), (F.col("n_chars") >= 600).alias("b"))


@query(f"""WITH {_DECIDED}, sums AS (SELECT count(*) FILTER (WHERE gold) AS support, count(*) FILTER (WHERE a) AS predicted, count(*) FILTER (WHERE a AND gold) AS matched FROM decided)
SELECT support, predicted, matched, CAST(matched AS DOUBLE) / predicted AS precision, CAST(matched AS DOUBLE) / support AS recall FROM sums""")
def eval_quality_prf(spark, sf_dir):
    x = _decided(spark, sf_dir).agg(F.count_if("gold").alias("support"), F.count_if("a").alias("predicted"), F.count_if(F.col("a") & F.col("gold")).alias("matched"))
    return x.withColumns({"precision": F.try_divide("matched", "predicted"), "recall": F.try_divide("matched", "support")})


@query(f"""WITH {_DECIDED} SELECT lang, CASE WHEN (a = gold) AND (b = gold) THEN 'both_solved' WHEN NOT (a = gold) AND (b = gold) THEN 'fixed'
 WHEN (a = gold) THEN 'broken' ELSE 'neither' END AS change, count(*) AS n FROM decided GROUP BY ALL""")
def eval_transition(spark, sf_dir):
    """What the second run fixed and broke, by language."""
    d = _decided(spark, sf_dir)
    return d.groupBy("lang", s.compare_runs(F.col("a") == F.col("gold"), F.col("b") == F.col("gold")).alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_DECIDED}, x AS (SELECT lang, CASE WHEN (a = gold) AND (b = gold) THEN 'both_solved' WHEN NOT (a = gold) AND (b = gold) THEN 'fixed' WHEN (a = gold) THEN 'broken' ELSE 'neither' END AS change FROM decided)
SELECT lang, count(*) FILTER (WHERE change = 'both_solved') AS both_solved, count(*) FILTER (WHERE change = 'fixed') AS fixed, count(*) FILTER (WHERE change = 'broken') AS broken, count(*) FILTER (WHERE change = 'neither') AS neither FROM x GROUP BY lang""")
def transition_by_language(spark, sf_dir):
    d = _decided(spark, sf_dir).select("lang", s.compare_runs(F.col("a") == F.col("gold"), F.col("b") == F.col("gold")).alias("change"))
    return d.groupBy("lang").pivot("change", ["both_solved", "fixed", "broken", "neither"]).count().na.fill(0)


@query(f"""WITH {_DECIDED}, g AS (SELECT 'lang' AS kind, lang AS value, a = gold AS ok, CAST(quality AS DOUBLE) AS q FROM decided UNION ALL SELECT 'source', source, a = gold, quality FROM decided UNION ALL SELECT 'total', '', a = gold, quality FROM decided)
SELECT kind, value, count(*) AS n, count(*) FILTER (WHERE ok) AS solved, CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) AS share, avg(q) AS mean_score FROM g GROUP BY kind, value""")
def breakdown_grouping_sets(spark, sf_dir):
    """Count, solved, share and mean by language, by source, and in total."""
    d = _decided(spark, sf_dir)
    return e.breakdown(d, ["lang", "source"], F.col("a") == F.col("gold"), F.col("quality").cast("double"))


@query(f"""WITH {_DECIDED}, s AS (SELECT 'first' AS run, count(*) FILTER (WHERE a = gold) AS ok, count(*) AS n FROM decided UNION ALL SELECT 'second', count(*) FILTER (WHERE b = gold), count(*) FROM decided)
SELECT max(CASE WHEN run = 'first' THEN 100.0 * ok / n END) AS first, max(CASE WHEN run = 'second' THEN 100.0 * ok / n END) AS second,
  max(CASE WHEN run = 'second' THEN 100.0 * ok / n END) - max(CASE WHEN run = 'first' THEN 100.0 * ok / n END) AS points FROM s""")
def two_runs_in_points(spark, sf_dir):
    """Two runs scored by one measure, the difference in points."""
    d = _decided(spark, sf_dir)
    out = d.agg(*[(F.lit(100.0) * F.count_if(F.col(c) == F.col("gold")) / F.count(F.lit(1))).alias(name) for c, name in (("a", "first"), ("b", "second"))])
    return out.withColumn("points", F.col("second") - F.col("first"))


def _long_words(x: str) -> str:
    word = _drop(_sql_translate(_low(_table("w", n.GLYPHS)), *n.TURKISH_FOLD), n.NON_WORD)
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array({x}, '\\s+'), lambda w: {word}), lambda w: length(w) > 2))"


@query(f"""WITH {_PAGES}, w AS (SELECT id, {_long_words('lead')} AS a, {_long_words('title')} AS g FROM pf)
SELECT id, CASE WHEN len(g) > 0 THEN round(CAST(len(list_intersect(a, g)) AS DOUBLE) / len(g), 6) END AS share FROM w""")
def header_overlap(spark, sf_dir):
    """Share of a title's words that the first paragraph has."""
    return page_fields(spark, sf_dir).select("id", F.round(overlap_share(F.col("lead"), F.col("title")), 6).alias("share"))


_BOXES = """boxes AS (SELECT page_id, CAST(CASE WHEN page_id % 2 = 0 AND i % 3 = 2 THEN 330 + k % 5 ELSE 50 + k % 7 END AS DOUBLE) AS x0, CAST(810 - (i * 14) % 760 AS DOUBLE) - z AS y0,
  CAST(CASE WHEN page_id % 2 = 0 AND i % 3 = 2 THEN 330 + k % 5 ELSE 50 + k % 7 END + least(k * 4, 230) AS DOUBLE) AS x1, CAST(810 - (i * 14) % 760 AS DOUBLE) AS y1, CAST(z AS DOUBLE) AS size, line
  FROM (SELECT page_id, i, line, length(line) AS k, CASE WHEN i = 3 THEN 18 ELSE 8 + length(line) % 3 END AS z FROM (SELECT page_id, unnest(regexp_extract_all(html, '>([^<>]+)<', 1)) AS line, generate_subscripts(regexp_extract_all(html, '>([^<>]+)<', 1), 1) - 1 AS i FROM pages)))"""


@query(f"""WITH {_BOXES}, p AS (SELECT page_id, min(x0) AS l, max(x1) AS r, max(y1) AS t, min(y0) AS b, median(size) AS m, quantile_cont(size, 0.9) - quantile_cont(size, 0.1) AS s,
  count(*) FILTER (WHERE x0 < 270) AS nl, count(*) FILTER (WHERE x0 > 300 AND x0 < 540) AS nr, median(x0) FILTER (WHERE x0 > 300 AND x0 < 540) AS mode_, quantile_cont(x1, 0.9) FILTER (WHERE x0 < 270) AS edge,
  avg(CASE WHEN y1 > 842 * 0.92 THEN 1.0 ELSE 0.0 END) AS h, avg(CASE WHEN y0 < 842 * 0.08 THEN 1.0 ELSE 0.0 END) AS f, sum(length(line)) AS n FROM boxes GROUP BY page_id),
g AS (SELECT page_id, y1 - lead(y1) OVER (PARTITION BY page_id ORDER BY y1 DESC, x0) AS gap FROM boxes),
l AS (SELECT page_id, median(gap) AS gap FROM g JOIN p USING (page_id) WHERE gap > 0 AND gap < 5 * m GROUP BY page_id),
big AS (SELECT page_id, x0, x1, y1, size FROM boxes JOIN p USING (page_id) WHERE size >= 1.35 * m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY y1 DESC, x0, size DESC, x1 DESC) = 1),
q AS (SELECT p.*, l.gap, big.y1, big.x0, big.x1, big.size, nr > 6 AND nl > 6 AND CAST(nr AS DOUBLE) / greatest(nl, 1) > 0.25 AS two FROM p LEFT JOIN l USING (page_id) LEFT JOIN big USING (page_id))
SELECT page_id, CASE WHEN two THEN 2 ELSE 1 END AS n_cols, round(l / 600, 4) AS margin_l, round(1 - r / 600, 4) AS margin_r, round(1 - t / 842, 4) AS margin_t, round(b / 842, 4) AS margin_b, round(m, 2) AS med_fontsize, round(s / greatest(m, 1), 3) AS font_spread,
  round(CASE WHEN two THEN (edge + mode_) / 2 / 600 ELSE 0 END, 4) AS gutter_center, round(CASE WHEN two THEN greatest(0, mode_ - edge) / 600 ELSE 0 END, 4) AS gutter_w, round(CASE WHEN two THEN mode_ - l ELSE r - l END / 600, 4) AS col_w, round(h, 3) AS hdr_band, round(f, 3) AS ftr_band,
  round(1 - coalesce(y1, t) / 842, 4) AS title_y, round(coalesce(size / m, 1.0), 3) AS title_ratio, round(CASE WHEN y1 IS NULL THEN l + r ELSE x0 + x1 END / 2 / 600, 3) AS title_cx, round(coalesce(gap / m, 1.2), 3) AS leading, round(n / (600 * 842.0) * 1000, 3) AS txt_density FROM q""")
def layout_fingerprint(spark, sf_dir):
    """Layout features of pages whose texts are set out in boxes: every third line in a right column on even pages, the fourth a title."""
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(">([^<>]+)<"), F.lit(1))).alias("i", "text"))
    k, i = F.length("text"), F.col("i")
    size = F.when(i == 3, 18).otherwise(8 + k % 3)
    x0 = F.when((F.col("page_id") % 2 == 0) & (i % 3 == 2), 330 + k % 5).otherwise(50 + k % 7)
    y1 = 810 - (i * 14) % 760
    boxes = lines.select("page_id", "text", *[c.cast("double").alias(name) for name, c in (("x0", x0), ("y0", y1 - size), ("x1", x0 + F.least(k * 4, F.lit(230))), ("y1", y1), ("size", size))])
    return layout_features(boxes, "page_id", 600, 842)
