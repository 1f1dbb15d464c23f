"""Joins, sets, aggregates, windows, orders over the driver's relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.operators import containment
from folioscope.operators import sets as o
from folioscope.operators import sketches
from folioscope.plans.registry import query, table


def _t(name):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


orders, customer, lineitem, nation, region, part, supplier, events, documents, labels = map(_t, ("orders", "customer", "lineitem", "nation", "region", "part", "supplier", "events", "documents", "labels"))


def _n():
    return F.count(F.lit(1)).alias("n")


# --- joins


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def join_inner(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "source").join(labels(spark, sf_dir).select("doc_id", "quality"), "doc_id")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'Orijinal Metadata Yok' ELSE 'Tam' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left_status(spark, sf_dir):
    l = labels(spark, sf_dir).select("doc_id", F.lit(True).alias("known"))
    return documents(spark, sf_dir).select("doc_id").join(l, "doc_id", "left").select("doc_id", F.when(F.col("known").isNull(), "Orijinal Metadata Yok").otherwise("Tam").alias("status"))


@query("SELECT p.p_partkey, p.p_name, coalesce(p.p_size, l.q) AS size, l.q FROM part p JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY l_partkey) l ON p.p_partkey = l.l_partkey")
def join_left_columns_win(spark, sf_dir):
    q = lineitem(spark, sf_dir).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("q"))
    return part(spark, sf_dir).select("p_partkey", "p_name", "p_size").join(q, "p_partkey").select("p_partkey", "p_name", F.coalesce("p_size", "q").alias("size"), "q")


@query("""SELECT c.c_custkey, CAST(coalesce(a.total, b.total, 0) AS DOUBLE) AS total FROM customer c
LEFT JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) a ON c.c_custkey = a.o_custkey
LEFT JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) b ON c.c_custkey = b.o_custkey""")
def join_two_sources_coalesced(spark, sf_dir):
    def total(status):
        x = orders(spark, sf_dir).filter(F.col("o_orderstatus") == status)
        return x.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias(f"t{status}"))

    c = customer(spark, sf_dir).select("c_custkey").join(total("F"), "c_custkey", "left").join(total("O"), "c_custkey", "left")
    return c.select("c_custkey", F.coalesce("tF", "tO", F.lit(0)).cast("double").alias("total"))


@query("""WITH m AS (SELECT o_custkey, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL)
SELECT a.o_custkey, a.m, CASE WHEN a.n > 0 AND b.n > 0 THEN 'both_solved' END AS change FROM m a JOIN m b ON a.o_custkey = b.o_custkey AND b.m = a.m - 1""")
def join_run_with_previous(spark, sf_dir):
    m = orders(spark, sf_dir).groupBy("o_custkey", F.month("o_orderdate").alias("m")).agg(_n())
    before = m.select("o_custkey", (F.col("m") + 1).alias("m"), F.col("n").alias("k"))
    return m.join(before, ["o_custkey", "m"]).select("o_custkey", "m", F.when((F.col("n") > 0) & (F.col("k") > 0), "both_solved").alias("change"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def exclude_anti(spark, sf_dir):
    x = orders(spark, sf_dir)
    return o.exclude(customer(spark, sf_dir).select("c_custkey"), "c_custkey", x.filter("o_orderstatus = 'P'").select("o_custkey"), x.filter("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')")
def require_semi(spark, sf_dir):
    x = lineitem(spark, sf_dir)
    return o.require(part(spark, sf_dir).select("p_partkey"), "p_partkey", x.filter("l_returnflag = 'R'").select("l_partkey"), x.filter("l_linestatus = 'O'").select("l_partkey"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_ids(spark, sf_dir):
    return o.pending(documents(spark, sf_dir).select("doc_id"), labels(spark, sf_dir), "doc_id")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT CASE WHEN a.k IS NULL THEN 'second' WHEN b.k IS NULL THEN 'first' ELSE 'both' END AS side, count(*) AS n, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS na, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS nb FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def outer_merge_sides(spark, sf_dir):
    def side(status, name):
        return orders(spark, sf_dir).filter(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(name))

    m = side("F", "na").join(side("P", "nb"), "k", "full_outer")
    s = F.when(F.col("na").isNull(), "second").when(F.col("nb").isNull(), "first").otherwise("both")
    return m.groupBy(s.alias("side")).agg(_n(), F.sum(F.coalesce("na", F.lit(0))).alias("na"), F.sum(F.coalesce("nb", F.lit(0))).alias("nb"))


@query("""SELECT n_name, bool_or(r.r_name LIKE 'A%' OR n.n_name LIKE '%1') AS hit FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey GROUP BY n_name""")
def any_alternative(spark, sf_dir):
    """Any of several alternatives may match."""
    x = nation(spark, sf_dir).join(region(spark, sf_dir), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("n_name").agg(F.bool_or(F.col("r_name").like("A%") | F.col("n_name").like("%1")).alias("hit"))


@query("SELECT n.n_nationkey, r.r_name, CASE WHEN r.r_name IS NULL THEN 'unregistered' ELSE 'ok' END AS state FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey < 3")
def registry_join(spark, sf_dir):
    r = region(spark, sf_dir).filter("r_regionkey < 3")
    x = nation(spark, sf_dir).join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return x.select("n_nationkey", "r_name", F.when(F.col("r_name").isNull(), "unregistered").otherwise("ok").alias("state"))


@query("""WITH s AS (SELECT o_orderstatus AS run, o_orderpriority AS field, count(*) AS n FROM orders GROUP BY ALL)
SELECT s.run, s.field, s.n, s.n - b.n AS difference FROM s JOIN s b ON b.run = 'F' AND b.field = s.field""")
def difference_to_baseline(spark, sf_dir):
    s = orders(spark, sf_dir).groupBy(F.col("o_orderstatus").alias("run"), F.col("o_orderpriority").alias("field")).agg(_n())
    b = s.filter("run = 'F'").select("field", F.col("n").alias("base"))
    return s.join(b, "field").select("run", "field", "n", (F.col("n") - F.col("base")).alias("difference"))


@query("""SELECT c_custkey, CASE WHEN f.k IS NOT NULL THEN 'F' WHEN p.k IS NOT NULL THEN 'P' END AS origin FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') f ON f.k = c_custkey
LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') p ON p.k = c_custkey""")
def first_existing_source(spark, sf_dir):
    """The first of two sources that has the key: a union with priorities and a minimum."""
    x = orders(spark, sf_dir)
    src = x.filter("o_orderstatus IN ('F', 'P')").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.struct(F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("p"), F.col("o_orderstatus").alias("s"))).alias("b"))
    return customer(spark, sf_dir).select("c_custkey").join(src, "c_custkey", "left").select("c_custkey", F.col("b.s").alias("origin"))


# --- sets and sampling


@query("""WITH k AS (SELECT doc_id, substr(md5(text), 1, 2) AS h FROM documents), a AS (SELECT DISTINCT h FROM k WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT h FROM k WHERE doc_id % 2 = 1)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (h)) AS n_both""")
def set_overlap(spark, sf_dir):
    k = documents(spark, sf_dir).select("doc_id", F.substring(F.md5("text"), 1, 2).alias("h"))
    return o.overlap(k.filter("doc_id % 2 = 0"), k.filter("doc_id % 2 = 1"), "h")


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def leakage_intersection(spark, sf_dir):
    """Test passages that occur word for word in documents."""
    b = table(spark, sf_dir, "benchmark")
    return containment.verbatim(b, "item_id", "text", documents(spark, sf_dir), "doc_id", "text").select("item_id", "doc_id")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, sf_dir):
    x = orders(spark, sf_dir)
    return x.filter("o_orderstatus = 'F'").select("o_custkey").subtract(x.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersection(spark, sf_dir):
    x = orders(spark, sf_dir)
    return x.filter("o_orderstatus = 'F'").select("o_custkey").intersect(x.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("""SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'supplier' FROM supplier UNION ALL SELECT n_nationkey, n_name, 0.0, 'nation' FROM nation""")
def union_by_name(spark, sf_dir):
    a = customer(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    b = supplier(spark, sf_dir).select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = nation(spark, sf_dir).select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return o.union_by_name(a, b, c, defaults={"balance": 0.0})


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def upsert_latest(spark, sf_dir):
    x = orders(spark, sf_dir).select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
    return o.latest(x, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def dedupe_priority(spark, sf_dir):
    x = orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderstatus")
    p = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return o.first_by_priority(x, "o_custkey", [p, F.col("o_orderkey")])


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 15")
def group_cap(spark, sf_dir):
    return o.cap_per_group(documents(spark, sf_dir).select("doc_id", "source"), "source", 15, [F.col("doc_id")])


@query("SELECT doc_id, source, CAST(rn AS INTEGER) AS round FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) ORDER BY rn, source LIMIT 50")
def round_robin_sample(spark, sf_dir):
    return o.round_robin(documents(spark, sf_dir).select("doc_id", "source"), "source", 50, [F.col("doc_id")])


@query("SELECT doc_id FROM documents ORDER BY ((doc_id + 42) % 2147483647 * 48271 % 2147483647) * 48271 % 2147483647, doc_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    return o.shuffled(documents(spark, sf_dir).select("doc_id"), "doc_id", 100, 42)


@query("WITH c AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS k FROM part) SELECT p_partkey, p_brand FROM c WHERE k <= 80")
def small_groups_whole(spark, sf_dir):
    p = part(spark, sf_dir).select("p_partkey", "p_brand")
    small = p.groupBy("p_brand").agg(_n()).filter("n <= 80").drop("n")
    return p.join(small, "p_brand", "left_semi").select("p_partkey", "p_brand")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) ORDER BY c_custkey LIMIT 40")
def bounded_collection(spark, sf_dir):
    """Collects in order until the target is reached."""
    return customer(spark, sf_dir).join(orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey").orderBy("c_custkey").limit(40)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphan_rows(spark, sf_dir):
    good = orders(spark, sf_dir).filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber").join(good, "l_orderkey", "left_anti")


# --- aggregates


@query("SELECT o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1")
def count_by_key(spark, sf_dir):
    return orders(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("key")).agg(_n()).orderBy(F.desc("n"), "key")


@query("SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem")
def distinct_counts(spark, sf_dir):
    return lineitem(spark, sf_dir).agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))


@query("SELECT c_mktsegment AS key, count(*) AS n, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1")
def group_summary(spark, sf_dir):
    return customer(spark, sf_dir).groupBy(F.col("c_mktsegment").alias("key")).agg(_n(), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query("SELECT p_type AS key, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def rows_and_clusters(spark, sf_dir):
    return part(spark, sf_dir).groupBy(F.col("p_type").alias("key")).agg(_n(), F.count_distinct("p_brand").alias("brands"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.02), 6) AS p2, round(quantile_cont(l_extendedprice, 0.05), 6) AS p5, round(quantile_cont(l_extendedprice, 0.10), 6) AS p10, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(median(l_extendedprice), 6) AS p50 FROM lineitem GROUP BY 1")
def percentiles(spark, sf_dir):
    q = o.percentiles_by_rank(lineitem(spark, sf_dir), "l_returnflag", "l_extendedprice", [0.02, 0.05, 0.10, 0.25, 0.5])
    return q.select("l_returnflag", *[F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(("p2", "p5", "p10", "p25", "p50"))])


@query("""SELECT l_returnflag, count(*) AS n, true AS p2, true AS p5, true AS p10, true AS p25, true AS p50, true AS parts FROM lineitem GROUP BY 1""")
def merged_sketches(spark, sf_dir):
    """Sketches of four runs merged: whether each quantile's true rank is within a hundredth, and the distinct count within a tenth."""
    rows = lineitem(spark, sf_dir).select("l_returnflag", "l_extendedprice", "l_partkey", "l_linenumber")
    runs = [sketches.summary(rows.filter(F.col("l_linenumber") % 4 == i), ["l_returnflag"], F.col("l_extendedprice"), F.col("l_partkey")) for i in range(4)]
    shares = {"p2": 0.02, "p5": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.5}
    m = sketches.merged(runs, ["l_returnflag"]).select("l_returnflag", "n", sketches.distinct().alias("items"), *[sketches.quantile(q).alias(c) for c, q in shares.items()])
    x = rows.join(m, "l_returnflag").groupBy("l_returnflag", "n", "items").agg(F.count_distinct("l_partkey").alias("known"), *[F.avg((F.col("l_extendedprice") <= F.col(c)).cast("double")).alias(c) for c in shares])
    return x.select("l_returnflag", "n", *[(F.abs(F.col(c) - q) <= 0.01).alias(c) for c, q in shares.items()], (F.abs(F.col("items") / F.col("known") - 1) <= 0.1).alias("parts"))


@query("SELECT count(*) AS total, count(CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS known, round(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 4) AS mean FROM customer")
def null_skipping_average(spark, sf_dir):
    x = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return customer(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count(x).alias("known"), F.round(F.avg(x), 4).alias("mean"))


@query("SELECT CAST(least(floor(l_discount * 100), 9) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def hist_bins(spark, sf_dir):
    return lineitem(spark, sf_dir).groupBy(F.least(F.floor(F.col("l_discount") * 100), F.lit(9)).cast("int").alias("bin")).agg(_n())


@query("SELECT count(*) AS pages, CAST(sum(CASE WHEN contains(html, '<nav') THEN 1 ELSE 0 END) AS BIGINT) AS nav, CAST(sum(CASE WHEN contains(html, '<h1') THEN 1 ELSE 0 END) AS BIGINT) AS h1, CAST(sum(CASE WHEN contains(html, '<table') THEN 1 ELSE 0 END) AS BIGINT) AS tables FROM pages")
def tag_presence(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").agg(F.count(F.lit(1)).alias("pages"), *[F.sum(h.contains(t).cast("int")).alias(n) for t, n in (("<nav", "nav"), ("<h1", "h1"), ("<table", "tables"))])


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT doc_id, md5(line) AS line, count(*) AS n FROM l WHERE length(line) > 8 GROUP BY doc_id, line HAVING count(*) >= 3""")
def running_headers(spark, sf_dir):
    """Lines that a document repeats three times or more."""
    lines = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    return lines.filter(F.length("line") > 8).groupBy("doc_id", "line").agg(_n()).filter("n >= 3").withColumn("line", F.md5("line"))


@query("SELECT round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd, median(l_quantity) AS mid FROM lineitem")
def column_moments(spark, sf_dir):
    return lineitem(spark, sf_dir).agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_pop("l_quantity"), 6).alias("sd"), F.median("l_quantity").alias("mid"))


@query("SELECT source, l.quality = 1 AS gate, count(*) AS n, count(*) FILTER (WHERE n_chars > 500) AS produced, count(*) FILTER (WHERE n_chars > 500 AND toxic = 0) AS correct FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def subset_counts(spark, sf_dir):
    x = documents(spark, sf_dir).select("doc_id", "source", "n_chars").join(labels(spark, sf_dir), "doc_id")
    return x.groupBy("source", (F.col("quality") == 1).alias("gate")).agg(_n(), F.count_if(F.col("n_chars") > 500).alias("produced"), F.count_if((F.col("n_chars") > 500) & (F.col("toxic") == 0)).alias("correct"))


@query("""WITH h AS (SELECT conv_id, avg(CASE WHEN length(text) > 300 THEN 1.0 ELSE 0.0 END) AS ratio FROM conversations GROUP BY conv_id) SELECT count(*) AS n, count(*) FILTER (WHERE ratio = 0) AS none, count(*) FILTER (WHERE ratio < 0.5) AS low, count(*) FILTER (WHERE ratio >= 0.8) AS high FROM h""")
def hit_ratio_bands(spark, sf_dir):
    h = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.avg((F.length("text") > 300).cast("double")).alias("r"))
    return h.agg(_n(), F.count_if(F.col("r") == 0).alias("none"), F.count_if(F.col("r") < 0.5).alias("low"), F.count_if(F.col("r") >= 0.8).alias("high"))


@query("SELECT l_shipmode_n AS bucket, CAST(sum(q) AS BIGINT) AS gold, CAST(sum(f) AS BIGINT) AS found, CAST(sum(CASE WHEN f > 0 AND q > 25 THEN 1 ELSE 0 END) AS BIGINT) AS matched FROM (SELECT l_linenumber AS l_shipmode_n, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS f FROM lineitem) GROUP BY 1")
def micro_totals(spark, sf_dir):
    """References that are known, that were found, and of those found the ones that match."""
    f, q = (F.col("l_returnflag") == "R").cast("long"), F.col("l_quantity").cast("long")
    return lineitem(spark, sf_dir).groupBy(F.col("l_linenumber").alias("bucket")).agg(F.sum(q).alias("gold"), F.sum(f).alias("found"), F.sum(F.when(q > 25, f).otherwise(0)).alias("matched"))


# --- windows and orders


@query("SELECT o_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders")
def running_total(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return orders(spark, sf_dir).select("o_custkey", "o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w).cast("double").alias("running"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def current_section(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("section"))


@query("""WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
m AS (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY o_custkey ORDER BY pos) = s THEN 0 ELSE 1 END AS fresh FROM l), r AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY pos) AS run FROM m)
SELECT o_custkey, min(s) AS s, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last, count(*) AS n FROM r GROUP BY o_custkey, run""")
def row_islands(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    l = orders(spark, sf_dir).select("o_custkey", F.col("o_orderstatus").alias("s"), F.row_number().over(w).alias("pos"))
    return o.islands(l, ["o_custkey"], "pos", "s")


@query("""WITH l AS (SELECT doc_id, line, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
m AS (SELECT doc_id, pos, length(line) > 60 AS long_ FROM l), f AS (SELECT *, CASE WHEN lag(long_) OVER (PARTITION BY doc_id ORDER BY pos) = long_ THEN 0 ELSE 1 END AS fresh FROM m), r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f)
SELECT doc_id, bool_or(long_) AS long_, CAST(min(pos) - 1 AS INTEGER) AS first, CAST(max(pos) - 1 AS INTEGER) AS last, count(*) AS n FROM r GROUP BY doc_id, run""")
def line_islands(spark, sf_dir):
    """Blocks of consecutive long or short lines."""
    l = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", (F.length("line") > 60).alias("long_"))
    return o.islands(l, ["doc_id"], "pos", "long_")


@query("SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events")
def neighbour_gap(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).select("user_id", "event_id", (F.col("value") - F.lag("value").over(w)).alias("gap"))


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, length(p_name) DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def best_alternative(spark, sf_dir):
    p = part(spark, sf_dir).groupBy("p_brand").agg(F.max(F.struct("p_retailprice", F.length("p_name").alias("l"), (-F.col("p_partkey")).alias("k"))).alias("b"))
    return p.select("p_brand", (-F.col("b.k")).alias("p_partkey"), "b.p_retailprice")


@query("SELECT o_orderkey, o_orderpriority, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 999 END AS INTEGER) AS place FROM orders")
def list_position_order(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", o.by_position(F.col("o_orderpriority"), ["5-LOW", "1-URGENT"]).cast("int").alias("place")).orderBy("place", "o_orderkey")


@query("""WITH k AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'PMC' || s_suppkey ELSE CAST(s_suppkey AS VARCHAR) END AS id FROM supplier) SELECT id, CAST(row_number() OVER (ORDER BY try_cast(id AS BIGINT) IS NULL, try_cast(id AS BIGINT), id) AS INTEGER) AS place FROM k""")
def numeric_then_text_order(spark, sf_dir):
    i = F.col("s_suppkey")
    k = supplier(spark, sf_dir).select(F.when(i % 3 == 0, F.concat(F.lit("PMC"), i.cast("string"))).otherwise(i.cast("string")).alias("id"))
    return o.numbered(k, o.numeric_first(F.col("id"))).withColumn("place", F.col("place").cast("int"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20")
def lowest_first(spark, sf_dir):
    return customer(spark, sf_dir).select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").limit(20)


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def topk_groups(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("source").agg(_n()).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT l_suppkey, max(l_extendedprice) AS price, arg_max(l_partkey, l_extendedprice * 1000000 - l_partkey) AS part FROM lineitem GROUP BY 1")
def argmax_per_group(spark, sf_dir):
    return lineitem(spark, sf_dir).groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("price"), F.max_by("l_partkey", F.col("l_extendedprice") * 1000000 - F.col("l_partkey")).alias("part"))


_FIVE = ("p_name", "p_brand", "p_type", "p_partkey", "p_size")


@query("SELECT p_partkey, p_name FROM part WHERE " + " OR ".join(f"contains(lower(CAST({c} AS VARCHAR)), '1')" for c in _FIVE) + " ORDER BY p_name, p_partkey LIMIT 50 OFFSET 50")
def search_page(spark, sf_dir):
    """The second page of a search over five columns."""
    return o.search(part(spark, sf_dir), "1", list(_FIVE), [F.col("p_name"), F.col("p_partkey")], 1).select("p_partkey", "p_name")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey IN (1, 7, 19) THEN 'fixed' ELSE o_orderstatus END AS status FROM orders""")
def relabel_named(spark, sf_dir):
    """Corrections by id, the same however often they are applied."""
    fixes = spark.createDataFrame([(1, "fixed"), (7, "fixed"), (19, "fixed")], "o_orderkey long, fix string")
    x = orders(spark, sf_dir).select("o_orderkey", "o_orderstatus").join(F.broadcast(fixes), "o_orderkey", "left")
    return x.select("o_orderkey", F.coalesce("fix", "o_orderstatus").alias("status"))


@query("SELECT page_id, regexp_replace(url, '^(https?)://[^/]*', '\\1://local') AS url FROM pages")
def path_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^(https?)://[^/]*", "$1://local").alias("url"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("""SELECT conv_id, list_filter(list(role ORDER BY turn), lambda x: x = 'assistant')[1] AS first_role, CAST(len(list_filter(list(role ORDER BY turn), lambda x: x = 'assistant')) AS INTEGER) AS n FROM conversations GROUP BY conv_id""")
def pick_by_language(spark, sf_dir):
    """The first element of a list with a given mark."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("a"))
    mine = F.filter("a", lambda x: x["role"] == "assistant")
    return c.select("conv_id", F.try_element_at(mine, F.lit(1))["role"].alias("first_role"), F.size(mine).alias("n"))
