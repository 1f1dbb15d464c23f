"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same expected number of copies, target / source size. The documents of
a source are put in an order, expected copies are prefix-summed along it, one random offset is added, and a
document is emitted once per integer boundary that its interval crosses. The order runs by size class, so
that each stretch of similar documents gives its share and the taken words come near the target: the error
of a source is of the order of its largest document.

The prefix sum is a rank times a constant. Ranks come from dealing the rows out by ranges of the whole order
(source, size class, spread of doc_id, size, doc_id, text hash, row), so no source and no repeated or missing
doc_id fills a task. The table of sources is ordered in the same way, so it may be long as well.

Nulls: a null text has size 0; a null source is a source of its own, ordered last; a null doc_id is ordered
first within its size class. Equal rows may swap their copies, which leaves the same rows. An empty table gives
an empty result. Very long texts are documents like any other: the error of a source is of the order of its
longest. Other columns of the input, whatever their names, are kept by ``mix_documents``.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import boxed, in_order, materialize, size_class, spread, word_count

#: Rows of the corpus for each value of the spread of doc_id, by which a size class is mixed before sizes are sorted.
ROWS_PER_BUCKET = 4096
MAX_RATIO = 3
SEED = 20240607


def offset_of(seed: int) -> float:
    """The one random offset of a mix, in (0, 1)."""
    return round(random.Random(seed).uniform(0.05, 0.95), 6)


def source_targets(sized: DataFrame, max_ratio: int = MAX_RATIO) -> DataFrame:
    """One row per source: source, source_size, target, and start, the place of its first row in the order.

    Weights 1, 2, 3 repeat over the sources in code-point order, null last. Capping at max_ratio times the
    source's size and sharing the excess by weight ends at target = min(cap, weight * level): the level is
    found by one ordered pass over cap / weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    per = in_order(per.withColumn("no_source", F.col("source").isNull()), ["no_source", "source"], ("n",))
    per = per.withColumn("weight", (F.pmod("place", F.lit(3)) + 1).cast("long")).withColumnsRenamed({"place": "sid", "before_n": "start"})
    per = per.withColumn("cap", F.col("source_size") * max_ratio)
    per = per.withColumn("turn", F.col("cap").cast("double") / F.col("weight").cast("double"))
    per = materialize(in_order(per, ["turn", "sid"], ("cap", "weight")).drop("place"))
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    left_over = F.lit(total["size"]).cast("long") - F.col("before_cap")
    open_weight = F.lit(total["weight"]).cast("long") - F.col("before_weight")
    level = left_over.cast("double") / open_weight.cast("double")
    level = per.agg(F.max(F.when(level <= F.col("turn"), level)).alias("level")).first()["level"]
    target = F.least(F.col("cap").cast("double"), F.col("weight").cast("double") * F.lit(level).cast("double"))
    return per.select("source", "source_size", "start", target.alias("target"))


def sample_counts(sized: DataFrame, seed: int = SEED, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds source_size, target and copies to rows with doc_id, source, size, h (a hash of the text) and uid (a written table)."""
    n = sized.count()
    salts = max(1, -(-n // rows_per_bucket))
    targets = source_targets(sized)
    rows = sized.withColumns({"no_source": F.col("source").isNull(), "cls": size_class(F.col("size")), "salt": spread(F.col("doc_id"), salts)})
    placed = in_order(rows, ["no_source", "source", "cls", "salt", "size", "doc_id", "h", "uid"])
    placed = placed.join(targets.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    rank = (F.col("place") - F.col("start") + 1).cast("double")
    u = F.lit(offset_of(seed))
    copies = F.floor(ratio * rank + u) - F.floor(ratio * (rank - F.lit(1.0)) + u)
    return placed.withColumn("copies", copies.cast("long")).select(*sized.columns, "source_size", "target", "copies")


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: every document repeated as often as it was drawn, with the input's columns.

    Every row is drawn by itself, also rows that share a doc_id. Rows meet their draws by a row number of their
    own, so texts are shuffled once and no key repeats.
    """
    rows = boxed(docs, size=word_count(F.col("text")), h=F.xxhash64("text"))
    light = rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "size", "h", "uid")
    drawn = sample_counts(light, seed).filter("copies > 0").select("uid", "copies")
    repeated = rows.select("uid", "row").join(drawn, "uid").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select("row.*")


def op2_mix_sources(spark, sf_dir):
    """Contract query: doc_id, size, source_size, target, taken for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    sized = materialize(sized.withColumn("uid", F.monotonically_increasing_id()))
    out = sample_counts(sized)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY CASE WHEN source IS NULL THEN 1 ELSE 0 END, source) AS sid FROM sized GROUP BY source
), caps AS (
  SELECT *, (sid - 1) % 3 + 1 AS weight, source_size * {MAX_RATIO} AS cap,
         CAST(source_size * {MAX_RATIO} AS DOUBLE) / CAST((sid - 1) % 3 + 1 AS DOUBLE) AS turn FROM per
), levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM per) - coalesce(sum(cap) OVER (ORDER BY turn, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY turn, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM caps
), targets AS (
  SELECT source, sid, source_size,
         least(CAST(cap AS DOUBLE), CAST(weight AS DOUBLE) * (SELECT max(level) FROM levels WHERE level <= turn)) AS target FROM levels
), salted AS (
  SELECT s.doc_id, s.size, t.sid, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS ratio,
         CAST(floor(4.0 * sqrt(sqrt(CAST(s.size AS DOUBLE)))) AS BIGINT) AS cls,
         coalesce((s.doc_id % 2147483647) * 48271 % 2147483647
                  % (SELECT greatest(1, CAST(ceil(count(*) / {ROWS_PER_BUCKET}.0) AS BIGINT)) FROM sized), 0) AS salt
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY sid ORDER BY cls, salt, size, doc_id) AS DOUBLE) AS r FROM salted
)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(ratio * r + CAST({offset_of(SEED)} AS DOUBLE)) - floor(ratio * (r - 1.0) + CAST({offset_of(SEED)} AS DOUBLE)) AS BIGINT) AS taken FROM ranked
"""
