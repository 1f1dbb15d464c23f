"""Sets, sampling and latest-row operators.

Every ranking has a total order. Ranks inside a group that may hold a third of all rows are taken with
top-k aggregation rather than a full window wherever only k rows are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_by_name(*parts: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """Rows of all parts; a column that a part lacks is null, or its default."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.fillna({k: v for k, v in (defaults or {}).items() if k in out.columns})


def exclude(rows: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """rows whose key is in no source. A missing source is an error where it is read, never an empty set."""
    forbidden = reduce(DataFrame.union, [s.select(s.columns[0]) for s in sources]).toDF(key).distinct()
    return rows.join(forbidden, key, "left_anti")


def require(rows: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """rows whose key is in every source."""
    for s in sources:
        rows = rows.join(s.select(F.col(s.columns[0]).alias(key)), key, "left_semi")
    return rows


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the last in the order: an upsert as a map-side maximum, without a window."""
    kept = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in kept])).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}") for c in kept])


def first_by_priority(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in the order."""
    kept = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in kept])).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}") for c in kept])


def cap_per_group(rows: DataFrame, group: str, most: int, order: list[Column]) -> DataFrame:
    """At most ``most`` rows of each group, in the order. Spark keeps ``most`` rows of a group on the map side."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def round_robin(rows: DataFrame, group: str, n: int, order: list[Column], rounds: int | None = None) -> DataFrame:
    """A sample of n rows that takes one row of each group per round. No group gives more than n rows."""
    w = Window.partitionBy(group).orderBy(*order)
    ranked = rows.withColumn("round", F.row_number().over(w)).filter(F.col("round") <= (rounds or n))
    return ranked.orderBy("round", group).limit(n)


def shuffled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that a seed shuffles: two steps of a Lehmer generator from an integer key, which any engine
    repeats."""
    step = lambda c: F.pmod(c * F.lit(48271).cast("long"), F.lit(2147483647).cast("long"))
    return rows.orderBy(step(step(F.pmod(F.col(key).cast("long") + F.lit(seed), F.lit(2147483647).cast("long")))), key).limit(n)


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What has no result yet."""
    return wanted.join(done.select(key), key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of two sets and of their intersection."""
    x, y = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    both = x.join(y, key, "full_outer")
    return both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))


def numeric_first(c: Column) -> list[Column]:
    """Order of ids: numbers by value, then other texts."""
    number = c.try_cast("long")
    return [number.isNull(), number, c]


def by_position(c: Column, listed: list[str]) -> Column:
    """Order by place in a list; what is not listed comes last."""
    at = F.array_position(F.array(*map(F.lit, listed)), c)
    return F.when(at == 0, 999).otherwise(at)


def islands(rows: DataFrame, partition: list[str], order: str, value: str) -> DataFrame:
    """Runs of consecutive rows of equal value: partition, value, first, last, n."""
    w = Window.partitionBy(*partition).orderBy(order)
    marked = rows.withColumn("_new", F.coalesce((F.lag(value).over(w) != F.col(value)) | (F.lag(order).over(w) != F.col(order) - 1), F.lit(True)).cast("int"))
    numbered = marked.withColumn("_run", F.sum("_new").over(w))
    return numbered.groupBy(*partition, "_run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def complete(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows in which all the fields are filled. The strict variant names the keywords as well."""
    return rows.filter(reduce(lambda a, b: a & b, [F.coalesce(F.trim(f), F.lit("")) != "" for f in fields]))


def search(rows: DataFrame, term: str, columns: list[str], order: list[Column], page: int, size: int = 50) -> DataFrame:
    """A page of the rows of which any of the columns holds the term, whatever its case."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(term.lower()), F.lit(False)) for c in columns])
    return rows.filter(hit).orderBy(*order).offset(page * size).limit(size)


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, in a total order. Rows are dealt out by ranges of the order and sorted in their
    tasks; only the sizes of the partitions, one row each, are summed in one place."""
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_seq", 33)
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_ahead"))
    out = at.withColumn("_part", part).join(F.broadcast(ahead), "_part")  # one row per partition
    return out.withColumn(name, F.col("_ahead") + F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_seq", "_ahead")


def percentiles_by_rank(rows: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """group and q, an array of exact percentiles with linear interpolation, one for each share; nulls are left out.

    Values are put in order by ranges of (group, value), and only those of the wanted ranks are taken, so no task holds the
    values of a group. Sizes and first places, one row a group, are map-side aggregates."""
    at = numbered(rows.select(group, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL"), [F.col(group), F.col("_v")], "_place")
    size = at.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    x = at.join(size, F.col(group).eqNullSafe(F.col("_group"))).withColumn("_rank", F.col("_place") - F.col("_first"))
    place = {i: F.lit(s) * (F.col("_n") - 1) for i, s in enumerate(shares)}
    low = {i: F.floor(p + 1e-9) for i, p in place.items()}
    near = F.array(*[low[i] for i in place], *[low[i] + 1 for i in place])
    x = x.filter(F.array_contains(near, F.col("_rank")))
    edges = [F.max(F.when(F.col("_rank") == low[i] + k, F.col("_v"))).alias(f"_{k}_{i}") for i in place for k in (0, 1)]
    wide = x.groupBy(group, "_n").agg(*edges)
    q = [F.col(f"_0_{i}") + (F.coalesce(f"_1_{i}", f"_0_{i}") - F.col(f"_0_{i}")) * (p - low[i]) for i, p in place.items()]
    return wide.select(group, F.array(*q).alias("q"))
