"""Long lists in blocks: what belongs to one label is never brought together in one row or task.

Rows are numbered in the order of (label, value) by ranges of that order; a label's first number, a map-side minimum, makes
the number a place in the label, and a block is a run of ``size`` places. So a label that every row has is as many rows as it
has blocks, and readers fetch the blocks they need by label and number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.sets import numbered

SIZE = 1024


def in_blocks(rows: DataFrame, group: str, order: list[Column], size: int = SIZE) -> DataFrame:
    """rows with ``block``, from 0: runs of ``size`` rows of each group in an order. A null group is a group."""
    at = numbered(rows, [F.col(group), *order], "_place")
    first = at.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"))
    out = at.join(first, F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn("block", F.floor((F.col("_place") - F.col("_first")) / size)).drop("_place", "_group", "_first")


def posting_lists(rows: DataFrame, key: str, labels: str, size: int = SIZE) -> DataFrame:
    """label, block, n and ids: the sorted keys of the rows with a label, ``size`` at most in a block."""
    x = in_blocks(rows.select(key, F.explode(F.array_distinct(labels)).alias("label")), "label", [F.col(key)], size)
    return x.groupBy("label", "block").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(key)).alias("ids"))


def directory(postings: DataFrame) -> DataFrame:
    """label, n (all its keys) and blocks."""
    return postings.groupBy("label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))
