"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a shuffle of the edges with map-side minima; nothing is collected. Every round is written to
the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, nodes: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of a node to the least among them and itself: the larger neighbours, or the smaller."""
    least = nodes.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    pairs = nodes.join(least, "a")
    if large:
        pairs = pairs.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        pairs = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return pairs.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node that can be reached; that node itself has no row.

    The edges may come in any direction, repeated, or as loops. Rounds go on until one changes nothing: every
    round before that lowers the end of some edge, so they end, after a number that grows with the square of the
    logarithm of the nodes at most.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        before = mark
        spread = _star(now, _directed(now), True)
        spread = spread.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = materialize(_star(spread, spread, False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
