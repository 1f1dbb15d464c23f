"""Pairs of near vectors without comparing all: partitions around pivots, and triangle bounds that say which of them meet.

PIVOTS sampled vectors serve as landmarks. Vectors go to the cell of their nearest landmark and, in the order of their
distance to it, to partitions of ``block`` vectors. A partition knows the least and greatest distance of its vectors to each
landmark. By the triangle inequality two vectors are at least as far apart as their distances to any landmark are, so two
partitions are at least as far apart as the widest gap between their ranges. Only partitions that this bound lets meet are
brought together, each pair of them as one group of two blocks at most.

Searches without a given bound make one: a first round inside the partitions gives every vector a near neighbour (or the
k closest pairs so far), a second one looks into the partitions that can hold a nearer one. Results are exact, ties too.

Bounds are compared between blocks of partitions' ranges, which is a ``block`` squared-th of the work of comparing all pairs.
How many groups are left depends on the data: few where vectors lie in clusters, all of them where no two vectors are much
nearer than any others, as among random directions of many dimensions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.distance import CHUNK, Side, block_pairs, block_size, both_sides, exact, minima, packed, tiles, together
from folioscope.operators.postings import in_blocks
from folioscope.sources.scratch import written

PIVOTS = 16
RANGES = 2048


class Partitions:
    """rows (id, v) in partitions: ``rows`` with part, ``ranges`` of part and its least and greatest distances to the landmarks."""

    def __init__(self, rows: DataFrame, block: int | None = None, pivots: int = PIVOTS):
        rows = rows.select("id", "v")
        self.n = rows.count()
        self.block = block = block or block_size(rows, self.n)
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
        if not sample:
            return
        marks = np.array([r["v"] for r in sample], float)
        cells = max(1, min(len(marks), self.n // block))

        @F.arrow_udf("array<double>")
        def to_marks(v: pa.Array) -> pa.Array:
            x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
            d = np.stack([np.sqrt(((x - m) ** 2).sum(axis=1)) for m in marks], axis=1)
            return pa.array(list(d), pa.list_(pa.float64()))

        dealt = rows.select("id", "v", to_marks(F.col("v")).alias("_to"))
        near = F.slice("_to", 1, cells)
        dealt = dealt.withColumn("_r", F.array_min(near)).withColumn("_cell", F.array_position(near, F.col("_r")))
        dealt = in_blocks(dealt, "_cell", [F.col("_r"), F.col("id")], block)
        names = dealt.select("_cell", "block").distinct().orderBy("_cell", "block")
        names = written(names.coalesce(1).withColumn("part", F.monotonically_increasing_id()))  # one row a partition
        self.rows = written(dealt.join(names, ["_cell", "block"]).select("id", "v", "_to", "part"))
        self.blocks: DataFrame | None = None
        edge = lambda f: F.array(*[f(F.col("_to")[i]) for i in range(len(marks))])
        self.ranges = written(self.rows.groupBy("part").agg(edge(F.min).alias("low"), edge(F.max).alias("high")))

    def meeting(self, limits: DataFrame | None = None, within: float | None = None, own: bool = True) -> DataFrame:
        """x and y (x <= y): the partitions that can hold vectors nearer than ``within``, or no farther than the ``most`` of either
        partition in ``limits`` (part, most)."""
        if limits is None:
            ranges = self.ranges.withColumn("most", F.lit(within))
        else:
            ranges = self.ranges.join(limits, "part")
        strict = limits is None
        dealt = ranges.select(F.col("part").alias("id"), F.concat("low", "high", F.array("most")).alias("v"))

        def run(pdf):
            x, y = pdf["_x"].iloc[0], pdf["_y"].iloc[0]
            left, right = pdf[pdf["_b"] == x], pdf[pdf["_b"] == y]
            if not len(left) or not len(right):
                return pd.DataFrame({"x": [], "y": []})
            a, b = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            k = a.shape[1] // 2
            mine, theirs = left["id"].to_numpy(), right["id"].to_numpy()
            found = []
            for i in range(len(a)):
                gap = np.maximum(np.maximum(a[i, :k] - b[:, k : 2 * k], b[:, :k] - a[i, k : 2 * k]).max(axis=1), 0)
                gap = np.maximum(gap - 1e-9, 0)  # distances are rounded
                ok = gap < a[i, -1] if strict else gap <= np.maximum(a[i, -1], b[:, -1])
                ok &= (mine[i] < theirs) | (own & (mine[i] == theirs)) if x == y else True
                found.append(np.stack([np.full(int(ok.sum()), mine[i]), theirs[ok]], axis=1))
            pairs = np.concatenate(found)
            return pd.DataFrame({"x": pairs.min(axis=1), "y": pairs.max(axis=1)})

        return block_pairs(dealt, RANGES).groupBy("_x", "_y").applyInPandas(run, "x long, y long")

    def groups(self, pairs: DataFrame):
        """The vectors of each pair of partitions as one group."""
        if self.blocks is None:
            self.blocks = written(packed(self.rows, "part"))
        return together(self.blocks, pairs)

    def own(self) -> DataFrame:
        return self.ranges.select(F.col("part").alias("x"), F.col("part").alias("y"))


def near_pairs(rows: DataFrame, below: float, block: int | None = None) -> DataFrame:
    """a, b and d of all pairs a < b nearer than a bound."""
    parts = Partitions(rows, block)
    if not parts.n:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d"))

    def run(t: pa.Table) -> pa.Table:
        found = []
        if two := both_sides(t):
            slack, squares = tiles(two[0].v, two[1].v)
            for s, c, q in squares:
                i, j = np.nonzero(q <= below * below * (1 + 1e-12) + slack)
                found.append(_pairs(*two, i + s, j + c))
                found[-1] = found[-1][found[-1]["d"] < below]
        return _arrow(found, PAIR)

    return parts.groups(parts.meeting(within=below)).applyInArrow(run, PAIR)


PAIR, NEAR = "a long, b long, d double", "id long, other long, d double"


def _arrow(found: list[pd.DataFrame], schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    all_ = pd.concat(found) if found else pd.DataFrame({c: [] for c in names})
    return pa.table([pa.array(all_[c], pa.float64() if c == "d" else pa.int64()) for c in names], names)


def _pairs(left: Side, right: Side, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    x, y = left.ids[i], right.ids[j]
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "d": np.sqrt(exact(left.v, right.v, i, j))})


def _minima(t: pa.Table) -> pa.Table:
    two = both_sides(t)
    if not two:
        return _arrow([], NEAR)
    x = minima(*two)
    if two[0] is two[1]:
        x = x.sort_values(["cost", "other"]).drop_duplicates("id")
    return _arrow([x.assign(d=np.sqrt(x["cost"]))], NEAR)


def nearest(rows: DataFrame, block: int | None = None) -> DataFrame:
    """id, other and d: the nearest other vector, the smaller id at ties; a vector alone has none."""
    parts = Partitions(rows, block)
    if not parts.n:
        return rows.select("id", F.col("id").alias("other"), F.lit(0.0).alias("d"))
    first = written(parts.groups(parts.own()).applyInArrow(_minima, NEAR))
    most = parts.rows.select("id", "part").join(first, "id", "left").groupBy("part").agg(F.max(F.coalesce("d", F.lit(float("inf")))).alias("most"))
    more = parts.groups(parts.meeting(limits=most, own=False)).applyInArrow(_minima, NEAR)
    return first.union(more).groupBy("id").agg(F.min(F.struct("d", "other")).alias("m")).select("id", "m.other", "m.d")


def _closest(two: tuple[Side, Side], k: int, most: float) -> pd.DataFrame | None:
    """The k closest pairs of a group, as far as they are no farther than ``most``."""
    slack, squares = tiles(two[0].v, two[1].v)
    limit, held, waiting = most * most * (1 + 1e-12), [], 0
    for s, c, q in squares:
        if q.size > k and (q <= limit + slack).sum() > k:
            limit = min(limit, float(np.partition(q, k - 1, axis=None)[k - 1]) + slack)
        i, j = np.nonzero((q <= limit + slack) & (q < math.inf))
        held.append(_pairs(*two, i + s, j + c))
        waiting += len(i)
        if waiting > 4 * k + CHUNK:
            held, waiting = [_first(held, k)], 0
            if len(held[0]) == k:
                limit = min(limit, float(held[0]["d"].iloc[-1]) ** 2 * (1 + 1e-12))
    return _first(held, k) if held else None


def _first(held: list[pd.DataFrame], k: int) -> pd.DataFrame:
    x = pd.concat(held)
    return x.iloc[np.lexsort((x["b"], x["a"], x["d"]))[:k]]


def closest(rows: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """a, b and d of the k closest pairs, in order; a group gives its own k closest at most."""
    parts = Partitions(rows, block)
    if not parts.n:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d"))

    def run(most: float):
        def one(t: pa.Table) -> pa.Table:
            two = both_sides(t)
            found = _closest(two, k, most) if two else None
            return _arrow([] if found is None else [found], PAIR)

        return one

    first = written(parts.groups(parts.own()).applyInArrow(run(math.inf), PAIR).orderBy("d", "a", "b").limit(k))
    held = first.agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("most")).first()
    most = held["most"] if held["n"] == k else float("inf")
    limits = parts.ranges.select("part", F.lit(most).alias("most"))
    more = parts.groups(parts.meeting(limits=limits, own=False)).applyInArrow(run(most), PAIR)
    return first.union(more).orderBy("d", "a", "b").limit(k)
