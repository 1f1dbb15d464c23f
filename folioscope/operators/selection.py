"""Greedy choices by distance from any number of vectors: the chosen few are on the driver, the rest stay where they are.

A step needs the best of all rows by a key: how far a row is from what is chosen, with caps, bonuses and ties. Distances
to the chosen vectors are a column, worked out in Arrow batches; the best rows come from a map-side top. Where choosing only
lowers other rows' keys (``Selection``), one such job brings the TOP best rows, and steps are taken among them for as long as
the best of them is still ahead of the last one brought: no row left behind can be ahead of it. So results are those of one
step at a time, with a fraction of the jobs. Exchanges (``exchange_twins``, ``lower_share``) take one job for each.

The driver holds the chosen vectors, whose number is a parameter, and TOP more; tasks hold a batch. Nothing else is bounded.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from folioscope.operators.distance import both_sides, dealt_blocks, exact, tiles, together
from folioscope.sources.scratch import written

TOP = 256


def _matrix(vectors: Iterable) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in vectors])


def distances(points: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distance of each row of v to the nearest of points."""
    near = np.full(len(v), np.inf)
    for p in points:
        near = np.minimum(near, np.sqrt(((v - p) ** 2).sum(axis=1)))
    return near


def near_to(points: np.ndarray) -> Column:
    """Distance of the column v to the nearest of a few points; infinite if there are none."""

    @F.arrow_udf("double")
    def near(v: pa.Array) -> pa.Array:
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
        return pa.array(distances(points, flat.reshape(len(v), -1)) if len(v) else np.zeros(0), pa.float64())

    return near(F.col("v")) if len(points) else F.lit(math.inf)


def most_remote(rows: DataFrame, block: int | None = None) -> DataFrame:
    """id and total: the sum of distances to all others, by block pairs. A total is right to rounding."""

    def run(t: pa.Table) -> pa.Table:
        ids, totals = np.zeros(0, np.int64), np.zeros(0)
        if two := both_sides(t):
            (left, a, _), (right, b, _) = two
            mine, theirs = np.zeros(len(a)), np.zeros(len(b))
            slack, squares = tiles(a, b)
            for s, c, q in squares:
                i, j = np.nonzero(q < 1e6 * slack)  # roots of small squares are too far off
                q[i, j] = exact(a, b, i + s, j + c)
                q[np.isinf(q)] = 0.0
                d = np.sqrt(q, out=q)
                mine[s : s + len(d)] += d.sum(axis=1)
                theirs[c : c + d.shape[1]] += d.sum(axis=0)
            ids, totals = np.concatenate([left, right]), np.concatenate([mine, theirs])
        return pa.table([pa.array(ids), pa.array(totals)], ["id", "total"])

    rows = rows.select("id", "v")
    blocks, pairs = dealt_blocks(rows, rows.count(), block)
    return together(blocks, pairs).applyInArrow(run, "id long, total double").groupBy("id").agg(F.sum("total").alias("total"))


def _among(c: Column, values: list) -> Column:
    """Whether a column is one of a few values, null among them."""
    some = c.isin([v for v in values if v is not None]) if any(v is not None for v in values) else F.lit(False)
    return F.coalesce(some, F.lit(False)) | (c.isNull() if None in values else F.lit(False))


class Selection:
    """A growing choice of points that are far from each other. Rows: id, v, and group, soft, bias where they are used.

    No more than ``cap`` of a group; of a soft group no more than ``soft_cap`` while any other row is left; rows nearer than
    ``twin`` to a chosen one are left out; ``bias`` is added to a row's distance. With ``relax`` a full group gives way where no
    other row is left. Ties go to the smaller id.
    """

    def __init__(self, cap: int | None = None, soft_cap: int | None = None, twin: float = 0.0, relax: bool = False, top: int = TOP):
        self.cap, self.soft_cap, self.twin, self.relax, self.top = cap, soft_cap, twin, relax, top
        self.ids: list[int] = []
        self.vectors: list[np.ndarray] = []
        self.groups: Counter = Counter()
        self.softs: Counter = Counter()
        self.jobs = 0

    def _add(self, row: dict) -> None:
        self.ids.append(row["id"])
        self.vectors.append(np.asarray(row["v"], float))
        self.groups[row["group"]] += 1
        self.softs[row["soft"]] += 1

    def _tier(self, row: dict) -> int:
        full = self.cap is not None and self.groups[row["group"]] >= self.cap
        return 2 * full + (self.soft_cap is not None and self.softs[row["soft"]] >= self.soft_cap)

    def _allowed(self, row: dict) -> bool:
        return (self.relax or self._tier(row) < 2) and (not self.ids or row["near"] >= self.twin)

    @staticmethod
    def _shaped(rows: DataFrame) -> DataFrame:
        extra = {"group": F.lit(0), "soft": F.lit(0), "bias": F.lit(0.0)}
        return rows.select("id", "v", *[F.col(c) if c in rows.columns else v.alias(c) for c, v in extra.items()])

    def _first(self, rows: DataFrame, crowd: DataFrame) -> dict | None:
        """The row with the greatest mean distance to all of a crowd, and bias."""
        self.jobs += 1
        n = crowd.count()
        mean = F.coalesce(F.col("total"), F.lit(0.0)) / max(n, 1)
        scored = written(rows.join(most_remote(crowd.select("id", "v")), "id", "left").withColumn("_mean", mean + F.col("bias")).drop("total"))
        best = scored.agg(F.max("_mean").alias("m")).first()["m"]
        if best is None:
            return None
        return scored.filter(F.col("_mean") >= best - 1e-11 * max(1.0, abs(best))).drop("_mean").orderBy("id").first().asDict()  # sums differ by rounding

    def _best(self, rows: DataFrame) -> list[dict]:
        """The TOP best rows now, the best first."""
        self.jobs += 1
        full = [g for g, n in self.groups.items() if self.cap is not None and n >= self.cap]
        soft = [g for g, n in self.softs.items() if self.soft_cap is not None and n >= self.soft_cap]
        tier = 2 * _among(F.col("group"), full).cast("int") + _among(F.col("soft"), soft).cast("int")
        found = rows.filter(~F.col("id").isin(self.ids)) if self.ids else rows
        found = found.select("*", near_to(_matrix(self.vectors)).alias("near"), tier.alias("tier"))
        found = found.filter(F.col("near") >= self.twin) if self.ids else found
        found = found if self.relax else found.filter("tier < 2")
        return [r.asDict() for r in found.orderBy("tier", F.desc(F.col("near") + F.col("bias")), "id").limit(self.top).collect()]

    def extend(self, rows: DataFrame, k: int, start: int | None = None, crowd: DataFrame | None = None) -> list[int]:
        """Chooses up to k more rows; returns their ids in order. The very first is ``start``, or the row that is farthest on
        average from all of ``crowd`` (all of rows)."""
        crowd = rows if crowd is None else crowd
        rows, fresh = self._shaped(rows), []
        if not self.ids and k > 0:
            row = self._first(rows, crowd) if start is None else (x.asDict() if (x := rows.filter(F.col("id") == start).first()) else None)
            if row is None:
                return fresh
            self._add(row)
            fresh.append(row["id"])
        key = lambda r: (self._tier(r), -(r["near"] + r["bias"]), r["id"])
        while len(fresh) < k:
            held = self._best(rows)
            last = key(held[-1]) if len(held) == self.top else None  # all that was left behind comes after it
            took = 0
            while len(fresh) < k:
                live = [r for r in held if self._allowed(r)]
                best = min(live, key=key, default=None)
                if best is None or (last is not None and key(best) > last):
                    break
                self._add(best)
                fresh.append(best["id"])
                held.remove(best)
                took += 1
                v = _matrix(r["v"] for r in held)
                for r, d in zip(held, distances(self.vectors[-1:], v) if held else (), strict=True):
                    r["near"] = min(r["near"], float(d))
            if not took:
                break
        return fresh


def farthest(rows: DataFrame, k: int, start: int | None = None, **rules) -> DataFrame:
    """id and place of k rows that are far from each other; rules as of ``Selection``."""
    ids = Selection(**rules).extend(rows, k, start)
    return rows.sparkSession.createDataFrame([(int(x), i) for i, x in enumerate(ids)], "id long, place long")


def _chosen(rows: DataFrame, ids: list[int]) -> list[dict]:
    """The rows of a few ids, in their order."""
    at = {i: n for n, i in enumerate(ids)}
    return sorted((r.asDict() for r in rows.filter(F.col("id").isin(ids)).collect()), key=lambda r: at[r["id"]])


def _closest(v: np.ndarray) -> tuple[float, int, int]:
    """Least distance between two of the points, and which they are; the first at ties."""
    best = (math.inf, 0, 0)
    for i in range(len(v) - 1):
        d = np.sqrt(((v[i + 1 :] - v[i]) ** 2).sum(axis=1))
        j = int(d.argmin())
        if d[j] < best[0]:
            best = float(d[j]), i, i + 1 + j
    return best


def exchange_twins(rows: DataFrame, chosen: list[int], threshold: float, most: int = 60, cluster_cap: int = 5) -> list[int]:
    """rows: id, v, value, class and cluster. While two chosen rows are nearer than the threshold, the less valuable goes (the
    greater id at ties). In its place comes a row never chosen that is no twin and whose cluster has fewer than ``cluster_cap``
    chosen: one of the same class before others, the farthest from the rest first, then the smaller id."""
    now = _chosen(rows, chosen)
    used = set(chosen)
    for _ in range(most):
        least, i, j = _closest(_matrix(r["v"] for r in now))
        if len(now) < 2 or least >= threshold:
            break
        out = min(now[i], now[j], key=lambda r: (r["value"], -r["id"]))
        now.remove(out)
        count = Counter(r["cluster"] for r in now)
        full = [c for c, n in count.items() if n >= cluster_cap]
        free = rows.filter(~F.col("id").isin(list(used)) & ~_among(F.col("cluster"), full)).select("*", near_to(_matrix(r["v"] for r in now)).alias("near"))
        other = ~F.col("class").eqNullSafe(F.lit(out["class"]))
        best: Row | None = free.filter(F.col("near") >= threshold).orderBy(other, F.desc("near"), "id").first()
        if best is not None:
            now.append(best.asDict())
            used.add(best["id"])
    return sorted(r["id"] for r in now)


def lower_share(rows: DataFrame, chosen: list[int], ceiling: int, most: int = 80) -> list[int]:
    """rows: id, v, value and marked. Of the chosen rows that are marked no more than ``ceiling`` stay: the least valuable go
    first, and for each the unmarked row comes that is farthest from all that is chosen then; at most ``most`` exchanges."""
    now = _chosen(rows, chosen)
    marked = sorted((r for r in now if r["marked"]), key=lambda r: (r["value"], r["id"]))
    used = [r["id"] for r in now]
    for out in marked[: max(0, min(len(marked) - ceiling, most))]:
        rest = [r for r in now if r is not out]
        near = F.when(F.col("near") == math.inf, 0.0).otherwise(F.col("near"))
        free = rows.filter(~F.col("marked") & ~F.col("id").isin(used)).select("*", near_to(_matrix(r["v"] for r in rest)).alias("near"))
        best = free.orderBy(F.desc(near), "id").first()
        if best is None:
            break
        now = [*rest, best.asDict()]
        used.append(best["id"])
    return sorted(r["id"] for r in now)
