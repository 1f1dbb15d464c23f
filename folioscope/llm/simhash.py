"""SimHash near-duplicates by vantage-point trees: exact pairs of fingerprints at Hamming distance 2 or less.

A fingerprint has a bit where over half of the text's 3-word shingle hashes have it. Equal fingerprints are
merged first. A vantage-point tree over the distinct fingerprints is laid out on a bounded sample: each node
has a vantage point and a radius; points within the radius go left, the others right, and the points in the
last two distances before the radius are also sent right as guests. By the triangle bound two points at
distance 2 whose sides differ are then together on the right. Leaves are shards; inside a shard the same
recursion goes on in memory down to small blocks, which are compared in full. A shard gives a spanning forest
of its links, never all pairs, and the links are closed to components by shuffles.

Guests make copies: of random fingerprints each goes to 3.5 leaves at 256,000, 6.5 at 1.3 million, 15 at 13
million (29,513 leaves of 6,519 points) and 20 from 33 million on, where the sample is used up (87,496 leaves);
beyond that a leaf grows with the input, one point for each 4,400. It is eight bytes a point in one task, which
splits it on down to blocks. The layout is made on the driver, in 8 s at 13 million and 27 s at most.

Defined results: null, empty and wordless texts have fingerprint zero and are linked like any other; a null
doc_id gets the component of its fingerprint's group and is never its name, unless the group has no other;
very long texts are hashed whole, by stretches of 65,536 shingles; repeated rows are in one group; an empty
table gives an empty result; other columns are ignored by the query and kept by ``keep_one``.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import boxed, load, materialize
from folioscope.llm.components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Distinct fingerprints for each shard, and the most that are sampled to lay out the shards.
SHARD_POINTS = 8192
SAMPLE = 65536
BLOCK = 192


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :])], np.uint64)  # noqa: B905
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(">u8")[0])


FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), in one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values)], FINGERPRINTS.fieldNames())

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, FINGERPRINTS)


def distances(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


def split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """Vantage point and radius that part the points most evenly; None if no try parts them.

    Candidates are points far from each other, then points near them: a tight ball of fingerprints has
    no radius around a far point that parts it, but has one around its own members.
    """
    best = None
    tries = [points[len(points) // 2]]
    tries.append(points[int(np.argmax(distances(points, tries[0])))])
    tries += [points[(i * len(points)) // 5] for i in (1, 3)]
    for v in tries:
        counts = np.bincount(distances(points, v), minlength=65)
        left = np.cumsum(counts)
        for radius in np.flatnonzero((left > 0) & (left < len(points))):
            guests = counts[max(0, radius - RADIUS + 1) : radius + 1].sum()
            cost = max(left[radius], len(points) - left[radius] + guests)
            if best is None or cost < best[0]:
                best = (cost, np.uint64(v), int(radius))
    return best[1:] if best and best[0] <= 0.9 * len(points) else None


def layout(sample: np.ndarray, leaf: int) -> list[tuple]:
    """Inner nodes (vantage, radius, left, right) of a tree over the sample; a child below 0 is leaf -child-1."""
    nodes: list = []
    leaves = 0

    def grow(points: np.ndarray) -> int:
        nonlocal leaves
        cut = split(points) if len(points) > leaf else None
        if cut is None:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(None)
        d = distances(points, cut[0])
        nodes[at] = (cut[0], cut[1], grow(points[d <= cut[1]]), grow(points[d > cut[1] - RADIUS]))
        return at

    grow(np.unique(sample))
    return nodes


def route(nodes: list[tuple], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of point, leaf) for every leaf that a point goes to, as owner or guest."""
    if not nodes:
        return np.arange(len(points)), np.ones(len(points), np.int64)
    which, leaf, todo = [], [], [(0, np.arange(len(points)))]
    while todo:
        at, index = todo.pop()
        if not len(index):
            continue
        if at < 0:
            which.append(index)
            leaf.append(np.full(len(index), -at, np.int64))
            continue
        v, radius, left, right = nodes[at]
        d = distances(points[index], v)
        todo += [(left, index[d <= radius]), (right, index[d > radius - RADIUS])]
    return (np.concatenate(which), np.concatenate(leaf)) if which else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs, of the links at distance RADIUS or less among distinct points."""
    parent = np.arange(len(points))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    todo = [np.arange(len(points))]
    while todo:
        index = todo.pop()
        cut = split(points[index]) if len(index) > BLOCK else None
        if cut is not None:
            d = distances(points[index], cut[0])
            todo += [index[d <= cut[1]], index[d > cut[1] - RADIUS]]
            continue
        own = points[index]
        for at in range(0, len(own), BLOCK):  # a ball that no radius parts is compared by stripes
            near = np.bitwise_count(own[at : at + BLOCK, None] ^ own[None, at:]) <= RADIUS
            rows, columns = np.nonzero(near)
            for i, j in zip(rows[rows < columns], columns[rows < columns], strict=True):
                x, y = root(index[at + i]), root(index[at + j])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(index[at + i])
                    b.append(index[at + j])
    return np.array(a, np.int64), np.array(b, np.int64)


EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
ROUTED = T.StructType([T.StructField("leaf", T.LongType()), T.StructField("fp", T.LongType())])


def linked_fingerprints(distinct: DataFrame, radius_points: int = SHARD_POINTS, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): a forest for each shard of the tree."""
    n = distinct.count()
    if n > radius_points:  # at most ``sample`` longs, as Arrow
        chosen = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp").toArrow().column("fp").to_numpy()
    else:
        chosen = np.zeros(0, np.int64)
    some = np.sort(chosen).view(np.uint64)
    nodes = layout(some, max(16, radius_points * len(some) // max(n, 1))) if len(some) else []

    def send(batches):
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            which, leaf = route(nodes, points)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(points[which].view(np.int64))], ROUTED.fieldNames())

    def solve(table: pa.Table) -> pa.Table:
        points = np.unique(table.column("fp").to_numpy().view(np.uint64))
        a, b = links(points)
        return pa.table([pa.array(points[a].view(np.int64)), pa.array(points[b].view(np.int64))], EDGES.fieldNames())

    return distinct.select("fp").mapInArrow(send, ROUTED).groupBy("leaf").applyInArrow(solve, EDGES)


def components_of(marked: DataFrame) -> DataFrame:
    """(fp, component, component_id) of every fingerprint in marked (a written table of doc_id, fp); component is a
    fingerprint of the component, component_id the least doc_id that links reach."""
    groups = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(linked_fingerprints(groups.select("fp")))
    named = groups.join(found, groups.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return materialize(named.join(names, "component").select("fp", "component", "component_id"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every document; component_id is the least doc_id that links reach."""
    marked = materialize(fingerprints(docs))
    return marked.join(components_of(marked), "fp").select("doc_id", "fp", "component_id")


def op9_simhash_vptree(spark, sf_dir):
    """Contract query: doc_id, fingerprint as 16 hex digits, component_id."""
    out = near_groups(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


MARKED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("uid", T.LongType()), T.StructField("fp", T.LongType())])


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group: the one of the least doc_id (null last), then of the least text hash.

    A group is a component of fingerprints, so rows that share a doc_id but not a text are kept or left by their
    own groups, and rows without a doc_id are grouped like any other. Of equal rows one stays.
    """

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch.column(3).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values)], MARKED.fieldNames())

    rows = boxed(docs, h=F.xxhash64("text"))
    marked = materialize(rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "h", "uid", F.col("row.text").alias("text")).mapInArrow(run, MARKED))
    of = components_of(marked.select("doc_id", "fp")).select("fp", "component")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "uid"))
    # a fingerprint's best row first, which is summed on the map side, then a component's: no group is brought together
    best = marked.groupBy("fp").agg(first.alias("best")).join(of, "fp").groupBy("component").agg(F.min("best").alias("best"))
    return rows.select("uid", "row").join(best.select(F.col("best.uid").alias("uid")), "uid", "left_semi").select("row.*")
