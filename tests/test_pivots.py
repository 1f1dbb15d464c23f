"""Near pairs, nearest and closest by partitions against all pairs; how many groups are read."""

import numpy as np
import pytest

from folioscope.operators import distance, pivots


def clustered(n, seed, dims=8, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims)) * 10
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims))
    x[n // 2 : n // 2 + 5] = x[:5]  # ties at distance 0
    return x.round(4)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)


def all_distances(x):
    return np.array([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in x])


@pytest.mark.parametrize("n,block", [(600, 24), (40, 512), (7, 2)])
def test_results_are_those_of_all_pairs(spark, n, block):
    x = clustered(n, n) if n > 20 else np.random.default_rng(1).normal(size=(n, 3))
    d, df = all_distances(x), frame(spark, x)
    pairs = sorted((d[a, b], a, b) for a in range(n) for b in range(a + 1, n))
    got = sorted((r.a, r.b) for r in pivots.near_pairs(df, 2.0, block).collect())
    assert got == sorted((a, b) for q, a, b in pairs if q < 2.0)
    got = [(r.a, r.b, r.d) for r in pivots.closest(df, 25, block).collect()]
    assert [(a, b) for a, b, _ in got] == [(a, b) for _, a, b in pairs[:25]]
    near = {r.id: (r.other, r.d) for r in pivots.nearest(df, block).collect()}
    assert len(near) == n
    for i in range(n):
        want = min((d[i, j], j) for j in range(n) if j != i)
        assert near[i] == (want[1], pytest.approx(want[0]))


def test_few_groups_meet_where_vectors_are_in_clusters(spark):
    parts = pivots.Partitions(frame(spark, clustered(2000, 5)), block=50)
    k = parts.ranges.count()
    every = k * (k + 1) // 2
    assert k >= 40 and max(r["count"] for r in parts.rows.groupBy("part").count().collect()) <= 50
    assert parts.meeting(within=2.0).count() < every / 4
    assert parts.meeting(within=1e9).count() == every


def test_one_vector_and_none(spark):
    one, none = frame(spark, np.ones((1, 3))), frame(spark, np.ones((1, 3))).limit(0)
    for df in (one, none):
        assert pivots.near_pairs(df, 1.0).count() == pivots.closest(df, 3).count() == pivots.nearest(df).count() == 0


def test_blocks_grow_with_the_table(spark):
    """Few groups: a pair of blocks holds thousands of vectors, and results stay those of all pairs."""
    x = np.random.default_rng(2).normal(size=(6000, 4)).round(3)
    assert pivots.Partitions(frame(spark, x)).ranges.count() <= 4  # blocks of 512 were 12 and more


def test_nearest_of_two_sides_with_ties():
    x = np.random.default_rng(3).integers(0, 3, (700, 3)).astype(float)
    left, right = distance.Side(np.arange(300), x[:300]), distance.Side(np.arange(300, 700), x[300:])
    got = {r.id: (r.other, r.cost) for r in distance.minima(left, right).itertuples()}
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for i in range(700):
        others = range(300, 700) if i < 300 else range(300)
        assert got[i] == min(((j, square[i, j]) for j in others), key=lambda p: (p[1], p[0]))


def test_percentiles_of_many_equal_distances(spark):
    x = np.repeat(np.random.default_rng(5).normal(size=(40, 3)), 12, axis=0)
    d = all_distances(x)[np.triu_indices(len(x), 1)]
    n, got = distance.pair_percentiles(frame(spark, x), [0.0, 0.02, 0.3, 1.0], block=100, bins=16, most=500)
    assert n == len(d) and got == pytest.approx(np.percentile(d, [0, 2, 30, 100]).tolist(), abs=1e-12)
