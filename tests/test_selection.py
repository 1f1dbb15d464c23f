"""Distributed choices and clusters against one step at a time over a matrix of all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import selection as c
from folioscope.operators.clustering import ward
from tests import greedy


def frame(spark, x, **more):
    rows = [(i, [float(q) for q in v], *[values[i] for values in more.values()]) for i, v in enumerate(x)]
    kinds = {"bias": "double", "marked": "boolean", "class": "string"}
    schema = "id long, v array<double>" + "".join(f", {k} {kinds.get(k, 'long')}" for k in more)
    return spark.createDataFrame(rows, schema).repartition(4)


def order(df):
    return [r.id for r in df.orderBy("place").collect()]


@pytest.mark.parametrize("top", [3, 20, 1000])
def test_choices_are_those_of_one_step_at_a_time(spark, top):
    rng = np.random.default_rng(top)
    x = rng.normal(size=(160, 3))
    x[150:] = x[:10]  # twins at distance 0
    group, soft = (np.arange(160) % 5).tolist(), (np.arange(160) % 11).tolist()
    bias = np.where(np.arange(160) % 3 == 0, -0.4, 0.0)
    m = greedy.matrix(x)
    rows = frame(spark, x, group=group, soft=soft, bias=[float(b) for b in bias])
    for k, rules in [(30, {}), (25, {"cap": 4}), (25, {"cap": 4, "relax": True}), (30, {"cap": 9, "soft_cap": 2, "twin": 0.6})]:
        local = {("soft_cap" if r == "soft_cap" else r): v for r, v in rules.items()}
        want = greedy.farthest_points(m, k, group, local.get("cap"), soft=soft, soft_cap=local.get("soft_cap"), penalty=bias, twin=local.get("twin", 0.0), relax=local.get("relax", False))
        s = c.Selection(top=top, **rules)
        assert s.extend(rows, k) == want
        assert top < 1000 or s.jobs <= 3  # few jobs where the top is wide


def test_choices_go_on_from_what_is_chosen(spark):
    x = np.random.default_rng(1).normal(size=(90, 2))
    m, part = greedy.matrix(x), np.arange(90) % 3
    s, want = c.Selection(cap=8), []
    rows = frame(spark, x, group=(np.arange(90) % 7).tolist())
    for block, k in ((0, 6), (1, 9), (2, 12)):
        away = np.where(part == block, 0.0, -np.inf)
        got = greedy.farthest_points(m, k, (np.arange(90) % 7).tolist(), 8, penalty=away, seed=list(want), start=0 if not want else None)
        want += [i for i in got if part[i] == block]
        s.extend(rows.filter(F.col("id") % 3 == block), k, start=0)
    assert s.ids == want


def test_fifty_thousand_vectors(spark):
    """Past any pool, in few jobs; the choice is that of all rows."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50_000, 8)).round(6)
    df = spark.range(50_000).repartition(8).join(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>"), "id")
    s = c.Selection(top=512)
    got = s.extend(df, 40, start=7)
    near, want = c.distances(x[7:8], x), [7]
    while len(want) < 40:
        want.append(int(near.argmax()))
        near = np.minimum(near, c.distances(x[want[-1:]], x))
    assert got == want and s.jobs < 15


def test_twins_and_ceilings_by_brute_force(spark):
    rng = np.random.default_rng(7)
    for round_ in range(3):
        x = rng.normal(size=(60, 2)).round(3)
        m, value = greedy.matrix(x), rng.integers(0, 5, 60)
        marked, cluster, kind = rng.random(60) < 0.6, rng.integers(0, 6, 60), rng.choice(list("abc"), 60)
        chosen = sorted(rng.choice(60, 20, replace=False).tolist())
        rows = frame(spark, x, value=value.tolist(), marked=marked.tolist(), cluster=cluster.tolist(), **{"class": kind.tolist()})
        assert c.lower_share(rows, chosen, 5 + round_) == greedy.class_ceiling(m, chosen, marked, value, 5 + round_)
        want = greedy.twin_sweep(m, chosen, value, kind.tolist(), 0.3, most=8, clusters=cluster.tolist(), cluster_cap=4)
        assert c.exchange_twins(rows, chosen, 0.3, 8, 4) == want


@pytest.mark.parametrize("n,dims,block", [(1, 2, 8), (25, 3, 8), (300, 4, 64), (300, 16, 2048)])
def test_ward_labels_are_those_of_chains(spark, n, dims, block):
    x = np.random.default_rng(n + dims).normal(size=(n, dims))
    ks = (max(1, round(n / 3.5)), max(1, round(n / 2.2)), min(n, 2), n)
    got = ward(frame(spark, x), *ks, block=block).orderBy("id").toPandas()
    for i, k in enumerate(ks):
        assert got[f"cluster_{i}"].tolist() == greedy.ward(x, k).tolist()


def test_ward_ends_in_one_task_once_two_blocks_hold_what_is_left(spark):
    from folioscope.sources import scratch

    x = np.random.default_rng(4).normal(size=(260, 24))  # of many dimensions: many rounds join few
    want, tables = [greedy.ward(x, k).tolist() for k in (74, 118)], {}
    for block in (None, 100):
        before = len(scratch._made)
        got = ward(frame(spark, x), 74, 118, block=block).orderBy("id").toPandas()
        tables[block] = len(scratch._made) - before
        assert [got["cluster_0"].tolist(), got["cluster_1"].tolist()] == want
    assert tables[None] < 14 and tables[None] < tables[100] < 26


def test_ward_of_repeated_vectors(spark):
    x = np.repeat(np.random.default_rng(3).normal(size=(6, 2)), 7, axis=0)
    got = ward(frame(spark, x), 6).orderBy("id").toPandas()
    assert got["cluster_0"].tolist() == np.repeat(np.arange(6), 7).tolist()


def test_empty_and_null_groups(spark):
    rows = frame(spark, np.zeros((0, 2)))
    assert c.farthest(rows, 5, start=1).count() == 0 and c.Selection().extend(rows, 3) == []
    rows = spark.createDataFrame([(i, [float(i)], None) for i in range(6)], "id long, v array<double>, group long")
    assert len(order(c.farthest(rows, 6, cap=2))) == 2 and len(order(c.farthest(rows, 6, cap=2, relax=True))) == 6


@pytest.fixture(scope="module")
def pool():
    import pyarrow.parquet as pq

    from tests.conftest import SF

    pdf = pq.read_table(f"{SF}/embeddings.parquet").to_pandas().sort_values("vec_id").reset_index(drop=True)
    return pdf.vec_id.to_numpy(), np.stack(pdf.embedding.to_numpy()).astype(float), pdf.label.tolist()


def run(spark, name):
    from folioscope import plans
    from tests.conftest import SF

    return plans.QUERIES[name](spark, SF)


def test_selection_queries_by_brute_force(spark, pool):
    ids, x, label = pool
    m = greedy.matrix(x)
    got = [r.id for r in run(spark, "farthest_point").orderBy("place").collect()]
    assert got == [ids[i] for i in greedy.farthest_points(m, 60, label, 12, relax=True)]
    soft, want = (ids % 25).tolist(), []
    for block, k in ((0, 20), (1, 20), (2, 20), (3, 40)):
        penalty = np.where(ids % 3 == 0, -0.4, 0.0) + np.where(ids % 4 == block, 0.0, -np.inf)
        picked = greedy.farthest_points(m, k, label, 40, soft=soft, soft_cap=6, penalty=penalty, twin=0.5, seed=[i for i, _ in want])
        want += [(i, block) for i in picked if ids[i] % 4 == block]
    assert sorted(map(tuple, run(spark, "quota_selection").collect())) == sorted((ids[i], b) for i, b in want)


def test_exchange_queries_by_brute_force(spark, pool):
    ids, x, label = pool
    m, value, first = greedy.matrix(x), ids * 7 % 101, list(range(min(100, len(ids))))
    bound = float(np.percentile(m[np.triu_indices(len(m), 1)], 2))
    want = greedy.twin_sweep(m, first, value, label, bound, clusters=(ids % 60).tolist())
    assert sorted(r.id for r in run(spark, "twin_sweep").collect()) == sorted(ids[want].tolist())
    want = greedy.class_ceiling(m, first, ids % 2 == 0, value, 30)
    assert sorted(r.id for r in run(spark, "language_ceiling").collect()) == sorted(ids[want].tolist())


def test_ward_query_by_brute_force(spark, pool):
    ids, x, _ = pool
    got = {r.id: (r.cluster, r.cluster_fine) for r in run(spark, "ward_clusters").collect()}
    coarse, fine = greedy.ward(x, max(20, round(len(x) / 3.5))), greedy.ward(x, round(len(x) / 2.2))
    assert got == {i: (a, b) for i, a, b in zip(ids.tolist(), coarse.tolist(), fine.tolist(), strict=True)}
