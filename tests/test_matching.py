"""Matching blocks and ratios against the standard library's, and long lists in blocks."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions.matching import Blocks, coded, common_bound, ratio
from folioscope.operators import postings


def test_blocks_are_the_standard_librarys():
    r = random.Random(3)
    for _ in range(1500):
        k = r.choice([1, 2, 3, 6, 30])
        a, b = ([r.randrange(k) for _ in range(r.randrange(0, 40))] for _ in "ab")
        want = [(m.a + i, m.b + i) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for i in range(m.size)]
        assert Blocks(*coded(a, b)).pairs() == want


@pytest.mark.parametrize("popular", [False, True])
def test_ratios_are_the_standard_librarys(popular):
    r = random.Random(7)
    for _ in range(400):
        k = r.choice([1, 3, 6, 30, 150])
        a, b = ("".join(chr(0x1F600 + r.randrange(k)) for _ in range(r.randrange(0, n))) for n in (300, 450))
        if r.random() < 0.4:
            b = "".join(r.choice([c, "q"]) if r.random() < 0.1 else c for c in a) * r.choice([1, 2])
        m = difflib.SequenceMatcher(None, a, b, autojunk=popular)
        assert ratio(a, b, popular) == pytest.approx(m.ratio())
        assert common_bound(a, b) >= ratio(a, b, False) - 1e-12


def test_a_label_of_every_row_is_many_blocks(spark):
    rows = spark.range(0, 5000, 1, 7).select("id", F.array(F.lit("all"), F.when(F.col("id") % 3 == 0, "third").otherwise("all"), F.concat(F.lit("x"), (F.col("id") % 50).cast("string"))).alias("labels"))
    lists = postings.posting_lists(rows, "id", "labels", 64)
    got = {}
    for r in lists.orderBy("label", "block").collect():
        assert r.n == len(r.ids) <= 64 and r.ids == sorted(r.ids)
        assert r.block == len(got.setdefault(r.label, [])) // 64  # no block is short but the last
        got[r.label] += r.ids
    assert got["all"] == list(range(5000)) and got["third"] == list(range(0, 5000, 3)) and got["x7"] == list(range(7, 5000, 50))
    heads = {r.label: (r.n, r.blocks) for r in postings.directory(lists).collect()}
    assert heads["all"] == (5000, 79) and len(heads) == 52
    assert postings.posting_lists(rows.limit(0), "id", "labels").count() == 0


def test_blocks_of_null_groups_and_ties(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), (None, None), ("a", 2)], "k string, v int")
    got = sorted((r.k or "", r.block, r.v or 0) for r in postings.in_blocks(rows, "k", [F.col("v")], 2).collect())
    assert got == [("", 0, 0), ("", 0, 1), ("", 1, 1), ("a", 0, 2)]


def test_resolved_spans_are_those_settled_one_by_one(spark):
    from folioscope.operators import spans as p

    r = random.Random(9)
    fields = [*p.PRIORITY[::2], "unknown"]
    rows = []
    for i in range(120):
        spans = [(s := r.randrange(0, 120), s + r.choice([0, 3, 9, 14, 40, 130]), r.choice(fields)) for _ in range(r.randrange(0, 7))]
        rows.append((i, spans))
    df = spark.createDataFrame([*rows, (999, None)], "id long, spans array<struct<start: long, end: long, field: string>>")
    got = {x.id: [(s.start, s.end, s.field) for s in x.s] for x in df.select("id", p.resolve(F.col("spans")).alias("s")).collect()}
    assert got == {i: p.settle(spans) for i, spans in rows} | {999: []}


def test_percentiles_by_rank(spark):
    import numpy as np

    from folioscope.operators.sets import percentiles_by_rank

    r = random.Random(4)
    rows = [(g, None if r.random() < 0.1 else round(r.random() * 9, 1)) for g in ["a"] * 200 + ["b"] * 3 + [None] * 7 + ["one"] for _ in range(1)] + [("nothing", None)]
    shares = [0.0, 0.02, 0.25, 0.5, 0.9, 1.0]
    got = {x.g: x.q for x in percentiles_by_rank(spark.createDataFrame(rows, "g string, v double").repartition(3), "g", "v", shares).collect()}
    for g in {x for x, v in rows if v is not None}:
        assert got.pop(g) == pytest.approx(np.percentile([v for x, v in rows if x == g and v is not None], [100 * s for s in shares]))
    assert not got
