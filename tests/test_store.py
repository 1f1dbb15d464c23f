"""The keyed store: latest wins whatever order batches come in, repeats change nothing, other buckets are not touched."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from folioscope.sources.store import KeyedStore
from folioscope.streaming.incremental import upsert_available

SCHEMA = "k string, t long, v string"


def latest(batches):
    """By plain Python: the greatest (t, batch) of each key; rows without a key all stay, once a batch."""
    best, loose = {}, []
    for number, rows in dict(batches).items():
        loose += [r for r in rows if r[0] is None]
        for r in rows:
            if r[0] is not None:
                best[r[0]] = max(best.get(r[0], ((-1, -1), None)), ((r[1], number), r), key=lambda x: x[0])
    return sorted([r for _, r in best.values()] + loose, key=str)


def stored(store):
    return sorted((tuple(r) for r in store.rows().select("k", "t", "v").collect()), key=str)


def test_batches_in_any_order_and_twice(spark, tmp_path):
    batches = [
        (0, [("a", 1, "a1"), ("b", 5, "b5"), (None, 1, "x"), (None, 1, "x"), ("c", 1, None)]),
        (1, [("a", 2, "a2"), ("b", 3, "late"), (None, 2, "y"), ("d", 1, "d1")]),
        (2, [("c", 1, "same time, later batch"), ("e", 1, "")]),
    ]
    store = KeyedStore(spark, str(tmp_path / "s"), "k", ["t"], 4)
    with pytest.raises(FileNotFoundError):
        store.rows()
    for number, rows in [batches[0], batches[1], batches[1], batches[2], batches[0]]:
        store.upsert(spark.createDataFrame(rows, SCHEMA), number)
    assert stored(store) == latest(batches)
    assert store.upsert(spark.createDataFrame([], SCHEMA), 3) == []
    assert sorted(r.v for r in store.lookup(spark.createDataFrame([("a",), ("a",), ("z",)], "k string")).collect()) == ["a2"]


def test_other_buckets_keep_their_files(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "k", ["t"], 8)
    store.upsert(spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).cast("long").alias("t"), F.lit("old").alias("v")), 0)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/s/_bucket=*/*.parquet")}
    touched = store.upsert(spark.createDataFrame([("7", 2, "new")], SCHEMA), 1)
    assert len(touched) == 1
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/s/_bucket=*/*.parquet")}
    same = {f for f in before if f"_bucket={touched[0]}/" not in f}
    assert len({os.path.dirname(f) for f in same}) == 7 and all(after[f] == before[f] for f in same)
    assert dict((r.k, r.v) for r in store.rows().collect())["7"] == "new" and store.rows().count() == 200


def test_a_stream_feeds_the_store(spark, tmp_path):
    src, mark = str(tmp_path / "src"), str(tmp_path / "mark")
    store = KeyedStore(spark, str(tmp_path / "s"), "k", ["t"], 3)
    put = lambda rows, name: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/{name}")
    go = lambda: upsert_available(spark, f"{src}/*", SCHEMA, lambda b: b.filter("v <> 'no'"), store, mark, 1)
    put([("a", 1, "a1"), ("b", 1, "no")], "1")
    put([("a", 3, "a3"), (None, 1, "x")], "2")
    assert go() == 2 and go() == 0
    put([("a", 2, "a2"), ("b", 1, "b1")], "3")
    assert go() == 1
    assert stored(store) == sorted([("a", 3, "a3"), ("b", 1, "b1"), (None, 1, "x")], key=str)


@pytest.mark.parametrize("files", [1, 2, 7])
def test_a_collection_is_the_same_however_the_stream_is_cut(spark, tmp_path, files):
    from folioscope.streaming.incremental import Collection, collect_until

    rows = [(i, "ok" if i % 4 == 1 else "bad" if i % 3 else "late") for i in range(140)]
    want = [sorted(map(tuple, t.collect())) for t in collect_until(spark.createDataFrame(rows, "id long, status string"), "status", "ok", 20, ["id"])]
    c = Collection(spark, str(tmp_path / "c"), "status", "ok", 20, ["id"])
    stream = lambda: spark.readStream.schema("id long, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src/*")
    step = 140 // files
    for n in range(files):
        spark.createDataFrame(rows[n * step : (n + 1) * step], "id long, status string").coalesce(1).write.parquet(f"{tmp_path}/src/{n}")
        left = c.follow(stream(), str(tmp_path / "mark"))
    assert left == 0
    c.add(spark.createDataFrame(rows[:step], "id long, status string"), 0)  # delivered twice
    assert [sorted(map(tuple, t.select(*k).collect())) for t, k in zip(c.tables(), (["id", "status"], ["status", "n"]), strict=True)] == want
