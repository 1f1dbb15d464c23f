"""Every operator against a brute-force version on rows with nulls, ties, copies, long and empty texts."""

import hashlib
import math
import pathlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import (
    automaton_dedup,
    common,
    components,
    decontaminate,
    licenses,
    line_dedup,
    mixing,
    quality,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
)
from tests.llm.conftest import prose


def key(v):
    return (v is None, v or 0)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is None, str(x)) for x in r])


def labels(spark, toxic_ids=(), rows=()):
    return spark.createDataFrame([(i, 1, int(i in toxic_ids)) for i in rows] or [(None, None, None)], "doc_id long, quality int, toxic int")


# --- quality


def brute_stats(text):
    text = text or ""
    words, w = [], ""
    for c in text:
        if c in " \t\n\r\x0b\x0c":
            words += [w] if w else []
            w = ""
        else:
            w += c
    words += [w] if w else []
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts_and_verdicts(spark, messy, messy_rows, empty, save):
    path = save(documents=messy, labels=labels(spark, rows=[r[0] for r in messy_rows if r[0]]))
    got = quality.op1_quality_forest(spark, path).collect()
    want = sorted([(r[0], *brute_stats(r[1])) for r in messy_rows], key=lambda r: [(x is None, str(x)) for x in r])
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=lambda r: [(x is None, str(x)) for x in r]) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept is (not r.base_failed)  # one kind of label only: nothing is anomalous
    assert quality.score_quality(empty, labels(spark)).count() == 0


def test_forest_separates_junk_from_prose():
    rng = np.random.default_rng(0)
    good = np.column_stack([np.zeros(400), rng.normal(5, 0.3, 400), rng.normal(0.8, 0.05, 400)])
    bad = np.column_stack([rng.uniform(1, 3, 40), rng.normal(8, 1, 40), rng.normal(0.5, 0.1, 40)])
    x = np.vstack([good, bad])
    f = quality.Forest(x)
    score = f.score(x)
    t = quality.calibrate(score, np.arange(440) < 400)
    assert (score[:400] < t).mean() >= 0.99 and (score[400:] >= t).mean() > 0.8
    assert quality.Forest(x).score(x).tolist() == score.tolist()


def test_forest_and_threshold_use_every_document(spark):
    """Junk is labelled only past the first 8,192 documents by hash; null and repeated ids, unlabelled rows."""
    rng = np.random.default_rng(1)
    known = spark.range(9000).orderBy(F.xxhash64("id"), "id").toPandas().id.to_numpy()
    junk = set(known[8500:].tolist())
    words = rng.integers(100, 400, 9000)
    rows = [(i, int(w), int(w * (9 if i in junk else 5)), int(2 * w) if i in junk else 0, 0, 0, int(w * rng.uniform(0.7, 0.9))) for i, w in enumerate(words)]
    rows += [(None, 200, 1000, 0, 0, 0, 150)] * 3 + [(5, 99, 999, 99, 0, 0, 40), (9500, 70, 420, 0, 0, 0, 60), (9501, 10, 50, 0, 0, 0, 9)]
    stats = spark.createDataFrame(rows, quality.STATS).repartition(5)
    lab = spark.createDataFrame([(i, int(i not in junk), 0) for i in range(9000)] + [(5, 1, 0), (9501, 0, 0)], "doc_id long, quality int, toxic int")
    forest, threshold = quality.fit(stats, lab)
    assert math.isfinite(threshold)

    pdf = stats.filter(f"n_words >= {quality.MIN_WORDS}").withColumn("bag", quality.bag()).toPandas()
    assert len(pdf) == 9005
    x, bags = quality.features(pdf), pdf.bag.to_numpy()
    want = quality.Forest(n=len(pdf))
    while want.level <= quality.DEPTH:
        want.grow(*want.summary(x, bags))
    for name in ("feature", "cut", "value"):
        assert (getattr(forest, name) == getattr(want, name)).all()
    best = pdf[pdf.doc_id.notna() & (pdf.doc_id < 9000)].sort_values(quality.STATS.fieldNames()).drop_duplicates("doc_id")
    assert len(best) == 9000
    good = ~best.doc_id.isin(junk).to_numpy()
    score = want.score(quality.features(best), best.bag.to_numpy())
    assert threshold == quality.calibrate(score, good)
    assert (score[good] < threshold).mean() >= 0.99 and (score[~good] >= threshold).mean() > 0.9


def test_out_of_bag_score_leaves_out_the_own_trees():
    x = np.random.default_rng(3).normal(size=(300, 3))
    f = quality.Forest(x)
    bags = np.arange(300) % quality.TREES
    alone = []
    for row, b in zip(x, bags, strict=True):
        paths = []
        for t in range(quality.TREES):
            node = 0
            while f.feature[t, node] >= 0:
                node = 2 * node + 1 + int(row[f.feature[t, node]] >= f.cut[t, node])
            if t not in {(b + j) % quality.TREES for j in range(f.dealt)}:
                paths.append(f.value[t, node])
        alone.append(2 ** (-np.mean(paths) / f.norm))
    assert f.dealt == 22 and np.allclose(f.score(x, bags), alone, rtol=1e-12)


def test_threshold_by_counts_equals_threshold_in_memory(spark):
    rng = np.random.default_rng(4)
    for n, share in ((400, 0.9), (400, 0.5), (50, 1.0), (50, 0.0), (0, 0)):
        good = rng.random(n) < share
        score = np.round(rng.random(n) + ~good * 0.3, 2)  # with ties
        df = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(score, good, strict=True)], "score double, good boolean")
        for keep in (0.99, 0.5):
            assert quality.calibrate_rows(df, keep) == quality.calibrate(score, good, keep)


def plain_verdicts(path, spark):
    """Verdicts of the query with both kinds of labels: the forest's trees walked one document and one tree at a time."""
    docs, labels_ = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.document_stats(docs)
    forest, threshold = quality.fit(stats, labels_)
    out = {}
    for r in stats.collect():
        x = quality.features({c: np.array([r[c]]) for c in quality.STATS.fieldNames()[1:]})[0]
        length = 0.0
        for f, cut, value in zip(forest.feature, forest.cut, forest.value, strict=True):
            node = 0
            while f[node] >= 0:
                node = 2 * node + (2 if x[f[node]] >= cut[node] else 1)
            length += value[node]
        score = 2 ** (-length / len(forest.feature) / forest.norm)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        out[r.doc_id] = (failed, not failed and score < threshold)
    return out, threshold


def test_quality_verdicts_with_both_labels(spark, save):
    rng = random.Random(2)
    junk = lambda i: " ".join(rng.choice(["#", "$$", "%&", "zz"]) * rng.randrange(1, 9) + str(rng.random()) for _ in range(60 + i % 40))
    rows = [(i, prose(i, 60 + i % 90)) for i in range(300)] + [(1000 + i, junk(i)) for i in range(24)] + [(2000, "few words"), (2001, "same " * 80), (None, prose(7, 80))]
    path = save(documents=spark.createDataFrame(rows, "doc_id long, text string"), labels=spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 0, 0) for i in range(0, 24, 2)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality.op1_quality_forest(spark, path).collect()}
    want, threshold = plain_verdicts(path, spark)
    assert math.isfinite(threshold) and {i: (r.base_failed, r.kept) for i, r in got.items()} == want
    kept = sum(got[1000 + i].kept for i in range(24)), sum(got[i].kept for i in range(300))
    assert kept[0] < 12 and kept[1] >= 290, kept
    few = save(documents=spark.createDataFrame(rows[:3] + rows[300:302], "doc_id long, text string"), labels=spark.createDataFrame([(0, 1, 0), (1, 1, 0), (1000, 0, 0)], "doc_id long, quality int, toxic int"))
    want, _ = plain_verdicts(few, spark)  # a forest of five rows is a forest
    assert {r.doc_id: (r.base_failed, r.kept) for r in quality.op1_quality_forest(spark, few).collect()} == want


# --- mixing


def light(docs):
    """What sample_counts takes: a written table with a hash of the text and a row number."""
    own = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    return common.materialize(own.withColumn("uid", F.monotonically_increasing_id()))


@pytest.mark.parametrize("ids", [None, 5])
def test_one_id_for_all_rows_fills_no_task(spark, ids):
    """Rows with no id, or all with one, are dealt out evenly and mixed and sharded like any other."""
    text = F.when(F.col("id") % 3 == 0, F.concat_ws(" ", F.lit("a b"), "id")).otherwise("same text")
    docs = spark.range(20000).select(F.lit(ids).cast("long").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    order = ["source", "doc_id", "h", "uid"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        common.in_order(light(docs), order)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folder = pathlib.Path(common._made[-1][1].removeprefix("file://"))
    per = [pq.read_metadata(f).num_rows for f in folder.glob("*.parquet")]
    assert len(per) == 4 and max(per) < 2 * 20000 / 4
    assert mixing.mix_documents(docs).count() == 20000  # one source: its target is its size
    out = sharding.shard_documents(docs, 7).toPandas()
    assert out.groupby("shard").size().agg(["min", "max"]).tolist() == [2857, 2858]
    assert sorted(out.slot[out["shard"] == 0]) == list(range(out[out["shard"] == 0].shape[0]))


def test_places_and_sums_in_order(spark):
    r = random.Random(8)
    rows = [(r.choice([None, 1, 1, 1, 2]), r.randrange(100), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v long, i int")
    got = common.in_order(df, ["k", "v", "i"], ("v",)).orderBy("place").collect()
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    assert [(x.k, x.v, x.i) for x in got] == want and [x.place for x in got] == list(range(500))
    assert [x.before_v for x in got] == [sum(w[1] for w in want[:i]) for i in range(500)]
    assert common.in_order(df.limit(0), ["k", "v", "i"], ("v",)).count() == 0


def test_mix_targets_and_copies(spark, messy, messy_rows, empty):
    sized = light(messy)
    got = mixing.sample_counts(sized, rows_per_bucket=8).toPandas()
    assert len(got) == len(messy_rows)
    total = sum(len((r[1] or "").split()) for r in messy_rows)
    per = defaultdict(int)
    for r in messy_rows:
        per[r[3]] += len((r[1] or "").encode().split())
    names = sorted([s for s in per if s is not None]) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, dict(per), float(sum(per.values()))
    while True:  # cap, share the excess again by weight
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * per[s]]
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = 3 * per[s]
            left -= target[s]
            del open_[s]
    assert total
    for s in names:
        mine = got[got.source.isna()] if s is None else got[got.source == s]
        assert np.allclose(mine.target, target[s])
        assert (mine.copies <= 3).all()
        assert abs((mine["size"] * mine.copies).sum() - target[s]) <= 3 * mine["size"].max()
    again = mixing.sample_counts(light(messy.repartition(7)), rows_per_bucket=8).toPandas()
    assert sorted(map(str, got[["doc_id", "size", "copies"]].values.tolist())) == sorted(map(str, again[["doc_id", "size", "copies"]].values.tolist()))
    out = mixing.mix_documents(messy)
    assert out.columns == messy.columns
    assert out.count() == int(mixing.sample_counts(sized).agg(F.sum("copies")).first()[0])
    assert mixing.mix_documents(empty).count() == 0


# --- sharding


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, messy, messy_rows, empty, law):
    out = sharding.shard_documents(messy, 5, law)
    assert set(messy.columns) < set(out.columns)
    pdf = out.select("doc_id", "text", "shard", "slot", "cell").toPandas()
    assert len(pdf) == len(messy_rows)
    size = pdf.text.map(lambda t: 8 if t is None else len(t.encode()) + 8)
    for s, part in pdf.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert pdf.sort_values(["shard", "slot"]).cell.is_monotonic_increasing
    if law == "rows":
        n = pdf.groupby("shard").size()
        assert n.max() - n.min() <= 1 and len(n) == 5
    else:
        b = size.groupby(pdf.shard).sum()
        assert (b - size.sum() / 5).abs().max() <= 2 * size.max()
    assert sharding.shard_documents(empty, 5, law).count() == 0


def test_equal_texts_are_one_stretch_of_the_order(spark, save):
    rows = [(i, f"text {i % 40}", "en" if i % 2 else "de", f"s{i % 7}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sharding.shard_documents(docs, 9).toPandas().sort_values(["shard", "slot"])
    assert out.groupby("text").cell.nunique().max() == 1
    assert (out.text.to_numpy()[1:] != out.text.to_numpy()[:-1]).sum() == 39
    got = sharding.op3_hilbert_shards(spark, save(documents=docs)).toPandas()
    assert (got.groupby("text_crc32")["shard"].nunique() > 1).sum() <= 23


def test_cells_follow_the_bins(spark, messy, messy_rows):
    """The cell of every row by a plain reading of the rule."""
    out = sharding.shard_documents(messy, 5).toPandas()
    groups = defaultdict(list)
    for r in messy_rows:
        groups[r[1] or ""].append((r[3], r[2]))
    lead = {t: min(g, key=lambda x: [(v is not None, v or "") for v in x]) if len(g) > 1 else g[0] for t, g in groups.items()}
    rows = [(*lead[r[1] or ""], math.floor(4 * math.sqrt(math.sqrt(len((r[1] or "").encode()) + 8)))) for r in messy_rows]
    binned = []
    for d in range(3):
        count = Counter(r[d] for r in rows)
        before, bins = 0, {}
        for v in sorted(count, key=lambda v: (v is None, v or 0 if d == 2 else v or "")):
            bins[v] = before * 16 // len(rows)
            before += count[v]
        binned.append([bins[r[d]] for r in rows])
    cell = sharding.hilbert_index(np.array(binned).T, 4)
    want = Counter((r[0], r[1], int(c)) for r, c in zip(messy_rows, cell))
    assert Counter((None if pd.isna(i) else int(i), t, c) for i, t, c in zip(out.doc_id, out.text, out.cell)) == want


def test_written_shards_prune_files(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 50), "en", f"s{i % 40:02d}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sharding.write_shards(sharding.shard_documents(docs, 16), str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("shard=*/*.parquet"))
    assert len(files) == 16
    ranges = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.to_arrow_schema().names.index("source")
        groups = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        ranges.append((min(g.min for g in groups), max(g.max for g in groups)))
    hit = [sum(low <= f"s{k:02d}" <= high for low, high in ranges) for k in range(40)]
    assert np.mean(hit) < 8  # a source is looked for in less than half of the files


def test_hilbert_curve_is_one_path():
    import itertools

    cells = np.array(list(itertools.product(range(8), repeat=3)))
    index = sharding.hilbert_index(cells, 3)
    assert sorted(index) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_contract_of_shards(spark, messy, messy_rows, save):
    got = sharding.op3_hilbert_shards(spark, save(documents=messy)).collect()
    assert rows_of(spark.createDataFrame([(r.doc_id, r.size, r.text_crc32) for r in got], "a long, b long, c long"), "a", "b", "c") == sorted(
        [(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in messy_rows], key=lambda r: [(x is None, str(x)) for x in r]
    )
    assert all(r.grown_shard is None and r.law == "rows" and 0 <= r.shard < 24 for r in got)


# --- suffix array


@pytest.mark.parametrize("letters,n", [(1, 200), (2, 400), (4, 3000), (256, 2000)])
def test_two_stage_suffix_order(letters, n):
    text = np.random.default_rng(letters).integers(0, letters, n).astype(np.uint8)
    order = suffix_dedup.suffix_order(text)
    b = text.tobytes()
    assert sorted(order) == list(range(n))
    cut = [b[i : i + 50] for i in order]
    assert all(x <= y for x, y in zip(cut, cut[1:]))


def test_only_the_asked_suffixes_and_those_they_need_are_sorted():
    r = np.random.default_rng(3)
    for trial in range(60):
        text = (r.integers(0, 1 + trial % 5, 900) + 97).astype(np.uint8)
        if trial % 2:
            text = np.repeat(text, r.integers(1, 130, 900))[:3000]
        asked = np.arange(len(text)) % 67 < 18
        order = suffix_dedup.suffix_order(text, asked)
        assert len(order) == len(set(order.tolist())) and not len(np.setdiff1d(np.flatnonzero(asked), order))
        b = text.tobytes()
        cut = [b[i : i + 50] for i in order.tolist()]
        assert all(x <= y for x, y in zip(cut, cut[1:]))
    assert len(suffix_dedup.suffix_order(r.integers(97, 123, 67000).astype(np.uint8), np.arange(67000) % 67 < 18)) < 22000


def test_a_long_run_of_one_byte_is_no_long_way():
    """A step of the scan for each byte of the run took 6 s for 200,000 bytes."""
    import time

    began = time.time()
    order = suffix_dedup.suffix_order(np.full(2_000_000, 113, np.uint8))
    assert time.time() - began < 20
    assert len(np.unique(order)) == 2_000_000 and set(order[:49].tolist()) == set(range(1_999_951, 2_000_000))


def brute_bytes(rows):
    first = {}
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for i, raw in texts:
        for p in range(len(raw) - 49):
            g = raw[p : p + 50]
            if g not in first or key(i) < key(first[g]):
                first[g] = i
    out = []
    for i, raw in texts:
        mark = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if key(first[raw[p : p + 50]]) < key(i):
                mark[p : p + 50] = True
        kept = np.frombuffer(raw, np.uint8)[~mark].tobytes()
        out.append((i, len(raw), int(mark.sum()), len(suffix_dedup._runs(mark)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: [(x is None, str(x)) for x in r])


def test_suffix_dedup(spark, messy, messy_rows, empty, save):
    path = save(documents=messy)
    assert rows_of(suffix_dedup.op4_suffix_dedup(spark, path), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(messy_rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeats(messy).count() == len(messy_rows)


def test_suffix_dedup_hot_keys_and_small_batches(spark, messy, messy_rows, save, monkeypatch):
    from folioscope.llm import windows

    monkeypatch.setattr(windows, "BATCH_BYTES", 2000)
    monkeypatch.setattr(windows, "BUCKET_KEYS", 100)
    monkeypatch.setattr(windows, "HOT", 1)
    path = save(documents=messy)
    assert rows_of(suffix_dedup.op4_suffix_dedup(spark, path), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(messy_rows)
    assert rows_of(automaton_dedup.op6_automaton_dedup(spark, path), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(messy_rows)


def test_structured_texts_are_not_taken_for_each_other(spark, save):
    """Thue-Morse stretches, whose polynomial hashes modulo 2**64 are equal, beside real copies of each."""
    morse = np.array([bin(i).count("1") % 2 for i in range(2048)])
    a, b = ("".join("ab"[x ^ y] for x in morse.tolist()) for y in (0, 1))
    rows = [(1, a), (2, b), (3, prose(50, 40) + a[:700]), (4, prose(51, 40) + b[:700]), (5, "q" * 400)]
    path = save(documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(suffix_dedup.op4_suffix_dedup(spark, path), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows)


# --- suffix automaton


def brute_words(rows):
    seen = Counter()
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for _, w in texts:
        for p in range(len(w) - 34):
            seen[tuple(w[p : p + 35])] += 1
    out = []
    for i, w in texts:
        mark = np.zeros(len(w), bool)
        for p in range(len(w) - 34):
            if seen[tuple(w[p : p + 35])] > 1:
                mark[p : p + 35] = True
        out.append((i, len(w), int(mark.sum()), hashlib.sha256(b" ".join(x for x, m in zip(w, mark) if not m)).hexdigest()))
    return sorted(out, key=lambda r: [(x is None, str(x)) for x in r])


def test_automaton_dedup(spark, messy, messy_rows, empty, save):
    path = save(documents=messy)
    assert rows_of(automaton_dedup.op6_automaton_dedup(spark, path), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(messy_rows)
    assert automaton_dedup.remove_repeats(empty).count() == 0


def test_matching_statistics():
    r = random.Random(4)
    for _ in range(50):
        seqs = [[r.randrange(3) for _ in range(r.randrange(1, 25))] for _ in range(4)]
        times = [r.choice([1, 1, 2]) for _ in seqs]
        a = automaton_dedup.SuffixAutomaton()
        for s, t in zip(seqs, times):
            a.add(s, t)
        a.settle()
        count = Counter()
        for s, t in zip(seqs, times):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    count[tuple(s[i:j])] += t
        for s in seqs:
            want = [max([n for n in range(1, e + 2) if count[tuple(s[e - n + 1 : e + 1])] >= 2] or [0]) for e in range(len(s))]
            assert a.repeats(s) == want


# --- lines


def test_line_runs(spark, messy, empty):
    shared = "alpha one\nbeta two\ngamma three\ndelta four"
    rows = [(1, f"x1\n{shared}\ny1"), (2, f"x2\n{shared}\ny2"), (3, "beta two\ngamma three\nz"), (4, None), (5, ""), (6, "q\nq\nq\nq\nq"), (None, shared), (7, f"{shared}\r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit(1))
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got[1] == f"x1\n{shared}\ny1" and got[2] == "x2\ny2"
    assert got[3] == rows[2][1] and got[4] is None and got[5] == ""
    assert got[6] == "q"  # windows of three repeat from the second line on
    assert got[None] == "" and got[7] == ""
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    assert line_dedup.drop_repeated_lines(messy).columns == messy.columns


def test_repeated_rows_lose_the_same_lines(spark):
    text = "a a\nb b\nc c\nd d"
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (2, text)], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.drop_repeated_lines(docs).collect()) == ["", "", "", text]


def test_short_runs_with_many_words_and_whole_documents_go_too(spark, save):
    long, half, other = (" ".join(prose(n, k).split()) for n, k in ((31, 60), (32, 30), (33, 30)))
    rows = [(1, f"x1\n{long}\ny1"), (2, f"x2\n{long}\ny2"), (3, f"x3\n{half}\n{other}"), (4, f"{half}\n{other}\ny4"), (5, f"x5\n{half}\ny5"), (6, "one\ntwo"), (7, "one\ntwo\r"), (8, "one"), (9, f"{long}\n{long}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got == dict(rows) | {2: "x2\ny2", 4: "y4", 7: "", 9: ""}
    four = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs, 4).collect()}
    assert four == got
    query = {r.doc_id: r.n_removed for r in line_dedup.op5_line_runs(spark, save(documents=docs)).collect()}
    assert query == {i: 0 for i, _ in rows} | {2: 1, 4: 2, 7: 2, 9: 2}
    runs = {(r.doc_id, r.start, r.length) for r in line_dedup.removed_runs(docs).collect()}
    assert runs == {(2, 1, 1), (4, 0, 2), (7, 0, 2), (9, 0, 2)}


def brute_lines(rows):
    """Texts left by the rule: later copies of runs of three lines, or of 50 words, or of short whole documents. Every row
    is a document of its own; of equal ones any may be the first."""
    order = sorted((r[0] is None, r[0] or 0, r[1], i) for i, r in enumerate(rows) if r[1] is not None)
    seen, left = set(), {i: None for i in range(len(rows))}
    for _, _, text, i in order:
        lines, gone = [x.removesuffix("\r") for x in text.split("\n")], set()
        for p in range(len(lines)):
            for n in (1, 2, 3):
                run = tuple(lines[p : p + n])
                if len(run) == n and (n == 3 or sum(len(x.encode().split()) for x in run) >= 50):
                    gone |= set(range(p, p + n)) if run in seen else set()
                    seen.add(run)
        if len(lines) < 3:
            gone |= set(range(len(lines))) if ("whole", *lines) in seen else set()
            seen.add(("whole", *lines))
        left[i] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return Counter((r[0], left[i]) for i, r in enumerate(rows))


def test_copies_without_an_id_or_with_the_same_one(spark):
    six = "\n".join(f"line {c}" for c in "abcdef")
    rows = [(None, six)] * 3 + [(9, "p p\nq q"), (9, "p p\nq q"), (None, "one"), (None, "one"), (None, None), (None, None), (3, f"z\n{six}"), (3, f"z\n{six}"), (None, "")]
    for part in (rows, rows[:3], rows[:3] + [(5, six)], rows[3:7]):
        docs = spark.createDataFrame(part, "doc_id long, text string").withColumn("n", F.monotonically_increasing_id()).repartition(3)
        got = line_dedup.drop_repeated_lines(docs)
        assert Counter((r.doc_id, r.text) for r in got.collect()) == brute_lines(part)
        assert sorted(r.n for r in got.collect()) == sorted(r.n for r in docs.collect())
    assert sum(r.text == six for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()) == 1


def test_line_runs_by_brute_force_and_clashing_names(spark, messy, messy_rows):
    docs = messy.withColumn("drop", F.lit(1)).withColumn("did", F.lit(2)).withColumn("_fs_drop", F.lit(3))
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == brute_lines(messy_rows)


@pytest.mark.parametrize("least", [3, 7])
def test_repeated_runs_by_brute_force(spark, least):
    r = random.Random(least)
    block = [f"s{i}" for i in range(23)]
    texts = [[r.choice("abc") for _ in range(r.randrange(30))] + block[r.randrange(9) : r.randrange(9, 24)] + [f"u{d}"] for d in range(25)]
    texts += [block * 2, block * 2, ["a"] * 40, ["only", "here"]]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")

    def common(d, p, e, q):
        n = 0
        while p + n < len(texts[d]) and q + n < len(texts[e]) and texts[d][p + n] == texts[e][q + n]:
            n += 1
        return n

    texts = ["\n".join(t).split("\n") for t in texts]
    starts = [(d, p) for d, t in enumerate(texts) for p in range(len(t))]
    best = {s: max((common(*s, *e) for e in starts if e < s), default=0) for s in starts}
    runs = line_dedup.repeated_runs(docs, least).collect()
    covered = set()
    for x in runs:
        assert (x.first_doc_id, x.first_start) < (x.doc_id, x.start)
        assert x.length == common(x.doc_id, x.start, x.first_doc_id, x.first_start) >= least
        assert x.length <= best[x.doc_id, x.start] < 2 * x.length  # its source is first in the last interval
        covered |= {(x.doc_id, x.start + i) for i in range(x.length)}
    assert covered == {(d, p + i) for (d, p), n in best.items() if n >= least for i in range(n)}
    stretches = line_dedup.removed_runs(docs, least, None).collect()
    assert {(x.doc_id, x.start + i) for x in stretches for i in range(x.length)} == covered
    assert sum(x.length for x in stretches) == len(covered)
    assert all((x.doc_id, x.start + x.length) not in covered for x in stretches)


def test_one_line_many_times_in_a_row(spark):
    docs = spark.createDataFrame([(1, "\n" * 4999), (2, "\n" * 4999), (3, "a\n\nb")], "doc_id long, text string")
    got = line_dedup.drop_repeated_lines(docs).collect()
    assert {r.doc_id: r.text for r in got} == {1: "", 2: "", 3: "a\n\nb"}
    runs = {(r.doc_id, r.start, r.length) for r in line_dedup.removed_runs(docs).collect()}
    assert runs == {(1, 1, 4999), (2, 0, 5000)}


def test_very_long_texts_of_lines(spark):
    text = "\n".join(f"line {i}" for i in range(60000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, f"a\n{text}\nb")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()} == {1: text, 2: "", 3: "a\nb"}


def test_each_text_is_cut_into_lines_once(spark):
    rows = [(i, "\n".join(f"line {j}" for j in range(i % 5))) for i in range(20)] + [(None, None), (7, "line 0\nline 1")]
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        reads.add(1)
        return text

    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", seen.asNondeterministic()("text").alias("text"))
    runs = {(r.doc_id, r.start, r.length) for r in line_dedup.removed_runs(docs).collect()}
    assert runs == {(i, 0, max(1, i % 5)) for i in range(5, 20)} | {(4, 0, 3)}
    assert reads.value == len(rows)


def test_one_carriage_return_ends_a_line(spark):
    block, ends = ["alpha", "beta", "gamma"], ["", "\r", "\r\r", "\r\u2028", "\r\r"]
    rows = [(i, "\n".join([f"u{i}", *[x + end for x in block], f"v{i}"])) for i, end in enumerate(ends)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.drop_repeated_lines(docs)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == brute_lines(rows)
    assert {r.doc_id for r in line_dedup.removed_runs(docs).collect()} == {1, 4}


# --- toxicity


def toxic_corpus(n=240):
    r = random.Random(2)
    rows = []
    for i in range(n):
        body = prose(5000 + i, 90)
        bad = i % 4 == 0
        if bad:
            lines = body.split("\n")
            lines[r.randrange(len(lines))] += f" you {r.choice(['vilename', 'scumlike', 'idiotish'])} thing."
            body = "\n".join(lines)
        rows.append((i, body, int(bad)))
    return rows


def test_toxicity_learns_sentences_from_document_labels(spark, messy, messy_rows, empty, save):
    rows = toxic_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(out[r[0]].held_out for r in held)
    assert np.mean([out[r[0]].predicted == r[2] for r in held]) > 0.95
    hit = next(r for r in rows if r[2] and out[r[0]].spans)
    span = out[hit[0]].spans[0]
    assert any(w in hit[1][span.start : span.end] for w in ("vilename", "scumlike", "idiotish"))
    kept = toxicity.drop_toxic(messy, model)
    assert kept.columns == messy.columns
    scored = toxicity.score_toxicity(messy, model).collect()
    assert len(scored) == len(messy_rows) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score_toxicity(empty, model).count() == 0
    nothing = toxicity.train(empty, labels(spark))
    assert {r.predicted for r in toxicity.score_toxicity(messy, nothing).collect()} == {0}


def test_noisy_or_by_brute_force(spark, save):
    """The scores of the contract query by a plain reading of the model, words of any length, and the offending spans."""
    rows = [(i, re.sub("you (?:vilename|scumlike|idiotish) thing", "ox", t), y) for i, t, y in toxic_corpus()] + [(900, None, 0), (901, "", 0), (902, "One. ox! two ox; ox.\nno", 1)]
    path = save(documents=spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), labels=spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.op7_toxicity_mil(spark, path).collect()}
    model = toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    assert "ox" in model.weights and got[902].predicted == 1 and got[902].offending.startswith("4-7,")
    for i, text, _ in rows:
        none = 1.0
        for sentence in re.split(r"[.!?\n]", (text or "").lower()):
            words = set(re.sub(r"[^0-9a-z\s]", " ", sentence).split())
            if sentence.strip():
                z = model.bias + sum(model.weights.get(f, 0) for w in words for f in [w] + [f"{w[:k]}-" for k in (5, 6, 7) if len(w) > k])
                none *= 1 - 1 / (1 + math.exp(-z))
        assert got[i].score == pytest.approx(1 - none, abs=1e-9)
        assert got[i].predicted == int(1 - none >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_a_repeated_labelled_id_is_one_training_document(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    again = docs.union(docs.filter("doc_id < 20")).union(docs.filter("doc_id < 20"))
    assert toxicity.train(again, lab).weights == toxicity.train(docs, lab).weights
    y = np.array([r[2] for r in rows if not toxicity.held_out(r[0])])
    plain = toxicity.NoisyOr().fit([r[1] for r in rows if not toxicity.held_out(r[0])], y)
    assert plain.weights == pytest.approx(toxicity.train(docs, lab).weights)


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")

    def model(flip):
        lab = [(r[0], 1, 1 - r[2] if flip and toxicity.held_out(r[0]) else r[2]) for r in rows]
        return toxicity.train(docs, spark.createDataFrame(lab, "doc_id long, quality int, toxic int"))

    assert model(False).weights == model(True).weights


# --- string tiling


def brute_tiles(item, doc, least):
    mi, md, out = [False] * len(item), [False] * len(doc), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not mi[i + k] and not md[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in sorted(found):
            if not any(mi[i : i + best]) and not any(md[j : j + best]):
                mi[i : i + best] = [True] * best
                md[j : j + best] = [True] * best
                out.append((i, j, best))


def test_greedy_tiles():
    r = random.Random(6)
    for _ in range(60):
        a = [r.randrange(4) for _ in range(r.randrange(0, 30))]
        b = [r.randrange(4) for _ in range(r.randrange(0, 40))]
        assert decontaminate.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3) == brute_tiles(a, b, 3)


def test_decontamination_catches_reordered_passages(spark, messy, messy_rows, empty, save, monkeypatch):
    item = prose(77, 60)
    words = item.replace("\n", " ").split()
    moved = " ".join(words[30:] + words[:30])
    docs = messy.select("doc_id", "text").union(spark.createDataFrame([(500, prose(8, 100) + " " + moved.upper()), (501, " ".join(words[:20])), (502, item)], "doc_id long, text string"))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "a b"), (5, item)], "item_id long, text string")
    path = save(documents=docs, benchmark=bench)
    got = rows_of(decontaminate.op8_string_tiling(spark, path), "doc_id", "item_id")
    assert got == [(500, 1), (500, 5), (502, 1), (502, 5)]
    left = decontaminate.drop_contaminated(messy, bench)
    assert left.columns == messy.columns and left.count() == len(messy_rows)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (10,))
    assert len(list(decontaminate.blocks(bench))) > 1
    assert rows_of(decontaminate.op8_string_tiling(spark, path), "doc_id", "item_id") == got
    assert decontaminate.contaminated(empty, decontaminate.Items([(1, item)])).count() == 0


def test_matches_by_brute_force():
    """Pairs over the threshold by tiling every document with every item, short items and long repeats among them."""
    r = random.Random(12)
    word = lambda: r.choice("abcdefgh") * r.randrange(1, 3)
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 14, 20, 30, 12, 5])] + [(50, "x " * 200), (None, "q r s t u v")]
    block = decontaminate.Items(items)
    texts = [None, "", "x " * 3000, "u v q r s t u v"]
    for _ in range(80):
        parts = [word() for _ in range(r.randrange(0, 40))]
        for _ in range(r.randrange(3)):
            w = r.choice(items)[1].split()
            parts += w[len(w) // 2 :] + [word()] + w[: len(w) // 2] if r.random() < 0.5 else w
        texts.append(" ".join(parts))
    for t in texts:
        doc = (t or "").split()
        want = []
        for i, item in sorted(items, key=lambda x: (x[0] is None, x[0] or 0)):
            w = item.split()
            tiles = brute_tiles(w, doc, min(5, len(w))) if t != texts[2] or i == 50 else []
            if t == texts[2] and i == 50:
                tiles = [(0, 0, 200)]
            if sum(x[2] for x in tiles) * 2 >= len(w):
                want.append((i, tiles))
        assert [(m[0], m[2]) for m in block.matches(t)] == want


def test_short_items_stand_in_a_row(spark, save):
    docs = spark.createDataFrame([(1, "x Lone, pair y"), (2, "lone x pair"), (3, "solo"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "lone pair"), (8, "solo"), (8, "solo"), (None, "lone"), (9, "")], "item_id long, text string")
    got = decontaminate.op8_string_tiling(spark, save(documents=docs, benchmark=bench)).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(1, 0), (1, 7), (2, 0), (3, 8)]


# --- simhash


def brute_fingerprint(text):
    w = [x.lower() for x in (text or "").encode().split()]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def test_simhash_groups(spark, messy, messy_rows, empty, save):
    got = simhash.op9_simhash_vptree(spark, save(documents=messy)).collect()
    fps = [brute_fingerprint(r[1]) for r in messy_rows]
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {g: min((messy_rows[i][0] for i in range(len(fps)) if group[i] == g and messy_rows[i][0] is not None), default=None) for g in set(group)}
    want = sorted([(r[0], f"{fps[i]:016x}", least[group[i]]) for i, r in enumerate(messy_rows)], key=lambda r: [(x is None, str(x)) for x in r])
    assert sorted([tuple(r) for r in got], key=lambda r: [(x is None, str(x)) for x in r]) == want
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({x for x in least.values() if x is not None})
    assert simhash.near_groups(empty).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Rows are told apart by their texts, not by their doc_id; missing ids are grouped like others."""
    rows = [(3, "A a b", "x"), (7, "A a b", "x"), (7, "B c d", "x"), (9, "C e f", "x"), (None, "A a b", "x"), (None, "zz y x", "x"), (None, "zz y x", "x"), (9, "C e f", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([(3, "A a b"), (7, "B c d"), (9, "C e f"), (None, "zz y x")], key=str)


def test_vantage_point_tree_finds_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    near = [b ^ np.uint64((1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))) for b in base[:200]]
    ball = [base[0] ^ np.uint64(1 << i) for i in range(60)]
    points = np.unique(np.concatenate([base, np.array(near + ball, np.uint64)]))
    distinct = spark.createDataFrame(pd.DataFrame({"fp": points.view(np.int64)}))
    edges = simhash.linked_fingerprints(distinct, radius_points=64, sample=512)
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    want = list(range(len(points)))
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= 2):
            a, b = want[i], want[j]
            want = [min(a, b) if g in (a, b) else g for g in want]
    signed = points.view(np.int64).tolist()
    groups = defaultdict(list)
    for g, p in zip(want, signed):
        groups[g].append(p)
    assert got == {p: min(ps) for ps in groups.values() for p in ps if p != min(ps)}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1000, 1002), (5, 5)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000, 1002: 1000}


# --- licences


def test_licence_families(spark, messy, messy_rows, empty):
    model = licenses.fit([licenses.words_of(line) for i in range(40) for line in prose(i, 90).split("\n")])
    lines = {"mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "apache": "Licensed under the Apache License, Version 2.0.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    docs = spark.createDataFrame([(i, prose(i, 60) + "\n" + t) for i, t in enumerate(lines.values())] + [(9, prose(9, 60)), (10, None)], "doc_id long, text string")
    got = {r.doc_id: r.family for r in licenses.scan_licences(docs, model).collect()}
    assert [got[i] for i in range(4)] == list(lines) and got[9] is None and got[10] is None
    assert licenses.scan_licences(messy, model).filter("family IS NOT NULL").count() == 0
    assert licenses.scan_licences(messy, model).count() == len(messy_rows)
    assert licenses.scan_licences(empty, model).count() == 0


def test_licence_accuracy_on_varied_notices():
    filler = [w for i in range(30) for w in licenses.words_of(prose(i, 60))]
    model = licenses.fit([licenses.words_of(line) for i in range(40) for line in prose(i, 90).split("\n")])
    rng = random.Random(3)
    cases = [(f, v) for f, ts in licenses.TEMPLATES.items() for t in ts for v in licenses.variants(licenses.words_of(t), filler, rng, 12)]
    right = [(r := model.paragraph(v)) is not None and r[0] == f for f, v in cases]
    wrong = [(r := model.paragraph(v)) is not None and r[0] != f for f, v in cases]
    assert np.mean(right) > 0.75 and np.mean(wrong) < 0.05


def test_prose_that_speaks_of_licences_is_not_one(spark, save):
    model = licenses.fit([licenses.words_of(line) for i in range(40) for line in prose(i, 90).split("\n")])
    assert model.text("They talked about the MIT License debate under the Apache License version rules")[0] in (None, "unknown")
    filler = [w for i in range(30) for w in licenses.words_of(prose(i + 300, 60))]
    rng = random.Random(5)
    notices = [licenses.words_of(t) for ts in licenses.TEMPLATES.values() for t in ts]
    said = [v for t in notices for v in licenses.mentions(t, rng.choice(notices), filler, rng, 10)]
    assert np.mean([model.paragraph(v) is not None for v in said]) < 0.02


def test_families_outside_the_templates_are_not_taken_for_others(monkeypatch):
    lines = [licenses.words_of(line) for i in range(40) for line in prose(i, 90).split("\n")]
    templates = dict(licenses.TEMPLATES)
    wrong = 0
    for family in ("apache", "gpl", "lgpl", "cc-by", "cc-by-sa", "cc-by-nc"):
        monkeypatch.setattr(licenses, "TEMPLATES", {f: t for f, t in templates.items() if f != family})
        model = licenses.fit(lines, examples=30, epochs=40)
        wrong += sum(model.text(t)[0] not in (None, "unknown") for t in templates[family])
    assert wrong <= 1


def test_licence_query_by_plain_scoring(spark, save):
    """Probabilities of the contract query by a plain softmax over the model's weights."""
    rows = [(1, f"{prose(1, 30)}\nReleased under the MIT License.\n{prose(2, 30)}"), (2, prose(3, 60)), (3, None), (4, "Licensed under CC BY-NC 4.0."), (5, "x " * 20000)]
    path = save(documents=spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in licenses.op10_license_scan(spark, path).collect()}
    model = licenses.train(spark.read.parquet(f"{path}/documents.parquet"))
    assert {i: r.family for i, r in got.items()} == {1: "mit", 2: None, 3: None, 4: "cc-by-nc", 5: None}
    for i, line in ((1, "released under the mit license"), (4, "licensed under cc by nc 4 0")):
        w = line.encode().split()
        z = model.weights[()] + sum(model.weights.get(g, 0) for g in {(x,) for x in w} | set(zip(w, w[1:])))
        e = np.exp(z - z.max())
        assert got[i].confidence == pytest.approx((e / e.sum())[model.families.index(got[i].family)], abs=1e-6)


def wrap(notice, width):
    return "\n".join(textwrap.wrap(notice, width))


def test_licence_notices_wrapped_over_lines():
    model = licenses.fit([licenses.words_of(line) for i in range(40) for line in prose(i, 90).split("\n")])
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    assert model.text(f"{prose(1, 30)}\n{gpl}\n{prose(2, 30)}")[:2] == ("gpl", 1)
    assert model.text(f"{prose(1, 30)}\n\n# {bsd}")[:2] == ("bsd", 1)
    assert model.text(bsd)[4] == 0 and model.text(f"x\n\ny\n{bsd}")[4] == 3
    assert model.text(bsd.replace("\n", "\n\n"))[0] != "bsd"  # a blank line parts paragraphs
    cases = [(f, wrap(t, w)) for f, ts in licenses.TEMPLATES.items() for t in ts for w in (30, 45, 60, 75)]
    right = [model.text(f"{prose(i, 40)}\n{t}\n{prose(i + 500, 40)}")[0] == f for i, (f, t) in enumerate(cases)]
    assert np.mean(right) > 0.95
    assert {model.text(prose(i, 400))[0] for i in range(40)} == {None}


def test_licences_that_no_template_confirms_are_unknown(spark):
    model = licenses.fit([licenses.words_of(line) for i in range(40) for line in prose(i, 90).split("\n")])
    eclipse = "This work is licensed under the Eclipse Public License, version 2.0."
    altered = "Permission is granted free of charge to any person\nobtaining this software and its files."
    rows = [(1, f"{prose(1, 40)}\n{eclipse}"), (2, f"{altered}\n\n{prose(2, 40)}"), (3, prose(3, 40)), (4, f"{eclipse}\n\nLicensed under the MIT License."), (5, None), (6, f"{eclipse}\n\n{prose(4, 20)}\n\n{eclipse}")]
    got = {r.doc_id: r for r in licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i].family for i in range(1, 7)] == ["unknown", "unknown", None, "mit", None, "unknown"]
    assert [got[i].n_paragraphs for i in range(1, 7)] == [0, 0, 0, 1, 0, 0]
    assert [got[i].n_unknown for i in range(1, 7)] == [1, 1, 0, 1, 0, 2]
    assert got[1].line == rows[0][1].count("\n") and got[1].confidence > 0.5
    assert {model.text(prose(i, 400))[0] for i in range(40)} == {None}


def test_unlisted_licences_are_never_nothing(monkeypatch):
    """Notices of no family, also of names and wordings that no training text has; one word a line; prose that only shares words."""
    lines = [licenses.words_of(line) for i in range(40) for line in prose(i, 90).split("\n")]
    model = licenses.fit(lines)
    isc, zlib_, eclipse, wtfpl = (next(t for t in licenses.UNLISTED if t.startswith(x)) for x in ("Permission to use", "This software is provided", "This program and the accompanying", "Everyone"))
    spdx = ["SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: BSD-2-Clause"]
    unseen = ["Licensed under the European Space Agency Public License", "This software is released under the Python Software Foundation License"]
    for t in (isc, zlib_, eclipse, wtfpl, *spdx, *unseen):
        family, confirmed, p, _, line, n = model.text(f"{prose(1, 30)}\n\n{t}\n\n{prose(2, 30)}")
        assert (family, confirmed, n) == ("unknown", 0, 1) and p > 0.5 and line == prose(1, 30).count("\n") + 2
        assert model.text("\n".join(t.split()))[0] == "unknown" or t in spdx
    mit = licenses.TEMPLATES["mit"][2]
    assert model.text("\n".join(mit.split()))[:2] == ("mit", 1)
    for t in ("We played football in the public garden and the author of the book provided a copy", "The library published a notice about the following program"):
        assert model.text(t)[0] is None
    pairs = lambda w: set(zip(w, w[1:]))
    known = set().union(*[pairs(licenses.words_of(t)) for ts in licenses.TEMPLATES.values() for t in ts])
    every, rng, filler = list(licenses.UNLISTED), random.Random(3), [w for p in lines for w in p]
    found = wrong = n = 0
    for i, t in enumerate(every):  # each kind of notice left out of training in turn
        if "{}" in t:
            continue
        monkeypatch.setattr(licenses, "UNLISTED", every[:i] + every[i + 1 :])
        held = licenses.fit(lines, examples=30, epochs=40)
        got = [held.text(b" ".join(v).decode())[0] for v in licenses.variants(licenses.words_of(t), filler, rng, 6)]
        found, wrong, n = found + got.count("unknown"), wrong + sum(f not in ("unknown", None) for f in got), n + len(got)
    assert found > 0.4 * n and wrong == 0
    free = [t for t in every if "{}" not in t and not known & pairs(licenses.words_of(t))]
    assert free and all(model.text(t)[0] == "unknown" for t in free)  # share no pair with a template


def plain_scan(model, text):
    """All columns of a document by plain loops over the model's weights and the templates' word pairs."""
    lines = [licenses.words_of(x) for x in (text or "").split("\n")]

    def chance(w):
        z = model.weights[()] + sum((model.weights[g] for g in {(x,) for x in w} | set(zip(w, w[1:])) if g in model.weights), 0.0)
        e = np.exp(z - z.max())
        return e / e.sum()

    def share(w, f):
        have = set(zip(w, w[1:]))
        return max((len(have & set(zip(t, t[1:]))) / len(set(zip(t, t[1:]))) for t in map(licenses.words_of, licenses.TEMPLATES[f])), default=0.0)

    runs = []
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            if not lines[j] or sum(map(len, lines[i:j])) >= licenses.RUN_WORDS:
                break
            w = [x for line in lines[i : j + 1] for x in line]
            p = chance(w)
            k = int(p.argmax())
            f = model.families[k]
            if f in licenses.TEMPLATES and p[k] >= model.least[k] and model.confirms(set(zip(w, w[1:])), [f]):
                runs.append((-share(w, f), j - i, i, f, p[k]))
    taken, best = set(), []
    for o, more, i, f, p in sorted(runs):
        if taken.isdisjoint(range(i, i + more + 1)):
            taken |= set(range(i, i + more + 1))
            best.append((-round(p, 6), i, f, -o))
    if not best:
        return None
    p, i, f, o = min(best)
    return f, len(best), -p, round(o, 6), i


def test_confirmed_documents_by_plain_loops(spark, save):
    rng = random.Random(12)
    every = [t for ts in licenses.TEMPLATES.values() for t in ts] + [t.replace("{}", "Name") for t in licenses.UNLISTED]
    rows = []
    for i in range(60):
        parts = [prose(i * 9 + k, 12) if rng.random() < 0.4 else wrap(rng.choice(every), rng.choice([12, 40, 90])) for k in range(rng.randrange(0, 5))]
        rows.append((i, rng.choice(["\n", "\n\n"]).join(parts)))
    path = save(documents=spark.createDataFrame([*rows, (99, None)], "doc_id long, text string"))
    model = licenses.train(spark.read.parquet(f"{path}/documents.parquet"))
    got = {r.doc_id: r for r in licenses.op10_license_scan(spark, path).collect()}
    confirmed = 0
    for i, text in rows:
        r, want = got[i], plain_scan(model, text)
        if want is None:
            assert r.family in (None, "unknown") and r.n_paragraphs == 0 and (r.family is None) == (r.n_unknown == 0)
        else:
            confirmed += 1
            assert (r.family, r.n_paragraphs, r.line) == (want[0], want[1], want[4])
            assert r.confidence == pytest.approx(want[2], abs=2e-6) and r.overlap == pytest.approx(want[3], abs=2e-6)
    assert confirmed > 15 and sum(got[i].family == "unknown" for i, _ in rows) > 3 and got[99].family is None
