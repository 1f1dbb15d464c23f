"""Every query runs; those with SQL give the same rows as DuckDB; published scores follow from their own P and R."""

import glob
import math

import duckdb
import pytest

import __spark_entry__ as entry
from folioscope import plans
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(df):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if hasattr(v, "__float__") and not isinstance(v, str):
            return f"{float(v):.9g}"
        return str(v)

    return sorted([tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)])


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name not in plans.SQL:
        assert len(got.columns)
        return
    want = duck.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pages_in_other_scripts(spark, tmp_path):
    """Titles of other scripts are compared as they are: equal, one character off, or different."""
    pairs = [
        ("Анализ данных", "Совсем другое название", set()),
        ("数据分析方法", "完全不同的标题", set()),
        ("数据 分析方法", "数据分析方法", {"soft", "levenshtein"}),
        ("Анализ данных", "Анализ даннах", {"levenshtein"}),
        ("Анализ", "Анализ", {"strict", "soft", "levenshtein"}),
        ("Çalışma ölçümü", "calisma olcumu", {"soft", "levenshtein"}),
        ("", "x", set()),
    ]
    page = "<html><title>{1}</title><h1>{0}</h1><p>-</p></html>"
    rows = [(i, "http://x.y/z", page.format(*pair)) for i, pair in enumerate(pairs)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = plans.QUERIES["eval_prf_pages"](spark, str(tmp_path)).toPandas()
    matched = {r.mode: r.matched for r in got[got.field == "title"].itertuples()}
    assert matched == {m: sum(m in want for *_, want in pairs) for m in ("strict", "soft", "levenshtein")}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert canon(got) == canon(c.sql(plans.SQL["eval_prf_pages"]).df())


def test_f1_follows_from_precision_and_recall(spark):
    rows = [(29.00, 24.39, 26.50), (88.13, 67.80, 76.64), (61.38, 24.25, 34.77), (97.25, 95.38, 96.30)]
    for p, r, f in rows:
        assert 2 * p * r / (p + r) == pytest.approx(f, abs=0.011)


def test_incremental_runs_do_each_file_once(spark, tmp_path):
    from folioscope.streaming.incremental import run_available

    src, sink, mark = (str(tmp_path / x) for x in ("src", "sink", "mark"))
    spark.range(10).write.parquet(f"{src}/a")
    go = lambda: run_available(spark, f"{src}/*", "id long", lambda b: b.selectExpr("id * 2 AS id"), sink, mark)
    assert go() == 1 and go() == 0
    spark.range(10, 15).write.parquet(f"{src}/b")
    assert go() == 1
    assert spark.read.parquet(sink).count() == 15


def test_sources(spark, tmp_path):
    from folioscope.sources import readers, writers

    (tmp_path / "ids.txt").write_text("# comment\n12\n\nPMC3\n")
    assert sorted(r.id for r in readers.read_id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["12", "PMC3"]
    (tmp_path / "rows.csv").write_bytes("﻿id,score\n1,0.5\n2,\n".encode())
    rows = readers.read_csv(spark, str(tmp_path / "rows.csv"), "id string, score double").collect()
    assert [(r.id, r.score) for r in rows] == [("1", 0.5), ("2", None)]
    (tmp_path / "data.js").write_text('const rows = [{"a": 1}, {"a": 2}];\n')
    assert [x.a for x in readers.read_embedded_json(spark, str(tmp_path / "data.js"), "rows", "array<struct<a: int>>").first()["data"]] == [1, 2]
    (tmp_path / "m.bin").write_bytes(b"#mdl#2#15545\nrest")
    assert [(r.kind, r["count"]) for r in readers.read_model_headers(spark, str(tmp_path / "m.bin")).collect()] == [("2", "15545")]
    (tmp_path / "q_0.json").write_text('[{"id": 1}, {"id": 2}]')
    spark.dataSource.register(readers.RecordSource)
    got = spark.read.format("records").options(path=str(tmp_path), queries="q,none", pages="1").load()
    assert got.count() == 2
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k long, v string")
    assert {(r.k, r.v) for r in writers.upsert(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, None)}
    status = spark.createDataFrame([(1, "altin"), (2, "karantina")], "id long, status string")
    writers.route(status, str(tmp_path / "out"))
    assert len(glob.glob(str(tmp_path / "out" / "status=*"))) == 2


def test_altered_and_short_passages_are_located(spark, tmp_path):
    words = [f"{a}{b}{c}n" for a in "bdfgk" for b in "aeiou" for c in "lrst"]
    item = words[:30]
    altered = [f"x{w}" if i % 6 == 5 else w for i, w in enumerate(item)]
    docs = [(1, " ".join(words[40:60] + item)), (2, " ".join(words[40:60] + altered).upper()), (3, " ".join(words[40:])), (4, "a lone pair of words")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    bench = [(7, " ".join(item)), (8, "lone pair"), (9, "lone"), (10, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r.item_id, r.doc_id) for r in run("leakage_intersection")) == [(7, 1), (8, 4), (9, 4)]
    assert {(r.item_id, r.doc_id) for r in run("find_spans") if r.start is not None} >= {(7, 1), (7, 2)}
    assert {(r.item_id, r.doc_id) for r in run("subsequence_match") if r["first"] is not None} >= {(7, 1), (7, 2), (8, 4), (9, 4)}
    swept = run("span_threshold_sweep")[0]
    assert swept.at_45_34 == 0 and swept.n >= swept.at_15_20
    assert run("leakage_intersection")


def _altered(words, share):
    return [f"qq{i}qq" if i % 10 < share else w for i, w in enumerate(words)]


def test_no_pair_within_reach_is_left_out(spark):
    """Every step of the sweep and the verbatim case against all pairs of sf0.01, measured one by one."""
    from pyspark.sql import functions as F

    from folioscope.operators import spans as p
    from folioscope.operators.containment import containment_candidates
    from folioscope.plans import spans

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    items = {r.item_id: " ".join(_altered(r.text.split(), r.item_id % 10)) for r in rows} | {1000 + r.item_id: r.text for r in rows}
    docs = {r.doc_id: p.Canvas((r.text or "").replace("\n", " <lb/>")).keys for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    words = b.select("item_id", spans._hashes(spans.passage_keys(F.col("text"))).alias("words"))
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", spans._hashes(spans.document_keys(F.col("text"))).alias("words"))
    found = {}
    for c, dens in sorted(spans.STEPS)[:1] + [p.REACH]:
        pairs = containment_candidates(words, "item_id", d, "doc_id", c, dens)
        found[c, dens] = {tuple(r) for r in pairs.collect()}
    for step in spans.STEPS:
        found.setdefault(step, found[0.15, 0.20])
    reached = dict.fromkeys(found, 0)
    for i, text in items.items():
        target = p.target_words(text)
        own = set(target)
        for k, keys in docs.items():
            if sum(w in own for w in keys) < 0.15 * len(target):  # not even by count
                continue
            hit = p.locate(keys, target)
            for step, pairs in found.items():
                if hit and hit.reaches(*step):
                    reached[step] += 1
                    assert (i, k) in pairs, (i, k, step)
    assert all(reached.values()) and reached[0.15, 0.20] > 2 * reached[0.45, 0.34]
    assert len(found[p.REACH]) < 0.02 * len(items) * len(docs)


def test_candidates_are_those_of_the_bound(spark):
    """Exactly the documents in which `meet` of the first words stand close enough, on random words with repeats."""
    import math
    import random

    from folioscope.operators.containment import containment_candidates

    rng = random.Random(3)
    draw = lambda n: [rng.randrange(12) for _ in range(n)]
    docs = {i: draw(rng.choice([0, 1, 4, 9, 40])) for i in range(80)}
    items = {i: draw(n) for i, n in enumerate([1, 2, 3, 5, 8, 12, 20, 3, 2])} | {50: []}
    frame = lambda x, k: spark.createDataFrame([(a, b) for a, b in x.items()], f"{k} long, words array<long>")
    known = {w for v in items.values() for w in v}
    used = {w: sum(v.count(w) for v in docs.values()) for w in known}
    for coverage, density, meet in [(0.45, 0.34, 3), (0.15, 0.2, 2), (1.0, 1.0, 1), (0.6, 0.5, 4)]:
        want = set()
        for i, v in items.items():
            n = len(v)
            need = max(1, math.ceil(coverage * n - 1e-9))
            least = min(meet, need)
            first = set(sorted(v, key=lambda w: (used[w], w))[: n - need + least])
            for k, ws in docs.items():
                at = [x for x, w in enumerate(ws) if w in first]
                if any(b - a < math.floor(n / density + 1e-9) for a, b in zip(at, at[least - 1 :], strict=False)):
                    wide = max(1, math.ceil(n / density))
                    both = [ws[x * wide : (x + 2) * wide] for x in range(-1, len(ws) // wide + 1)]
                    both[0] = ws[:wide]
                    if any(sum(min(p.count(w), v.count(w)) for w in set(v)) >= need for p in both):
                        want.add((i, k))
        got = [tuple(r) for r in containment_candidates(frame(items, "item_id"), "item_id", frame(docs, "doc_id"), "doc_id", coverage, density, meet).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_verbatim_passages_of_any_length(spark):
    import random

    from folioscope.operators.containment import verbatim

    rng = random.Random(6)
    text = lambda n: "".join(rng.choice(["ab", "a", "b", " ", "\n", "ç", "😀"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 2, 5, 30, 60]))) for i in range(70)] + [(99, None)]
    items = [(i, text(n)) for i, n in enumerate([0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 8, 12, 9, 7])] + [(50, None), (51, " "), (52, "a  b"), (53, "ab a b")]
    items += [(60 + i, t[3:20]) for i, (_, t) in enumerate(docs) if t and len(t) > 30]
    frame = lambda x, k: spark.createDataFrame(x, f"{k} long, text string")
    got = [tuple(r) for r in verbatim(frame(items, "item_id"), "item_id", "text", frame(docs, "doc_id"), "doc_id", "text").collect()]
    assert sorted(got) == sorted((i, k) for i, b in items for k, t in docs if b is not None and t is not None and b in t)


def test_every_source_reads_what_was_written(spark, tmp_path):
    from folioscope.sources import readers, writers

    gold = spark.createDataFrame([("1", "Baslik", "Tam"), ("2", "", "Eksik:baslik"), ("3", None, "Eksik:baslik")], "id string, gercek_baslik string, durum string")
    gold.write.parquet(str(tmp_path / "gold"))
    assert [r.id for r in readers.read_table(spark, str(tmp_path / "gold"), ["id"], "gercek_baslik").collect()] == ["1"]
    full = readers.align_schema(gold)
    assert full.columns == list(readers.GOLD_FIELDS) and {r.gercek_doi for r in full.collect()} == {""}
    wanted = spark.createDataFrame([("1",), ("9",), ("9",)], "id string")
    assert {(r.id, r.durum) for r in readers.lookup(gold, wanted, "id").collect()} == {("1", "Tam"), ("9", None)}
    (tmp_path / "old.json").write_text('{"title": "T", "authors": ["A"], "year": "2019"}')
    (tmp_path / "new.json").write_text('{"titles": ["T", "U"], "abstract": " ", "found": true}')
    records = readers.gold_alternatives(readers.read_json_documents(spark, str(tmp_path / "*.json"))).collect()
    assert sorted(r.titles for r in records) == [["T"], ["T", "U"]] and all(r.abstracts == [] for r in records)
    (tmp_path / "tei").mkdir()
    (tmp_path / "tei" / "makale_12.xml").write_text("<TEI>\nx</TEI>")
    assert [tuple(r) for r in readers.read_markup(spark, str(tmp_path / "tei")).collect()] == [("12", "<TEI>\nx</TEI>")]
    (tmp_path / "f.txt").write_text("tok " + " ".join(f"f{i}" for i in range(12)) + "\nshort f1\n\n")
    assert [(r.token, len(r.features)) for r in readers.read_features(spark, str(tmp_path / "f.txt")).collect()] == [("tok", 13)]
    assert [(r.path.rsplit("/", 1)[-1], r.length) for r in readers.list_store(spark, str(tmp_path / "tei"), "*.xml").collect()] == [("makale_12.xml", 13)]
    writers.write_csv(gold, str(tmp_path / "csv"))
    back = readers.read_csv(spark, str(tmp_path / "csv"), "id string, gercek_baslik string, durum string")
    assert {(r.id, r.durum) for r in back.collect()} == {(r.id, r.durum) for r in gold.collect()}
    writers.write_partitioned(gold, str(tmp_path / "by"), "durum")
    assert spark.read.parquet(str(tmp_path / "by")).filter("durum = 'Tam'").count() == 1
    writers.write_normalised_lines(spark.createDataFrame([("a\r\nb",)], "t string"), "t", str(tmp_path / "lf"))
    assert b"\r" not in b"".join(p.read_bytes() for p in (tmp_path / "lf").glob("part-*"))
    assert spark.read.parquet(writers.publish(gold, str(tmp_path / "v"), "3")).count() == 3


def test_record_pages_of_a_store(spark, tmp_path):
    from folioscope.sources import readers

    for page in (0, 1, 3):
        (tmp_path / f"q_{page}.json").write_text(f'[{{"id": {page}}}]')
    spark.dataSource.register(readers.RecordSource)
    read = lambda pages: spark.read.format("records").options(path=f"file://{tmp_path}", queries="q,none", pages=pages).load()
    assert sorted(r.value for r in read("3").collect()) == ['{"id": 0}', '{"id": 1}']
    with pytest.raises(Exception, match="page 2 of query q is missing"):
        read("4").collect()


def test_a_table_is_installed_and_the_old_one_kept(spark, tmp_path):
    from folioscope.sources import writers

    path = str(tmp_path / "t")
    for n in (1, 2, 3):
        writers.install(spark.range(n), path)
    assert spark.read.parquet(path).count() == 3 and spark.read.parquet(path + ".backup").count() == 2


def test_results_are_computed_once(spark, tmp_path):
    from folioscope.streaming.incremental import cached

    seen = spark.sparkContext.accumulator(0)

    def compute(todo):
        seen.add(todo.count())
        return todo.selectExpr("id", "id * 2 AS twice")

    path = str(tmp_path / "cache")
    assert cached(spark.range(5), "id", compute, path).count() == 5
    got = {r.id: r.twice for r in cached(spark.range(3, 8), "id", compute, path).collect()}
    assert got == {i: 2 * i for i in range(3, 8)} and seen.value == 8
    assert cached(spark.range(8), "id", compute, path).count() == 8 and seen.value == 8


def test_collection_stops_at_the_target(spark):
    from folioscope.streaming.incremental import collect_until, remaining

    rows = spark.createDataFrame([(i, "ok" if i % 3 == 0 else "bad" if i % 3 == 1 else "none") for i in range(20)], "id int, s string")
    hits, counts = collect_until(rows, "s", "ok", 3, ["id"])
    assert sorted(r.id for r in hits.collect()) == [0, 3, 6] and dict(counts.collect()) == {"ok": 3, "bad": 2, "none": 2}
    assert dict(collect_until(rows, "s", "ok", 50, ["id"])[1].collect()) == {"ok": 7, "bad": 7, "none": 6}
    assert remaining(rows, rows.filter("id > 2"), "id").count() == 3


def test_reports_as_lines(spark):
    from folioscope.operators.reports import read_reports  # noqa: F401
    from folioscope.sources import writers

    cols = "id int, tier string, produced boolean, title_ok boolean, title_sim double, merged boolean, recall double, precision double, f1 double, strict_f1 double, authors_ok boolean, abstract_sim double"
    rows = spark.createDataFrame([(1, "zor", True, True, 0.9, False, 1.0, 1.0, 1.0, 0.5, True, 0.8), (2, "zor", True, False, 0.3, True, 0.0, 0.5, 0.0, 0.0, False, None), (3, "orta", False, False, 0.0, False, None, None, None, None, None, 0.4)], cols)
    before = spark.createDataFrame([(1, False, True), (2, True, True)], "id int, title_ok boolean, authors_ok boolean")
    lines = [r.line for r in writers.text_report(rows, ["tier"], before).orderBy("part", "place").collect()]
    assert lines[0] == "cikti uretti: 2/3" and lines[1].split() == ["TOPLAM", "3", "1", "33%", "0.400"]
    assert lines[2].split() == ["tier", "zor", "2", "1", "50%", "0.600"] and lines[3].split()[1] == "orta"
    assert "recall=0.500  precision=0.750  F1=0.500  siki_F1=0.250  cozulen=1/3  hic yazar yok=1" in lines[5]
    assert lines[6] == "  ort_sim=0.600  >=0.70: 1/2" and sorted(x.split()[1] for x in lines[7:]) == ["both_solved:", "broken:", "broken:", "fixed:"]
    docs = spark.createDataFrame([(7, "a", ["x", "y"]), (3, None, ["y", "y"])], "id int, title string, flags array<string>")
    text = [r.line for r in writers.inventory(docs, "id", "flags", ["title"]).orderBy("part", "place").collect()]
    assert text == ["### x (1): `7`", "### y (2): `3` `7`", "| id | title | labels |", "|---|---|---|", "| 3 |  | y;y |", "| 7 | a | x;y |", "- `y` — 2", "- `x` — 1", "1 flag: 1", "2 flag: 1"]
