"""Worked cases of the functions: hand-computed values, Turkish letters, empty and null inputs."""

import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import greedy
from folioscope.functions import normalize as n
from folioscope.functions import rules as r
from folioscope.functions import similarity as s
from folioscope.operators import distance as d
from folioscope.operators import segments as g
from folioscope.operators import sets as o
from folioscope.operators import spans as p


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,fold,want",
    [("Şule PEKUZ", True, "sulepekuz"), ("Sule Pekuz", True, "sulepekuz"), ("ISPARTA İLİ", True, "ispartaili"), ("ısparta ili", True, "ispartaili"), ("ISPARTA İLİ", False, "ıspartaili"), ("", True, ""), (None, True, None)],
)
def test_soft(spark, text, fold, want):
    assert value(spark, text, lambda c: n.soft_norm(c, fold)) == want


def test_composition(spark):
    assert value(spark, "café", lambda c: n.soft_norm(c, compose=True)) == "café"
    assert value(spark, "Éa ŞÜ ﬁn", n.score_norm) == "ea su fin"


def test_lists_have_no_order(spark):
    assert value(spark, "Yılmaz Ömer; Şule Pekuz", lambda c: n.list_norm(c, True)) == value(spark, "Sule Pekuz, Yilmaz Omer", lambda c: n.list_norm(c, True)) == "sulepekuz yilmazomer"


def test_repairs(spark):
    assert value(spark, "KARINCAO⁄LU", n.norm_word) == "karincaoglu"
    assert value(spark, "kiĢinin", n.mojibake_fix) == "kişinin" and value(spark, "kiĢiĢ", n.mojibake_count) == 2
    assert value(spark, "bütünlü-<lb/>ğünün", n.join_hyphens) == "bütünlüğünün"
    assert value(spark, "https://doi.org/10.1/ABC ", n.clean_doi) == "10.1/abc"
    assert value(spark, "IV. Giriş", n.heading_norm) == "giriş"
    assert value(spark, "a<b>c</b><lb/>d", n.strip_tags) == "ac<lb/>d"
    assert value(spark, "vol 12, 2019.", n.year_of) == "2019" and value(spark, "12019", n.year_of) == ""


@pytest.mark.parametrize("a,b,ratio,match", [("kitten", "sitting", 1 - 3 / 7, False), ("abcdefghij", "abcdefghxx", 0.8, True), ("", "", 1.0, True), ("abc", "", 0.0, False), ("çğş", "cgs", 0.0, False)])
def test_levenshtein(spark, a, b, ratio, match):
    x = spark.createDataFrame([(a, b)], "a string, b string").select(s.levenshtein_ratio(F.col("a"), F.col("b")), s.levenshtein_match(F.col("a"), F.col("b"))).first()
    assert x[0] == pytest.approx(ratio) and x[1] is match


def test_longest_match_keeps_the_order_of_arguments(spark):
    x = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string").select(s.longest_match_ratio("a", "b").alias("r")).collect()
    assert [round(v.r, 2) for v in x] == [0.25, 0.5]
    pairs = [("a" * 30 + "b", "a" * 30 + "c"), ("abc", "abd"), ("", "x")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", s.longest_match("a", "b").alias("m")).collect()
    assert {(v.a, v.b): v.m for v in got} == {k: bool(k[0]) and difflib.SequenceMatcher(None, *k, autojunk=False).ratio() >= 0.95 for k in pairs}


def test_token_metric_rules_for_missing(spark):
    rows = [("alpha beta", "alpha gamma", 50.0, 50.0), ("", "alpha", 0.0, 0.0), ("alpha", "", None, None), (None, None, None, None)]
    for a, b, recall, precision in rows:
        x = spark.createDataFrame([(a, b)], "a string, b string").select(s.token_recall_precision(F.col("a"), F.col("b")).alias("x")).first()["x"]
        assert (x.recall, x.precision) == (recall, precision)


def test_severity_cases(spark):
    cols = "chars double, letters double, replaced double, anomalies double, body double, title double, abstract double, authors double, crash boolean, flags array<string>"
    rows = [
        (2000.0, 80.0, 0.0, 0.0, 9000.0, 1.0, 1.0, 1.0, False, []),
        (50.0, 5.0, 0.0, 0.0, 0.0, None, None, None, False, ["a", "b"]),
        (2000.0, 50.0, 3.0, 4.0, 400.0, 0.5, None, 0.5, False, ["a", "b", "c"]),
        (2000.0, 80.0, 0.0, 0.0, 0.0, 0.1, 0.1, 0.1, True, ["a"]),
    ]
    c = [F.col(x.split()[0]) for x in cols.split(", ")]
    score = spark.createDataFrame(rows, cols).select(r.severity(*c).alias("s"))
    got = [(x.s, x.b) for x in score.select("s", r.severity_band(F.col("s")).alias("b")).collect()]
    assert got == [(0, "hafif"), (49, "orta"), (66, "agir"), (28, "orta")]


def test_find_span_case():
    page = p.Canvas("dergi turk gelir dagilimi uzerine bir analiz yazar")
    hit = p.locate(page.keys, p.target_words("gelir dagilimi uzerine analiz"))
    assert hit.places == [2, 3, 4, 6] and hit.coverage == 1.0 and hit.density == 0.8
    assert hit.reaches(0.45, 0.34) and not hit.reaches(0.45, 0.9)
    assert p.locate(page.keys, ["tek"]) is None and p.locate(page.keys, ["hic", "yok"]) is None
    assert [page.word_at(i) for i in (0, 1, 6, 999)] == [0, 1, 1, len(page.words)]


def test_words_cut_at_line_ends_and_places_in_breaks():
    page = p.Canvas("Bir dene- <lb/>me <lb/>son-")
    assert page.words == [("bir", 0, 3), ("deneme", 4, 17), ("son", 23, 27)]
    assert [page.off_break(i) for i in (9, 10, 11, 14, 15, 16)] == [9, 10, 15, 15, 15, 16]
    assert page.lines == [(0, 10), (15, 18), (23, 27)]


FRONT = " <lb/>".join([
    "Türk Dergisi Cilt 12 Sayı 3", "Bitkisel Üretimde Verim ve", "Kalite Üzerine Bir Araştırma", "Ayşe YILMAZ, Mehmet Öztürk", ", Dr. Ali Kaya", "Ankara Üniversitesi Ziraat Fakültesi", "Ankara", "Geliş Tarihi: 12.03.2019",
    "ÖZET: Bu çalışmada bitkisel üretimde verim ve kalite incelenmiş ve sonuçlar tartışılmıştır.", "Anahtar Kelimeler:", "verim, kalite", "Abstract: In this study yield and quality of crops were examined in the field.", "Keywords: yield, quality, crops", "10.1234/tarim.567",
])


def test_shapes_of_a_front_page():
    page = p.Canvas(FRONT)
    got = {f: page.text[s:e].replace(" <lb/>", "|").strip(" |") for f, (s, e) in p.label_by_shape(page).items()}
    assert got["title"] == "Bitkisel Üretimde Verim ve|Kalite Üzerine Bir Araştırma"
    assert got["author"] == "Ayşe YILMAZ, Mehmet Öztürk|, Dr. Ali Kaya"
    assert got["affiliation"].startswith("Ankara Üniversitesi Ziraat Fakültesi|Ankara")
    assert got["reference"] == "Türk Dergisi Cilt 12 Sayı 3"
    assert got["abstract_tr"].startswith("Bu çalışmada") and got["abstract_tr"].endswith("tartışılmıştır.")
    assert got["abstract_en"].startswith("In this study") and got["abstract_en"].endswith("field.")
    assert got["keyword_tr"] == "verim, kalite" and got["keyword_en"] == "yield, quality, crops"
    assert got["doi"] == "10.1234/tarim.567" and got["date"] == "12.03.2019"
    assert not p.of_authors("BİTKİSEL ÜRETİMDE VERİM") and not p.of_authors("Sorumlu yazar: Ayşe YILMAZ")


def test_an_abstract_without_a_heading():
    body = "uzun bir metin " * 12
    text = " <lb/>".join(["Ayşe YILMAZ, Mehmet Öztürk", "Ankara Üniversitesi", "Received: 1 May 2019", body, "Anahtar Kelimeler: a, b, c"])
    page = p.Canvas(text)
    s, e = p.label_by_shape(page)["abstract_tr"]
    assert page.text[s:e].replace("<lb/>", "").strip().endswith(body.strip())
    assert "abstract_tr" not in p.label_by_shape(p.Canvas(text.replace(body, "kısa bir metin")))


def test_author_spans_are_trimmed_to_lines_with_names():
    lines = ["Ayşe Yılmaz", "ORCID 0000", "Ankara", "Mehmet Kaya", "Ege Üniversitesi", "Ali Demir", "son satır"]
    page = p.Canvas(" <lb/>".join(lines))
    at = lambda w: page.keys.index(p.word_key(w))
    everything = (0, len(page.text))
    cut = lambda places: p.trim_to_names(page, everything, places)
    text = lambda x: page.text[x[0] : x[1]].replace(" <lb/>", "|").strip()
    assert text(cut([at("Ayşe"), at("Mehmet")])) == "Ayşe Yılmaz|ORCID 0000|Ankara|Mehmet Kaya"
    assert text(cut([at("Ayşe"), at("Ali")])) == "Ayşe Yılmaz|ORCID 0000|Ankara|Mehmet Kaya"  # before the institution
    assert text(cut([at("Mehmet")])) == "Mehmet Kaya" and cut([]) is None


def test_known_values_are_labelled(spark):
    meta = p.known(
        title=F.lit("Bitkisel Üretimde Verim ve Kalite Üzerine Bir Araştırma"), title_en=F.lit("A Study of Yield and Quality in Crops"), authors=F.lit("Ayşe Yılmaz; Mehmet Öztürk; Ali Kaya"),
        abstract=F.lit("Bu çalışmada bitkisel üretimde verim ve kalite incelenmiş ve sonuçlar tartışılmıştır."), keywords=F.lit("verim; kalite"), journal=F.lit("Türk Dergisi"), doi=F.lit("10.1234/tarim.567"), year=F.lit("2019"),
    )
    df = spark.createDataFrame([(FRONT,), (None,), ("",)], "c string").select("c", p.label("c", meta).alias("s"))
    rows = df.collect()
    got = {x.field: (FRONT[x.start : x.end].replace(" <lb/>", "|"), x.source) for x in rows[0].s}
    assert got["title"] == ("Bitkisel Üretimde Verim ve|Kalite Üzerine Bir Araştırma", "known")
    assert got["author"][1] == "known" and got["author"][0].startswith("Ayşe YILMAZ")
    assert got["doi"] == ("10.1234/tarim.567", "known") and got["date"] == ("2019", "known") and got["affiliation"][1] == "shape" and "abstract_en" not in got
    assert rows[1].s == [] and rows[2].s == []
    intact = df.select((p.strip_spans(p.apply_spans(F.col("c"), F.col("s"))) == F.col("c")).alias("x")).first().x
    gated = df.select(p.gate(F.col("s"), F.lit(1.0), F.lit(True)).alias("a"), p.gate(F.col("s"), F.lit(0.1), F.lit(True)).alias("b"), p.gate(F.col("s"), F.lit(1.0), F.lit(False)).alias("c")).first()
    assert intact and tuple(gated) == ("gold", "wrong-author", "text-changed")


def test_a_title_in_the_other_language_is_moved():
    page = p.Canvas("A Study of Yield and Quality <lb/>rest")
    spans = {"title": (0, 28, "shape"), "author": (30, 34, "shape")}
    meta = {"title": "Verim ve Kalite", "title_en": "A study of yield and quality in crops"}
    assert p.in_own_language(page, spans, meta) == {"title_en": (0, 28, "shape"), "author": (30, 34, "shape")}
    assert p.in_own_language(page, {"title": (0, 28, "known")}, meta) == {"title": (0, 28, "known")}
    assert p.in_own_language(page, spans, meta | {"title": "A study of yield and quality in crops"}) == spans


def test_altered_values_are_measured_as_by_difflib(spark):
    """Thresholds on measured spans against a loop of its own over difflib."""
    import difflib
    import random

    r = random.Random(4)
    words = [f"{a}{b}{c}n" for a in "bdfgk" for b in "aeiou" for c in "lrst"]
    rows = []
    for i in range(40):
        canvas = [r.choice(words) for _ in range(60)]
        value = [f"qq{j}" if r.random() < i / 45 else w for j, w in enumerate(canvas[10:40])]
        rows.append((i, " ".join(canvas[:20]) + "- <lb/>" + " ".join(canvas[20:]), " ".join(value)))
    got = {x.i: x.x for x in spark.createDataFrame(rows, "i int, c string, v string").select("i", p.measure_span("c", "v").alias("x")).collect()}
    kept = []
    for i, canvas, value in rows:
        a, b = value.split(), canvas.replace("- <lb/>", "").split()
        m = [x for x in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks() if x.size]
        size, width = sum(x.size for x in m), m[-1].b + m[-1].size - m[0].b
        assert got[i].matched == size and got[i].coverage == size / len(a) and got[i].density == size / width
        assert got[i].places == [x.b + k for x in m for k in range(x.size)]
        kept.append([size / len(a) >= c and size / width >= d for c, d in ((0.45, 0.34), (0.45, 0.2), (0.35, 0.2), (0.25, 0.2), (0.15, 0.2))])
    n = np.sum(kept, axis=0)
    assert n[0] <= n[1] < n[2] < n[3] < n[4]


def test_resolve_case():
    got = p.settle([(10, 40, "title"), (30, 80, "author"), (35, 38, "affiliation"), (0, 100, "reference")])
    assert got == [(10, 40, "title"), (40, 80, "author"), (80, 100, "reference")]


def test_applied_spans_leave_the_canvas(spark):
    canvas = "Başlık burada <lb/>Ahmet 😀 Yılmaz <lb/>metin"
    spans = [(0, 13, "title", "x"), (19, 33, "author", "x")]
    df = spark.createDataFrame([(canvas, spans)], "c string, s array<struct<start:int,end:int,field:string,source:string>>")
    x = df.select(p.apply_spans(F.col("c"), F.col("s")).alias("t")).select("t", p.strip_spans(F.col("t")).alias("u")).first()
    assert x.u == canvas and x.t.startswith("<title>Başlık burada</title>")


def test_zones_join_to_the_text(spark):
    text = "Title\nname\n1. GİRİŞ\nbody\nKaynakça\n[1] x"
    df = spark.createDataFrame([(1, text), (2, "a\nb\nc\nd"), (3, "")], "id long, text string")
    z = df.join(g.zones(df, "id", "text"), "id").select("id", "text", "front_end", "references_start", g.zone_text(F.col("text"), F.col("front_end"), F.col("references_start")).alias("z")).collect()
    one = next(x for x in z if x.id == 1)
    assert (one.front_end, one.references_start) == (2, 4) and one.z.body == "1. GİRİŞ\nbody"
    for x in z:
        assert "\n".join(v for v in (x.z.front, x.z.body, x.z.references) if v) == x.text


def test_one_to_one_references():
    assert [(i, j) for i, j, _ in p.greedy_pairs(["alpha beta", "alpha beta c"], ["alpha beta", "zzz"])] == [(0, 0)]
    assert [(i, j) for i, j, _ in p.greedy_pairs(["abcd x", "abcd"], ["abcd", "abcd x", "abcd xy"])] == [(0, 1), (1, 0)]
    assert p.greedy_pairs([], ["a"]) == [] and p.greedy_pairs(["a"], []) == []


def test_ward_agrees_with_brute_force():
    x = np.random.default_rng(1).normal(size=(24, 3))
    groups = [[i] for i in range(24)]
    while len(groups) > 5:
        def cost(a, b):
            ca, cb = x[a].mean(axis=0), x[b].mean(axis=0)
            return len(a) * len(b) / (len(a) + len(b)) * ((ca - cb) ** 2).sum()

        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda t: cost(groups[t[0]], groups[t[1]]))
        groups[j] += groups[i]
        del groups[i]
    labels = greedy.ward(x, 5)
    assert sorted(sorted(np.flatnonzero(labels == k).tolist()) for k in set(labels)) == sorted(map(sorted, groups))


def test_farthest_points_respect_caps():
    x = np.random.default_rng(2).normal(size=(40, 2))
    m = greedy.matrix(x)
    got = greedy.farthest_points(m, 10, [i % 4 for i in range(40)], 3)
    assert len(got) == 10 and max(np.bincount([i % 4 for i in got])) <= 3
    chosen = got[:1]
    for i in got[1:]:
        allowed = [j for j in range(40) if j not in chosen and sum(c % 4 == j % 4 for c in chosen) < 3]
        assert m[i][chosen].min() == pytest.approx(max(m[j][chosen].min() for j in allowed))
        chosen.append(i)


def test_block_pairs_are_all_pairs(spark):
    x = np.random.default_rng(5).normal(size=(37, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(q.a, q.b): q.d for q in d.pair_distances(df, block=10).collect()}
    assert len(got) == 37 * 36 // 2
    assert all(v == pytest.approx(np.linalg.norm(x[a] - x[b])) for (a, b), v in got.items())


def test_latest_and_caps_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (None, 1, "x"), (2, None, "b")], "k long, t long, v string")
    assert {(x.k, x.v) for x in o.latest(df, "k", [F.col("t")]).collect()} == {(1, None), (None, "x"), (2, "b")}
    assert o.cap_per_group(df, "k", 1, [F.col("t")]).count() == 3
    assert o.latest(df.limit(0), "k", [F.col("t")]).count() == 0


def test_caps_give_way_where_no_candidate_is_left():
    m = greedy.matrix(np.random.default_rng(3).normal(size=(12, 2)))
    assert len(greedy.farthest_points(m, 8, [0] * 12, 3)) == 3
    assert len(greedy.farthest_points(m, 8, [0] * 12, 3, relax=True)) == 8


def test_exchanges_under_a_ceiling_by_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(20):
        m, over, value = greedy.matrix(rng.normal(size=(30, 2))), rng.random(30) < 0.6, rng.integers(0, 5, 30)
        chosen, ceiling = rng.choice(30, 12, replace=False).tolist(), int(rng.integers(0, 8))
        now = set(chosen)
        for _ in range(80):
            marked, free = [i for i in now if over[i]], [i for i in range(30) if not over[i] and i not in now]
            if len(marked) <= ceiling or not free:
                break
            now.discard(min(marked, key=lambda i: (value[i], i)))
            now.add(max(free, key=lambda i: (min((m[i][j] for j in now), default=0), -i)))
        assert greedy.class_ceiling(m, chosen, over, value, ceiling) == sorted(now)


def test_twins_are_exchanged():
    x = np.array([[0, 0], [0.01, 0], [5, 5], [9, 0], [0, 9], [20, 20]], float)
    value, classes = np.array([1, 2, 3, 4, 5, 6]), list("aabbab")
    assert greedy.twin_sweep(greedy.matrix(x), [0, 1, 2], value, classes, 1.0) == [1, 2, 4]  # of its own class
    assert greedy.twin_sweep(greedy.matrix(x), [0, 1, 2], value, list("aabbbb"), 1.0) == [1, 2, 5]  # or the farthest
    assert greedy.twin_sweep(greedy.matrix(x), [0, 1, 2], value, classes, 1.0, clusters=[0, 0, 0, 1, 0, 0], cluster_cap=2) == [1, 2, 3]


def test_distances_in_blocks(spark):
    x = np.random.default_rng(9).normal(size=(83, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    pairs = {(i, j): np.linalg.norm(x[i] - x[j]) for j in range(83) for i in range(j)}
    n, got = d.pair_percentiles(df, [0.0, 0.02, 0.5, 0.977, 1.0], block=20, bins=64)
    assert n == len(pairs) and got == pytest.approx(np.quantile(list(pairs.values()), [0.0, 0.02, 0.5, 0.977, 1.0]).tolist())
    assert [(q.a, q.b) for q in d.closest(df, 50, 20).collect()] == sorted(pairs, key=lambda k: (pairs[k], k))[:50]
    near = {i: min(np.linalg.norm(x[i] - x[j]) for j in range(30)) for i in range(30, 83)}
    far = {q.id: q.d for q in d.far_from(df.filter("id >= 30"), df.filter("id < 30"), 0.5, block=7).collect()}
    assert far == pytest.approx({i: v for i, v in near.items() if v >= 0.5})
    assert d.far_from(df, df.limit(0), 0.5).count() == 83 and d.pair_percentiles(df.limit(1), [0.5])[0] == 0


def test_best_of_several_alternatives(spark):
    from folioscope.functions import similarity as s

    rows = [("abc def", ["xyz", "abc deg"]), ("abc", []), ("abc", ["", None]), ("", ["abc"]), (None, None)]
    got = [x.s for x in spark.createDataFrame(rows, "p string, g array<string>").select(s.best_similarity("p", "g").alias("s")).collect()]
    assert got == [pytest.approx(0.857), None, None, 0.0, None]


def test_merged_outputs(spark):
    from folioscope.operators import checks as c

    schema = "id int, title string, authors array<string>, abstract string, keywords string, doi string"
    a = spark.createDataFrame([(1, "Uzun bir baslik burada", ["Ali Kaya"], "", "k", None), (2, "Kisa", [], "oz", "", "d"), (3, "tek", None, None, None, None)], schema)
    b = spark.createDataFrame([(1, "Baslik", ["Can Er"], "abs", "q", "x"), (2, "Verim ve Kalite", ["Ali Kaya", "Verimin incelenmesi", "dort kelimelik uzun ad"], "z", "w", "y"), (4, "yalniz", ["Ece Su"], "a", "b", "c")], schema)
    got = {r.id: (r.title, r.authors, r.abstract, r.keywords, r.doi) for r in c.merge_outputs(a, b, "id").collect()}
    assert got[1] == ("Uzun bir baslik burada", ["Ali Kaya"], "abs", "k", "x")
    assert got[2] == ("Verim ve Kalite Verimin incelenmesi dort kelimelik uzun ad", ["Ali Kaya"], "oz", "w", "d")
    assert got[3] == ("tek", [], "", "", "") and got[4] == ("yalniz", ["Ece Su"], "a", "b", "c")


def test_front_ends(spark):
    header, title, abstract = "Running header", "Soil and water of the plain", "one two three four five six seven"
    lines = {
        1: ["x", "1. GİRİŞ", title], 2: ["x", header, title, header, header, "y"], 3: ["a", "Soil and water OF THE plain", "b", "two three four five six seven", "c"],
        4: list("abcdefgh"), 5: ["a"], 6: ["1. Girişimcilik", "x"], 7: ["a", "1 introduction"], 8: [title, "q", title, "r", title],
    }
    docs = spark.createDataFrame([(i, "\n".join(x), [title, "Too short"], [abstract, ""]) for i, x in lines.items()], "id int, text string, t array<string>, a array<string>")
    got = {r.id: r.front_end for r in g.front_end(docs, "id", "text", "t", "a").collect()}
    assert got == {1: 1, 2: 3, 3: 4, 4: 2, 5: 1, 6: 1, 7: 1, 8: 1}  # in 8 the title is a running header


def test_word_spans_of_hard_texts(spark):
    """Places in code points, nulls and texts without words, as a search with a pattern finds them."""
    import re

    from folioscope.functions import normalize

    texts = ["İki kısa çizgi", None, "", "...", "a𝒳b ığüşöç\nx", "ß1é2", "son", "İ"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    got = {r.id: r.s and [tuple(x) for x in r.s] for r in rows.select("id", normalize.word_spans("t").alias("s")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else [(m.group(), m.start(), m.end()) for m in re.finditer("[a-zA-Z0-9ığüşöçİĞÜŞÖÇ]+", t)]
        assert (got[i] or (None if t is None else [])) == want


def test_word_spans_are_flat_arrays():
    """No object for each word: a batch costs its own text and places."""
    import pyarrow as pa

    from folioscope.functions.normalize import _word_spans

    made = _word_spans(["kelime " * 50_000, None, "son"])
    assert isinstance(made, pa.ListArray) and made.nbytes < 8_000_000 and [len(x) if x.is_valid else None for x in made] == [50_000, None, 1]


def test_texts_of_few_large_files_are_dealt_out(spark, tmp_path, monkeypatch):
    from folioscope.plans import registry

    spark.range(4000).selectExpr("id AS doc_id", "sha2(string(id), 512) AS text").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(registry, "TASK_BYTES", 1 << 15)
    assert registry.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() > 8  # two were read in place
    monkeypatch.setattr(registry, "TASK_BYTES", 1 << 30)
    assert registry.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() <= 4


def test_a_text_is_cut_into_words_once_for_its_pairs(monkeypatch):
    import pandas as pd

    from folioscope.operators import spans

    made, cut = [], spans.Canvas

    def counted(text):
        made.append(text)
        return cut(text)

    monkeypatch.setattr(spans, "Canvas", counted)
    texts = ["one two three four", "one two three four", "five six seven one", None, "five six seven one"]
    got = spans.measure_span.func(pd.Series(texts), pd.Series(["two three", "three four", "six seven", "six seven", None]))
    assert made.count("one two three four") == 1
    assert got["matched"].tolist()[:3] == [2, 2, 2] and got["matched"].isna().tolist()[3:] == [True, True]
