"""Collocations, token counts and periodic runs against brute force, the tokenizer itself and an all-periods scan."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioscope.llm import collocations, periodic_runs, token_counts
from tests.llm.conftest import prose


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


# --- collocations


def brute_collocations(rows, least, top):
    """rows of (lang, text) -> the contract's rows, with Python's whole numbers."""
    count, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = count.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for m in (1, 2, 3, 4):
                f.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in candidates.items():
            inner = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * b >= 80 * a and inner(q) for q, b in candidates.items()):
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return out


@pytest.mark.parametrize("batch_bytes", [1500, 1 << 24])
def test_collocations_equal_brute_force(spark, messy, messy_rows, batch_bytes):
    got = collocations.collocations(messy, top=40, least=3, batch_bytes=batch_bytes)
    want = brute_collocations([(r[2], r[1]) for r in messy_rows], 3, 40)
    assert len(want) > 40 and {r[0] for r in want} == {"en", "fr", "tr"}
    assert plain(got.collect()) == plain(want)


def test_collocations_of_copies_ties_and_missing_values(spark, empty):
    r = random.Random(4)
    rows = [("en", " ".join(r.choice("abc") for _ in range(9)) + r.choice(".,;\n\x0b ")) for _ in range(120)]
    rows += [(None, "Ab aB ab\tab. ab"), ("und", "ab ab ab"), (None, None), ("fr", ""), ("fr", " . , ")]
    rows += [("en", "x y z x y z")] * 50 + [("de", "É é É é"), ("de", "       ")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = plain(collocations.collocations(docs, top=25, least=2, batch_bytes=400).collect())
    assert got == plain(brute_collocations(rows, 2, 25))
    assert collocations.collocations(empty).count() == 0


def test_sketch_never_counts_too_little():
    """A cell table with room for few cells: clashes add up, and what reaches the bound is all there."""
    words = collocations.Words(["en"] * 3, ["a b a b. a b", None, "b a " * 20])
    bits, seen = 3, Counter()
    for at, h in words.runs(4):
        for c, d in zip(*collocations.cells(h, bits), strict=True):
            seen[int(c)] += 1
            seen[int(d)] += 1
    for at, h in words.runs(4):
        times = Counter(h.tolist())
        for c, d, x in zip(*collocations.cells(h, bits), h.tolist(), strict=True):
            assert seen[int(c)] >= times[x] <= seen[int(d)]
    assert words.totals == {"en": 46} and words.left[:6].tolist() == [4, 3, 2, 1, 2, 1]


def test_scores_are_exact_past_64_bits(spark):
    big = 9_000_000_000_000_000
    rows = [("en", 1, "p", big + 7), ("en", 1, "q", big + 1), ("en", 2, "p q", big), ("en", 0, "", 10**17), ("en", 1, "s", 3), ("en", 2, "p s", 2)]
    got = {x.phrase: x for x in collocations.scored(spark.createDataFrame(rows, "lang string, m int, phrase string, a long")).collect()}
    assert got["p q"].score == 2000000 * big // (2 * big + 8)
    assert (got["p s"].l, got["p s"].r, got["p s"].score) == (big + 7, 3, 0)


# --- token counts


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_counts.vocabulary_path())


PARTS = ["a", "b", "'s", "'t", "'", "é", "́", "İ", "é", "Å", "ß", "1", "٢", "<|endoftext|>", "<|endof", "text|>", "<|startoftext|>", "。", "中"]
PARTS += ["!", "...", " ", "　", "​", "하", "ᆫ", "가", "ΑΣ", "\x1c", "\x85", "क़", "😀", "_", "-", "{", "\x7f"]


def hard_texts():
    r = random.Random(5)
    out = [None, "", " \t\n", "a" * 3000, "中" * 2000, "a" * 1500 + "<|endoftext|>" * 100 + "b" * 900, "ab." * 900, "x" * 500 + " " * 600 + "y" * 500]
    for share in (0, 0, 0.02, 0.1, 0.4) * 12:
        out.append("".join(r.choice(PARTS) + (r.choice(" \n\t\x0b") if r.random() < share else "") for _ in range(r.randrange(900))))
    return out


@pytest.mark.parametrize("chunk,overlap", [(120, 48), (400, 80), (1 << 15, 256)])
def test_token_counts_are_the_librarys(spark, tokenizer, chunk, overlap):
    texts = hard_texts()
    docs = spark.createDataFrame([(i % 50 or None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = token_counts.count_tokens(docs, chunk=chunk, overlap=overlap).select("row.doc_id", "row.text", "n_bytes", "n_tokens").collect()
    want = [(i % 50 or None, t, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert plain(got) == plain(want)


def test_token_count_query_and_other_columns(spark, messy, messy_rows, empty, save, tokenizer):
    got = token_counts.op12_token_counts(spark, save(documents=messy)).collect()
    counts = [(r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in messy_rows]
    assert plain(got) == plain([(*c, c[2] > 2048) for c in counts])
    assert token_counts.count_tokens(empty).count() == 0
    assert token_counts.count_tokens(messy).select("row.*").columns == messy.columns


def test_stable_boundaries_part_any_text(tokenizer):
    """What the rule calls stable is: both sides encode to the tokens that the whole has there."""
    coder = token_counts.encoder(token_counts.vocabulary_path())
    r, found = random.Random(8), 0
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    for _ in range(300):
        text = "".join(r.choice([*PARTS, "q", "7", " "]) for _ in range(30))
        whole = encode(text)
        for at in range(1, len(text)):
            if coder.stable(text, at):
                found += 1
                assert encode(text[:at]) + encode(text[at:]) == whole
    assert found > 1000


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 5)
    coder = token_counts.Encoder(token_counts.vocabulary_path())
    texts = ["one two three", "four five six seven", "x" * 100 + " one", "one two three four five six seven"]
    assert coder.counts(texts) == coder.numbers(texts)


def test_special_strings_and_wide_overlaps(spark, tokenizer):
    """No boundary at all until a chunk holds the whole text."""
    text = "中" * 700 + "<|endoftext|>" + "é" * 700
    huge = spark.createDataFrame([(1, text), (2, text * 2)], "uid long, text string")
    got = dict(map(tuple, token_counts.huge_counts(huge, chunk=100, overlap=64).collect()))
    assert got == {1: len(tokenizer.encode(text, add_special_tokens=False).ids), 2: len(tokenizer.encode(text * 2, add_special_tokens=False).ids)}


# --- periodic runs


def brute_runs(w, least=12):
    """Every period in turn, every stretch of words that equal those a period on."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if i + p - start >= max(least, 2 * p):
                found.setdefault((start, i + p), p)
    return sorted((s, q, e - s) for (s, e), q in found.items())


def periodic_rows(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, q, length in runs), default=None)
    head = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    lines = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_runs_equal_all_periods_scan():
    r = random.Random(1)
    for _ in range(700):
        n, letters = r.randrange(0, 110), r.choice([1, 2, 3, 5])
        w = [r.randrange(letters) for _ in range(n)]
        if r.random() < 0.5 and n:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randrange(3, 11)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        got = periodic_runs.find_runs(np.array(w, np.int64))
        assert [(s, q, length) for s, length, q in got.tolist()] == brute_runs(w)


def test_runs_in_pieces_and_with_clashing_hashes(monkeypatch):
    """Pairs in pieces of seven, and hashes modulo 5, which clash all the time: the words have the last say."""
    r = random.Random(2)
    monkeypatch.setattr(periodic_runs, "CHUNK", 7)
    monkeypatch.setattr(periodic_runs, "MODULUS", 5)
    monkeypatch.setattr(periodic_runs, "_powers", np.ones(1, np.int64))
    for _ in range(150):
        w = [r.randrange(r.choice([1, 2, 4])) for _ in range(r.randrange(0, 60))]
        got = periodic_runs.find_runs(np.array(w, np.int64), 4)
        assert [(s, q, length) for s, length, q in got.tolist()] == brute_runs(w, 4)


def test_runs_of_a_huge_text():
    w = np.arange(400_000, dtype=np.int64) % 7
    w[0] = 9
    assert periodic_runs.find_runs(w).tolist() == [[1, 399_999, 7]]


def test_periodic_run_query(spark, messy, messy_rows, empty, save):
    rows = [r for r in messy_rows if r[0] != 4]
    docs = messy.filter("doc_id IS NULL OR doc_id <> 4")
    more = [(i, prose(i, 40 + i % 50)) for i in range(500, 600)] + [(600, "one two " * 9 + "three"), (None, "q " * 13), (601, "a b c d e f " * 2), (602, "a " * 11)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = periodic_runs.op13_periodic_runs(spark, save(documents=docs)).collect()
    want = [periodic_rows(r[0], r[1]) for r in rows + more]
    assert plain(got) == plain(want)
    assert sum(r.n_runs > 0 for r in got) > 8
    assert periodic_runs.mark_runs(empty).count() == 0


def test_spans_and_collapsed_texts(spark, messy):
    docs = spark.createDataFrame([(1, "x\n" + "a b " * 8 + "c", "k"), (2, "left  as\tit is", "k"), (3, None, "k")], "doc_id long, text string, found string")
    assert [tuple(r) for r in periodic_runs.periodic_runs(docs).collect()] == [(1, 1, 16, 2)]
    out = {r.doc_id: r.text for r in periodic_runs.collapse_runs(docs).collect()}
    assert out == {1: "x a b c", 2: "left  as\tit is", 3: None}
    assert periodic_runs.collapse_runs(messy).columns == messy.columns
