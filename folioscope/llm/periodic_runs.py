"""Periodic run detection: every stretch of words that repeats itself, found on a harmonic grid.

A stretch with period q and length of 2q words or more covers a grid point i (a multiple of q) together with i + q.
So for every period p the grid points 0, p, 2p, ... are paired with the points p words on: n/1 + n/2 + n/3 + ... pairs,
which are n log n. Of all pairs with equal words at once, NumPy binary-searches how far the words from the two points on
agree, and how far those before them do; equality of stretches is read from prefix hashes. Every candidate is then
verified on the words themselves and, if a hash misled, measured anew on them. A run is found from many grid points and
under multiples of its period; equal stretches are one run, with the least of their periods.

A hash that clashes can only make a stretch look longer than it is, never shorter, and the words have the last say, so
results are exact. Documents are independent: one pass, no shuffle. Pairs are made in pieces of CHUNK, by rising period;
later pieces leave out pairs that lie in a run whose period divides theirs, so that a huge text of one word costs no more
than its first period.

Defined results: a null or empty text has no words and no run; words are compared as they are; very long texts take memory
of about 60 bytes a word in one task; repeated rows and repeated or null doc_ids each get their own result; an empty table
gives an empty result; other columns, whatever their names, are kept in ``row`` or by ``collapse_runs``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import WORD_PATTERN, load

LEAST = 12
CHUNK = 1 << 20
MODULUS = (1 << 31) - 1
BASE = 911382323

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
FOUND = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"

_powers = np.ones(1, np.int64)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0..n-1; kept for the next text, but for texts past CHUNK words."""
    global _powers
    if len(_powers) >= n:
        return _powers[:n]
    out = np.ones(max(n, 1024), np.int64)
    have = 1
    while have < len(out):
        more = min(have, len(out) - have)
        out[have : have + more] = out[:more] * pow(BASE, have, MODULUS) % MODULUS
        have += more
    if n <= CHUNK:
        _powers = out
    return out[:n]


class Prefixes:
    """Prefix hashes of a word sequence; agreement of two places i < j as vectors."""

    def __init__(self, w: np.ndarray):
        self.n = len(w)
        self.power = powers(self.n + 1)
        self.hash = np.zeros(self.n + 1, np.int64)
        np.cumsum((w + 1) * self.power[: self.n] % MODULUS, out=self.hash[1:])
        self.hash %= MODULUS

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        here, there = self.hash[i + length] - self.hash[i], self.hash[j + length] - self.hash[j]
        return (here * self.power[j - i] - there) % MODULUS == 0

    def agree(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """How many words agree from i and j on, or before them; each step halves all that is open."""
        low, high = np.zeros_like(i), i.copy() if back else self.n - j
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.same(i - mid, j - mid, mid) if back else self.same(i, j, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def grid(n: int):
    """(grid point, period) of all pairs of a text of n words, in pieces of CHUNK by rising period."""
    counts = (n - 1) // np.arange(1, n // 2 + 1)
    ends = np.cumsum(counts)
    for first in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
        t = np.arange(first, min(first + CHUNK, int(ends[-1])))
        k = np.searchsorted(ends, t, side="right")
        yield (t - ends[k] + counts[k]) * (k + 1), k + 1


def measured(w: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """Start and end of the stretch of period p around the pair (i, i + p), from the words."""
    differ = np.flatnonzero(w[:-p] != w[p:])
    at = np.searchsorted(differ, i)
    start = int(differ[at - 1]) + 1 if at else 0
    return start, (int(differ[at]) if at < len(differ) else len(w) - p) + p


def find_runs(w: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``least`` words or more, by start, then period."""
    n = len(w)
    found: dict[tuple[int, int], int] = {}
    if n < max(least, 2):
        return np.zeros((0, 3), np.int64)
    prefixes, cover, periods = None, None, [1]
    for i, p in grid(n):
        ok = w[i] == w[i + p]
        if cover is not None:  # pairs inside a run whose period divides theirs say nothing new
            ok &= (cover[i] == 0) | (cover[i] != cover[i + p]) | (p % np.array(periods)[cover[i]] != 0)
        i, p = i[ok], p[ok]
        if not len(i):
            continue
        prefixes = prefixes or Prefixes(w)
        start = i - prefixes.agree(i, i + p, True)
        end = i + p + prefixes.agree(i, i + p, False)
        ok = end - start >= np.maximum(least, 2 * p)
        if not ok.any():
            continue
        rows, of = np.unique(np.stack([start[ok], end[ok], p[ok]], axis=1), axis=0, return_inverse=True)
        for k, (s, e, q) in enumerate(rows.tolist()):
            if (w[s : e - q] == w[s + q : e]).all():
                found[s, e] = min(q, found.get((s, e), q))
                continue
            for point in i[ok][of.ravel() == k].tolist():  # hashes clashed: several stretches may look like one
                s, e = measured(w, point, q)
                if e - s >= max(least, 2 * q):
                    found[s, e] = min(q, found.get((s, e), q))
        if n * 8 > CHUNK:
            cover = np.zeros(n, np.int32)
            periods = [1, *found.values()]
            for k, (s, e) in enumerate(found, 1):
                cover[s:e] = k
    rows = sorted((s, q, e - s) for (s, e), q in found.items())
    return np.array([(s, length, q) for s, q, length in rows], np.int64).reshape(-1, 3)


def kept(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def _text(text: str | None, least: int) -> tuple[list[dict], str]:
    words = (text or "").encode().split()
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    runs = find_runs(w, least)
    if len(runs):
        words = [words[i] for i in np.flatnonzero(kept(runs, len(w)))]
    return [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], b" ".join(words).decode()


def runs_of(text: Column, least: int = LEAST) -> Column:
    """struct of runs (start, length, period, in words from 0; by start, then period) and collapsed (the words left, joined by one space)."""

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        out = [_text(t, least) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r for r, _ in out], RUNS), pa.array([c for _, c in out], pa.string())], ["runs", "collapsed"])

    return found(text)


def mark_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """row (the columns of docs as a struct), and found: the runs and the collapsed text of each document."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), runs_of(F.col("text"), least).alias("found"))


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, start, length and period of every run."""
    return docs.select("doc_id", runs_of(F.col("text"), least).alias("found")).select("doc_id", F.inline("found.runs"))


def collapse_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with every run cut to its first period; texts without a run stay as they are, others are words joined by one space."""
    text = F.when(F.size("found.runs") > 0, F.col("found.collapsed")).otherwise(F.col("row.text"))
    return mark_runs(docs, least).select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the rewriting that the contract of op13 asks of every tenth document by crc32.

    A null doc_id is not rewritten. The tail from word a on is its first p words again and again, ten times at most.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))
    n = F.size(words).cast("long")
    a = F.pmod(g, n).cast("int")
    share = F.lit(3).cast("long") + g % 8
    p = (F.lit(1) + F.floor((n - a) / share)).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), (share + 1).cast("int")))
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), (n - a).cast("int"))), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir):
    """Contract query: the longest run of each document, and digests of all its runs and of its collapsed words."""
    marked = mark_runs(planted(load(spark, sf_dir, "documents")))
    runs = F.col("found.runs")
    ranked = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less")))
    best = F.array_max(ranked)
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    digest = lambda s: F.sha2(s.cast("binary"), 256)
    rows = marked.select("row.doc_id", F.col("found"), best.alias("best"))
    return rows.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"),
        F.expr("1000 * best.length div -best.less").alias("exponent_milli"),
        digest(F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("")).alias("runs_sha256"),
        digest(F.col("found.collapsed")).alias("collapsed_sha256"),
    )
