"""Benchmark decontamination by greedy string tiling.

Documents and test items are sequences of lower-case words without ASCII punctuation. A document meets an
item where they share a seed of MIN_TILE consecutive words. The share of the item's words under shared seeds
bounds what tiling can reach, so only pairs over the threshold are tiled: the longest common run of unmarked
words is found by Karp-Rabin hashes over halving lengths, checked word by word, marked on both sides, and
again until no run of MIN_TILE words is left. Tiles may lie in any order, so reordered passages count. A
document is contaminated by an item if tiles cover at least COVERAGE of the item's words. An item of fewer
than MIN_TILE words is one seed by itself: it is found where all its words stand in a row.

The seeds of the items are sent to all tasks in blocks of at most BLOCK_BYTES of item text, which are made one
after the other; a larger benchmark takes more passes over the documents, never a larger broadcast.

Defined results: null or empty texts contain nothing; null items and items without a word match nothing; equal
items of different ids are each reported, rows of equal id and text are one item; repeated documents are each
reported; null doc_ids are passed through; very long texts are searched whole, in time and memory linear in
their words; empty tables give an empty result; other columns are kept by ``drop_contaminated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import load
from folioscope.llm.windows import Hashes, mix

MIN_TILE = 5
COVERAGE = 0.5
#: Item text in a block. A block takes about ten times as much memory in a Python worker.
BLOCK_BYTES = 8 << 20

_marks = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_spaces = bytes.maketrans(_marks.encode(), b" " * len(_marks))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_spaces).split()


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of n ids."""
    return mix(Hashes(ids).all(n))


def free_windows(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of windows of n words of which none is marked."""
    if len(marked) < n:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[n:] == total[:-n])


def common(a: np.ndarray, b: np.ndarray, marked_a: np.ndarray, marked_b: np.ndarray, n: int, first: bool = False) -> list[tuple[int, int]]:
    """Pairs of starts of equal unmarked windows of n words that do not overlap each other, in order, or only the first.

    For each start in a, from the left, the leftmost start in b that is still free. A start of b that has been
    overtaken by a tile never becomes free again, so no pair of starts is looked at twice.
    """
    at_a, at_b = free_windows(marked_a, n), free_windows(marked_b, n)
    if not len(at_a) or not len(at_b):
        return []
    hash_a, hash_b = window_hashes(a, n)[at_a], window_hashes(b, n)[at_b]
    hit = np.isin(hash_a, hash_b)
    if not hit.any():
        return []
    order = np.argsort(hash_b, kind="stable")
    hash_b, at_b = hash_b[order], at_b[order]
    low, high = np.searchsorted(hash_b, hash_a[hit], "left"), np.searchsorted(hash_b, hash_a[hit], "right")
    free_a, free_b = ~marked_a, ~marked_b
    next_, out, end = {}, [], -1
    for i, s, e in zip(at_a[hit].tolist(), low.tolist(), high.tolist(), strict=True):
        if i < end:
            continue
        at = next_.get(s, s)
        while at < e and not (free_b[at_b[at]] and free_b[at_b[at] + n - 1]):
            at += 1
        next_[s] = at
        for k in range(at, e):  # the first one, but where hashes of different words are equal
            j = int(at_b[k])
            if free_b[j] and free_b[j + n - 1] and np.array_equal(a[i : i + n], b[j : j + n]):
                out.append((i, j))
                if first:
                    return out
                free_b[j : j + n] = False
                end = i + n
                break
    return out


def tile(item: np.ndarray, doc: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in doc, length), the longest first."""
    marked_i, marked_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out, most = [], min(len(item), len(doc))
    while most >= least:
        low, high, found = least, most, 0
        while low <= high:  # the longest length with a common unmarked window; shorter ones have one as well
            n = (low + high) // 2
            if common(item, doc, marked_i, marked_d, n, first=True):
                found, low = n, n + 1
            else:
                high = n - 1
        if not found:
            break
        most = found
        for i, j in common(item, doc, marked_i, marked_d, most):
            marked_i[i : i + most] = True
            marked_d[j : j + most] = True
            out.append((i, j, most))
    return out


class Items:
    """Test items as id sequences, and their seeds by length: sorted hashes with the item and place of each."""

    def __init__(self, rows: list[tuple[int, str]], least: int = MIN_TILE, coverage: float = COVERAGE):
        self.rows, self.least, self.coverage = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), least, coverage
        self.ids: dict[bytes, int] = {}
        self.items = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], np.uint64) for _, text in self.rows]
        self.seeds = {}
        for n in sorted({min(least, len(x)) for x in self.items if len(x)}):
            own = [k for k, x in enumerate(self.items) if min(least, len(x)) == n]
            hashes = [window_hashes(self.items[k], n) for k in own]
            size = [len(h) for h in hashes]
            keys, item, at = np.concatenate(hashes), np.repeat(np.array(own, np.int32), size), np.concatenate([np.arange(m, dtype=np.int32) for m in size])
            order = np.argsort(keys, kind="stable")
            self.seeds[n] = keys[order], item[order], at[order]

    def __reduce__(self):
        return Items, (self.rows, self.least, self.coverage)

    def under_seeds(self, doc: np.ndarray) -> dict[int, np.ndarray]:
        """item -> which of its words are under seeds that the document has; only short items are decided by it."""
        covered: dict[int, np.ndarray] = {}
        for n, (keys, item, at) in self.seeds.items():
            known = free_windows(doc == 0, n)
            if not len(known):
                continue
            hashes = np.unique(window_hashes(doc, n)[known])
            for s, e in zip(np.searchsorted(keys, hashes, "left").tolist(), np.searchsorted(keys, hashes, "right").tolist(), strict=True):
                for k, i in zip(item[s:e].tolist(), at[s:e].tolist(), strict=True):
                    if k not in covered:
                        covered[k] = np.zeros(len(self.items[k]), bool)
                    covered[k][i : i + n] = True
        return covered

    def matches(self, text: str | None) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        """(item id, share of the item's words in tiles, tiles) of each item that reaches the threshold."""
        words = words_of(text)
        if not words or not self.seeds:
            return []
        get = self.ids.get
        doc = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        if not doc.any():
            return []
        covered = self.under_seeds(doc)
        out = []
        for k in sorted(covered):
            n = len(self.items[k])
            if covered[k].sum() < self.coverage * n:
                continue
            doc_for = np.where(np.isin(doc, self.items[k]), doc, 0)
            tiles = tile(self.items[k], doc_for, min(self.least, n))
            share = sum(t[2] for t in tiles) / n
            if share >= self.coverage:
                out.append((self.rows[k][0], share, tiles))
        return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks whose text is about ``limit`` bytes at most; each is small enough to be sent to all tasks.

    Items are dealt by id and text, so missing or repeated ids do not fill a block. One block is made at a time."""
    known = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, math.ceil(size / limit))
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        yield Items([(r["item_id"], r["text"]) for r in known.filter(own == b).collect()])  # about ``limit`` bytes


PAIRS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.IntegerType())]
)


def contaminated(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles) of contaminated documents, for one block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_BYTES of text

    def run(batches):
        for batch in batches:
            rows = [(d, i, round(share, 6), len(tiles)) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, share, tiles in sent.value.matches(text)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, [pa.int64(), pa.int64(), pa.float64(), pa.int32()])), PAIRS.fieldNames())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PAIRS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; one pass for each block of items."""
    schema, at = docs.schema, docs.columns.index("text")
    for items in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op8_string_tiling(spark, sf_dir):
    """Contaminated pairs of all documents and all benchmark items: doc_id, item_id, coverage, n_tiles."""
    docs = load(spark, sf_dir, "documents")
    parts = [contaminated(docs, items) for items in blocks(load(spark, sf_dir, "benchmark"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
