"""Removing repeated word sequences: matching statistics against suffix automata of reference shards.

A word is removed if a window of 35 words that covers it also starts anywhere else, in the same document or
another. The reference is the corpus itself, which no broadcast may hold, so its shards are laid out by the
windows module: stretches that can share a window are in one shard. A task builds the suffix automaton of its
shard, counts how often each state occurs, and streams the stretches through it: at every word it follows
the longest match that occurs at least twice. Where that reaches 35 words the window ends in a repeat, and
maximal runs of such windows are the spans to remove.

The automata are not broadcast: shard and queries meet in the same task. Broadcasting all shards of a corpus
to all documents would read every document once for each shard.

Defined results: a null text has no words; texts under 35 words lose nothing; repeated rows are copies of
each other and both lose their repeats; null doc_ids are passed through; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioscope.llm.common import load
from folioscope.llm.suffix_dedup import _null_ids, _runs
from folioscope.llm.windows import Rules, search

WIDTH = 35
PIECE = 8


class _Names(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_names = _Names()


def word_ids(raw: bytes) -> np.ndarray:
    words = raw.split()
    return np.fromiter(map(_names.__getitem__, words), np.uint64, len(words))


class SuffixAutomaton:
    """Suffix automaton of a set of sequences, with the number of times each state's strings occur.

    Each sequence starts anew from the root, so no string crosses two sequences. States carry their longest
    length, suffix link and transitions.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.times = [0]

    def add(self, sequence: list[int], times: int = 1) -> None:
        """Adds a sequence that occurs ``times`` times."""
        nxt, link, length, count = self.next, self.link, self.length, self.times
        last = 0
        for c in sequence:
            p = last
            if c in nxt[p]:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    last = q
                    count[q] += times
                    continue
                last = self._clone(p, q, c)
                count[last] += times
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[p] + 1)
            count.append(times)
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        self.times.append(0)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def settle(self) -> None:
        """Adds each state's count to its suffix link's, the longest states first."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.times[self.link[s]] += self.times[s]

    def repeats(self, sequence: list[int], least: int = 2) -> list[int]:
        """Matching statistics: for each word, the length of the longest string that ends there and occurs ``least`` times."""
        nxt, link, length, count = self.next, self.link, self.length, self.times
        state, have, out = 0, 0, []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                have = length[state]
            state = nxt[state].get(c, 0)
            have = have + 1 if state else 0
            while state and count[state] < least:
                state = link[state]
                have = length[state]
            out.append(have)
        return out


def solve(tokens: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, count: np.ndarray):
    """Ranges of windows of the segments that occur twice or more in the shard."""
    _, ids = np.unique(tokens, return_inverse=True)
    parts = [ids[s:e].tolist() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    shard = SuffixAutomaton()
    for part, n in zip(parts, count.tolist(), strict=True):
        shard.add(part, n)
    shard.settle()
    segment, low, high = [], [], []
    for i, part in enumerate(parts):
        for s, e in _runs(np.array(shard.repeats(part)[WIDTH - 1 :]) >= WIDTH).tolist():
            segment.append(i)
            low.append(s)
            high.append(e - 1)
    return np.array(segment, np.int64), np.array(low, np.int64), np.array(high, np.int64), np.zeros(len(low), np.int64)


RULES = Rules(WIDTH, PIECE, False, "uint64", word_ids, lambda t: t, solve)
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
KEPT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])


def _left(raw: bytes, mark: np.ndarray) -> bytes:
    words = raw.split()
    return b" ".join([words[i] for i in np.flatnonzero(~mark)]) if mark.any() else b" ".join(words)


def _digest(batch, marks) -> pa.Table:
    rows = [] if batch is None else [(len(m), int(m.sum()), hashlib.sha256(_left(raw, m)).hexdigest()) for raw, m in zip(batch.raw, marks, strict=True)]
    n, removed, sha = list(zip(*rows, strict=True)) or [()] * 3
    ids = _null_ids(batch.ids) if batch is not None else pa.array([], pa.int64())
    return pa.table([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], RESULT.fieldNames())


def _kept(batch, marks) -> pa.Table:
    kept = [] if batch is None else [_left(raw, m).decode("utf-8", "replace") for raw, m in zip(batch.raw, marks, strict=True)]
    ids = _null_ids(batch.ids) if batch is not None else pa.array([], pa.int64())
    return pa.table([ids, pa.array(kept, pa.string()), pa.array([_runs(m).tolist() for m in marks], pa.list_(pa.list_(pa.int64())))], KEPT.fieldNames())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, the kept words joined by spaces, and the removed spans [start, end) in words."""
    return search(docs, RULES, _kept, KEPT)


def op6_automaton_dedup(spark, sf_dir):
    """Contract query: doc_id, n_words, n_removed, kept_sha256."""
    return search(load(spark, sf_dir, "documents"), RULES, _digest, RESULT)


#: The contract in SQL: a word is gone if one of the 35 windows that cover it occurs twice.
OP6_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p, words FROM t),
g AS (SELECT doc_id, word, p, CASE WHEN p + 34 <= len(words) THEN md5(array_to_string(list_slice(words, p, p + 34), ' ')) END AS win FROM w),
f AS (SELECT doc_id, word, p, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS hit FROM g),
m AS (SELECT doc_id, word, p, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY p) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""
