"""Removing repeated byte strings: two-stage suffix sorting of candidate stretches.

A byte is removed if a 50-byte string that covers it also starts in a document of a smaller doc_id. The
windows module brings equal 50-byte strings together in buckets; a bucket's bytes are suffix-sorted in two
stages. Only suffixes smaller than their successors are sorted directly, by eight bytes at a time within
groups that still tie. The others are induced by one scan over the first-byte buckets: a suffix whose
successor has just been met goes to the next free place of its own bucket. Common prefixes of neighbours in
the order then give the groups of equal 50-byte strings, and each group its least doc_id. The order need
hold to a depth of 50 bytes, so ties beyond 56 bytes stay as they are.

Defined results: a null text is empty; texts under 50 bytes lose nothing; a null doc_id is larger than any
other and equal to itself; rows that share a doc_id do not remove each other; an empty table gives an empty
result; other columns are ignored by the query.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import load
from folioscope.llm.windows import NO_ID, Rules, search

WIDTH = 50
#: Longer pieces make more segments, but fewer that only share a piece, whose number grows faster than the corpus.
PIECE = 24
DEPTH = 56

_byte_values = np.random.default_rng(20240607).integers(0, 2**64, 256, np.uint64)


def eight_bytes(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one big-endian number; text has eight bytes of padding."""
    return np.ndarray(len(text) - 7, ">u8", np.ascontiguousarray(text), 0, (1,))[at].astype(np.uint64)


def smaller_than_next(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, whether it is smaller than the suffix after it (the end counts as the least suffix); and the
    places where DEPTH equal bytes or more start."""
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True))  # of each run of equal bytes
    size = np.diff(last, prepend=-1)
    small = np.repeat(np.append(text[last[:-1] + 1] > text[last[:-1]], False), size)
    long = np.flatnonzero(size >= DEPTH)
    many = size[long] - DEPTH + 1
    return small, np.repeat(last[long] - size[long] + 1 - (np.cumsum(many) - many), many) + np.arange(many.sum())


def sort_directly(padded: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The places ``at`` in the order of their suffixes, to ``depth`` bytes."""
    key = eight_bytes(padded, at)
    order = np.argsort(key)
    at, key = at[order], key[order]
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) if len(at) else np.zeros(0, np.int64)
    for d in range(8, depth, 8):
        same = np.concatenate([[False], group[1:] == group[:-1]])
        open_ = same | np.concatenate([same[1:], [False]])
        tied = np.flatnonzero(open_)
        if not len(tied):
            break
        key = eight_bytes(padded, np.minimum(at[tied] + d, len(padded) - 8))
        order = np.lexsort((key, group[tied]))
        at[tied] = at[tied[order]]
        key, owner = key[order], group[tied]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        # a new group starts wherever a tied stretch parts; groups keep their order
        starts = ~same
        starts[tied] |= new
        group = np.cumsum(starts) - 1
    return at


def needed(small: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The places whose suffixes must be sorted to order the asked ones: after one that is induced also its successor."""
    out = np.append(asked, True)
    at = np.flatnonzero(asked & ~out[1:])
    while len(at := at[~small[at]] + 1):
        at = at[~out[at]]
        out[at] = True
    return out[:-1]


def suffix_order(text: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of a byte sequence, right to DEPTH bytes at least; of the asked places, and those needed for them.

    Induced suffixes that start with DEPTH equal bytes are the last induced ones of their bucket and tie, so a run
    of one byte takes DEPTH steps at most, however long it is.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(DEPTH + 8, np.uint8)])
    small, long = smaller_than_next(text)
    sort = np.ones(n, bool) if asked is None else needed(small, asked)
    counts = np.bincount(text[sort], minlength=256)
    heads = np.cumsum(counts) - counts
    ends = heads + counts
    out = np.empty(ends[-1], np.int64)
    direct = sort_directly(padded, np.flatnonzero(small & sort))
    tied = long[~small[long] & sort[long]]
    tied = tied[np.argsort(text[tied], kind="stable")]
    borders = np.searchsorted(text[tied], np.arange(257))
    sort &= ~small
    sort[tied] = False  # from here on: what is induced one by one
    n_small = np.bincount(text[direct], minlength=256)
    at = 0
    for c in range(256):
        out[ends[c] - n_small[c] : ends[c]] = direct[at : at + n_small[c]]
        at += n_small[c]
    free = heads.copy()

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[sort[before]]
        if not len(before):
            return
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        for s, e in zip(cuts, [*cuts[1:], len(first)], strict=True):
            c = first[s]
            out[free[c] : free[c] + e - s] = before[s:e]
            free[c] += e - s

    induce(np.array([n]))  # the empty suffix comes before all others
    for c in range(256):
        done = heads[c]
        while done < free[c]:  # induced suffixes of this bucket, until none of its own byte is added
            stop = free[c]
            induce(out[done:stop])
            done = stop
        last = tied[borders[c] : borders[c + 1]]
        out[free[c] : free[c] + len(last)] = last
        induce(last)
        induce(out[ends[c] - n_small[c] : ends[c]])
    return out


def solve(text: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, count: np.ndarray):
    """Ranges of windows of the segments whose bytes have a smaller document, or may have in the sender's batch."""
    parts = [text[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    text = np.concatenate(parts)
    size = end - start
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    windows = np.maximum(size - WIDTH + 1, 0)
    window = np.repeat(np.tile([True, False], len(size)), np.column_stack([windows, size - windows]).ravel())
    order = suffix_order(text, window)
    order = order[window[order]]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    same = np.ones(max(len(order) - 1, 0), bool)
    for d in (0, 8, 16, 24, 32, 40, WIDTH - 8):  # common prefix of neighbours, as far as WIDTH
        left = np.flatnonzero(same)
        same[left] = eight_bytes(padded, order[left] + d) == eight_bytes(padded, order[left + 1] + d)
    cuts = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.empty(len(text), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[owner[order]], cuts), np.diff(np.append(cuts, len(order))))
    at = np.flatnonzero(window)
    at = at[(least[at] < doc[owner[at]]) | (count[owner[at]] > 1)]
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    new = np.concatenate([[True], (np.diff(at) != 1) | (owner[at][1:] != owner[at][:-1]) | (least[at][1:] != least[at][:-1])])
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    base = end[owner[first]] - size[owner[first]]
    return owner[first], first - base, last - base, least[first]


RULES = Rules(WIDTH, PIECE, True, "uint8", lambda raw: np.frombuffer(raw, np.uint8), lambda t: _byte_values[t], solve)
RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
)
KEPT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])


def _runs(mark: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)])


def _null_ids(ids: np.ndarray) -> pa.Array:
    return pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64())


def _digest(batch, marks) -> pa.Table:
    rows = [] if batch is None else [
        (len(raw), int(m.sum()), len(_runs(m)), hashlib.sha256(np.frombuffer(raw, np.uint8)[~m].tobytes()).hexdigest()) for raw, m in zip(batch.raw, marks, strict=True)
    ]
    n, removed, spans, sha = list(zip(*rows, strict=True)) or [()] * 4
    ids = _null_ids(batch.ids) if batch is not None else pa.array([], pa.int64())
    return pa.table([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], RESULT.fieldNames())


def _kept(batch, marks) -> pa.Table:
    kept = [] if batch is None else [np.frombuffer(raw, np.uint8)[~m].tobytes() for raw, m in zip(batch.raw, marks, strict=True)]
    ids = _null_ids(batch.ids) if batch is not None else pa.array([], pa.int64())
    return pa.table([ids, pa.array(kept, pa.binary()), pa.array([_runs(m).tolist() for m in marks], pa.list_(pa.list_(pa.int64())))], KEPT.fieldNames())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, the bytes that are kept, and the removed spans [start, end) of every document."""
    return search(docs, RULES, _kept, KEPT)


def op4_suffix_dedup(spark, sf_dir):
    """Contract query: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return search(load(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text")), RULES, _digest, RESULT)


#: The contract in SQL, over the hexadecimal digits of the bytes.
OP4_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS p FROM t),
g AS (SELECT doc_id, p, substr(h, 2 * p - 1, 2) AS byte, CASE WHEN 2 * p + 98 <= length(h) THEN md5(substr(h, 2 * p - 1, 100)) END AS win FROM b),
f AS (SELECT doc_id, p, byte, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS hit FROM g),
m AS (SELECT doc_id, p, byte, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM m),
a AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, string_agg(CASE WHEN NOT gone THEN byte END, '' ORDER BY p) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""
