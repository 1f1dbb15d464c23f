"""Finding repeated windows of W tokens in a corpus, without loss and without skew.

A window's key is the least hash of its k-token pieces (its minimizer), of which 48 bits are kept and sent, so equal
windows have equal keys. Consecutive windows of equal least hash are a segment; each window is in exactly one segment. The search goes:

1. anchors: batches of documents give their distinct keys, each once, to buckets of keys;
2. shared: a bucket answers to each batch which of its keys can hold a repeated window;
3. segments: a batch sends the segments of those keys, equal ones once, to buckets;
4. solve: a bucket finds the repeated windows among its segments (this is the operator's own method);
5. apply: a batch marks the windows that the answers name.

What a batch sends is pre-aggregated, so a key that a third of all documents hold reaches its bucket once
per batch. A key with more than HOT segments is dealt anew: its windows go out one by one, by their own
hash, equal ones once per batch. Documents with an equal smaller text are settled by the text's 128-bit hash
in steps 1 and 2 and send nothing else. Texts are shuffled once, to batches by doc_id, and read from that
shuffle by steps 1, 3 and 5; a copy takes over what the solver decides for the document that stands for its text.
64-bit hashes only choose candidates. Segments are the same where 128-bit hashes of their tokens are (XXH3, which
unlike a polynomial modulo 2**64 has no known pairs of structured texts that clash); batches and buckets each take
them from the tokens. What is sent is a name of 96 bits, by which a batch knows its own segments again. Equality
of windows is decided by the solver.

Work is linear in what is sent: replies are sorted by batch once and cut. A key that all batches hold brings one
entry of 12 bytes per batch into one bucket: 0.2 MB at 30 GB of text, 6 MB at 1 TB, 600 MB at 100 TB, where
BATCH_BYTES should be raised with the memory of the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import spread

#: About so many bytes of text are a batch, and about so many keys or segment bytes a bucket. CHUNK windows are hashed at a time.
BATCH_BYTES = 2 << 20
BUCKET_KEYS = 1 << 19
HOT = 1 << 15
CHUNK = 1 << 14
NO_ID = np.int64(2**63 - 1)

#: Name of a segment: 32 bits of a hash from prefix sums, which finds it, and 64 of its XXH3 hash, which decide.
NAME = np.dtype([("find", "<u4"), ("sure", "<u8")])

_B = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(2**32 - 1)
_BINV = np.uint64(pow(int(_B), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i up to n at least."""
    if len(_powers[0]) <= n:
        for i, b in enumerate((_B, _BINV)):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + 1, b, np.uint64)]))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xE9846AF9B1A615D5)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


class Hashes:
    """Hashes of any stretch of a token sequence from prefix sums, modulo 2**64."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values))
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def all(self, n: int) -> np.ndarray:
        return self.some(n, 0, len(self.prefix) - n)

    def some(self, n: int, low: int, high: int) -> np.ndarray:
        """Of the stretches of n tokens that start from low to before high."""
        return (self.prefix[low + n : high + n] - self.prefix[low:high]) * self.down[low:high] if high > low else np.zeros(0, np.uint64)


@dataclass
class Rules:
    """A kind of search. tokens: text -> array of tokens, of the given type; values: tokens -> random 64-bit values.

    ordered: a window counts where a smaller doc_id has it; else where it occurs anywhere else.
    solve: (tokens, starts, ends, docs, counts) of distinct segments -> (segment, first, last, doc) of ranges of
    window offsets whose windows count, with the least doc that has them (0 if not ordered).
    """

    width: int
    piece: int
    ordered: bool
    dtype: str
    tokens: Callable
    values: Callable
    solve: Callable


class Batch:
    """The token sequences of a batch, one after the other, cut into segments."""

    def __init__(self, rules: Rules, table: pa.Table):
        self.rules = rules
        self.texts = [t or "" for t in table.column("text").to_pylist()]
        self.raw = [t.encode("utf-8", "surrogatepass") for t in self.texts]
        ids = table.column("doc_id")
        self.ids = ids.fill_null(int(NO_ID)).to_numpy().astype(np.int64)
        parts = [rules.tokens(r) for r in self.raw]
        size = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, rules.dtype)
        self.text_hash = np.array([divmod(xxhash.xxh3_128_intdigest(r), 2**64) for r in self.raw], np.uint64).reshape(-1, 2)

    def cut(self) -> None:
        """seg_start, seg_last (first and last window), key and doc row of every segment."""
        w = self.rules.width
        self.hashes = Hashes(self.rules.values(self.tokens))
        long = self.ends - self.starts >= w
        if not long.any():
            self.seg_start = self.seg_last = self.seg_doc = np.zeros(0, np.int64)
            self.key = self.least = np.zeros(0, np.uint64)
            self.valid = np.zeros(0, bool)
            return
        m, span = len(self.tokens) - w + 1, w - self.rules.piece + 1
        pieces, least = np.empty(m + span - 1, np.uint64), np.empty(m, np.uint64)
        for low in range(0, m, CHUNK):  # parts that stay in a core's cache
            high = min(low + CHUNK, m)
            part, have = mix(self.hashes.some(self.rules.piece, low, high + span - 1)), 1
            pieces[low : high + span - 1] = part
            while have < span:  # least of `have` pieces -> of up to twice as many
                step = min(have, span - have)
                part = np.minimum(part[:-step], part[step:])
                have += step
            least[low:high] = part
        edge = np.zeros(m + 1, np.int8)
        np.add.at(edge, self.starts[long], 1)
        np.add.at(edge, self.ends[long] - w + 1, -1)
        valid = np.cumsum(edge[:m], dtype=np.int8) > 0
        fresh = np.ones(m, bool)
        fresh[1:] = least[1:] != least[:-1]
        first = valid & fresh
        first[1:] |= valid[1:] & ~valid[:-1]
        first[0] = valid[0]
        last = valid.copy()
        last[:-1] &= first[1:] | ~valid[1:]
        self.seg_start, self.seg_last = np.flatnonzero(first), np.flatnonzero(last)
        self.least, self.valid = least[self.seg_start], valid
        self.key = self.least >> np.uint64(16)
        self.seg_doc = np.searchsorted(self.ends, self.seg_start, "right")
        self.pieces = pieces

    def own_repeats(self) -> np.ndarray:
        """Whether a segment has its key's piece twice or more: only then can two of its own windows be equal."""
        if not len(self.key):
            return np.zeros(0, bool)
        n = len(self.pieces) + 1
        known, which = np.unique(self.pieces, return_inverse=True)
        places = np.sort(which.astype(np.int64) * n + np.arange(n - 1))
        block = np.searchsorted(known, self.least) * n
        second = np.searchsorted(places, block + self.seg_start) + 1
        end = block + self.seg_last + self.rules.width - self.rules.piece
        return (second < len(places)) & (places[np.minimum(second, len(places) - 1)] <= end)

    def seg_hash(self, pick=slice(None)) -> np.ndarray:
        start, end = self.seg_start[pick], self.seg_last[pick] + self.rules.width
        return mix(self.hashes.of(start, end) + (end - start).astype(np.uint64))


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _six(keys: np.ndarray) -> bytes:
    """Keys as six bytes each."""
    return _bytes(np.ascontiguousarray(keys, "<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _keys(table: pa.Table) -> list[np.ndarray]:
    out = []
    for b in table.column("keys").to_pylist():
        wide = np.zeros((len(b) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
        out.append(wide.view("<u8").ravel())
    return out


def digests(tokens: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit hashes of stretches of tokens, two words each."""
    raw, size, of = memoryview(_bytes(tokens)), tokens.itemsize, xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([of(raw[s:e]) for s, e in zip((start * size).tolist(), (end * size).tolist(), strict=True)]), np.uint64).reshape(-1, 2)


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of x that have one of the known values (sorted, 32 bits): a table by low bits turns most away, a search decides."""
    low = np.uint32((1 << 20) - 1)
    table = np.zeros(1 << 20, bool)
    table[known & low] = True
    maybe = np.flatnonzero(table[x & low])
    if len(maybe):
        at = np.minimum(np.searchsorted(known, x[maybe]), len(known) - 1)
        maybe = maybe[known[at] == x[maybe]]
    return maybe


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _by(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by owner 0..n-1, and the n + 1 borders of the owners' stretches."""
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(n + 1))


def _split(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, and the buckets with the borders of their stretches."""
    order = np.argsort(bucket, kind="stable")
    at = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    return order, at[cuts], np.append(cuts, len(at))


KEYS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("texts", T.BinaryType())])
SHARED = T.StructType([T.StructField("batch", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("hot", T.BinaryType()), T.StructField("texts", T.BinaryType())])
SEGMENTS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.IntegerType()), T.StructField("names", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("docs", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("tokens", T.BinaryType())])
ANSWERS = T.StructType([T.StructField("batch", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("names", T.BinaryType()), T.StructField("ranges", T.BinaryType()), T.StructField("docs", T.BinaryType())])


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    kinds = {T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary(), T.LongType(): pa.int64()}
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema.fields, strict=True)], schema.fieldNames())


def _join(table: pa.Table, column: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype) for b in table.column(column).to_pylist()]


def anchors(rules: Rules, buckets: int, table: pa.Table) -> pa.Table:
    batch = table.column("batch")[0].as_py()
    b = Batch(rules, table)
    b.cut()
    order = np.lexsort((b.seg_doc, b.key)) if rules.ordered else np.argsort(b.key)
    key, doc = b.key[order], b.ids[b.seg_doc[order]] if rules.ordered else None
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(cuts, len(key)))
    if rules.ordered and len(cuts):
        multi = np.minimum.reduceat(doc, cuts) != np.maximum.reduceat(doc, cuts)
    else:
        again = b.own_repeats()[order]
        multi = (count > 1) | (np.logical_or.reduceat(again, cuts) if len(cuts) else False)
    keys, counts = key[cuts], np.where(multi, -count, count).astype(np.int32)
    order, names, borders = _split((keys % np.uint64(buckets)).astype(np.int64))
    rows = {int(k): [keys[order[s:e]], counts[order[s:e]], None] for k, s, e in zip(names, borders, borders[1:], strict=False)}
    order, names, borders = _split((b.text_hash[:, 1] % np.uint64(buckets)).astype(np.int64))
    for k, s, e in zip(names, borders, borders[1:], strict=False):
        pick = order[s:e]
        part = np.column_stack([b.text_hash[pick].view(np.int64), b.ids[pick]])
        rows.setdefault(int(k), [np.zeros(0, np.uint64), np.zeros(0, np.int32), None])[2] = part
    return _table([(k, batch, _six(r[0]), _bytes(r[1]), _bytes(r[2]) if r[2] is not None else b"") for k, r in sorted(rows.items())], KEYS)


def shared(rules: Rules, table: pa.Table) -> pa.Table:
    batches = table.column("batch").to_numpy()
    keys, counts = _keys(table), _join(table, "counts", np.int32)
    of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count, of = key[order], count[order], of[order]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(cuts, len(key)))
    if len(cuts):
        many = (size > 1) | (np.minimum.reduceat(count, cuts) < 0)
        hot = np.add.reduceat(np.abs(count).astype(np.int64), cuts) > HOT
        many, hot = np.repeat(many, size), np.repeat(hot, size)
        key, of, hot = key[many], of[many], hot[many]
    else:
        hot = np.zeros(0, bool)
    texts = [x.reshape(-1, 3) for x in _join(table, "texts", np.int64)]
    text_of = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    text = np.concatenate(texts)
    order = np.lexsort((text[:, 2], text[:, 1], text[:, 0]))
    text, text_of = text[order], text_of[order]
    if len(text):
        new = np.concatenate([[True], (text[1:, :2] != text[:-1, :2]).any(axis=1)])
        group = np.cumsum(new) - 1
        least, size = text[new, 2][group], np.bincount(group)[group]
        text, text_of = np.column_stack([text[:, :2], least, size])[size > 1], text_of[size > 1]
    else:
        text = text.reshape(-1, 3)[:, [0, 1, 2, 2]]
    rows = []
    mine, cut = _by(of, len(batches))
    own, text_cut = _by(text_of, len(batches))
    key, hot, text = key[mine], hot[mine].astype(np.uint8), text[own]
    for i, name in enumerate(batches.tolist()):
        s, e, a, b = cut[i], cut[i + 1], text_cut[i], text_cut[i + 1]
        if s < e or a < b:
            rows.append((name, _six(key[s:e]), _bytes(hot[s:e]), _bytes(text[a:b])))
    return _table(rows, SHARED)


def _copies(b: Batch, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document of the batch: the least doc_id with its text, and whether it stands for its text."""
    least, stands = b.ids.copy(), np.ones(len(b.ids), bool)
    size = np.ones(len(b.ids), np.int64)
    if len(text):
        known = {(r[0], r[1]): (r[2], r[3]) for r in text.tolist()}
        seen = set()
        for i, h in enumerate(map(tuple, b.text_hash.view(np.int64).tolist())):
            if h in known:
                least[i], size[i] = known[h]
                stands[i] = b.ids[i] == least[i] and h not in seen
                if stands[i]:
                    seen.add(h)
    return (least if b.rules.ordered else size), stands


def segments(rules: Rules, buckets: int, table: pa.Table, replies: pa.Table) -> pa.Table:
    if not table.num_rows or not replies.num_rows:
        return _table([], SEGMENTS)
    batch = table.column("batch")[0].as_py()
    b = Batch(rules, table)
    b.cut()
    w = rules.width
    text = np.concatenate(_join(replies, "texts", np.int64)).reshape(-1, 4)
    _, stands = _copies(b, text)
    keys, hot = np.concatenate(_keys(replies)), np.concatenate(_join(replies, "hot", np.uint8))
    order = np.argsort(keys)
    keys, hot = keys[order], hot[order]
    at = np.minimum(np.searchsorted(keys, b.key), max(len(keys) - 1, 0))
    ask = stands[b.seg_doc] & (keys[at] == b.key) if len(keys) else np.zeros(len(b.key), bool)
    warm = ask & (hot[at] == 0) if len(keys) else ask
    start, end = b.seg_start[warm], b.seg_last[warm] + w
    doc, route = b.seg_doc[warm], b.key[warm]
    names = b.seg_hash(warm)
    burning = np.flatnonzero(ask & ~warm)
    if len(burning):  # single windows, dealt by their own hash
        many = b.seg_last[burning] - b.seg_start[burning] + 1
        each = np.repeat(b.seg_start[burning] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        own = mix(b.hashes.of(each, each + w) + np.uint64(w))
        start, end = np.concatenate([start, each]), np.concatenate([end, each + w])
        doc, route, names = np.concatenate([doc, np.repeat(b.seg_doc[burning], many)]), np.concatenate([route, own]), np.concatenate([names, own])
    digest = digests(b.tokens, start, end)
    order = np.lexsort((b.ids[doc], digest[:, 1], digest[:, 0]))
    cuts = np.flatnonzero(_fresh(digest[order, 0], digest[order, 1]))
    count = np.diff(np.append(cuts, len(order))).astype(np.int64)
    pick = order[cuts]
    name = np.empty(len(names), NAME)
    name["find"], name["sure"] = names & _LOW, digest[:, 0]
    names = name
    bucket = (mix(route[pick]) % np.uint64(buckets)).astype(np.int64)
    sub, labels, borders = _split(bucket)
    rows = []
    for k, s, e in zip(labels, borders, borders[1:], strict=False):
        p = pick[sub[s:e]]
        tokens = np.concatenate([b.tokens[i:j] for i, j in zip(start[p].tolist(), end[p].tolist(), strict=True)])
        rows.append((int(k), batch, _bytes(names[p]), _bytes((end[p] - start[p]).astype(np.int64)), _bytes(b.ids[doc[p]]), _bytes(count[sub[s:e]]), _bytes(tokens)))
    if len(text) or len(burning):  # and whether single windows went out
        rows.append((-1 - batch, batch, b"", b"1" if len(burning) else b"", _bytes(text), b"", b""))
    return _table(rows, SEGMENTS)


def answers(rules: Rules, table: pa.Table) -> pa.Table:
    if table.column("bucket")[0].as_py() < 0:
        return _table([(b, 0, b"", s, d) for b, s, d in zip(*(table.column(c).to_pylist() for c in ("batch", "sizes", "docs")), strict=True)], ANSWERS)
    batches = table.column("batch").to_numpy()
    names, sizes = _join(table, "names", NAME), _join(table, "sizes", np.int64)
    of = np.repeat(np.arange(len(names)), [len(x) for x in names])
    name, size = np.concatenate(names), np.concatenate(sizes)
    doc, count = np.concatenate(_join(table, "docs", np.int64)), np.concatenate(_join(table, "counts", np.int64))
    tokens = np.concatenate(_join(table, "tokens", np.dtype(rules.dtype)))
    end = np.cumsum(size)
    digest = digests(tokens, end - size, end)
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    fresh = _fresh(digest[order, 0], digest[order, 1])
    cuts = np.flatnonzero(fresh)
    group = np.empty(len(name), np.int64)
    group[order] = np.cumsum(fresh) - 1
    first = order[cuts]
    segment, low, high, least = rules.solve(tokens, end[first] - size[first], end[first], np.minimum.reduceat(doc[order], cuts), np.add.reduceat(count[order], cuts))
    rows = []
    by = np.argsort(segment, kind="stable")
    segment, low, high, least = segment[by], low[by], high[by], least[by]
    lo, hi = np.searchsorted(segment, group, "left"), np.searchsorted(segment, group, "right")
    known = np.flatnonzero(hi > lo)
    known = known[np.argsort(of[known], kind="stable")]
    n = hi[known] - lo[known]
    pick = np.repeat(lo[known] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    name, ranges, least, of = np.repeat(name[known], n), np.column_stack([low[pick], high[pick]]).astype(np.int32), least[pick], np.repeat(of[known], n)
    cut = np.searchsorted(of, np.arange(len(batches) + 1))
    for batch, s, e in zip(batches.tolist(), cut[:-1], cut[1:], strict=True):
        if s < e:
            rows.append((batch, 1, _bytes(name[s:e]), _bytes(ranges[s:e]), _bytes(least[s:e])))
    return _table(rows, ANSWERS)


def covered(rules: Rules, table: pa.Table, replies: pa.Table) -> tuple[Batch, list[np.ndarray]]:
    """For each document of a batch: which of its tokens are in a window that counts."""
    b = Batch(rules, table)
    b.cut()
    w = rules.width
    marks = np.zeros(len(b.tokens) + 1, np.int32)
    settled, single = [], False
    for kind, sent, docs in zip(*(replies.column(c).to_pylist() for c in ("kind", "ranges", "docs")), strict=True):
        if kind == 0:
            settled.append(np.frombuffer(docs, np.int64).reshape(-1, 4))
            single |= sent == b"1"
    other, stands = _copies(b, np.concatenate(settled) if settled else np.zeros((0, 4), np.int64))
    asked = replies.filter(pa.compute.equal(replies.column("kind"), 1)) if replies.num_rows else replies
    if asked.num_rows:
        names = np.concatenate(_join(asked, "names", NAME))
        ranges = np.concatenate(_join(asked, "ranges", np.int32)).reshape(-1, 2).astype(np.int64)
        least = np.concatenate(_join(asked, "docs", np.int64))
        order = np.argsort(names["find"], kind="stable")
        names, ranges, least = names[order], ranges[order], least[order]
        name = np.ascontiguousarray(names["find"])
        whole, windows = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if single:  # windows of hot keys have their own names
            whole = (mix(b.hashes.all(w) + np.uint64(w)) & _LOW).astype(np.uint32)
            windows = among(whole[: len(b.valid)], name)
            windows = windows[b.valid[windows]]
        starts = np.concatenate([b.seg_start, windows])
        docs = np.concatenate([b.seg_doc, np.searchsorted(b.ends, windows, "right")])
        own = np.concatenate([(b.seg_hash() & _LOW).astype(np.uint32), whole[windows]])
        lo, hi = np.searchsorted(name, own, "left"), np.searchsorted(name, own, "right")
        n = hi - lo
        pick = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        start, doc = np.repeat(starts, n), np.repeat(docs, n)
        found = np.flatnonzero(n)
        length = np.concatenate([b.seg_last + w - b.seg_start, np.full(len(windows), w)])[found]
        use = np.repeat(digests(b.tokens, starts[found], starts[found] + length)[:, 0], n[found]) == names["sure"][pick]
        if rules.ordered:
            use &= least[pick] < b.ids[doc]
        np.add.at(marks, start[use] + ranges[pick[use], 0], 1)
        np.add.at(marks, start[use] + ranges[pick[use], 1] + w, -1)
    inside = np.cumsum(marks, dtype=np.int32) > 0
    out = []
    for i, (s, e) in enumerate(zip(b.starts.tolist(), b.ends.tolist(), strict=True)):
        at = inside[s:e]
        copy = other[i] < b.ids[i] if rules.ordered else other[i] > 1
        out.append(np.ones(e - s, bool) if copy and e - s >= w else at)
    return b, out


def search(docs: DataFrame, rules: Rules, finish: Callable, schema: T.StructType) -> DataFrame:
    """Runs the search over docs (doc_id, text); finish(batch, marks) makes the rows of each batch."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    volume = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    batches = max(1, math.ceil(volume / BATCH_BYTES))
    buckets = max(1, math.ceil(volume / (12 * BUCKET_KEYS)))
    own = spread(F.coalesce(F.col("doc_id"), F.xxhash64("text")), batches)
    rows = docs.withColumn("batch", own)
    found = rows.groupBy("batch").applyInArrow(lambda t: anchors(rules, buckets, t), KEYS)
    found = found.groupBy("bucket").applyInArrow(lambda t: shared(rules, t), SHARED)
    found = rows.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(lambda a, b: segments(rules, buckets, a, b), SEGMENTS)
    found = found.groupBy("bucket").applyInArrow(lambda t: answers(rules, t), ANSWERS)

    def last(a: pa.Table, b: pa.Table) -> pa.Table:
        return finish(*covered(rules, a, b)) if a.num_rows else finish(None, [])

    return rows.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(last, schema)
