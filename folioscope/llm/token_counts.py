"""Token counts: the tokenizer's own counts, with huge documents encoded in overlapping chunks and spliced.

A document of up to CHUNK characters is encoded in one task. A longer one is cut into chunks of CHUNK characters that
reach OVERLAP characters into their neighbours; the chunks are dealt out over all tasks and encoded with offsets. The two
encodings of an overlap are resynchronised at a boundary that

* both have, with the same token on its right, and
* is proven stable: no normalisation, pre-token or special string can reach across it, so that each side is encoded alike
  whatever stands on the other (``stable`` gives the rule).

Up to that boundary the left chunk's tokens count, from it on the right one's. A document with an overlap in which no such
boundary is found goes to another round with chunks and overlaps WIDEN times as long; once a chunk holds all of it there
is nothing to splice, so every round ends and any text is counted exactly.

White space is such a boundary. So inside a task the words of short documents are encoded once each and their counts kept
(MEMO words at most, then anew); words of over LONGEST bytes are not kept.

The rule of ``stable`` is proven for tokenizers that normalise by NFC, white space to one space and lower case, and split
at white space, letters, single numbers and the rest; ``word_bpe_49k.json`` is one. The file is a parameter; special
strings in texts are what the library makes of them by default, no begin or end tokens are added.

Defined results: a null or empty text has no bytes and no tokens; very long texts take several tasks; repeated rows and
repeated or null doc_ids each get their own count; an empty table gives an empty result; other columns, whatever their
names, are kept in ``row``.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import load, materialize

VOCABULARY = "word_bpe_49k.json"
CHUNK = 1 << 15
OVERLAP = 256
WIDEN = 4
MARGIN = 32
MEMO = 1 << 20
LONGEST = 64
LIMIT = 2048

#: ASCII white space of the word rule.
SPACES = " \t\n\x0b\x0c\r"
#: Letters as they were in an early Unicode version, so that every library agrees on them.
EARLY = unicodedata.ucd_3_2_0


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """A tokenizer of this process with the counts of words met before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[bytes, int] = {}

    def numbers(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def counts(self, texts: list[str | None]) -> list[int]:
        """Numbers of tokens of whole texts, each different word encoded once."""
        out = []
        for text in texts:
            words = (text or "").encode().split()
            new = list({w for w in words if w not in self.memo})
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
                new = list(set(words))
            short = [w for w in new if len(w) <= LONGEST]
            self.memo.update(zip(short, self.numbers([w.decode() for w in short]), strict=True))
            once = {w: n for w, n in zip(long, self.numbers([w.decode() for w in long]), strict=True)} if (long := [w for w in new if len(w) > LONGEST]) else {}
            known = self.memo
            out.append(sum(once[w] if w in once else known[w] for w in words) if once else sum(map(known.__getitem__, words)))
        return out

    def boundaries(self, text: str, starts: list[int], ids: list[int], ends: list[int], low: int, high: int) -> list[dict]:
        """Stable boundaries of text from low to high (past MARGIN from either edge): their place, the token on the right, the tokens before."""
        out, before = [], 0
        for at in range(max(low, MARGIN), min(high, len(text) - MARGIN)):
            if not self.stable(text, at):
                continue
            while before < len(ends) and ends[before] <= at:
                before += 1
            if before == len(starts) or starts[before] >= at:  # no token reaches across
                out.append({"at": at, "id": ids[before] if before < len(ids) else -1, "before": before})
        return out

    def stable(self, text: str, at: int) -> bool:
        """No special string stands across the place, and its two characters part whatever is encoded there."""
        if not stable(text[at - 1], text[at]):
            return False
        near = text[max(at - MARGIN, 0) : at + MARGIN]
        here = min(at, MARGIN)
        return not any(here - len(s) < p < here for s in self.special for p in _places(near, s))


def _places(text: str, s: str) -> Iterator[int]:
    p = text.find(s)
    while p >= 0:
        yield p
        p = text.find(s, p + 1)


@functools.lru_cache(1 << 16)
def stable(x: str, y: str) -> bool:
    """Whether two neighbouring characters are in different pre-tokens whatever surrounds them.

    ASCII white space on either side; an ASCII digit, which is a pre-token of its own, beside an ASCII character, or on the
    right of any; or a letter and then an ASCII sign, since no pre-token goes on after its letters end. An ASCII character
    never composes with one before it. A letter is one that normalising and lower case leave a letter. A sign before a letter
    does not do, as it may start a contraction.
    """
    if x in SPACES or y in SPACES:
        return True
    if not y.isascii():
        return False
    if y in "0123456789" or x in "0123456789":
        return True
    if y.isalnum() or not y.isprintable():
        return False
    plain = unicodedata.normalize("NFC", x).lower()
    return all(EARLY.category(c).startswith("L") for c in plain)


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def short_counts(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text that one task encodes, as long."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(encoder(path or vocabulary_path()).counts(texts.to_pylist()), pa.int64())

    return count(text)


SEAM = pa.list_(pa.struct([("at", pa.int64()), ("id", pa.int64()), ("before", pa.int64())]))


def chunks(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """uid, k, start and piece: chunk k reaches from ``overlap`` characters before place k * chunk to as many after the next."""

    def cut(batches):
        schema = pa.schema([("uid", pa.int64()), ("k", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()), ("piece", pa.string())])
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = max(1, -(-len(text) // chunk))
                for first in range(0, n, 64):  # a few chunks at a time
                    ks = range(first, min(first + 64, n))
                    starts = [max(0, k * chunk - overlap) for k in ks]
                    pieces = [text[s : (k + 1) * chunk + overlap] for k, s in zip(ks, starts, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([[uid] * len(ks), list(ks), starts, [k == n - 1 for k in ks], pieces], schema, strict=True)], schema=schema)

    return huge.select("uid", "text").mapInArrow(cut, "uid long, k long, start long, last boolean, piece string")


def encoded(pieces: DataFrame, chunk: int, overlap: int, path: str | None) -> DataFrame:
    """uid, k, last, n (tokens of the piece) and the stable boundaries of its left and right overlap, as places in the document."""
    schema = "uid long, k long, last boolean, n long, " + ", ".join(f"{c} array<struct<at: long, id: long, before: long>>" for c in ("left", "right"))

    def encode(batches):
        for batch in batches:
            coder = encoder(path or vocabulary_path())
            uid, k, start, last, piece = (c.to_pylist() for c in batch.columns)
            n, left, right = [], [], []
            for kk, s, text in zip(k, start, piece, strict=True):
                e = coder.tokenizer.encode(text, add_special_tokens=False)
                ids, offsets = e.ids, e.offsets
                starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
                n.append(len(ids))
                for out, seam in ((left, kk * chunk), (right, (kk + 1) * chunk)):
                    low, high = max(seam - overlap + MARGIN, 0) - s, seam + overlap - MARGIN - s
                    found = coder.boundaries(text, starts, ids, ends, low, high) if seam else []
                    out.append([{**b, "at": b["at"] + s} for b in found])
            arrays = [batch.column(0), batch.column(1), batch.column(3), pa.array(n, pa.int64()), pa.array(left, SEAM), pa.array(right, SEAM)]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "k", "last", "n", "left", "right"])

    return pieces.mapInArrow(encode, schema)


def spliced(parts: DataFrame) -> DataFrame:
    """uid, n_tokens and open (the overlaps in which no common stable boundary was found) of documents encoded in chunks.

    A document's number is that of its last chunk and, for each overlap, the left chunk's tokens before the boundary less
    the right one's.
    """
    key = lambda c: F.transform(c, lambda b: F.struct(b["at"].alias("at"), b["id"].alias("id")))
    before = lambda c: F.get(F.filter(c, lambda b: b["at"] == F.col("at")), F.lit(0))["before"]
    mine = parts.select("uid", "k", "n", "last", "right")
    theirs = parts.filter("k > 0").select("uid", (F.col("k") - 1).alias("k"), F.col("left"))
    seams = mine.join(theirs, ["uid", "k"], "left").withColumn("at", F.array_min(F.array_intersect(key("right"), key("left")))["at"])
    tokens = F.when(F.col("last"), F.col("n")).otherwise(before("right") - before("left"))
    open_ = (~F.col("last") & F.col("at").isNull()).cast("long")
    return seams.groupBy("uid").agg(F.sum(tokens).alias("n_tokens"), F.sum(open_).alias("open"))


def huge_counts(huge: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """uid and n_tokens of all rows (uid, text; a written table), by rounds of wider overlaps until every one is spliced."""
    done = None
    while True:
        pieces = chunks(huge, chunk, overlap).repartition("uid", "k")
        found = materialize(spliced(materialize(encoded(pieces, chunk, overlap, path))))
        ready = found.filter("open = 0").select("uid", "n_tokens")
        done = ready if done is None else done.union(ready)
        if found.filter("open > 0").isEmpty():
            return done
        huge = materialize(huge.join(found.filter("open > 0").select("uid"), "uid", "left_semi"))
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def count_tokens(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """row (the columns of docs as a struct), n_bytes and n_tokens of every row of docs."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    long = F.coalesce(F.char_length("row.text") > chunk, F.lit(False))
    huge = materialize(rows.filter(long).select("row", "n_bytes", F.monotonically_increasing_id().alias("uid")))
    counts = huge_counts(huge.select("uid", F.col("row.text").alias("text")), path, chunk, overlap)
    short = rows.filter(~long).select("row", "n_bytes", short_counts(F.col("row.text"), path).alias("n_tokens"))
    return short.union(huge.join(counts, "uid").select("row", "n_bytes", "n_tokens"))


def op12_token_counts(spark, sf_dir):
    """Contract query: doc_id, n_bytes, n_tokens and over_limit of all documents."""
    counted = count_tokens(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
