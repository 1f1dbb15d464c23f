"""Phrase collocation mining: a merged count-min sketch first, exact counts of what survives it second.

1. Texts are shuffled once, into batches of about BATCH_BYTES dealt by row. A batch hashes its runs of one to ORDER words
   within pieces and counts them in a count-min sketch of two rows. A batch meets only some of the cells, so its sketch is
   sent as cells with counts, shelf by shelf; counts stop at ``least``, which no decision can tell.
2. The sketches are merged by shelves of 65,536 cells: each shelf adds up what all batches bring and replies to each which
   of its cells reach ``least``.
3. The batches, read again from the same shuffle, keep the runs whose cells both reach it and whose shorter runs do, and
   count those exactly, by the words themselves. A sketch never counts too little, so nothing frequent is lost.
4. Exact counts are summed over the batches; those of ``least`` and more are written. Every cut of a candidate looks up its
   two parts there (parts are at least as frequent as the whole), the lowest score counts, and candidates inside a longer
   one nearly as frequent go.

The sketch has a cell for each CELL_BYTES bytes of text (rounded up to a power of two), so its load stays the same as the
corpus grows; nothing of it is broadcast or sent to the driver. Per batch, length and cell met 3 bytes are shuffled. A shelf holds
about half a million entries whatever the size; a run that all batches hold brings it 3 bytes a batch. What a batch keeps is
one row for each different surviving run, so a word of every document costs one row a batch.

Defined results: words, pieces and case as the contract of op11 has them; null texts are empty; a null lang is the
language ``und``; repeated rows and copies count as often as they stand there; very long texts are read whole, in one batch;
ties are broken by the phrase, so they have one order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import load, materialize

ORDER = 4
LEAST = 30
TOP = 2000
SUBSUMED = 80
BATCH_BYTES = 8 << 20
CELL_BYTES = 16
SHELF = 16
#: Parts of a language's candidates that are ranked by themselves first.
PARTS = 64

#: Characters that part pieces; within a piece only space and tab are left to part words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO_BREAK = bytes.maketrans(BREAKS, b"\n" * len(BREAKS))
_LOW = (1 << 22) - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of a batch of texts in one sequence: number of each word, words left in its piece, names and hashes by number.

    A word's number stands for its language too, and pieces part texts, so runs within pieces are all there is to count.
    """

    def __init__(self, langs: list[str], texts: list[str | None]):
        by_lang: dict[str, tuple[dict, list, list]] = {}
        for lang, text in zip(langs, texts, strict=True):
            number, ids, sizes = by_lang.setdefault(lang, ({}, [], []))
            for piece in (text or "").encode().lower().translate(_TO_BREAK).split(b"\n"):
                if words := piece.split():
                    ids.extend([number.setdefault(w, len(number)) for w in words])
                    sizes.append(len(words))
        self.names: list[bytes] = []
        self.langs: list[str] = []
        self.totals = {lang: len(ids) for lang, (_, ids, _) in by_lang.items()}
        parts, left, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for lang, (number, ids, sizes) in by_lang.items():
            parts.append(np.array(ids, np.int64) + len(self.names))
            ends = np.cumsum(sizes)
            left.append(np.repeat(ends, sizes) - np.arange(len(ids)))
            seed = xxhash.xxh3_64_intdigest(lang.encode())
            seeds += [xxhash.xxh3_64_intdigest(w, seed) for w in number]
            self.names += number
            self.langs += [lang] * len(number)
        self.ids, self.left = np.concatenate(parts), np.concatenate(left)
        self.hash = np.array(seeds, np.uint64)

    def runs(self, order: int):
        """For each length up to ``order``: the places where a run starts, and the hashes of these runs."""
        word = self.hash[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        at, h = np.arange(len(self.ids)), word
        for m in range(1, order + 1):
            if m > 1:
                ok = self.left[at] >= m
                at, h = at[ok], h[ok]
                h = _mix(h * _A + word[at + m - 1] * _B)
            yield at, h


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each hash in the two rows; the second row's cells follow the first's."""
    mask, width = np.uint64((1 << bits) - 1), np.uint64(1 << bits)
    kind = np.uint32 if bits < 32 else np.uint64
    return (_mix(h) & mask).astype(kind), ((_mix(h * _B) & mask) + width).astype(kind)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Slices of data, one after the other, as binary values."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _read(table: pa.Table) -> Words:
    return Words(table["lang"].to_pylist(), table["text"].to_pylist())


def sketches(batches: DataFrame, bits: int, least: int, order: int = ORDER) -> DataFrame:
    """shelf, batch, places and counts: what each batch met, cell by cell."""

    def shelves(found: np.ndarray, batch: int) -> pa.Table:
        found.sort()
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        counts = np.minimum(np.diff(np.append(first, len(found))), least).astype(np.uint8 if least < 256 else np.uint32)
        found = found[first]
        shelf, start = np.unique(found >> found.dtype.type(SHELF), return_index=True)
        sizes = np.diff(np.append(start, len(found)))
        places = (found & found.dtype.type((1 << SHELF) - 1)).astype(np.uint16)
        return pa.table({"shelf": shelf.astype(np.int64), "batch": pa.array([batch] * len(shelf), pa.int64()), "places": _binary(places, sizes), "counts": _binary(counts, sizes)})

    def sketch(key, table):
        batch = key[0].as_py()
        return pa.concat_tables([shelves(c, batch) for _, h in _read(table).runs(order) for c in cells(h, bits)])

    return batches.groupBy("batch").applyInArrow(sketch, "shelf long, batch long, places binary, counts binary")


def replies(sketched: DataFrame, least: int) -> DataFrame:
    """shelf, batch and places: the cells of each batch that reach ``least`` in all batches together."""

    def merge(key, table):
        def joined(name, kind):
            return np.frombuffer(b"".join(table[name].to_pylist()), kind)

        places, counts = joined("places", np.uint16), joined("counts", np.uint8 if least < 256 else np.uint32)
        heavy = (np.bincount(places, counts, 1 << SHELF) >= least)[places]
        sizes = np.array([len(x) // 2 for x in table["places"].to_pylist()])
        kept = np.add.reduceat(heavy.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        out = pa.table({"shelf": table["shelf"], "batch": table["batch"], "places": _binary(places[heavy], kept)})
        return out.filter(pa.array(kept > 0))

    return sketched.groupBy("shelf").applyInArrow(merge, "shelf long, batch long, places binary")


class Heavy:
    """A set of cells: a table by low bits turns most others away, a search decides."""

    def __init__(self, table: pa.Table):
        places = table["places"].to_pylist()
        shelf = np.repeat(np.array(table["shelf"], np.uint64), [len(p) // 2 for p in places]) if places else np.zeros(0, np.uint64)
        self.cells = np.sort((shelf << np.uint64(SHELF)) | np.frombuffer(b"".join(places), np.uint16).astype(np.uint64))
        self.low = np.zeros(_LOW + 1, bool)
        self.low[(self.cells & np.uint64(_LOW)).astype(np.int64)] = True

    def holds(self, c: np.ndarray) -> np.ndarray:
        ok = self.low[c & c.dtype.type(_LOW)]
        maybe = np.flatnonzero(ok)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.cells, c[maybe]), len(self.cells) - 1)
            ok[maybe] = self.cells[at] == c[maybe]
        return ok


def survivors(batches: DataFrame, heavy: DataFrame, bits: int, order: int = ORDER) -> DataFrame:
    """lang, m (words), phrase and a: exact counts, batch by batch, of the runs that survive; m = 0 has the number of words."""

    def count(docs, reply):
        words, cell_set = _read(docs), Heavy(reply)
        n = len(words.ids)
        lang, m_, phrase, a = list(words.totals), [0] * len(words.totals), [""] * len(words.totals), list(words.totals.values())
        code = np.zeros(n, np.int64)
        for m, (at, h) in enumerate(words.runs(order), 1):
            if m > 1:
                ok = (code[at] >= 0) & (code[at + 1] >= 0)
                at, h = at[ok], h[ok]
            first, second = cells(h, bits)
            ok = cell_set.holds(first)
            ok[ok] = cell_set.holds(second[ok])
            at = at[ok]
            key = code[at] << 32 | words.ids[at + m - 1]
            _, index, number, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            code = np.full(n, -1, np.int64)
            code[at] = number
            for ids in words.ids[at[index][:, None] + np.arange(m)].tolist():
                phrase.append(b" ".join([words.names[i] for i in ids]).decode())
                lang.append(words.langs[ids[0]])
            m_ += [m] * len(times)
            a += times.tolist()
        return pa.table({"lang": pa.array(lang, pa.string()), "m": pa.array(m_, pa.int32()), "phrase": pa.array(phrase, pa.string()), "a": pa.array(a, pa.int64())})

    return batches.groupBy("batch").cogroup(heavy.groupBy("batch")).applyInArrow(count, "lang string, m int, phrase string, a long")


def phrase_counts(docs: DataFrame, least: int = LEAST, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A written table of lang, m, phrase and a: the runs of one to ORDER words found ``least`` times or more, and all words (m = 0)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(SHELF, (size // CELL_BYTES).bit_length())
    n = size // batch_bytes + 1
    tasks = max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # as many as there is work for
    batch = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n).cast("long"))
    batches = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", batch.alias("batch")).repartition(tasks, "batch")
    heavy = replies(sketches(batches, bits, least).repartition(tasks, "shelf"), least)
    exact = survivors(batches, heavy, bits)
    counts = exact.groupBy("lang", "m", "phrase").agg(F.sum("a").alias("a"))
    return materialize(counts.filter((F.col("m") == 0) | (F.col("a") >= least)))


def scored(counts: DataFrame) -> DataFrame:
    """lang, m, phrase, a, l, r and score of all candidates: the cut of the lowest score, of equal ones the first."""
    word = F.split("phrase", " ")
    part = lambda first, size: F.array_join(F.slice(word, first, size), " ")
    cuts = counts.filter("m >= 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "m", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    whole = counts.filter("m >= 1")
    left = whole.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = whole.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("CAST(a AS DECIMAL(28, 0)) * 2000000 div (CAST(l AS DECIMAL(28, 0)) + r)")  # exact past 64 bits
    best = cuts.groupBy("lang", "m", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "m", "phrase", "a", "b.l", "b.r", "b.score")


def subsumed(counts: DataFrame) -> DataFrame:
    """lang, phrase and f: the greatest count of a longer candidate that a candidate lies in."""
    word = F.split("phrase", " ")
    longer = counts.filter("m >= 3").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)))
    inner = longer.select("lang", F.array_join(F.slice(word, F.col("at"), F.col("size")), " ").alias("phrase"), "a")
    return inner.groupBy("lang", "phrase").agg(F.max("a").alias("f"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` collocations."""
    counts = phrase_counts(docs, least, batch_bytes)
    rows = scored(counts).join(subsumed(counts), ["lang", "phrase"], "left")
    rows = rows.filter(~F.coalesce(F.col("f").cast("decimal(28,0)") * 100 >= F.col("a").cast("decimal(28,0)") * SUBSUMED, F.lit(False)))
    rank = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))  # a language's first are among its parts' first
    rows = rows.withColumn("rank", rank("part")).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", rank()).filter(F.col("rank") <= top)
    totals = counts.filter("m = 0").select("lang", F.col("a").alias("n"))
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    """Contract query: the first 2,000 collocations of each language of documents."""
    return collocations(load(spark, sf_dir, "documents").select("lang", "text"))


def _gram(m: int) -> str:
    return " || ' ' || ".join(["w"] + [f"lead(w, {i}) OVER v" for i in range(1, m)])


OP11_SQL = f"""
WITH pieces AS (
  SELECT lang, piece, row_number() OVER () AS pid FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL)
), words AS (
  SELECT lang, pid, unnest(regexp_extract_all(piece, '[^\\x20\\x09]+')) AS w, generate_subscripts(regexp_extract_all(piece, '[^\\x20\\x09]+'), 1) AS pos
  FROM pieces
), runs AS (
  SELECT lang, {", ".join(f"{_gram(m)} AS p{m}" for m in range(1, ORDER + 1))} FROM words WINDOW v AS (PARTITION BY pid ORDER BY pos)
), f AS (
  {" UNION ALL ".join(f"SELECT lang, {m} AS m, p{m} AS phrase, count(*) AS a FROM runs WHERE p{m} IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}" for m in range(1, ORDER + 1))}
), candidate AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2),
cut AS (SELECT *, unnest(range(1, m)) AS k FROM candidate),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * c.a // (x.a::HUGEINT + y.a) AS BIGINT) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k+1:c.m], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), sized AS (SELECT lang, m, ws, a, unnest(range(2, m)) AS size FROM candidate WHERE m >= 3),
placed AS (SELECT lang, ws, a, size, unnest(range(1, m - size + 2)) AS start_at FROM sized),
inside AS (SELECT lang, array_to_string(ws[start_at:start_at+size-1], ' ') AS phrase, max(a) AS f FROM placed GROUP BY ALL),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, score
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE NOT coalesce(100::HUGEINT * f >= {SUBSUMED}::HUGEINT * b.a, false)
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= {TOP}
"""
