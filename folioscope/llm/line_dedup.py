"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

The corpus is the sequence of lines of all documents in the order of (doc_id, line number). A line's place in it is one
number; a place without a line parts two documents, so no match crosses them. Texts are cut into lines once: the hashes
of the lines are written, and all that follows reads those. A round knows the rank of every line start by its first h
lines; ranks of 2h lines come from sorting pairs of ranks h lines apart. Starts whose rank nobody shares leave the race,
so each round sorts only what still repeats, and doubling goes on until no rank is shared.

Starts of one rank after h lines are an interval of the suffix array whose common prefix has h lines or more. A start
that is not the first of its interval in corpus order is a later copy. Of its last such interval the first start is
its source, and the length of their common prefix is made up of the ranks of the rounds, the longest first: one lookup
a round for the copy and one for the source. These runs end where the two texts part; a run that lies inside the run
of the line before, with the same source, is left out. Later copies of runs of MIN_LINES lines or more are deleted.

A run of fewer lines can hold as much text. Later copies of shorter runs of MIN_WORDS words or more are therefore
deleted too, and documents of fewer lines that equal an earlier one as a whole; for that the first ranks grow by one
line a round, so that no length below MIN_LINES is left out.

A rank's members are never brought together: a pair of ranks is counted with map-side sums and its new rank
is joined back, which Spark may split where one line, or the source of many copies, is very frequent.

Defined results: a null text has no lines; an empty text has one empty line; lines are compared as they
are, without one trailing carriage return; null doc_ids come last in corpus order; of rows that share doc_id and text
one is the document and the others lose all their lines, as later copies of it; very long texts take time linear in their lines, times the logarithm of the
longest repeated run; an empty table gives an empty result; other columns, whatever their names, are kept by
``drop_repeated_lines``.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import in_order, load, materialize, word_count

MIN_LINES = 3
MIN_WORDS = 50


def _name():
    """Name of a document: its doc_id and a hash of its text. As a struct it can be compared where doc_id is null."""
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).alias("did")


def _lines():
    return F.transform(F.split("text", "\n", -1), lambda x: F.when(x.endswith("\r"), F.left(x, F.char_length(x) - 1)).otherwise(x))


def hashed_documents(docs: DataFrame, sized: bool = False) -> DataFrame:
    """A written table of the documents with a text, each once: did, d (the place of its first line in the corpus) and lines.

    lines has two 64-bit hashes for each line, a and b; and w, its number of words, if ``sized``.
    """
    w = (lambda x: [word_count(x).alias("w")]) if sized else lambda x: []
    lines = F.transform(_lines(), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), *w(x)))
    rows = docs.filter("text IS NOT NULL").select(_name(), lines.alias("lines"), F.monotonically_increasing_id().alias("uid"))
    rows = materialize(rows)
    names = rows.groupBy("did").agg(F.min("uid").alias("uid"), F.min(F.size("lines") + 1).alias("n"))  # one place more than lines
    names = in_order(names, ["did"], ("n",)).select("uid", F.col("before_n").alias("d"))
    return materialize(rows.join(names, "uid").select("did", "d", "lines"))


def line_table(table: DataFrame) -> DataFrame:
    """The lines of ``hashed_documents``: d, g (the line's place in the corpus) and what lines has."""
    return table.select("d", F.posexplode("lines").alias("pos", "h")).select("d", (F.col("d") + F.col("pos")).alias("g"), "h.*")


def _rank(starts: DataFrame) -> DataFrame:
    """starts (d, g, a, b; a written table, as it is read twice) -> those whose pair (a, b) repeats, with its rank and first start.

    Ranks follow the order of the pairs: the pairs are range-partitioned and sorted, so the ids that Spark
    gives to rows rise with them. The table is written, which fixes the ids.
    """
    pairs = starts.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min("g").alias("first")).filter("c > 1").drop("c")
    pairs = materialize(pairs.orderBy("a", "b").withColumn("rank", F.monotonically_increasing_id()))
    return materialize(starts.join(pairs, ["a", "b"]).drop("a", "b"))


def _join_ranks(ranked: DataFrame, mate: DataFrame, at: int, sized: bool) -> DataFrame:
    """The ranks of runs that are a run of ``ranked`` and, ``at`` lines on, one of ``mate``."""
    w = ["w"] if sized else []
    mate = mate.select((F.col("g") - at).alias("g"), F.col("rank").alias("b"), *[F.col(c).alias("w_next") for c in w])
    pairs = ranked.select("d", "g", F.col("rank").alias("a"), *w).join(mate, "g")
    return _rank(materialize(pairs.withColumn("w", F.col("w") + F.col("w_next")).drop("w_next") if sized else pairs))


def _ranks(table: DataFrame, least: int, sized: bool) -> dict[int, DataFrame]:
    """Length -> the starts whose run of so many lines repeats, with rank and first; up to the last that any repeats.

    Below ``least`` the length grows by one line a round if ``sized``, and doubles otherwise.
    """
    ranks = {1: _rank(line_table(table))}
    have = 1
    while have < least:
        step = 1 if sized else min(have, least - have)
        mate, at = (ranks[1], have) if sized else (ranks[have], step)
        ranks[have + step] = _join_ranks(ranks[have], mate, at, sized)
        have += step
    while not (top := ranks[have]).isEmpty():
        ranks[2 * have] = _join_ranks(top.drop("w"), top, have, False)
        have *= 2
    del ranks[have]
    return ranks


def _runs(ranks: dict[int, DataFrame], least: int) -> DataFrame | None:
    """d, g, n (lines) and first of later copies of ``least`` lines or more; None if there are none."""
    long = [h for h in ranks if h >= least]
    if not long:
        return None
    late = reduce(DataFrame.union, [ranks[h].filter("first <> g").select("d", "g", F.lit(h).alias("n"), "first") for h in long])
    # a start's interval lies in its shorter one, so that the last interval has the greatest first, too
    late = late.groupBy("d", "g").agg(F.max("n").alias("n"), F.max("first").alias("first"))
    before = F.lag(F.struct("g", "first")).over(Window.partitionBy("d").orderBy("g"))
    inside = (F.col("before.g") == F.col("g") - 1) & (F.col("before.first") == F.col("first") - 1)
    runs = materialize(late.withColumn("before", before).filter(~F.coalesce(inside, F.lit(False))).drop("before"))
    for i, h in enumerate(sorted(ranks, reverse=True)[1:], 1):  # no common prefix is twice the last interval's length
        mine = ranks[h].select(F.col("g").alias("at"), F.col("rank").alias("r1"))
        theirs = ranks[h].select(F.col("g").alias("there"), F.col("rank").alias("r2"))
        runs = runs.withColumn("at", F.col("g") + F.col("n")).withColumn("there", F.col("first") + F.col("n"))
        runs = runs.join(mine, "at", "left").join(theirs, "there", "left")
        longer = F.col("n") + F.when(F.col("r1") == F.col("r2"), h).otherwise(0)
        runs = runs.select("d", "g", longer.alias("n"), "first")
        runs = materialize(runs) if i % 4 == 0 else runs
    return materialize(runs)


def _later_documents(table: DataFrame, least: int) -> DataFrame:
    """d, g (the first line) and n (lines) of documents of fewer than ``least`` lines that equal an earlier document."""
    short = table.filter(F.size("lines") < least).select("d", "lines")
    first = materialize(short.groupBy("lines").agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1"))
    return short.join(first, "lines").filter("first <> d").select("d", F.col("d").alias("g"), F.size("lines").alias("n"))


def later_copies(docs: DataFrame, least: int = MIN_LINES, words: int | None = MIN_WORDS) -> DataFrame:
    """did, start and length of the maximal stretches of lines that later copies of runs of ``least`` lines or more cover.

    With ``words`` also of shorter runs of so many words or more, and of shorter documents that are copies as a whole.
    Runs may overlap by nearly all their lines (one line many times in a row), so they are merged before any line is named.
    """
    sized = words is not None
    table = hashed_documents(docs, sized)
    ranks = _ranks(table, least, sized)
    runs = _runs(ranks, least)
    found = [table.limit(0).select("d", F.col("d").alias("g"), F.lit(0).alias("n"))] if runs is None else [runs.select("d", "g", "n")]
    if sized:
        found += [_later_documents(table, least)]
        found += [ranked.filter((F.col("first") != F.col("g")) & (F.col("w") >= words)).select("d", "g", F.lit(h).alias("n")) for h, ranked in ranks.items() if h < least]
    w = Window.partitionBy("d").orderBy("g")
    ends = F.max(F.col("g") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = reduce(DataFrame.union, found).groupBy("d", "g").agg(F.max("n").alias("n"))
    rows = rows.withColumn("new", F.coalesce(F.col("g") > ends, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    rows = rows.groupBy("d", "run").agg(F.min("g").alias("g"), F.max(F.col("g") + F.col("n")).alias("end"))
    rows = rows.join(table.select("did", "d"), "d")
    return rows.select("did", (F.col("g") - F.col("d")).cast("int").alias("start"), (F.col("end") - F.col("g")).cast("int").alias("length"))


def repeated_runs(docs: DataFrame, least: int = MIN_LINES) -> DataFrame:
    """Later copies of runs of ``least`` lines or more: doc_id, start, length, and first_doc_id, first_start of their source."""
    table = hashed_documents(docs.select("doc_id", "text"))
    ranks = _ranks(table, least, False)
    runs = _runs(ranks, least)
    if runs is None:
        runs, ranks = table.limit(0).select("d", F.col("d").alias("g"), F.lit(0).alias("n"), F.col("d").alias("first")), {1: line_table(table)}
    source = ranks[1].select(F.col("g").alias("first"), F.col("d").alias("from"))
    names = table.select("d", F.col("did.doc_id").alias("doc_id"))
    runs = runs.join(source, "first").join(names, "d").join(names.select(F.col("d").alias("from"), F.col("doc_id").alias("first_doc_id")), "from")
    place = lambda at, d: (F.col(at) - F.col(d)).cast("int")
    return runs.select("doc_id", place("g", "d").alias("start"), F.col("n").alias("length"), "first_doc_id", place("first", "from").alias("first_start"))


def removed_runs(docs: DataFrame, least: int = MIN_LINES, words: int | None = MIN_WORDS) -> DataFrame:
    """doc_id, start and length of the maximal stretches of lines that are deleted."""
    return later_copies(docs.select("doc_id", "text"), least, words).select("did.doc_id", "start", "length")


def mark_lines(docs: DataFrame, least: int = MIN_LINES, words: int | None = MIN_WORDS) -> DataFrame:
    """row (the columns of docs as a struct) and drop, the numbers of the lines to delete (null where there are none).

    Of rows that share doc_id and text the first one written is the document; the others are later copies of all of it.
    """
    lines = F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("length") - 1)))
    drop = later_copies(docs.select("doc_id", "text"), least, words).groupBy("did").agg(lines.alias("drop"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _name())
    again = docs.filter("text IS NOT NULL").groupBy(_name()).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("did")
    again = materialize(again)
    if again.isEmpty():
        return rows.join(drop, "did", "left").select("row", "drop")
    once = rows.join(again, "did", "left_anti").join(drop, "did", "left").select("row", "drop")
    many = materialize(rows.join(again, "did", "left_semi").withColumn("uid", F.monotonically_increasing_id()))
    first = many.groupBy("did").agg(F.min("uid").alias("first")).join(drop, "did", "left")
    whole = F.sequence(F.lit(0), F.size(F.split("row.text", "\n", -1)) - 1)
    return once.union(many.join(first, "did").select("row", F.when(F.col("uid") == F.col("first"), F.col("drop")).otherwise(whole)))


@F.pandas_udf(T.StringType())
def _left(text: pd.Series, drop: pd.Series) -> pd.Series:
    def one(t, d):
        if t is None or d is None:
            return t
        gone = set(d.tolist())
        return "\n".join([x for i, x in enumerate(t.split("\n")) if i not in gone])

    return pd.Series([one(t, d) for t, d in zip(text, drop, strict=True)], dtype="object")


def drop_repeated_lines(docs: DataFrame, least: int = MIN_LINES, words: int | None = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated line runs and of short documents deleted from text."""
    kept = _left("row.text", "drop")
    return mark_lines(docs, least, words).select(*[kept.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op5_line_runs(spark, sf_dir):
    """doc_id, n_lines, n_removed and kept_sha256 (of the kept lines joined by newlines) of all documents."""
    marked = mark_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n", -1)))
    return marked.select(
        "row.doc_id",
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(_left("row.text", "drop"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP5_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL
), plain AS (
  SELECT doc_id, pos, regexp_replace(line, chr(13) || '$', '') AS line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM lines
), runs AS (
  SELECT doc_id, pos, line AS r1, w AS w1,
         {", ".join(f"{' || chr(10) || '.join(['line'] + [f'lead(line, {i}) OVER v' for i in range(1, n)])} AS r{n}, {' + '.join(['w'] + [f'lead(w, {i}) OVER v' for i in range(1, n)])} AS w{n}" for n in range(2, MIN_LINES + 1))}
  FROM plain WINDOW v AS (PARTITION BY doc_id ORDER BY pos)
), numbered AS (
  {" UNION ALL ".join(f"SELECT doc_id, pos, {n} AS n, row_number() OVER (PARTITION BY r{n} ORDER BY doc_id, pos) AS nth FROM runs WHERE r{n} IS NOT NULL" + (f" AND w{n} >= {MIN_WORDS}" if n < MIN_LINES else "") for n in range(1, MIN_LINES + 1))}
), whole AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS nth
  FROM (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS t FROM plain GROUP BY doc_id HAVING count(*) < {MIN_LINES})
), gone AS (
  SELECT DISTINCT doc_id, pos + i AS pos FROM numbered, (SELECT unnest(range({MIN_LINES})) AS i) WHERE nth > 1 AND i < n
  UNION SELECT doc_id, i FROM whole, (SELECT unnest(range({MIN_LINES})) AS i) WHERE nth > 1 AND i < n
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS kept
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
