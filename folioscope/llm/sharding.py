"""Sharding by Hilbert-curve order: rows close in several metadata dimensions share a file.

Source, language and size class are cut into 16 bins of about equal row counts each; the three bin numbers
are the cell of a row, and cells are ordered along the Hilbert curve. Rows of equal text are a group: they take
the source and language of the least among them, so they are in one cell, and there the order is by size and
text, so a group is one stretch of the order. Ranks come from dealing the rows out by ranges of the whole
order, whose last column is a row number: a cell or a text that a third of all rows share is spread over many
tasks. Runs of the order are cut by one of two laws: ``rows`` (counts at most one apart) or ``bytes`` (sizes
near equal, at most one document over); a group is in more than one shard only where a border cuts it.

Nulls: a null text is an empty one; a null source or language is a value of its own, ordered last; null
doc_ids come first among equal texts. Equal rows may swap places. An empty table gives an empty result. Very
long texts are rows like any other. Other columns, whatever their names, are kept by ``shard_documents``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import boxed, in_order, materialize, size_class

BITS = 4
SHARDS = 24


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, dims), by the transpose method (Skilling 2004)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def bins(rows: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """dim, number, word, bin for each distinct value of source (dim 0), lang (1) and size class (2):
    2**bits bins of about equal row counts in the order of the values, nulls last."""
    no_word, no_number = F.lit(None).cast("string"), F.lit(None).cast("int")
    per = [rows.groupBy(F.lit(d).alias("dim"), no_number.alias("number"), F.col(c).alias("word")).agg(F.count(F.lit(1)).alias("c")) for d, c in enumerate(("source", "lang"))]
    per.append(rows.groupBy(F.lit(2).alias("dim"), F.col("cls").alias("number"), no_word.alias("word")).agg(F.count(F.lit(1)).alias("c")))
    values = per[0].union(per[1]).union(per[2]).withColumn("none", F.col("number").isNull() & F.col("word").isNull())
    at = in_order(values, ["dim", "none", "number", "word"], ("c",))
    before = F.col("before_c") - F.col("dim") * F.lit(n).cast("long")
    return at.select("dim", "number", "word", _div(before * (1 << bits), n).cast("int").alias("bin"))


def cells(rows: DataFrame, n: int) -> DataFrame:
    """rows with cell, the index of their bins along the Hilbert curve."""
    table = materialize(bins(rows, n))
    for d, column in enumerate(("source", "lang", "cls")):
        own = table.filter(F.col("dim") == d).select(F.col("number" if column == "cls" else "word").alias(f"_v{d}"), F.col("bin").alias(f"_bin{d}"))
        rows = rows.join(own, F.col(column).eqNullSafe(F.col(f"_v{d}"))).drop(f"_v{d}")
    side = 1 << BITS
    every = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    curve = rows.sparkSession.createDataFrame(list(enumerate(hilbert_index(every, BITS).tolist())), "_code int, cell int")
    rows = rows.withColumn("_code", (F.col("_bin0") * side + F.col("_bin1")) * side + F.col("_bin2"))
    return rows.join(F.broadcast(curve), "_code").drop("_code", "_bin0", "_bin1", "_bin2")  # 4,096 cells


def shard_rows(rows: DataFrame, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """Adds cell, shard and slot to rows (a written table with doc_id, source, lang, size, text_crc32, h, uid)."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    n, volume = int(total["n"]), int(total["bytes"])
    text = ["size", "text_crc32", "h"]
    shared = rows.groupBy(*text).agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("source", "lang")).alias("_of")).filter("_c > 1").drop("_c")
    lead = rows.select("doc_id", *text, "uid", F.struct("source", "lang").alias("_own")).join(shared, text, "left")
    lead = lead.withColumn("_of", F.coalesce("_of", "_own")).select("doc_id", *text, "uid", "_of.source", "_of.lang", size_class(F.col("size")).alias("cls"))
    order = ["cell", *text, "doc_id", "uid"]
    placed = cells(materialize(lead), n).select(*order)
    if law == "rows":
        out = in_order(placed, order)
        shard = _div(F.col("place") * shards, n)
        start = _div(F.col("shard") * n + (shards - 1), shards)
        out = out.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("place") - start)
    elif law == "bytes":
        out = in_order(placed, order, ("size",))
        out = materialize(out.withColumn("shard", _div(F.col("before_size") * shards, volume).cast("int")))
        starts = out.groupBy("shard").agg(F.min("place").alias("_start"))  # at most one row per shard
        out = out.join(F.broadcast(starts), "shard").withColumn("slot", F.col("place") - F.col("_start"))
    else:
        raise ValueError(f"unknown law {law!r}")
    return out.select("doc_id", "size", "text_crc32", "uid", "cell", "shard", "slot")


def _div(a: Column, b: int) -> Column:
    """Exact division of non-negative longs, rounded down; by 1 where the table is empty."""
    by = F.lit(max(b, 1)).cast("long")
    return F.floor((a - F.pmod(a, by)) / by).cast("long")


def shard_documents(docs: DataFrame, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """docs with cell, shard and slot added (names that the input already has are replaced).

    Rows meet their places by a row number of their own: texts are shuffled once, and no key repeats."""
    rows = boxed(docs, size=_size(), text_crc32=_crc(), h=_hash())
    light = rows.select("row.doc_id", "row.source", "row.lang", "size", "text_crc32", "h", "uid")
    placed = shard_rows(light, shards, law).select("uid", "cell", "shard", "slot")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("cell", "shard", "slot")]
    return rows.select("uid", "row").join(placed, "uid").select(*kept, "cell", "shard", "slot")


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1 << 18) -> None:
    """One folder per shard, rows in slot order: file statistics of all three dimensions stay narrow. A file is a run of slots,
    so tasks hold as many rows as a file, not as a shard."""
    run = F.floor(F.col("slot") / rows_per_file)
    sharded.repartition(F.col("shard"), run).sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def _size() -> Column:
    return F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + F.lit(8).cast("long")


def _crc() -> Column:
    return F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def op3_hilbert_shards(spark, sf_dir):
    """Contract query: all documents in shards 0 to 23, law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    light = docs.select("doc_id", "source", "lang", _size().alias("size"), _crc().alias("text_crc32"), _hash().alias("h"))
    out = shard_rows(materialize(light.withColumn("uid", F.monotonically_increasing_id())))
    none = F.lit(None).cast("int")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none.alias("grown_shard"), F.col("cell").cast("long").alias("hilbert_cell"))
