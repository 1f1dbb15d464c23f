"""Sinks: upserts, routed and partitioned output, payloads, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.similarity import compare_runs
from folioscope.operators import postings
from folioscope.operators.evaluate import breakdown


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Rows of new replace rows of old with their key: a map-side maximum by generation, then by ``order`` (all columns,
    if there is none). Rows without a key are no two versions of one row and all stay."""
    columns = [c for c in new.columns if c != key]
    both = old.select(*new.columns).withColumn("_g", F.lit(0)).union(new.withColumn("_g", F.lit(1)))
    best = both.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("_g", *(order or []), F.struct(*columns).alias("_c"))).alias("_b"))
    kept = best.select(key, *[F.col(f"_b._c.{c}") for c in columns])
    return kept.union(both.filter(F.col(key).isNull()).select(key, *columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def route(df: DataFrame, path: str, status: str = "status") -> DataFrame:
    """Gold and quarantine in folders of their own; returns the counts."""
    write_partitioned(df, path, status)
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def payload(df: DataFrame, key: str, size: int = postings.SIZE) -> DataFrame:
    """key, block and data: JSON arrays of the rows of a value of key, in their order, ``size`` at most in one."""
    rest = [c for c in df.columns if c != key]
    blocks = postings.in_blocks(df, key, [F.col(c) for c in rest], size)
    return blocks.groupBy(key, "block").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("data"))


def inverted_index(df: DataFrame, key: str, labels: str, size: int = postings.SIZE) -> DataFrame:
    """label, block, n and the sorted ids of the block."""
    return postings.posting_lists(df, key, labels, size)


def publish(df: DataFrame, path: str, version: str) -> str:
    """A version of its own; an earlier one stays. Writing a version again gives the same."""
    target = f"{path}/version={version}"
    df.write.mode("overwrite").parquet(target)
    return target


def write_normalised_lines(df: DataFrame, column: str, path: str) -> None:
    """Text with CRLF as LF."""
    df.select(F.replace(column, F.lit("\r\n"), F.lit("\n"))).write.mode("overwrite").text(path)


def install(df: DataFrame, path: str) -> None:
    """Puts a table in the place of another, which stays beside it as <path>.backup. The new one is written in full
    before anything is moved; if the second move fails the old one is moved back."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place, fresh, backup = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".backup"))
    fs = place.getFileSystem(conf)
    df.write.mode("overwrite").parquet(path + ".new")
    had = fs.exists(place)
    if had:
        fs.delete(backup, True)
        if not fs.rename(place, backup):
            raise OSError(f"{path} could not be set aside")
    if not fs.rename(fresh, place):
        if had:
            fs.rename(backup, place)
        raise OSError(f"{path} could not be installed")


def inventory(df: DataFrame, key: str, labels: str, columns: list[str]) -> DataFrame:
    """Lines (part, place, line) of an inventory in Markdown: the ids of each label, a line for each block of them; a table
    of all rows with their labels; and how often each label and each number of labels occurs."""
    ids = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("`"), i.cast("string"), F.lit("`"))), " ")
    lists = inverted_index(df, key, labels)
    index = postings.directory(lists)
    place = F.concat("label", F.lit("\x01"), F.format_string("%012d", "block"))
    heading = F.when(F.col("block") == 0, F.concat(F.lit("### "), "label", F.lit(" ("), F.col("total").cast("string"), F.lit("): "), ids)).otherwise(ids)
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = f"| {key} | {' | '.join(columns)} | labels |"
    parts = [
        lists.join(index.select("label", F.col("n").alias("total")), "label").select(F.lit(0).alias("part"), place.alias("place"), heading.alias("line")),
        df.sparkSession.createDataFrame([(1, "0", head), (1, "1", "|" + "---|" * (len(columns) + 2))], "part int, place string, line string"),
        df.select(F.lit(2).alias("part"), cell(key).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", cell(key), *map(cell, columns), F.array_join(labels, ";")), F.lit(" |")).alias("line")),
        index.select(F.lit(3).alias("part"), F.format_string("%012d %s", F.lit(10**12 - 1) - F.col("n"), F.col("label")).alias("place"), F.format_string("- `%s` — %d", "label", "n").alias("line")),
        df.groupBy(F.size(F.array_distinct(labels)).alias("k")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(4).alias("part"), F.format_string("%012d", "k").alias("place"), F.format_string("%d flag: %d", "k", "n").alias("line")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def text_report(rows: DataFrame, keys: list[str], before: DataFrame | None = None, id: str = "id") -> DataFrame:
    """Lines (part, place, line) of the report of a run.

    rows: id, keys, produced, title_ok, title_sim, merged, recall, precision, f1, strict_f1, authors_ok, abstract_sim.
    before: id, title_ok, authors_ok of another run, which is compared with this one. All counts come from one pass
    over groupings and one over the whole; nothing is collected."""
    pct = lambda a, b: F.try_divide(F.lit(100.0) * a, b)
    groups = breakdown(rows, keys, F.col("title_ok"), F.col("title_sim"))
    lines = [
        groups.select(
            F.when(F.col("kind") == "total", 1).otherwise(2).alias("part"),
            F.concat_ws(" ", "kind", F.format_string("%012d", F.lit(10**12 - 1) - F.col("n")), "value").alias("place"),
            F.format_string("  %-22s %5d %8d %7.0f%% %8.3f", F.when(F.col("kind") == "total", "TOPLAM").otherwise(F.concat_ws(" ", "kind", "value")), "n", "solved", pct(F.col("solved"), F.col("n")), "mean_score").alias("line"),
        )
    ]
    one = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("produced").alias("produced"), F.count_if("merged").alias("merged"), *[F.avg(c).alias(c) for c in ("recall", "precision", "f1", "strict_f1")],
        F.count_if("authors_ok").alias("solved"), F.count_if(F.col("recall") == 0).alias("without"), F.avg("abstract_sim").alias("abstract"), F.count_if(F.col("abstract_sim") >= 0.70).alias("good"), F.count("abstract_sim").alias("known"),
    )
    text = F.array(
        F.struct(F.lit(0).alias("part"), F.format_string("cikti uretti: %d/%d", "produced", "n").alias("line")),
        F.struct(F.lit(3).alias("part"), F.format_string("cift dilli birlesik baslik: %d", "merged").alias("line")),
        F.struct(F.lit(4).alias("part"), F.format_string("  recall=%.3f  precision=%.3f  F1=%.3f  siki_F1=%.3f  cozulen=%d/%d  hic yazar yok=%d", "recall", "precision", "f1", "strict_f1", "solved", "n", "without").alias("line")),
        F.struct(F.lit(5).alias("part"), F.format_string("  ort_sim=%.3f  >=0.70: %d/%d", "abstract", "good", "known").alias("line")),
    )
    lines.append(one.select(F.inline(text)).select("part", F.lit("").alias("place"), "line"))
    if before is not None:
        both = rows.select(id, "title_ok", "authors_ok").join(before.select(id, F.col("title_ok").alias("t"), F.col("authors_ok").alias("a")), id)
        kinds = F.array(*[F.struct(F.lit(f).alias("field"), compare_runs(F.coalesce(F.col(b), F.lit(False)), F.coalesce(F.col(c), F.lit(False))).alias("change")) for f, b, c in (("BASLIK", "t", "title_ok"), ("YAZAR", "a", "authors_ok"))])
        changes = both.select(F.inline(kinds)).groupBy("field", "change").agg(F.count(F.lit(1)).alias("n"))
        lines.append(changes.select(F.lit(6).alias("part"), F.concat_ws(" ", "field", "change").alias("place"), F.format_string("  %-7s %s: %d", "field", "change", "n").alias("line")))
    out = lines[0]
    for x in lines[1:]:
        out = out.union(x)
    return out
