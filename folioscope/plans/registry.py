"""Queries by name, each with the SQL that gives the same rows (None where SQL cannot)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is defined twice")
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return keep


def add(name: str, f: Query, sql: str | None = None) -> None:
    query(sql, name)(f)


#: Tables whose rows are long texts, so that work on them is CPU-bound.
TEXTS = ("documents", "pages", "conversations")
#: Bytes of stored text for a task, so that neither its time nor a batch of its rows grows with the table.
TASK_BYTES = 4 << 20


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a table is read from; only their names and sizes are read."""
    files = df.sparkSession.read.format("binaryFile").load(df.inputFiles())
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]


def dealt_out(df: DataFrame, least: int = 1) -> DataFrame:
    """Rows with CPU-bound work, dealt out over the session's shuffle partitions or more."""
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. A task of texts reads about TASK_BYTES of files: a single file, which may be one row group, and files
    that would make fewer tasks than that are dealt out; a table of many small files is read in place."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXTS:
        tasks = math.ceil(stored_bytes(df) / TASK_BYTES)
        if len(df.inputFiles()) == 1 or tasks > df.rdd.getNumPartitions():
            return dealt_out(df, tasks)
    return df
