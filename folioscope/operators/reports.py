"""Measurement reports as text, the run registry, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How a report names its modes.
MODE_MARKS = (("strict", "Strict"), ("soft", "Soft"), ("levenshtein", "Levenshtein"), ("ratcliff", "Ratcliff"))
ROW = r"^\|\s*(\w+)\s*\|\s*([\d.]+)\s*\|\s*([\d.]+)\s*\|\s*([\d.]+)\s*\|\s*(\d+)\s*\|"
REGISTRY_SCHEMA = "file string, label string, corpus string, model string, version string, folded boolean, status string, note string"


def parse_reports(lines: DataFrame) -> DataFrame:
    """lines (file, pos, line) -> file, mode, field, p, r, f1, support. A mode holds until the next one is named."""
    mode = F.coalesce(*[F.when(F.col("line").contains(mark) & ~F.col("line").startswith("|"), F.lit(m)) for m, mark in MODE_MARKS])
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("mode", F.last(mode, ignorenulls=True).over(w)).filter(F.col("line").rlike(ROW) & F.col("mode").isNotNull())
    parts = [F.regexp_extract("line", ROW, i) for i in range(1, 6)]
    return rows.select("file", "mode", parts[0].alias("field"), *[p.cast("double").alias(n) for p, n in zip(parts[1:4], ("p", "r", "f1"), strict=True)], parts[4].cast("long").alias("support"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return parse_reports(whole)


def registered(scores: DataFrame, registry: DataFrame) -> DataFrame:
    """Only registered runs, with what the registry says of them. The registry is a dimension of a few rows per
    run; Spark broadcasts it if it measures it small."""
    return scores.join(registry, "file")


def unregistered(scores: DataFrame, registry: DataFrame) -> DataFrame:
    return scores.select("file").distinct().join(registry.select("file"), "file", "left_anti")


def to_baseline(scores: DataFrame, base: str) -> DataFrame:
    """Each run's F1 and its difference to the base run of the same mode and field."""
    b = scores.filter(F.col("file") == base).select("mode", "field", F.col("f1").alias("base"))
    return scores.join(b, ["mode", "field"], "left").withColumn("difference", F.round(F.col("f1") - F.col("base"), 4))
