"""A corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Every stage takes any rows: null and empty texts are documents without words, which are clean, free of benchmark
items and near-duplicates of each other; null doc_ids and sources are values like any other; of equal rows one
stays after near-deduplication; an empty table goes through all stages as an empty table; very long texts are
read whole; further columns, whatever their names, are kept, but that the last stage sets cell, shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontaminate, mixing, sharding, simhash, toxicity
from folioscope.llm.common import load, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of sentence scores rejects go; a null or empty text is never rejected."""
    model = toxicity.train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: the one of the least doc_id, then of the least text hash. Rows of one doc_id
    but different texts are in groups of their own texts; rows without a doc_id are grouped like any other."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of the words of a benchmark item in tiles go; items of fewer than five words
    count where all their words stand in a row."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as systematic sampling drew it, so some rows go and some are repeated."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its place along the Hilbert curve: cell, shard and slot; equal texts are neighbours."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: Toxicity and SimHash cannot be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = materialize(docs) if i < len(STAGES) - 1 else docs
    return docs
