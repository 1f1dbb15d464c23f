"""Incremental runs: what has a result is not done again.

The batch form is an anti join with the sink. The streaming form reads new files once, in micro-batches, keeps
what it has read in its checkpoint, and writes each batch to a folder of its own, or merges it into a ``KeyedStore``;
trigger availableNow ends when all is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.sources.store import KeyedStore


def remaining(wanted: DataFrame, sink: DataFrame, key: str) -> DataFrame:
    return wanted.join(sink.select(key), key, "left_anti")


def run_available(spark: SparkSession, source: str, schema: StructType | str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 1000) -> int:
    """Transforms the files that have come since the last run and appends each batch under its number, so that a
    batch that is run again replaces itself. Returns the number of batches."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        done.append(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def upsert_available(spark: SparkSession, source: str, schema: StructType | str, transform: Callable[[DataFrame], DataFrame], store: KeyedStore, checkpoint: str, files_per_batch: int = 1000) -> int:
    """Transforms the files that have come since the last run and merges them into a store by key. Returns the number of batches."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return store.follow(transform(stream), checkpoint)


def collect_until(rows: DataFrame, status: str, wanted: str, target: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first ``target`` rows of the wanted status, and the counts by status over all rows up to the one that fills
    the target (over all rows if it is not filled): what was tried, and what became of it. The order must be total."""
    place = F.struct(*order)
    hits = rows.filter(F.col(status) == wanted).orderBy(*order).limit(target)
    last = hits.agg(F.count(F.lit(1)).alias("_n"), F.max(place).alias("_last"))
    tried = rows.join(F.broadcast(last)).filter((F.col("_n") < target) | (place <= F.col("_last")))  # one row
    return hits, tried.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


class Collection:
    """collect_until over a stream: what is collected, and what was tried, is kept by micro-batch under a path.

    A batch takes what is still missing when the batches before it are counted, so a batch that is run again replaces
    itself and changes nothing else. Once the target is filled batches are passed over. The rows of later batches come
    after those of earlier ones; ``order`` is that inside a batch. The two tables are those of collect_until, however the
    stream is cut into batches."""

    def __init__(self, spark: SparkSession, path: str, status: str, wanted: str, target: int, order: list[str]):
        self.spark, self.path, self.status, self.wanted, self.target, self.order = spark, path, status, wanted, target, order

    def _stored(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def missing(self, number: int | None = None) -> int:
        """How many rows the target lacks, before a batch or in all."""
        stored = self._stored("hits")
        if stored is None:
            return self.target
        return self.target - (stored if number is None else stored.filter(F.col("batch") < number)).count()

    def add(self, rows: DataFrame, number: int) -> None:
        left = self.missing(number)
        hits, tried = collect_until(rows, self.status, self.wanted, left, self.order) if left > 0 else (rows.limit(0), rows.limit(0).groupBy(self.status).agg(F.count(F.lit(1)).alias("n")))
        hits.write.mode("overwrite").parquet(f"{self.path}/hits/batch={number}")
        tried.write.mode("overwrite").parquet(f"{self.path}/tried/batch={number}")

    def follow(self, stream: DataFrame, checkpoint: str) -> int:
        """Collects from what a stream has now; returns how many rows the target still lacks."""
        query = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.missing()

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """The rows collected, and the counts by status of all that was tried."""
        hits, tried = self._stored("hits"), self._stored("tried")
        if hits is None or tried is None:
            raise FileNotFoundError(self.path)
        return hits.drop("batch"), tried.groupBy(self.status).agg(F.sum("n").alias("n"))


def cached(wanted: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Results of compute for the wanted keys, of which those stored under path are not computed again.

    New results are appended to the store; a key that two runs compute at once is stored twice and read once."""
    spark = wanted.sparkSession
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    todo = wanted if stored is None else wanted.join(stored.select(key), key, "left_anti")
    compute(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path).dropDuplicates([key]).join(wanted.select(key), key, "left_semi")
