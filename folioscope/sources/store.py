"""A stored table that is updated by key, batch after batch.

The table is a folder of Parquet partitioned by bucket, a hash of the key. A batch rewrites only the buckets that it has
keys of: their rows and its own are merged to the latest row of each key, written beside, and put in place by a dynamic
partition overwrite; files of other buckets are not touched. The latest row is the greatest by the columns of ``order``, then
by batch number. So a batch that is run again, after a failure or a restart of the stream, changes nothing.

Rows without a key are no versions of each other: they all stay, and a batch that is run again replaces those it brought.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.scratch import written

BUCKETS = 64


class KeyedStore:
    """A table at ``path`` whose rows are found by ``key``; order: the columns that say which of two rows is later."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path, key, order, buckets

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def upsert(self, rows: DataFrame, number: int = 0) -> list[int]:
        """Merges a batch; returns the buckets that were rewritten (the number of buckets is a parameter)."""
        bucket = F.when(F.col(self.key).isNull(), -1).otherwise(F.pmod(F.xxhash64(self.key), F.lit(self.buckets).cast("long"))).cast("int")
        new = written(rows.withColumn("_batch", F.lit(number)).withColumn("_bucket", bucket))
        touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())
        if not touched:
            return []
        old = self._stored()
        if old is not None:
            again = F.col(self.key).isNull() & (F.col("_batch") == number)
            new = new.unionByName(old.filter(F.col("_bucket").isin(touched) & ~again), allowMissingColumns=True)
        columns = [c for c in new.columns if c not in (self.key, "_bucket")]
        latest = F.max(F.struct(*self.order, "_batch", F.struct(*columns).alias("_row"))).alias("_m")
        keyed = new.filter(F.col(self.key).isNotNull()).groupBy("_bucket", self.key).agg(latest)
        keyed = keyed.select(self.key, *[F.col(f"_m._row.{c}") for c in columns], "_bucket")
        merged = written(keyed.unionByName(new.filter(F.col(self.key).isNull())))  # the store is not read while it is written
        merged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        return touched

    def rows(self) -> DataFrame:
        """The latest row of each key."""
        stored = self._stored()
        if stored is None:
            raise FileNotFoundError(self.path)
        return stored.drop("_bucket", "_batch")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys."""
        return self.rows().join(keys.select(self.key).distinct(), self.key, "left_semi")

    def follow(self, stream: DataFrame, checkpoint: str) -> int:
        """Merges what a stream has now, micro-batch by micro-batch; returns the number of batches. The batch number of the
        stream is that of the store, so a batch that is delivered twice counts once."""
        done: list[int] = []

        def merge(batch: DataFrame, number: int) -> None:
            self.upsert(batch, number)
            done.append(number)

        query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return len(done)
