"""What the operators of this subpackage share: shared storage, word rules, distributed ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII whitespace characters.
#: ``bytes.split()`` cuts at exactly these, so Python code splits the UTF-8 bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: the session's spark.checkpoint.dir.

    Only where the session names none and runs in one process (a local test run) a temporary folder is chosen and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Delete the tables made so far. For sessions that go on: call it when the results have been written."""
    while _made:
        _delete(*_made.pop())


def _clean() -> None:
    try:
        release()
    except Exception:  # the session is gone; nothing is left to do at exit
        return


atexit.register(_clean)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts lineage: a lost executor costs a reread of the table, never the work before it.
    The tables of a session are deleted by release(), or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/folioscope-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text, as long; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def spread(key: Column, buckets: int) -> Column:
    """A number in 0..buckets-1 from an integer key, by one step of a Lehmer generator; null keys go to 0.

    The rule has only +, * and mod on values under 2**48, so any SQL engine repeats it exactly.
    """
    p = F.lit(2147483647).cast("long")
    mixed = F.pmod(F.pmod(key.cast("long"), p) * F.lit(48271).cast("long"), p)
    return F.coalesce(F.pmod(mixed, F.lit(buckets).cast("long")), F.lit(0)).cast("int")


def size_class(size: Column) -> Column:
    """Size class of about 8 % width: four times the fourth root, rounded down. sqrt is exact in IEEE arithmetic."""
    return F.floor(F.lit(4.0) * F.sqrt(F.sqrt(size.cast("double")))).cast("int")


#: monotonically_increasing_id() has the partition above this bit and the row's place in it below.
_PART_BITS = 33


def boxed(docs: DataFrame, **extra: Column) -> DataFrame:
    """docs as a written table of row (all columns as one struct, so that no name can clash), uid and ``extra``.

    The table is written once, so a uid names the same row however often it is read.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    return materialize(docs.select(F.struct(*own).alias("row"), *[c.alias(k) for k, c in extra.items()], F.monotonically_increasing_id().alias("uid")))


def in_order(rows: DataFrame, order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """rows with ``place``, from 0, in the total order, and before_<s>, the sum of s over all earlier rows.

    Rows are dealt to tasks by ranges of the whole order and sorted there, so no key, however frequent, fills a
    task as long as the last column of the order tells rows apart. Only the partitions' totals, one row each,
    are summed over in one place and sent to all tasks.
    """
    seq = F.col("_seq")
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright(seq, _PART_BITS))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_t_{s}") for s in sums])
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(earlier), zero).alias("_ahead"), *[F.coalesce(F.sum(f"_t_{s}").over(earlier), zero).alias(f"_a_{s}") for s in sums])
    out = placed.join(F.broadcast(totals), "_part")  # one row per shuffle partition
    out = out.withColumn("place", F.col("_ahead") + seq.bitwiseAND(F.lit((1 << _PART_BITS) - 1)))
    inside = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    for s in sums:
        out = out.withColumn(f"before_{s}", F.col(f"_a_{s}") + F.coalesce(F.sum(s).over(inside), zero))
    return out.drop("_part", "_seq", "_ahead", *[f"_a_{s}" for s in sums])
