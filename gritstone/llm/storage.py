"""Shared scratch tables: the one way operators here cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.session import shared_dir, ship_package


#: Rows of an Arrow batch: texts are whole and some are long, so the default of 10,000 rows would hold too much at once.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Get a session ready for Python operators: this package on the executors, sent once, and bounded Arrow batches.

    The bound stays set in the session, as plans read it when they run, which may be after an operator returns.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship_package(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gritstone/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later stages restart from files, not from lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**({"compression": "lz4"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gritstone_scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more; frames that it did not return are left alone."""
    for df in tables:
        if place := getattr(df, "_gritstone_scratch", None) if "_gritstone_scratch" in df.__dict__ else None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers that may be broadcast, and that one task may well take.
MOST_BROADCAST = 1 << 18
TASK_ROWS = 1 << 17


def small(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A table of a few numbers a row, marked for broadcast if its rows (counted, or at most ``rows``) are under the bound."""
    return F.broadcast(table) if (table.count() if rows is None else rows) <= MOST_BROADCAST else table


def few(table: DataFrame, rows: int) -> DataFrame:
    """The result of a shuffle of at most ``rows`` rows of a few numbers, in no more tasks than those are worth."""
    return table.coalesce(max(1, -(-rows // TASK_ROWS))) if rows < 64 * TASK_ROWS else table


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of finished steps: it acts when the driver collects garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucket_count(df: DataFrame, bytes_per_bucket: int = 16 << 20, per_partition: int = 4) -> int:
    """How many buckets a packed exchange of ``df`` needs: from the size of the tables that its plan reads, not from a count of rows.

    Leaves of unknown size (Spark gives those the largest number there is) add nothing: the session's partitions decide.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(s for s in sizes if s < 1 << 56)
    least = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(max(least, size // bytes_per_bucket))
