"""The shared folder, and running sums over ordered rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of a table that may be broadcast; beyond it the same join is a shuffle.
BROADCAST_ROWS = 1_000_000


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that isn't set (tests on one
    machine)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quadspan-")
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, as a table in the shared folder: its lineage ends there."""
    spark, at = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


class Tables:
    """Tables in the shared folder that one computation writes, each of which it drops once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        at = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.paths[id(out)] = (out, at)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            if df is not None and id(df) in self.paths:
                delete(self.spark, self.paths.pop(id(df))[1])


def delete(spark: SparkSession, at: str) -> None:
    """Deletes a folder that this library has written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def narrow(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if it has been counted to be small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; nulls count by their place."""
    columns = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*columns, *(c.isNull() for c in columns))


def running(df: DataFrame, part: str, order: list[str], size: str, out: str) -> DataFrame:
    """Adds the sum of ``size`` over all rows before each row, in the order (part, *order).

    ``part`` numbers bounded runs of rows (files, range partitions) in ascending order.  The sums of the runs, one row
    for each, are added up in one task; the rows within a run in a window of its own."""
    sums = df.groupBy(part).agg(F.sum(size).alias("_sum"))
    before = sums.select(part, F.coalesce(F.sum("_sum").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return rows.join(before, part).withColumn(out, F.col("_before") + F.col("_within")).drop("_before", "_within")


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with the memory that it has freed given back at its end: Python workers live on into later stages."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # the C library's own allocator, where it is glibc
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that no live plan refers to, before the next large step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
