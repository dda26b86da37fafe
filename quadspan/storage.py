"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import TRIPLE, Dataset, Graph


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that isn't set, on one machine only (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quadspan-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _write_folders(df: DataFrame, at: str, *by: str) -> None:
    """df as a folder for each value of some columns.  A task keeps the files of its few folders open, so nothing is sorted by
    folder; beyond that number Spark sorts the rest."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = df.sparkSession.conf.get(name)
    df.sparkSession.conf.set(name, "64")
    try:
        df.write.partitionBy(*by).option("compression", "zstd").option("parquet.block.size", 1 << 24).parquet(at)
    finally:
        df.sparkSession.conf.set(name, before)


def stored(g: Graph) -> Graph:
    """The graph as a table in the shared folder, a folder for each predicate: scans of some predicates read those only,
    and triples that several rows give are there once.  For graphs whose predicates are a vocabulary."""
    at = new_path(g.spark, "graph")
    _write_folders(g.distinct(), at, "p")
    out = Graph(g.spark.read.schema(g.scan().select(*TRIPLE).schema).parquet(at), distinct=True)
    out.near, out.alike = g, g.alike
    return out


def stored_dataset(quads: DataFrame, distinct: bool = False) -> Dataset:
    """Quads as a table in the shared folder with a folder for each graph and predicate, so that a pattern reads those of
    its graph and predicate only; each quad is there once (distinct: they are so already).  Quads without a graph are in the default graph."""
    spark, at = quads.sparkSession, new_path(quads.sparkSession, "dataset")
    rows = quads.select(*TRIPLE, "g")
    _write_folders(rows if distinct else rows.distinct(), at, "g", "p")

    def read(predicates: Sequence[str], graphs: Sequence[str] | None) -> DataFrame:
        found = spark.read.schema(rows.schema).parquet(at)
        found = found.filter(F.col("p").isin(*predicates)) if predicates else found
        return (found.filter(F.col("g").isin(*graphs)) if graphs is not None else found).select(*TRIPLE, "g")

    return Dataset(spark, read, lambda predicates: read(predicates, None))


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: columns are compressed there, unlike a checkpoint's rows."""
    return Scratch(df.sparkSession).put(df, "cut")


class Scratch:
    """Tables in the shared folder that one computation writes; each ends its plan's lineage, and is deleted when dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, {}

    def put(self, df: DataFrame, name: str = "scratch") -> DataFrame:
        at = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.at[id(out)] = (out, at)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if id(df) in self.at:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at.pop(id(df))[1])
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """Drops all tables but df."""
        self.drop(*(t for t, _ in list(self.at.values()) if t is not df))
        return df
