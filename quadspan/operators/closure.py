"""Transitive closure and property paths on distributed edge sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import new_path


def closure(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """x, y, hops: all pairs joined by one or more edges (x, y), with the fewest; cycles are fine.

    Distances double: a pair at a distance of 2^k + r, r up to 2^k, is one of exactly 2^k and one of r in a row, so each
    round joins the pairs at 2^k with all pairs found so far and drops those that are known.  The number of rounds is that
    of the binary digits of the longest distance.  Rounds are folders of one table, so what is known is never written
    again.  ``limit`` leaves out pairs further apart."""
    spark, at = edges.sparkSession, new_path(edges.sparkSession, "closure")
    pairs = edges.select("x", "y").distinct()
    pairs.withColumn("hops", F.lit(1)).write.parquet(f"{at}/round=0")
    schema = StructType([*(StructField(f.name, f.dataType) for f in pairs.schema), StructField("hops", IntegerType()), StructField("round", IntegerType())])
    k = 0
    while limit is None or 1 << k < limit:
        known = spark.read.schema(schema).parquet(at).drop("round")
        far = known.filter(F.col("hops") == 1 << k).select("x", F.col("y").alias("_m"), F.col("hops").alias("_h"))
        near = known.select(F.col("x").alias("_m"), "y", "hops")
        grown = far.join(near, "_m").groupBy("x", "y").agg(F.min(F.col("_h") + F.col("hops")).alias("hops"))
        k += 1
        grown.join(known.select("x", "y"), ["x", "y"], "left_anti").write.parquet(f"{at}/round={k}")
        if spark.read.schema(schema).parquet(at).filter(F.col("round") == k).isEmpty():
            break
    found = spark.read.schema(schema).parquet(at).drop("round")
    return found if limit is None else found.filter(F.col("hops") <= limit)


def reflexive(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """x, y of zero or more steps: the closure and each of the nodes (column x) with itself."""
    return pairs.select("x", "y").unionByName(nodes.select("x", F.col("x").alias("y"))).distinct()


def edges(triples: DataFrame) -> DataFrame:
    """x, y of triples between nodes."""
    return triples.filter("ok <> 2").select(F.col("s").alias("x"), F.col("o").alias("y"))


def sequence(a: DataFrame, b: DataFrame) -> DataFrame:
    """a/b"""
    right = b.select(F.col("x").alias("_m"), F.col("y").alias("_z"))
    return a.join(right, F.col("y") == F.col("_m")).select("x", F.col("_z").alias("y"))


def inverse(a: DataFrame) -> DataFrame:
    """^a"""
    return a.select(F.col("y").alias("x"), F.col("x").alias("y"))


def alternative(a: DataFrame, b: DataFrame) -> DataFrame:
    """a|b, a bag."""
    return a.select("x", "y").unionByName(b.select("x", "y"))


def optional(a: DataFrame, nodes: DataFrame) -> DataFrame:
    """a?"""
    return reflexive(a, nodes)


def negated(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """!(p|q)"""
    return edges(triples.filter(~F.col("p").isin(*predicates)))


def path_text(path) -> str:
    """How a path is written in findings: ("+", p) -> (p)+, ("|", p, q) -> p|q, ("/", p, q), ("^", p); a string is itself."""
    if isinstance(path, str):
        return path
    head, *rest = path
    parts = [path_text(p) for p in rest]
    return f"^({parts[0]})" if head == "^" else head.join(parts) if head in "|/" else f"({parts[0]}){head}"
