"""Checks again where something changed (F33): findings are stored with what each check read and a fingerprint of every
predicate; a run compares fingerprints and evaluates the checks only that read a changed predicate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TRIPLE, Graph
from ..storage import new_path

c, lit = F.col, F.lit
ANY = ""


class Recorder(Graph):
    """A graph that notes the predicates it is scanned for; ANY stands for a scan of all."""

    def __init__(self, inner: Graph):
        self.spark, self.inner, self.read = inner.spark, inner, set()

    @property
    def triples(self) -> DataFrame:
        return self.scan()

    def scan(self, *predicates: str, objects: Sequence[str] | None = None, datatypes: Sequence[str] | None = None) -> DataFrame:
        self.read |= set(predicates) or {ANY}
        return self.inner.scan(*predicates, objects=objects, datatypes=datatypes)


def fingerprints(g: Graph) -> DataFrame:
    """p, n, mark: the number of a predicate's triples and an order-free hash of them; one aggregation over the graph."""
    t = g.scan().select(*TRIPLE)
    row = F.xxhash64("s", "o", "ok", c("dt").isNull(), "dt", c("lang").isNull(), "lang")
    return t.groupBy("p").agg(F.count("*").alias("n"), F.concat_ws(":", F.bit_xor(row).cast("string"), F.sum(row.cast("decimal(38,0)")).cast("string")).alias("mark"))


class Ledger:
    """Stored findings of some checks over a graph that changes.  Each run writes a new version in the shared folder."""

    def __init__(self, spark: SparkSession, checks: dict[str, Callable[[Graph], DataFrame]]):
        self.spark, self.checks = spark, checks
        self.at: str | None = None
        self.ran: list[str] = []

    def _stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}")

    def stale(self, now: DataFrame) -> list[str]:
        """The checks that have to run: those not stored, and those that read a predicate whose fingerprint differs."""
        if self.at is None:
            return list(self.checks)
        old = self._stored("marks").select("p", c("n").alias("_n"), c("mark").alias("_mark"))
        changed = now.join(old, "p", "full").filter(~(c("n").eqNullSafe(c("_n")) & c("mark").eqNullSafe(c("_mark")))).select("p")
        reads = self._stored("reads")
        # one row for each check at most
        hit = reads.join(changed, "p", "left_semi").unionByName(reads.filter(c("p") == ANY).join(changed.limit(1).select(lit(ANY).alias("p")), "p", "left_semi")).select("check_id").distinct()
        known = {r[0] for r in reads.select("check_id").distinct().collect()}
        due = {r[0] for r in hit.collect()}
        return [id for id in self.checks if id in due or id not in known]

    def run(self, g: Graph) -> DataFrame:
        """check_id, focus_node, path, value, ran (whether this run worked it out)."""
        at = new_path(self.spark, "ledger")
        fingerprints(g).write.parquet(f"{at}/marks")
        self.ran = self.stale(self.spark.read.parquet(f"{at}/marks"))
        keep = [id for id in self.checks if id not in self.ran]
        reads: list[tuple[str, str]] = []
        for id in self.ran:
            watched = Recorder(g)
            found = self.checks[id](watched).select("focus_node", "path", "value")
            reads += [(id, p) for p in sorted(watched.read)]
            found.withColumn("ran", lit(True)).write.parquet(f"{at}/findings/check_id={id}")
        told = self.spark.createDataFrame(reads, "check_id string, p string")
        if self.at is not None and keep:
            told = told.unionByName(self._stored("reads").filter(c("check_id").isin(keep)))
            for id in keep:
                self._findings().filter(c("check_id") == id).select("focus_node", "path", "value", lit(False).alias("ran")).write.parquet(f"{at}/findings/check_id={id}")
        told.write.parquet(f"{at}/reads")
        self.at = at
        return self._findings()

    def _findings(self) -> DataFrame:
        return self.spark.read.schema("focus_node string, path string, value string, ran boolean, check_id string").parquet(f"{self.at}/findings").select("check_id", "focus_node", "path", "value", "ran")
