"""Line deduplication with levelled sorted runs of line hashes.

Documents arrive in batches, the largest ids first.  ``LineRuns`` keeps what earlier batches held as runs: tables of
(key, holder, n) sorted by key and bucketed by it, so that a new batch is merge-anti-joined with each run without
shuffling the run.  Keys that no run has are new, and their largest document of this batch is their holder.  The batch
is then added as a run of its own; as soon as a level has ``fan`` runs they are merged into one of the next level, so
that a batch meets at most (fan - 1) runs a level.  The keys that enough documents hold then lose their lines everywhere but in
their holder.

Only Spark functions are used.  A batch is aggregated by key before it is shuffled.  Where the frequent keys are counted
to be few they are broadcast; otherwise those that hold more than a ten-thousandth of all lines (at most 10,000, as the
lines are counted) are broadcast and the rest are joined by a shuffle whose groups are bounded by that share.

Defined cases: each row is a document; rows of one id with the same text lose the same lines; a null id counts as
smaller than all others; in its largest document a line stays as often as it stands there, and if several rows have
that id, in all of them; a null or empty text is one empty line; keys are told apart by 128-bit hashes; extra columns
stay, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .shared import Tables, delete, new_path

MIN_CHARS, MIN_DOCS = 20, 3
#: Batches that a table is dealt to, and runs of a level that are merged into one.
BATCHES, FAN = 8, 3
#: A key with more than this part of all lines is joined by a broadcast; there are at most as many.
HEAVY = 10_000
LOWEST = -(1 << 63)
RUN = "key binary, holder long, n long"
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


class LineRuns:
    """Levelled sorted runs of line keys: (key, holder, n), one row for each key of a run."""

    def __init__(self, spark: SparkSession, fan: int = FAN, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch whose key is in no run."""
        for run in self.runs():
            batch = batch.join(run.select("key"), "key", "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Adds (key, doc, n): documents with the key and the largest of them, which holds the key if no run has it."""
        keys = batch.groupBy("key").agg(F.max("doc").alias("holder"), F.sum("n").alias("n"))
        new = self.fresh(keys).select("key", "holder", F.lit(0).cast("long").alias("n"))
        self._put(0, self._written(keys.select("key", F.lit(None).cast("long").alias("holder"), "n"), new))

    def totals(self) -> DataFrame:
        """key, holder, n over all runs."""
        runs = [self._plain(run) for level in self.levels for run in level]
        return self._merged(runs) if runs else self.spark.createDataFrame([], RUN)

    def drop(self) -> None:
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = []

    def _put(self, level: int, run: tuple[str, str]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._written(*map(self._plain, old)))
            for run in old:
                self._drop(run)

    def _plain(self, run: tuple[str, str]) -> DataFrame:
        """A run as files: Spark 4.1 takes a union of bucketed tables for one that is partitioned by key, which it isn't."""
        return self.spark.read.schema(RUN).parquet(run[1])

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        dealt = reduce(DataFrame.unionByName, runs).repartition(self.buckets, "key")
        return dealt.groupBy("key").agg(F.max("holder").alias("holder"), F.sum("n").alias("n"))

    def _written(self, *entries: DataFrame) -> tuple[str, str]:
        name, at = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line_run")
        self._merged(list(entries)).sortWithinPartitions("key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", at).saveAsTable(name)
        return name, at

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        delete(self.spark, run[1])


def _bounds(docs: DataFrame, key: str, batches: int) -> list[int]:
    """Ids that cut the table into about equal batches, descending."""
    parts = [k / batches for k in range(batches - 1, 0, -1)]
    found = docs.agg(F.percentile_approx(key, F.array(*map(F.lit, parts)), 10_000).alias("at")).collect()[0]["at"]
    return list(dict.fromkeys(found or []))


def _lines(rows: DataFrame, min_chars: int, bounds: list[int]) -> DataFrame:
    """batch, doc, rid, key, pos, n for each line that may be dropped; n is 1 at a document's first of equal lines, else 0."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    keys = F.transform(split, line_key)
    # hashes of a document's lines in their order, so that equal ones are neighbours
    hashed = F.transform(keys, lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(F.unhex(F.md5(k)).alias("key"), i.alias("pos"))))
    batch = sum((F.when(F.col("doc") < b, 1).otherwise(0) for b in bounds), F.lit(0))
    at = rows.select("doc", "rid", batch.alias("batch"), F.sort_array(F.filter(hashed, lambda x: x.isNotNull())).alias("found"))
    flat = at.select("batch", "doc", "rid", F.posexplode("found").alias("i", "x"), "found")
    new = (F.col("i") == 0) | (F.get("found", F.col("i") - 1)["key"] != F.col("x.key"))
    return flat.select("batch", "doc", "rid", "x.key", "x.pos", F.when(new, 1).otherwise(0).cast("long").alias("n"))


def dropped_lines(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """doc, rid, gone: the places of each document's lines whose key another document holds."""
    few = shared.narrow(frequent)
    if few is not frequent:
        hits = lines.join(few, "key")
    else:
        share = frequent.agg(F.sum("n")).collect()[0][0] // HEAVY
        heavy, light = frequent.filter(F.col("n") > share), frequent.filter(F.col("n") <= share)
        marked = lines.join(F.broadcast(heavy), "key", "left")
        rest = marked.filter("holder is null").select(*lines.columns).join(light, "key")
        hits = marked.filter("holder is not null").select("doc", "rid", "pos", "holder").unionByName(rest.select("doc", "rid", "pos", "holder"))
    return hits.filter("doc <> holder").groupBy("doc", "rid").agg(F.collect_set("pos").alias("gone"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """The columns of docs as a struct ``row``, the kept text, n_lines before and n_dropped."""
    spark = docs.sparkSession
    tables, runs = Tables(spark), LineRuns(spark, fan)
    doc, said = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)), F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(doc.alias("doc"), F.xxhash64(said).alias("rid"), said.alias("text"))
    at = new_path(spark, "lines")
    bounds = _bounds(rows.select("doc"), "doc", batches)
    lines = _lines(rows, min_chars, bounds)
    lines.write.partitionBy("batch").option("compression", "zstd").parquet(at)
    stored = spark.read.schema(lines.select("doc", "rid", "key", "pos", "n", "batch").schema).parquet(at)
    for k in range(len(bounds) + 1):
        runs.add(stored.filter(F.col("batch") == k).select("key", "doc", "n"))
    frequent = tables.write(runs.totals().filter(F.col("n") >= min_docs), "frequent_lines")
    runs.drop()
    gone = dropped_lines(stored.select("doc", "rid", "key", "pos"), frequent)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), doc.alias("doc"), F.xxhash64(said).alias("rid"), F.split(said, "\n").alias("lines"))
    joined = whole.join(gone, ["doc", "rid"], "left")
    # positions are numbers, so array_except is linear in the lines of a document
    kept = joined.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>"))))
    return kept.select("row", F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n").alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share, dropped but for the one with the largest id."""
    found = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, rid, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT rid) >= 3),
m AS (SELECT k.*, f.holder IS NOT NULL AND f.holder <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id, rid
"""
