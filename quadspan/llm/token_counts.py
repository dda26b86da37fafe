"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but ids, big-endian and two bytes each (four for vocabularies beyond 65,536); documents end with
a separator id and nothing says where.  ``write_flat`` writes such files, ``count_tokens`` counts them: files are cut
into blocks, each block is searched for separators at once, and a block is summed up by the ids before its first
separator, the lengths between separators, and the ids behind the last.  A running sum of the separators of all earlier
blocks (a prefix scan: within each file, then over files) numbers the documents; pieces of a document that blocks or
files share have its number and are added up.

Documents are encoded where their rows lie, so no text is shuffled; the keys of a task's documents, in the order of its
files, are written by the same task into a folder beside them, so they fit whatever is run again.  Files are closed after
a bounded number of runs of documents: there are more of them for more data, not larger ones.  Spark's binary reader
takes a file at a time.

Defined cases: an empty file or folder has no documents; a separator at once after another ends an empty document; ids
behind the last separator are a document of their own; null or empty texts are written as a separator alone; repeated
rows, and rows without a key, are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, running, tidied, written
from .tokens import default_vocabulary, encoder
from .words import chunks

#: The id behind each document: the first that the vocabulary of 49,408 doesn't have, so no text holds it.
SEPARATOR = 49_408
#: Ids of a block.
BLOCK = 1 << 18
#: Runs of documents in a file; a run is encoded from two MB of text, or from one longer text.
RUNS = 16


def write_flat(docs: DataFrame, path: str, vocabulary: str | None = None, separator: int = SEPARATOR, width: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Documents as flat token files in path/kind=ids, and their keys, in the files' order, in path/kind=keys.

    Spark's text writer puts a line end behind each row.  The separator's last byte has to be zero: rows leave it out,
    and the line end is a zero byte."""
    if separator % 256 or separator >= 256**width:
        raise ValueError("the separator's last byte has to be zero, and it has to fit the ids' width")
    source = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, row = separator.to_bytes(4, "little"), 0
        for b in batches:
            for k, t in chunks(b.column(1)):
                ids = b"".join(x + end for x in encoder(source).encode([t.raw(i) for i in range(t.n)]))
                flat = np.frombuffer(ids, "<u4").astype(f">u{width}").tobytes()
                keys = "\0".join(json.dumps({"row": row + i, "key": x}) for i, x in enumerate(b.column(0).slice(k, t.n).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(["ids", "keys"]), pa.array([row, row], pa.int64()), pa.array([flat[:-1], keys.encode()], pa.binary())], ["kind", "row", "value"])
                row += t.n

    rows = docs.select(F.col(key).cast("string"), text).mapInArrow(tidied(encode), "kind string, row long, value binary").sortWithinPartitions("kind", "row")
    rows.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", RUNS).text(path)


def _task(file: Column) -> Column:
    """The number of the task that wrote a file."""
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("long")


def scan_blocks(spark: SparkSession, path: str, separator: int = SEPARATOR, block: int = BLOCK, width: int = 2) -> DataFrame:
    """file, block, n_ids, n_ends, head, tail, inner: for each block its ids and separators, the ids up to the first and
    behind the last separator, and the lengths between.  Files have the order of their tasks and, within one, of their
    numbers."""
    schema = "file long, block long, n_ids long, n_ends long, head long, tail long, inner array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                ids, rows = np.frombuffer(content.as_buffer(), f">u{width}"), []
                for k, at in enumerate(range(0, len(ids), block)):
                    part = ids[at : at + block]
                    ends = np.flatnonzero(part == separator)
                    n = len(ends)
                    rows.append({"file": file, "block": k, "n_ids": len(part), "n_ends": n, "head": int(ends[0]) + 1 if n else len(part), "tail": len(part) - 1 - int(ends[-1]) if n else 0, "inner": np.diff(ends).tolist()})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([*((c, pa.int64()) for c in ("file", "block", "n_ids", "n_ends", "head", "tail")), ("inner", pa.list_(pa.int64()))]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).filter(~F.col("path").contains("/kind=keys/"))
    file = _task(F.col("path")) * F.lit(1 << 20) + F.coalesce(F.regexp_extract("path", r"[.-]c(\d+)\.", 1).cast("long"), F.lit(0))
    return files.select(file.alias("file"), "content").mapInArrow(tidied(scan), schema)


def count_tokens(spark: SparkSession, path: str, separator: int = SEPARATOR, block: int = BLOCK, width: int = 2) -> DataFrame:
    """number, n_tokens: the ids of each document, its separator left out, numbered in the order of the files."""
    blocks = written(scan_blocks(spark, path, separator, block, width), "blocks")
    placed = running(blocks.select("file", "block", "n_ends", "head", "tail", "inner"), "file", ["block"], "n_ends", "first")
    inner = placed.select(F.col("first"), F.posexplode("inner").alias("k", "n")).select((F.col("first") + F.col("k") + 1).alias("number"), F.col("n"))
    head = placed.select(F.col("first").alias("number"), F.col("head").alias("n"), (F.col("n_ends") > 0).cast("int").alias("ended"))
    tail = placed.filter("n_ends > 0 and tail > 0").select((F.col("first") + F.col("n_ends")).alias("number"), F.col("tail").alias("n"), F.lit(0).alias("ended"))
    whole = inner.select("number", (F.col("n") - 1).alias("n_tokens"))
    # only the pieces at block ends have to meet
    pieces = head.unionByName(tail).groupBy("number").agg((F.sum("n") - F.max("ended")).alias("n_tokens"))
    return whole.unionByName(pieces)


def keys_of(spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """number, key: the keys of the documents in the order of the files."""
    lines = spark.read.schema("row long, key string, kind string").option("lineSep", "\0").json(path).filter("kind = 'keys'")
    lines = lines.select(_task(F.input_file_name()).alias("task"), "row", F.col("key").cast(kind).alias(key))
    counts = lines.groupBy("task").agg(F.count("*").alias("n"))
    # one row for each task that wrote
    before = running(counts.withColumn("all", F.lit(0)), "all", ["task"], "n", "before").select("task", "before")
    return lines.join(before, "task").select((F.col("before") + F.col("row")).alias("number"), key)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens: the documents' texts as flat token files, counted."""
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "flat")
    write_flat(docs, at)
    return keys_of(spark, at).join(count_tokens(spark, at), "number").select("doc_id", "n_tokens")
