"""Token ids in ORC: stripes with integer run-length encoding, row indexes, and a Bloom filter on document ids.

``write_token_ids`` deals the texts out by ranges of the document id (texts that share one by ranges of a hash, equal ones
at random, so that no id has to fit into one task), encodes them, and writes one ORC file for each
range, ascending by id.  Stripes can be read in parallel, and a filter on doc_id skips files and stripes by their
minima and maxima, and row groups by the row index and the Bloom filter.  ``read_token_ids`` reads them back.

Defined cases: a null or empty text has only the end id; rows with one doc_id are kept each, ties in order of a hash
of their texts; a null doc_id comes first; an empty table gives a folder without rows; other columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, running, tidied, written
from .tokens import default_vocabulary, encoder
from .words import chunks

END_ID = 2
STRIPE_MB = 16
#: Rows of a file at most: more data makes more files.
FILE_ROWS = 200_000


def token_ids(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, key: str = "doc_id", text: str = "text", tie: str | None = None) -> DataFrame:
    """key, ids: each text's token ids and the end id; with a column of longs that breaks ties of the key, this too."""
    more = [tie] if tie else []
    path = vocabulary or default_vocabulary()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, end_id.to_bytes(4, "little")
        for b in batches:
            for k, t in chunks(b.column(1)):
                ids = [x + end for x in encode([t.raw(i) for i in range(t.n)])]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, t.n), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), *(b.column(2).slice(k, t.n) for _ in more)], [key, "ids", *more])

    return docs.select(key, text, *more).mapInArrow(tidied(run), f"{key} {kind}, ids array<int>" + "".join(f", {x} long" for x in more))


def write_token_ids(docs: DataFrame, path: str, files: int | None = None, vocabulary: str | None = None, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> None:
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(key, text, F.xxhash64(text).alias("_tie")).repartitionByRange(files, F.col(key), F.col("_tie"), F.rand(1))
    (
        token_ids(dealt, vocabulary, end_id, key, text, "_tie")
        .sortWithinPartitions(key, "_tie")
        .drop("_tie")
        .write.option("orc.bloom.filter.columns", key)
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(STRIPE_MB << 20))
        .option("orc.create.index", "true")
        .option("maxRecordsPerFile", FILE_ROWS)
        .option("compression", "zlib")
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    return spark.read.schema(f"{key} {kind}, ids array<int>").orc(path)


def token_report(spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of each document, from the files.  Files follow each other by their numbers, which
    ascend with the ids; within one, documents have the order of its rows.  Only keys, sizes and sums are shuffled."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            ids = b.column(1)
            bounds, values = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(values[4 * s : 4 * e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64()), b.column(2), b.column(3), pa.array(np.arange(seen, seen + b.num_rows))], [key, "n_tokens", "ids_crc32", "_file", "_block", "_row"])
            seen += b.num_rows

    name = F.input_file_name()
    _file = F.regexp_extract(name, r"part-(\d+)", 1).cast("long") * (1 << 20) + F.coalesce(F.regexp_extract(name, r"[.-]c(\d+)\.", 1).cast("long"), F.lit(0))
    rows = read_token_ids(spark, path, key, kind).select(key, "ids", _file.alias("_file"), F.input_file_block_start().alias("_block"))
    rows = written(rows.mapInArrow(tidied(sums), f"{key} {kind}, n_tokens long, ids_crc32 long, _file long, _block long, _row long"), "token_rows")
    return running(rows, "_file", ["_block", "_row"], "n_tokens", "start").select(key, "start", "n_tokens", "ids_crc32")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "token_ids")
    write_token_ids(docs, at)
    return token_report(spark, at)
