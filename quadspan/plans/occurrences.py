"""Occurrence index (F32): where terms stand in texts, as postings.

Lines are split into the written names (prefix:local) and what is between them, with Spark's own functions; the columns of
names follow from running sums of lengths, a batch of lines at a time.  A document's prefixes and terms go with its text, so
no posting is dealt to meet them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c, lit = F.col, F.lit
#: What comes before a name, its prefix, its local part.
NAME = r"(^|[\s(),;.\[\]{}])((?:[A-Za-z][A-Za-z0-9_-]*)?):([A-Za-z_][A-Za-z0-9_-]*)"


def occurrences(docs: DataFrame, prefixes: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """iri, doc, line, start, end (from 0), declares.  docs: doc, text; prefixes: doc, prefix, ns; declared: doc, iri of the
    terms that a document declares: the first name of a line does so.  Where they aren't given, docs may have them as columns:
    prefixes (an array of prefix, ns) and declared (an array of iri).  Comment lines and names without a known prefix have no
    postings."""
    if prefixes is not None:
        docs = docs.join(prefixes.groupBy("doc").agg(F.collect_list(F.struct("prefix", "ns")).alias("prefixes")), "doc")
    if declared is not None:
        docs = docs.join(declared.groupBy("doc").agg(F.collect_set("iri").alias("declared")), "doc", "left")
    own = ["declared"] if "declared" in docs.columns else []
    said = docs.filter("size(prefixes) > 0").select("doc", "prefixes", *own, F.posexplode(F.split("text", "\r?\n")).alias("line", "said")).filter(~F.ltrim("said").startswith("#") & c("said").contains(":"))
    found = lambda k: F.regexp_extract_all("said", lit(NAME), lit(k))
    lengths = lambda x: F.transform(x, lambda y: F.length(y))
    names = said.select("doc", "prefixes", *own, "line", F.length(F.regexp_extract("said", "^\\s*", 0)).alias("indent"), found(0).alias("whole"), lengths(found(1)).alias("lead"), found(2).alias("prefix"), found(3).alias("local"), lengths(F.split("said", NAME)).alias("gap"))
    sized = names.filter("size(whole) > 0").select("doc", "prefixes", *own, "line", "indent", "prefix", "local", "lead", lengths(c("whole")).alias("size"), F.slice("gap", lit(1), F.size("whole")).alias("gap"))
    kept = sized.select("doc", "prefixes", *own, "line", "indent", "prefix", "local", c("lead").alias("start"), c("size").alias("end"))
    rows = sized.mapInArrow(_places, kept.schema).select("doc", "prefixes", *own, "line", "indent", F.explode(F.arrays_zip("prefix", "local", "start", "end")).alias("x"))
    out = rows.select("doc", *own, "line", "indent", "x.local", "x.start", "x.end", F.explode(F.filter("prefixes", lambda y: y["prefix"] == c("x.prefix"))).alias("y"))
    out = out.select("doc", *own, "line", "indent", "start", "end", F.concat("y.ns", "local").alias("iri"))
    declares = (F.coalesce(F.array_contains("declared", c("iri")), lit(False)) & (c("start") == c("indent"))) if own else lit(False)
    return out.select("iri", "doc", "line", c("start").cast("long").alias("start"), c("end").cast("long").alias("end"), declares.alias("declares"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with lead, size and gap of their names (lists of lengths): start and end of each instead."""
    for b in batches:
        lead, size, gap = (b.column(n).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for n in ("lead", "size", "gap"))
        offsets = b.column("size").offsets.to_numpy()
        offsets = offsets - offsets[0]
        so_far = np.concatenate([[0], np.cumsum(gap + size)])
        end = so_far[1:] - np.repeat(so_far[offsets[:-1]], np.diff(offsets))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.astype(np.int32)))  # noqa: E731, B023
        rest = [n for n in b.schema.names if n not in ("lead", "size", "gap")]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), lists(end - size + lead), lists(end)], [*rest, "start", "end"])
