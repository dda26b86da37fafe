"""N-Triples and N-Quads: splittable reading and distributed writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
#: Lines of a file that is written.
FILE_LINES = 500_000
_NODE = "<[^>]*>|_:[^\\s<>\"]+"
LINE = f"^\\s*({_NODE})\\s*(<[^>]*>)\\s*(<[^>]*>|_:[^\\s<>\"]+|\"(?:[^\"\\\\]|\\\\.)*\"(?:\\^\\^<[^>]*>|@[A-Za-z0-9-]+)?)\\s*({_NODE})?\\s*\\.\\s*(?:#.*)?$"
_IRI, _BLANK = "<([^>]*)>", "(_:[^\\s<>\"]+)"
#: The same lines with a group for each part: IRI or blank subject, predicate, IRI or blank object, or a quote, what is said,
#: datatype and language; a bracket, IRI or blank graph.  What is said is gone through without steps back.
PARTS = f"^\\s*(?:{_IRI}|{_BLANK})\\s*{_IRI}\\s*(?:{_IRI}|{_BLANK}|(\")([^\"\\\\]*+(?:\\\\.[^\"\\\\]*+)*+)\"(?:\\^\\^{_IRI}|@([A-Za-z0-9-]+))?)\\s*(?:(<)([^>]*)>|{_BLANK})?\\s*\\.\\s*(?:#.*)?$"
_ESCAPES = (("t", "\t"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("f", "\f"), ('"', '"'), ("'", "'"))


def _unescape(x: Column) -> Column:
    """Backslash escapes, by replacement; a doubled backslash is kept apart meanwhile."""
    x = F.replace(x, F.lit("\\\\"), F.lit("\u0001"))
    for name, char in _ESCAPES:
        x = F.replace(x, F.lit("\\" + name), F.lit(char))
    # \\uXXXX and \\UXXXXXXXX: piece by piece
    pieces = F.split(x, "(?=\\\\u[0-9A-Fa-f]{4}|\\\\U[0-9A-Fa-f]{8})")
    code = lambda p, n: F.decode(F.unhex(F.lpad(F.substring(p, 3, n), 8, "0")), "UTF-32")
    made = F.transform(pieces, lambda p: F.when(p.rlike("^\\\\u[0-9A-Fa-f]{4}"), F.concat(code(p, 4), F.substring(p, 7, 1 << 30))).when(p.rlike("^\\\\U[0-9A-Fa-f]{8}"), F.concat(code(p, 8), F.substring(p, 11, 1 << 30))).otherwise(p))
    x = F.when(x.contains("\\u") | x.contains("\\U"), F.array_join(made, "")).otherwise(x)
    return F.replace(x, F.lit("\u0001"), F.lit("\\"))


def parse_lines(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """s, sk, p, o, ok, dt, lang, g of N-Triples or N-Quads lines, after the columns to keep; other lines are left out (see
    ``bad_lines``).

    A line is matched once: its parts are put between line breaks, which no line holds.  They come from an explode, so that
    the filter isn't worked out by a second match."""
    parts = F.split(F.regexp_replace(column, PARTS, "\n".join(f"${k}" for k in range(1, 13))), "\n")
    rows = lines.select(*keep, F.explode(F.array(parts)).alias("_x")).filter(F.size("_x") == 12)
    s, s_blank, p, o, o_blank, quote, said, kind, tag, named, g, g_blank = (c("_x")[k] for k in range(12))
    some = lambda x: x != ""
    dt = F.when(some(quote), F.when(some(tag), "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").when(some(kind), kind).otherwise("http://www.w3.org/2001/XMLSchema#string"))
    return rows.select(
        *keep, F.when(some(s_blank), s_blank).otherwise(s).alias("s"), F.when(some(s_blank), 1).otherwise(0).alias("sk"), p.alias("p"),
        F.when(some(quote), F.when(said.contains("\\"), _unescape(said)).otherwise(said)).when(some(o_blank), o_blank).otherwise(o).alias("o"), F.when(some(quote), 2).when(some(o_blank), 1).otherwise(0).alias("ok"),
        dt.alias("dt"), F.when(some(tag), tag).alias("lang"), F.when(some(named), g).when(some(g_blank), g_blank).alias("g"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, doc (the file) and seq (the line's number in it, from 0) of text files.

    Files are read in splits.  Within one the lines come in their order; the lines of the splits before it, a row for each
    split, are added up by file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = raw.groupBy("doc", "_block").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("doc").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(F.broadcast(blocks.select("doc", "_block", "_least", before.alias("_before"))), ["doc", "_block"]).select("value", "doc", (F.col("_id") - F.col("_least") + F.col("_before")).alias("seq"))


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    """doc, seq, a triple and g: N-Triples or N-Quads files with the place of each statement."""
    return parse_lines(numbered_lines(spark, path), keep=("doc", "seq"))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """doc and seq of each statement: lines are matched, and not taken apart."""
    return numbered_lines(spark, path).filter(c("value").rlike(PARTS)).select("doc", "seq")


def file_format(path: str | Column, head: Column | None = None) -> Column:
    """The format of a document by its name, else by how it begins."""
    name = F.lower(path if isinstance(path, Column) else F.lit(path))
    out = None
    for suffix, kind in SUFFIXES.items():
        test = name.endswith(suffix)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    if head is None:
        return out
    start = F.ltrim(head)
    return F.coalesce(out, F.when(start.rlike("^<\\?xml|^<rdf:RDF"), "rdfxml").when(start.startswith("{") | start.startswith("["), "jsonld").when(start.rlike("(?i)^(@prefix|@base|prefix|base)\\b"), "turtle").when(start.rlike("^(<[^>]*>|_:\\S+)\\s+<[^>]*>\\s"), "ntriples"))


#: Suffixes of document names.
SUFFIXES = {
    ".ttl": "turtle",
    ".trig": "trig",
    ".nt": "ntriples",
    ".nq": "nquads",
    ".n3": "n3",
    ".jsonld": "jsonld",
    ".rdf": "rdfxml",
    ".owl": "rdfxml",
}


def bad_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.filter(~c(column).rlike(LINE) & ~c(column).rlike("^\\s*(#.*)?$"))


def _node(x: str, kind: str) -> Column:
    return F.when(c(kind) == 1, c(x)).otherwise(F.concat(F.lit("<"), c(x), F.lit(">")))


def lines(triples: DataFrame) -> DataFrame:
    """value: a line for each triple, or quad where there is a g."""
    said = c("o")
    for char, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        said = F.replace(said, F.lit(char), F.lit(name))
    quoted = F.concat(F.lit('"'), said, F.lit('"'), F.when(c("lang").isNotNull(), F.concat(F.lit("@"), c("lang"))).when(c("dt") == "http://www.w3.org/2001/XMLSchema#string", "").when(c("dt").isNull(), "").otherwise(F.concat(F.lit("^^<"), c("dt"), F.lit(">"))))
    o = F.when(c("ok") == 2, quoted).otherwise(_node("o", "ok"))
    end = F.when(c("g").isNotNull(), F.concat(F.lit(" <"), c("g"), F.lit("> ."))).otherwise(F.lit(" .")) if "g" in triples.columns else F.lit(" .")
    return triples.select(F.concat(_node("s", "sk"), F.lit(" <"), c("p"), F.lit("> "), o, end).alias("value"))


def write(triples: DataFrame, path: str) -> None:
    """Compressed files, which are read in one piece and therefore bounded."""
    lines(triples).write.option("maxRecordsPerFile", FILE_LINES).text(path, compression="gzip")
