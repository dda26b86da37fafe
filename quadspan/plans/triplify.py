"""Tables to graphs: CSV reading, column profiles, drafts and sketches (2.6 F24-F29, S12)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c, lit = F.col, F.lit
# The forms of cells, in the order in which they are tried, headers of keys, and the values of an enum.
_KINDS = (
    ("date", "^\\d{4}-\\d{2}-\\d{2}(T\\d{2}:\\d{2}:\\d{2})?$"),
    ("boolean", "(?i)^(true|false|yes|no)$"),
    ("integer", "^-?\\d+$"),
    ("decimal", "^-?\\d+(\\.\\d+)?$"),
)
KEY_HEADERS = ("(?i)(^|_)id$", "Id$")
FEW = 12


def read_csv(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """All columns as strings; an empty cell is ''; blank rows are left out; .tsv files are cut at tabs."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, sep="\t" if path.endswith(".tsv") else ",").fillna("")
    df = df.filter(F.concat_ws("", *df.columns) != "")
    return df.limit(rows) if rows else df


def profile(table: DataFrame) -> DataFrame:
    """One row for each column: kind, distinct values (sorted, the first 12), whether it may be a key, and how many cells
    are filled.  One aggregation of unpivoted cells, whatever the number of columns; ranks are limited before they are
    shuffled."""
    cells = table.select(F.explode(F.array(*(F.struct(lit(k).alias("position"), lit(n).alias("column"), c(f"`{n}`").cast("string").alias("cell")) for k, n in enumerate(table.columns)))).alias("x")).select("x.*").filter("cell is not null and cell <> ''")
    values = cells.groupBy("position", "column", "cell").agg(F.count("*").alias("n"))
    flags = {name: F.bool_and(c("cell").rlike(p)).alias(name) for name, p in _KINDS}
    one = values.groupBy("position", "column").agg(F.sum("n").alias("filled"), F.count("*").alias("different"), *flags.values())
    place = F.row_number().over(Window.partitionBy("position").orderBy("cell"))
    samples = values.withColumn("place", place).filter(c("place") <= FEW).groupBy("position").agg(F.array_join(F.array_sort(F.collect_list("cell")), "|").alias("samples"))
    kind = F.when((c("different") <= FEW) & (c("different") < c("filled")) & (c("filled") > 1), "enum")
    for name, _ in _KINDS:
        kind = kind.when(c(name), name)
    key = c("column").rlike(KEY_HEADERS[0]) | c("column").rlike(KEY_HEADERS[1]) | ((c("different") == c("filled")) & (c("filled") > 1))
    return one.join(samples, "position", "left").select("column", kind.otherwise("string").alias("kind"), "filled", "different", key.alias("may_be_key"), F.coalesce("samples", lit("")).alias("samples"))


def safe_name(header: str) -> str:
    """A header as a variable name; drafts and evaluation use the same."""
    return re.sub(r"\W+", "_", header.strip()).strip("_") or "column"


def draft(profiled: list[dict], name: str, namespace: str) -> tuple[str, str]:
    """An ontology and a query for a profiled table, as text to start from."""
    kinds = {"date": "xsd:date", "boolean": "xsd:boolean", "integer": "xsd:integer", "decimal": "xsd:decimal"}
    cls = name[:1].upper() + name[1:]
    key = next((safe_name(p["column"]) for p in profiled if p["may_be_key"]), safe_name(profiled[0]["column"]))
    lines = [f"@prefix : <{namespace}> .", "@prefix owl: <http://www.w3.org/2002/07/owl#> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .", "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .", "", f":{cls} a owl:Class ."]
    lines += [f":{safe_name(p['column'])} a owl:DatatypeProperty ; rdfs:domain :{cls} ; rdfs:range {kinds.get(p['kind'], 'xsd:string')} ." for p in profiled]
    body = [f"  ?row a :{cls} ."] + [f"  ?row :{safe_name(p['column'])} ?{safe_name(p['column'])} ." for p in profiled]
    query = "\n".join([f"PREFIX : <{namespace}>", "CONSTRUCT {", *body, "}", "WHERE {", f"  BIND(IRI(CONCAT(\"{namespace}{name}-\", ENCODE_FOR_URI(?{key}))) AS ?row)", "}"])
    return "\n".join(lines) + "\n", query + "\n"


def sketch(query: str) -> str:
    """The CONSTRUCT body of a query with variables as names: what its triples look like, as Turtle."""
    prefixes = re.findall(r"(?im)^\s*PREFIX\s+([\w-]*:)\s*(<[^>]*>)", query)
    found = re.search(r"CONSTRUCT\s*\{(.*?)\}\s*WHERE", query, re.S | re.I)
    body = re.sub(r"\?(\w+)", r":\1", found[1]) if found else ""
    return "\n".join(f"@prefix {p} {ns} ." for p, ns in prefixes) + "\n" + body.strip() + "\n"
