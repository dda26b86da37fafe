"""CONSTRUCT, solution joins and competency assertions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..model import TRIPLE
from ..storage import Scratch
from .contract import reachable

c = F.col


def construct(solutions: DataFrame, template: list[tuple[Column, Column | str, Column]]) -> DataFrame:
    """Triples of a template (subject, predicate, object term) for each solution, in one pass.

    Subjects are IRI strings, or blank nodes with ``_:``; objects are structs of ``functions.terms``.  Triples with an
    unbound part are left out."""
    made = []
    for s, p, o in template:
        p = F.lit(p) if isinstance(p, str) else p
        kind = F.when(s.startswith("_:"), 1).otherwise(0)
        made.append(F.struct(s.alias("s"), kind.alias("sk"), p.alias("p"), o["o"].alias("o"), o["ok"].alias("ok"), o["dt"].alias("dt"), o["lang"].alias("lang")))
    rows = solutions.select(F.explode(F.array(*made)).alias("t")).select("t.*").filter("s is not null and p is not null and o is not null")
    return rows.select(*TRIPLE).distinct()


def blank(*key: Column) -> Column:
    """A blank node that is fresh for each solution, from the solution's key."""
    return F.concat(F.lit("_:b"), F.substring(F.sha2(F.to_json(F.struct(*key)), 256), 1, 24))


def compatible_join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Join of solutions where null is unbound and fits anything; the bound value wins.  b is inline data (VALUES).

    Which of the variables b's rows bind is read from it (at most two to the power of their number).  A row of a is dealt
    once to each of these patterns, a row of b to each pattern that rows of a can have, and both sides meet in one equi-join
    on the patterns and what both bind."""
    right = b.select(*(c(x).alias(f"_r_{x}") if x in on else c(x) for x in b.columns))
    bits = lambda prefix: reduce(lambda p, q: p + q, (F.when(c(prefix + x).isNotNull(), 1 << k).otherwise(0) for k, x in enumerate(on)), F.lit(0))
    patterns = [r[0] for r in right.select(bits("_r_").alias("m")).distinct().collect()]
    keys = lambda prefix: [F.when(c("_m").bitwiseAND(c("_n")).bitwiseAND(F.lit(1 << k)) != 0, c(prefix + x)).alias(f"_k_{x}") for k, x in enumerate(on)]
    left = a.withColumn("_m", bits("")).withColumn("_n", F.explode(F.array(*map(F.lit, patterns)) if patterns else F.array().cast("array<int>")))
    left = left.select(*a.columns, "_m", "_n", *keys(""))
    given = right.withColumn("_n", bits("_r_")).withColumn("_m", F.explode(F.array(*map(F.lit, range(1 << len(on))))))
    given = given.select(*right.columns, "_m", "_n", *keys("_r_"))
    names = [f"_k_{x}" for x in on]
    met = left.alias("l").join(given.alias("r"), reduce(lambda p, q: p & q, (c(f"l.{n}").eqNullSafe(c(f"r.{n}")) for n in ("_m", "_n", *names))))
    rest = [x for x in right.columns if not x.startswith("_r_")]
    return met.select(*(F.coalesce(c(f"l.{x}"), c(f"r._r_{x}")).alias(x) if x in on else c(f"l.{x}") for x in a.columns), *(c(f"r.{x}") for x in rest))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """MINUS: nothing is taken away if no variable is shared."""
    shared = [x for x in a.columns if x in b.columns]
    return a.join(b, shared, "left_anti") if shared else a


def ask(solutions: DataFrame) -> DataFrame:
    """One row: whether there is a solution."""
    return solutions.limit(1).agg((F.count("*") > 0).alias("answer"))


def competency(solutions: DataFrame, expect: bool | None = None, min_rows: int = 1) -> DataFrame:
    """One row: whether an ASK gives the expected answer, or a SELECT at least so many rows."""
    if expect is not None:
        return ask(solutions).select((c("answer") == expect).alias("passed"))
    return solutions.limit(min_rows).agg((F.count("*") >= min_rows).alias("passed"))


def describe(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """The concise description of some subjects (column s): their triples, and those of the blank nodes that they lead to
    through blank nodes."""
    tables = Scratch(triples.sparkSession)
    wanted = tables.put(nodes.select("s").distinct(), "wanted")
    sources = wanted.select(c("s").alias("x"))
    hidden = reachable(triples.filter("ok = 1").select(c("s").alias("x"), c("o").alias("y")), sources, sources.filter(c("x").startswith("_:")))
    return triples.join(wanted.unionByName(hidden.select(c("node").alias("s"))).distinct(), "s", "left_semi").select(*TRIPLE).distinct()


def template_of(subject: Column, cls: str, columns: dict[str, str]) -> list[tuple]:
    """The direct mapping of a table's row: its type, and a literal for each column (column: predicate)."""
    rdf_type = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    return [(subject, rdf_type, terms.iri(F.lit(cls))), *((subject, p, terms.literal(F.nullif(F.col(x).cast("string"), F.lit("")))) for x, p in columns.items())]
