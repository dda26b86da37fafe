"""RDF lists (F44): members with their places by pointer jumping over rdf:rest, and lists that are broken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..model import Graph, union
from ..storage import Scratch
from .contract import jump, parted, repeated

c, lit = F.col, F.lit
FIRST, REST, NIL = v.RDF + "first", v.RDF + "rest", v.RDF + "nil"


def is_list_node(g: Graph) -> DataFrame:
    """s of the nodes with an rdf:first or rdf:rest."""
    return g.having(FIRST, REST)


def _said(g: Graph, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """The triples of rdf:first, and (s, o) of rdf:rest between nodes."""
    t = tables.put(g.scan(FIRST, REST).filter((c("p") == FIRST) | (c("ok") != 2)).select("s", "o", "ok", "dt", "lang", (c("p") == FIRST).alias("member")), "said")
    return t.filter("member").drop("member"), t.filter("not member").select("s", "o")


def _links(rests: DataFrame, tables: Scratch, several: DataFrame, shared: DataFrame) -> DataFrame:
    """The sound links (node, next) back from a cell to the only cell that goes on with it, and with it alone; several (s)
    are cells with several rests, shared (o) those that several cells go on with."""
    links = rests.filter((c("o") != NIL) & c("s").isNotNull())
    for name, bad in (("s", several), ("o", shared)):
        links = parted(links, name, tables.put(bad, "bad"))[1]
    return links.select(c("o").alias("node"), c("s").alias("next"))


def list_members(g: Graph) -> DataFrame:
    """list (its first cell), position (from 1), cell, o, ok, dt, lang of all lists' members, in a logarithmic number of
    rounds.  A list ends before a cell that other cells share and behind one with several rests; lists that run in a
    circle have no members: see ``list_problems``."""
    tables = Scratch(g.spark)
    firsts, rests = _said(g, tables)
    ranks = jump(_links(rests, tables, repeated(rests.select("s")), repeated(rests.filter(c("o") != NIL).select("o"))))
    # a cell that no link leads back from is the first of its list
    ranks = ranks.select(c("node").alias("s"), "end", "steps", (c("cycle").isNotNull()).alias("cyclic"))
    found = firsts.filter("s is not null").join(ranks, "s", "left").filter("cyclic is null or not cyclic")
    return found.select(F.coalesce("end", "s").alias("list"), (F.coalesce("steps", lit(0)) + 1).alias("position"), c("s").alias("cell"), "o", "ok", "dt", "lang")


def list_problems(g: Graph) -> DataFrame:
    """node, problem of cells that a list can't have."""
    tables = Scratch(g.spark)
    firsts, rests = _said(g, tables)
    counts = lambda node, *n: [c(node).alias("node"), *(lit(k).alias(name) for k, name in zip(n, ("firsts", "rests", "before"), strict=True))]
    every = firsts.select(*counts("s", 1, 0, 0)).unionByName(rests.select(*counts("s", 0, 1, 0))).unionByName(rests.filter(c("o") != NIL).select(*counts("o", 0, 0, 1)))
    rules = {"no first": "firsts = 0 and rests > 0", "several firsts": "firsts > 1", "no rest": "rests = 0", "several rests": "rests > 1", "shared": "before > 1"}
    cells = every.groupBy("node").agg(*(F.sum(n).alias(n) for n in ("firsts", "rests", "before"))).filter(" or ".join(f"({when})" for when in rules.values()))
    cells = tables.put(cells, "cells")
    found = [cells.filter(when).select("node", lit(name).alias("problem")) for name, when in rules.items()]
    links = _links(rests, tables, *(cells.filter(f"{n} > 1 and node is not null").select("node") for n in ("rests", "before")))
    return union([*found, jump(links).filter("cycle is not null").select("node", lit("cyclic").alias("problem"))])


def expand(edges: DataFrame, roots: DataFrame, limit: int = 100) -> DataFrame:
    """node, depth, path, cut of the tree below roots (column node) over edges (x, y) (F17): each way from a root to a node
    once, without children that are on the way already; cut tells where such a child was left out.  Goes ``limit`` deep."""
    tables = Scratch(edges.sparkSession)
    step = tables.put(edges.select(c("x").alias("node"), c("y").alias("child")).distinct(), "edges")
    level = tables.put(roots.select("node", lit(0).alias("depth"), F.array("node").alias("path")).distinct(), "level")
    children = step.groupBy("node").agg(F.collect_set("child").alias("children"))
    out = []
    while not level.isEmpty():
        below = level.join(children, "node", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
        ways = tables.put(below.withColumn("on", F.array_except("children", "path")), "ways")
        out.append(ways.select("node", "depth", "path", (F.size("on") < F.size("children")).alias("cut")))
        if len(out) > limit:
            break
        level = tables.put(ways.select(F.explode("on").alias("node"), (c("depth") + 1).alias("depth"), "path").withColumn("path", F.concat("path", F.array("node"))), "level")
    return union(out) if out else level.withColumn("cut", lit(False))
