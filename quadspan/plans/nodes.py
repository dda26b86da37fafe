"""What a graph says of its nodes, a row for each node: the anti joins of several checks ask for no more.

A node's row is made in one aggregation, where the triples of one row of a table still stand together; the few nodes that a
check is after are then met with the triples, which aren't dealt for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..model import LITERAL, Graph, small
from ..storage import Scratch

c, lit = F.col, F.lit
#: Bits of ``f``: as a subject (SUBJECT: of any triple, OTHER: of one that isn't a type, TYPED: of a type, CLASSED: of a type
#: that is an IRI, LABELLED), and as an object (OF_TYPE, OF_VERSION, OF_SEE: of these predicates; USED: of others than types
#: and see-also; BOUND: of those that have to lead to something typed).
SUBJECT, OTHER, TYPED, CLASSED, LABELLED, OF_TYPE, OF_VERSION, OF_SEE, USED, BOUND = (1 << k for k in range(10))


def nodes(g: Graph) -> DataFrame:
    """node, f (bits), n (triples but types that have it as subject; repeated ones count), worked out once for a graph."""
    if "_nodes" not in g.__dict__:
        t = (g.near or g).scan().select("s", "p", "o", "ok")
        is_ = lambda *ps: c("p").isin(*ps)
        bit = lambda when, k: F.when(when, k).otherwise(0)
        said = F.when(is_(v.TYPE), F.when(c("ok") == 0, SUBJECT | TYPED | CLASSED).otherwise(SUBJECT | TYPED)).when(is_(v.LABEL, v.PREF_LABEL), SUBJECT | OTHER | LABELLED).otherwise(SUBJECT | OTHER)
        bound = ~is_(v.IMPORTS, v.VERSION_IRI, v.TYPE) & ~c("p").startswith(v.W3C)
        pointed = F.when(is_(v.TYPE), OF_TYPE).otherwise(bit(is_(v.VERSION_IRI), OF_VERSION).bitwiseOR(F.when(is_(v.SEE_ALSO), OF_SEE).otherwise(USED)).bitwiseOR(bit(bound, BOUND)))
        row = lambda node, f, n: F.struct(node.alias("node"), f.alias("f"), n.cast("long").alias("n"))
        ends = F.array(row(c("s"), said, bit(~is_(v.TYPE), 1)), F.when(c("ok") != LITERAL, row(c("o"), pointed, lit(0))))
        found = t.select(F.explode(ends).alias("x")).filter("x is not null").groupBy("x.node").agg(F.bit_or("x.f").alias("f"), F.sum("x.n").alias("n"))
        g._nodes = Scratch(g.spark).put(found, "nodes")
    return g._nodes


def has(*bits: int) -> Column:
    """Whether a node's row has any of some bits."""
    return c("f").bitwiseAND(lit(sum(bits))) != 0


def named(column: str = "node") -> Column:
    return ~c(column).startswith("_:")


def meeting(triples: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Triples whose column is one of the nodes found (column node, each once)."""
    return triples.join(small(found.select(c("node").alias(column))), column, "left_semi")
