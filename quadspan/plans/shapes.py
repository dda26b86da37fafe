"""The 19 shapes (2.5): targets, native core constraints, and the checks' plans for those that are queries.

A shape has a target (a class with its subclasses, a node, the subjects of a predicate, or a query) and a constraint.
Shapes of one's own are rows: see ``shape_table``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..model import Graph, inline
from ..operators.closure import edges
from . import checks as k

c, lit = F.col, F.lit


def target_class(g: Graph, *classes: str) -> DataFrame:
    """s of instances of the classes or of their subclasses."""
    wanted = inline(g.spark, [(x,) for x in classes], "x string")
    below = g.closed(v.SUBCLASS).join(wanted.select(c("x").alias("y")), "y").select("x").union(wanted).distinct()
    return k.within(g.scan(v.TYPE).filter("ok <> 2").select("s", "o"), below, "o").select("s").distinct()


def target_subjects(g: Graph, predicate: str) -> DataFrame:
    return g.having(predicate)


def disjoint(g: Graph, targets: DataFrame, reach: DataFrame, path: str, other: str) -> DataFrame:
    """sh:disjoint: the path's nodes (x, y) and those of another predicate must not meet."""
    apart = g.scan(other).filter("ok <> 2").select(c("s").alias("x"), c("o").alias("y"))
    return k.rows(k.within(reach.join(apart, ["x", "y"]), targets, "x"), "x", lit(path), "y")


def _only(run: Callable[[Graph], DataFrame], target: Callable[[Graph], DataFrame] | None) -> Callable[[Graph], DataFrame]:
    if target is None:
        return run
    return lambda g: k.within(run(g), target(g), "focus_node")


_classes = lambda g: target_class(g, v.CLASS)
_objects = lambda g: target_class(g, v.OBJ_PROP)
_data = lambda g: target_class(g, v.DATA_PROP)


def log_001(g: Graph) -> DataFrame:
    return disjoint(g, _classes(g), g.closed(v.SUBCLASS), f"({v.SUBCLASS})+", v.DISJOINT)


def log_003(g: Graph) -> DataFrame:
    return disjoint(g, _classes(g), edges(g.scan(v.EQUIV_CLASS)).filter("x <> y"), v.EQUIV_CLASS, v.SUBCLASS)


@dataclass(frozen=True)
class Shape:
    id: str
    check_id: str
    run: Callable[[Graph], DataFrame]


SHAPES: dict[str, Shape] = {
    s.id: s
    for s in [
        *(Shape(i, i, k.CHECKS[i].run) for i in ("DAT-001", "DAT-002", "DAT-003", "EFF-002", "EFF-003", "LOG-002", "QUA-001", "QUA-003", "STR-001", "STR-002", "STR-003")),
        Shape("EFF-001", "EFF-001", _only(k.eff_001, _classes)),
        Shape("LOG-001", "LOG-001", log_001),
        Shape("LOG-003", "LOG-003", log_003),
        Shape("QUA-002", "QUA-002", _only(k.qua_002, lambda g: target_class(g, v.ONTOLOGY))),
        Shape("STY-001", "STY-001", _only(k.sty_001, _classes)),
        Shape("STY-002-obj", "STY-002", _only(k.sty_002, _objects)),
        Shape("STY-002-data", "STY-002", _only(k.sty_002, _data)),
        Shape("STY-003", "STY-003", _only(k.sty_003, lambda g: target_subjects(g, v.LABEL))),
    ]
}
