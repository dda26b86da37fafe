"""User shapes: rows that are repeated, nodes with many values, and how often values are dealt."""

from __future__ import annotations

from quadspan import vocab as v
from quadspan.model import TRIPLE_SCHEMA, Graph, from_tuples, inline
from quadspan.plans import shape_table

E = "http://example.org/t#"


def broken(spark, g, *rows):
    found = shape_table.validate(g, inline(spark, [tuple(r) for r in rows], shape_table.SHAPE))
    return sorted((r["focus_node"].removeprefix(E), r["broken"], r["values"]) for r in found.collect())


def test_repeated_rows_and_targets_count_values_once(spark):
    g = Graph(from_tuples(spark, [(E + "a", v.TYPE, E + "T"), (E + "a", v.TYPE, E + "U"), (E + "U", v.SUBCLASS, E + "T"), (E + "a", E + "p", "1", None, None)]))
    row = ("S", "class", E + "T", None, E + "p", "minCount", "2", False)
    assert broken(spark, g, row, row) == [("a", "minCount", 1)] * 2
    # a target that only the closed row states, and one that is a subject, an object and a node of its own
    assert broken(spark, g, row, ("S", "node", E + "b", None, None, "closed", "", False)) == [("a", "closed", 1), ("a", "minCount", 1), ("b", "minCount", 0)][1:]
    ends = Graph(from_tuples(spark, [(E + "a", E + "p", E + "a"), (E + "a", E + "q", E + "b")]))
    assert broken(spark, ends, *(("S", kind, target, None, E + "p", "maxCount", "0", False) for kind, target in (("subjects", E + "q"), ("objects", E + "p"), ("node", E + "a")))) == [("a", "maxCount", 1)] * 3


def test_a_scan_that_repeats_triples(spark):
    class Twice(Graph):
        once = False

        def scan(self, *predicates, **narrow):
            found = super().scan(*predicates, **narrow)
            return found.unionByName(found)

    g = Twice(from_tuples(spark, [(E + "a", E + "p", "1", None, None), (E + "a", E + "r", "2", None, None)]), distinct=True)
    g.once = False
    assert broken(spark, g, ("S", "subjects", E + "p", None, E + "p", "maxCount", "1", False), ("S", "subjects", E + "p", None, None, "closed", "", False)) == [("a", "closed", 1)]


def test_values_are_dealt_once(spark):
    """Values that no class, equals or disjoint row speaks of are dealt by their node only, without their text."""
    triples = spark.range(1000).selectExpr(f"concat('{E}n', id % 10) AS s", "0 AS sk", f"'{E}p' AS p", "concat('value ', id) AS o", "2 AS ok", f"'{v.XSD}string' AS dt", "CAST(NULL AS STRING) AS lang")
    g = Graph(spark.createDataFrame(triples.toArrow(), TRIPLE_SCHEMA), distinct=True)
    rows = [("S", "subjects", E + "p", None, E + "p", "pattern", "^value", False), ("S", "subjects", E + "p", None, E + "p", "maxCount", "99", False)]
    found = shape_table.validate(g, inline(spark, rows, shape_table.SHAPE))
    assert {(r["broken"], r["values"]) for r in found.collect()} == {("maxCount", 100)} and found.count() == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("== Initial Plan ==")[-1].splitlines() if "Exchange hashpartitioning" in line and "target_kind" not in line]
    assert len(dealt) == 1 and "hashpartitioning(s#" in dealt[0]
