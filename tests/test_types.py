"""Types of the closure as bits: the counts and members that the closure itself gives, on odd schemas."""

import pytest
from pyspark.sql import functions as F

from quadspan import vocab as v
from quadspan.model import Graph, from_tuples
from quadspan.plans import reasoner
from quadspan.sources.rdfview import TableGraph

A = "http://a/"
PLAIN = [
    (A + "x", v.TYPE, A + "C"), (A + "x", A + "p", A + "y"), (A + "x", A + "p", "_:z"), (A + "x", A + "d", "1", None, None), (A + "p", v.DOMAIN, A + "D"), (A + "p", v.RANGE, A + "E"), (A + "d", v.RANGE, A + "D"),
    (A + "q", v.SUBPROP, A + "p"), (A + "u", A + "q", A + "w"), (A + "u", A + "p", A + "w"), (A + "v", A + "q", A + "w"), (A + "C", v.SUBCLASS, A + "B"), (A + "B", v.EQUIV_CLASS, A + "B2"), (A + "E", v.SUBCLASS, A + "E2"),
    (A + "y", v.SAME, A + "s"), (A + "s", v.SAME, A + "t"), (A + "t", v.TYPE, A + "D"), (A + "x", v.TYPE, "C", None, None), (A + "D", A + "apart", A + "E2"), (A + "apart", v.SUBPROP, v.DISJOINT), (A + "B2", v.DISJOINT, A + "D"),
]
META = [*PLAIN, (A + "kind", v.SUBPROP, v.TYPE), (A + "m", A + "kind", A + "C")]


@pytest.mark.parametrize("said", [PLAIN, META, PLAIN[1:2]], ids=["plain", "of the vocabulary", "no schema"])
def test_as_the_closure(spark, said):
    g = Graph(from_tuples(spark, said))
    closed = reasoner.reason(g)
    want = {tuple(r) for r in reasoner.inferred(g, closed).groupBy("p").agg(F.count("*")).collect()}
    assert {tuple(r) for r in reasoner.inferred_counts(g).collect()} == want
    apart = sorted(r[0] for r in reasoner.disjoint_members(closed).collect())
    assert sorted(r[0] for r in reasoner.disjoint_types(g).collect()) == apart
    assert not apart if len(said) == 1 else {A + "x", A + "y", A + "s"} <= set(apart)


def test_only_what_gives_a_type_is_read(spark, monkeypatch):
    read = []
    g = TableGraph(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(g, "scan", lambda *ps, **more: read.extend(ps) or TableGraph.scan(g, *ps, **more))
    reasoner.disjoint_types(g)
    assert not [p for p in read if p.endswith(("ofOrder", "quantity", "soldBy", "eventValue"))]
