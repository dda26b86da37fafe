"""Checks that judge nodes by one row each: odd graphs, and no triple is dealt for an anti join."""

import pytest

from quadspan import vocab as v
from quadspan.model import Graph, from_tuples
from quadspan.plans import checks
from quadspan.sources.rdfview import EX, TableGraph
from quadspan.storage import stored

SF = "/root/testdata/sf0.001"
A, P, Q = "http://a/", "http://a/p", "http://a/q"
ODD = [
    (A + "s", P, A + "gone"), (A + "s", P, A + "typed"), (A + "s", P, A + "text"), (A + "typed", v.TYPE, A + "C"), (A + "s", v.SEE_ALSO, A + "seen"), (A + "x", v.VERSION_IRI, A + "text", None, None),
    (A + "s", P, "_:b"), (A + "s", Q, "1", v.XSD + "integer", None), (A + "s", Q, "1", v.XSD + "decimal", None), (A + "y", v.TYPE, "C", None, None), (P, v.LABEL, "p", None, "en"),
    *((A + "many", Q, str(n), None, None) for n in range(51)), (P, v.RANGE, A + "D"), (A + "D", v.TYPE, v.CLASS), (Q, v.RANGE, v.XSD + "integer"), (A + "s2", P, A + "typed"),
]


@pytest.fixture(params=[False, True], ids=["plain", "stored"])
def g(spark, request):
    one = Graph(from_tuples(spark, ODD))
    return stored(one) if request.param else one


def found(df):
    return sorted(((r["focus_node"], r["path"], r["value"]) for r in df.collect()), key=str)


def test_odd_nodes(g):
    # a version IRI said as a text is known, what is only seen also is not asked for
    assert found(checks.dat_002(g)) == [(A + "s", P, A + "gone")]
    assert found(checks.str_006(g)) == [(A + "s", P, A + "gone"), (A + "s", P, A + "text")]
    assert found(checks.dat_003(g)) == [(A + "s", Q, A + "s")]
    assert found(checks.eff_003(g)) == [(A + "many", Q, A + "many")]
    # a type that is a text is a type, as in SQL
    assert {r[0] for r in found(checks.str_009(g))} == {A + "s", A + "s2", A + "x", A + "many", P, Q}
    assert {r[0] for r in found(checks.qua_004(g))} == {A + n for n in ("s", "s2", "gone", "typed", "x", "y", "many", "C", "D", "q")}


def test_values_that_fit_no_range(g):
    want = [(A + "s", P, A + "typed"), (A + "s2", P, A + "typed"), (A + "s", Q, "1"), *((A + "many", Q, str(n)) for n in range(51))]
    assert found(checks.cnf_004(g)) == sorted(want, key=str)


def test_many_bad_pairs_and_many_names(g, monkeypatch):
    want = found(checks.cnf_004(g)), found(checks.cnf_003(g))
    for name, bound in (("FEW", 0), ("HOT", 1), ("PUSHED", 0)):
        monkeypatch.setattr(checks, name, bound)
        g.__dict__.pop("_judged", None)
        assert (found(checks.cnf_004(g)), found(checks.cnf_003(g))) == want


def test_no_triples_are_dealt(spark):
    g = stored(TableGraph(spark, SF))
    assert g.near is not None and EX + "soldBy" in g.alike and v.LABEL not in g.alike
    for check in (checks.dat_002, checks.str_006, checks.str_009):
        plan = check(g)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
    assert checks.nodes(g) is checks.nodes(g)
