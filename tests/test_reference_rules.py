"""Rules of the vocabulary check, the guidance, the CSV profile, expressivity and metrics on small inline graphs."""

from __future__ import annotations

import pytest

from quadspan import vocab as v
from quadspan.model import Graph, from_tuples, union
from quadspan.operators.closure import closure
from quadspan.plans import passes, triplify
from quadspan.plans.checks import CHECKS
from quadspan.sources.rdfview import TableGraph
from quadspan.storage import stored

E, F_ = "http://e/", "http://foreign/"


def graph(spark, *triples):
    return Graph(from_tuples(spark, list(triples)))


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_voc_001(spark):
    g = graph(
        spark,
        (E + "Dog", v.TYPE, v.CLASS), (E + "rex", v.TYPE, E + "Dgo"), (E + "rex", E + "barks", E + "x"), ("_:b", E + "hums", E + "x"), ("_:b", v.TYPE, E + "Ct"),
        (E + "Dog", v.SUBCLASS, F_ + "Animal"), (E + "Dog", v.EQUIV_PROP, E + "nothing"), (E + "s", v.SH + "targetClass", E + "Dogg"), ("http://only/i", v.TYPE, E + "Dog"), (E + "rex", "http://only/seen", E + "x"),
    )
    got = found(passes.voc_001(g), "focus_node", "path", "value")
    # blank subjects say nothing, foreign namespaces are left alone, an individual makes its namespace known
    assert got == sorted([(E + "rex", v.TYPE, E + "Dgo"), (E + "rex", E + "barks", E + "barks"), (E + "s", v.SH + "targetClass", E + "Dogg"), (E + "rex", "http://only/seen", "http://only/seen")])


def test_guidance_is_a_hint(spark):
    assert {CHECKS[f"MDL-00{i}"].severity for i in (1, 2, 3)} == {"Hint"}
    g = graph(spark, (E + "p", v.TYPE, v.OBJ_PROP), (E + "p", v.INVERSE, E + "q"), (E + "a", v.TYPE, v.ANN_PROP), (E + "a", v.INVERSE, E + "q"), (E + "d", v.TYPE, v.DATA_PROP), (E + "d", v.INVERSE, E + "q"))
    assert found(passes.mdl_001(g), "focus_node") == [(E + "d",), (E + "p",)]


CONSTRUCTS = [
    ([(E + "A", v.TYPE, v.CLASS), (E + "p", v.TYPE, v.DATA_PROP), (E + "p", v.RANGE, v.XSD + "string")], "AL(D)", (True, True, True)),
    ([("_:x", v.OWL + "unionOf", "_:l")], "ALC", (False, False, False)),
    ([(E + "p", v.TYPE, v.OWL + "TransitiveProperty"), (E + "p", v.SUBPROP, E + "q")], "AL+H", (True, False, True)),
    ([(E + "p", v.TYPE, v.OWL + "TransitiveProperty"), ("_:x", v.OWL + "complementOf", E + "C")], "S", (False, False, False)),
    ([("_:x", v.OWL + "maxCardinality", "1", v.XSD + "integer", None), (E + "p", v.TYPE, v.OWL + "FunctionalProperty")], "ALNF", (False, False, False)),
    ([("_:x", v.OWL + "qualifiedCardinality", "1", v.XSD + "integer", None), (E + "p", v.TYPE, v.OWL + "FunctionalProperty"), (E + "q", v.TYPE, v.OWL + "AsymmetricProperty")], "ALQR", (False, False, False)),
    ([("_:x", v.OWL + "oneOf", "_:l"), (E + "p", v.INVERSE, E + "q"), (E + "p", v.EQUIV_PROP, E + "q")], "ALOI", (False, True, True)),
    ([("_:x", v.OWL + "someValuesFrom", E + "C"), ("_:y", v.OWL + "allValuesFrom", E + "C")], "ALC", (False, False, True)),
]


def test_expressivity(spark):
    for triples, logic, profiles in CONSTRUCTS:
        g = graph(spark, *triples)
        r = passes.expressivity(g).first()
        assert (r["logic"], (r["el"], r["ql"], r["rl"])) == (logic, profiles)
        broken = {x["profile"] for x in passes.profile_violations(g).collect()}
        assert broken == {p for p, ok in zip(("el", "ql", "rl"), profiles) if not ok}


def test_metrics(spark):
    g = graph(
        spark,
        (E + "A", v.TYPE, v.CLASS), (E + "B", v.TYPE, v.CLASS), (E + "C", v.TYPE, v.CLASS), (E + "A", v.SUBCLASS, E + "B"), (E + "B", v.SUBCLASS, E + "C"), (E + "C", v.SUBCLASS, E + "C"),
        (E + "A", v.LABEL, "a", None, "en"), (E + "B", v.DEFINITION, "b", None, "en"), (E + "p", v.TYPE, v.OBJ_PROP), (E + "d", v.TYPE, v.DATA_PROP), (E + "n", v.TYPE, v.ANN_PROP), (E + "i", v.TYPE, E + "A"), ("_:j", v.TYPE, E + "A"), (E, v.TYPE, v.ONTOLOGY),
    )
    r = passes.metrics(g).first().asDict()
    want = {"classes": 3, "object_properties": 1, "datatype_properties": 1, "annotation_properties": 1, "individuals": 1, "axioms": 14, "edges": 3, "max_depth": 2, "missing_label": 2, "missing_definition": 2, "inheritance": 1.0, "relationship": 0.25, "attribute": 0.33}
    assert r == want


@pytest.mark.parametrize("cells, kind", [(["1", "2.5", "3"], "decimal"), (["1", "-2", "3"], "integer"), (["+1", "2", "3"], "string"), (["2024-01-01", "2024-01-02T10:00:00"], "date"), (["2024-01-01 10:00", "x"], "string"), (["yes", "No", "TRUE"], "boolean"), (["a", "a", "b"], "enum")])
def test_csv_kinds(spark, cells, kind):
    r = triplify.profile(spark.createDataFrame([(x,) for x in cells], "userId string")).first()
    assert r["kind"] == kind and r["may_be_key"]


def test_csv_keys(spark):
    rows = [("1", "1", "1", "1"), ("1", "1", "1", "2")]
    got = {r["column"]: r["may_be_key"] for r in triplify.profile(spark.createDataFrame(rows, "row_id string, valid string, item_code string, n string")).collect()}
    assert got == {"row_id": True, "valid": False, "item_code": False, "n": True}


def test_a_stored_graph_scans_alike(spark):
    g = TableGraph(spark, "/root/testdata/sf0.001")
    kept = stored(g)
    for p in (v.LABEL, v.SUBCLASS):
        assert sorted(map(str, kept.scan(p).collect())) == sorted(set(map(str, g.scan(p).collect())))
    assert kept.typed(v.CLASS).count() == g.typed(v.CLASS).count() > 0
    assert g.scan(datatypes=[v.XSD + "date"]).count() == g.scan().filter(f"dt = '{v.XSD}date'").count() > 0


def test_long_chain_and_many_frames(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(40)], "x string, y string")
    assert closure(chain).count() == 40 * 41 // 2 and closure(chain, 3).agg({"hops": "max"}).first()[0] == 3
    assert union([spark.range(1).withColumnRenamed("id", "x") for _ in range(33)]).count() == 33
