"""Steps that would deal triples by predicate, class or shared object: one task would get a whole predicate."""

import re

import pytest

from quadspan import roster_structures, vocab as v
from quadspan.model import Graph, from_tuples
from quadspan.plans import checks, passes, reasoner

E = "http://e/"
SCHEMA = [(E + "p", v.TYPE, v.OBJ_PROP), (E + "p", v.DOMAIN, E + "A"), (E + "p", v.RANGE, E + "A"), (E + "q", v.DOMAIN, E + "B"), (E + "q", v.RANGE, v.XSD + "integer"), (E + "C", v.SUBCLASS, E + "A"), (E + "A", v.DISJOINT, E + "B")]
FACTS = [t for k in range(40) for t in ((E + f"n{k}", v.TYPE, E + "ABCD"[k % 4]), (E + f"n{k}", E + "p", E + f"n{k % 3}"), (E + f"n{k}", E + "q", str(k), v.XSD + ("integer" if k % 2 else "string"), None), (E + f"n{k}", E + "r", E + "n0"), (E + f"m{k}", E + "q", E + "n1"))]


@pytest.fixture
def graph(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only what is counted to be small is broadcast
    yield Graph(from_tuples(spark, [*SCHEMA, *FACTS, (E + "n0", v.TYPE, E + "B")]), distinct=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("run", [checks.str_002, checks.str_007, checks.cnf_004])
def test_no_join_deals_by_predicate(graph, run):
    assert not re.search(r"SortMergeJoin \[_?p#\d+(, dt#\d+)?\]", _plan(run(graph)))


def test_disjoint_classes_are_broadcast(graph):
    found = reasoner.disjoint_members(graph)
    assert not re.search(r"SortMergeJoin \[(a|o)#\d+\]", _plan(found))
    assert [r[0] for r in found.collect()] == [E + "n0"]


def test_subjects_are_dealt_once(graph):
    assert len(re.findall(r"hashpartitioning\(s#", _plan(checks.cnf_003(graph)))) == 1


def _pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def _types():
    out = {}
    for t in [*FACTS, (E + "n0", v.TYPE, E + "B")]:
        if t[1] == v.TYPE:
            out.setdefault(t[0], set()).update({t[2]} | ({E + "A"} if t[2] == E + "C" else set()))
    return out


@pytest.mark.parametrize("word", [1, 62])
def test_domains_by_brute_force(graph, monkeypatch, word):
    monkeypatch.setattr(checks, "WORD", word)
    types, domain = _types(), {E + "p": E + "A", E + "q": E + "B"}
    want = sorted({(t[0], t[1]) for t in FACTS if t[1] in domain and t[0] in types and domain[t[1]] not in types[t[0]]})
    assert want and _pairs(checks.cnf_003(graph), "focus_node", "path") == want


@pytest.mark.parametrize(("few", "hot"), [(200_000, 100_000), (0, 3), (0, 100_000)])
def test_ranges_by_brute_force(graph, monkeypatch, few, hot):
    monkeypatch.setattr(checks, "FEW", few)
    monkeypatch.setattr(checks, "HOT", hot)
    types = _types()
    want = {(t[0], t[1], t[2]) for t in FACTS if len(t) == 5 and t[1] == E + "q" and t[3] != v.XSD + "integer"}
    want |= {(t[0], t[1], t[2]) for t in FACTS if len(t) == 3 and t[1] == E + "p" and t[2] in types and E + "A" not in types[t[2]]}
    want |= {(t[0], t[1], t[2]) for t in FACTS if len(t) == 3 and t[1] == E + "q" and t[2] in types}
    assert _pairs(checks.cnf_004(graph), "focus_node", "path", "value") == sorted(want)


def test_only_shared_checks_are_merged(graph):
    found = passes.run_checks(graph, only=["STR-002", "CNF-003", "DAT-001"])
    merged = passes.merge(found)
    assert sorted(map(str, found.collect())) == sorted(map(str, merged.collect()))
    assert "hashpartitioning" not in _plan(passes.run_checks(graph, only=["STR-002"], literal=False))


def test_csv_files_are_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(roster_structures, "CSV_ROWS", 60)
    monkeypatch.setattr(roster_structures, "new_path", lambda spark, name: str(tmp_path / name))
    n = roster_structures._csv(spark, "/root/testdata/sf0.001").select("s").distinct().count()
    sizes = [len(f.read_text().splitlines()) - 1 for f in (tmp_path / "csv").glob("*.csv")]
    assert sum(sizes) == n and max(sizes) <= 60 < n
