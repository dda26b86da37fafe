"""Closure in logarithmic rounds, identity classes, lists, trees, named graphs, shapes, occurrences and re-checks."""

from __future__ import annotations

import random
import re

import pytest

from quadspan import vocab as v
from quadspan.model import Graph, from_tuples, inline
from quadspan.operators import closure, construct, contract, lists
from quadspan.plans import occurrences, reasoner, recheck, repairs, shape_table
from quadspan.sources import ntriples
from quadspan.sources.rdfview import EX, GRAPHS, TableGraph
from quadspan.storage import new_path, stored_dataset

SF = "/root/testdata/sf0.001"
E = "http://e/"
F = contract.F


def pairs(spark, es):
    return spark.createDataFrame(es, "x string, y string")


def distances(es):
    """Fewest steps from each node to each that it reaches."""
    step, out = {}, {}
    for a, b in es:
        step.setdefault(a, set()).add(b)
    for s in {n for e in es for n in e}:
        seen, front, d = {}, {s}, 0
        while front:
            d += 1
            front = {b for a in front for b in step.get(a, ())} - seen.keys()
            seen |= dict.fromkeys(front, d)
        out[s] = seen
    return out


def depth(es):
    far = distances(es)
    step = {}
    for a, b in set(es):
        if a != b and not (b in far[a] and a in far[b]):
            step.setdefault(a, []).append(b)
    known = {}

    def of(a):
        if a not in known:
            known[a] = max((1 + of(b) for b in step.get(a, ())), default=0)
        return known[a]

    return max(map(of, far))


_dice = random.Random(3)
_random = [(f"n{_dice.randrange(12):02}", f"n{_dice.randrange(12):02}") for _ in range(13)]
SHAPES_OF_GRAPHS = {
    "random": _random,
    "strands and cycles": [(f"c{i}", f"c{i + 1}") for i in range(9)] + [("c9", "r0"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("r1", "t"), ("p0", "p1"), ("p1", "p2"), ("p2", "p0"), ("s", "s"), ("c4", "side")],
}


@pytest.mark.parametrize(("name", "small"), [("random", contract.SMALL), ("strands and cycles", contract.SMALL), ("strands and cycles", 0)])
def test_graphs_against_plain_walks(spark, monkeypatch, name, small):
    """Reach, cycles, longest paths and components, by rounds alone and with the last edges in one task."""
    monkeypatch.setattr(contract, "SMALL", small)
    es = sorted(set(SHAPES_OF_GRAPHS[name]))
    far = distances(es)
    sources = sorted(far)[:2]
    got = contract.reach(pairs(spark, es), spark.createDataFrame([(s,) for s in sources], "x string"))
    assert {(r["x"], r["y"], r["hops"]) for r in got.collect()} == {(s, y, d) for s in sources for y, d in far[s].items()}
    got = {(r["x"], r["y"], r["hops"]) for r in closure.closure(pairs(spark, es)).collect()}
    assert got == {(s, y, d) for s in far for y, d in far[s].items()}
    root = {r["node"]: r["root"] for r in contract.cycles(pairs(spark, es)).collect()}
    on = {a for a in far if a in far[a]}
    assert set(root) == on and all((root[a] == root[b]) == (b in far[a] and a in far[b]) for a in on for b in on)
    assert contract.longest(pairs(spark, es)) == depth(es)
    both = distances(es + [(b, a) for a, b in es])
    assert {r["node"]: r["root"] for r in contract.components(pairs(spark, es)).collect()} == {a: min([a, *both[a]]) for a in both}


def chain(spark, n):
    return spark.range(n).selectExpr("cast(id as string) x", "cast(id + 1 as string) y")


def rounds(monkeypatch):
    """Counts the rounds of pointer jumping."""
    seen = []
    put = contract.Scratch.put

    def counted(self, df, name="scratch"):
        seen.append(name)
        return put(self, df, name)

    monkeypatch.setattr(contract.Scratch, "put", counted)
    return seen


def test_chain_of_twenty_thousand(spark, monkeypatch):
    seen = rounds(monkeypatch)
    got = contract.reach(chain(spark, 20_000), spark.createDataFrame([("0",)], "x string")).agg(F.max("hops"), F.count("*")).collect()[0]
    assert tuple(got) == (20_000, 20_000)
    assert sum(n in ("jumped", "front") for n in seen) < 40


def test_depth_of_a_hundred_thousand(spark, monkeypatch):
    seen = rounds(monkeypatch)
    assert contract.longest(chain(spark, 99_999)) == 99_999
    assert sum(n in ("jumped", "base") for n in seen) < 40


def test_closure_doubles(spark):
    """A chain of 64: seven rounds, all distances."""
    found = closure.closure(chain(spark, 64))
    assert found.count() == 64 * 65 // 2 and found.agg(F.max("hops")).collect()[0][0] == 64
    assert closure.closure(chain(spark, 64), limit=5).agg(F.max("hops")).collect()[0][0] == 5


# --- reasoner -------------------------------------------------------------------------------------------------------


def naive(triples):
    """The rules, applied until nothing is new."""
    known = set(triples)
    while True:
        of = lambda p: {(s, o) for s, q, o in known if q == p}
        sub, subp, same, typ = of(v.SUBCLASS), of(v.SUBPROP), of(v.SAME), of(v.TYPE)
        new = {(a, p, d) for p, rel in ((v.SUBCLASS, sub), (v.SUBPROP, subp), (v.SAME, same)) for a, b in rel for c, d in rel if b == c}
        new |= {(i, v.TYPE, d) for i, a in typ for c, d in sub | of(v.EQUIV_CLASS) if a == c} | {(b, v.TYPE, t) for i, t in typ for a, b in same if i == a}
        new |= {(s, q, o) for s, p, o in known for a, q in subp | of(v.EQUIV_PROP) if a == p}
        new |= {(s, v.TYPE, d) for s, p, o in known for a, d in of(v.DOMAIN) if a == p} | {(o, v.TYPE, d) for s, p, o in known for a, d in of(v.RANGE) if a == p}
        new |= {(b, p, a) for p in (v.EQUIV_CLASS, v.EQUIV_PROP, v.SAME) for a, b in of(p)}
        if new <= known:
            return known
        known |= new


PLAIN = [("A", v.SUBCLASS, "B"), ("B", v.SUBCLASS, "C"), ("C", v.EQUIV_CLASS, "D"), ("D", v.SUBCLASS, "F"), ("p", v.SUBPROP, "q"), ("q", v.EQUIV_PROP, "r"), ("r", v.DOMAIN, "A"), ("q", v.RANGE, "R"), ("i", v.TYPE, "A"), ("i", v.SAME, "j"), ("k", v.SAME, "j"), ("x", "p", "y"), ("j", v.TYPE, "Z"), ("l", v.SAME, "l")]
META = [*PLAIN, ("isA", v.SUBPROP, v.TYPE), ("kindOf", v.SUBPROP, v.SUBCLASS), ("n", "isA", "A"), ("F", "kindOf", "G"), (v.TYPE, v.DOMAIN, "Thing"), ("is", v.EQUIV_PROP, v.SAME), ("n", "is", "o")]


@pytest.mark.parametrize("triples", [PLAIN, META], ids=["facts", "the vocabulary itself"])
def test_closure_of_all_rules(spark, triples):
    full = [(x if x.startswith("http") else E + x for x in t) for t in triples]
    full = [tuple(t) for t in full]
    closed = reasoner.reason(Graph(from_tuples(spark, full)))
    assert {(r["s"], r["p"], r["o"]) for r in closed.scan().collect()} == naive(full)
    by_p = {r["p"]: r["n"] for r in closed.counts().collect()}
    assert by_p == {p: sum(q == p for _, q, _ in naive(full)) for p in {q for _, q, _ in naive(full)}}


def test_identities_of_a_large_class(spark):
    """A hundred thousand equal nodes are as many membership rows, and types are shared by all of them."""
    n = 100_000
    same = spark.range(n).selectExpr(f"concat('{E}', id) s", "0 sk", f"'{v.SAME}' p", f"concat('{E}', id + 1) o", "0 ok", "cast(null as string) dt", "cast(null as string) lang")
    closed = reasoner.reason(Graph(same.unionByName(from_tuples(spark, [(E + "5", v.TYPE, E + "A")])), distinct=True))
    assert closed.members.count() == n + 1 and closed.members.select("rep").distinct().count() == 1
    assert {r["p"]: r["n"] for r in closed.counts().collect()} == {v.SAME: (n + 1) ** 2, v.TYPE: n + 1}


# --- lists, trees, descriptions, graphs --------------------------------------------------------------------------------


def test_long_list(spark, monkeypatch):
    n, seen = 100_000, rounds(monkeypatch)
    cell = spark.range(n).selectExpr(f"explode(array(named_struct('s', concat('_:', id), 'sk', 1, 'p', '{lists.FIRST}', 'o', concat('{E}', id), 'ok', 0), named_struct('s', concat('_:', id), 'sk', 1, 'p', '{lists.REST}', 'o', if(id = {n - 1}, '{lists.NIL}', concat('_:', id + 1)), 'ok', if(id = {n - 1}, 0, 1)))) t")
    g = Graph(cell.select("t.*").selectExpr("*", "cast(null as string) dt", "cast(null as string) lang"), distinct=True)
    found = lists.list_members(g)
    assert found.filter(f"list <> '_:0' or o <> concat('{E}', position - 1)").isEmpty() and found.count() == n
    assert seen.count("jumped") < 20


def test_broken_lists(spark):
    def cells(*rows):
        return from_tuples(spark, [(s, lists.FIRST if p == "f" else lists.REST, o) for s, p, o in rows])

    g = Graph(cells(("_:a", "f", E + "1"), ("_:a", "r", "_:b"), ("_:b", "f", E + "2"), ("_:b", "r", lists.NIL), ("_:c", "f", E + "3"), ("_:c", "r", "_:d"), ("_:d", "f", E + "4"), ("_:d", "r", "_:c"), ("_:e", "r", lists.NIL), ("_:g", "f", E + "5"), ("_:h", "r", "_:a"), ("_:h", "f", E + "6"), ("_:i", "r", "_:a"), ("_:i", "f", E + "7"), ("_:i", "f", E + "8")))
    assert {(r["node"], r["problem"]) for r in lists.list_problems(g).collect()} == {("_:c", "cyclic"), ("_:d", "cyclic"), ("_:e", "no first"), ("_:g", "no rest"), ("_:a", "shared"), ("_:i", "several firsts")}
    assert {(r["list"], r["position"], r["o"]) for r in lists.list_members(g).collect()} >= {("_:a", 1, E + "1"), ("_:a", 2, E + "2"), ("_:h", 1, E + "6")}
    assert not lists.list_members(g).filter("list in ('_:c', '_:d')").count()


def test_expand_limit_and_empty(spark):
    es = pairs(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")])
    got = {("".join(r["path"]), r["cut"]) for r in lists.expand(es, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("a", False), ("ab", False), ("abc", True), ("ac", True)}
    assert {len(r["path"]) for r in lists.expand(es, spark.createDataFrame([("a",)], "node string"), limit=1).collect()} == {1, 2}
    assert lists.expand(es, spark.createDataFrame([], "node string")).count() == 0


def test_description_goes_through_blank_nodes_only(spark):
    t = from_tuples(spark, [(E + "a", E + "p", "_:1"), ("_:1", E + "p", "_:2"), ("_:2", E + "p", E + "b"), (E + "b", E + "p", "_:3"), ("_:3", E + "p", E + "c"), ("_:2", E + "q", "_:1")])
    got = {r["s"] for r in construct.describe(t, spark.createDataFrame([(E + "a",)], "s string")).collect()}
    assert got == {E + "a", "_:1", "_:2"}


def test_dataset_reads_its_graph_and_predicate_only(spark):
    d = TableGraph(spark, SF).dataset()
    read = {f.rsplit("/", 1)[-1] for f in d.graph(GRAPHS + "customer").scan(EX + "inNation").inputFiles()}
    assert read == {"customer.parquet"}
    kept = stored_dataset(d.each(v.LABEL, EX + "inNation"))
    one = kept.graph(GRAPHS + "supplier").scan(EX + "inNation")
    assert re.search(r"PartitionFilters: \[[^\]]*p#[^\]]*g#|PartitionFilters: \[[^\]]*g#[^\]]*p#", one._jdf.queryExecution().executedPlan().toString())
    assert one.count() == d.graph(GRAPHS + "supplier").scan(EX + "inNation").count()
    assert kept.graph(E + "none").scan().count() == 0


# --- shapes, occurrences, re-checks, previews, files ------------------------------------------------------------------


def test_shape_rows(spark):
    g = Graph(from_tuples(spark, [(E + "a", v.TYPE, E + "T"), (E + "a", E + "p", "5", v.XSD + "integer", None), (E + "b", v.TYPE, E + "U"), (E + "U", v.SUBCLASS, E + "T"), (E + "b", E + "p", "x", None, "en"), (E + "b", E + "p", E + "a"), (E + "b", E + "q", E + "a"), (E + "c", E + "q", E + "b")]))

    def broken(*rows):
        found = shape_table.validate(g, inline(spark, [("S", kind, target, grp, E + path if path else None, c, value, neg) for kind, target, grp, path, c, value, neg in rows], shape_table.SHAPE))
        return {(r["focus_node"].removeprefix(E), r["broken"]) for r in found.collect()}

    t = ("class", E + "T", None)
    assert broken((*t, "p", "minCount", "2", False)) == {("a", "minCount")}
    assert broken((*t, "p", "minCount", "2", True)) == {("b", "minCount")}
    assert broken((*t, "p", "datatype", v.XSD + "integer", False), (*t, "q", "maxCount", "0", False)) == {("b", "datatype"), ("b", "maxCount")}
    assert broken(("class", E + "T", "x", "p", "nodeKind", "2", False), ("class", E + "T", "x", "q", "hasValue", E + "a", False)) == set()
    assert broken((*t, "p", "qualifiedMin", f"1 {E}T", False)) == {("a", "qualifiedMin")}
    assert broken((*t, "q", "class", E + "T", False), ("subjects", E + "q", None, "q", "class", E + "U", False)) == {("b", "class")}
    assert broken((*t, "q", "equals", E + "p", False)) == {("a", "equals"), ("b", "equals")}
    assert broken((*t, "q", "disjoint", E + "p", False)) == {("b", "disjoint")}
    assert broken((*t, "p", "closed", "", False)) == {("b", "closed")}
    assert broken(("node", E + "nowhere", None, "p", "minCount", "1", False)) == {("nowhere", "minCount")}


def test_occurrences(spark):
    docs = spark.createDataFrame([("d", "# ex:comment\nex:A a owl:Class ;\r\n  ex:p ex:A, (:b). x:no"), ("e", None), ("f", "ex:A")], "doc string, text string")
    prefixes = spark.createDataFrame([("d", "ex", E), ("d", "", "http://default/"), ("f", "ex", "http://f/")], "doc string, prefix string, ns string")
    declared = spark.createDataFrame([("d", E + "A")], "doc string, iri string")
    got = {tuple(r) for r in occurrences.occurrences(docs, prefixes, declared).collect()}
    assert got == {(E + "A", "d", 1, 0, 4, True), (E + "p", "d", 2, 2, 6, False), (E + "A", "d", 2, 7, 11, False), ("http://default/b", "d", 2, 14, 16, False), ("http://f/A", "f", 0, 0, 4, False)}


def test_ledger_runs_what_read_a_change(spark):
    base = [(E + "a", v.LABEL, "x", None, None), (E + "a", v.TYPE, E + "T"), (E + "a", E + "p", E + "b")]
    checks = {"label": lambda g: g.scan(v.LABEL).selectExpr("s focus_node", "cast(null as string) path", "o value"), "type": lambda g: g.typed(E + "T").selectExpr("s focus_node", "cast(null as string) path", "s value"), "all": lambda g: g.scan().selectExpr("s focus_node", "p path", "o value")}
    ledger = recheck.Ledger(spark, checks)

    def run(rows):
        found = {(r["check_id"], r["focus_node"], r["value"]) for r in ledger.run(Graph(from_tuples(spark, rows))).collect()}
        whole = {(id, r["focus_node"], r["value"]) for id, f in checks.items() for r in f(Graph(from_tuples(spark, rows))).collect()}
        assert found == whole
        return ledger.ran

    assert run(base) == ["label", "type", "all"]
    assert run(base) == []
    assert run([*base, (E + "c", v.TYPE, E + "T")]) == ["type", "all"]
    assert run([(E + "a", v.LABEL, "y", None, None), *base[1:]]) == ["label", "type", "all"]
    assert run(base[1:2]) == ["label", "all"]


def test_preview_is_bounded(spark):
    t = from_tuples(spark, [(E + f"{k:02}", v.LABEL, "x", None, "en") for k in range(11)]).withColumn("change", F.lit("added")).unionByName(from_tuples(spark, [(E + "a", v.TYPE, E + "b")]).withColumn("change", F.lit("removed")))
    got = [r["line"] for r in repairs.preview(t, {"e": E, "rdfs": v.RDFS}).orderBy("side", "place").collect()]
    assert got == [*(f'+ e:{k:02} rdfs:label "x"@en' for k in range(8)), f"- e:a {v.TYPE} e:b", "and 3 more"]


def test_places_of_statements(spark, tmp_path):
    """Line numbers over many splits of a file, and formats by name or beginning."""
    lines = [f"<{E}{k}> <{E}p> \"{'v' * (k % 50)}\" ." if k % 7 else "# comment" for k in range(3000)]
    (tmp_path / "x.nt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = {r["s"]: r["seq"] for r in ntriples.read_quads(spark, f"file://{tmp_path}/x.nt").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {E + str(k): k for k in range(3000) if k % 7}
    named = spark.createDataFrame([("a.TTL", ""), ("b", "@prefix e: <x> ."), ("c", "<?xml?>"), ("d", ' {"@id": 1}'), ("e", "<a> <b> <c> ."), ("f", "none")], "name string, head string")
    assert [r[0] for r in named.select(ntriples.file_format(F.col("name"), F.col("head"))).collect()] == ["turtle", "turtle", "rdfxml", "jsonld", "ntriples", None]


def test_values_with_unbound_on_both_sides(spark):
    a = spark.createDataFrame([(1, "x"), (1, None), (None, "y"), (None, None)], "a int, b string")
    b = spark.createDataFrame([(1, None, "p"), (None, "x", "q"), (None, None, "r"), (2, "y", "s")], "a int, b string, tag string")
    fits = lambda x, y: x is None or y is None or x == y
    want = sorted(str((p[0] if p[0] is not None else q[0], p[1] if p[1] is not None else q[1], q[2])) for p in a.collect() for q in b.collect() if fits(p[0], q[0]) and fits(p[1], q[1]))
    assert sorted(str(tuple(r)) for r in construct.compatible_join(a, b, ["a", "b"]).collect()) == want


def test_stored_tables_go(spark):
    tables = contract.Scratch(spark)
    one = tables.put(spark.range(3), "t")
    assert one.count() == 3
    tables.drop(one)
    assert not tables.at and new_path(spark, "x") != new_path(spark, "x")


def test_names_and_paths():
    prefixes = {"rdf": v.RDF, "e": E}
    assert v.expand("e:a", prefixes) == E + "a" and v.expand("x:a", prefixes) == "x:a" and v.shrink(E + "a", prefixes) == "e:a"
    assert v.primary_prefix(prefixes) == "e" and v.primary_prefix({"rdf": v.RDF}) is None
    assert closure.path_text(("/", ("+", "p"), ("^", "q"))) == "(p)+/^(q)" and closure.path_text(("|", "p", "q")) == "p|q"
