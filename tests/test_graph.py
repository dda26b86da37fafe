"""The graph engine on small inline graphs, and queries against their SQL over the smallest tables."""

from __future__ import annotations

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quadspan import roster
from quadspan import vocab as v
from quadspan.model import Graph, from_tuples
from quadspan.operators import closure
from quadspan.plans import reasoner
from quadspan.sources import ntriples

SF = "/root/testdata/sf0.001"
E = "http://e/"
#: One of each family; the driver compares all of them.
NAMES = ["check_dat_001", "check_eff_001", "check_log_003", "check_qua_005", "shacl_sty_003", "literal_typing", "algebra_path_plus", "algebra_construct", "algebra_update", "fn_iri", "fn_shrink", "fn_replace", "profiles", "max_depth", "prefix_alignment", "triplify_orders", "csv_profile"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_sql(spark, con, name):
    found = con.execute(roster.ORACLE[name])
    names = [x[0] for x in found.description]
    got = roster.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == sorted(map(str, found.fetchall()))


def test_entry_imports_without_a_session():
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 100, set(e.oracle_sql()) <= set(e.queries()))"], cwd=root, capture_output=True, text=True)
    assert done.stdout.split() == ["True", "True"], done.stderr


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "x string, y string")
    got = {(r["x"], r["y"]) for r in closure.closure(edges).select("x", "y").collect()}
    assert got == {(p, q) for p in "abc" for q in "abc"} | {("x", "y")}


def test_reason(spark):
    t = from_tuples(spark, [(E + "A", v.SUBCLASS, E + "B"), (E + "B", v.SUBCLASS, E + "C"), (E + "i", v.TYPE, E + "A"), (E + "p", v.DOMAIN, E + "D"), (E + "p", v.RANGE, E + "R"), (E + "i", E + "p", E + "j"), (E + "i", E + "p", "text", None, None)])
    got = {(r["s"], r["o"]) for r in reasoner.reason(Graph(t)).scan(v.TYPE).collect()}
    assert {(E + "i", E + x) for x in "ABCD"} | {(E + "j", E + "R")} <= got
    assert not any(s == "text" for s, _ in got)


def test_ntriples_lines(spark):
    lines = ['<http://e/a> <http://e/p> "x\\ty \\u00e9"@en .', '_:b <http://e/p> <http://e/o> <http://e/g> . # note', "# only a comment", "", '<http://e/a> <http://e/p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .', "not a line"]
    got = {(r["s"], r["sk"], r["o"], r["ok"], r["lang"], r["g"]) for r in ntriples.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {("http://e/a", 0, "x\ty é", 2, "en", None), ("_:b", 1, "http://e/o", 0, None, "http://e/g"), ("http://e/a", 0, "5", 2, None, None)}
