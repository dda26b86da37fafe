"""Reasoning, repairs and the term model over the tables, not the schema or a few predicates."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from quadspan import roster
from quadspan import vocab as v
from quadspan.plans import reasoner
from quadspan.sources.rdfview import EX, TableGraph

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_disjoint_members_of_the_whole_closure(spark, con):
    name = "rea_disjoint_closure"
    got = sorted(r["focus_node"] for r in roster.QUERIES[name](spark, SF).collect())
    assert got == sorted(r[0] for r in con.execute(roster.ORACLE[name]).fetchall())
    suppliers = {f"{EX}supplier-{r[0]}" for r in con.execute("SELECT s_suppkey FROM supplier").fetchall()}
    assert suppliers and suppliers <= set(got)


def test_closure_has_the_types_of_all_predicates(spark, con):
    closed = reasoner.reason(TableGraph(spark, SF))
    got = {tuple(r) for r in closed.scan(v.TYPE).select("s", "o").distinct().collect()}
    want = con.execute(f"WITH RECURSIVE {roster.sql_view()}, {roster._closed} SELECT DISTINCT i, t FROM m").fetchall()
    assert got == set(want)


def test_closure_queries_count_every_predicate(spark, con):
    asserted = {r[0] for r in con.execute(f"WITH {roster.sql_view()} SELECT DISTINCT p FROM T").fetchall()}
    assert asserted <= {r["p"] for r in roster.QUERIES["rdfs_closure"](spark, SF).collect()}


def test_repairs_and_terms_read_the_tables(spark, con):
    added = {(r["s"], r["o"], r["change"]) for r in roster.QUERIES["repair_str_001"](spark, SF).collect()}
    assert (EX + "Ordr", v.CLASS, "added") in added
    gone = {(r["s"], r["o"]) for r in roster.QUERIES["repair_sty_003"](spark, SF).filter("change = 'removed'").collect()}
    assert {(f"{EX}nation-{k}", n) for k, n in con.execute("SELECT n_nationkey, n_name FROM nation").fetchall()} <= gone
    named = con.execute(f"WITH {roster.sql_view()} SELECT count(DISTINCT s) FROM T WHERE sk = 0 AND p = '{v.TYPE}'").fetchone()[0]
    assert roster.QUERIES["term_model"](spark, SF).count() == named
