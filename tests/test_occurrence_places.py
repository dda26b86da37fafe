"""Places of names in lines: no posting is dealt to be placed, prefixes may be frames or columns."""

import duckdb
from pyspark.sql import functions as F

from quadspan import roster_structures  # noqa: F401
from quadspan.model import inline
from quadspan.plans.occurrences import occurrences
from quadspan.roster import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_frames_and_columns(spark):
    docs = inline(spark, [(1, " a:x (b:y) c:no\n# a:z\na:é é a:x"), (2, "a:x"), (3, "")], "doc long, text string")
    prefixes = inline(spark, [(1, "a", "A/"), (1, "b", "B/"), (1, "b", "C/")], "doc long, prefix string, ns string")
    declared = inline(spark, [(1, "A/x")], "doc long, iri string")
    got = sorted(tuple(r) for r in occurrences(docs, prefixes, declared).collect())
    assert got == [("A/x", 1, 0, 1, 4, True), ("A/x", 1, 2, 6, 9, False), ("B/y", 1, 0, 6, 9, False), ("C/y", 1, 0, 6, 9, False)]
    given = docs.filter("doc = 1").withColumns({"prefixes": F.expr("array(named_struct('prefix', 'a', 'ns', 'A/'), named_struct('prefix', 'b', 'ns', 'B/'), named_struct('prefix', 'b', 'ns', 'C/'))"), "declared": F.expr("array('A/x')")})
    assert sorted(tuple(r) for r in occurrences(given).collect()) == got


def test_index_deals_counts_only(spark):
    found = QUERIES["occurrence_index"](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(ORACLE["occurrence_index"])
    at = [[x[0] for x in cur.description].index(n) for n in found.columns]
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r[k] for k in at) for r in cur.fetchall())
