"""Links that are combined where they stand, trees below sources, and baskets with odd keys."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadspan.operators import contract
from quadspan.sources.rdfview import _basket_query, baskets


def _plain(links: dict) -> set:
    out = set()
    for node in links:
        at, steps, seen = node, 0, {}
        while at in links and at not in seen:
            seen[at] = steps
            at, steps = links[at], steps + 1
        if at in links:
            way = list(seen)
            out.add((node, None, min(way[seen[at] :])))
        else:
            out.add((node, at, steps))
    return out


@pytest.mark.parametrize("block", [1, 7, 500_000])
def test_jump_blocks(spark, monkeypatch, block):
    """Chains, trees, cycles within a block and over several, and ways into them."""
    monkeypatch.setattr(contract, "BLOCK", block)
    rng = np.random.default_rng(block)
    to = rng.integers(0, 130, 100)
    links = {f"n{i}": f"n{k}" for i, k in enumerate(to.tolist())} | {f"c{i}": f"c{i + 1}" for i in range(60)} | {f"r{i}": f"r{(i + 1) % 9}" for i in range(9)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = contract.jump(spark.createDataFrame(list(links.items()), "node string, next string").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(links)
    assert {(r["node"], r["end"], r["steps"] if r["cycle"] is None else r["cycle"]) for r in got} == _plain(links)


def test_jump_deals_few(spark, monkeypatch):
    """Lists that stand together in their table aren't jumped over."""
    seen, put = [], contract.Scratch.put
    monkeypatch.setattr(contract.Scratch, "put", lambda self, df, name="scratch": (seen.append(name), put(self, df, name))[1])
    links = spark.range(0, 4000, 1, 1).select(F.concat(F.lit("a"), "id").alias("node"), F.concat(F.lit("a"), (F.col("id") - 1)).alias("next"))
    assert contract.jump(links.filter("next <> 'a-1'")).agg(F.max("steps")).collect()[0][0] == 3999
    assert "jumped" not in seen


def test_reachable(spark):
    rng = np.random.default_rng(5)
    edges = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 120, (110, 2)).tolist()} | {("n0", "n0"), ("n3", "n4")}
    sources = {f"n{k}" for k in range(0, 120, 11)}
    front, want = set(sources), set()
    while front:
        front = {b for a, b in edges if a in front} - want
        want |= front
    of = spark.createDataFrame([(s,) for s in sorted(sources)], "x string")
    got = contract.reachable(spark.createDataFrame(sorted(edges), "x string, y string"), of, of).collect()
    assert Counter(r["node"] for r in got) == Counter(want)


def test_baskets_odd_keys(spark, tmp_path):
    """Lines without an order, with equal rows, and parts that are there twice give each triple once."""
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT * FROM (VALUES (1, 5, 1, 1, DATE '1995-01-01'), (1, 5, 1, 1, DATE '1995-01-01'), (NULL, 6, 1, 1, DATE '1995-01-01'), (NULL, 6, 1, 2, DATE '1995-01-01'), (103, NULL, 1, 1, DATE '1995-01-01'), (103, 2, 1, 2, DATE '1995-01-01'), (97, 2, 1, 1, DATE '1995-01-01'), (-89, 2, 1, 1, DATE '1995-01-01')) x(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate)")
    con.execute("CREATE TABLE part AS SELECT * FROM (VALUES (1), (2), (2), (NULL), (5)) x(p_partkey)")
    for t in ("lineitem", "part"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    g = baskets(spark, str(tmp_path))
    by_sql = spark.sql(f"SELECT s, sk, p, o, ok FROM ({_basket_query('{lines}', '{parts}')})", lines=spark.read.parquet(f"{tmp_path}/lineitem.parquet"), parts=spark.read.parquet(f"{tmp_path}/part.parquet"))
    assert Counter(tuple(r) for r in g.scan().select("s", "sk", "p", "o", "ok").collect()) == Counter(tuple(r) for r in by_sql.collect())
