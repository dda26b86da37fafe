"""Triples of the tables, each once, without dealing triples where keys tell."""

import shutil

import pytest

from quadspan.model import TRIPLE
from quadspan.sources.rdfview import EX, TableGraph, ontology

SF = "/root/testdata/sf0.001"
SOME = (EX + "ofOrder", EX + "hasOrder", EX + "orderDay", EX + "byUser", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type")


@pytest.fixture
def copied(spark, tmp_path):
    """The tables, with the rows of orders twice."""
    for name in ("region", "nation", "customer", "supplier", "part", "lineitem", "events", "documents"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path)
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.unionByName(orders).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_unique_keys_deal_no_triples(spark):
    found = TableGraph(spark, SF).distinct(EX + "ofOrder", EX + "hasOrder", EX + "byUser")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(s#") <= 1  # the schema's few
    assert found.count() == found.dropDuplicates(TRIPLE).count()


def test_repeated_rows(spark, copied):
    found, plain = TableGraph(spark, copied).distinct(*SOME), TableGraph(spark, SF).distinct(*SOME)
    assert found.count() == plain.count() == found.dropDuplicates(TRIPLE).count()
    assert found.exceptAll(plain).isEmpty()


def test_schema_of_a_table(spark):
    g = TableGraph(spark, SF, [*ontology(), (EX + "order-1", EX + "placedBy", EX + "customer-1")])
    assert g.mixed
    found = g.distinct(EX + "placedBy")
    assert found.count() == found.dropDuplicates(TRIPLE).count()
