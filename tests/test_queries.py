import os

import duckdb
import pytest

import __spark_entry__ as entry
from veldra.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(names), sorted((tuple(tidy(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_against_duckdb(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.ORACLE[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in want.description], want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entity_resolution_and_upsert_read_whole_tables(spark):
    sf = "/root/testdata/sf0.01"  # the smallest with more suppliers than a few
    met = plans.QUERIES["entity_resolution"](spark, sf).collect()
    suppliers = {r.s_suppkey for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    customers = [r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").collect()]
    want = {c: {c // 15, c // 15 + c % 2} & suppliers for c in customers}
    assert {r.id: r.targets for r in met} == {c: len(t) for c, t in want.items() if t}
    assert max(r.target for r in met if r.target) > 1_000_000_000_050 and {r.conflict for r in met} == {True, False}
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    assert plans.QUERIES["upsert_merge"](spark, sf).count() == orders.select("o_custkey").distinct().count()


def test_dedupe_by_whole_text_loses_no_text(spark):
    sf = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("source", "text").distinct().count()
    assert plans.QUERIES["dedupe_richest"](spark, sf).count() == texts
