"""Queries of functions against their SQL on rows that the small tables lack."""

import datetime

import duckdb
from pyspark.sql import functions as F

from veldra.functions import text
from veldra.plans import queries as plans


def differences(spark, folder, query, name, columns, rows):
    """Rows of a query over a table of these rows that its SQL doesn't have, and the reverse."""
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    df = plans.QUERIES[query](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    want = con.execute(plans.ORACLE[query])
    assert [d[0] for d in want.description] == df.columns
    return set(map(tuple, df.collect())) ^ set(want.fetchall())


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def test_dates_beyond_the_year_9999(spark, tmp_path):
    rows = [(k, k, "O", 1.5, datetime.datetime(2024, 1, 1), "1-URGENT") for k in (2914479, 2914480, 9000001, 53999999)]
    assert not differences(spark, tmp_path, "date_functions", "orders", ORDERS, rows)


CUSTOMERS = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def test_lengths_are_rounded_as_in_sql(spark, tmp_path):
    rows = [(k, f"Customer#{k}", 14, pay, "BUILDING") for k, pay in enumerate((1994.9, 1995.0, 1995.1, 1998.11, 2004.9, 2005.0, -0.5), 1) for k in (2 * k + 1, 2 * k + 100)]
    assert not differences(spark, tmp_path, "more_functions", "customer", CUSTOMERS, rows)


def test_rows_of_one_file_are_dealt_to_many_tasks(spark, tmp_path):
    rows = [(k, f"Customer#{k}", k % 25, 10.0 * (k % 400), "BUILDING") for k in range(3500)]
    spark.createDataFrame(rows, CUSTOMERS).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = plans.QUERIES["class_functions"](spark, str(tmp_path))
    used = df.select("c_custkey", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in used) == 3500 and len(used) == 4


def test_words_of_slugs_are_made_once(spark):
    plan = spark.range(1).select(text.slug_candidates(F.col("id").cast("string")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("split(") == 1
