"""Queries of priority queues, scans of hot keys and counts that can be added up, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.operators import graph, near_dup, reports
from veldra.operators.scratch import materialize, scratch_root
from veldra.plans.queries import _FP, query, table
from veldra.streaming.events import cross_listed_streams


@query("""
WITH RECURSIVE e AS (SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst, c_custkey AS pos, c_acctbal AS score FROM customer
 UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 1000000000 + o_orderkey, o_totalprice / 50 FROM orders
 UNION ALL SELECT 'c' || a.c_custkey, 'c' || b.c_custkey, 2000000000 + b.c_custkey, b.c_acctbal + 1 FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 25 AND a.c_nationkey = b.c_nationkey),
k AS (SELECT src, list({'pos': pos, 'dst': dst, 'score': score::DOUBLE}) AS kids FROM e GROUP BY src),
w AS (
 SELECT n_nationkey AS company, [{'s': -100.0::DOUBLE, 'd': 0, 'p': 0::BIGINT, 'u': 'n' || n_nationkey}] AS q, []::VARCHAR[] AS seen, []::INTEGER[] AS deep FROM nation
 UNION ALL
 SELECT company, list_concat(q[2:], CASE WHEN NOT list_contains(seen, q[1].u) AND q[1].d < 2 THEN list_transform(coalesce(kids, []), lambda x: {'s': q[1].d - x.score, 'd': q[1].d + 1, 'p': x.pos::BIGINT, 'u': x.dst}) ELSE [] END),
  CASE WHEN NOT list_contains(seen, q[1].u) THEN list_append(seen, q[1].u) ELSE seen END, CASE WHEN NOT list_contains(seen, q[1].u) THEN list_append(deep, q[1].d) ELSE deep END
 FROM (SELECT company, list_sort(q) AS q, seen, deep FROM w) v LEFT JOIN k ON k.src = v.q[1].u
 WHERE len(q) > 0 AND len(seen) < 25
),
f AS (SELECT company, seen, deep FROM w QUALIFY row_number() OVER (PARTITION BY company ORDER BY len(seen) DESC) = 1)
SELECT company, unnest(seen) AS url, unnest(deep) AS depth, unnest(range(1, len(seen) + 1))::INTEGER AS visit FROM f
""")
def priority_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each nation to its customers, their orders and neighbours, the best page first, 25 pages of each."""
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    edge = lambda df, src, dst, pos, score: df.select(src.alias("src"), dst.alias("dst"), pos.cast("long").alias("pos"), score.cast("double").alias("score"))
    a, b = c.alias("a"), c.alias("b")
    near = a.join(b, (F.col("b.c_custkey") == F.col("a.c_custkey") + 25) & (F.col("a.c_nationkey") == F.col("b.c_nationkey")))
    edges = edge(c, node("n", "c_nationkey"), node("c", "c_custkey"), F.col("c_custkey"), F.col("c_acctbal"))
    edges = edges.unionByName(edge(o, node("c", "o_custkey"), node("o", "o_orderkey"), F.col("o_orderkey") + 1000000000, F.col("o_totalprice") / 50))
    edges = edges.unionByName(edge(near, node("c", "a.c_custkey"), node("c", "b.c_custkey"), F.col("b.c_custkey") + 2000000000, F.col("b.c_acctbal") + 1))
    return graph.priority_drill(n.select(F.col("n_nationkey").alias("company"), node("n", "n_nationkey").alias("url")), edges)


_DAYS = {"clicked": "click", "bought": "purchase", "failed": "error"}


@query(f"""
WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type IN ({", ".join(f"'{v}'" for v in _DAYS.values())}))
SELECT CASE event_type {" ".join(f"WHEN '{v}' THEN '{k}'" for k, v in _DAYS.items())} END AS flag, sum(n)::BIGINT AS by_run, (SELECT count(DISTINCT user_id) FROM e x WHERE x.event_type = d.event_type) AS users, true AS right
FROM (SELECT event_type, day, count(DISTINCT user_id) AS n FROM e GROUP BY ALL) d GROUP BY event_type
""")
def distinct_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by day and kind, reports of days added up; where the sum is an estimate, whether it is within its
    stated error."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    flags = {k: F.col("event_type") == v for k, v in _DAYS.items()}
    runs = reports.distinct_sketches(e, flags, "user_id", ["day"])
    total = reports.merged_distinct(runs, [])
    truth = e.select(F.explode(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items()))).alias("flag"), "user_id").where("flag is not null").groupBy("flag").agg(F.count_distinct("user_id").alias("users"))
    right = F.when(F.col("is_exact"), F.col("n") == F.col("users")).otherwise(F.abs(F.col("n") - F.col("users")) <= 0.025 * F.col("users"))
    return runs.groupBy("flag").agg(F.sum("n").alias("by_run")).join(total, "flag").join(truth, "flag").select("flag", "by_run", "users", right.alias("right"))


_LISTED = f"{_FP}, r AS (SELECT doc_id, source, CAST('0x' || fp AS UBIGINT) AS v, TIMESTAMP '2024-01-01' + to_days((doc_id % 170)::INTEGER) AS ts FROM documents JOIN f USING (doc_id))"
_PAIRS = "SELECT a.doc_id AS offer, b.doc_id AS listed, 1 - bit_count(xor(a.v, b.v)) / 64 AS score FROM r a JOIN r b ON a.source <> b.source AND a.doc_id <> b.doc_id AND bit_count(xor(a.v, b.v)) <= 5"


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings of their sources, over 170 days."""
    d = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") % 170 * 86400)
    return d.select(F.col("doc_id").cast("string").alias("url"), F.col("source").alias("company"), near_dup.fingerprints(F.col("text")).alias("fingerprint"), at.alias("ts"))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.col("offer_url").cast("long").alias("offer"), F.col("row_url").cast("long").alias("listed"), "score")


@query(f"WITH {_LISTED} {_PAIRS} AND b.ts::DATE >= DATE '2024-04-01'")
def cross_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against those of other sources that were seen in the 90 days before the end of June."""
    rows = materialize(_listings(spark, sf_dir))
    return _pairs(near_dup.cross_listings(rows, rows.withColumn("seen", F.col("ts").cast("date")), F.lit("2024-06-30").cast("date")))


#: Rows of a slot of the streams, in each band that they are in.
SLOT_ROWS = 100_000


@query(f"WITH {_LISTED} {_PAIRS} AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 90 DAYS")
def cross_listing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8, J5 on streams: the same as rows of two streams that meet, each offer against the 90 days before it."""
    folder, out, at = (f"{scratch_root(spark)}/veldra/{uuid.uuid4().hex}" for _ in range(3))
    rows = _listings(spark, sf_dir)
    rows.write.parquet(folder)
    n = spark.read.parquet(folder).count()
    pieces = near_dup.agreeing(n, 5)
    slots = max(64, 2 * n * len(near_dup.masks(5, pieces)) // SLOT_ROWS)
    source = lambda: spark.readStream.schema(rows.schema).parquet(folder)
    run = cross_listed_streams(source(), source(), pieces=pieces, slots=slots).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
    run.awaitTermination()
    return _pairs(spark.read.schema("offer_url string, row_url string, score double, offer_ts timestamp").parquet(out))
