"""Plans that must not grow through the driver, one task or the disk."""

import datetime
import random

import duckdb
from pyspark.sql import functions as F

from veldra.operators import near_dup, similarity
from veldra.plans import join_queries, source_queries
from veldra.plans import queries as plans
from veldra.streaming.events import cross_listed_streams


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffled(spark):
    """Rows that the stages of this application have written for shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def pages(spark, folder, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")


def test_sections_of_odd_pages(spark, tmp_path):
    html = ["<title> a &quot;b&quot; &amp; c &lt;</title><h1>x</h1>", "<p>no title</p>", "", None, "<title>z</title><svg><title>a</title></svg><ul><li><h1>in</h1></li></ul>", "<title>cut &amp</title><h1><b>y</b></h1>"]
    pages(spark, tmp_path, [(k, "u", h) for k, h in enumerate(html)])
    got = plans.QUERIES["expand_sections"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(plans.ORACLE["expand_sections"]).fetchall())


def test_trackers_are_many_files_with_headings(spark, sf, monkeypatch):
    want = sorted(map(tuple, source_queries.tracker_log(spark, sf).collect()))
    monkeypatch.setattr(source_queries, "TRACKER_ROWS", 100)
    many = source_queries.tracker_log(spark, sf)
    assert many.rdd.getNumPartitions() > 4 and sorted(map(tuple, many.collect())) == want


def test_similar_pairs_are_shuffled_without_their_items(spark):
    sets = spark.createDataFrame([(1, "b", ["x", "y"]), (2, "b", ["y", "x"])], "id int, block string, items array<string>")
    found = similarity.similar_sets(sets, sets)
    assert "_items" not in next(x for x in optimized(found).splitlines() if "Aggregate" in x or "Deduplicate" in x)
    assert [r.shared for r in found.collect()] == [2]


def test_exploded_fingerprints_are_not_broadcast(spark):
    rows = spark.range(40).select(F.col("id").cast("string").alias("url"), F.concat(F.lit("c"), F.col("id")).alias("company"), F.lpad(F.hex("id"), 16, "0").alias("fingerprint"), F.lit(datetime.date(2026, 1, 1)).alias("seen"))
    found = near_dup.cross_listings(rows.select("url", "company", F.lower("fingerprint").alias("fingerprint")), rows.withColumn("fingerprint", F.lower("fingerprint")), F.lit("2026-01-02").cast("date"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "band" in x and "x#" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_events_are_dealt_to_tasks(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.lit("{}").alias("props"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert join_queries._nested(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_streams_keep_tables_of_slots_not_rows_of_bands(spark, tmp_path):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(5)]
    start = datetime.datetime(2026, 1, 1)
    near = lambda v: v ^ sum(1 << b for b in r.sample(range(64), r.randrange(5)))
    rows = [(f"u{k % 110}", r.choice("ABC"), f"{near(r.choice(base)):016x}", start + datetime.timedelta(days=r.randrange(10))) for k in range(120)]
    folder, schema = str(tmp_path / "in"), "url string, company string, fingerprint string, ts timestamp"
    source = lambda: spark.readStream.schema(schema).parquet(folder)
    # not in their order: history comes after the offers that it is listed for, within the delay
    for k in (0, 60):
        spark.createDataFrame(rows[k : k + 60], schema.replace("timestamp", "timestamp_ntz")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
        found = cross_listed_streams(source(), source(), days=4, delay="30 days", pieces=2)
        run = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        run.awaitTermination()
    # before: 21 keys of each row on each of two sides
    assert run.lastProgress.stateOperators[0].numRowsTotal <= 64
    bits = lambda a, b: (int(a[2], 16) ^ int(b[2], 16)).bit_count()
    want = [(a[0], b[0], 1 - bits(a, b) / 64, a[3]) for a in rows for b in rows if b[3] <= a[3] <= b[3] + datetime.timedelta(days=4) and bits(a, b) <= 5 and a[1] != b[1] and a[0] != b[0]]
    got = spark.read.parquet(str(tmp_path / "out")).select("offer_url", "row_url", "score", F.col("offer_ts").cast("timestamp_ntz"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_near_pairs_are_compared_in_groups_and_met_once(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(4)]
    near = lambda v: v ^ sum(1 << b for b in r.sample(range(64), r.randrange(6)))
    rows = [(k, "" if k % 40 == 0 else f"{near(r.choice(base)):016x}") for k in range(300)]
    docs = spark.createDataFrame(rows, "id long, fingerprint string")
    least = {}
    for i, f in rows:
        least.setdefault(f, i)
    ids = [(i, int(f, 16)) for f, i in least.items() if f]
    want = sorted((a, b, (x ^ y).bit_count()) for a, x in ids for b, y in ids if a < b and (x ^ y).bit_count() <= 5)
    # whole keys, and keys cut into many parts, some of which are empty
    for part in (4096, 40, 2):
        found = near_dup.near_pairs(docs, part=part)
        assert sorted(map(tuple, found.collect())) == want and want
    # before: candidates met in a join, were told by strings and shuffled again to drop repetitions
    assert "Aggregate" not in optimized(found) and "x.band" not in optimized(found) and "MapInPandas" in optimized(found)
    text = spark.createDataFrame([("ä", "00ff00ff00ff00ff"), ("b", "00ff00ff00ff00fe")], "id string, fingerprint string")
    assert [tuple(x) for x in near_dup.near_pairs(text).collect()] == [("b", "ä", 1)]


def test_cross_listings_are_compared_as_numbers(spark):
    rows = spark.createDataFrame([("u", "a", "00ff00ff00ff00ff"), ("v", "b", "00ff00ff00ff00fe")], "url string, company string, fingerprint string").withColumn("seen", F.lit(datetime.date(2026, 1, 1)))
    found = near_dup.cross_listings(rows, rows, F.lit("2026-01-02").cast("date"))
    # before: each candidate of the join was told by expressions on strings
    assert "Join" in optimized(found) and "RLIKE" not in optimized(found) and "conv(" not in optimized(found)
    assert sorted(map(tuple, found.collect())) == [("u", "v", 1 - 1 / 64), ("v", "u", 1 - 1 / 64)]


def test_totals_of_similar_sets_against_the_nested_loop(spark):
    r = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    some = lambda n, most: [(k, r.choice("xxxy"), r.choices(words, weights=[1 / (w + 1) for w in range(30)], k=r.randrange(most))) for k in range(n)]
    left = some(120, 8) + [(200, "x", words[:20] + [f"l{k}" for k in range(300)]), (201, "x", None), (202, None, ["w0"])]
    right = some(200, 12) + [(400, "x", words + [f"l{k}" for k in range(300)]), (401, "x", [None]), (402, None, ["w0"]), (403, "z", ["w0"])]
    side = lambda rows: spark.createDataFrame(rows, "id long, block string, items array<string>").repartition(3)
    a, b = side(left), side(right)
    want = {}
    for _, x, s in left:
        met = [(i, len(set(s) & set(t))) for i, y, t in right if s and t and x == y and x and len(set(s) & set(t)) / min(len(set(s)), len(set(t))) >= 0.6]
        if met:
            want[x, tuple(sorted(set(s)))] = (len(met), min(i for i, _ in met), max(n for _, n in met))
    for part in (30, similarity.PART):
        totals = similarity.similar_totals(a.drop("id"), b, 0.6, part)
        keys = {row.a: (row.block, tuple(sorted(set(row["items"])))) for row in a.withColumn("a", similarity.set_key(F.col("block"), F.col("items"))).where("block is not null and size(items) > 0").collect()}
        assert {keys[row.a]: (row.n, row.first, row.most) for row in totals.collect()} == want


def test_titles_meet_sentences_without_rows_of_pairs(spark, tmp_path):
    # all titles and sentences are alike and long: neither their pairs nor their items are rows
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    pages(spark, tmp_path, [(k, "u", f'<html lang="en"><title>{" ".join(words[: 90 + k])}</title>') for k in range(9)])
    docs = [(k, " ".join(words[k:]) + ". End", "en") for k in range(20)] + [(30, None, "en"), (31, "aa. b", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = shuffled(spark)
    found = sorted(map(tuple, plans.QUERIES["similar_titles"](spark, str(tmp_path)).collect()))
    assert shuffled(spark) - before < 500
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(plans.ORACLE["similar_titles"]).fetchall()
    assert len(want) == 9 and want[0][1] == 20 and found == sorted(want)
