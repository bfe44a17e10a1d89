import datetime as dt
import heapq
import random

from pyspark.sql import functions as F

from veldra.operators import graph, near_dup, reports
from veldra.streaming.events import cross_listed_streams
from veldra.streaming.state import intervals


def plain_drill(seeds, edges, nodes, depth):
    """The queue of one company, in a plain loop."""
    heap = [(-100.0, 0, 0, u) for u in set(seeds)]
    heapq.heapify(heap)
    seen = {}
    while heap and len(seen) < nodes:
        _, d, _, u = heapq.heappop(heap)
        if u in seen:
            continue
        seen[u] = d
        if d < depth:
            for src, dst, pos, score in edges:
                if src == u:
                    heapq.heappush(heap, (d - score, d + 1, pos, dst))
    return [(u, d, n + 1) for n, (u, d) in enumerate(seen.items())]


def test_priority_drill_against_a_heap(spark):
    r = random.Random(7)
    for nodes, depth in ((5, 2), (25, 2), (12, 3), (3, 1), (40, 0)):
        edges = [(f"p{r.randrange(30)}", f"p{r.randrange(60)}", k, float(r.randrange(12))) for k in range(300)] + [("p1", "p1", 900, 99.0)]
        seeds = {"a": ["p1", "p2"], "b": ["p3"], "c": ["nowhere"], "d": ["p1"]}
        got = graph.priority_drill(spark.createDataFrame([(c, u) for c, us in seeds.items() for u in us], "company string, url string"), spark.createDataFrame(edges, "src string, dst string, pos long, score double"), nodes, depth).collect()
        for c, us in seeds.items():
            assert sorted(((x.url, x.depth, x.visit) for x in got if x.company == c), key=lambda x: x[2]) == plain_drill(us, edges, nodes, depth), (nodes, depth, c)


def test_intervals_against_a_loop_with_any_number_of_blocks(spark):
    r = random.Random(3)
    at = dt.datetime(2026, 1, 1)
    rows = [(r.choice(["hot"] * 8 + ["b", None]), at + dt.timedelta(seconds=r.randrange(4000))) for _ in range(400)]
    last, want = {}, []
    for p, t in sorted(rows, key=lambda x: x[1]):
        gap = (t - last[p]).total_seconds() if p in last else None
        last[p] = t
        want.append((p, t, gap, gap is not None and gap < 10))
    df = spark.createDataFrame(rows, "provider string, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp"))
    for blocks in (1, 3, 16):
        got = intervals(df, 10, blocks).withColumn("ts", F.col("ts").cast("timestamp_ntz")).select("provider", "ts", "gap_seconds", "too_soon").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_distinct_counts_that_add_up(spark):
    r = random.Random(5)
    rows = [(f"d{k % 3}", r.randrange(9000), r.random() < 0.5) for k in range(30_000)] + [("d9", None, True), ("d9", 5, None)]
    df = spark.createDataFrame(rows, "day string, user int, big boolean")
    flags = {"big": F.col("big"), "low": F.col("user") < 100, "none": F.col("user") < 0}
    runs = reports.distinct_sketches(df, flags, "user", ["day"])
    of = lambda f, d=None: len({u for day, u, b in rows if u is not None and (d is None or day == d) and f(u, b)})
    kept = {(x.day, x.flag): x for x in runs.collect()}
    assert all(kept[d, "big"].n == of(lambda u, b: b, d) and kept[d, "big"]["keys"] is None for d in ("d0", "d1", "d2"))
    assert all(len(kept[d, "low"]["keys"]) == kept[d, "low"].n == of(lambda u, b: u < 100, d) for d in ("d0", "d1", "d2"))
    total = {x.flag: x for x in reports.merged_distinct(runs, []).collect()}
    assert total["low"].is_exact and total["low"].n == of(lambda u, b: u < 100)
    truth = of(lambda u, b: b)
    assert not total["big"].is_exact and abs(total["big"].n - truth) <= 0.025 * truth
    # runs that are exact each, but not together
    some = reports.distinct_sketches(df, {"low": F.col("user") < 100}, "user", ["day"], exact=100)
    assert [x.is_exact for x in reports.merged_distinct(some, [], exact=50).collect()] == [False]


def listings(r, n):
    base = [random.Random(k).getrandbits(64) for k in range(6)]
    rows = []
    for k in range(n):
        v = r.choice(base)
        for _ in range(r.randrange(7)):
            v ^= 1 << r.randrange(64)
        rows.append((f"u{k % (n - 5)}", r.choice("AB"), f"{v:016x}" if r.random() < 0.95 else "", dt.datetime(2026, 1, 1) + dt.timedelta(days=r.randrange(200))))
    return rows


def test_cross_listings_against_all_pairs(spark):
    r = random.Random(9)
    offers, history = listings(r, 80), listings(r, 120)
    make = lambda rows: spark.createDataFrame(rows, "url string, company string, fingerprint string, ts timestamp_ntz").withColumn("seen", F.col("ts").cast("date"))
    close = lambda a, b: a[2] and b[2] and (int(a[2], 16) ^ int(b[2], 16)).bit_count() <= 5 and a[1] != b[1] and a[0] != b[0]
    first = dt.datetime(2026, 6, 1) - dt.timedelta(days=90)
    want = sorted({(a[0], b[0], 1 - (int(a[2], 16) ^ int(b[2], 16)).bit_count() / 64) for a in offers for b in history if b[3] >= first and close(a, b)})
    for part in (4096, 3):
        got = near_dup.cross_listings(make(offers), make(history), F.lit("2026-06-01").cast("date"), part=part)
        assert sorted(map(tuple, got.collect())) == want and want


def test_cross_listed_streams_drop_what_has_left_the_window(spark, tmp_path):
    r = random.Random(11)
    rows = sorted(listings(r, 90), key=lambda x: x[3])
    folder = str(tmp_path / "in")
    schema = "url string, company string, fingerprint string, ts timestamp"
    source = lambda: spark.readStream.schema(schema).parquet(folder)
    kept = []
    # thirty rows at a time, as they come
    for k in range(0, len(rows), 30):
        spark.createDataFrame(rows[k : k + 30], "url string, company string, fingerprint string, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
        run = cross_listed_streams(source(), source(), days=20).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        run.awaitTermination()
        kept.append(run.lastProgress.stateOperators[0].numRowsTotal)
    got = spark.read.parquet(str(tmp_path / "out")).select("offer_url", "row_url").collect()
    want = [(a[0], b[0]) for a in rows for b in rows if b[3] <= a[3] <= b[3] + dt.timedelta(days=20) and a[2] and b[2] and (int(a[2], 16) ^ int(b[2], 16)).bit_count() <= 5 and a[1] != b[1] and a[0] != b[0]]
    assert sorted(map(tuple, got)) == sorted(want) and want
    # six bands a row on each of two sides: without dropping, all of them would stay
    assert kept[-1] < 0.6 * 2 * 6 * sum(bool(x[2]) for x in rows)
