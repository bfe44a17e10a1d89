import datetime as dt

import pytest
from pyspark.sql import functions as F

from veldra.streaming import events, state

T0 = dt.datetime(2026, 1, 1)
at = lambda m: T0 + dt.timedelta(minutes=m)


@pytest.fixture
def stream(spark, tmp_path):
    """A file stream over batches of rows, and a run of it to its end."""

    def make(batches, schema):
        folder = tmp_path / "in"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))

    def run(df, mode="append"):
        got = []
        q = df.writeStream.foreachBatch(lambda b, i: got.extend(b.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return got

    return make, run


def test_tumbling_stream_equals_batch(spark, stream):
    make, run = stream
    schema = "ts timestamp, event_type string, user_id long, value double"
    rows = [(at(m), "ab"[m % 2], m % 3, 1.0) for m in range(0, 300, 7)]
    df = make([rows[:20], rows[20:]], schema)
    got = run(events.tumbling(df, "1 hour", "1 hour"), "complete")
    want = events.tumbling(spark.createDataFrame(rows, schema), "1 hour").collect()
    assert {tuple(r) for r in got} >= {tuple(r) for r in want}


def test_fresh_only(spark, stream):
    make, run = stream
    df = make([[(at(0), "k"), (at(1), "k"), (at(2), "j")]], "ts timestamp, key string")
    assert sorted(r.key for r in run(events.fresh_only(df, ["key"], "10 minutes"))) == ["j", "k"]


CIRCUIT = [("p", at(0), "BLOCKED"), ("p", at(1), "BLOCKED"), ("p", at(2), "MANUAL_RESUME_REQUESTED"), ("q", at(0), "BLOCKED"), ("q", at(1), "HEALTHY_PROBE"), ("r", at(0), "HEALTHY_PROBE"), ("r", at(1), "BLOCKED"), ("s", at(0), "MANUAL_RESUME_REQUESTED")]
STATES = {"p": ("PROBE_REQUIRED", at(0)), "q": ("CLOSED", None), "r": ("OPEN", at(1)), "s": ("CLOSED", None)}


def test_circuits(spark):
    df = spark.createDataFrame(CIRCUIT, "provider string, ts timestamp, type string").withColumn("at", F.col("ts"))
    assert {r.provider: (r.state, r.opened_at) for r in state.circuits(df).collect()} == STATES


def test_stateful_circuits_and_budgets(spark, stream, tmp_path):
    make, run = stream
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = make([CIRCUIT[:4], CIRCUIT[4:]], "provider string, ts timestamp, type string")
    last = {}
    for r in run(state.circuit_stream(df), "update"):
        last[r.provider] = (r.state, None if str(r.opened_at) == "NaT" else r.opened_at)
    assert last == STATES


def test_stateful_budget(spark, stream):
    make, run = stream
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = make([[("d", at(0), 1, 3.0), ("d", at(1), 2, 5.0)], [("d", at(2), 3, 2.0), ("e", at(3), 4, 9.0)]], "day string, ts timestamp, request long, units double")
    assert {r.request: r.accepted for r in run(state.budget_stream(df, 5.0))} == {1: True, 2: False, 3: True, 4: False}


def test_router_items_and_gates(spark):
    a = spark.createDataFrame([("q", 0, "x", "error"), ("q", 1, "y", "success"), ("q", 2, "z", "success"), ("w", 0, "x", "error"), ("w", 1, "y", "empty")], "query string, pos int, provider string, status string")
    assert {r.query: (r.provider, r.status, r.attempts) for r in state.route(a).collect()} == {"q": ("y", "success", 3), "w": ("y", "empty", 2)}
    items = spark.createDataFrame([("a", 0, "PENDING"), ("b", 1, "SUCCEEDED"), ("c", 2, "FAILED"), ("d", 3, "DEFERRED")], "itemKey string, position int, status string")
    due = lambda c, **k: [r.itemKey for r in state.due_items(items, F.lit(c), **k).collect()]
    assert due("CLOSED") == ["a", "d"] and due("CLOSED", retry=True, budget=2) == ["a", "c"] and due("PROBE_REQUIRED") == ["a"] and due("OPEN") == []
    s = spark.createDataFrame([("p", at(0)), ("p", T0 + dt.timedelta(seconds=5)), ("p", at(1))], "provider string, ts timestamp")
    assert sorted(r.too_soon for r in state.intervals(s).collect()) == [False, False, True]
