"""State machines: circuit breaker, daily budget, batch checkpoint and search router.  T2, T3, T5, T6, T10, W9, W12.

Each has a batch form of native functions and, where it is a fold, a streaming form that keeps the state of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CLOSED, OPEN, PROBE = "CLOSED", "OPEN", "PROBE_REQUIRED"


def circuits(events: DataFrame) -> DataFrame:
    """(provider, state, opened_at) from events (provider, at, ts, type), ``at`` a unique order.

    A healthy probe closes the circuit; blocks after the last one open it, and the first of them says since when; a
    request to resume after the last block asks for a probe.  This is the fold in closed form: aggregates that combine
    before the shuffle, not a loop over a provider's events.
    """
    healthy = events.where("type = 'HEALTHY_PROBE'").groupBy("provider").agg(F.max("at").alias("_h"))
    after = events.join(healthy, "provider", "left")
    on = F.col("_h").isNull() | (F.col("at") > F.col("_h"))
    blocked, resume = on & (F.col("type") == "BLOCKED"), on & (F.col("type") == "MANUAL_RESUME_REQUESTED")
    out = after.groupBy("provider").agg(F.min(F.when(blocked, F.col("ts"))).alias("opened_at"), F.max(F.when(blocked, F.col("at"))).alias("b"), F.max(F.when(resume, F.col("at"))).alias("r"))
    state = F.when(F.col("b").isNull(), CLOSED).when(F.col("r") > F.col("b"), PROBE).otherwise(OPEN)
    return out.select("provider", state.alias("state"), "opened_at")


class CircuitBreaker(StatefulProcessor):
    """T3 on a stream of (provider, ts, type): emits (provider, state, opened_at) after each batch of a provider."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string, opened_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, opened = self.state.get() if self.state.exists() else (CLOSED, None)
        for e in pd.concat(list(rows)).sort_values("ts").itertuples(index=False):
            if e.type == "HEALTHY_PROBE":
                state, opened = CLOSED, None
            elif e.type == "BLOCKED":
                state, opened = OPEN, opened or e.ts
            elif e.type == "MANUAL_RESUME_REQUESTED" and state == OPEN:
                state = PROBE
        self.state.update((state, opened))
        yield pd.DataFrame({"provider": [key[0]], "state": [state], "opened_at": pd.Series([opened], dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def circuit_stream(events: DataFrame) -> DataFrame:
    """T3; needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    return events.groupBy("provider").transformWithStateInPandas(CircuitBreaker(), "provider string, state string, opened_at timestamp", "Update", "None")


class DailyBudget(StatefulProcessor):
    """T2 on a stream of (day, ts, request, units): emits accepted; a refused request uses nothing."""

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "used double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used = self.used.get()[0] if self.used.exists() else 0.0
        frame = pd.concat(list(rows)).sort_values(["ts", "request"])
        accepted = []
        for units in frame["units"]:
            ok = used + units <= self.limit
            used += units * ok
            accepted.append(ok)
        self.used.update((float(used),))
        yield pd.DataFrame({"day": frame["day"], "request": frame["request"], "accepted": accepted})

    def close(self) -> None:
        pass


def budget_stream(requests: DataFrame, limit: float) -> DataFrame:
    """T2"""
    return requests.groupBy("day").transformWithStateInPandas(DailyBudget(limit), "day string, request long, accepted boolean", "Append", "None")


def due_items(items: DataFrame, circuit: Column, retry: bool = False, budget: int | None = None) -> DataFrame:
    """Items of a batch that run next, in order: never succeeded ones, failed ones on request, deferred ones
    only while the circuit is closed; none while it is open."""
    runs = (F.col("status") == "PENDING") | (F.lit(retry) & (F.col("status") == "FAILED")) | ((F.col("status") == "DEFERRED") & (circuit == CLOSED))
    due = items.where(runs & (circuit != OPEN)).orderBy("position")
    return due if budget is None else due.limit(budget)


def checkpoint_batch(path: str):
    """T5: a ``foreachBatch`` sink of item results (batchId, itemKey, status): a batch of the stream that comes again
    overwrites what it wrote, so results are written once."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("stream_batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream_batch").parquet(path)

    return write


def route(attempts: DataFrame) -> DataFrame:
    """(query, provider, status, attempts) of the first success in the order of attempts (query, pos, provider,
    status), or else of the last attempt."""
    rank = F.struct((F.col("status") != "success").alias("bad"), F.when(F.col("status") == "success", F.col("pos")).otherwise(-F.col("pos")).alias("p"))
    return attempts.groupBy("query").agg(F.min_by(F.struct("provider", "status"), rank).alias("r"), F.count("*").alias("attempts")).select("query", "r.provider", "r.status", "attempts")


def intervals(searches: DataFrame, least_seconds: int = 10, blocks: int | None = None) -> DataFrame:
    """T4: searches (provider, ts) with the seconds since the provider's one before and whether they came too soon.

    A scan in two levels, so that a provider with most of the searches isn't one task's: searches are dealt by ranges of
    provider and time, each block finds its gaps for itself, and its first search of a provider takes the time before it
    from the blocks' summaries, one row for each block and provider.
    """
    from pyspark.sql import Window

    from veldra.operators.scratch import materialize

    spark = searches.sparkSession
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(searches.repartitionByRange(n, "provider", "ts").withColumn("_block", F.spark_partition_id()))
    ends = dealt.groupBy("provider", "_block").agg(F.max("ts").alias("_end"))
    before = F.lag("_end").over(Window.partitionBy("provider").orderBy("_block"))
    ends = ends.select(F.col("provider").alias("_p"), F.col("_block").alias("_b"), before.alias("_before"))
    inner = F.lag("ts").over(Window.partitionBy("_block", "provider").orderBy("ts"))
    out = dealt.withColumn("_last", inner).join(ends, F.col("provider").eqNullSafe(F.col("_p")) & (F.col("_block") == F.col("_b")), "left")
    gap = F.unix_micros("ts") - F.unix_micros(F.coalesce("_last", "_before"))
    out = out.withColumn("gap_seconds", gap / 1e6).withColumn("too_soon", F.coalesce(F.col("gap_seconds") < least_seconds, F.lit(False)))
    return out.drop("_block", "_last", "_p", "_b", "_before", "_end")
