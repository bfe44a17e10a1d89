"""Event-time operators over rows (ts, event_type, user_id, value): the same functions serve batch and streams.

These are extensions: T1, T7 and T8 need them; windows, sessions and late data have no other counterpart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Pairs of rows that leave a task at once.
_PAIRS_OUT = 100_000


def tumbling(events: DataFrame, size: str, watermark: str | None = None) -> DataFrame:
    """Counts and sums by type and window; on a stream late rows beyond the watermark are dropped."""
    e = events.withWatermark("ts", watermark) if watermark else events
    out = e.groupBy("event_type", F.window("ts", size)).agg(F.count("*").alias("rows"), F.round(F.sum("value"), 2).alias("value"))
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "rows", "value")


def sessions(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """Sessions of each user that end with a gap."""
    e = events.withWatermark("ts", watermark) if watermark else events
    out = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("rows"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "rows")


def fresh_only(requests: DataFrame, keys: list[str], ttl: str) -> DataFrame:
    """Of a stream of requests those whose key wasn't seen within the time to live."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def latest_unexpired(cache: DataFrame, keys: list[str], now: F.Column, ttl: str) -> DataFrame:
    """T1, batch form: the latest entry of each key that hasn't expired."""
    from veldra.operators.pick import last_by

    return last_by(cache.where(F.col("ts") + F.expr(f"INTERVAL {ttl}") > now), keys, F.col("ts"))


def append_log(logs: DataFrame, path: str, checkpoint: str):
    """An append-only sink; exactly once by the checkpoint."""
    return logs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def cross_listed(offers: DataFrame, history: DataFrame, days: int = 90) -> DataFrame:
    """A stream of offers against static history by fingerprint bands, within the window before each offer."""
    from veldra.functions.text import latin_key
    from veldra.operators.near_dup import THRESHOLD, bands, similarity

    cut = lambda df, n: df.select(F.col("url").alias(f"{n}_url"), latin_key(F.col("company")).alias(f"{n}_company"), F.col("fingerprint").alias(f"{n}_fp"), F.col("ts").alias(f"{n}_ts"), F.explode(bands(F.col("fingerprint"), int((1 - THRESHOLD) * 64))).alias("band"))
    met = cut(offers.where("fingerprint <> ''"), "offer").join(cut(history.where("fingerprint <> ''"), "row"), "band")
    met = met.where("offer_company <> row_company and offer_url <> row_url").where(F.col("row_ts") >= F.col("offer_ts") - F.expr(f"INTERVAL {days} DAYS"))
    score = similarity(F.col("offer_fp"), F.col("row_fp"))
    return met.where(score >= THRESHOLD).select("offer_url", "row_url", score.alias("score"), "offer_ts")


def _meet(rows: pd.DataFrame, fresh: np.ndarray, radius: int, of: np.ndarray) -> Iterator[pd.DataFrame]:
    """Pairs of an offer and a row of history, one of them at least ``fresh``, in the first of the bands that they share."""
    from veldra.operators.near_dup import close, first_met

    fp, band, offer = rows["fp"].to_numpy().view(np.uint64), rows["band"].to_numpy(), rows["offer"].to_numpy()
    key = fp & of[band]
    # of a key: the old offers, the new ones, the new history, the old
    kind = np.where(offer, fresh, 3 - fresh)
    order = np.lexsort((kind, key, band))
    fp, band, key, kind = fp[order], band[order], key[order], kind[order]
    change = np.r_[True, (key[1:] != key[:-1]) | (band[1:] != band[:-1])]
    sizes = np.bincount((np.cumsum(change) - 1) * 4 + kind, minlength=4 * change.sum()).reshape(-1, 4)
    starts = (np.cumsum(sizes) - sizes.ravel()).reshape(-1, 4)
    at, limit = rows["at"].to_numpy()[order], rows["until"].to_numpy()[order]
    company, url = (pd.factorize(rows[c])[0][order] for c in ("company", "url"))
    names = rows["url"].to_numpy()[order]
    held, n = [], 0

    def out() -> pd.DataFrame:
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        return pd.DataFrame({"offer_url": names[i], "row_url": names[j], "bits": np.bitwise_count(fp[i] ^ fp[j]).astype(np.int32), "at": at[i]})

    new_offers = (starts[:, 1], sizes[:, 1]), (starts[:, 2], sizes[:, 2] + sizes[:, 3])
    old_offers = (starts[:, 0], sizes[:, 0]), (starts[:, 2], sizes[:, 2])
    for a, b in (new_offers, old_offers):
        for i, j in close(fp, a, b, radius):
            ok = (at[j] <= at[i]) & (at[j] >= limit[i]) & (company[i] != company[j]) & (url[i] != url[j])
            i, j = i[ok], j[ok]
            ok = first_met(fp[i] ^ fp[j], band[i], of)
            held.append((i[ok], j[ok]))
            n += int(ok.sum())
            if n >= _PAIRS_OUT:
                yield out()
                held, n = [], 0
    if n:
        yield out()


def _listed(radius: int, of: np.ndarray):
    columns = ["offer", "band", "fp", "at", "until", "url", "company"]

    def listed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Rows of the state and of the batch; what no later row can meet is not kept."""
        old = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else pd.DataFrame()
        new = [] if state.hasTimedOut else [b[columns] for b in batches]
        rows = pd.concat([old, *new], ignore_index=True) if len(old) else pd.concat(new, ignore_index=True)
        if len(rows) > len(old):
            yield from _meet(rows, np.arange(len(rows)) >= len(old), radius, of)
        late = state.getCurrentWatermarkMs()
        needed = np.where(rows["offer"].to_numpy(), rows["at"].to_numpy(), rows["until"].to_numpy())
        needed = -(-needed // 1000)
        rows, needed = rows[needed > late], needed[needed > late]
        if not len(rows):
            state.remove()
            return
        table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        state.setTimeoutTimestamp(int(needed.max()) + 1)

    return listed


def cross_listed_streams(offers: DataFrame, history: DataFrame, days: int = 90, delay: str = "1 day", pieces: int = 1, slots: int = 64) -> DataFrame:
    """(offer_url, row_url, score, offer_ts) of a stream of offers against a stream of history (url, company,
    fingerprint, ts): rows of another company and address, seen in the ``days`` before the offer.

    Rows of both meet by fingerprint bands (``pieces`` that must agree, see ``near_dup.agreeing``: more where more
    fingerprints are in the window).  Keys are dealt to ``slots``, whose rows of the window are the state: one Arrow table
    each, not a row of the state store for each key of a fingerprint.  The watermarks, ``delay`` behind the latest times,
    tell what no later row can meet: history after the window, offers at once; it is dropped when a slot gets rows or has
    nothing else left.  A pair that agrees in several bands is taken in the first of them only, so no state is needed to
    tell repetitions.
    """
    from veldra.functions.text import latin_key
    from veldra.operators.near_dup import THRESHOLD, keyed, masks, number

    radius = int((1 - THRESHOLD) * 64)
    of = masks(radius, pieces)

    def side(df: DataFrame, offer: bool) -> DataFrame:
        df = df.where("fingerprint rlike '^[0-9a-f]{16}$'").withWatermark("ts", delay)
        # an offer's window begins there; a row is needed until then, with a day for clocks that are set
        until = F.col("ts") - F.expr(f"INTERVAL {days} DAYS") if offer else F.col("ts") + F.expr(f"INTERVAL {days + 1} DAYS")
        return df.select("ts", F.unix_micros("ts").alias("at"), F.unix_micros(until).alias("until"), F.lit(offer).alias("offer"), "url", latin_key(F.col("company")).alias("company"), number(F.col("fingerprint")).alias("fp"))

    both = side(offers, True).unionByName(side(history, False)).where("at is not null and url is not null and company is not null")
    dealt = keyed(both, of).withColumn("slot", F.pmod(F.xxhash64("band", "key"), F.lit(slots))).drop("key")
    found = dealt.groupBy("slot").applyInPandasWithState(_listed(radius, of), "offer_url string, row_url string, bits int, at long", "rows binary", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("offer_url", "row_url", (1 - F.col("bits") / 64.0).alias("score"), F.timestamp_micros("at").alias("offer_ts"))
