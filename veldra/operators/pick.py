"""Picking one row of each key, and joins against what was seen.  The IDs are those of the operator inventory.

Every pick takes an explicit order, so results don't depend on partitions.  A pick is an aggregate of ``max_by``
kind, not a window: it combines before the shuffle, so that a key with a third of all rows costs a row a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions.dates import job_key
from veldra.functions.urls import clean_url


def _pick(df: DataFrame, keys: list[str], order: list[Column], least: bool) -> DataFrame:
    columns = df.columns
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    take = F.min_by if least else F.max_by
    kept = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(take(F.struct(*(df[c] for c in columns)), rank).alias("_row"))
    return kept.select("_row.*").select(*columns)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes first in the order."""
    return _pick(df, keys, list(order), True)


def last_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes last in the order."""
    return _pick(df, keys, list(order), False)


def best_by(df: DataFrame, keys: list[str], score: Column, seq: Column) -> DataFrame:
    """The row of each key with the highest score, the first of equals."""
    return first_by(df, keys, -score, seq)


def top_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key; the window's rank limit is pushed below the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def richness(description: Column, company: Column, location: Column, posted_at: Column) -> Column:
    """How much a posting says."""
    has = lambda x: F.coalesce(x.cast("string"), F.lit("")) != ""
    return F.coalesce(F.length(description), F.lit(0)) + F.when(has(company), 50).otherwise(0) + F.when(has(location), 30).otherwise(0) + F.when(has(posted_at), 20).otherwise(0)


def source_rank(kind: Column) -> Column:
    """Official systems before sites before verified platforms before discoveries."""
    from veldra.functions.rules import SOURCE_RANK

    return F.coalesce(F.create_map(*(F.lit(v) for kv in SOURCE_RANK.items() for v in kv))[kind], F.lit(0))


def dedupe_jobs(jobs: DataFrame, seq: str = "seq") -> DataFrame:
    """Postings (region, url, company, title, location, description, posted_at, source_type, seq): the
    richest of each region and url, then the most official of each region and identity, with canonical_key,
    alternate_urls and cross_source (whether the identity had several urls)."""
    rich = richness(F.col("description"), F.col("company"), F.col("location"), F.col("posted_at"))
    url = F.regexp_replace(F.coalesce(clean_url(F.col("url")), F.col("url")), r"(?i)[?&](?:utm_[^=&]*|gh_src|source|ref|trk)[^=&]*=[^&#]*", "")
    one = first_by(jobs.withColumn("url", F.regexp_replace(url, "/$", "")).withColumn("_rich", rich), ["region", "url"], -F.col("_rich"), F.col(seq))
    keyed = one.withColumn("canonical_key", job_key(F.col("company"), F.col("title"), F.col("location")))
    order = F.struct((-source_rank(F.col("source_type"))).alias("a"), (-F.col("_rich")).alias("b"), F.col(seq).alias("c"))
    columns = [c for c in keyed.columns if c not in ("_rich", "region", "canonical_key")]
    out = keyed.groupBy("region", "canonical_key").agg(F.min_by(F.struct(*columns), order).alias("_r"), F.array_sort(F.collect_set("url")).alias("_urls"), F.count("*").alias("_n"))
    return out.select("region", "canonical_key", "_r.*", F.array_except("_urls", F.array("_r.url")).alias("alternate_urls"), (F.col("_n") > 1).alias("cross_source"))


def merge_results(results: DataFrame, keys: list[str], last_non_empty: list[str], last: list[str], any_true: list[str], lists: list[str], seq: str = "seq") -> DataFrame:
    """A1: rows of a key merged in the order of ``seq``: the last that isn't empty, the last even if null, whether any
    is true, and the union of lists in order."""
    lastly = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(seq))).alias(c)
    even_null = lambda c: F.max_by(F.struct(c), F.col(seq))[c].alias(c)
    out = results.groupBy(*keys).agg(*map(lastly, last_non_empty), *map(even_null, last), *(F.bool_or(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in any_true), F.count("*").alias("merged"))
    for c in lists:
        out = out.join(list_union(results, keys, c, seq).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), c), reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))), "left")
        out = out.drop(*(f"_k{i}" for i in range(len(keys)))).withColumn(c, F.coalesce(c, F.array().cast(results.schema[c].dataType)))
    return out.select(*keys, *last_non_empty, *last, *any_true, *lists, "merged")


def list_union(rows: DataFrame, keys: list[str], column: str, seq: str = "seq") -> DataFrame:
    """A1, A5: (keys, column) with the distinct items of a key's lists, in the order in which they first occur.  Only
    distinct items and their first place are gathered, after they are combined on the map side."""
    items = rows.select(*keys, F.col(seq).alias("_s"), F.posexplode(column).alias("_p", "_x"))
    first = items.groupBy(*keys, "_x").agg(F.min(F.struct("_s", "_p")).alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda x: x["_x"]).alias(column))


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not seen; null keys were not."""
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Keys with several rows and their number."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def running_budget(requests: DataFrame, day: str, limit: int, *order: Column) -> DataFrame:
    """Requests of one unit with accepted: whether they fit into their day's budget.

    ``order`` tells all requests of a day apart.  Only the first ``limit`` of each day are ranked, a limit that is
    pushed below the shuffle; the last of them is the day's bound, which all requests are compared with.
    """
    first = top_n(requests.select(F.col(day).alias("_day"), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))).alias("_at")), ["_day"], limit, F.col("_at"))
    bound = first.groupBy("_day").agg(F.max("_at").alias("_last"))
    at = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    out = requests.withColumn("_at", at).join(bound, F.col(day).eqNullSafe(F.col("_day")), "left")
    return out.withColumn("accepted", F.coalesce(F.col("_at") <= F.col("_last"), F.lit(False))).drop("_at", "_day", "_last")


def shard(df: DataFrame, seq: str, n: int, k: int) -> DataFrame:
    """The rows whose number leaves k modulo n."""
    return df.where(F.pmod(F.col(seq), F.lit(n)) == k)


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """N rows in the order of a seeded hash of a key: the same for the same seed, however rows are dealt."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def until_confident(rows: DataFrame, keys: list[str], round_col: str, confident: Column) -> DataFrame:
    """Of each key the rounds up to the first with a confident row."""
    firsts = rows.where(confident).groupBy(*keys).agg(F.min(round_col).alias("_first"))
    return rows.join(firsts, keys, "left").where(F.col("_first").isNull() | (F.col(round_col) <= F.col("_first"))).drop("_first")


def append_all(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_keyed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key is new."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))
