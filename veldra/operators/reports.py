"""Quality, coverage, cost and run reports.  A8 to A23, D13.

Each is one global or grouped aggregate of conditional counts: a row a task is shuffled, whatever the input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.functions.dates import china_day, china_month, ratio
from veldra.functions.text import clean


def quality(observations: DataFrame) -> DataFrame:
    """One row of rates over rows of counters (see the parameter names); null where nothing was evaluated."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    rates = {
        "officialVerificationRate": ("portalsVerified", "portalsEvaluated"),
        "jobExtractionSuccessRate": ("extractionSuccesses", "extractionAttempts"),
        "platformOnlySupersededRate": ("platformOnlySupersededCount", "platformOnlyAcceptanceCount"),
        "duplicateRate": ("duplicateCandidateResults", "validCandidateResults"),
        "falsePositiveRate": ("falsePositiveCount", "groundTruthEvaluated"),
        "unknownAvailabilityRate": ("unknownAvailabilityCount", "availabilityEvaluated"),
        "blockedRate": ("blockedPortals", "portalsEvaluated"),
        "missingStartDateRate": ("missingStartDates", "recruitmentEventsEvaluated"),
        "missingCloseDateRate": ("missingCloseDates", "recruitmentEventsEvaluated"),
        "missingLocationRate": ("missingLocations", "recruitmentEventsEvaluated"),
    }
    scores = F.coalesce("confidenceScores", F.array().cast("array<double>"))
    summed = F.sum(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x))
    return observations.agg(*(ratio(total(n), total(d)).alias(k) for k, (n, d) in rates.items()), F.round(F.try_divide(summed, F.sum(F.size(scores)).cast("double")), 2).alias("averageConfidenceScore"), total("platformOnlyAcceptanceCount").alias("platformOnlyAcceptanceCount"))


def field_coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A10: (field, filled, rows, coverage): how many rows have a value that isn't empty, in one pass."""
    filled = lambda c: F.count_if(clean(F.col(c)) != "")
    one = df.agg(F.count("*").alias("rows"), *(filled(c).alias(f"_{i}") for i, c in enumerate(fields)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"_{i}").alias("filled")) for i, c in enumerate(fields))))
    return one.select(rows.alias("x"), "rows").select("x.field", "x.filled", "rows", ratio(F.col("x.filled"), F.col("rows")).alias("coverage"))


def flag_counts(df: DataFrame, flags: Mapping[str, Column], key: str | None = None) -> DataFrame:
    """One row with the number of rows of each flag, or of distinct keys."""
    count = (lambda c: F.count_if(F.coalesce(c, F.lit(False)))) if key is None else (lambda c: F.count_distinct(F.when(c, F.col(key))))
    return df.agg(*(count(c).alias(n) for n, c in flags.items()))


#: Registers of a sketch are two to the power of this: the standard error is 0.8 %, a sketch has 16 KB at most.
SKETCH_LG = 14
#: Distinct keys up to which a run's report keeps them all, and its count is exact.
EXACT_KEYS = 2000


def distinct_sketches(df: DataFrame, flags: Mapping[str, Column], key: str, by: Sequence[str], exact: int = EXACT_KEYS) -> DataFrame:
    """By run (``by``) and flag a mergeable count of distinct keys: (by, flag, n, keys, sketch).

    n is the run's own count.  Of at most ``exact`` keys their hashes are kept (keys) and can be united exactly; a larger
    run has keys null and only its sketch.  Sketches combine before they are shuffled; a run's keys are gathered up to the
    limit only, from its distinct ones.
    """
    rows = df.select(*by, F.explode(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()))).alias("flag"), F.col(key).cast("string").alias("_k"))
    one = rows.where("flag is not null and _k is not null").groupBy(*by, "flag", "_k").agg(F.count("*").alias("_"))
    place = F.row_number().over(Window.partitionBy(*by, "flag").orderBy("_h"))
    total = one.groupBy(*by, "flag").agg(F.count("*").alias("n"), F.hll_sketch_agg("_k", SKETCH_LG).alias("sketch"))
    kept = one.withColumn("_h", F.xxhash64("_k")).withColumn("_i", place).where(F.col("_i") <= exact).groupBy(*by, "flag").agg(F.array_sort(F.collect_list("_h")).alias("keys"))
    return total.join(kept, [*by, "flag"]).select(*by, "flag", "n", F.when(F.col("n") <= exact, F.col("keys")).alias("keys"), "sketch")


def merged_distinct(sketches: DataFrame, by: Sequence[str], exact: int = EXACT_KEYS) -> DataFrame:
    """Appended ``distinct_sketches`` added up: (by, flag, n, is_exact).

    Where all runs kept their keys and few enough are different, n is their number; else the estimate of the united
    sketches, which is within three standard errors, 2.5 %, of the truth almost always.
    """
    est = sketches.groupBy(*by, "flag").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"), F.bool_and(F.col("keys").isNotNull()).alias("all"), F.sum(F.size("keys")).alias("most"))
    few = est.where("all")
    keys = sketches.join(few.select(*by, "flag"), [*by, "flag"], "left_semi").select(*by, "flag", F.explode("keys").alias("k")).distinct().groupBy(*by, "flag").agg(F.count("*").alias("same"))
    out = est.join(keys, [*by, "flag"], "left")
    sure = F.col("all") & (F.coalesce("same", F.lit(0)) <= exact)
    return out.select(*by, "flag", F.when(sure, F.coalesce("same", F.lit(0))).otherwise(F.col("about")).alias("n"), F.coalesce(sure, F.lit(False)).alias("is_exact"))


def batch_status(items: DataFrame, paused: bool = False) -> DataFrame:
    """Counts by status of a batch's items and the batch's status."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = items.groupBy("batchId").agg(F.count("*").alias("items"), *(n(s).alias(s.lower()) for s in ("SUCCEEDED", "FAILED", "DEFERRED", "PENDING", "BLOCKED")))
    waiting = (F.col("pending") + F.col("deferred")) > 0
    status = F.when(F.lit(paused) & waiting, "PAUSED").when(F.col("failed") > 0, "COMPLETE_WITH_ERRORS").when(waiting, "PARTIAL").otherwise("COMPLETE")
    return out.withColumn("status", status)


def source_coverage(records: DataFrame, projects: DataFrame) -> DataFrame:
    """By source: records fetched and accepted, projects of it alone and merged with others'.

    ``records``: (source, accepted); ``projects``: (project_id, sources array)."""
    fetched = records.groupBy("source").agg(F.count("*").alias("fetched"), F.count_if("accepted").alias("accepted"))
    used = projects.select(F.explode(F.array_distinct("sources")).alias("source"), (F.size(F.array_distinct("sources")) == 1).alias("alone"))
    used = used.groupBy("source").agg(F.count_if("alone").alias("unique_projects"), F.count_if(~F.col("alone")).alias("merged_projects"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return fetched.join(used, "source", "full_outer").select("source", *map(zero, ("fetched", "accepted", "unique_projects", "merged_projects")))


def duplicate_rate(records: int, projects: int) -> float:
    """A11"""
    return round(max(0, records - projects) / records, 4) if records else 0.0


def daily_digest(projects: DataFrame, now_ms: int) -> DataFrame:
    """(section, project_id, company, deadline) of new, soon closing and just verified projects."""
    day = 86_400_000
    closes, checked = F.col("expires_at"), F.coalesce("verified_at", F.lit(0))
    sections = F.array_compact(
        F.array(
            F.when(F.coalesce("new_in_run", F.lit(False)), "new"),
            F.when(closes.between(now_ms, now_ms + 3 * day), "closing_3_days"),
            F.when(closes.between(now_ms, now_ms + 7 * day), "closing_7_days"),
            F.when(F.col("official_verified") & (checked >= now_ms - day), "changed"),
        )
    )
    return projects.select(F.explode(sections).alias("section"), "project_id", "company", F.timestamp_millis(closes).cast("date").alias("deadline"))


def high_value_reviews(queue: DataFrame, *order: Column) -> DataFrame:
    """The first 30 reviews about official pages, conflicts, duplicates or dates (a report of 30 by definition)."""
    return queue.where(F.exists("reasons", lambda r: r.rlike("(?i)官方|冲突|重复|日期|official|conflict|duplicate|date"))).orderBy(*order).limit(30)


def business_quality(projects: DataFrame, now_ms: int) -> DataFrame:
    """One row of counts and completeness rates of projects."""
    has = lambda c: F.coalesce(clean(F.col(c)), F.lit("")) != ""
    rate = lambda c: F.coalesce(ratio(F.count_if(c), F.count("*")), F.lit(0.0))
    active = F.col("expires_at").isNull() | (F.col("expires_at") >= now_ms)
    return projects.agg(
        F.count("*").alias("projects"),
        F.count_if("new_in_run").alias("new_campaigns"),
        F.count_if(active).alias("active_campaigns"),
        F.count_if(~active).alias("expired_campaigns"),
        F.count_if("official_verified").alias("verified_campaigns"),
        F.count_if(F.size("sources") > 1).alias("merged_campaigns"),
        rate(F.col("official_verified")).alias("official_url_valid_rate"),
        rate(has("cohort_year")).alias("graduation_year_completeness"),
        rate(has("batch") & (F.col("batch") != "待确认批次")).alias("recruitment_type_completeness"),
        rate(F.col("expires_at").isNotNull()).alias("deadline_completeness"),
        rate(F.size("locations") > 0).alias("location_completeness"),
    )


def reason_distribution(queue: DataFrame) -> DataFrame:
    """A13"""
    return queue.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def cost(ledger: DataFrame, now: Column, daily_usd: float = 0.5, monthly_usd: float = 4.5) -> DataFrame:
    """One row of the day's and month's cost in China, cost of a query, and what is left of the budgets.

    ``ledger``: (at timestamp in UTC, usd, queries, verified, status)."""
    today, month = china_day(F.col("at")) == china_day(now), china_month(F.col("at")) == china_month(now)
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0.0))
    one = ledger.agg(total("usd", today).alias("d"), total("usd", month).alias("m"), total("queries", month).alias("q"), total("verified", month).alias("v"), F.count_if(month & (F.col("status") == "search_deferred_by_budget")).alias("blocked_by_budget"))
    return one.select(
        F.round("d", 6).alias("daily_cost_usd"),
        F.round("m", 6).alias("monthly_cost_usd"),
        F.round(F.try_divide("m", F.nullif(F.col("q").cast("double"), F.lit(0.0))), 6).alias("cost_per_query"),
        F.round(F.try_divide("m", F.nullif(F.col("v").cast("double"), F.lit(0.0))), 6).alias("cost_per_verified"),
        F.round(F.greatest(F.lit(0.0), F.lit(daily_usd) - F.col("d")), 6).alias("daily_left_usd"),
        F.round(F.greatest(F.lit(0.0), F.lit(monthly_usd) - F.col("m")), 6).alias("monthly_left_usd"),
        "blocked_by_budget",
    )


def cost_by(ledger: DataFrame, key: str, month: str) -> DataFrame:
    """A month's cost by actor or source."""
    return ledger.where(china_month(F.col("at")) == month).groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias(key)).agg(F.round(F.sum("usd"), 6).alias("usd"))


def llm_cost(calls: DataFrame, input_usd: Column, output_usd: Column) -> DataFrame:
    """Calls with their cost by prices of a million tokens; null where any part is unknown."""
    return calls.withColumn("cost_usd", F.try_divide(F.col("input_tokens") * input_usd + F.col("output_tokens") * output_usd, F.lit(1e6)))


def anomalies(records: DataFrame, now_ms: int) -> DataFrame:
    """(id, type) of what is wrong with records (id, company, title, primary_url, n_links, posted_at, scope,
    cohort_year)."""
    found = F.array_compact(
        F.array(
            F.when(clean(F.col("company")) == "", "missing_company"),
            F.when(clean(F.col("title")) == "", "missing_title"),
            F.when((clean(F.col("primary_url")) == "") & (F.coalesce("n_links", F.lit(0)) == 0), "missing_url"),
            F.when(F.col("posted_at") > now_ms + 86_400_000, "future_posted_at"),
            F.when((F.col("scope") == "campus") & F.col("cohort_year").isNull(), "campus_cohort_unknown"),
        )
    )
    twice = records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.explode(F.array_repeat(F.lit("duplicate_id"), F.col("n").cast("int") - 1)).alias("type"))
    return records.select("id", F.explode(found).alias("type")).unionByName(twice)


def link_audit(records: DataFrame) -> DataFrame:
    """(decision, links, records) of governed links (array of structs url, decision)."""
    return records.select("id", F.explode("links").alias("l")).groupBy(F.col("l.decision").alias("decision")).agg(F.count("*").alias("links"), F.count_distinct("id").alias("records"))


def verdict_metrics(candidates: DataFrame) -> DataFrame:
    """A20"""
    return candidates.groupBy("verdict").agg(F.count("*").alias("candidates"), F.count_distinct("companyId").alias("companies"))
