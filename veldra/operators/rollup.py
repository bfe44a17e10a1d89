"""Roll-ups of postings into companies, projects and events.  A2, A3, A4, A5, J1, O3, K6, A17."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions.rules import EVENT_LABELS
from veldra.functions.text import _s, clean, planner_company, present
from veldra.functions.values import unique_strings


def _first(column: str, seq: str) -> Column:
    """The first value in order that isn't empty."""
    return F.min_by(column, F.when(F.coalesce(F.col(column).cast("string"), F.lit("")) != "", F.col(seq))).alias(column)


def companies(jobs: DataFrame, seq: str = "seq") -> DataFrame:
    """A2: (company_key, company, open_jobs, locations, sources) of postings (company, location, source, seq).

    Lists are sets, sorted; the postings themselves stay in their table, where the key finds them.
    """
    key = F.coalesce(F.nullif(planner_company(F.col("company")), F.lit("")), present(F.col("company")), F.lit("unknown"))
    return (
        jobs.withColumn("company_key", key)
        .groupBy("company_key")
        .agg(
            F.coalesce(F.min_by("company", F.when(_s(F.col("company")) != "", F.col(seq))), F.lit("Unknown")).alias("company"),
            F.count("*").alias("open_jobs"),
            F.array_sort(F.collect_set(F.nullif(F.col("location"), F.lit("")))).alias("locations"),
            F.array_sort(F.collect_set(F.nullif(F.col("source"), F.lit("")))).alias("sources"),
        )
    )


def projects(records: DataFrame, seq: str = "seq") -> DataFrame:
    """A3: records (project_id, company, cohort_year, batch, title, location, posted_at, expires_at, first_seen_at,
    verified_at, source, official_verified, identity_confirmed, campaign_confirmed, application_active, new_in_run, and
    the link roles apply_url, job_detail_url, job_list_url, campaign_url, career_url) of a project as one row.

    The latest record represents it; dates span all; flags are or-ed; each link role has its first address, and an
    address stands in one role only, the foremost.
    """
    latest = F.struct(F.coalesce("verified_at", "posted_at", F.lit(0)), -F.col(seq))
    links = ["apply_url", "job_detail_url", "job_list_url", "campaign_url", "career_url"]
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    verified = yes("official_verified") & yes("identity_confirmed") & yes("campaign_confirmed")
    flat = records.groupBy("project_id").agg(
        F.max_by(F.struct("company", "cohort_year", "batch"), latest).alias("r"),
        F.array_sort(F.collect_set(F.nullif(clean(F.col("title")), F.lit("")))).alias("job_titles"),
        F.array_sort(F.collect_set(F.nullif(clean(F.col("location")), F.lit("")))).alias("locations"),
        F.array_sort(F.collect_set(F.nullif(clean(F.col("source")), F.lit("")))).alias("sources"),
        F.min(F.coalesce("posted_at", "first_seen_at")).alias("posted_at"),
        F.max("expires_at").alias("expires_at"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.bool_or(yes("new_in_run")).alias("new_in_run"),
        F.bool_or(verified).alias("official_verified"),
        F.bool_or("application_active").alias("application_active"),
        F.count("*").alias("records"),
        *(_first(c, seq) for c in links),
    )
    out = flat.select("project_id", "r.*", *(c for c in flat.columns if c not in ("project_id", "r")))
    for i, c in enumerate(links[1:], 1):
        out = out.withColumn(c, F.when(F.col(c).isin(*map(F.col, links[:i])), None).otherwise(F.col(c)) if i == 0 else F.when(F.array_contains(F.array_compact(F.array(*links[:i])), F.col(c)), None).otherwise(F.col(c)))
    role = F.when(F.col("apply_url").isNotNull(), "DIRECT_APPLICATION").when(F.col("job_detail_url").isNotNull(), "JOB_DETAIL").when(F.col("job_list_url").isNotNull(), "JOB_LIST").when(F.col("campaign_url").isNotNull(), "CAMPAIGN_LANDING").when(F.col("career_url").isNotNull(), "CAREER_HOME")
    cohort = F.when(F.col("cohort_year").isNotNull(), F.concat(F.col("cohort_year").cast("string"), F.lit("届"))).otherwise("")
    return out.withColumn("entry_role", role).withColumn("project_name", F.concat(_s(F.col("company")), cohort, _s(F.col("batch")))).withColumn("status", F.when(F.col("official_verified"), "verified").otherwise("discovered"))


def merge_events(events: DataFrame, seq: str = "seq") -> DataFrame:
    """A5: events of one id: locations united, earliest start and close, first seen kept."""
    from veldra.operators.pick import list_union

    out = events.groupBy("event_id").agg(F.min("start_at").alias("start_at"), F.min("closes_at").alias("closes_at"), F.min_by("first_seen_at", seq).alias("first_seen_at"))
    return out.join(list_union(events, ["event_id"], "locations", seq), "event_id", "left").withColumn("locations", F.coalesce("locations", F.array().cast("array<string>")))


def event_label(kind: Column, campaign: Column, cohort: Column) -> Column:
    """A4"""
    base = F.coalesce(F.when(kind == "SPECIAL_PROGRAM", present(campaign)), F.create_map(*(F.lit(v) for kv in EVENT_LABELS.items() for v in kv))[kind], clean(kind))
    return F.when(clean(cohort) != "", F.concat(clean(cohort), F.lit(" 届"), base)).otherwise(base)


def application_rows(events: DataFrame, companies: DataFrame, portals: DataFrame, jobs: DataFrame, superseded: bool = False, ordered: bool = True) -> DataFrame:
    """A row for each event with company and portal, and the titles and places of its active jobs.

    Events of superseded platform portals go unless ``superseded``.  Sorted by tier, company (in Chinese collation),
    class and label, which is a sort of all rows, unless it isn't ``ordered``.
    """
    active = jobs.where((F.col("status") == "ACTIVE") & F.col("recruitmentEventId").isNotNull())
    titles = active.groupBy(F.col("recruitmentEventId").alias("id")).agg(F.array_sort(F.collect_set(F.nullif(clean(F.col("title")), F.lit("")))).alias("titles"))
    places = active.select(F.col("recruitmentEventId").alias("id"), F.explode("locations").alias("p")).groupBy("id").agg(F.array_sort(F.collect_set(F.nullif(clean(F.col("p")), F.lit("")))).alias("places"))
    e = events.join(companies.select(F.col("id").alias("companyId"), "canonicalName", "industryTags"), "companyId")
    e = e.join(portals.select(F.col("id").alias("careerPortalId"), "supersededByPortalId", F.col("lastVerifiedAt").alias("_pv")), "careerPortalId")
    if not superseded:
        e = e.where(~((F.col("sourceTier") == "PLATFORM_ONLY") & F.col("supersededByPortalId").isNotNull()))
    e = e.join(titles, "id", "left").join(places, "id", "left")
    where = unique_strings(F.concat(F.coalesce("locations", F.array().cast("array<string>")), F.coalesce("places", F.array().cast("array<string>"))))
    rank = F.when(F.col("sourceTier") == "OFFICIAL_SITE", 0).when(F.col("sourceTier") == "OFFICIAL_ATS", 1).otherwise(2)
    rows = e.select(
        clean(F.col("canonicalName")).alias("company"),
        F.array_join(unique_strings(F.col("industryTags")), "、").alias("company_type"),
        clean(F.col("sourceTier")).alias("source_tier"),
        event_label(F.col("recruitmentType"), F.col("campaignName"), F.col("cohort")).alias("batch"),
        clean(F.col("cohort")).alias("cohort"),
        _s(F.col("startAt")).alias("start_at"),
        _s(F.col("closesAt")).alias("closes_at"),
        F.array_join(where, "、").alias("locations"),
        F.array_join(F.coalesce("titles", F.array().cast("array<string>")), "；").alias("titles"),
        F.col("directoryUrl").alias("url"),
        clean(F.col("status")).alias("status"),
        _s(F.coalesce("lastVerifiedAt", "_pv")).alias("verified_at"),
        rank.alias("_rank"),
    )
    return (rows.orderBy("_rank", F.collate("company", "zh_Hans"), "cohort", F.collate("batch", "zh_Hans")) if ordered else rows).drop("_rank")


def knowledge_baseline(surfaces: DataFrame) -> DataFrame:
    """(dimension, value, rows): surfaces by vendor, type and company, in one pass."""
    wide = surfaces.select(F.explode(F.create_map(F.lit("vendor"), F.col("vendor"), F.lit("type"), F.col("type"), F.lit("company"), F.col("company"))).alias("dimension", "value"))
    return wide.groupBy("dimension", "value").agg(F.count("*").alias("rows"))
