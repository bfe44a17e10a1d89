"""Full records: planner postings, database records, knowledge base, legacy rows and output selection.  C32, C33, C35, K2, K4, K5, K6, K23, X12, X14, F13, O1, O4, O6, E1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions import classify, dates, text, urls, values
from veldra.functions.text import _s, clean, let, present
from veldra.operators.pick import first_by
from veldra.operators.store import union_of, upsert


def normalize_jobs(jobs: DataFrame) -> DataFrame:
    """Postings (id, title, company, location, country, description html, url, apply_url, source_url, platform,
    market, posted_at) as planner postings with all that is derived."""
    j = jobs.withColumn("description", text.html_to_text(F.col("description")))
    body = F.concat_ws("\n", "title", "description")
    j = j.withColumn("market", urls.infer_market(F.col("market"), F.col("country"), F.col("url"), F.col("apply_url"), F.col("source_url"), F.col("platform")))
    j = j.withColumn("_e", dates.experience(body)).withColumn("_c", F.when(F.col("market") == "CN", dates.cn_experience(body)))
    least = F.least(F.col("_e.minYears"), F.col("_c.minYears"))
    j = j.withColumn("min_years", least).withColumn("max_years", F.least(F.col("_e.maxYears"), F.col("_c.maxYears"))).drop("_c", "_e")
    kind = classify.job_type(F.col("title"), F.col("description"), F.col("min_years"))
    cn = F.nullif(classify.cn_job_type(body), F.lit(""))
    j = j.withColumn("job_type", let(kind, lambda k: F.when((F.col("market") == "CN") & (k == "unspecified_full_time"), F.coalesce(cn, k)).otherwise(k)))
    cohort = F.when(F.col("market") == "CN", dates.cohort(body).cast("int"))
    j = j.withColumn("cohort_year", cohort).withColumn("bucket", classify.job_bucket(F.col("title"), F.col("description"), F.col("job_type"), F.col("min_years"), cohort))
    j = j.withColumn("industry", F.coalesce(classify.industry(F.concat_ws("\n", "title", "description", "platform", "company")), F.lit("interdisciplinary")))
    src = urls.source(F.coalesce(F.nullif("url", F.lit("")), "apply_url"))
    return (
        j.withColumn("normalized_title", text.title_key(F.col("title")))
        .withColumn("skills", text.skills(F.col("description")))
        .withColumn("responsibilities", text.responsibilities(F.col("description")))
        .withColumn("requirements", text.requirements(F.col("description")))
        .withColumn("education", F.when(F.col("market") == "CN", dates.education(body)).otherwise(""))
        .withColumn("work_mode", F.when(F.lower(_s(F.col("location"))).contains("remote"), "remote").otherwise("unspecified"))
        .withColumn("source", src["source"])
        .withColumn("source_type", src["sourceType"])
        .withColumn("needs_official_link", src["sourceType"] == "discovery")
        .withColumn("canonical_key", dates.job_key(F.col("company"), F.col("title"), F.col("location")))
    )


def legacy_rows(openings: DataFrame, portals: DataFrame, companies: DataFrame) -> DataFrame:
    """Openings with portal and company as flat rows."""
    o = openings.join(portals.select(F.col("id").alias("careerPortalId"), F.col("companyId").alias("_c"), "pageType", "verificationStatus", "canonicalUrl", "atsType"), "careerPortalId")
    o = o.join(companies.select(F.col("id").alias("_c"), "market", "canonicalName"), "_c")
    at = lambda kind: F.when(F.col("pageType") == kind, urls.clean_url(F.col("canonicalUrl")))
    sources = F.array_distinct(F.array_compact(F.array(urls.clean_url(F.col("sourceUrl")), urls.clean_url(F.col("canonicalUrl")))))
    return o.select(
        urls.market(F.col("market")).alias("market"), clean(F.col("canonicalName")).alias("company"), clean(F.col("title")).alias("title"), F.array_join("locations", ", ").alias("location"), "employmentType", "publishedAt", F.col("atsType").alias("source"),
        (F.col("verificationStatus") == "VERIFIED").alias("officialIdentityConfirmed"), (F.col("pageType") == "CAMPAIGN").alias("campaignConfirmed"), (F.col("pageType") == "JOB_LIST").alias("hasJobList"), (F.col("pageType") == "APPLY").alias("hasApplicationAction"), (F.col("status") == "ACTIVE").alias("applicationActive"),
        at("CAREER_HOME").alias("companyCareerHomeUrl"), at("CAMPAIGN").alias("campaignLandingUrl"), at("JOB_LIST").alias("jobListUrl"), urls.clean_url(F.col("jobDetailUrl")).alias("jobDetailUrl"), urls.clean_url(F.col("applyUrl")).alias("applyUrl"), sources.alias("sourceUrls"),
    )


def ranked_links(found: Column, scope: Column) -> Column:
    """K2: distinct links (structs url, source, type) with official ones first, then by the order of sites of a scope."""
    order = {"internship": ["shixiseng.com", "nowcoder.com", "zhipin.com", "liepin.com"], "social": ["liepin.com", "zhipin.com", "zhaopin.com", "nowcoder.com"], "campus": ["nowcoder.com", "zhipin.com", "yingjiesheng.com", "ncss.cn"]}

    def site(h: Column, names: Sequence[str]) -> Column:
        out = F.lit(1)
        for i, n in reversed(list(enumerate(names))):
            out = F.when(urls.host_in(h, [n]), 50 - i).otherwise(out)
        return out

    def rank(x: Column) -> Column:
        h = urls.bare_host(x["url"])
        by_site = F.when(scope == "internship", site(h, order["internship"])).when(scope == "social", site(h, order["social"])).otherwise(site(h, order["campus"]))
        return let(urls.recruitment_channel(x["url"])["rank"], lambda r: F.when(r >= 3, 100 + r).otherwise(by_site))

    valid = F.filter(found, lambda x: urls.is_url(x["url"]))
    keyed = F.transform(values.first_by(valid, "url"), lambda x, i: F.struct((-rank(x)).alias("r"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def database_records(records: DataFrame, now_ms: int, run_id: str) -> DataFrame:
    """Raw records (company, title, batch_name, location, description, scope, job_type, cohort_year,
    posted_at, first_seen_at, source, links array<struct<url,source,type>>) as rows of the bucketed database."""
    body = F.concat_ws(" ", "title", "batch_name", "description")
    r = records.withColumn("scope", classify.record_scope(F.concat_ws(" ", "title", "batch_name"), F.col("description"), F.col("scope"), F.col("job_type"), F.lit(""), F.col("cohort_year")))
    r = r.withColumn("posted_at", F.coalesce("posted_at", "first_seen_at"))
    r = r.withColumn("cohort_year", dates.cohort_year(F.col("cohort_year"), body, F.col("scope"), F.coalesce("posted_at", F.lit(0))))
    r = r.withColumn("batch", classify.batch(body, F.col("scope"))).withColumn("links", ranked_links(F.col("links"), F.col("scope")))
    official = F.filter("links", lambda x: urls.is_official_channel(urls.recruitment_channel(x["url"])["channel"]))
    r = r.withColumn("primary_url", F.coalesce(F.get(F.transform(official, lambda x: x["url"]), F.lit(0)), F.lit("")))
    r = r.withColumn("sources", F.array_distinct(F.filter(F.transform("links", lambda x: clean(x["source"])), lambda s: s != "")))
    year = F.year(F.timestamp_millis(F.coalesce("posted_at", F.lit(now_ms))))
    r = r.withColumn("project_id", dates.project_key(F.col("company"), F.col("cohort_year"), F.col("scope"), F.col("batch"), year))
    key = dates.record_key(F.col("company"), F.coalesce(present(F.col("title")), F.col("batch_name")), F.col("location"), F.coalesce(F.col("cohort_year").cast("string"), F.lit("")), F.col("batch_name"))
    r = r.withColumn("id", key).withColumn("bucket", classify.database_bucket(F.col("cohort_year"), F.col("scope")))
    return r.withColumn("description", F.substring(clean(F.col("description")), 1, 30_000)).withColumn("first_run_id", F.lit(run_id)).withColumn("last_seen_at", F.lit(now_ms))


def select_output(records: DataFrame, mode: str = "window", scope: str = "all", days: int = 30, cohorts: Sequence[int] = (), run_id: str = "", now_ms: int = 0) -> DataFrame:
    """records of a run, of a scope or of a window; records that only an old listing names are dropped."""
    old = (F.size("links") > 0) & F.forall("links", lambda x: x["url"].rlike(r"(?i)nowcoder\.com/jobs/detail/")) & ~F.exists("sources", lambda s: s.rlike("(?i)NowCoder Schedule"))
    out = records.where(~F.coalesce(old, F.lit(False)))
    if cohorts:
        out = out.where(F.col("cohort_year").isNull() | F.col("cohort_year").isin(*cohorts))
    if scope != "all":
        out = out.where(F.col("scope") == scope)
    if mode == "new":
        return out.where(F.col("first_run_id") == run_id)
    return out if mode == "scope" else out.where(F.coalesce("posted_at", "first_seen_at", F.lit(0)) >= now_ms - max(1, days) * 86_400_000)


def apply_drill(records: DataFrame, drilled: DataFrame) -> DataFrame:
    """K5: records (id, apply_url, job_detail_url, job_list_url, official_url, official_verified) with what a drill
    found (id, status, reachable, identity_confirmed, candidates array<struct<role,url>>)."""
    good = drilled.where(F.col("status").isin("entry_found", "no_action_found"))
    usable = F.filter("candidates", lambda c: ~urls.is_static_asset(c["url"]) & (c["role"] != "UNKNOWN"))
    pick = lambda role: F.get(F.transform(F.filter("_u", lambda c: c["role"] == role), lambda c: c["url"]), F.lit(0))
    d = good.withColumn("_u", usable).select(F.col("id").alias("_id"), pick("DIRECT_APPLICATION").alias("_a"), pick("JOB_DETAIL").alias("_d"), pick("JOB_LIST").alias("_l"), (F.col("reachable") & F.col("identity_confirmed")).alias("_ok"))
    out = records.join(d, records["id"] == F.col("_id"), "left")
    front = F.coalesce("_a", "_d", "_l")
    verified = F.coalesce(F.col("_ok") & front.isNotNull(), F.lit(False)) | F.coalesce("official_verified", F.lit(False))
    return out.select(*(c for c in records.columns if c not in ("apply_url", "job_detail_url", "job_list_url", "official_url", "official_verified")), F.coalesce("_a", "apply_url").alias("apply_url"), F.coalesce("_d", "job_detail_url").alias("job_detail_url"), F.coalesce("_l", "job_list_url").alias("job_list_url"), F.coalesce(front, "official_url").alias("official_url"), verified.alias("official_verified"))


def is_rendered_host(url: Column) -> Column:
    """K5: a host whose pages are made by scripts."""
    h = urls.bare_host(url)
    return F.coalesce(urls.host_in(h, ["mokahr.com", "hotjob.cn", "zhiye.com", "jobs.feishu.cn", "iguopin.com"]) | h.rlike(r"^(?:careers?|campus|apply|jobs?|hr|join|zhaopin|recruitment)\."), F.lit(False))


def route_projects(projects: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """K4: projects (project_id, company, official_verified, application_active, urls array) with route: active_verified,
    direct_hit, cache_hit, invalid_project or ready.  ``cache``: (project_id, expires_at, status)."""
    fresh = cache.where((F.col("expires_at") > now) & (F.col("status") == "success")).select("project_id").distinct().withColumn("_hit", F.lit(True))
    direct = F.exists(F.coalesce("urls", F.array().cast("array<string>")), lambda u: urls.is_official_channel(urls.recruitment_channel(u)["channel"]))
    done = F.coalesce("official_verified", F.lit(False)) & F.coalesce("application_active", F.lit(True))
    route = F.when(done, "active_verified").when(direct, "direct_hit").when(F.col("_hit"), "cache_hit").when((_s(F.col("company")) == "") | F.col("project_id").isNull(), "invalid_project").otherwise("ready")
    return projects.join(fresh, "project_id", "left").withColumn("route", route).drop("_hit")


def prioritized(projects: DataFrame, internships_only: bool = False) -> DataFrame:
    """Summer projects first, then the newest."""
    x = F.concat_ws(" ", "batch", "title")
    out = projects.where(x.rlike("(?i)实习|intern")) if internships_only else projects
    return out.orderBy(F.desc(x.rlike("(?i)暑期|summer")), F.desc(F.coalesce("posted_at", F.lit(0))), "project_id")


def by_rank(candidates: DataFrame) -> DataFrame:
    """O1"""
    return candidates.orderBy(F.coalesce("rank", F.lit(1 << 30)), "url")


def listed(table: DataFrame, *columns: str) -> DataFrame:
    """A store's table in its listing order, last seen first where it has such a column."""
    order = [F.desc(c) for c in ("lastSeenAt", "lastVerifiedAt", "updatedAt") if c in table.columns][:1]
    return table.orderBy(*order, *(columns or ("id",)))


def terminal_status(discovery: Column, blocked: Column, found: Column, target: Column) -> Column:
    """A run's status: discovery's own end, else blocked when short of its target, else complete or partial."""
    return F.when(discovery.isNotNull(), discovery).when(blocked & (found < target), "BLOCKED").when(found >= target, "COMPLETE").otherwise("PARTIAL")


def backfill_events(openings: DataFrame) -> DataFrame:
    """Columns that older rows lack."""
    return openings.withColumn("sourceTier", F.coalesce("sourceTier", F.lit("OFFICIAL_SITE"))).withColumn("status", F.coalesce("status", F.lit("UNKNOWN")))


#: How entities and surfaces merge.
ENTITY_RULES = {"brandNames": union_of, "englishNames": union_of, "officialDomains": union_of, "projectIds": union_of, "createdAt": "old"}
SURFACE_RULES = {"companyIds": union_of, "scope": union_of, "createdAt": "old"}


def knowledge_base(records: DataFrame, definitions: DataFrame, domains: DataFrame, tenants: DataFrame, entities: DataFrame, surfaces: DataFrame) -> dict[str, DataFrame]:
    """Entities, surfaces, candidates and audit from records (company, project_id), definitions (id,
    name, aliases), domains (company, domain, url, verified) and tenants (company, vendor, tenant, url), merged into
    the stored ``entities`` (id, canonicalName, brandNames, englishNames, officialDomains, projectIds, createdAt) and
    ``surfaces`` (id, vendor, tenantKey, canonicalUrl, companyIds, scope, identityStatus, createdAt)."""
    none = F.array().cast("array<string>")
    key = text.company_alias(F.col("company"))
    named = definitions.select(F.col("id"), F.col("name"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", none))).alias("n"))
    known = first_by(named.select("id", "name", text.company_alias(F.col("n")).alias("_k")), ["_k"], F.col("id"))

    def entity(df: DataFrame) -> DataFrame:
        out = df.withColumn("_k", key).join(known, "_k", "left")
        return out.withColumn("entity", F.coalesce("id", dates.prefixed_id("company", F.col("_k")))).withColumn("name", F.coalesce("name", clean(F.col("company")))).drop("id", "_k")

    bad = ["gankinterview.cn", "gankinterview.com", "gaoxiaojob.com", "iguopin.com", "langlangwangshen.com", "liepin.com", "ncss.cn", "niuqizp.com", "niuqizhipin.com", "nowcoder.com", "shixiseng.com", "wondercv.com", "yingjiesheng.com", "zhaopin.com", "zhipin.com"]
    d = entity(domains).withColumn("state", F.when(urls.registrable_domain(F.coalesce("url", "domain")).isin(bad), "rejected").when(F.col("verified") & F.col("url").isNotNull(), "verified").otherwise("candidate"))
    t = entity(tenants)
    r = entity(records)
    every = (
        r.select("entity", "name", none.alias("d"), F.array("project_id").alias("p"))
        .unionByName(d.select("entity", "name", F.when(F.col("state") == "verified", F.array("domain")).otherwise(none).alias("d"), none.alias("p")))
        .unionByName(t.select("entity", "name", none.alias("d"), none.alias("p")))
    )
    one = every.groupBy(F.col("entity").alias("id")).agg(F.min("name").alias("canonicalName"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("d")))).alias("officialDomains"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("p")))).alias("projectIds"))
    new = one.select("id", "canonicalName", none.alias("brandNames"), none.alias("englishNames"), "officialDomains", "projectIds", F.lit(None).cast(entities.schema["createdAt"].dataType).alias("createdAt"))
    own = d.where("state = 'verified'").select(F.lit("SELF_HOSTED").alias("vendor"), F.lit("").alias("tenantKey"), F.col("url").alias("canonicalUrl"), "entity")
    s = own.unionByName(t.select(F.upper("vendor").alias("vendor"), F.coalesce("tenant", F.lit("")).alias("tenantKey"), F.col("url").alias("canonicalUrl"), "entity"))
    s = s.groupBy("vendor", "tenantKey", "canonicalUrl").agg(F.array_sort(F.collect_set("entity")).alias("companyIds"))
    s = s.select(dates.prefixed_id("surface", F.col("vendor"), F.col("tenantKey"), F.col("canonicalUrl")).alias("id"), "vendor", "tenantKey", "canonicalUrl", "companyIds", F.array(F.lit("GENERAL")).alias("scope"), F.lit("VERIFIED").alias("identityStatus"), F.lit(None).cast(surfaces.schema["createdAt"].dataType).alias("createdAt"))
    candidates = d.where("state <> 'verified'").select(F.col("entity").alias("companyId"), F.coalesce("url", F.concat(F.lit("https://"), "domain", F.lit("/"))).alias("url"), F.when(F.col("state") == "rejected", "REJECTED").otherwise("UNVERIFIED").alias("verdict"))
    return {"entities": upsert(entities, new, ["id"], ENTITY_RULES), "surfaces": upsert(surfaces, s, ["id"], SURFACE_RULES), "candidates": candidates, "audit": d.groupBy("state").agg(F.count("*").alias("rows"))}
