"""End-to-end compositions over source tables.  Z1 to Z12.

What the outside world would give (search hits, fetched pages, feeds, advice of a model) comes in as tables; ``now``
is always a parameter.  Nothing is collected; a rejected row stays with its reason.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions import classify, dates, text, urls
from veldra.operators import builders, filters, graph, near_dup, pick, reports, resolve, rollup, store, verify


def search_companies(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Scored candidates of companies.  ``queries``: (company, query, round); ``hits``: (query, rank,
    url, title, snippet, kind).  Each url of a company once, by its best score; rounds after the first confident one
    don't count."""
    h = queries.join(hits, "query")
    tokens = text.brand_tokens(F.col("company"))
    score = classify.site_score(F.col("url"), F.col("title"), F.col("snippet"), tokens["tokens"], tokens["cjkOnly"])
    policy = classify.source_policy(F.col("url"), F.col("company"), F.col("title"), F.col("kind"))
    scored = h.withColumn("score", score).withColumn("decision", policy["decision"]).withColumn("reason", policy["reasonCode"])
    scored = scored.withColumn("url", F.coalesce(F.nullif(urls.canonical_url(F.col("url")), F.lit("")), F.col("url")))
    within = pick.until_confident(scored, ["company"], "round", (F.col("score") >= 1.0) & (F.col("decision") == "VERIFY_OFFICIAL_CANDIDATE"))
    return pick.best_by(within, ["company", "url"], F.col("score"), F.struct("round", "rank", "query"))


def verify_candidates(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates (company, url) with their page's state and the verdict on whose it is.  ``pages``:
    (requestedUrl, finalUrl, status, html, seq); a page that is missing is FETCH_FAILED."""
    fetched = resolve.lookup_pages(candidates, pages)
    page = classify.surface_page(F.coalesce("finalUrl", "url"), F.col("html"), F.col("status"))
    own = classify.page_identity(F.col("html"), F.array("company"))
    medium = F.array_compact(F.array(F.when(F.size(own["signals"]) > 0, "page_company_name_match"), F.when(own["confirmed"], "job_content_match")))
    tokens = text.brand_tokens(F.col("company"))
    strong = F.array_compact(F.array(F.when(classify.site_score(F.coalesce("finalUrl", "url"), F.lit(""), F.lit(""), tokens["tokens"], tokens["cjkOnly"]) >= 0.8, "official_registry_domain")))
    risks = classify.domain_risks(F.coalesce("finalUrl", "url"), F.array().cast("array<string>"), text.strip_tags(F.col("html"), False))
    who = classify.identity(strong, medium, risks, page["pageRole"], page["vacancyStatus"], F.col("status"), F.lit(True), F.lit(False))
    out = fetched.withColumn("page", page).withColumn("identity", who)
    return out.select(*candidates.columns, "outcome", "page.*", "identity.verdict", "identity.identityStatus")


def scan(jobs: DataFrame, config: Mapping, history: DataFrame, seen_roles: DataFrame, windows: DataFrame, now: Column, today: str) -> DataFrame:
    """Postings (seq, url, title, company, location, description, posted_at timestamp, salary struct) with stage,
    the first filter that each fails or ``added``, and their fingerprint.

    The cheap filters come first; joins only see what passed them.  Within the run the first of each url, and then of
    each company and role, wins in the order of ``seq``.
    """
    title = config.get("title", {})
    words = [*title.get("positive", ())]
    stage = filters.first_failed_stage(
        title=filters.title_filter(F.col("title"), words, title.get("negative", ())),
        tier=filters.tier_filter(classify.tier(F.col("title")), config.get("skip_tiers", ())),
        location=filters.location_filter(F.col("location"), **config.get("location", {})),
        age=filters.age_filter(F.col("posted_at"), now, config.get("max_age_days")),
        salary=filters.salary_filter(F.col("salary.min"), F.col("salary.max"), F.col("salary.currency"), **config.get("salary", {})),
        content=filters.content_filter(F.col("description"), F.col("title"), words, **config.get("content", {})),
    )
    staged = jobs.withColumn("stage", stage)
    passed, failed = staged.where("stage = 'added'"), staged.where("stage <> 'added'")
    settled = history.where(filters.is_settled(F.col("status"), F.col("first_seen"), today, config.get("recheck_after_days"))).select("url").distinct()
    role = F.concat(F.lower(F.trim("company")), F.lit("::"), F.lower(F.trim("title")))
    p = passed.withColumn("_role", role)
    first_url = p.groupBy("url").agg(F.min("seq").alias("_u"))
    p = p.join(first_url, "url").join(settled.withColumn("_seen", F.lit(True)), "url", "left")
    p = p.withColumn("stage", F.when(F.col("_seen") | (F.col("seq") > F.col("_u")), "seen_url").otherwise("added")).drop("_seen", "_u")
    first_role = p.where("stage = 'added'").groupBy("_role").agg(F.min("seq").alias("_r"))
    known = seen_roles.select(F.concat(F.lower(F.trim("company")), F.lit("::"), F.lower(F.trim("role"))).alias("_role")).distinct().withColumn("_known", F.lit(True))
    p = p.join(first_role, "_role", "left").join(known, "_role", "left")
    p = p.withColumn("stage", F.when(F.col("stage") != "added", F.col("stage")).when(F.col("_known") | (F.col("seq") > F.col("_r")), "seen_role").otherwise("added")).drop("_r", "_known", "_role")
    p = filters.cooldown(p, windows, today).withColumn("stage", F.when((F.col("stage") == "added") & F.col("cooldown").isNotNull(), "cooldown").otherwise(F.col("stage")))
    out = p.unionByName(failed, allowMissingColumns=True)
    return out.withColumn("fingerprint", F.when(F.col("stage") == "added", near_dup.fingerprints(F.when(F.col("stage") == "added", F.col("description")))).otherwise(F.lit("")))


def shard_scan(companies: DataFrame, n: int, k: int, limit: int | None = None, seed: int | None = None) -> DataFrame:
    """A shard of the companies (seq, slug), sampled by a seed if one is given."""
    part = pick.shard(companies, "seq", n, k)
    if limit is None:
        return part
    return pick.sample(part, limit, seed, "slug") if seed is not None else part.orderBy("seq").limit(limit)


def discover(intents: DataFrame, hits: DataFrame, pages: DataFrame, edges: DataFrame, openings: DataFrame, now: Column, freshness_days: int = 90, target: int = 50) -> dict[str, DataFrame]:
    """Tables portals, evidence, events, openings and rejected.

    ``intents``: (intent, query, providers, topK, pos); ``hits``: (query, provider, rank, url, title, snippet, company,
    official_domain, kind); ``pages``: (requestedUrl, finalUrl, status, html, seq); ``edges``: (src, dst, pos);
    ``openings``: (url, title, location, published timestamp, closes, apply_url, status).
    """
    found = filters.natural_results(intents.join(hits, "query"), ["intent", "query"], 20, F.col("rank"))
    company = F.coalesce(F.nullif(text.company_hint(F.col("company"), F.col("title")), F.lit("")), text.infer_company(F.col("title"), F.col("snippet")))
    policy = classify.source_policy(F.col("url"), company, F.col("title"), F.col("kind"))
    hits_ = found.withColumn("company", company).withColumn("decision", policy["decision"]).withColumn("url", urls.clean_url(F.col("url")))
    bad = hits_.where("decision <> 'VERIFY_OFFICIAL_CANDIDATE' or company = ''").select("url", "company", F.col("decision").alias("reason"))
    good = pick.first_by(hits_.where("decision = 'VERIFY_OFFICIAL_CANDIDATE' and company <> ''").select("company", "url", "official_domain", "rank"), ["company", "url"], F.col("rank"), F.col("official_domain"))
    reached = graph.frontier(good, edges)
    domains = good.where("official_domain <> ''").groupBy("company").agg(F.min("official_domain").alias("official_domain"))
    visited = resolve.lookup_pages(reached.join(domains, "company", "left"), pages)
    portals = visited.where("outcome = 'FETCHED'").select(F.sha2(F.concat_ws("|", "company", "url").cast("binary"), 256).alias("portal"), "company", "url", "html", "status", F.coalesce("official_domain", F.lit("")).alias("official_domain"), F.lit(False).alias("tenant_verified"), (F.col("depth") > 0).alias("official_linked"))
    page = classify.surface_page(F.col("url"), F.col("html"), F.col("status"))
    evidence = verify.page_evidence(portals).join(portals.select("portal", page["pageRole"].alias("page_type")), "portal")
    verdicts = verify.verdicts(evidence, "portal", "page_type", F.col("code"))
    verified = portals.drop("html", "status").join(verdicts.where("status = 'VERIFIED'").select("portal"), "portal")
    o = openings.join(verified, "url")
    reason = filters.opening_rejection(F.col("status"), F.lit(True), F.lit(True), F.coalesce(urls.clean_url(F.col("apply_url")), urls.clean_url(F.col("url"))).isNotNull(), filters.is_recent(F.col("published"), now, freshness_days))
    o = o.withColumn("reason", reason)
    event = classify.recruitment_event(F.col("title"), F.lit(""), F.lit(""), F.col("title"), F.lit(""), F.col("url"), F.lit("JOB_LIST"), F.lit("OFFICIAL_SITE"), F.lit(None).cast("string"), F.col("closes"), F.array("location"))
    stored = pick.top_n(o.where("reason is null").withColumn("intent", F.lit(0)), ["intent"], target, F.desc("published"), F.col("url"), F.col("title")).drop("intent", "reason").withColumn("event", event)
    stored = stored.withColumn("event_id", dates.event_id(F.col("company"), F.col("event.recruitmentType"), F.col("event.cohort"), F.col("event.directoryUrl")))
    events = stored.select("event_id", F.col("event.startAt").alias("start_at"), F.col("event.closesAt").alias("closes_at"), F.col("published").alias("first_seen_at"), F.col("event.locations").alias("locations"), F.xxhash64("url", "title").alias("seq"))
    return {
        "portals": portals.drop("html", "status").join(verdicts, "portal"),
        "evidence": evidence,
        "events": rollup.merge_events(events),
        "openings": stored.drop("event"),
        "rejected": bad.unionByName(o.where("reason is not null").select("url", "company", "reason")),
    }


def ingest_browser_result(observations: DataFrame, now: Column) -> DataFrame:
    """Observations (company, requestedUrl, finalUrl, status, html, kind, title) as portals: official ones
    for verification, platform ones with a confidence of 49 at most, which never verify."""
    policy = classify.source_policy(F.coalesce("finalUrl", "requestedUrl"), F.col("company"), F.col("title"), F.col("kind"))
    page = classify.surface_page(F.coalesce("finalUrl", "requestedUrl"), F.col("html"), F.col("status"))
    rows = observations.select("company", F.coalesce("finalUrl", "requestedUrl").alias("url"), policy["decision"].alias("decision"), policy["platform"].alias("platform"), page["pageRole"].alias("page_type"), page["vacancyStatus"].alias("vacancy"))
    return rows.withColumn("confidence_cap", F.when(F.col("decision") == "PLATFORM_CANDIDATE", 49).otherwise(100)).withColumn("checked_at", now)


def index_discovery(hits: DataFrame, companies: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Hits of index sites (query, url, title, snippet, published timestamp, seq) as records of resolved companies,
    recent ones, each url once."""
    recent = hits.where(F.col("published").isNull() | filters.is_recent(F.col("published"), now, days))
    named = recent.withColumn("company", text.infer_company(F.col("title"), F.col("snippet"))).where("company <> ''")
    named = named.withColumn("url", F.coalesce(urls.clean_url(F.col("url")), F.col("url")))
    rows = resolve.resolve_companies(pick.first_by(named, ["url"], F.col("seq")), companies)
    x = F.concat_ws(" ", "title", "snippet")
    scope = classify.record_scope(F.col("title"), F.col("snippet"), F.lit(""), F.lit(""), F.lit(""), F.lit(None))
    rows = rows.withColumn("scope", scope).withColumn("batch", classify.batch(x, scope))
    year = dates.cohort_year(F.lit(None).cast("int"), x, scope, F.coalesce(F.unix_millis("published"), F.lit(0)))
    return rows.withColumn("cohort_year", year).withColumn("bucket", classify.database_bucket(F.col("cohort_year"), F.col("scope")))


def candidate_pipeline(candidates: DataFrame, pages: DataFrame, tenants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with verdicts, counts by verdict).  ``tenants``: (company, vendor) that are registered."""
    judged = verify_candidates(candidates, pages).withColumn("vendor", urls.ats(F.col("url")))
    known = tenants.select("company", "vendor", F.lit(True).alias("_t")).distinct()
    out = judged.join(known, ["company", "vendor"], "left")
    out = out.withColumn("verdict", F.when(F.col("_t") & (F.col("verdict") == "MANUAL_REVIEW"), "AUTO_ACCEPT_WITH_LIMITED_ROLE").otherwise(F.col("verdict"))).drop("_t")
    return out, reports.verdict_metrics(out.withColumn("companyId", F.col("company")))


def job_details(jobs: DataFrame, api: DataFrame, pages: DataFrame) -> DataFrame:
    """Jobs (url) with the status of their api answer, or else of their page.  ``api``: (url, status, body);
    ``pages``: (requestedUrl, finalUrl, status, html, seq)."""
    a = api.select("url", F.col("status").alias("api_status"), F.col("body").alias("api_body"))
    fetched = resolve.lookup_pages(jobs, pages).join(a, "url", "left")
    live = classify.liveness(F.col("status"), F.col("url"), F.col("finalUrl"), text.strip_tags(F.col("html"), False), F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<(?:button|a)[^>]*>(.*?)</(?:button|a)>"), F.lit(1)))
    result = F.when(F.col("api_status") == 200, "active").when(F.col("api_status").isin(404, 410), "expired").when(F.col("outcome") == "FETCH_FAILED", "uncertain").otherwise(live["result"])
    return fetched.select(*jobs.columns, result.alias("liveness"), F.when(F.col("api_status") == 200, "api").when(F.col("outcome") == "FETCHED", "page").alias("checked_by"))


def campaign_search(projects: DataFrame, hits: DataFrame, cache: DataFrame, limit: int = 3) -> DataFrame:
    """Projects (project_id, company, cohort_year, batch, official_domain) with the best candidate
    of their queries' hits (query, url, title, snippet, rank); those in the cache (project_id) aren't asked."""
    due = projects.join(cache.select("project_id").distinct(), "project_id", "left_anti")
    asked = due.withColumn("query", F.explode(builders.official_queries(F.col("company"), F.col("cohort_year"), F.col("batch"), F.col("official_domain"), limit)))
    met = resolve.fan_back(hits, asked)
    s = classify.official_score(F.col("url"), F.col("title"), F.col("snippet"), F.col("company"), F.col("official_domain"), F.lit(False), F.col("cohort_year"), F.col("batch"), F.col("rank"))
    scored = met.withColumn("s", s).select("project_id", "company", "url", "rank", "query", "s.*")
    return pick.best_by(scored, ["project_id"], F.col("totalScore"), F.struct("rank", "query"))


def browser_discovery(companies: DataFrame, hits: DataFrame, per_company: int = 3) -> DataFrame:
    """The hits of each company that are worth a visit, by class and rank."""
    met = companies.join(hits, "company")
    kind = classify.result_class(F.col("url"), F.col("company"), F.col("title"), F.col("snippet"), F.col("kind"))
    rank = F.when(F.col("class") == "recruitment", 0).when(F.col("class") == "ats", 1).otherwise(2)
    return pick.top_n(met.withColumn("class", kind).where(classify.should_open(F.col("class"))), ["company"], per_company, rank, F.col("rank"), F.col("url"))


def portal_health(portals: DataFrame, probes: DataFrame) -> DataFrame:
    """Portals (name, url) with the class of their probe's failure and, where a slug is gone, other slugs.
    ``probes``: (url, status, message, error)."""
    out = portals.join(probes, "url", "left")
    problem = F.when(F.col("status") == 200, "ok").otherwise(text.fetch_error_class(F.col("status"), F.col("message"), F.col("error")))
    return out.select("name", "url", problem.alias("health"), F.when(problem == "slug_gone", text.slug_candidates(F.col("name"))).alias("candidates"))


def promote_platform_leads(leads: DataFrame, jobs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(leads that stand as official jobs or freshly verified, leads that don't)."""
    official, rest = resolve.promote_leads(leads, jobs)
    fresh = classify.fresh_verification(F.col("source_type"), F.col("browser_verified"), F.col("status"), F.col("verified_at"), now)
    kept = official.unionByName(rest.where(fresh), allowMissingColumns=True)
    return kept, rest.where(~fresh)


def commit_snapshot(db: store.Store, companies: DataFrame, portals: DataFrame, openings: DataFrame) -> int:
    """One company snapshot, all or nothing: companies and portals are upserted, openings of portals that
    aren't verified go, and openings without a portal are an error."""
    new_portals = store.upsert(db.read("portals"), portals, ["id"], store.PORTAL_RULES)
    new_openings = store.drop_unverified(store.upsert(db.read("openings"), openings, ["id"], store.PORTAL_RULES), new_portals)
    orphans = verify.key_violations(new_openings, new_portals.select(F.col("id").alias("careerPortalId")), "careerPortalId", "missing_portal").where("missing_portal")
    return db.commit({"companies": store.upsert(db.read("companies"), companies, ["id"], store.COMPANY_RULES), "portals": new_portals, "openings": new_openings}, [orphans])
