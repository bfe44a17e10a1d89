"""Search hits, model advice and company lists as tables.  S17, S18, S20 to S23, S33, S34, S36, K8, K13, K14, K16, K18, K21, C34.

Live fetching and searching are seams: whoever runs them writes these tables, and everything from there on is here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.functions.classify import field_errors
from veldra.functions.text import _s, clean, present
from veldra.functions.urls import canonical_url, clean_url, host, host_in, public_target

#: Tables that the outside world writes.
PAGES = "requestedUrl string, finalUrl string, status int, html string, seq long, observedAt timestamp"
HITS = "provider string, query string, rank int, title string, url string, snippet string, publishedAt timestamp, kind string"

#: Where answers of search providers have their hits: list, title, url, snippet, date.
PROVIDERS = {
    "brave": ("$.web.results", "$.title", "$.url", "$.description", "$.page_age"),
    "tavily": ("$.results", "$.title", "$.url", "$.content", "$.published_date"),
    "baidu": ("$.references", "$.title", "$.url", "$.content", "$.date"),
}


def hits(answers: DataFrame) -> DataFrame:
    """Answers (provider, query, payload) as hits, ranked as they came."""
    out = None
    for name, (items, *paths) in PROVIDERS.items():
        a = answers.where(F.col("provider") == name).select("provider", "query", F.posexplode(F.from_json(F.get_json_object("payload", items), "array<string>")).alias("p", "x"))
        title, url, snippet, date = (F.get_json_object("x", p) for p in paths)
        one = a.select("provider", "query", (F.col("p") + 1).alias("rank"), title.alias("title"), url.alias("url"), snippet.alias("snippet"), F.try_to_timestamp(date).alias("publishedAt"), F.lit("organic").alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out.where(clean_url(F.col("url")).isNotNull())


def manual_hits(queries: DataFrame, entries: DataFrame, top: int = 8) -> DataFrame:
    """Hand-made entries (pos, query, company, url, title) for queries that contain their query or company.  The
    entries are a list of configuration, which bounds the join."""
    from veldra.operators.pick import top_n
    from veldra.operators.scratch import listed

    e = entries.select("pos", F.col("query").alias("_q"), "company", "url", "title")
    fits = (_s(F.col("_q")) == "") | F.col("query").contains(_s(F.col("_q"))) | ((_s(F.col("company")) != "") & F.col("query").contains(_s(F.col("company"))))
    met = top_n(queries.select("query").distinct().join(listed(e), fits), ["query"], top, F.col("pos"))
    return met.select("query", "company", "url", "title", F.lit("manual").alias("provider"))


def actor_hits(items: DataFrame, most: int = 8) -> DataFrame:
    """Datasets of a batch search (seq, payload with searchQuery.term and organicResults), the last of each query
    and address."""
    from veldra.operators.pick import last_by

    q = F.coalesce(F.get_json_object("payload", "$.searchQuery.term"), F.get_json_object("payload", "$.searchQuery"), F.lit(""))
    rows = items.select("seq", q.alias("query"), F.posexplode(F.slice(F.from_json(F.get_json_object("payload", "$.organicResults"), "array<string>"), 1, most)).alias("p", "x"))
    get = lambda *ps: F.coalesce(*(F.get_json_object("x", p) for p in ps), F.lit(""))
    out = rows.select("seq", "p", "query", get("$.title", "$.name").alias("title"), canonical_url(get("$.url", "$.link")).alias("url"), get("$.description", "$.snippet").alias("snippet"), F.coalesce(F.get_json_object("x", "$.position").try_cast("int"), F.col("p") + 1).alias("rank")).where("url <> ''")
    return last_by(out, ["query", "url"], F.col("seq"), F.col("p")).drop("seq", "p")


def actor_config(env: Mapping[str, str]) -> dict:
    """Bounded settings of the batch search."""
    number = lambda k, d: float(env.get(k, d)) if str(env.get(k, d)).replace(".", "", 1).isdigit() else float(d)
    return {"daily_usd": number("DAILY_BUDGET_USD", 0.5), "monthly_usd": number("MONTHLY_BUDGET_USD", 4.5), "results": int(max(1, min(8, number("MAX_RESULTS", 8)))), "batch": int(max(5, min(100, number("BATCH_QUERY_LIMIT", 50)))), "timeout_s": int(max(30, min(600, number("RUN_TIMEOUT_SECONDS", 90))))}


def visible_hits(rows: DataFrame, top: int = 8) -> DataFrame:
    """Hits read off a result page, without advertisements, ranked anew."""
    from veldra.operators.filters import natural_results

    good = rows.where((clean(F.col("title")) != "") & clean_url(F.col("url")).isNotNull())
    return natural_results(good, ["query"], top, F.col("rank"))


def cache_key(market: Column, provider: Column, query: Column, top: Column) -> Column:
    """K16"""
    return F.concat_ws("|", _s(market), _s(provider), clean(query), _s(top))


def search_mode(primary: bool, fallback: bool) -> str:
    """K8: the mode of two providers that are configured or not."""
    return "primary_fallback" if primary and fallback else "single_provider" if primary or fallback else "no_provider"


def probe_result(status: Column, error: Column) -> Column:
    """K8: what a provider's probe says."""
    e = F.lower(_s(error))
    return F.when(status == "success", "healthy").when(e.rlike("429|rate"), "rate_limited").when(e.rlike("abort|timeout"), "timeout").when(e.rlike("401|403|key"), "unauthorized").when(status == "not_configured", "not_configured").otherwise("provider_error")


def advice_evidence(advice: DataFrame) -> DataFrame:
    """A model's advice on pages (portal, label, confidence, rationale) as evidence of no weight."""
    label = F.when(F.col("label").isin("LIKELY_CAREER", "LIKELY_AGGREGATOR", "LIKELY_NEWS"), F.col("label")).otherwise("UNKNOWN")
    seen = F.to_json(F.struct(label.alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"), F.substring(_s(F.col("rationale")), 1, 500).alias("rationale")))
    return advice.select("portal", F.lit("llm_advisory").alias("code"), seen.alias("observed"))


def accept_extraction(rows: DataFrame) -> DataFrame:
    """Fields that a model extracted (m_company, m_title, m_url, m_start, m_close) fill empty ones only if all of
    them are valid."""
    errors = field_errors(F.col("m_company"), F.col("m_title"), F.col("m_url"), F.col("m_start"), F.col("m_close"))
    ok = F.size(errors) == 0
    fill = lambda c: F.when(ok, F.coalesce(present(F.col(c)), F.col(f"m_{c}"))).otherwise(F.col(c))
    out = rows.withColumn("extraction", F.when(ok, "accepted").otherwise("rejected")).withColumn("extraction_errors", errors)
    for c in ("company", "title", "url", "start", "close"):
        out = out.withColumn(c, fill(c))
    return out.drop(*(f"m_{c}" for c in ("company", "title", "url", "start", "close")))


def fetch_targets(urls_: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(addresses that may be fetched, others with reason)."""
    t = urls_.withColumn("_t", public_target(F.col(url)))
    return t.where("_t.safe").drop("_t"), t.where("not _t.safe").withColumn("reason", F.col("_t.reasonCode")).drop("_t")


def retry_delays(status: Column, attempt: Column, base_seconds: float = 1.5, most: int = 3) -> Column:
    """Seconds until a polite fetcher asks again; null if it doesn't."""
    again = (status.isin(429) | (status >= 500)) & (attempt < most)
    return F.when(again, F.lit(base_seconds) * F.pow(F.lit(2.0), attempt))


def reconcile(headless: DataFrame, headed: DataFrame) -> DataFrame:
    """Liveness (url, result, code); where a challenge stopped the first look, the second counts."""
    second = headed.select("url", F.col("result").alias("_r"), F.col("code").alias("_c"))
    stopped = F.col("code").isin("bot_challenge", "access_blocked") & F.col("_r").isNotNull()
    return headless.join(second, "url", "left").select("url", F.when(stopped, F.col("_r")).otherwise(F.col("result")).alias("result"), F.when(stopped, F.col("_c")).otherwise(F.col("code")).alias("code"))


def trusted_documents(pages: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Pages of allowed domains, such as those of a government, and of universities."""
    h = host(F.col("requestedUrl"))
    kind = F.when(host_in(h, list(domains)), "government").when(h.rlike(r"\.edu(?:\.cn)?$"), "university")
    return pages.withColumn("source_type", kind).where("source_type is not null")


def company_inputs(spark: SparkSession, lines: Sequence[str] | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Companies from names or from rows that call them name, company, companyName or canonicalName."""
    if lines is not None:
        return spark.createDataFrame([(x.strip(),) for x in lines if x.strip()], "company string")
    names = [c for c in ("canonicalName", "companyName", "company", "name") if c in rows.columns]
    return rows.withColumn("company", F.coalesce(*(present(F.col(c)) for c in names))).where("company is not null")
