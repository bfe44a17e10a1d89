import datetime as dt

from pyspark.sql import functions as F

from tests.helpers import values
from veldra.operators import governance as g
from veldra.operators import records as r
from veldra.plans import settings
from veldra.sources import files, search


def test_govern_and_sanitize(spark):
    links = spark.createDataFrame([("1", "Acme", "https://jobs.acme.com/jobs/"), ("2", "Acme", "https://acme.mokahr.com/apply/1"), ("3", "Acme", "https://other.mokahr.com/x"), ("4", "Acme", "https://www.zhipin.com/x"), ("5", "Acme", "https://job.pku.edu.cn/"), ("6", "Acme", "https://mp.weixin.qq.com/s?__biz=AB"), ("7", "Acme", "bad"), ("8", "Zed", "https://jobs.acme.com/"), ("9", "Acme", "https://36kr.com/a")], "id string, company string, url string")
    domains = spark.createDataFrame([("Acme 公司", "acme.com")], "company string, domain string")
    tenants = spark.createDataFrame([("Acme", "mokahr.com", "acme")], "company string, host string, tenant string")
    accounts = spark.createDataFrame([("Acme", "AB")], "company string, biz string")
    out = g.govern(links, domains, tenants, accounts)
    got = {x.id: (x.decision, x.role) for x in out.collect()}
    assert got == {"1": ("corporate_domain_confirmed", "job_list"), "2": ("ats_tenant_confirmed", "application_form"), "3": ("ats_platform_recognized", "unknown"), "4": ("aggregator_source", "aggregator_source"), "5": ("university_repost", "trusted_repost"), "6": ("official_wechat_announcement", "official_wechat_announcement"), "7": ("missing_or_dead", "unknown"), "8": ("unknown", "unknown"), "9": ("media_article", "media_article")}
    rec = spark.createDataFrame([("p", "https://acme.mokahr.com/apply/1", "https://acme.mokahr.com/apply/1", "https://www.zhipin.com/x", None, None)], "id string, applyUrl string, jobDetailUrl string, jobListUrl string, campaignLandingUrl string, companyCareerHomeUrl string")
    kept, removed = g.sanitize_entries(rec, out.withColumn("id", F.lit("p")))
    k = kept.head()
    assert (k.applyUrl, k.jobDetailUrl, k.jobListUrl, k.primaryUrl, k.verificationState) == ("https://acme.mokahr.com/apply/1", None, None, "https://acme.mokahr.com/apply/1", "VERIFIED")
    assert [(x.column, x.decision) for x in removed.collect()] == [("jobListUrl", "aggregator_source")]


def test_hits(spark):
    cases = [("https://acme.com/careers", "Acme 招聘", "OFFICIAL_RECRUITMENT", "VERIFY_PAGE"), ("https://acme.mokahr.com/x", "Acme 招聘", "ATS_RECRUITMENT", "VERIFY_PAGE"), ("https://www.liepin.com/company-jobs/1/", "Acme 岗位", "JOB_BOARD_COMPANY_LIST", "FALLBACK"), ("https://www.liepin.com/zhaopin/?key=a", "Acme", "JOB_BOARD_SEARCH", "REJECT"), ("https://acme.com/news/1", "Acme", "REJECTED_SOURCE", "REJECT"), ("https://b.com/careers", "Bee 招聘", "UNKNOWN", "REJECT"), ("bad", "Acme", "INVALID", "REJECT")]
    got = values(spark, [c[:2] for c in cases], lambda c: g.hit_class(c("u"), c("t"), F.lit(""), F.lit("Acme 集团"), F.lit(""), F.lit(False), F.lit(False)), "u string, t string")
    assert [(x.kind, x.decision) for x in got] == [c[2:] for c in cases]
    hits = spark.createDataFrame([("p", "u1", "JOB_BOARD_COMPANY_LIST", "FALLBACK", 1), ("p", "u2", "OFFICIAL_RECRUITMENT", "VERIFY_PAGE", 9), ("p", "u3", "UNKNOWN", "REJECT", 0)], "project string, url string, kind string, decision string, rank int")
    assert [x.url for x in g.best_entries(hits, ["project"]).collect()] == ["u2"]


def test_normalize_jobs(spark):
    rows = [("1", "Senior iOS Engineer", "Acme Inc", "Remote", "", "<p>Responsibilities</p><p>Write Swift</p><p>5+ years</p>", "https://jobs.lever.co/a/1", "", "", "", "", None), ("2", "后端实习", "腾讯", "深圳", "CN", "应届 本科 2026届", "https://x.com/1", "", "", "", "", None)]
    df = spark.createDataFrame(rows, "id string, title string, company string, location string, country string, description string, url string, apply_url string, source_url string, platform string, market string, posted_at timestamp")
    got = {x.id: x for x in r.normalize_jobs(df).collect()}
    a, b = got["1"], got["2"]
    assert (a.market, a.min_years, a.job_type, a.bucket, a.skills, a.responsibilities, a.source, a.work_mode, a.normalized_title) == ("NA", 5, "experienced_hire", "experienced", ["Swift"], "Write Swift 5+ years", "Lever", "remote", "ios engineer")
    assert (b.market, b.min_years, b.cohort_year, b.education, b.job_type, b.bucket) == ("CN", 0, 2026, "bachelor", "internship", "internship")


def test_database_records(spark):
    schema = "company string, title string, batch_name string, location string, description string, scope string, job_type string, cohort_year int, posted_at long, first_seen_at long, source string, links array<struct<url:string,source:string,type:string>>"
    at = int(dt.datetime(2025, 9, 1, tzinfo=dt.UTC).timestamp() * 1000)
    df = spark.createDataFrame([("A", "秋招 Dev", "", "R", "", None, "", None, at, None, "s", [("https://www.nowcoder.com/1", "n", "source"), ("https://acme.com/careers", "o", "apply"), ("https://acme.com/careers", "z", "apply"), ("bad", "b", "x")])], schema)
    x = r.database_records(df, at, "run").head()
    assert (x.scope, x.cohort_year, x.bucket, x.batch, x.primary_url) == ("campus", 2026, "cohort-2026", "秋招", "https://acme.com/careers")
    assert [y.url for y in x.links] == ["https://acme.com/careers", "https://www.nowcoder.com/1"] and x.sources == ["o", "n"]
    out = lambda **k: r.select_output(r.database_records(df, at, "run"), **k).count()
    assert out(mode="new", run_id="run") == 1 and out(mode="new", run_id="x") == 0 and out(now_ms=at) == 1 and out(now_ms=at + 90 * 86_400_000) == 0 and out(mode="scope", scope="social") == 0 and out(mode="scope", cohorts=[2027]) == 0


def test_knowledge_base(spark):
    rec = spark.createDataFrame([("Acme", "p1"), ("acme 公司", "p2"), ("New", "p3")], "company string, project_id string")
    defs = spark.createDataFrame([("acme", "Acme", ["ACME Ltd"])], "id string, name string, aliases array<string>")
    dom = spark.createDataFrame([("Acme", "acme.com", "https://acme.com/jobs", True), ("New", "liepin.com", "https://liepin.com/x", True), ("New", "new.com", None, False)], "company string, domain string, url string, verified boolean")
    ten = spark.createDataFrame([("Acme", "moka", "acme", "https://acme.mokahr.com/")], "company string, vendor string, tenant string, url string")
    e = spark.createDataFrame([("acme", "Acme", ["B"], [], ["old.com"], [], 5)], "id string, canonicalName string, brandNames array<string>, englishNames array<string>, officialDomains array<string>, projectIds array<string>, createdAt long")
    s = spark.createDataFrame([], "id string, vendor string, tenantKey string, canonicalUrl string, companyIds array<string>, scope array<string>, identityStatus string, createdAt long")
    kb = r.knowledge_base(rec, defs, dom, ten, e, s)
    got = {x.canonicalName: x for x in kb["entities"].collect()}
    assert (got["Acme"].officialDomains, got["Acme"].projectIds, got["Acme"].createdAt, got["Acme"].brandNames) == (["old.com", "acme.com"], ["p1", "p2"], 5, ["B"])
    assert got["New"].id.startswith("company_") and kb["surfaces"].count() == 2
    assert sorted(x.verdict for x in kb["candidates"].collect()) == ["REJECTED", "UNVERIFIED"]
    again = r.knowledge_base(rec, defs, dom, ten, kb["entities"], kb["surfaces"])
    assert sorted(map(str, again["entities"].collect())) == sorted(map(str, kb["entities"].collect()))


def test_routes_drills_and_orders(spark):
    now = F.lit(dt.datetime(2026, 1, 1)).cast("timestamp")
    p = spark.createDataFrame([("a", "A", True, None, None), ("b", "B", False, None, ["https://b.com/careers"]), ("c", "C", False, None, []), ("d", "", False, None, None), ("e", "E", True, False, None)], "project_id string, company string, official_verified boolean, application_active boolean, urls array<string>")
    cache = spark.createDataFrame([("c", dt.datetime(2026, 2, 1), "success"), ("e", dt.datetime(2025, 2, 1), "success")], "project_id string, expires_at timestamp, status string")
    assert {x.project_id: x.route for x in r.route_projects(p, cache, now).collect()} == {"a": "active_verified", "b": "direct_hit", "c": "cache_hit", "d": "invalid_project", "e": "ready"}
    rec = spark.createDataFrame([("x", None, "old", None, None, False)], "id string, apply_url string, job_detail_url string, job_list_url string, official_url string, official_verified boolean")
    drill = spark.createDataFrame([("x", "entry_found", True, True, [("JOB_LIST", "l"), ("DIRECT_APPLICATION", "a.png"), ("UNKNOWN", "u")])], "id string, status string, reachable boolean, identity_confirmed boolean, candidates array<struct<role:string,url:string>>")
    d = r.apply_drill(rec, drill).head()
    assert (d.apply_url, d.job_detail_url, d.job_list_url, d.official_url, d.official_verified) == (None, "old", "l", "l", True)
    q = spark.createDataFrame([("1", "暑期实习", "", 1), ("2", "秋招", "", 9), ("3", "summer", "intern", 5)], "project_id string, batch string, title string, posted_at long")
    assert [x.project_id for x in r.prioritized(q).collect()] == ["3", "1", "2"]


def test_search_tables(spark):
    a = spark.createDataFrame([("brave", "q", '{"web":{"results":[{"title":"T","url":"https://a.com"},{"title":"x","url":"bad"}]}}'), ("tavily", "q", "broken")], "provider string, query string, payload string")
    assert [(x.rank, x.url) for x in search.hits(a).collect()] == [(1, "https://a.com")]
    items = spark.createDataFrame([(0, '{"searchQuery":{"term":"q"},"organicResults":[{"title":"A","url":"https://a.com/?utm_source=x"}]}'), (1, '{"searchQuery":{"term":"q"},"organicResults":[{"title":"B","url":"https://a.com/"}]}')], "seq int, payload string")
    assert [(x.query, x.title, x.url, x.rank) for x in search.actor_hits(items).collect()] == [("q", "B", "https://a.com/", 1)]
    m = search.manual_hits(spark.createDataFrame([("acme jobs",), ("zed",)], "query string"), spark.createDataFrame([(0, "zzz", "acme", "u1", "t"), (1, "", "x", "u2", "t")], "pos int, query string, company string, url string, title string"))
    assert sorted((x.query, x.url) for x in m.collect()) == [("acme jobs", "u1"), ("acme jobs", "u2"), ("zed", "u2")]
    ok, bad = search.fetch_targets(spark.createDataFrame([("https://a.com",), ("http://10.0.0.1",)], "url string"))
    assert ok.count() == 1 and bad.head().reason == "private_ip"
    adv = search.advice_evidence(spark.createDataFrame([("p", "ODD", 7.0, "why")], "portal string, label string, confidence double, rationale string")).head()
    assert adv.code == "llm_advisory" and '"confidence":1.0' in adv.observed and "UNKNOWN" in adv.observed
    rows = spark.createDataFrame([("", "t", None, None, None, "M", "T", "https://m.com", None, None), ("A", "", None, None, None, "M", "", "bad", None, None)], "company string, title string, url string, start string, close string, m_company string, m_title string, m_url string, m_start string, m_close string")
    assert sorted((x.extraction, x.company, x.url) for x in search.accept_extraction(rows).collect()) == [("accepted", "M", "https://m.com"), ("rejected", "A", None)]
    assert values(spark, [(429, 0), (500, 2), (503, 3), (404, 0)], lambda c: search.retry_delays(c("s"), c("a")), "s int, a int") == [1.5, 6.0, None, None]


def test_settings():
    good = {"id": "x", "apiVersion": 1, "description": "d", "humanInTheLoop": True, "hooks": ["search"]}
    assert settings.manifest_errors(good, "x") == []
    assert settings.manifest_errors(good | {"allowedHosts": ["10.0.0.1"], "hooks": ["bad"]}, "y") == ["id", "hooks", "allowedHosts"]
    assert settings.runtime_settings({"SEARCH_MAX_RESULTS": "99", "DISCOVERY_MAX_QUERIES": "-1"})["max_results"] == 20
    assert settings.version_key("1.10.0") > settings.version_key("1.9.9-beta")
    assert settings.tree_hash({"a": b"1", "b": b"2"}) == settings.tree_hash({"b": b"2", "a": b"1"}) != settings.tree_hash({"a": b"2"})
    assert search.search_mode(True, False) == "single_provider"


def test_run_summary(spark):
    s = files.run_summary(spark.createDataFrame([("added",), ("title",), ("seen_url",), ("seen_role",)], "stage string"), "t", 3, 2).head()
    assert (s.found, s.added, s.title, s.seen, s.companies) == (4, 1, 1, 2, 3)
