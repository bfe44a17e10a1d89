import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veldra.operators import store
from veldra.plans import pipelines as z

def now():
    return F.lit(dt.datetime(2026, 1, 31)).cast("timestamp")
PAGES = "requestedUrl string, finalUrl string, status int, html string, seq int"


def test_search_companies(spark):
    q = spark.createDataFrame([("Acme", "q1", 1), ("Acme", "q2", 2)], "company string, query string, round int")
    h = spark.createDataFrame([("q1", 1, "https://acme.com/careers?utm_source=x", "Acme careers", "", None), ("q1", 2, "https://acme.com/careers", "Acme", "", None), ("q1", 3, "https://linkedin.com/acme", "jobs", "", None), ("q2", 1, "https://late.com", "Acme", "", None)], "query string, rank int, url string, title string, snippet string, kind string")
    got = {r.url: r.score for r in z.search_companies(q, h).collect()}
    assert got == {"https://acme.com/careers": 1.5, "https://linkedin.com/acme": 0.7}


def test_verify_candidates(spark):
    c = spark.createDataFrame([("Acme", "https://jobs.acme.com/"), ("Acme", "https://gone.com/")], "company string, url string")
    p = spark.createDataFrame([("https://jobs.acme.com/", None, 200, "<title>Acme jobs</title><footer>Acme</footer><p>open positions</p>", 0)], PAGES)
    got = {r.url: (r.outcome, r.pageRole, r.verdict) for r in z.verify_candidates(c, p).collect()}
    assert got == {"https://jobs.acme.com/": ("FETCHED", "JOB_LIST", "AUTO_ACCEPT"), "https://gone.com/": ("FETCH_FAILED", "UNKNOWN", "UNVERIFIED")}


def test_scan(spark):
    base = lambda i, **k: {"seq": i, "url": f"https://x.com/{i}", "title": "Backend dev", "company": f"C{i}", "location": "Rome", "description": "python " * 60, "posted_at": dt.datetime(2026, 1, 30), "salary": None} | k
    jobs = [base(0), base(1, title="Chef"), base(2, title="Senior backend dev"), base(3, location="Mars"), base(4, posted_at=dt.datetime(2020, 1, 1)), base(5, description="php"), base(6, url="https://x.com/0"), base(7, company="C0"), base(8, url="https://seen.com"), base(9, company="Known"), base(10, company="Cool")]
    df = spark.createDataFrame(jobs, "seq int, url string, title string, company string, location string, description string, posted_at timestamp, salary struct<min:double,max:double,currency:string>")
    history = spark.createDataFrame([("https://seen.com", "2026-01-01", "added")], "url string, first_seen string, status string")
    roles = spark.createDataFrame([("known", "backend dev")], "company string, role string")
    windows = spark.createDataFrame([(0, "Cool", "2026-01-30", 30, ["backend"], None)], "pos int, company string, last_apply_date string, same_role_days int, applied_to array<string>, bucket string")
    config = {"title": {"positive": ["backend"]}, "skip_tiers": ["senior"], "location": {"block": ["mars"]}, "max_age_days": 30, "content": {"positive": ["python"]}}
    got = {r.seq: r for r in z.scan(df, config, history, roles, windows, now(), "2026-01-31").collect()}
    assert {k: r.stage for k, r in got.items()} == {0: "added", 1: "title", 2: "tier", 3: "location", 4: "age", 5: "content", 6: "seen_url", 7: "seen_role", 8: "seen_url", 9: "seen_role", 10: "cooldown"}
    assert len(got[0].fingerprint) == 16 and got[1].fingerprint == ""


def test_discover(spark):
    intents = spark.createDataFrame([("i", "q", 0)], "intent string, query string, pos int")
    hits = spark.createDataFrame([("q", "p", 1, "https://jobs.acme.com/", "Acme careers", "", "Acme", "acme.com", None), ("q", "p", 2, "https://acme.com/news/1", "x", "", "Acme", "acme.com", None)], "query string, provider string, rank int, url string, title string, snippet string, company string, official_domain string, kind string")
    html = "<p>open positions 立即投递 岗位</p>"
    pages = spark.createDataFrame([("https://jobs.acme.com/", None, 200, html, 0), ("https://jobs.acme.com/list", None, 200, html, 1)], PAGES)
    edges = spark.createDataFrame([("https://jobs.acme.com/", "https://jobs.acme.com/list", 0)], "src string, dst string, pos int")
    openings = spark.createDataFrame([("https://jobs.acme.com/list", "2026届 Dev", "Rome", dt.datetime(2026, 1, 20), None, None, "ACTIVE"), ("https://jobs.acme.com/list", "Old", "Rome", dt.datetime(2020, 1, 20), None, None, "ACTIVE")], "url string, title string, location string, published timestamp, closes string, apply_url string, status string")
    got = z.discover(intents, hits, pages, edges, openings, now())
    assert {r.url: r.status for r in got["portals"].collect()} == {"https://jobs.acme.com/": "VERIFIED", "https://jobs.acme.com/list": "VERIFIED"}
    assert [r.title for r in got["openings"].collect()] == ["2026届 Dev"] and got["events"].count() == 1
    assert sorted(r.reason for r in got["rejected"].collect()) == ["DISCOVERY_LOG_ONLY", "stale"]


def test_details_leads_and_health(spark):
    jobs = spark.createDataFrame([("https://x/1",), ("https://x/2",), ("https://x/3",), ("https://x/4",)], "url string")
    api = spark.createDataFrame([("https://x/1", 200, ""), ("https://x/2", 404, "")], "url string, status int, body string")
    pages = spark.createDataFrame([("https://x/3", None, 200, "<button>Apply now</button>" + "text " * 100, 0)], PAGES)
    assert {r.url[-1]: (r.liveness, r.checked_by) for r in z.job_details(jobs, api, pages).collect()} == {"1": ("active", "api"), "2": ("expired", None), "3": ("active", "page"), "4": ("uncertain", None)}
    leads = spark.createDataFrame([("l1", "Acme", "Dev", "x", False, "x", None), ("l2", "B", "Dev", "verified_platform_apply", False, "active", dt.datetime(2026, 1, 30)), ("l3", "C", "Dev", "x", False, "active", dt.datetime(2026, 1, 30))], "lead string, company string, title string, source_type string, browser_verified boolean, status string, verified_at timestamp")
    official = spark.createDataFrame([(0, "Acme", "Dev", "u")], "pos int, company string, title string, url string")
    kept, rest = z.promote_platform_leads(leads, official, now())
    assert sorted(r.lead for r in kept.collect()) == ["l1", "l2"] and [r.lead for r in rest.collect()] == ["l3"]
    portals = spark.createDataFrame([("Acme", "u1"), ("B", "u2")], "name string, url string")
    probes = spark.createDataFrame([("u1", 404, None, None), ("u2", 200, None, None)], "url string, status int, message string, error string")
    got = {r.name: (r.health, r.candidates and r.candidates[0]) for r in z.portal_health(portals, probes).collect()}
    assert got == {"Acme": ("slug_gone", "acme"), "B": ("ok", None)}


def test_index_and_campaigns(spark):
    hits = spark.createDataFrame([("q", "https://n.com/1", "华为技术有限公司2026届校招", "", dt.datetime(2026, 1, 20), 0), ("q", "https://n.com/1", "华为技术有限公司", "", None, 1), ("q", "https://n.com/2", "old 公司有限公司", "", dt.datetime(2020, 1, 1), 2)], "query string, url string, title string, snippet string, published timestamp, seq int")
    companies = spark.createDataFrame([("hw", "华为", ["华为技术有限公司"], 0)], "companyId string, canonicalName string, aliases array<string>, pos int")
    got = z.index_discovery(hits, companies, now()).collect()
    assert [(r.companyId, r.scope, r.bucket) for r in got] == [("hw", "campus", "cohort-2026")]
    projects = spark.createDataFrame([("p1", "Acme", 2026, "秋招", "acme.com"), ("p2", "B", 2026, "", "")], "project_id string, company string, cohort_year int, batch string, official_domain string")
    found = spark.createDataFrame([('"Acme" 招聘官网', "https://acme.com/x", "Acme 2026 招聘", "", 1), ('"Acme" 招聘官网', "https://zhipin.com", "Acme", "", 2), ('"B" careers', "https://b.com", "B", "", 1)], "query string, url string, title string, snippet string, rank int")
    got = z.campaign_search(projects, found, spark.createDataFrame([("p2",)], "project_id string")).collect()
    assert [(r.project_id, r.url, r.decision) for r in got] == [("p1", "https://acme.com/x", "auto_verify")]


def test_snapshots(spark, tmp_path):
    schemas = {"companies": StructType.fromDDL("id string, canonicalName string, aliases array<string>"), "portals": StructType.fromDDL("id string, verificationStatus string, firstSeenAt string"), "openings": StructType.fromDDL("id string, careerPortalId string, firstSeenAt string")}
    db = store.Store(spark, f"file://{tmp_path}/db", schemas)
    make = lambda t, *r: spark.createDataFrame(list(r), schemas[t])
    z.commit_snapshot(db, make("companies", ("c", "A", ["a"])), make("portals", ("p", "VERIFIED", "1")), make("openings", ("o", "p", "1")))
    with pytest.raises(ValueError):
        z.commit_snapshot(db, make("companies"), make("portals"), make("openings", ("o2", "nowhere", "2")))
    assert db.read("openings").count() == 1
    z.commit_snapshot(db, make("companies", ("c", "B", ["b"])), make("portals", ("p", "REVIEW", "9")), make("openings"))
    assert tuple(db.read("companies").head()) == ("c", "A", ["a", "b"]) and tuple(db.read("portals").head()) == ("p", "REVIEW", "1") and db.read("openings").count() == 0


def test_browser_results(spark):
    c = spark.createDataFrame([("Acme",)], "company string")
    h = spark.createDataFrame([("Acme", "https://acme.com/jobs", "Acme jobs", "", None, 1), ("Acme", "https://baidu.com", "x", "", None, 2), ("Acme", "https://acme.mokahr.com/x", "x", "", None, 3)], "company string, url string, title string, snippet string, kind string, rank int")
    assert [r["class"] for r in z.browser_discovery(c, h).orderBy("rank").collect()] == ["recruitment", "ats"]
    o = spark.createDataFrame([("Acme", "https://www.liepin.com/company-jobs/1/", None, 200, "<p>x</p>", None, "Acme招聘")], "company string, requestedUrl string, finalUrl string, status int, html string, kind string, title string")
    assert z.ingest_browser_result(o, now()).head().confidence_cap == 49
