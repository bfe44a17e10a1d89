import datetime as dt

from pyspark.sql import functions as F

from tests.helpers import values
from veldra.functions import classify as k

L = F.lit


def test_source_policy(spark):
    cases = [
        ("https://www.baidu.com/s", "A", "t", "organic"),
        ("https://acme.com/careers", "A", "t", "ad"),
        ("https://job.edu.cn/x", "A", "t", None),
        ("https://acme.com/news/1", "A", "t", None),
        ("https://www.liepin.com/company-jobs/12/", "Acme", "Acme招聘", None),
        ("https://www.liepin.com/company-jobs/12/", "Acme", "Other招聘", None),
        ("https://acme.com/careers", "A", "t", None),
        ("bad", "A", "t", None),
    ]
    got = values(spark, cases, lambda c: k.source_policy(c("u"), c("c"), c("t"), c("k")), "u string, c string, t string, k string")
    assert [(g.decision[:8], g.reasonCode) for g in got] == [("DISCOVER", "search_engine_page"), ("DISCOVER", "invalid_or_nonorganic"), ("DISCOVER", "hard_excluded_source"), ("DISCOVER", "news_or_reprint"), ("PLATFORM", None), ("DISCOVER", "platform_identity_unconfirmed"), ("VERIFY_O", None), ("DISCOVER", "invalid_or_nonorganic")]


def test_surface_pages(spark):
    cases = [
        ("https://x.com/", "<p>请输入验证码</p>", 200, "BLOCKED_OR_CAPTCHA"),
        ("https://x.com/", "<p>x</p>", 403, "BLOCKED_OR_CAPTCHA"),
        ("https://x.com/", "<p>本次招聘已截止</p>", 200, "EXPIRED_CAMPAIGN"),
        ("https://x.com/", "<p>暂无职位</p>", 200, "VERIFIED_NO_OPENINGS"),
        ("https://x.com/apply/", "<p>Submit application</p>", 200, "APPLY_ACTION"),
        ("https://x.com/", "<p>Responsibilities: a</p>", 200, "ACTIVE_JOB_DETAIL"),
        ("https://x.com/", "<a href=/job/1>a</a><a href='/job/2'>b</a><a href='/job/3'>c</a>", 200, "ACTIVE_JOB_LIST"),
        ("https://x.com/", "<h1>加入我们</h1>", 200, "VERIFIED_CAREER_HOME"),
        ("https://x.com/", "<h1>Acme</h1><p>2026届校园招聘</p>", 200, "VERIFIED_CAMPAIGN"),
        ("https://x.com/", "<p>hello</p>", 200, "UNKNOWN"),
    ]
    got = values(spark, [c[:3] for c in cases], lambda c: k.surface_page(c("u"), c("h"), c("s")), "u string, h string, s int")
    assert [g.pageState for g in got] == [c[3] for c in cases]


def test_liveness_order(spark):
    long = "content " * 60
    cases = [
        (404, "", "", long, [], "http_gone"),
        (200, "", "", "Just a moment", [], "bot_challenge"),
        (503, "", "", long, [], "access_blocked"),
        (200, "", "https://x?error=true", long, [], "expired_url"),
        (200, "", "", "This job has expired", [], "expired_body"),
        (200, "https://x/12345", "https://x/", long, [], "redirected_off_posting"),
        (200, "https://x/12345", "https://x/12345", long, ["Apply now"], "apply_control_visible"),
        (200, "", "", "12 jobs found " + long, [], "listing_page"),
        (200, "", "", "short", [], "insufficient_content"),
        (200, "", "", long, ["Reapplying"], "no_apply_control"),
    ]
    got = values(spark, [c[:5] for c in cases], lambda c: k.liveness(c("s"), c("r"), c("f"), c("b"), c("a")), "s int, r string, f string, b string, a array<string>")
    assert [g.code for g in got] == [c[5] for c in cases]


def test_tiers(spark):
    titles = {"Senior Engineer": "senior", "Engineer III": "senior", "VP, Sales": "senior", "Engineer II": "mid", "Entry-Level Analyst": "entry", "Software Engineer I": "entry", "A.I. Engineer": "mid", "Graduate Program": "intern", "Graduate Analyst": "mid", "Intern": "intern", "Senior Intern": "senior", "Internal Auditor": "mid", None: "mid"}
    assert values(spark, [(t,) for t in titles], lambda c: k.tier(c("t")), "t string") == list(titles.values())


def test_job_types_and_buckets(spark):
    cases = [("New Grad Dev", "", None, "new_grad_full_time"), ("Intern", "", None, "internship"), ("Junior Dev", "", None, "early_career"), ("Dev", "this internship role", None, "internship"), ("Dev", "contractor", None, "contract"), ("Dev", "", 3, "experienced_hire"), ("Dev", "", 1, "early_career"), ("Dev", "", None, "unspecified_full_time")]
    assert values(spark, [c[:3] for c in cases], lambda c: k.job_type(c("t"), c("d"), c("y")), "t string, d string, y int") == [c[3] for c in cases]
    rows = [("Senior Dev", "", "", None), ("Dev intern", "", "", None), ("实习生", "", "", 4), ("Dev", "", "contract", None), ("Dev", "new grad", "", None), ("Dev", "", "", 5)]
    assert values(spark, rows, lambda c: k.job_bucket(c("t"), c("d"), c("j"), c("y"), L(None)), "t string, d string, j string, y int") == ["experienced", "internship", "experienced", "experienced", "full_time", "experienced"]


def test_quirk_q1_literal_patterns_miss_latin_words(spark):
    got = values(spark, [("Senior Dev", "", "", None), ("Dev intern", "", "", None)], lambda c: k.job_bucket(c("t"), c("d"), c("j"), c("y"), L(None), compat=True), "t string, d string, j string, y int")
    assert got == ["full_time", "full_time"]


def test_industry(spark):
    got = values(spark, [("bank risk and audit",), ("semiconductor software",), ("nothing here",), ("",), ("LLM platform",)], lambda c: k.industry(c("t")), "t string")
    assert got == ["finance_banking", "electronics_semiconductor", None, None, "internet_ai_software"]
    assert values(spark, [("嵌入式软件", ""), ("x", "java dev"), ("", "")], lambda c: k.role_family(c("a"), c("b")), "a string, b string") == ["嵌入式", "软件研发", "其他"]


def test_events(spark):
    texts = {"日常实习": "DAILY_INTERNSHIP", "校招 暑期实习": "CAMPUS_INTERNSHIP", "2026校园招聘": "CAMPUS_FULL_TIME", "summer intern": "DAILY_INTERNSHIP", "社会招聘": "EXPERIENCED", "x": "SPECIAL_PROGRAM"}
    assert values(spark, [(t,) for t in texts], lambda c: k.recruitment_type(c("t")), "t string") == list(texts.values())
    build = lambda c: k.recruitment_event(c("t"), c("b"), L(""), L(""), L(""), c("u"), c("p"), L("OFFICIAL_SITE"), L(None).cast("string"), L(None).cast("string"), F.array(L(" a "), L("a")))
    got = values(spark, [("2026届校招", "2026年1月1日开始", "https://x.com/#a", "JOB_LIST"), ("t", "", "https://x.com", "JOB_DETAIL"), ("t", "", "bad", "JOB_LIST")], build, "t string, b string, u string, p string")
    assert (got[0].recruitmentType, got[0].cohort, got[0].startAt, got[0].directoryUrl, got[0].locations, got[0].violation) == ("CAMPUS_FULL_TIME", "2026", dt.date(2026, 1, 1), "https://x.com/", ["a"], None)
    assert [g.violation for g in got[1:]] == ["unsupported_page_type", "invalid_directory_url"]


def test_scopes(spark):
    cases = [("暑期实习", "", "", "internship"), ("社招", "", "campus", "social"), ("秋招", "", "social", "campus"), ("x", "", "social", "social"), ("x", "社会招聘", "", "social"), ("x", "", "", "campus")]
    assert values(spark, [c[:3] for c in cases], lambda c: k.record_scope(c("t"), c("x"), c("g"), L(""), L(""), L(None)), "t string, x string, g string") == [c[3] for c in cases]
    assert values(spark, [("提前批秋招", ""), ("", "internship"), ("", "")], lambda c: k.batch(c("t"), c("s")), "t string, s string") == ["提前批", "日常实习", "待确认批次"]


def test_trust(spark):
    got = values(spark, [("", "A"), ("x", "A"), ("https://bad.com", "Acme"), ("https://acme.com", "Acme Inc"), ("https://boards.greenhouse.io/x", "Acme")], lambda c: k.trust(c("u"), c("c"), ["bad.com"]), "u string, c string")
    assert [(g.score, g.flags, g.level) for g in got] == [(60, ["missing_apply_url"], "medium"), (50, ["invalid_url"], "low"), (60, ["suspicious_domain", "company_domain_mismatch"], "medium"), (100, [], "high"), (100, [], "high")]


def test_scores(spark):
    got = values(spark, [("https://acme.mokahr.com/x", "Acme 2026 招聘", "Acme", "", 2026), ("https://zhipin.com/x", "Acme", "Acme", "", 0), ("https://jobs.acme.com", "Acme jobs 2026", "Acme", "acme.com", 2026)], lambda c: k.official_score(c("u"), c("t"), L(""), c("c"), c("d"), L(False), c("y"), L(""), L(1)), "u string, t string, c string, d string, y int")
    assert [(g.totalScore, g.decision) for g in got] == [(95, "auto_verify"), (-20, "reject"), (100, "auto_verify")]
    got = values(spark, [("https://www.acme.com/x", "careers"), ("https://a.b.acme.com/x", ""), ("https://baidu.com", "acme"), ("https://linkedin.com/x", "jobs")], lambda c: k.site_score(c("u"), c("t"), L(""), F.array(L("acme")), L("")), "u string, t string")
    assert got == [1.5, 0.8, 0.0, 0.7]


def test_identity(spark):
    A = lambda *x: list(x)
    cases = [(A("a"), A(), A(), "JOB_LIST", "ACTIVE", 200, "AUTO_ACCEPT"), (A("a"), A(), A(), "CAREER_HOME", "UNKNOWN", 200, "AUTO_ACCEPT_WITH_LIMITED_ROLE"), (A("a"), A(), A("identity_conflict"), "JOB_LIST", "ACTIVE", 200, "REJECT"), (A("a"), A(), A(), "JOB_LIST", "BLOCKED", 200, "BLOCKED"), (A(), A("x", "y"), A(), "UNKNOWN", "UNKNOWN", 200, "MANUAL_REVIEW"), (A(), A("x"), A("other"), "UNKNOWN", "UNKNOWN", 200, "UNVERIFIED")]
    got = values(spark, [c[:6] for c in cases], lambda c: k.identity(c("s"), c("m"), c("r"), c("p"), c("v"), c("h"), L(True), L(False)), "s array<string>, m array<string>, r array<string>, p string, v string, h int")
    assert [g.verdict for g in got] == [c[6] for c in cases]


def test_domain_risks(spark):
    got = values(spark, [("https://1.2.3.4/",), ("https://acne.com/",), ("https://docs.qq.com:8080/x",), ("bad",), ("https://jobs.acme.com/",)], lambda c: k.domain_risks(c("u"), F.array(L("acme.com")), L("加微信")), "u string")
    assert [sorted(g) for g in got] == [["ip_literal_host", "payment_or_private_contact_risk"], ["lookalike_official_domain", "payment_or_private_contact_risk"], ["non_standard_port", "payment_or_private_contact_risk", "personal_form_or_cloud_drive"], ["invalid_url"], ["payment_or_private_contact_risk"]]
