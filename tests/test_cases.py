"""Functions on known cases: the inputs of each and what it comes to, derived by hand from the rules."""

import hashlib

from pyspark.sql import functions as F

from veldra.functions import classify, dates, text, urls, values
from veldra.operators import builders, filters

_LONG = "x" * 40
_BODY = "Intro\nResponsibilities:\n- Build things\n* Ship\nRequirements\nPython\nBenefits\nnone"
_PAGE = "content " * 60

#: Inputs of each case and what it comes to.
TEXTS: dict[str, list[tuple[tuple, str | None]]] = {
    "normalize_text": [(("Ａcme　Co., Ltd",), "acme co ltd"), ((None,), ""), (("  a--b ",), "a b")],
    "planner_text": [(("C++ / Node.js – Dev!",), "c++ node.js dev"), ((None,), "")],
    "title_key": [(("Senior iOS Engineer II (New Grad)",), "ios engineer"), (("Jr. C# Dev 2",), "c# dev")],
    "company_alias": [(("腾讯科技（深圳）有限公司",), "腾讯科技深圳"), (("Acme 公司",), "acme")],
    "clean_company_name": [(("腾讯2026届校招",), "腾讯"), (("A 暑期实习 机械类",), "A")],
    "platform_identity": [(("Acme 招聘 | BOSS直聘",), "acme"), (("jobs",), "")],
    "decode_entities": [(("a&nbsp;&amp;&LT;b&gt;&#65;&#x42;&bogus;",), "a &<b>AB&bogus;")],
    "html_to_text": [(("<p>a</p><script>x</script><div>b<br>c  d</div>&amp;",), "a\n\nb\nc d\n&")],
    "agency_key": [(("Ａ-b 中！",), "ab中")],
    "markdown_field": [(("a|b [c]\n\\d",), "a/b \\[c\\] \\\\d")],
    "tsv_field": [(("=1+1",), "'=1+1"), (("a\tb",), "a b"), (("-x",), "'-x")],
    "redact": [(("Bearer abc, api_key=xyz ok",), "[REDACTED], [REDACTED] ok")],
    "bounded_error": [((None,), "unknown error"), (("x" * 300,), "x" * 240)],
    "slugs": [(("Acme",), "acme,acmeai,acmetech,acmeio,acmehq,acmelabs,acme.tech,acme.io"), (("",), "")],
    "skills": [(("We use Go, C++ and node.js; Golang too. REST",), "Node.js,REST,C++,Go")],
    "company_match": [(("Acme Inc", "acme"), "true"), (("Acme", "Acmeville"), "false"), (("A.B.", "ab"), "true"), (("", "x"), "false"), (("x-y", "xy z"), "false")],
    "responsibilities": [((_BODY,), "Build things Ship"), ((_LONG + "\nshort",), _LONG), ((None,), "")],
    "requirements": [((_BODY,), "Python")],
    "specific_location": [(("Rome", "Rome, Italy"), "Rome, Italy"), (("", "x"), "x"), (("Paris", "Rome"), "Paris")],
    "overlap": [(("data engineer", "senior data engineer"), "1.0"), (("", "x"), "0.0"), (("data chef", "data engineer"), "0.5")],
    "company_hint": [((None, "Acme Careers - x"), "Acme"), (("B", "y"), "B"), ((None, "腾讯校园招聘"), "腾讯")],
    "is_lookalike": [(("acme.com", "acne.com"), "true"), (("a.com", "a.com"), "false"), (("x.com", "acme.org"), "false")],
    "infer_company": [(("招聘 - 华为技术有限公司", ""), "华为技术有限公司"), (("前端工程师 | 字节", ""), "字节")],
    "fetch_error_class": [(("404", None), "slug_gone"), ((None, "fetch failed"), "network"), (("503", "x"), "server"), ((None, "HTTP 401"), "auth"), ((None, None), "unknown"), (("200", "?"), "unknown")],
    "thread_comment": [(("Acme | Dev | Remote<p>see https://acme.io/jobs.",), "https://acme.io/jobs"), (("Only title",), "https://t/1"), (("",), None)],
    "format_salary": [(("1.4", "2.6", "EUR"), "1-3 EUR"), (("5.0", "5.0", ""), "5"), ((None, None, "x"), "")],
}
URLS: dict[str, list[tuple[tuple, str | None]]] = {
    "clean_url": [(("HTTPS://User@Ex.COM:443/a?b#c",), "https://ex.com/a?b"), (("http://x.com",), "http://x.com/"), (("ftp://x",), None), ((None,), None)],
    "unwrap": [(("https://www.nowcoder.com/jump?url=https%3A%2F%2Fa.com%2Fb",), "https://a.com/b"), (("https://x.com/y",), "https://x.com/y"), (("no",), "")],
    "registrable_domain": [(("www.a.b.com",), "b.com"), (("https://x.y.com.cn/z",), "y.com.cn"), (("a.co.uk",), "a.co.uk")],
    "official_domain": [(("https://www.Acme.com/x",), "acme.com"), (("acme.com:80",), "acme.com")],
    "ats": [(("https://acme.mokahr.com/x",), "moka"), (("https://boards.greenhouse.io/a",), "greenhouse"), (("https://acme.com",), None)],
    "market_region": [(("china",), "CN"), (("us",), "NA"), (("??",), "NA")],
    "market": [(("中国",), "CN"), (("Canada",), "NA"), (("Mars",), None)],
    "is_static_asset": [(("/a.css?x",), "true"), (("/a",), "false")],
    "wechat_key": [(("https://mp.weixin.qq.com/s?__biz=AB",), "mp.weixin.qq.com|AB"), (("https://mp.weixin.qq.com/s/xyz",), "mp.weixin.qq.com|article:xyz")],
    "is_company_ats_host": [(("https://acme.mokahr.com",), "true"), (("https://app.mokahr.com",), "false")],
    "is_private_host": [(("10.1.2.3",), "true"), (("8.8.8.8",), "false"), (("localhost",), "true"), (("100.64.0.1",), "true"), (("example.com",), "false")],
    "governed_url": [(("https://x.com/a/?utm_source=1#t",), "https://x.com/a"), (("https://x.com/a.png",), "static_asset"), (("x",), "invalid_url")],
    "channel": [(("https://acme.com/careers",), "official_careers"), (("http://zhipin.com/x",), "discovery_index"), (("https://mp.weixin.qq.com/s",), "official_wechat"), (("https://a.zhaopin.com",), "delegated_official"), (("-",), "invalid")],
    "best_channel": [(("http://zhipin.com https://a.com https://b.com/jobs",), "https://b.com/jobs")],
    "source": [(("https://jobs.lever.co/a",), "Lever"), (("https://uk.indeed.com/x",), "Indeed"), (("https://acme.com",), "acme.com"), (("?",), "unknown")],
    "public_target": [(("https://a.com:8443/",), "non_standard_port"), (("http://127.0.0.1/",), "private_ip"), (("ftp://a",), "unsupported_protocol"), (("https://a.com/",), None)],
    "rediscovered": [(("//duckduckgo.com/l/?uddg=https%3A%2F%2Fjobs.acme.com%2F1 https://other.com", "jobs.acme.com"), "https://jobs.acme.com/1"), (("https://other.com", "z.com"), None)],
    "best_entry": [((None, "x", "https://l.com/a"), "JOB_LIST https://l.com/a")],
}
DATES: dict[str, list[tuple[tuple, str | None]]] = {
    "epoch_date": [(("1700000000",), "2023-11-14"), (("1700000000000",), "2023-11-14")],
    "event_dates": [(("报名2026年1月2日开始；2026年2月3日截止", None), "2026-01-02 2026-02-03"), (("x", "2025-05-05"), "2025-05-05 ")],
    "add_days": [(("2026-01-30", "3"), "2026-02-02"), (("bad", "1"), None)],
    "days_between": [(("2026-01-01", "2026-03-01"), "59"), (("2026-02-30", "2026-03-01"), None)],
    "range_days": [(("30",), "30"), (("2 weeks",), "14"), (("3个月",), "90"), (("?",), "90"), (("7d",), "7")],
    "experience": [(("3-5 years of experience",), "3-5"), (("at least 2 years",), "2-"), (("7+ yrs",), "7-"), (("founded 20 years ago",), "-"), (("No prior experience",), "0-0")],
    "cn_experience": [(("1-3年",), "1-3"), (("5年以上",), "5-"), (("不超过2年",), "-2"), (("应届",), "0-0")],
    "cohort": [(("26届校招",), "2026"), (("2027 届",), "2027"), (("2026 graduate program",), "2026"), (("x",), None)],
    "cohort_year": [(("2024", "", "campus"), "2024"), ((None, "25届", "campus"), "2025"), ((None, "", "social"), None)],
    "education": [(("硕士及以上",), "master"), (("本科",), "bachelor"), (("",), "")],
    "ratio": [(("1", "3"), "0.3333"), (("1", "0"), None)],
    "clamp": [(("120",), "100"), (("-5",), "0"), (("40",), "40")],
}
CLASSES: dict[str, list[tuple[tuple, str | None]]] = {
    "source_policy": [
        (("https://www.baidu.com/s", "A", "t", "organic"), "DISCOVERY_LOG_ONLY search_engine_page"), (("https://acme.com/careers", "A", "t", "ad"), "DISCOVERY_LOG_ONLY invalid_or_nonorganic"), (("https://job.edu.cn/x", "A", "t", None), "DISCOVERY_LOG_ONLY hard_excluded_source"),
        (("https://acme.com/news/1", "A", "t", None), "DISCOVERY_LOG_ONLY news_or_reprint"), (("https://www.liepin.com/company-jobs/12/", "Acme", "Acme招聘", None), "PLATFORM_CANDIDATE "), (("https://www.liepin.com/company-jobs/12/", "Acme", "Other招聘", None), "DISCOVERY_LOG_ONLY platform_identity_unconfirmed"), (("https://acme.com/careers", "A", "t", None), "VERIFY_OFFICIAL_CANDIDATE "),
    ],
    "result_class": [(("https://www.baidu.com/s", "A", "t", "organic"), "excluded"), (("https://www.liepin.com/company-jobs/12/", "Acme", "Acme招聘", None), "platform"), (("https://boards.greenhouse.io/a", "A", "t", None), "ats"), (("https://acme.com/careers", "A", "t", None), "recruitment"), (("https://acme.com/about", "A", "t", None), "other")],
    "surface_page": [
        (("https://x.com/", "<p>请输入验证码</p>", "200"), "BLOCKED_OR_CAPTCHA"), (("https://x.com/", "<p>x</p>", "403"), "BLOCKED_OR_CAPTCHA"), (("https://x.com/", "<p>本次招聘已截止</p>", "200"), "EXPIRED_CAMPAIGN"), (("https://x.com/", "<p>暂无职位</p>", "200"), "VERIFIED_NO_OPENINGS"), (("https://x.com/apply/", "<p>Submit application</p>", "200"), "APPLY_ACTION"),
        (("https://x.com/", "<p>Responsibilities: a</p>", "200"), "ACTIVE_JOB_DETAIL"), (("https://x.com/", "<h1>加入我们</h1>", "200"), "VERIFIED_CAREER_HOME"), (("https://x.com/", "<h1>Acme</h1><p>2026届校园招聘</p>", "200"), "VERIFIED_CAMPAIGN"), (("https://x.com/", "<p>hello</p>", "200"), "UNKNOWN"),
    ],
    "liveness": [(("404", "", "", _PAGE), "http_gone"), (("200", "", "", "Just a moment"), "bot_challenge"), (("503", "", "", _PAGE), "access_blocked"), (("200", "", "https://x?error=true", _PAGE), "expired_url"), (("200", "", "", "This job has expired"), "expired_body"), (("200", "https://x/12345", "https://x/", _PAGE), "redirected_off_posting"), (("200", "", "", "short"), "insufficient_content")],
    "job_bucket": [(("Senior Dev", "", "", None), "experienced"), (("Dev intern", "", "", None), "internship"), (("实习生", "", "", "4"), "experienced"), (("Dev", "", "contract", None), "experienced"), (("Dev", "new grad", "", None), "full_time"), (("Dev", "", "", "5"), "experienced")],
    "role_family": [(("嵌入式软件", ""), "嵌入式"), (("x", "java dev"), "软件研发"), (("", ""), "其他")],
    "recruitment_type": [(("日常实习",), "DAILY_INTERNSHIP"), (("校招 暑期实习",), "CAMPUS_INTERNSHIP"), (("2026校园招聘",), "CAMPUS_FULL_TIME"), (("社会招聘",), "EXPERIENCED"), (("x",), "SPECIAL_PROGRAM")],
    "recruitment_event": [(("2026届校招", "2026年1月1日开始", "https://x.com/#a", "JOB_LIST"), "CAMPUS_FULL_TIME https://x.com/ "), (("t", "", "https://x.com", "JOB_DETAIL"), "unsupported_page_type"), (("t", "", "bad", "JOB_LIST"), "invalid_directory_url")],
    "record_scope": [(("暑期实习", "", ""), "internship"), (("社招", "", "campus"), "social"), (("秋招", "", "social"), "campus"), (("x", "社会招聘", ""), "social"), (("x", "", ""), "campus")],
    "batch": [(("提前批秋招", ""), "提前批"), (("", "internship"), "日常实习"), (("", ""), "待确认批次")],
    "official_score": [(("https://acme.mokahr.com/x", "Acme 2026 招聘", "", "2026"), "95 auto_verify"), (("https://zhipin.com/x", "Acme", "", "0"), "-20 reject"), (("https://jobs.acme.com", "Acme jobs 2026", "acme.com", "2026"), "100 auto_verify")],
    "site_score": [(("https://www.acme.com/x", "careers"), "1.5"), (("https://a.b.acme.com/x", ""), "0.8"), (("https://baidu.com", "acme"), "0.0"), (("https://linkedin.com/x", "jobs"), "0.7")],
    "identity": [(("a", "", "", "JOB_LIST", "ACTIVE"), "AUTO_ACCEPT"), (("a", "", "", "CAREER_HOME", "UNKNOWN"), "AUTO_ACCEPT_WITH_LIMITED_ROLE"), (("a", "", "identity_conflict", "JOB_LIST", "ACTIVE"), "REJECT"), (("a", "", "", "JOB_LIST", "BLOCKED"), "BLOCKED"), (("", "x y", "", "UNKNOWN", "UNKNOWN"), "MANUAL_REVIEW"), (("", "x", "other", "UNKNOWN", "UNKNOWN"), "UNVERIFIED")],
    "domain_risks": [(("https://1.2.3.4/",), "ip_literal_host,payment_or_private_contact_risk"), (("https://acne.com/",), "lookalike_official_domain,payment_or_private_contact_risk"), (("bad",), "invalid_url"), (("https://jobs.acme.com/",), "payment_or_private_contact_risk")],
}
VALUES: dict[str, list[tuple[tuple, str | None]]] = {
    "decode_list": [(('["a", "b"]',), "a,b"), (("broken",), ""), ((None,), "")],
    "has_forbidden_key": [(('{"a":{"isOfficial" : 1}}',), "true"), (('{"x":"isOfficial"}',), "false")],
    "json_document": [(('{"u":"https:\\/\\/a.com","t":["x y"]}',), "true https://a.com x y"), (("no",), "false ")],
    "company_type": [(("x", "0.9"), "x"), (("x", "0.5"), "")],
    "unique_strings": [((" a |b|a||c",), "a,b,c")],
    "union_evidence": [(("a b", "b c"), "a,b,c"), (("", "x"), ",x")],
}
FILTERS: dict[str, list[tuple[tuple, str | None]]] = {
    "matched_keywords": [(("AI lead",), "AI,Lead"), (("Maid",), ""), ((None,), "")],
    "content_filter": [(("", "x"), "true"), (("python here", "dev"), "true"), (("php here", "dev"), "false"), (("php here", "php dev"), "true"), (("go", "php dev"), "false")],
    "age_filter": [(("2026-01-30",), "true"), (("2025-01-01",), "false"), ((None,), "true")],
    "is_settled": [(("added", "2026-01-01"), "false"), (("added", "2026-01-30"), "true"), (("cooldown:x:2026-03-01", None), "true"), (("cooldown:x:2026-01-01", None), "false"), (("skipped_title", None), "true")],
    "opening_rejection": [(("CLOSED", "y", "y", "y", "y"), "inactive"), (("ACTIVE", "n", "y", "y", "y"), "role_mismatch"), (("ACTIVE", "y", "n", "y", "y"), "location_mismatch"), (("ACTIVE", "y", "y", "n", "y"), "no_entry"), (("ACTIVE", "y", "y", "y", "n"), "stale"), (("ACTIVE", "y", "y", "y", "y"), None)],
    "violations": [(("", "0.5"), "id"), (("a", "2"), "score"), (("", "2"), "id,score"), (("a", "1"), "")],
}

MORE: dict[str, list[tuple[tuple, str | None]]] = {
    "document_url": [(("https://x.com/a?utm_source=1&id=2&share=3",), "https://x.com/a?id=2"), (("bad",), None)],
    "robots_disallow": [(("https://x.com/private/a",), "true"), (("https://x.com/a",), "false")],
    "cn_date": [(("2026年01月02日",), "1767312000000"), (("2026.1.2",), "1767312000000"), (("x",), None)],
    "instant": [(("1700000000", None), "2023-11-14 22:13:20"), ((None, "2026-01-02"), "2026-01-02 00:00:00"), ((None, "x"), None)],
    "canonical_hash": [(("x", "y"), hashlib.sha256(b'{"a":"x","b":"y"}').hexdigest()), (("é", ""), hashlib.sha256('{"a":"é","b":""}'.encode()).hexdigest())],
    "target_evidence": [(("2026届校招 秋招 实习 2025 届",), "CAMPUS,INTERNSHIP|2025,2026|AUTUMN"), (("社招",), "SOCIAL||"), (("x",), "||")],
    "needs_render": [(("RESOLVED", "UNKNOWN", "500", "y"), "true"), (("RESOLVED", "JOB_LIST", "100", "n"), "true"), (("RESOLVED", "JOB_LIST", "500", "n"), "false"), (("FAILED", "UNKNOWN", "0", "n"), "false")],
    "organization_type": [(("北京大学",), "高校"), (("协和医院",), "医院"), (("某研究所",), "科研院所"), (("招商银行",), "金融机构"), (("税务局",), "机关事业单位"), (("华为公司",), "企业"), (("x",), "待确认")],
    "source_trust": [(("official_ats", "https://a.com"), "official 100"), (("university", "https://a.com"), "high 85"), (("aggregator", "https://a.com"), "discovery 45"), (("x", "https://a.com"), "lead 20"), (("x", "https://acme.com/careers"), "official 100"), (("x", "https://mp.weixin.qq.com/s"), "high 90")],
    "page_identity": [(("<title>Acme jobs</title><footer>Acme</footer>",), "title,footer true"), (("<title>Acme</title>",), "title false"), (("<nav>Acme</nav><title>Acme</title>",), "title,nav false")],
    "hard_negative": [(("https://www.zhipin.com/x", ""), "aggregator_domain"), (("https://job.pku.edu.cn/", ""), "university_employment_site"), (("https://acme.com/news/1", ""), "news_reprint"), (("https://acme.com/", "Java培训班"), "training_provider"), (("https://acme.com/", "加微信"), "private_or_payment_risk"), (("https://acme.com/", "x"), None)],
    "has_structure": [(("open positions",), "true"), (("x y",), "false")],
    "has_no_openings": [(("暂无职位",), "true"), (("no current openings",), "true"), (("jobs",), "false")],
    "is_search_blocked": [(("百度安全验证",), "true"), (("ok",), "false")],
    "explicit_job_links": [(("https://a.com/job/1 https://a.com/about https://a.com/apply/",), "https://a.com/job/1,https://a.com/apply/"), (("https://a.com/about",), "")],
    "field_errors": [(("", "t", "https://a.com", None, None), "missing_company"), (("a", "", "bad", None, None), "missing_title,invalid_url"), (("a", "t", "https://a.com", "2026-02-01", "2026-01-01"), "dates_reversed"), (("a", "t", "https://a.com", "2026-01-01", "2026-02-01"), "")],
    "opening_status": [(("Closed", None), "CLOSED"), (("open", "2026-01-01"), "CLOSED"), (("招聘中", None), "ACTIVE"), (("?", None), "UNKNOWN"), (("inactive", None), "CLOSED")],
    "matches_role": [(("Senior Data-Engineer",), "false"), (("Senior Data Engineer",), "true"), (("Chef",), "false")],
    "matches_location": [(("Rome|Milan",), "true"), (("Paris",), "false"), ((None,), "true")],
    "database_bucket": [(("2026", "x"), "cohort-2026"), ((None, "internship"), "daily-internships"), ((None, "social"), "social"), ((None, "campus"), "cohort-unknown")],
    "work_limits": [(("No visa sponsorship here",), "true"), (("ITAR rules",), "true"), (("guitar",), "false")],
    "fresh_verification": [(("verified_platform_apply", "n", "active", "2026-01-30 00:00:00"), "true"), (("x", "y", "active", "2026-01-20 00:00:00"), "false"), (("x", "n", "active", "2026-01-30 00:00:00"), "false"), (("x", "y", "expired", "2026-01-30 00:00:00"), "false")],
    "brand_query": [(("Acme Robotics Co",), '"acme robotics co"'), (("华为 技术",), "华为技术")],
    "fold_locations": [(("Rome", "Milan", "IT"), "Rome · Milan · IT"), (("Rome", "Rome", None), "Rome"), ((None, None, "IT"), "IT")],
    "known_sources": [(("a z",), "a"), (("z",), "a,b"), ((None,), "a,b")],
}


def _run(spark, cases, builds):
    assert cases.keys() == builds.keys()
    for name, rows in cases.items():
        schema = "_i int, " + ", ".join(f"x{k} string" for k in range(len(rows[0][0])))
        df = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(rows)], schema)
        got = df.select("_i", builds[name](*(F.col(f"x{k}") for k in range(len(rows[0][0])))).cast("string").alias("x")).collect()
        assert [r.x for r in sorted(got, key=lambda r: r._i)] == [want for _, want in rows], name


def _words(x):
    return F.filter(F.split(x, " "), lambda w: w != "")


def test_text_functions(spark):
    number = lambda c: c.cast("double")
    _run(spark, TEXTS, {
        "normalize_text": text.normalize_text, "planner_text": text.planner_text, "title_key": text.title_key, "company_alias": text.company_alias, "clean_company_name": text.clean_company_name, "platform_identity": text.platform_identity,
        "decode_entities": text.decode_entities, "html_to_text": text.html_to_text, "agency_key": text.agency_key, "markdown_field": text.markdown_field, "tsv_field": text.tsv_field, "redact": text.redact, "bounded_error": text.bounded_error,
        "slugs": lambda c: F.array_join(text.slug_candidates(c), ","), "skills": lambda c: F.array_join(text.skills(c), ","), "company_match": text.company_match, "responsibilities": text.responsibilities, "requirements": text.requirements,
        "specific_location": text.specific_location, "overlap": text.overlap, "company_hint": text.company_hint, "is_lookalike": text.is_lookalike, "infer_company": text.infer_company,
        "fetch_error_class": lambda s, m: text.fetch_error_class(s.cast("int"), m, F.lit(None).cast("string")), "thread_comment": lambda c: text.thread_comment(c, F.lit("https://t/1"))["url"],
        "format_salary": lambda a, b, c: text.format_salary(F.struct(number(a).alias("min"), number(b).alias("max"), c.alias("currency"))),
    })


def test_url_functions(spark):
    none = F.lit(None).cast("string")
    entry = lambda a, b, c: urls.best_entry(a, b, c, none, none)
    _run(spark, URLS, {
        "clean_url": urls.clean_url, "unwrap": urls.unwrap, "registrable_domain": urls.registrable_domain, "official_domain": urls.official_domain, "ats": urls.ats, "market_region": urls.market_region, "market": urls.market,
        "is_static_asset": urls.is_static_asset, "wechat_key": urls.wechat_key, "is_company_ats_host": urls.is_company_ats_host, "is_private_host": urls.is_private_host,
        "governed_url": lambda c: F.concat(urls.governed_url(c)["canonicalUrl"], urls.governed_url(c)["reason"]), "channel": lambda c: urls.recruitment_channel(c)["channel"], "best_channel": lambda c: urls.best_channel(_words(c))["url"],
        "source": lambda c: urls.source(c)["source"], "public_target": lambda c: urls.public_target(c)["reasonCode"], "rediscovered": lambda h, d: urls.rediscovered(_words(h), d),
        "best_entry": lambda a, b, c: F.concat_ws(" ", entry(a, b, c)["role"], entry(a, b, c)["url"]),
    })


def test_date_functions(spark):
    span = lambda x: F.concat(F.coalesce(x["minYears"].cast("string"), F.lit("")), F.when(x["minYears"].isNull() & x["maxYears"].isNull(), "-").otherwise("-"), F.coalesce(x["maxYears"].cast("string"), F.lit("")))
    both = lambda x: F.concat(F.coalesce(x["startAt"].cast("string"), F.lit("")), F.lit(" "), F.coalesce(x["closesAt"].cast("string"), F.lit("")))
    _run(spark, DATES, {
        "epoch_date": lambda n: dates.epoch_date(n.cast("double")), "event_dates": lambda t, a: both(dates.event_dates(t, a, F.lit(None).cast("string"))), "add_days": lambda a, n: dates.add_days(a, n.cast("int")), "days_between": dates.days_between,
        "range_days": lambda s: dates.range_days(s, 90), "experience": lambda s: span(dates.experience(s)), "cn_experience": lambda s: span(dates.cn_experience(s)), "cohort": dates.cohort,
        "cohort_year": lambda e, t, s: dates.cohort_year(e.cast("int"), t, s, F.lit(1_700_000_000_000)), "education": dates.education, "ratio": lambda a, b: dates.ratio(a.cast("int"), b.cast("int")), "clamp": lambda c: dates.clamp(c.cast("int")).cast("int"),
    })


def test_class_functions(spark):
    none, empty = F.lit(None).cast("string"), F.lit("")
    event = lambda t, b, u, p: classify.recruitment_event(t, b, empty, empty, empty, u, p, F.lit("OFFICIAL_SITE"), none, none, F.array(F.lit(" a "), F.lit("a")))
    policy = lambda *c: classify.source_policy(*c)
    official = lambda u, t, d, y: classify.official_score(u, t, empty, F.lit("Acme"), d, F.lit(False), y.cast("int"), empty, F.lit(1))
    _run(spark, CLASSES, {
        "source_policy": lambda *c: F.concat(policy(*c)["decision"], F.lit(" "), F.coalesce(policy(*c)["reasonCode"], empty)), "result_class": lambda u, c, t, k: classify.result_class(u, c, t, empty, k),
        "surface_page": lambda u, h, s: classify.surface_page(u, h, s.cast("int"))["pageState"], "liveness": lambda s, r, f, b: classify.liveness(s.cast("int"), r, f, b, F.array().cast("array<string>"))["code"],
        "job_bucket": lambda t, d, j, y: classify.job_bucket(t, d, j, y.cast("int"), F.lit(None)), "role_family": classify.role_family, "recruitment_type": classify.recruitment_type,
        "recruitment_event": lambda *c: F.coalesce(event(*c)["violation"], F.concat(event(*c)["recruitmentType"], F.lit(" "), event(*c)["directoryUrl"], F.lit(" "))),
        "record_scope": lambda t, x, g: classify.record_scope(t, x, g, empty, empty, F.lit(None)), "batch": classify.batch,
        "official_score": lambda *c: F.concat_ws(" ", official(*c)["totalScore"].cast("string"), official(*c)["decision"]), "site_score": lambda u, t: classify.site_score(u, t, empty, F.array(F.lit("acme")), empty),
        "identity": lambda s, m, r, p, v: classify.identity(_words(s), _words(m), _words(r), p, v, F.lit(200), F.lit(True), F.lit(False))["verdict"],
        "domain_risks": lambda u: F.array_join(F.array_sort(classify.domain_risks(u, F.array(F.lit("acme.com")), F.lit("加微信"))), ","),
    })


def test_value_functions(spark):
    doc = values.json_document
    _run(spark, VALUES, {
        "decode_list": lambda c: F.array_join(values.decode_list(c), ","), "has_forbidden_key": values.has_forbidden_key, "json_document": lambda c: F.concat_ws(" ", doc(c)["valid"].cast("string"), F.when(doc(c)["valid"], doc(c)["text"]).otherwise("")),
        "company_type": lambda c, n: values.company_type(c, n.cast("double")), "unique_strings": lambda c: F.array_join(values.unique_strings(F.split(c, r"\|")), ","), "union_evidence": lambda a, b: F.array_join(values.union_evidence(F.split(a, " "), F.split(b, " ")), ","),
    })


def test_filter_functions(spark):
    yes = lambda c: c == "y"
    now = F.lit("2026-01-31").cast("timestamp")
    _run(spark, FILTERS, {
        "matched_keywords": lambda t: F.array_join(filters.matched_keywords(t, ["AI", "Lead", ""]), ","), "content_filter": lambda d, t: filters.content_filter(d, t, ["dev", "php"], positive=["python"], by_title={"PHP": {"positive": ["php"]}}),
        "age_filter": lambda d: filters.age_filter(d.cast("timestamp"), now, 30), "is_settled": lambda s, d: filters.is_settled(s, d, "2026-01-31", 10), "opening_rejection": lambda s, a, b, c, d: filters.opening_rejection(s, yes(a), yes(b), yes(c), yes(d)),
        "violations": lambda i, s: F.array_join(filters.violations(id=i == "", score=s.cast("double") > 1), ","),
    })


def test_more_functions(spark):
    yes = lambda c: c == "y"
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    target = lambda x: F.concat_ws("|", F.array_join(x["recruitmentScopes"], ","), F.array_join(x["cohortYears"].cast("array<string>"), ","), F.array_join(x["recruitmentBatches"], ","))
    trust = lambda k, u: classify.source_trust(k, u)
    known = lambda h: classify.page_identity(h, F.array(F.lit("Acme")))
    links = lambda c: F.transform(_words(c), lambda u: F.struct(u.alias("url"), F.lit("").alias("text")))
    _run(spark, MORE, {
        "document_url": urls.document_url, "robots_disallow": lambda u: urls.robots_disallow(u, ["/private", ""]), "cn_date": dates.cn_date, "instant": lambda n, t: stamp(dates.instant(n, t)), "canonical_hash": lambda x, y: dates.canonical_hash(F.struct(x.alias("a"), y.alias("b"))),
        "target_evidence": lambda c: target(classify.target_evidence(c)), "needs_render": lambda r, p, n, s: classify.needs_render(r, p, n.cast("int"), yes(s)), "organization_type": classify.organization_type, "source_trust": lambda k, u: F.concat_ws(" ", trust(k, u)["tier"], trust(k, u)["score"].cast("string")),
        "page_identity": lambda h: F.concat_ws(" ", F.array_join(known(h)["signals"], ","), known(h)["confirmed"].cast("string")), "hard_negative": classify.hard_negative, "has_structure": classify.has_recruitment_structure, "has_no_openings": classify.has_no_openings, "is_search_blocked": classify.is_search_blocked,
        "explicit_job_links": lambda c: F.array_join(F.transform(classify.explicit_job_links(links(c)), lambda a: a["url"]), ","), "field_errors": lambda *c: F.array_join(classify.field_errors(*c), ","), "opening_status": lambda s, d: classify.opening_status(s, d, F.lit("2026-02-01").cast("date")),
        "matches_role": lambda t: classify.matches_role(t, ["data engineer", " "]), "matches_location": lambda c: classify.matches_location(F.split(c, r"\|"), " rome "), "database_bucket": lambda y, s: classify.database_bucket(y.cast("int"), s), "work_limits": classify.work_authorization_limits,
        "fresh_verification": lambda k, b, s, at: classify.fresh_verification(k, yes(b), s, at.cast("timestamp"), F.lit("2026-01-31").cast("timestamp")), "brand_query": lambda c: text.brand_tokens(c)["query"],
        "fold_locations": lambda a, b, c: text.fold_locations(a, F.array(F.struct(b.alias("location"), F.lit(None).cast("string").alias("locality"), c.alias("country")))), "known_sources": lambda c: F.array_join(builders.known_sources(_words(c), ["a", "b"]), ","),
    })
