"""Classifiers and scores over Columns: ordered rules, the first that fits wins.  The IDs are those of the inventory.

Each is one native expression, so that whole-stage code generation covers it and nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldra.functions import rules
from veldra.functions.dates import clamp, cohort, event_dates, explicit_date
from veldra.functions.text import _s, clean, let, planner_text, present, replace, same_identity, strip_tags, trim, whole
from veldra.functions.urls import bare_host, canonical_url, clean_url, host, host_in, is_url, links, path, recruitment_channel, registrable_domain


def first_rule(*cases: tuple[Column, object], default: object = None) -> Column:
    """CASE of (condition, value) in order; a null condition doesn't fit."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = lit(default)
    for condition, value in reversed(cases):
        out = F.when(condition, lit(value)).otherwise(out)
    return out


def any_of(patterns: list[str], flags: str = "(?is)") -> str:
    return flags + "(?:" + "|".join(patterns) + ")"


def source_policy(url: Column, company: Column, title: Column, kind: Column) -> Column:
    """Struct of decision, reasonCode, sourceTier and platform of a search hit."""
    return let(F.struct(bare_host(url).alias("h"), path(url).alias("p")), lambda u: _policy(u["h"], u["p"], company, title, kind))


def _policy(h: Column, p: Column, company: Column, title: Column, kind: Column) -> Column:
    row = lambda decision, reason=None, tier=None, platform=None: F.struct(*(F.lit(v).cast("string").alias(n) for n, v in (("decision", decision), ("reasonCode", reason), ("sourceTier", tier), ("platform", platform))))
    log = "DISCOVERY_LOG_ONLY"
    organic = F.lower(F.coalesce(F.nullif(kind, F.lit("")), F.lit("organic"))) == "organic"
    cases = [
        (h.isNull() | ~organic, row(log, "invalid_or_nonorganic")),
        (host_in(h, rules.SEARCH_ENGINES), row(log, "search_engine_page")),
        (host_in(h, [*rules.HARD_EXCLUDED, *rules.UNIVERSITY_SITES]) | h.rlike(r"\.edu\.cn$"), row(log, "hard_excluded_source")),
        (p.rlike("(?i)/(?:news|article|media|press)(?:/|$)") | _s(title).rlike("(?i)新闻|转载|媒体报道|news|press release"), row(log, "news_or_reprint")),
    ]
    for domain, platform, exact in rules.PLATFORMS:
        mine = host_in(h, [domain])
        cases += [(mine & p.rlike(exact) & same_identity(company, title), row("PLATFORM_CANDIDATE", None, "PLATFORM_ONLY", platform)), (mine, row(log, "platform_identity_unconfirmed", None, platform))]
    return first_rule(*cases, default=row("VERIFY_OFFICIAL_CANDIDATE", None, "OFFICIAL_SITE"))


def result_class(url: Column, company: Column, title: Column, snippet: Column, kind: Column) -> Column:
    """What a search hit is to a company's search: excluded, platform, ats, recruitment or other."""
    policy = source_policy(url, company, title, kind)
    about = F.concat_ws(" ", title, snippet, path(url)).rlike("(?i)招聘|校招|社招|岗位|职位|career|jobs?|recruit|join")
    from veldra.functions.urls import ats

    return first_rule((policy["decision"] == "DISCOVERY_LOG_ONLY", "excluded"), (policy["decision"] == "PLATFORM_CANDIDATE", "platform"), (ats(url).isNotNull(), "ats"), (about, "recruitment"), default="other")


def should_open(result: Column) -> Column:
    """Whether a hit of that class is worth a visit."""
    return result.isin("platform", "ats", "recruitment")


def hinted_role(url: Column, text: Column) -> Column:
    """What a link on a page of postings leads to."""
    return let(F.concat_ws(" ", url, text), _hinted)


def _hinted(x: Column) -> Column:
    return first_rule(
        (x.rlike(r"(?i)立即投递|立即申请|申请职位|apply(?:(?![A-Za-z0-9_])|/|\?)"), "APPLY"),
        (x.rlike(r"(?i)岗位职责|任职要求|职位详情|job/[^/]+|position/[^/]+|jobId=|positionId="), "JOB_DETAIL"),
        (x.rlike(r"(?i)职位列表|招聘岗位|查看职位|view jobs|search jobs|/(?:jobs?|positions?)(?:/|\?|$)"), "JOB_LIST"),
        (x.rlike("(?i)校招|校园招聘|实习|campus|intern"), "CAMPAIGN"),
        (x.rlike("(?i)招聘|加入我们|career|join"), "CAREER_HOME"),
        default="UNKNOWN",
    )


def surface_page(url: Column, html: Column, status: Column, numeric: bool = False) -> Column:
    """C4: struct of pageState, pageRole and vacancyStatus of a page, by nine rules."""
    read = F.struct(strip_tags(html, numeric).alias("text"), F.size(F.filter(links(html, url), lambda a: hinted_role(a["url"], a["text"]) == "JOB_DETAIL")).alias("details"))
    return let(read, lambda r: _surface(url, html, status, r["text"], r["details"]))


def _surface(url: Column, html: Column, status: Column, text: Column, details: Column) -> Column:
    x = F.concat_ws(" ", url, text)
    h1 = replace(F.regexp_extract(_s(html), r"(?is)<h1(?![A-Za-z0-9_])[^>]*>(.*?)</h1>", 1), "<[^>]+>", " ")
    row = lambda state, role, vacancy: F.struct(F.lit(state).alias("pageState"), F.lit(role).alias("pageRole"), F.lit(vacancy).alias("vacancyStatus"))
    return first_rule(
        (status.isin(401, 403, 429) | x.rlike("(?i)验证码|安全验证|访问过于频繁|captcha|access denied"), row("BLOCKED_OR_CAPTCHA", "UNKNOWN", "BLOCKED")),
        (x.rlike("(?i)招聘已结束|已截止|停止申请|no longer accepting"), row("EXPIRED_CAMPAIGN", "CAMPAIGN", "EXPIRED")),
        (x.rlike("(?i)暂无(?:开放)?职位|暂无岗位|没有在招职位|no open(?:ing| position| job)"), row("VERIFIED_NO_OPENINGS", "CAREER_HOME", "NO_OPENINGS")),
        (path(url).rlike(r"(?i)(?:^|/)apply(?:\.html|/|$)|application(?:/|$)") & text.rlike("(?i)提交简历|确认申请|提交申请|创建账号后申请|apply now|submit application"), row("APPLY_ACTION", "APPLY", "ACTIVE")),
        (x.rlike("(?i)岗位职责|任职要求|responsibilit|qualification") & ~x.rlike("多个职位|职位列表"), row("ACTIVE_JOB_DETAIL", "JOB_DETAIL", "ACTIVE")),
        ((details >= 2) | x.rlike("(?i)招聘职位|职位列表|岗位列表|open positions"), row("ACTIVE_JOB_LIST", "JOB_LIST", "ACTIVE")),
        (F.when(h1 == "", x).otherwise(h1).rlike("(?i)加入我们|人才招聘|招聘官网|careers|join us") & ~h1.rlike(r"20\d{2}届|暑期实习|日常实习"), row("VERIFIED_CAREER_HOME", "CAREER_HOME", "UNKNOWN")),
        (x.rlike(r"(?i)20\d{2}届|校园招聘|校招|暑期实习|日常实习|campus|summer intern"), row("VERIFIED_CAMPAIGN", "CAMPAIGN", "UNKNOWN")),
        default=row("UNKNOWN", "UNKNOWN", "UNKNOWN"),
    )


def target_evidence(text: Column) -> Column:
    """Struct of recruitmentScopes, cohortYears and recruitmentBatches that a text names."""
    x = _s(text)
    named = lambda table: F.array_compact(F.array(*(F.when(x.rlike(f"(?i){p}"), n) for n, p in table)))
    scopes = named([("CAMPUS", "校招|校园招聘|应届|campus|graduate"), ("INTERNSHIP", "实习|intern"), ("SOCIAL", "社招|社会招聘|experienced")])
    batches = named([("AUTUMN", f"秋招|秋季校园招聘|{whole('autumn')}"), ("SPRING", f"春招|春季校园招聘|{whole('spring')}"), ("EARLY", f"提前批|early[_ -]?batch|{whole('early')}"), ("SUPPLEMENTARY", f"补录|追加招聘|{whole('supplementary')}")])
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"(20\d{2})\s*届"), F.lit(1)), lambda y: y.cast("int"))))
    return F.struct(scopes.alias("recruitmentScopes"), years.alias("cohortYears"), batches.alias("recruitmentBatches"))


def needs_render(resolved: Column, role: Column, text_length: Column, has_signal: Column) -> Column:
    """Whether a page must be rendered to be read."""
    return (resolved == "RESOLVED") & ((role == "UNKNOWN") | (~has_signal & (text_length < 200)))


def liveness(status: Column, requested: Column, final: Column, body: Column, controls: Column) -> Column:
    """Struct of result and code by ten checks.  ``controls``: the labels of what can be pressed."""
    tokens = F.regexp_extract_all(F.lower(_s(requested)), F.lit(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\d{5,}"), F.lit(0))
    job = F.try_element_at(tokens, F.lit(-1))
    row = lambda result, code: F.struct(F.lit(result).alias("result"), F.lit(code).alias("code"))
    b = _s(body)
    word = lambda p: p if " " in p or "ś" in p else whole(p)
    apply = any_of([word(p) for p in rules.APPLY_TEXT], "(?iu)")
    return first_rule(
        (status.isin(404, 410), row("expired", "http_gone")),
        (b.rlike(any_of([whole(p) if p in ("ray id", "cf-ray") else p for p in rules.CHALLENGE_TEXT], "(?i)")), row("uncertain", "bot_challenge")),
        (status.isin(403, 503), row("uncertain", "access_blocked")),
        (_s(final).rlike("(?i)[?&]error=true"), row("expired", "expired_url")),
        (b.rlike(any_of(rules.EXPIRED_TEXT, "(?iu)")), row("expired", "expired_body")),
        (job.isNotNull() & (_s(final) != "") & ~F.lower(_s(final)).contains(job), row("uncertain", "redirected_off_posting")),
        (F.exists(controls, lambda c: c.rlike(apply)), row("active", "apply_control_visible")),
        (b.rlike(any_of(rules.LISTING_TEXT, "(?i)")), row("expired", "listing_page")),
        (F.length(trim(b)) < 300, row("expired", "insufficient_content")),
        default=row("uncertain", "no_apply_control"),
    )


def tier(title: Column) -> Column:
    """Senior, mid, entry or intern; mid if nothing shows."""
    x = replace(replace(_s(title), r"(?i)(?<![A-Za-z0-9_])A\.\s*I(?:\.|(?![A-Za-z0-9_]))", "AI"), r"(?i)(?<![A-Za-z0-9_])I\.\s*T(?:\.|(?![A-Za-z0-9_]))", "IT")
    x = replace(x, r"(?i)(?<![A-Za-z0-9_])i/o(?![A-Za-z0-9_])", "IO")
    scheme = x.rlike("(?i)" + whole("graduate")) & x.rlike("(?i)" + whole("program|scheme"))
    return first_rule(*((x.rlike("(?i)" + whole(p)), name) for name, p in rules.TIERS), (scheme, "intern"), default="mid")


def job_type(title: Column, description: Column, min_years: Column) -> Column:
    """One of seven types, by the title before the description before the years."""
    t, d = _s(title), _s(description)
    grad, senior = "(?i)new grad|graduate program|university grad|campus|early career|entry[- ]level|校招|应届|管培生", "(?i)senior|staff|principal|lead|manager|director"
    return first_rule(
        (t.rlike(grad), "new_grad_full_time"),
        (t.rlike("(?i)intern(?:ship)?|co-?op|实习|暑期项目"), "internship"),
        (~t.rlike(senior) & t.rlike("(?i)(?:(?<![A-Za-z0-9_])(?:ios|mobile|software)?\\s*engineer\\s+(?:i|1)(?![A-Za-z0-9_]))|" + whole(r"junior|jr\.?|associate")), "early_career"),
        (d.rlike(grad), "new_grad_full_time"),
        (d.rlike("(?i)" + whole(r"(?:this|the|our|an?)\s+(?:paid\s+|summer\s+)?intern(?:ship)?|internship\s+(?:role|position|program)") + "|实习岗位|暑期项目"), "internship"),
        (F.concat_ws("\n", t, d).rlike("(?i)contract|contractor|temporary|temp(?![A-Za-z0-9_])|合同工|派遣"), "contract"),
        (~t.rlike(senior) & d.rlike("(?i)" + whole(r"(?:ios|mobile|software)\s+(?:software\s+)?engineer\s+(?:i|1)")), "early_career"),
        (min_years >= 2, "experienced_hire"),
        (min_years <= 1, "early_career"),
        default="unspecified_full_time",
    )


def cn_job_type(text: Column) -> Column:
    """The type that a Chinese text names; empty if none."""
    x = _s(text)
    return first_rule((x.rlike("校招|应届生|校录取|高校"), "new_grad_full_time"), (x.rlike("实习|雷弹"), "internship"), (x.rlike("社招|社会招聘"), "unspecified_full_time"), default="")


def job_bucket(title: Column, description: Column, job_type: Column, min_years: Column, cohort_year: Column, compat: bool = False) -> Column:
    """Internship, full_time or experienced.  ``compat``: Latin words for seniors and interns are not seen (Q1)."""
    t, x = _s(title), F.concat_ws("\n", _s(title), _s(description), _s(job_type))
    intern = "实习" if compat else "(?i)" + whole("intern|co-?op") + "|实习"
    senior = r"(?i)engineer\\s+(?:ii|iii|iv)" if compat else "(?i)" + whole(r"senior|sr\.?|staff|principal|lead|manager|director|expert|head of|architect|engineer\s+(?:ii|iii|iv)")
    fresh = "(?i)" + whole(r"new grad|graduate|newly graduated|0[\s\-]?(?:to[\s\-]?1|1)[\s\-]?year|class of") + "|应届生|校招|高校|校录取"
    is_intern = (_s(job_type) == "internship") | x.rlike(intern)
    return first_rule(
        (is_intern & (min_years.isNull() | (min_years < 3)), "internship"),
        (min_years >= 3, "experienced"),
        (t.rlike(senior), "experienced"),
        (_s(job_type).isin("experienced_hire", "contract"), "experienced"),
        (x.rlike(fresh), "full_time"),
        (cohort_year >= 2025, "full_time"),
        default="full_time",
    )


def normalize_bucket(value: Column) -> Column:
    """The bucket that a name means; null if none."""
    v = F.lower(trim(_s(value)))
    return first_rule(*((v.isin(names), name) for name, names in rules.BUCKET_NAMES.items()))


def bucket_label(bucket: Column) -> Column:
    """C10"""
    return first_rule(*((bucket == k, v) for k, v in rules.JOB_BUCKETS.items()), default=_s(bucket))


def _has(lower: Column, keyword: str) -> Column:
    k = keyword.lower()
    return lower.rlike(f"(?:^|[^a-z0-9]){re.escape(k)}(?:[^a-z0-9]|$)") if re.fullmatch("[a-z0-9+#.]{2,3}", k) else lower.contains(k)


def industry_scores(x: Column) -> list[Column]:
    """Of a lower-case text."""
    out = []
    for _, words, against in rules.INDUSTRIES.values():
        score = F.lit(0)
        for w in words:
            if len(w) >= 2:
                score = score + _has(x, w).cast("int")
        for w in against:
            score = score - x.contains(w).cast("int")
        out.append(score)
    return out


def industry(text: Column) -> Column:
    """C11: the industry with most words less contrary ones, the first of equals; null if none has any."""
    scored = lambda x: F.array(*(F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, s) in enumerate(zip(rules.INDUSTRIES, industry_scores(x), strict=True))))
    best = let(F.lower(_s(text)), lambda x: F.array_max(scored(x)))
    return let(best, lambda b: F.when(b["s"] > 0, b["name"]))


def industry_label(bucket: Column) -> Column:
    """C11"""
    return first_rule(*((bucket == k, v[0]) for k, v in rules.INDUSTRIES.items()), default=_s(bucket))


def normalize_industry(value: Column) -> Column:
    """C11"""
    v = replace(F.lower(trim(_s(value))), r"\s+", "_")
    return F.when(v.isin(list(rules.INDUSTRIES)), v)


def role_family(title: Column, text: Column) -> Column:
    """The family of the title, or else of the text, or else 其他."""
    find = lambda x: first_rule(*((x.rlike(f"(?iu){p}"), name) for name, p in rules.ROLE_FAMILIES))
    return F.coalesce(find(_s(title)), find(_s(text)), F.lit("其他"))


def role_categories(text: Column) -> Column:
    """All families that a text shows."""
    return F.array_compact(F.array(*(F.when(_s(text).rlike(f"(?iu){p}"), name) for name, p in rules.ROLE_FAMILIES)))


def recruitment_type(text: Column) -> Column:
    """The type of a recruitment event."""
    x = _s(text)
    campus = "校招|校园|应届"
    return first_rule(
        (x.rlike("日常实习|长期实习|滚动实习|常规实习"), "DAILY_INTERNSHIP"),
        (x.rlike(f"(?:{campus}|毕业生).{{0,20}}实习|实习.{{0,20}}(?:{campus})"), "CAMPUS_INTERNSHIP"),
        (x.rlike("(?i)校招|校园招聘|应届|毕业生|graduate|campus"), "CAMPUS_FULL_TIME"),
        (x.rlike("(?i)实习|internship|(?:^|[^a-z])intern(?:[^a-z]|$)"), "DAILY_INTERNSHIP"),
        (x.rlike("(?i)社会招聘|社招|experienced|professional hires?|social recruitment"), "EXPERIENCED"),
        default="SPECIAL_PROGRAM",
    )


def recruitment_event(page_title: Column, page_text: Column, link_text: Column, job_title: Column, employment: Column, url: Column, page_type: Column, tier: Column, start: Column, close: Column, places: Column) -> Column:
    """Struct of a recruitment event; a page of another type or an invalid address gives violation instead (Q4:
    status is always OPEN)."""
    return let(clean_url(url), lambda at: _event(at, page_title, page_text, link_text, job_title, employment, page_type, tier, start, close, places))


def _event(at: Column, page_title: Column, page_text: Column, link_text: Column, job_title: Column, employment: Column, page_type: Column, tier: Column, start: Column, close: Column, places: Column) -> Column:
    from veldra.functions.values import unique_strings

    text = F.concat_ws(" ", *(present(x) for x in (page_title, link_text, job_title, employment, at)))
    dates = event_dates(page_text, start, close)
    wrong = first_rule((~page_type.isin("CAMPAIGN", "JOB_LIST", "CAREER_HOME", "PLATFORM_ONLY") | page_type.isNull(), "unsupported_page_type"), (at.isNull(), "invalid_directory_url"))
    platform = F.upper(clean(tier)) == "PLATFORM_ONLY"
    return F.struct(
        recruitment_type(text).alias("recruitmentType"),
        cohort(F.concat_ws(" ", text, page_text)).alias("cohort"),
        F.coalesce(present(page_title), present(link_text)).alias("campaignName"),
        F.lit("OPEN").alias("status"),
        dates["startAt"].alias("startAt"),
        dates["closesAt"].alias("closesAt"),
        at.alias("directoryUrl"),
        unique_strings(places).alias("locations"),
        F.when(platform, "PLATFORM_ONLY").otherwise("EXPLICIT").alias("publicationClass"),
        wrong.alias("violation"),
    )


def batch(text: Column, scope: Column) -> Column:
    """C14: the batch that a record's text names, or its scope's."""
    return first_rule(*((_s(text).rlike(f"(?i){p}"), name) for name, p in rules.BATCHES), (scope == "internship", "日常实习"), (scope == "social", "社招"), default="待确认批次")


def record_scope(title: Column, text: Column, given: Column, job_type: Column, bucket: Column, cohort_year: Column) -> Column:
    """C14: internship, social or campus: the visible title first, then what is given, then the whole text."""
    t, x = _s(title), F.concat_ws(" ", title, text)
    intern, social, campus = "(?i)实习|intern", "(?i)社招|社会招聘|经验招聘|experienced", "(?i)校招|校园招聘|应届|秋招|春招"
    return first_rule(
        (t.rlike(intern), "internship"),
        (t.rlike(social), "social"),
        (t.rlike(campus + "|(?:20)?2[0-9]届"), "campus"),
        (given.isin("internship", "campus", "social"), given),
        ((job_type == "internship") | x.rlike(intern), "internship"),
        ((bucket == "experienced") | x.rlike(social), "social"),
        default="campus",
    )


def database_bucket(cohort_year: Column, scope: Column) -> Column:
    """C14: the bucket of the database that a record goes to."""
    return first_rule((cohort_year.isNotNull() & (cohort_year != 0), F.concat(F.lit("cohort-"), cohort_year.cast("string"))), (scope == "internship", "daily-internships"), (scope == "social", "social"), default="cohort-unknown")


def organization_type(name: Column, default: Column | None = None) -> Column:
    """The kind of organisation that a name shows."""
    x = _s(name)
    return first_rule((x.rlike("大学|学院|学校"), "高校"), (x.rlike("医院|卫生"), "医院"), (x.rlike("研究院|研究所|科学院"), "科研院所"), (x.rlike("银行|证券|保险|基金"), "金融机构"), (x.rlike("局|委员会|政府|事业单位"), "机关事业单位"), (x.rlike("集团|公司|企业"), "企业"), default=F.lit("待确认") if default is None else default)


def source_trust(kind: Column, url: Column) -> Column:
    """Struct of tier and score of a source."""
    channel = recruitment_channel(url)["channel"]
    row = lambda t, s: F.struct(F.lit(t).alias("tier"), F.lit(s).alias("score"))
    return first_rule(
        (_s(kind).isin("official_company", "official_ats") | channel.isin("official_careers", "delegated_official"), row("official", 100)),
        ((channel == "official_wechat") | (_s(kind) == "official_announcement"), row("high", 90)),
        (_s(kind).isin("government", "university"), row("high", 85)),
        (_s(kind).isin("aggregator", "discovery_index", "job_board"), row("discovery", 45)),
        default=row("lead", 20),
    )


def page_identity(html: Column, names: Column) -> Column:
    """Struct of the signals (title, og, ld, footer, nav) in which one of the names stands, and whether two do on
    a page about recruitment."""
    x = _s(html)
    part = lambda p: replace(F.regexp_extract(x, p, 1), "<[^>]+>", " ")
    places = {"title": r"(?is)<title[^>]*>(.*?)</title>", "og_site_name": r"""(?is)<meta[^>]+property=["']og:site_name["'][^>]+content=["']([^"']+)""", "json_ld": r'(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>', "footer": r"(?is)<footer[^>]*>(.*?)</footer>", "nav": r"(?is)<nav[^>]*>(.*?)</nav>"}

    def stands(p: str) -> Column:
        return let(F.lower(part(p)), lambda t: F.exists(names, lambda n: (F.length(n) >= 2) & t.contains(F.lower(n))))

    signals = F.array_compact(F.array(*(F.when(stands(p), k) for k, p in places.items())))
    about = strip_tags(x, False).rlike("(?i)招聘|职位|岗位|career|jobs?|recruit|join us")
    return let(signals, lambda s: F.struct(s.alias("signals"), ((F.size(s) >= 2) & about).alias("confirmed")))


def hard_negative(url: Column, text: Column) -> Column:
    """C20: the code of evidence against a page; null if none."""
    return let(bare_host(url), lambda h: _negative(h, url, text))


def _negative(h: Column, url: Column, text: Column) -> Column:
    return first_rule(
        (host_in(h, [*rules.CN_AGGREGATORS, *rules.HARD_EXCLUDED]), "aggregator_domain"),
        (h.rlike(r"\.edu(?:\.cn)?$") | host_in(h, rules.UNIVERSITY_SITES), "university_employment_site"),
        (path(url).rlike("(?i)/(?:news|article|media|press)(?:/|$)"), "news_reprint"),
        (_s(text).rlike("培训机构|培训班|就业培训"), "training_provider"),
        (_s(text).rlike("(?i)培训费|押金|体检费|材料费|个人账户转账|加微信|QQ群|下载APK"), "private_or_payment_risk"),
    )


def explicit_job_links(page_links: Column) -> Column:
    """Links that lead to a posting."""
    return F.filter(page_links, lambda a: hinted_role(a["url"], a["text"]).isin("JOB_DETAIL", "APPLY"))


def has_recruitment_structure(text: Column) -> Column:
    """C22"""
    return _s(text).rlike("(?i)职位|岗位|招聘|投递|job|position|vacanc|opening")


def has_no_openings(text: Column) -> Column:
    """C22"""
    return _s(text).rlike("(?i)暂无(?:开放)?职位|暂无岗位|没有在招职位|no (?:current )?open(?:ing|ings| position| positions| job| jobs)")


def is_search_blocked(text: Column) -> Column:
    """C22, K17"""
    return _s(text).rlike("(?i)百度安全验证|安全验证|验证码|captcha|unusual traffic")


def field_errors(company: Column, title: Column, url: Column, start: Column, close: Column) -> Column:
    """What is wrong with fields taken from a page."""
    return F.array_compact(F.array(F.when(clean(company) == "", "missing_company"), F.when(clean(title) == "", "missing_title"), F.when(clean_url(url).isNull(), "invalid_url"), F.when(explicit_date(start) > explicit_date(close), "dates_reversed")))


def opening_status(status: Column, closes_at: Column, today: Column) -> Column:
    """C24"""
    x = F.lower(_s(status))
    return first_rule((x.rlike("closed|expired|inactive|关闭|结束") | (explicit_date(closes_at) < today), "CLOSED"), (x.rlike("active|open|开放|招聘中"), "ACTIVE"), default="UNKNOWN")


def matches_role(title: Column, roles: list[str]) -> Column:
    """Any of the roles in the title; no roles match all."""
    x = planner_text(title)
    hit = F.lit(not [r for r in roles if r.strip()])
    for r in roles:
        if r.strip():
            hit = hit | x.contains(planner_text(F.lit(r)))
    return hit


def matches_location(locations: Column, wanted: str | None) -> Column:
    """Any place contains the wanted one or is contained; nothing wanted or known matches."""
    if not wanted or not wanted.strip():
        return F.lit(True)
    w = F.lower(F.lit(wanted.strip()))
    known = F.coalesce(locations, F.array().cast("array<string>"))
    return (F.size(known) == 0) | F.exists(known, lambda p: F.lower(p).contains(w) | w.contains(F.lower(p)))


def trust(url: Column, company: Column, suspicious: list[str], allowed: list[str] = rules.TRUSTED_ATS) -> Column:
    """Struct of score, flags and level of a posting."""
    u, h = trim(_s(url)), host(url)
    name = trim(replace(F.lower(_s(company)), "[^a-z0-9 ]"))
    words = F.filter(F.split(name, " +"), lambda w: F.length(w) >= 3)
    matches = (name == "") | h.contains(replace(name, " +")) | F.exists(words, lambda w: h.contains(w))
    flags = F.when(u == "", F.array(F.lit("missing_apply_url"))).when(~is_url(url), F.array(F.lit("invalid_url"))).otherwise(
        F.array_compact(F.array(F.when(host_in(h, suspicious), "suspicious_domain"), F.when((trim(_s(company)) != "") & ~host_in(h, allowed) & ~matches, "company_domain_mismatch")))
    )
    return let(flags, _level)


def _level(flags: Column) -> Column:
    cost = F.create_map(*(F.lit(v) for kv in rules.TRUST.items() for v in kv))
    score = clamp(100 - F.aggregate(flags, F.lit(0), lambda a, f: a + cost[f]), 0, 100)
    return let(score, lambda s: F.struct(s.alias("score"), flags.alias("flags"), first_rule((s >= 90, "high"), (s >= 60, "medium"), default="low").alias("level")))


def official_score(url: Column, title: Column, snippet: Column, company: Column, official_domain: Column, tenant: Column, year: Column, kind: Column, rank: Column) -> Column:
    """Struct of totalScore and decision of a candidate for a company's own page."""
    from veldra.functions.urls import ats

    return let(F.struct(host(canonical_url(url)).alias("d"), F.concat_ws(" ", title, snippet).alias("x"), ats(url).isNotNull().alias("v")), lambda u: _official(u["d"], u["x"], u["v"], company, official_domain, tenant, year, kind, rank))


def _official(d: Column, x: Column, vendor: Column, company: Column, official_domain: Column, tenant: Column, year: Column, kind: Column, rank: Column) -> Column:
    has_name = (_s(company) != "") & F.lower(x).contains(F.lower(_s(company)))
    own = F.coalesce((_s(official_domain) != "") & ((d == official_domain) | F.endswith(d, F.concat(F.lit("."), official_domain))), F.lit(False))
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = (
        points(host_in(d, rules.CN_AGGREGATORS), -50)
        + points(own, 40)
        + points(vendor & has_name, 35)
        + points(tenant, 40)
        + F.when(has_name, 25).otherwise(-40)
        + points((year > 0) & x.contains(year.cast("string")), 20)
        + points((_s(kind) != "") & x.contains(_s(kind)), 15)
        + points(x.rlike("(?i)招聘|校招|投递|career|jobs?|campus"), 10)
        + points(rank <= 3, 5)
        + points(x.rlike("已结束|已截止|停止"), -20)
    )
    strong = own | tenant | (vendor & has_name)
    return let(score, lambda s: F.struct(s.alias("totalScore"), first_rule(((s >= 75) & strong, "auto_verify"), (s < 55, "reject"), default="review").alias("decision")))


def site_score(url: Column, title: Column, snippet: Column, tokens: Column, cjk: Column) -> Column:
    """0 to 1.5 for a search hit as a company's own site (Q3: each career word counts half a point)."""
    return let(F.struct(bare_host(url).alias("h"), path(url).alias("p")), lambda u: _site(u["h"], u["p"], title, snippet, tokens, cjk))


def _site(h: Column, where: Column, title: Column, snippet: Column, tokens: Column, cjk: Column) -> Column:
    labels = F.filter(F.split(h, r"\."), lambda x: F.length(x) >= 4)
    plain = F.filter(F.transform(tokens, lambda t: replace(F.lower(t), "[^a-z0-9]+")), lambda t: F.length(t) >= 4)
    owned = F.exists(labels, lambda x: F.exists(plain, lambda t: x.contains(t))) & ~h.rlike(r"\.wd[0-9]+\.myworkdayjobs\.com$|\.myworkday\.com$|^myworkdayjobs\.com$") & ~h.isin(rules.VENDOR_HOSTS)
    has_cjk = F.length(_s(cjk)) >= 2
    in_path = has_cjk & F.concat(h, where).contains(_s(cjk))
    in_text = has_cjk & F.concat_ws(" ", title, snippet).contains(_s(cjk))
    base = first_rule((owned, F.when(F.size(F.split(h, r"\.")) > 3, 0.8).otherwise(1.0)), (in_path, 0.7), (in_text, 0.5), (h.isin(rules.VENDOR_HOSTS), 0.4), (h.isin(rules.AGGREGATOR_HOSTS), 0.2), default=0.0)
    x = F.lower(F.concat_ws(" ", title, snippet))
    hits = F.lit(0)
    for w in rules.CAREER_WORDS:
        hits = hits + x.contains(w).cast("int")
    score = lambda b, n: clamp(b + F.when(in_text & (b < 1), 0.3).otherwise(0.0) + n * 0.5, 0.0, 1.5)
    value = let(F.struct(base.alias("b"), hits.alias("n")), lambda v: F.when(v["b"] == 0, 0.0).otherwise(score(v["b"], v["n"])))
    return F.when(h.isNull() | h.isin(rules.SEARCH_HOSTS), 0.0).otherwise(value)


def identity(strong: Column, medium: Column, risks: Column, role: Column, vacancy: Column, http_status: Column, reachable: Column, semantics: Column) -> Column:
    """Struct of verdict, identityStatus and reviewStatus from lists of evidence and risks."""
    blocked = (vacancy == "BLOCKED") | F.coalesce(http_status.isin(401, 403, 429), F.lit(False))
    high = F.exists(risks, lambda r: r.isin(rules.HIGH_RISKS))
    about = F.coalesce(semantics, F.lit(False)) | role.isin("CAREER_HOME", "CAMPAIGN", "JOB_LIST", "JOB_DETAIL", "APPLY")
    row = lambda v, i, r: F.struct(*((x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in (("verdict", v), ("identityStatus", i), ("reviewStatus", r))))
    active = role.isin("JOB_LIST", "JOB_DETAIL", "APPLY") & (vacancy == "ACTIVE")
    return first_rule(
        (blocked, row("BLOCKED", F.when(F.size(strong) > 0, "PROBABLE").otherwise("UNVERIFIED"), "QUEUED")),
        (high, row("REJECT", "REJECTED", "AUTO_ACCEPTED")),
        ((F.size(strong) > 0) & F.coalesce(reachable, F.lit(True)) & about, row(F.when(active, "AUTO_ACCEPT").otherwise("AUTO_ACCEPT_WITH_LIMITED_ROLE"), "VERIFIED", "AUTO_ACCEPTED")),
        (F.size(medium) >= 2, row("MANUAL_REVIEW", "PROBABLE", "QUEUED")),
        default=row("UNVERIFIED", "UNVERIFIED", "QUEUED"),
    )


def domain_risks(url: Column, official: Column, page_text: Column) -> Column:
    """Signals against an address: literals, punycode, shape, forms, look-alikes, requests for money."""
    from veldra.functions.urls import port

    return let(F.struct(host(url).alias("h"), port(url).alias("o")), lambda u: _risks(u["h"], u["o"], official, page_text))


def _risks(h: Column, o: Column, official: Column, page_text: Column) -> Column:
    from veldra.functions.text import is_lookalike

    return F.when(h.isNull(), F.array(F.lit("invalid_url"))).otherwise(
        F.array_compact(
            F.array(
                F.when(h.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") | h.contains(":"), "ip_literal_host"),
                F.when(h.contains("xn--"), "punycode_domain"),
                F.when(o.isNotNull() & ~o.isin("80", "443"), "non_standard_port"),
                F.when((F.length(h) - F.length(F.replace(h, F.lit("-"), F.lit(""))) >= 4) | F.split(h, r"\.")[0].rlike("(?i)[a-z0-9]{18,}"), "abnormal_domain_shape"),
                F.when(host_in(h, ["docs.qq.com", "pan.baidu.com", "weiyun.com", "qun.qq.com", "chat.whatsapp.com"]), "personal_form_or_cloud_drive"),
                F.when(F.exists(official, lambda d: is_lookalike(registrable_domain(h), registrable_domain(d))), "lookalike_official_domain"),
                F.when(_s(page_text).rlike("(?i)培训费|押金|体检费|材料费|个人账户转账|加微信|QQ群|下载APK"), "payment_or_private_contact_risk"),
            )
        )
    )


def student_match(role_hits: Column, skill_hits: Column, skills: Column, job_type: Column, min_years: Column, location: Column, restricted: Column, active: Column) -> Column:
    """Struct of score (0 to 100) and priority of a posting for a student, before exclusions."""
    share = F.when(skills > 0, skill_hits / F.least(skills, F.lit(10))).otherwise(0.25)
    early = job_type.isin("internship", "new_grad_full_time", "early_career")
    score = 35 * F.least(F.lit(1.0), role_hits / 2) + 35 * F.least(F.lit(1.0), share)
    score = score + F.when(early, 15).when(min_years > 1, -30).otherwise(0) + F.when(location, 10).otherwise(0) - F.when(restricted, 35).otherwise(0) + F.when(active, 5).otherwise(0)
    whole_score = clamp(F.floor(score + 0.5).cast("int"), 0, 100)
    return F.struct(whole_score.alias("score"), first_rule((whole_score >= 75, "High"), (whole_score >= 55, "Medium"), default="Low").alias("priority"))


def work_authorization_limits(text: Column) -> Column:
    """Whether a posting limits who may work."""
    return _s(text).rlike(r"(?is)no (?:visa |immigration )?sponsorship|(?:visa |immigration )?sponsorship (?:is |will be )?not (?:available|provided|offered)|must be (?:a )?u\.?s\.? citizen|security clearance|(?<![a-z])itar(?![a-z])")


def fresh_verification(source_type: Column, browser_verified: Column, status: Column, verified_at: Column, now: Column) -> Column:
    """A platform's lead counts as fresh for 48 hours after it was seen active."""
    return F.coalesce(((source_type == "verified_platform_apply") | browser_verified) & (status == "active") & (F.unix_seconds(now) - F.unix_seconds(verified_at) <= 48 * 3600), F.lit(False))
