"""Governance of official links: registries, search-hit classes, entry selection and sanitising.  C17, C18, C21, F19, O11, A14, J6, J18, X12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions.classify import first_rule
from veldra.functions.text import _s, company_alias, let, replace
from veldra.functions.urls import ATS_HOSTS, _parts, ats, governed_url, host, host_in, host_suffixes, is_company_ats_host, path, query, registrable_domain
from veldra.operators.pick import first_by

#: Domains that are never an employer's own, and media.
DENIED = ["gaoxiaojob.com", "wondercv.com", "linkedin.com", "jobui.com", "qiuzhifangzhou.com", "bosszhipin.com", "bendibao.com", "91jzx.cn", "fandow.com", "pzw520.com", "nowcoder.com", "gankinterview.cn", "gankinterview.com", "langlangwangshen.com", "niuqizp.com", "niuqizhipin.com", "yingjiesheng.com", "shixiseng.com", "liepin.com", "zhipin.com", "51job.com", "lagou.com", "zhaopin.com", "ncss.cn", "91wllm.cn", "91wllm.com"]
MEDIA = ["thepaper.cn", "36kr.com", "huxiu.com", "sohu.com", "sina.com.cn", "163.com", "qq.com"]
#: Platforms, their names and the paths of their company pages.
BOARDS = [
    ("liepin.com", "猎聘", r"^/company(?:-jobs)?/\d+/?$"),
    ("zhipin.com", "BOSS直聘", r"^/gongsi/job/[a-z0-9]+\.html$|^/companys?/[a-z0-9]+/?(?:jobs?)?/?$"),
    ("zhaopin.com", "智联招聘", r"/company/.+/jobs?/?$|/companydetail/.+"),
    ("51job.com", "前程无忧", r"/company/.+"),
    ("lagou.com", "拉勾", r"/gongsi/j?\d+\.html$"),
]
#: Paths (with query) of applications, of career pages, of lists, and what announcements of campaigns say.
APPLY_PATH = r"(?i)(?:apply|application|jobid|positionid|projectid|tenantid|jobs?/[^/]+|position/[^/]+|zwcx|job-list|joblist|positions?)(?:/|$|[?])"
CAREER_PATH = r"(?i)(?:^|/)(?:career|careers|job|jobs|join|join-us|recruit|recruitment|campus|talent|positions?|apply)(?:/|$|[?#])|校园招聘|加入我们|人才招聘|社会招聘"
LIST_PATH = r"(?i)(?:jobs?|positions?)(?:/|$|[?#])"
CAMPAIGN_TEXT = r"20\d{2}届|校招|校园招聘|秋招|春招|提前批|暑期实习|实习生|补录|招聘公告|招聘启事"
LINK_ROLES = ["applyUrl", "jobDetailUrl", "jobListUrl", "campaignLandingUrl", "companyCareerHomeUrl"]
#: Roles that an address may have to stand in a column.
ALLOWED = {"applyUrl": ["application_form"], "jobDetailUrl": ["application_form"], "jobListUrl": ["job_list"], "campaignLandingUrl": ["campaign_announcement"], "companyCareerHomeUrl": ["company_career_home"]}


def governed_role(where: Column, source: Column, own: Column) -> Column:
    """The role of a governed address, by source before path (with query)."""
    return first_rule(
        (source == "wechat", "official_wechat_announcement"),
        (source.isin("university", "government"), "trusted_repost"),
        (source == "aggregator", "aggregator_source"),
        (source == "media", "media_article"),
        (where.rlike(APPLY_PATH), "application_form"),
        (F.coalesce(F.try_url_decode(where), where).rlike(CAMPAIGN_TEXT), "campaign_announcement"),
        (where.rlike(LIST_PATH) & where.rlike(CAREER_PATH), "job_list"),
        (where.rlike(CAREER_PATH) | own, "company_career_home"),
        default="unknown",
    )


def govern(links: DataFrame, domains: DataFrame, tenants: DataFrame, accounts: DataFrame) -> DataFrame:
    """Links (id, company, url) with canonical_url, source_type, role, decision and ats.

    ``domains``: (company, domain); ``tenants``: (company, host, tenant); ``accounts``: (company, biz).  The registries
    are met by equi-joins on the company's alias key and the host's suffixes, so they may be as large as they like.
    """
    u = governed_url(F.col("url"))
    base = links.withColumn("canonical_url", u["canonicalUrl"]).withColumn("_key", company_alias(F.col("company")))
    parts = _parts(F.col("canonical_url"), lambda p: F.struct(replace(p["host"], r"^www\.").alias("h"), F.concat(p["path"], p["query"]).alias("w"), F.regexp_extract(p["query"], r"[?&]__biz=([^&]*)", 1).alias("b")))
    base = base.withColumn("_p", parts).withColumn("_root", registrable_domain(F.col("_p.h")))
    wide = base.where("_p is not null").select("id", "_key", F.col("_p.h").alias("_h"), F.col("_p.w").alias("_w"), F.explode(host_suffixes(F.col("_p.h"))).alias("_d"))
    own = domains.select(company_alias(F.col("company")).alias("_key"), F.lower("domain").alias("_d")).distinct()
    by_domain = wide.join(own, ["_key", "_d"]).select("id").distinct().withColumn("_domain", F.lit(True))
    t = tenants.select(company_alias(F.col("company")).alias("_key"), F.lower("host").alias("_d"), F.lower(F.coalesce("tenant", F.lit(""))).alias("_t")).distinct()
    by_tenant = wide.join(t, ["_key", "_d"]).where((F.col("_t") == "") | F.col("_h").contains(F.col("_t")) | F.lower("_w").contains(F.col("_t"))).select("id").distinct().withColumn("_tenant", F.lit(True))
    a = accounts.select(company_alias(F.col("company")).alias("_key"), F.col("biz").alias("_b")).distinct()
    by_account = base.select("id", "_key", F.col("_p.b").alias("_b")).where("_b <> ''").join(a, ["_key", "_b"]).select("id").distinct().withColumn("_account", F.lit(True))
    out = base.join(by_domain, "id", "left").join(by_tenant, "id", "left").join(by_account, "id", "left")
    h, root, yes = F.col("_p.h"), F.col("_root"), lambda c: F.coalesce(F.col(c), F.lit(False))
    vendor = ats(F.col("canonical_url"))
    tenant = vendor.isNotNull() & yes("_tenant")
    row = lambda kind, decision: F.struct(F.lit(kind).alias("source_type"), F.lit(decision).alias("decision"))
    verdict = first_rule(
        (F.col("canonical_url") == "", row("unknown", "missing_or_dead")),
        (h.rlike(r"\.edu\.(?:cn|hk)$|91wllm\.com$"), row("university", "university_repost")),
        (root.rlike(r"(?:^|\.)gov\.cn$"), row("government", "government_repost")),
        (root.isin(DENIED) & ~tenant, row("aggregator", "aggregator_source")),
        ((h == "mp.weixin.qq.com") & yes("_account"), row("wechat", "official_wechat_announcement")),
        (h == "mp.weixin.qq.com", row("wechat", "wechat_identity_unproven")),
        (root.isin(MEDIA), row("media", "media_article")),
        (tenant, row("delegated_ats", "ats_tenant_confirmed")),
        (vendor.isNotNull(), row("delegated_ats", "ats_platform_recognized")),
        (yes("_domain"), row("corporate_domain", "corporate_domain_confirmed")),
        default=row("unknown", "unknown"),
    )
    out = out.withColumn("_v", verdict).withColumn("ats", F.when(F.col("_v.source_type") == "delegated_ats", vendor))
    role = governed_role(F.col("_p.w"), F.col("_v.source_type"), F.col("_v.decision").isin("corporate_domain_confirmed", "ats_tenant_confirmed"))
    return out.select(*links.columns, "canonical_url", "_v.source_type", "_v.decision", F.when(F.col("canonical_url") != "", role).otherwise("unknown").alias("role"), "ats")


def sanitize_entries(records: DataFrame, governed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, removed): records (id and the columns of ``LINK_ROLES``) keep an address only where its role may
    stand, and in the foremost column only; the others move to ``removed`` (id, column, url, decision).

    ``governed``: (id, url, decision, role) of all their addresses.
    """
    flat = records.select("id", F.explode(F.create_map(*(x for c in LINK_ROLES for x in (F.lit(c), F.col(c))))).alias("column", "url")).where("url is not null and url <> ''")
    may = F.create_map(*(x for c, roles in ALLOWED.items() for x in (F.lit(c), F.array(*map(F.lit, roles)))))
    judged = flat.join(governed.select("id", "url", "decision", "role").distinct(), ["id", "url"], "left")
    fine = F.col("decision").isin("corporate_domain_confirmed", "ats_tenant_confirmed") & F.array_contains(may[F.col("column")], F.col("role"))
    fine = fine | ((F.col("decision") == "official_wechat_announcement") & (F.col("column") == "campaignLandingUrl"))
    judged = judged.withColumn("fine", F.coalesce(fine, F.lit(False)))
    order = F.array_position(F.array(*map(F.lit, LINK_ROLES)), F.col("column"))
    kept = first_by(judged.where("fine").withColumn("o", order), ["id", "url"], F.col("o"))
    kept = kept.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("column", "url"))).alias("m"))
    rest = [c for c in records.columns if c not in LINK_ROLES]
    clean = records.select(*rest).join(kept, "id", "left").select(*rest, *(F.col("m")[c].alias(c) for c in LINK_ROLES))
    best = F.coalesce(*LINK_ROLES)
    entry = F.coalesce("applyUrl", "jobDetailUrl", "jobListUrl")
    clean = clean.withColumn("primaryUrl", best).withColumn("verificationState", F.when(entry.isNotNull(), "VERIFIED").otherwise("UNVERIFIED"))
    return clean, judged.where("not fine").select("id", "column", "url", "decision")


def hit_class(url: Column, title: Column, snippet: Column, company: Column, official_domain: Column, tenant: Column, paid: Column) -> Column:
    """Struct of kind, decision, role and reasons of a search hit."""
    text = F.concat_ws(" ", title, snippet)
    name = lambda x: replace(replace(F.lower(_s(x)), "(?:集团|股份)?有限公司$|有限责任公司$|股份公司$|集团$"), r"[\s\-—_·•（）()【】\[\]，,。.!！?？]")
    named = F.coalesce(tenant, F.lit(False)) | ((F.length(name(company)) >= 2) & name(text).contains(name(company)))
    content = r"(?i)新闻|资讯|报道|媒体|百科|论坛|文章|行业动态|news|article|content|press|media|wiki|blog"
    semantics = r"(?i)招聘|职位|岗位|校招|校园招聘|社会招聘|社招|实习|应届|人才招聘|加入我们|careers?|jobs?|positions?|campus|graduate|intern|recruit|join us"

    def judged(u: Column) -> Column:
        h, p = replace(u["host"], r"^www\."), F.lower(u["path"])
        board, page = F.lit(None).cast("string"), F.lit(False)
        for domain, label, pattern in reversed(BOARDS):
            board, page = F.when(host_in(h, [domain]), label).otherwise(board), F.when(host_in(h, [domain]), p.rlike(pattern)).otherwise(page)
        listing = p.rlike(r"/zhaopin/?$|/web/geek/job/?$|/jobs?/search|/search|/sou/|/list/") | u["query"].rlike(r"(?i)[?&](?:key|keyword|query|kw)=")
        bad = F.array_compact(F.array(F.when(F.coalesce(paid, F.lit(False)), "paid_search_result"), F.when(p.rlike(content) | (text.rlike(content) & ~text.rlike("招聘职位|岗位列表")), "news_or_content_page")))
        role = first_rule((p.rlike(r"/(?:apply|application)(?:/|$)"), "APPLY"), (p.rlike(r"/(?:job|position)/[^/]+") | u["query"].rlike("(?i)(?:jobId|positionId)="), "JOB_DETAIL"), (p.rlike(r"/(?:jobs?|positions?|internship|graduate|social/position)(?:/|$)"), "JOB_LIST"), default="CAREER_HOME")
        missing = F.array_compact(F.array(F.when(~named, "company_identity_mismatch"), F.when(~F.concat_ws(" ", h, p, text).rlike(semantics), "missing_recruitment_semantics")))
        vendor = host_in(h, [d for d, _ in ATS_HOSTS]) & (F.coalesce(tenant, F.lit(False)) | is_company_ats_host(F.concat(F.lit("https://"), h)))
        none = F.array().cast("array<string>")
        row = lambda kind, decision, role_, reasons: F.struct(*((x if isinstance(x, Column) else F.lit(x).cast("string")).alias(n) for n, x in (("kind", kind), ("decision", decision), ("role", role_), ("reasons", reasons))))
        one = lambda r: F.array(F.lit(r))
        return first_rule(
            (u.isNull(), row("INVALID", "REJECT", None, one("invalid_url"))),
            (F.size(bad) > 0, row("REJECTED_SOURCE", "REJECT", None, bad)),
            (board.isNotNull() & listing, row("JOB_BOARD_SEARCH", "REJECT", None, one("job_board_search_page"))),
            (board.isNotNull() & ~page, row("JOB_BOARD_OTHER", "REJECT", None, one("job_board_not_company_list"))),
            (board.isNotNull() & ~named, row("JOB_BOARD_COMPANY_LIST", "REJECT", None, one("company_identity_mismatch"))),
            (board.isNotNull(), row("JOB_BOARD_COMPANY_LIST", "FALLBACK", "JOB_BOARD_COMPANY_LIST", none)),
            (F.size(missing) > 0, row("UNKNOWN", "REJECT", None, missing)),
            (vendor, row("ATS_RECRUITMENT", "VERIFY_PAGE", role, none)),
            default=row("OFFICIAL_RECRUITMENT", "VERIFY_PAGE", role, none),
        )

    return _parts(url, judged)


def best_entries(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's usable hits (kind, decision, rank) the most official, then the first."""
    rank = F.create_map(F.lit("OFFICIAL_RECRUITMENT"), F.lit(3), F.lit("ATS_RECRUITMENT"), F.lit(2), F.lit("JOB_BOARD_COMPANY_LIST"), F.lit(1))[F.col("kind")]
    return first_by(hits.where(F.col("decision").isin("VERIFY_PAGE", "FALLBACK")), keys, -F.coalesce(rank, F.lit(0)), F.coalesce("rank", F.lit(999)), F.col("url"))


def platform_jobs(pages: DataFrame) -> DataFrame:
    """(company, url, title) of the distinct links to postings on confirmed platform pages (company, url, title,
    html)."""
    from veldra.functions.classify import explicit_job_links, source_policy
    from veldra.functions.urls import links as page_links

    policy = source_policy(F.col("url"), F.col("company"), F.col("title"), F.lit(None).cast("string"))
    good = pages.where(policy["decision"] == "PLATFORM_CANDIDATE")
    found = good.select("company", F.explode(explicit_job_links(page_links(F.col("html"), F.col("url")))).alias("a"))
    return found.select("company", "a.url", F.col("a.text").alias("title")).dropDuplicates(["company", "url"])


def infer_domains(records: DataFrame, domains: DataFrame, edits: int = 0) -> DataFrame:
    """Addresses to try for records (id, company, has_career) of known companies that have no career page.

    With ``edits`` a company counts as known if its key is within so many edits of a known one; the nearest ones are
    taken."""
    from veldra.operators.similarity import nearest_aliases

    due = records.where(~F.coalesce("has_career", F.lit(False))).withColumn("_key", company_alias(F.col("company")))
    known = domains.select(company_alias(F.col("company")).alias("_key"), F.lower("domain").alias("domain")).distinct()
    if edits:
        value = lambda df: df.select(F.col("_key").alias("value")).where("value <> ''")
        known = nearest_aliases(value(due), value(known), edits).join(known.withColumnRenamed("_key", "known"), "known").select(F.col("value").alias("_key"), "domain").distinct()
    shapes = F.array(*(F.concat(F.lit(a), F.col("domain"), F.lit(b)) for a, b in (("https://careers.", "/"), ("https://jobs.", "/"), ("https://www.", "/careers"))))
    return due.join(known, "_key").select("id", "company", F.explode(shapes).alias("url"))


def surface_admits(root: Column, tenant: Column, url: Column) -> Column:
    """whether a page belongs to a recruitment surface: the same domain and, if there is one, the tenant."""
    same = registrable_domain(host(url)) == root
    return let(F.lower(F.concat(host(url), path(url), query(url))), lambda x: F.coalesce(same & ((_s(tenant) == "") | x.contains(F.lower(_s(tenant)))), F.lit(False)))
