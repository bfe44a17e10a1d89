"""URL functions over Columns: parts by pattern, never by a parser that raises.

A URL here is ``scheme://[user@]host[:port][/path][?query][#fragment]`` with scheme http or https in any case.  The
host is lower-cased; an address with white space inside or without a host is invalid, and its parts are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldra.functions.text import WS, _s, clean, let, replace, trim

_URL = rf"^(?i:(https?))://(?:[^/?#@{WS}]*@)?([^/?#:@{WS}]+)(?::(\d*))?(?=[/?#]|$)([^?#{WS}]*)(\?[^#{WS}]*)?(#.*)?$"

#: Parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "from", "source", "ref", "referrer", "campaign", "bd_vid"]
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ["com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "com.hk", "edu.hk", "org.hk", "co.uk", "com.au", "co.jp"]


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(trim(_s(url)), _URL, group)


def _parts(url: Column, body) -> Column:
    """``body`` of a url's struct of scheme, host, port, path, query and fragment, taken apart once."""

    def cut(u: Column) -> Column:
        get = lambda i: F.regexp_extract(u, _URL, i)
        raw = F.struct(F.lower(get(1)).alias("s"), F.lower(get(2)).alias("h"), get(3).alias("o"), get(4).alias("p"), get(5).alias("q"), get(6).alias("f"))
        return F.when(u.rlike(_URL), raw)

    def tidy(r: Column) -> Column:
        own = F.when(r["s"] == "https", "443").otherwise("80")
        return F.when(r.isNotNull(), F.struct(r["s"].alias("scheme"), r["h"].alias("host"), F.when((r["o"] != "") & (r["o"] != own), r["o"]).alias("port"), F.when(r["p"] == "", "/").otherwise(r["p"]).alias("path"), F.when(r["q"] == "?", "").otherwise(r["q"]).alias("query"), r["f"].alias("fragment")))

    return let(trim(_s(url)), lambda u: let(cut(u), lambda r: let(tidy(r), body)))


def is_url(url: Column) -> Column:
    return trim(_s(url)).rlike(_URL)


def scheme(url: Column) -> Column:
    return F.lower(F.nullif(_part(url, 1), F.lit("")))


def host(url: Column) -> Column:
    return F.lower(F.nullif(_part(url, 2), F.lit("")))


def bare_host(url: Column) -> Column:
    """The host without a leading www."""
    return replace(host(url), r"^www\.")


def port(url: Column) -> Column:
    """The port unless it is the scheme's own."""
    return _parts(url, lambda u: u["port"])


def path(url: Column) -> Column:
    return _parts(url, lambda u: u["path"])


def query(url: Column) -> Column:
    """With its question mark; empty if there is none or nothing in it."""
    return _parts(url, lambda u: u["query"])


def fragment(url: Column) -> Column:
    return _parts(url, lambda u: u["fragment"])


def _parameter(search: Column, name: str) -> Column:
    return F.when(search.rlike(rf"[?&]{name}="), F.try_url_decode(F.regexp_extract(search, rf"[?&]{name}=([^&]*)", 1)))


def parameter(url: Column, name: str) -> Column:
    """The decoded value of the first parameter of that name; null if there is none."""
    return _parts(url, lambda u: _parameter(u["query"], name))


def _join(u: Column, search: Column, tail: Column | None = None, where: Column | None = None) -> Column:
    at = F.coalesce(F.concat(F.lit(":"), u["port"]), F.lit(""))
    return F.concat(u["scheme"], F.lit("://"), u["host"], at, u["path"] if where is None else where, search, F.lit("") if tail is None else tail)


def clean_url(url: Column) -> Column:
    """Http and https only, without fragment; null if invalid."""
    return _parts(url, lambda u: _join(u, u["query"]))


def _without(search: Column, drop: str) -> Column:
    """The query without parameters whose name matches."""
    kept = F.filter(F.split(F.substring(search, 2, 1 << 30), "&"), lambda p: ~p.rlike(rf"(?i)^(?:{drop})(?:=|$)") & (p != ""))
    return let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("?"), F.array_join(k, "&"))).otherwise(""))


def canonical_url(url: Column) -> Column:
    """``clean_url`` without tracking parameters; empty if invalid."""
    return F.coalesce(_parts(url, lambda u: _join(u, _without(u["query"], "|".join(["utm_[^=]*", *TRACKING])))), F.lit(""))


def document_url(url: Column, drop: list[str] | None = None) -> Column:
    """The same with a list of one's own; null if invalid."""
    return _parts(url, lambda u: _join(u, _without(u["query"], "|".join(drop or ["utm_[^=]*", "spm", "from", "source", "share", "timestamp"]))))


def is_static_asset(url: Column) -> Column:
    """An address of a file that is no page."""
    return _s(url).rlike(r"(?i)\.(?:css|js|mjs|cjs|map|png|jpe?g|gif|svg|ico|webp|woff2?|ttf|otf|eot|mp4|mp3|pdf|zip|json|xml|txt|wasm)(?:$|[?#])")


def robots_disallow(url: Column, disallowed: list[str]) -> Column:
    """Whether a path begins with a disallowed one."""
    p = path(url)
    return F.coalesce(F.exists(F.array(*map(F.lit, [d for d in disallowed if d] or ["\0"])), lambda d: F.startswith(p, d)), F.lit(False))


def governed_url(url: Column) -> Column:
    """U4: struct of originalUrl, canonicalUrl and reason (invalid_url, static_asset or empty).

    Redirect wrappers are unwrapped, tracking parameters and trailing slashes go.
    """

    def governed(original: Column) -> Column:
        def parts(u: Column) -> Column:
            where = F.when(F.length(u["path"]) > 1, replace(u["path"], "/+$")).otherwise(u["path"])
            tail = F.when(u["path"].rlike(r"(?i)/(?:#|index\.html$)"), u["fragment"]).otherwise("")
            whole = _join(u, _without(u["query"], "|".join(["utm_[^=]*", "spm", "from", "source", "ref"])), tail, where)
            reason = F.when(u.isNull(), "invalid_url").when(is_static_asset(u["path"]), "static_asset").otherwise("")
            return let(reason, lambda r: F.struct(original.alias("originalUrl"), F.when(r == "", whole).otherwise("").alias("canonicalUrl"), r.alias("reason")))

        return _parts(unwrap(original), parts)

    return let(clean(url), governed)


def unwrap(url: Column) -> Column:
    """The target of a job site's jump page or of a captcha page; others as they are, invalid ones empty."""

    def target(u: Column) -> Column:
        jump = host_in(u["host"], ["nowcoder.com"]) & (u["path"] == "/jump")
        captcha = host_in(u["host"], ["mp.weixin.qq.com"]) & u["path"].rlike("(?i)wappoc_appmsgcaptcha")
        wrapped = F.when(jump, _parameter(u["query"], "url")).when(captcha, F.coalesce(_parameter(u["query"], "target_url"), _parameter(u["query"], "url")))
        return F.coalesce(F.nullif(wrapped, F.lit("")), F.when(u.isNotNull(), trim(_s(url))), F.lit(""))

    return _parts(url, target)


def search_target(href: Column) -> Column:
    """The target of a search engine's redirect link."""
    link = F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).when(F.startswith(href, F.lit("/")), F.concat(F.lit("https://duckduckgo.com"), href)).otherwise(href)
    found = _parts(link, lambda u: F.when(host_in(u["host"], ["duckduckgo.com"]) & (u["path"] == "/l/"), _parameter(u["query"], "uddg")))
    return F.coalesce(F.nullif(found, F.lit("")), href)


def registrable_domain(name: Column) -> Column:
    """The last two labels of a host, three under a suffix of two.  A public suffix list isn't at hand."""
    h = replace(replace(replace(replace(F.lower(_s(name)), "^https?://"), r"^www\."), ":[0-9]+(?=/|$)"), "/.*$")

    def short(x: Column) -> Column:
        labels = F.filter(F.split(x, r"\."), lambda p: p != "")
        return let(labels, lambda p: let(F.array_join(F.slice(p, -2, 2), "."), lambda two: F.when(two.isin(TWO_LABEL_SUFFIXES), F.array_join(F.slice(p, -F.least(F.size(p), F.lit(3)), 3), ".")).otherwise(two)))

    return let(replace(h, r"\.$"), lambda x: F.when(F.size(F.split(x, r"\.")) <= 2, x).otherwise(short(x)))


def host_in(name: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    hit = F.lit(False)
    for d in domains:
        hit = hit | (name == d) | F.endswith(name, F.lit("." + d))
    return F.coalesce(hit, F.lit(False))


def host_suffixes(name: Column) -> Column:
    """A host and all domains above it, for an equi-join with a table of domains."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def official_domain(x: Column) -> Column:
    """U8: the host of an official domain or URL, without www; null if there is none."""
    x = replace(F.lower(trim(_s(x))), "^https?://")
    return F.nullif(replace(replace(replace(x, "[/?#].*$"), r":\d+$"), r"^www\."), F.lit(""))


def _octet(name: Column, i: int) -> Column:
    return F.get(F.split(name, r"\."), F.lit(i)).try_cast("int")


def is_private_host(name: Column) -> Column:
    """A name or address literal that isn't public."""

    def private(h: Column) -> Column:
        a, b = _octet(h, 0), _octet(h, 1)
        v4 = h.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
        inner = (a == 0) | (a == 10) | (a == 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 198) & b.isin(18, 19))
        v6 = h.contains(":") & (h.isin("::", "::1") | h.rlike("^(?:f[cd]|fe[89ab])"))
        local = (h == "localhost") | h.rlike(r"\.(?:localhost|local|internal)$")
        return F.coalesce((h == "") | local | (v4 & inner) | v6, F.lit(False))

    return let(replace(replace(F.lower(_s(name)), r"^\[|\]$"), "%.*$"), private)


def public_target(url: Column) -> Column:
    """Struct of safe and reasonCode, as far as the address itself tells (no name is resolved)."""

    def judged(u: Column) -> Column:
        reason = (
            F.when(u.isNull(), "unsupported_protocol")
            .when(u["host"].rlike(r"^(?:localhost|.*\.(?:localhost|local|internal))$"), "local_hostname")
            .when(u["port"].isNotNull(), "non_standard_port")
            .when(is_private_host(u["host"]), "private_ip")
        )
        return let(reason, lambda r: F.struct(r.isNull().alias("safe"), r.alias("reasonCode")))

    return _parts(url, judged)


#: Hosts of applicant tracking systems, in the order they are tried.
ATS_HOSTS = [
    ("mokahr.com", "moka"),
    ("zhiye.com", "beisen_zhiye"),
    ("hotjob.cn", "hotjob"),
    ("jobs.feishu.cn", "feishu_jobs"),
    ("myworkdayjobs.com", "workday"),
    ("jobs2web.com", "jobs2web"),
    ("greenhouse.io", "greenhouse"),
    ("smartrecruiters.com", "smartrecruiters"),
    ("tupu360.com", "tupu360"),
    ("moseeker.com", "moseeker"),
    ("zhaopin.com", "zhaopin_campaign"),
    ("73cn.cn", "73cn"),
    ("jobs.lever.co", "lever"),
    ("jobs.ashbyhq.com", "ashby"),
]


def ats(url: Column) -> Column:
    """The applicant tracking system of a host; null if it is none."""

    def vendor_of(h: Column) -> Column:
        out = F.lit(None).cast("string")
        for domain, vendor in reversed(ATS_HOSTS):
            out = F.when(host_in(h, [domain]), vendor).otherwise(out)
        return out

    return let(host(url), vendor_of)


def ats_fingerprint(url: Column, html: Column, signs: dict[str, tuple[str, str]]) -> Column:
    """Struct of vendor and confidence: 1 by host, 0.8 by a sign in the page.  ``signs``: vendor -> (host, sign),
    both patterns, in order."""
    out = F.lit(None).cast("struct<vendor:string,confidence:double>")
    for vendor, (h, sign) in reversed(signs.items()):
        row = lambda c, vendor=vendor: F.struct(F.lit(vendor).alias("vendor"), F.lit(c).alias("confidence"))
        out = F.when(host(url).rlike(h), row(1.0)).when(_s(html).rlike(sign), row(0.8)).otherwise(out)
    return out


def source(url: Column) -> Column:
    """Struct of source and sourceType by host."""
    row = lambda a, b: F.struct((F.lit(a) if isinstance(a, str) else a).alias("source"), F.lit(b).alias("sourceType"))
    return let(bare_host(url), lambda h: (
        F.when(h.isNull(), row("unknown", "unknown"))
        .when(F.endswith(h, F.lit("linkedin.com")), row("LinkedIn", "discovery"))
        .when(F.endswith(h, F.lit("indeed.com")) | h.contains(".indeed."), row("Indeed", "discovery"))
        .when(F.endswith(h, F.lit("greenhouse.io")), row("Greenhouse", "official_ats"))
        .when(F.endswith(h, F.lit("ashbyhq.com")), row("Ashby", "official_ats"))
        .when(F.endswith(h, F.lit("lever.co")), row("Lever", "official_ats"))
        .when(h.contains("myworkdayjobs.com"), row("Workday", "official_ats"))
        .when(F.endswith(h, F.lit("smartrecruiters.com")), row("SmartRecruiters", "official_ats"))
        .when(F.endswith(h, F.lit("teamtailor.com")), row("Teamtailor", "official_ats"))
        .otherwise(row(h, "company_site"))
    ))


#: Sites that only list jobs of others.
INDEX_HOSTS = ["nowcoder.com", "yingjiesheng.com", "shixiseng.com", "ncss.cn", "zhipin.com", "liepin.com", "iguopin.com", "job.mohrss.gov.cn", "sasac.gov.cn", "sydwgkzp.cn", "jobonline.cn", "lagou.com", "51job.com", "kanzhun.com", "gankinterview.com", "gankinterview.cn", "langlangwangshen.com", "langlangws.com", "niuqizp.com", "niuqizhipin.com", "niuqizhipin.cn"]


CHANNEL_RANK = {"official_careers": 5, "official_wechat": 4, "delegated_official": 3, "official_candidate": 2, "discovery_index": 1, "invalid": 0}


def recruitment_channel(url: Column) -> Column:
    """Struct of url (https, unwrapped), channel and rank."""

    def channel(u: Column) -> Column:
        h = replace(u["host"], r"^www\.")
        https = replace(_join(u, u["query"], u["fragment"]), "^http:", "https:")
        name = (
            F.when(u.isNull(), "invalid")
            .when(h == "mp.weixin.qq.com", "official_wechat")
            .when(host_in(h, INDEX_HOSTS) | h.isin("zhaopin.com", "sou.zhaopin.com", "jobs.zhaopin.com"), "discovery_index")
            .when(host_in(h, ["zhaopin.com"]), "delegated_official")
            .when(F.concat(h, u["path"], u["fragment"]).rlike("(?i)job|position|career|recruit|campus|join|apply"), "official_careers")
            .otherwise("official_candidate")
        )
        rank = lambda c: F.create_map(*(F.lit(v) for kv in CHANNEL_RANK.items() for v in kv))[c]
        return let(name, lambda c: F.struct(F.coalesce(https, F.lit("")).alias("url"), c.alias("channel"), rank(c).alias("rank")))

    return _parts(unwrap(url), channel)


def best_channel(urls: Column) -> Column:
    """The channel of the highest rank, 2 at least, the first of equals; null if there is none."""
    found = F.filter(F.transform(urls, recruitment_channel), lambda x: x["rank"] >= 2)
    keyed = F.transform(found, lambda x, i: F.struct(x["rank"].alias("k"), (-i).alias("i"), x.alias("x")))
    return F.array_max(keyed)["x"]


def is_official_channel(channel: Column) -> Column:
    """U12"""
    return channel.isin("official_careers", "official_wechat", "delegated_official")


def market_region(value: Column) -> Column:
    """CN or NA by a name for it, NA if unknown."""
    t = F.upper(trim(_s(value)))
    return F.when(t.isin("CN", "CHINA"), "CN").otherwise("NA")


def market(value: Column) -> Column:
    """U13, strict: null for a name that isn't known."""
    t = F.upper(trim(_s(value)))
    return F.when(t.isin("CN", "CHINA", "中国"), "CN").when(t.isin("NA", "NORTH AMERICA", "US", "USA", "CANADA"), "NA")


#: What points to a market, first the addresses and then the country.
CN_SITES = ["zhipin.com", "nowcoder.com", "yingjiesheng.com", "lagou.com", "liepin.com", "shixiseng.com", "maimai.cn", "51job.com", "kanzhun.com", "weibo.cn"]
NA_SITES = ["linkedin.com", "indeed.com", "job-boards.greenhouse.io", "jobs.lever.co", "jobs.ashbyhq.com", "myworkdayjobs.com", "teamtailor.com", "jobs.smartrecruiters.com"]
CN_COUNTRIES = ["CN", "CHINA", "MAINLAND CHINA", "HONG KONG", "TW", "TAIWAN", "HK", "MO", "MACAO"]


def infer_market(given: Column, country: Column, *addresses: Column) -> Column:
    """The market as given, by the addresses' sites, by the country, or else NA."""
    blob = F.lower(F.concat_ws("\n", *addresses))
    has = lambda sites: blob.rlike("|".join(s.replace(".", r"\.") for s in sites))
    return (
        F.when(F.coalesce(given, F.lit("")) != "", market_region(given))
        .when(has(CN_SITES), "CN")
        .when(has(NA_SITES), "NA")
        .when(F.upper(_s(country)).isin(CN_COUNTRIES), "CN")
        .otherwise("NA")
    )


def resolve(href: Column, base: Column) -> Column:
    """An address as a page means it: absolute, of the same scheme, of the same host, or beside the page; dot segments
    at its start are followed.  Null if it isn't one of http."""


    def absolute(at: Column) -> Column:
        root = F.concat(at["scheme"], F.lit("://"), at["host"], F.coalesce(F.concat(F.lit(":"), at["port"]), F.lit("")))

        def beside(x: Column) -> Column:
            # each ../ at the start takes a folder away, three at most
            ups = F.length(F.regexp_extract(x, r"^((?:\.\./){0,3})", 1)) / 3
            folder = replace(at["path"], "[^/]*$")
            for n in (1, 2, 3):
                folder = F.when(ups >= n, replace(folder, "[^/]+/$")).otherwise(folder)
            return F.concat(root, folder, replace(x, r"^(?:\.\./){1,3}|^\./"))

        return let(
            trim(_s(href)),
            lambda x: F.when(x.rlike("(?i)^https?://"), x)
            .when(x.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
            .when(F.startswith(x, F.lit("//")), F.concat(at["scheme"], F.lit(":"), x))
            .when(F.startswith(x, F.lit("/")), F.concat(root, x))
            .when(F.startswith(x, F.lit("?")), F.concat(root, at["path"], x))
            .when((x == "") | F.startswith(x, F.lit("#")), F.concat(root, at["path"], at["query"]))
            .otherwise(beside(x)),
        )

    return clean_url(_parts(base, absolute))


def links(html: Column, base: Column | None = None) -> Column:
    """Array of structs url and text of a page's anchors, in page order, the first of each url."""
    pattern = r"""(?is)<a(?=\s)[^>]*?\shref\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all(_s(html), F.lit(pattern), F.lit(1)).alias("h"), F.regexp_extract_all(_s(html), F.lit(pattern), F.lit(2)).alias("t"))
    at = (lambda h: resolve(h, base)) if base is not None else trim
    found = F.transform(pairs, lambda p: F.struct(at(p["h"]).alias("url"), clean(replace(p["t"], "<[^>]+>", " ")).alias("text")))
    found = F.filter(found, lambda x: x["url"].isNotNull())
    return let(found, lambda f: let(F.transform(f, lambda x: x["url"]), lambda seen: F.filter(f, lambda x, i: F.array_position(seen, x["url"]) == i + 1)))


def link_role(url: Column, text: Column) -> Column:
    """What a link leads to, by its address and text."""
    blob = F.lower(F.concat_ws(" ", _s(text), _parts(url, lambda u: F.concat(u["path"], F.lit(" "), u["query"]))))
    return let(blob, lambda x: (
        F.when(x.rlike(r"apply|application|投递|网申|立即申请"), "APPLY")
        .when(x.rlike(r"(?:job|position|vacanc)[a-z]*[/_-]?(?:detail|id)|(?:jobs?|positions?)/[^/?]*\d|职位详情"), "JOB_DETAIL")
        .when(x.rlike(r"jobs|positions|vacanc|openings|职位|岗位列表"), "JOB_LIST")
        .when(x.rlike(r"campus|graduate|校招|校园招聘|宣讲"), "CAMPAIGN")
        .when(x.rlike(r"career|join-?us|recruit|talent|加入我们|人才招聘"), "CAREER_HOME")
        .otherwise("UNKNOWN")
    ))


def best_entry(apply: Column, detail: Column, listing: Column, campaign: Column, home: Column) -> Column:
    """U16: struct of role and url: the first valid of these; null if none is."""
    row = lambda role, u: let(clean_url(u), lambda c: F.when(c.isNotNull(), F.struct(F.lit(role).alias("role"), c.alias("url"))))
    return F.coalesce(row("DIRECT_APPLICATION", apply), row("JOB_DETAIL", detail), row("JOB_LIST", listing), row("CAMPAIGN_LANDING", campaign), row("CAREER_HOME", home))


def wechat_key(url: Column) -> Column:
    """The account key of a WeChat page."""

    def key(u: Column) -> Column:
        h = replace(u["host"], r"^www\.")
        biz = F.coalesce(F.nullif(_parameter(u["query"], "__biz"), F.lit("")), F.nullif(_parameter(u["query"], "biz"), F.lit("")))
        article = F.nullif(replace(replace(replace(u["path"], "/+", "/"), "^/|/$"), "^s/"), F.lit(""))
        return F.when(u.isNull(), "mp.weixin.qq.com|invalid").otherwise(F.concat(h, F.lit("|"), F.coalesce(biz, F.concat(F.lit("article:"), F.coalesce(article, F.lit("unknown"))))))

    return _parts(url, key)


def rediscovered(hrefs: Column, domain: Column) -> Column:
    """The first address whose host is the domain."""
    targets = F.transform(hrefs, search_target)
    return F.get(F.filter(targets, lambda u: host(u) == domain), F.lit(0))


def is_company_ats_host(url: Column) -> Column:
    """A host whose first label below its domain names a company."""
    whole = F.when(_s(url).contains("://"), url).otherwise(F.concat(F.lit("https://"), url))

    def labelled(h: Column) -> Column:
        below = F.length(h) - F.length(registrable_domain(h)) - 1
        label = let(below, lambda n: F.when(n > 0, F.split(F.substring(h, F.lit(1), n), r"\.")[0]))
        return F.coalesce(let(label, lambda x: (x != "") & ~x.isin("www", "app", "wecruit", "jobs", "career", "careers", "recruit")), F.lit(False))

    return let(bare_host(whole), labelled)
