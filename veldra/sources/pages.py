"""Page parsers, details and archives.  S26, S27, S28, S9, S32, K10, K11, K15."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions.text import _s, clean, decode_named_entities, replace
from veldra.functions.urls import document_url, host, host_in

_LD = re.compile(r"""<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>""", re.I | re.S)
#: Nodes of a JSON document that are walked; deeper or wider ones are never postings.
_NODES = 200_000


def _postings(value) -> Iterator[dict]:
    todo, n = [value], 0
    while todo and n < _NODES:
        x = todo.pop(0)
        n += 1
        if isinstance(x, list):
            todo[:0] = x
        elif isinstance(x, dict):
            kind = x.get("@type")
            if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
                yield x
            todo[:0] = [v for v in x.values() if isinstance(v, (dict, list))]


def _place(x) -> str:
    if isinstance(x, str):
        return x
    if isinstance(x, list):
        return " · ".join(dict.fromkeys(filter(None, map(_place, x))))
    if isinstance(x, dict):
        if "address" in x:
            return _place(x["address"])
        parts = [x.get(k) for k in ("addressLocality", "addressRegion", "addressCountry", "name")]
        return ", ".join(dict.fromkeys(p if isinstance(p, str) else p.get("name", "") for p in parts if p))
    return ""


def job_posting(html: str | None, url: str | None) -> tuple | None:
    """The first JSON-LD posting of a page."""
    for text in _LD.findall(html or ""):
        try:
            found = next(_postings(json.loads(text.strip())), None)
        except (ValueError, RecursionError):
            continue
        if found:
            org, ident = found.get("hiringOrganization") or {}, found.get("identifier")
            org = org if isinstance(org, dict) else {"name": org}
            ident = ident.get("value") if isinstance(ident, dict) else ident
            text_of = lambda k: str(found.get(k) or "")
            return (str(ident or ""), text_of("title"), str(org.get("name") or ""), _place(found.get("jobLocation") or found.get("applicantLocationRequirements")), text_of("description"), found.get("datePosted") and str(found["datePosted"]), found.get("validThrough") and str(found["validThrough"]), str(found.get("url") or url or ""))
    return None


LD = "job_id string, title string, company string, location string, description string, posted_at string, expires_at string, apply_url string"


def json_ld(html: Column, url: Column) -> Column:
    """Struct of a page's first JSON-LD posting, null if it has none.  The walk of unknown depth is a vectorised
    UDF; pages without such a script are told apart natively and never leave the JVM's side of it as more than a null."""

    def parsed(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        rows = [job_posting(p, u) or (None,) * 8 for p, u in zip(pages, urls, strict=True)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in LD.split(", ")], dtype=object)

    has = _s(html).rlike("(?i)application/ld\\+json")
    found = F.pandas_udf(parsed, LD)(F.when(has, html), url)
    return F.when(found["title"].isNotNull(), found)


def meta(html: Column, attribute: str, value: str) -> Column:
    forward = rf"""(?i)<meta[^>]+{attribute}=["']{value}["'][^>]+content=["']([^"']+)["']"""
    back = rf"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+{attribute}=["']{value}["']"""
    return F.coalesce(F.nullif(F.regexp_extract(html, forward, 1), F.lit("")), F.regexp_extract(html, back, 1))


def basic_page(html: Column) -> Column:
    """Struct of title, company and summary by meta elements, heading and title."""
    part = lambda tag: clean(decode_named_entities(replace(F.regexp_extract(html, rf"(?is)<{tag}(?![A-Za-z0-9_])[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", " ")))
    first = lambda *xs: F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))
    return F.struct(first(meta(html, "property", "og:title"), part("h1"), part("title")).alias("title"), first(meta(html, "property", "og:site_name"), meta(html, "name", "application-name")).alias("company"), first(meta(html, "property", "og:description"), meta(html, "name", "description")).alias("summary"))


def page_provider(url: Column) -> Column:
    """S27"""
    h = host(url)
    return F.when(host_in(h, ["jobs.feishu.cn", "feishu.cn"]), "feishu").when(host_in(h, ["hotjob.cn"]), "hotjob").when(host_in(h, ["mokahr.com"]), "moka").when(host_in(h, ["teamtailor.com"]), "teamtailor").when(host_in(h, ["zhiye.com"]), "zhiye").otherwise("generic-jsonld")


#: Detail pages of applicant tracking systems: pattern of the address -> address of the interface.
DETAILS = {
    "ashby": (r"^https?://jobs\.ashbyhq\.com/([^/]+)/([0-9a-f-]{36})", "https://api.ashbyhq.com/posting-api/job-board/$1"),
    "greenhouse": (r"^https?://(?:job-)?boards\.greenhouse\.io/([^/]+)/jobs/(\d+)", "https://boards-api.greenhouse.io/v1/boards/$1/jobs/$2"),
    "lever": (r"^https?://jobs\.lever\.co/([^/]+)/([0-9a-f-]{36})", "https://api.lever.co/v0/postings/$1/$2"),
    "smartrecruiters": (r"^https?://jobs\.smartrecruiters\.com/([^/]+)/(\d+)", "https://api.smartrecruiters.com/v1/companies/$1/postings/$2"),
    "workday": (r"^(https?://([^./]+)\.wd\d+\.myworkdayjobs\.com)/(?:[a-z]{2}-[A-Z]{2}/)?([^/]+)(/job/.+)$", "$1/wday/cxs/$2/$3$4"),
}


def detail_api(url: Column) -> Column:
    """Struct of provider and api of a posting's address; null if it is none that is known."""
    out = F.lit(None).cast("struct<provider:string,api:string>")
    for name, (pattern, api) in reversed(DETAILS.items()):
        out = F.when(_s(url).rlike(pattern), F.struct(F.lit(name).alias("provider"), F.regexp_replace(F.regexp_extract(url, pattern, 0), pattern, api).alias("api"))).otherwise(out)
    return out


def humanize_slug(x: Column) -> Column:
    """K11"""
    return F.initcap(clean(replace(x, "[-_]+", " ")))


def source_documents(pages: DataFrame) -> DataFrame:
    """Pages (url, content, fetched_at) with id, canonical_url, year and month, for a partitioned archive."""
    return pages.select(F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 32).alias("id"), document_url(F.col("url")).alias("canonical_url"), "url", "content", "fetched_at", F.date_format("fetched_at", "yyyy").alias("year"), F.date_format("fetched_at", "MM").alias("month"))


def archive(pages: DataFrame, path: str) -> None:
    """Documents that the archive lacks are appended below their year and month."""
    source_documents(pages).dropDuplicates(["id"]).write.partitionBy("year", "month").mode("append").parquet(path)


def openings(pages: DataFrame, portals: DataFrame) -> DataFrame:
    """Openings of the pages (portal, url, jobs array of structs) of verified portals."""
    good = portals.where("verificationStatus = 'VERIFIED'").select(F.col("id").alias("portal"))
    return pages.join(good, "portal", "left_semi").select("portal", "url", F.explode("jobs").alias("j")).select("portal", "url", "j.*")
