"""Queries of functions over inputs that are made from the tables' columns, with SQL that states each rule anew.

An input is an expression of both dialects; Spark applies the library's function to it, the SQL its own statement of the
rule, as far as the inputs reach into it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.functions import classify, dates, rules, text, urls, values
from veldra.operators import builders, filters, governance, resolve
from veldra.plans.queries import ORACLE, QUERIES, spread, table
from veldra.sources import files


@dataclass(frozen=True)
class Rule:
    """``inputs`` are named {0}, {1} ... in ``sql``; results are compared as text.  ``native`` holds those inputs, by
    place, that Spark must write in another way to mean the same."""

    inputs: list[str]
    build: Callable[..., Column]
    sql: str
    native: dict[int, str] = field(default_factory=dict)


def _sql(name: str, key: str, rules: dict[str, Rule]) -> str:
    inputs = [f"({x}) AS i_{n}_{k}" for n, r in rules.items() for k, x in enumerate(r.inputs)]
    results = [f"({r.sql.format(*(f'i_{n}_{k}' for k in range(len(r.inputs))))})::VARCHAR AS {n}" for n, r in rules.items()]
    return f"WITH i AS (SELECT {key}, {', '.join(inputs)} FROM {name}) SELECT {key}, {', '.join(results)} FROM i"


def rules_query(query: str, ids: str, name: str, key: str, rules: dict[str, Rule]) -> None:
    """Register a query that applies all rules to every row of a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spread(table(spark, sf_dir, name), key)
        inputs = rows.select(key, *(F.expr(r.native.get(k, x)).alias(f"i_{n}_{k}") for n, r in rules.items() for k, x in enumerate(r.inputs)))
        return inputs.select(key, *(r.build(*(F.col(f"i_{n}_{k}") for k in range(len(r.inputs)))).cast("string").alias(n) for n, r in rules.items()))

    run.__name__, run.__doc__ = query, ids
    QUERIES[query], ORACLE[query] = run, _sql(name, key, rules)


def _planner(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{{{L}}}}\\p{{{{N}}}}+#.\\-]+', ' ', 'g'))"


def _sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _clean(x: str) -> str:
    return f"trim({_sub(x, chr(92) + 's+', ' ')})"


def _twice(pattern: str) -> str:
    """A pattern's braces, for ``str.format``."""
    return pattern.replace("{", "{{").replace("}", "}}")


_LETTERS = _twice(r"[^\p{L}\p{N}]+")
_S = "CAST({} AS STRING)".format
_SECTION = "'Intro' || chr(10) || CASE WHEN p_size % 5 = 0 THEN 'About us' ELSE 'Responsibilities:' END || chr(10) || '- Build ' || p_name || chr(10) || '* Ship ' || p_type || chr(10) || CASE p_size % 3 WHEN 0 THEN 'Requirements' WHEN 1 THEN 'Benefits and pay' ELSE 'Requirements:' END || chr(10) || 'Python ' || p_brand"


def _section_sql(starts: list[str]) -> str:
    lines = "list_filter(list_transform(string_split({0}, chr(10)), lambda y: trim(y)), lambda y: y <> '')"
    heads = "|".join(starts).replace("'", "''")
    at = f"list_position(list_transform({lines}, lambda y: regexp_matches({_planner('y')}, '^(?:{heads})')), true)"
    below = f"({lines})[{at} + 1:]"
    stop = f"list_position(list_transform({below}, lambda y: regexp_matches({_planner(_sub('y', ':$'))}, '^(?:{'|'.join(text.SECTION_STOPS)})(?: |$)')), true)"
    body = f"({below})[1:CASE WHEN coalesce({stop}, 0) > 0 THEN {stop} - 1 ELSE 100 END]"
    return f"CASE WHEN coalesce({at}, 0) = 0 THEN '' ELSE array_to_string(list_transform({body}, lambda y: regexp_replace(y, '^[-*•]\\s*', '')), ' ') END"


_SKILL = lambda key: "(?:^|[^\\p{{L}}\\p{{N}}+#])" + re.sub(r"([.+/])", r"\\\1", key) + "(?:$|[^\\p{{L}}\\p{{N}}+#])"
_SKILLS = "(SELECT concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(x, '{_SKILL(text._planner_text(s))}') THEN '{s}' END" for s in text.SKILLS) + f") FROM (SELECT {_planner('{0}')} AS x))"
_FLAT = f"trim({_sub(_sub('{0}', r'[\r\n\t]+', ' '), ' {{2,}}', ' ')})"

TEXT_RULES = {
    "title_key": Rule(["'Senior ' || p_name || CASE p_size % 4 WHEN 0 THEN ' Engineer II' WHEN 1 THEN ' (New Grad)' WHEN 2 THEN ' Jr. 2' ELSE ' C++ Entry Level' END"], text.title_key, f"trim({_sub(_sub(_sub(_planner('{0}'), _twice(r'\b(?:sr|senior|jr|junior|i{1,3}|1|2|3)\b'), ' '), r'\b(?:new grad|graduate|early career|entry level)\b', ' '), _twice(r'[^\p{L}\p{N}+#]+'), ' ')})"),
    "clean_company_name": Rule(["p_brand || CASE p_size % 5 WHEN 0 THEN '2026届校招' WHEN 1 THEN ' 暑期实习  机械类' WHEN 2 THEN '26届' WHEN 3 THEN '秋招 岗位' ELSE ' 工业' END"], text.clean_company_name, f"trim(regexp_replace({_sub(_clean('{0}'), _twice(r'(?:20\d{2}|\d{2})届(?:校招|秋招|春招|实习)?|暑期实习|日常实习|校园招聘|校招|秋招|春招|提前批|补录|预告|剩余岗位'))}, '\\s*(?:机械类|电气类|岗位)$', ''))"),
    "platform_identity": Rule(["p_name || CASE p_size % 4 WHEN 0 THEN ' 招聘 | BOSS直聘' WHEN 1 THEN ' Careers' WHEN 2 THEN '-jobs | 猎聘' ELSE '公司招聘职位' END"], text.platform_identity, _sub(_sub("lower({0})", "招聘职位|招聘岗位|招聘信息|正在招聘|最新招聘|社会招聘|校园招聘|公司招聘|招聘|职位|岗位|careers?|jobs?|hiring|liepin|猎聘|boss直聘|boss"), _LETTERS)),
    "same_identity": Rule(["p_name || ' Careers'", "CASE WHEN p_size % 2 = 0 THEN upper(p_name) || ' 招聘' ELSE p_type END"], text.same_identity, f"{_sub(_sub('lower({0})', 'careers?|招聘'), _LETTERS)} = {_sub(_sub('lower({1})', 'careers?|招聘'), _LETTERS)}"),
    "agency_key": Rule(["p_brand || '-' || p_type || ' 中！' || p_name"], text.agency_key, _sub("lower({0})", _LETTERS)),
    "brand_query": Rule(["CASE WHEN p_size % 3 = 0 THEN '华为 技术' ELSE p_type || ' ' || p_name || ' (Co) 技术' END || CASE WHEN p_size % 2 = 0 THEN '-X' ELSE '' END"], lambda c: text.brand_tokens(c)["query"], "CASE WHEN len(list_filter(string_split_regex(trim({0}), '[\\s\\-·‧()]+'), lambda t: regexp_full_match(t, '[A-Za-z][A-Za-z0-9_.\\-]+'))) > 0 THEN '\"' || array_to_string(list_transform(list_filter(string_split_regex(trim({0}), '[\\s\\-·‧()]+'), lambda t: regexp_full_match(t, '[A-Za-z][A-Za-z0-9_.\\-]+')), lambda t: lower(t)), ' ') || '\"' ELSE regexp_replace({0}, '\\s+', '', 'g') END"),
    "skills": Rule(["'We use ' || CASE p_size % 6 WHEN 0 THEN 'Go, C++ and node.js; Golang' WHEN 1 THEN 'Python/SQL, R&D' WHEN 2 THEN 'Machine Learning (PyTorch) CI/CD' WHEN 3 THEN 'C# .NET' WHEN 4 THEN 'react native, React' ELSE p_name END || ' REST ' || p_type"], lambda c: F.array_join(text.skills(c), ","), _SKILLS),
    "responsibilities": Rule([_SECTION], lambda c: text.section(c, text.RESPONSIBILITIES), _section_sql(text.RESPONSIBILITIES)),
    "requirements": Rule([_SECTION], text.requirements, f"substr({_section_sql(text.REQUIREMENTS)}, 1, 1200)"),
    "specific_location": Rule([f"CASE WHEN p_size % 7 = 0 THEN '' ELSE 'City ' || {_S('p_size % 5')} END", f"CASE WHEN p_size % 6 = 0 THEN '' ELSE 'City ' || {_S('p_size % 3')} || ', ' || p_type END"], text.specific_location, f"CASE WHEN {{0}} = '' THEN {{1}} WHEN {{1}} = '' THEN {{0}} WHEN starts_with({_planner('{1}')}, {_planner('{0}')}) AND length({_planner('{1}')}) > length({_planner('{0}')}) THEN {{1}} ELSE {{0}} END"),
    "markdown_field": Rule(["p_name || '|[' || p_brand || ']' || chr(10) || chr(9) || '  x' || chr(92) || 'y '"], text.markdown_field, f"replace({_sub(_FLAT, r'([\\\[\]])', r'\\\1')}, '|', '/')"),
    "tsv_field": Rule(["CASE p_size % 5 WHEN 0 THEN '=' WHEN 1 THEN ' -' WHEN 2 THEN '@' ELSE '' END || p_name || chr(9) || p_brand"], text.tsv_field, f"CASE WHEN regexp_matches({_FLAT}, '^[=+\\-@]') THEN '''' ELSE '' END || {_FLAT}"),
    "fold_locations": Rule([f"'City ' || {_S('p_size % 3')}", f"'City ' || {_S('p_size % 2')}", "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END"], lambda a, b, c: text.fold_locations(a, F.array(F.struct(b.alias("location"), F.lit(" ").alias("locality"), c.alias("country")))), "concat_ws(' · ', {0}, CASE WHEN {1} <> {0} THEN {1} END, {2})"),
    "thread_comment": Rule([f"p_brand || ' | ' || p_name || ' | City ' || {_S('p_size')} || ' https://x.example.com/<p>see <a href=\"https://jobs.example.com/' || {_S('p_partkey')} || '.\">it</a> &amp; more'"], lambda c: text.let(text.thread_comment(c, F.lit("https://t/1")), lambda x: F.concat_ws("~", x["title"], x["url"], x["company"], x["location"])), "trim(regexp_replace(split_part({0}, '<p>', 1), 'https?://[^\\s]+', '', 'g')) || '~' || regexp_extract({0}, '(https?://[^\\s<>\"]+)', 1) || '~' || trim(split_part({0}, '|', 1)) || '~' || trim(regexp_replace(split_part(split_part({0}, '<p>', 1), '|', 3), 'https?://[^\\s]+', '', 'g'))"),
    "redact": Rule(["'fetch ' || p_name || CASE p_size % 4 WHEN 0 THEN ' Bearer ' || p_brand WHEN 1 THEN ', api_key=' || p_type || ', ok' WHEN 2 THEN ' Token: ' || p_name ELSE '' END || repeat('x', p_size * 8)"], text.redact, f"substr({_sub('{0}', _twice(r'(?i)(?:authorization|bearer|api[_-]?key|token)\s*[:=]?\s*[^\s,;]+'), '[REDACTED]')}, 1, 240)"),
    "bounded_error": Rule(["CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN NULL ELSE repeat(p_name, p_size) END"], text.bounded_error, "substr(coalesce(nullif({0}, ''), 'unknown error'), 1, 240)"),
    "slugs": Rule(["p_name || CASE WHEN p_size % 2 = 0 THEN '! ' || p_type ELSE '' END"], lambda c: F.array_join(text.slug_candidates(c), ","), "(SELECT concat_ws(',', a, replace(w, ' ', '-'), replace(w, ' ', '_'), h, a || 'ai', a || 'tech', a || 'io', a || 'hq', a || 'labs', a || '.tech', a || '.io', h || 'ai', h || 'tech', h || 'io', h || 'hq', h || 'labs', h || '.tech', h || '.io') FROM (SELECT w, replace(w, ' ', '') AS a, split_part(w, ' ', 1) AS h FROM (SELECT trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')) AS w)))"),
    "fetch_error_class": Rule(["CASE p_size % 7 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 500 + p_size WHEN 3 THEN 200 WHEN 4 THEN 410 END", f"CASE p_partkey % 5 WHEN 0 THEN 'fetch failed' WHEN 1 THEN 'HTTP 40' || {_S('p_size % 5')} WHEN 2 THEN 'HTTP 5' || {_S('10 + p_size')} WHEN 3 THEN p_name END"], lambda s, m: text.fetch_error_class(s.cast("int"), m, F.lit(None).cast("string")), "CASE WHEN {0} IS NULL AND {1} IS NULL THEN 'unknown' WHEN {1} = 'fetch failed' THEN 'network' WHEN {0} IN (404, 410) THEN 'slug_gone' WHEN {0} IN (401, 403) THEN 'auth' WHEN {0} >= 500 THEN 'server' WHEN {1} LIKE '%HTTP 404%' OR {1} LIKE '%HTTP 410%' THEN 'slug_gone' WHEN {1} LIKE '%HTTP 401%' OR {1} LIKE '%HTTP 403%' THEN 'auth' WHEN regexp_matches({1}, 'HTTP 5\\d\\d') THEN 'server' ELSE 'unknown' END"),
    "company_hint": Rule(["CASE WHEN p_size % 6 = 0 THEN ' Firm ' || p_brand ELSE '' END", "CASE p_size % 4 WHEN 0 THEN p_brand || ' Careers - ' || p_name WHEN 1 THEN p_name || '校园招聘' WHEN 2 THEN p_type || ' Jobs: ' || p_name ELSE p_name END"], text.company_hint, f"coalesce(nullif({_clean('{0}')}, ''), trim(regexp_extract({_clean('{1}')}, '{_twice('^(.{2,80}?)(?:招聘官网|招聘职位|校园招聘|社会招聘|招聘|Careers|Jobs)(?:' + chr(92) + 's|[-–—:：|｜]|$)')}', 1)))"),
    "infer_company": Rule(["CASE p_size % 4 WHEN 0 THEN '招聘 - ' || p_type || '技术有限公司' WHEN 1 THEN '前端工程师 | 字节' || p_type WHEN 2 THEN p_name ELSE 'BOSS直聘_' || p_type || '银行' END", "CASE WHEN p_size % 8 = 2 THEN p_type || '大药房集团' ELSE '' END"], text.infer_company, f"CASE WHEN regexp_matches({{0}} || {{1}}, '有限公司|银行|集团') THEN trim(regexp_extract({_sub(_sub('{0} || chr(32) || {1}', '实习僧|应届生求职网|BOSS直聘|智联招聘|国家大学生就业服务平台', ' '), '[｜|_—–]+', ' ')}, '{_twice(r'([㐀-鿿A-Za-z0-9·（）()\-]{2,40}(?:股份有限公司|有限责任公司|有限公司|集团|银行|证券|研究院|研究所|事务所|学校|医院))')}', 1)) ELSE coalesce(trim(list_filter(string_split_regex({{0}}, '[-｜|_—–]'), lambda y: regexp_matches(y, '[㐀-鿿]') AND NOT regexp_matches(y, '招聘|校招|实习|岗位|职位|工程师|求职'))[1]), '') END"),
}
rules_query("text_functions", "P5, P9, P10, P17, P20, P21, P22, P23, P24, P27, P28, P29, P30, P31", "part", "p_partkey", TEXT_RULES)


_HOST = "lower(regexp_extract({0}, '^[a-z]+://([^/?#]+)', 1))"
_LABEL = "'x' || CAST(page_id % 50 AS STRING)"


def _kept(drop: str) -> str:
    """A page's address without fragment and without parameters that match."""
    q = f"list_filter(string_split(regexp_extract({{0}}, '^[^#?]*\\?([^#]*)', 1), '&'), lambda y: y <> '' AND NOT regexp_matches(y, '^(?i:{drop})(=|$)'))"
    return f"CASE WHEN len({q}) > 0 THEN '?' || array_to_string({q}, '&') ELSE '' END"


_PATH = "CASE regexp_extract({0}, '^[a-z]+://[^/?#]+([^?#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract({0}, '^[a-z]+://[^/?#]+([^?#]*)', 1) END"
_SCHEME = "regexp_extract({0}, '^([a-z]+)://', 1)"
_OCTET = lambda i: f"CASE WHEN regexp_full_match({{0}}, '{_twice(chr(92) + 'd{1,3}(' + chr(92) + '.' + chr(92) + 'd{1,3}){3}')}') THEN split_part({{0}}, '.', {i})::INTEGER END"
_ADDRESS = f"CASE page_id % 8 WHEN 0 THEN '10.' || {_S('page_id % 256')} || '.1.2' WHEN 1 THEN '172.' || {_S('page_id % 40')} || '.0.1' WHEN 2 THEN '100.' || {_S('page_id % 140')} || '.3.4' WHEN 3 THEN {_S('page_id % 256')} || '.254.0.9' WHEN 4 THEN '192.168.0.' || {_S('page_id % 99')} WHEN 5 THEN 'db.internal' WHEN 6 THEN '198.' || {_S('page_id % 24')} || '.7.7' ELSE 'host' || {_S('page_id')} || '.example.org' END"
_PRIVATE = f"({{0}} LIKE '%.internal' OR coalesce({_OCTET(1)} IN (0, 10, 127) OR {_OCTET(1)} >= 224 OR ({_OCTET(1)} = 100 AND {_OCTET(2)} BETWEEN 64 AND 127) OR ({_OCTET(1)} = 169 AND {_OCTET(2)} = 254) OR ({_OCTET(1)} = 172 AND {_OCTET(2)} BETWEEN 16 AND 31) OR ({_OCTET(1)} = 192 AND {_OCTET(2)} = 168) OR ({_OCTET(1)} = 198 AND {_OCTET(2)} IN (18, 19)), false))"
_VENDOR = f"'https://' || {_LABEL} || CASE page_id % 7 WHEN 0 THEN '.mokahr.com/x' WHEN 1 THEN '.greenhouse.io' WHEN 2 THEN '.zhaopin.com/' WHEN 3 THEN '.example.com' WHEN 4 THEN '.wd3.myworkdayjobs.com/y' WHEN 5 THEN '.indeed.com' ELSE '.jobs.lever.co' END"

URL_RULES = {
    "document_url": Rule(["url || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '?spm=1&id=' || CAST(page_id AS STRING) ELSE '&share=2' END"], urls.document_url, f"{_SCHEME} || '://' || {_HOST} || {_PATH} || {_kept('utm_[^=]*|spm|from|source|share|timestamp')}"),
    "governed_url": Rule(["url || CASE WHEN page_id % 4 = 0 THEN '/' WHEN page_id % 4 = 1 AND url NOT LIKE '%?%' AND url NOT LIKE '%#%' THEN '.png' ELSE '' END"], lambda c: F.concat_ws("~", urls.governed_url(c)["canonicalUrl"], urls.governed_url(c)["reason"]), f"CASE WHEN regexp_matches({_PATH}, '\\.png$') THEN '~static_asset' ELSE {_SCHEME} || '://' || {_HOST} || CASE WHEN length({_PATH}) > 1 THEN regexp_replace({_PATH}, '/+$', '') ELSE {_PATH} END || {_kept('utm_[^=]*|spm|from|source|ref')} || '~' END"),
    "is_private_host": Rule([_ADDRESS], urls.is_private_host, _PRIVATE),
    "public_target": Rule([_ADDRESS, "CASE WHEN page_id % 3 = 0 THEN ':8443' ELSE '' END"], lambda h, p: urls.public_target(F.concat(F.lit("https://"), h, p, F.lit("/")))["reasonCode"], f"CASE WHEN {{0}} LIKE '%.internal' THEN 'local_hostname' WHEN {{1}} <> '' THEN 'non_standard_port' WHEN {_PRIVATE} THEN 'private_ip' END"),
    "ats": Rule([_VENDOR], urls.ats, f"CASE WHEN {_HOST} LIKE '%.mokahr.com' THEN 'moka' WHEN {_HOST} LIKE '%.myworkdayjobs.com' THEN 'workday' WHEN {_HOST} LIKE '%.greenhouse.io' THEN 'greenhouse' WHEN {_HOST} LIKE '%.zhaopin.com' THEN 'zhaopin_campaign' WHEN {_HOST} LIKE '%.jobs.lever.co' THEN 'lever' END"),
    "source": Rule([_VENDOR], lambda c: F.concat_ws("~", urls.source(c)["source"], urls.source(c)["sourceType"]), f"CASE WHEN {_HOST} LIKE '%indeed.com' THEN 'Indeed~discovery' WHEN {_HOST} LIKE '%greenhouse.io' THEN 'Greenhouse~official_ats' WHEN {_HOST} LIKE '%lever.co' THEN 'Lever~official_ats' WHEN {_HOST} LIKE '%myworkdayjobs.com%' THEN 'Workday~official_ats' ELSE {_HOST} || '~company_site' END"),
    "market_region": Rule(["CASE page_id % 5 WHEN 0 THEN ' China' WHEN 1 THEN 'cn' WHEN 2 THEN 'us' WHEN 3 THEN 'Canada' ELSE substr(url, 1, 9) END"], urls.market_region, "CASE WHEN upper(trim({0})) IN ('CN', 'CHINA') THEN 'CN' ELSE 'NA' END"),
    "market": Rule(["CASE page_id % 6 WHEN 0 THEN ' China' WHEN 1 THEN 'cn' WHEN 2 THEN 'us' WHEN 3 THEN 'Canada' WHEN 4 THEN '中国' ELSE substr(url, 1, 9) END"], urls.market, "CASE WHEN upper(trim({0})) IN ('CN', 'CHINA', '中国') THEN 'CN' WHEN upper(trim({0})) IN ('US', 'CANADA') THEN 'NA' END"),
    "best_entry": Rule(["CASE WHEN page_id % 3 = 0 THEN url ELSE 'x' END", "CASE WHEN page_id % 2 = 0 THEN url END", "'HTTPS://L.example.com/' || CAST(page_id AS STRING)"], lambda a, b, c: (lambda e: F.concat_ws(" ", e["role"], e["url"]))(urls.best_entry(a, b, c, F.lit(None).cast("string"), F.lit(None).cast("string"))), "CASE WHEN {0} <> 'x' THEN 'DIRECT_APPLICATION ' WHEN {1} IS NOT NULL THEN 'JOB_DETAIL ' ELSE 'JOB_LIST ' END || regexp_replace(CASE WHEN {0} <> 'x' THEN {0} WHEN {1} IS NOT NULL THEN {1} ELSE replace({2}, 'HTTPS://L', 'https://l') END, '#.*$', '')"),
    "wechat_key": Rule(["'https://' || CASE WHEN page_id % 2 = 0 THEN 'www.' ELSE '' END || 'mp.weixin.qq.com/s' || CASE page_id % 3 WHEN 0 THEN '?__biz=B' || CAST(page_id AS STRING) || '&x=1' WHEN 1 THEN '/art' || CAST(page_id AS STRING) ELSE '?biz=C' || CAST(page_id % 9 AS STRING) END"], urls.wechat_key, "'mp.weixin.qq.com|' || CASE WHEN regexp_matches({0}, '[?&](__)?biz=') THEN regexp_extract({0}, '[?&](?:__)?biz=([^&#]*)', 1) ELSE 'article:' || regexp_extract({0}, '/s/([^/?#]+)', 1) END"),
    "rediscovered": Rule(["'https://other.example.com/' || CAST(page_id AS STRING) || ' ' || url || ' http://last.example.com/'", "CASE WHEN page_id % 3 = 0 THEN 'last.example.com' ELSE lower(substring_index(substring_index(substring_index(url, '/', 3), '/', -1), '?', 1)) END"], lambda h, d: F.regexp_replace(urls.rediscovered(F.split(h, " "), d), "[?#].*$", ""), "CASE WHEN {1} = 'last.example.com' THEN 'http://last.example.com/' ELSE regexp_replace(split_part({0}, ' ', 2), '[?#].*$', '') END"),
    "is_company_ats_host": Rule([f"CASE page_id % 4 WHEN 0 THEN 'https://app.mokahr.com/x' WHEN 1 THEN 'www.mokahr.com' WHEN 2 THEN 'https://' || {_LABEL} || '.mokahr.com' ELSE 'mokahr.com' END"], urls.is_company_ats_host, "regexp_matches({0}, 'x[0-9]+\\.mokahr')"),
    "is_static_asset": Rule(["url || CASE page_id % 4 WHEN 0 THEN '.css?x' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.pdfx' ELSE '' END"], urls.is_static_asset, "regexp_matches(lower({0}), '\\.(css|jpeg)($|[?#])')"),
    "robots_disallow": Rule(["url"], lambda u: urls.robots_disallow(u, ["/en/", "", "/fr/4"]), f"regexp_matches({_PATH}, '^/(en/|fr/4)')"),
}
# what both dialects have no common function for is written for each
_SPLIT = "substring_index(substring_index(substring_index(url, '/', 3), '/', -1), '?', 1)"
rules_query("url_functions", "U3, U4, U9, U10, U11, U13, U16, U17, U18, U19, U20", "pages", "page_id", URL_RULES)
ORACLE["url_functions"] = ORACLE["url_functions"].replace(f"lower({_SPLIT})", "lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))")


_N = "o_orderkey % 9 + 1"
_DAY = f"{_S('2001 + o_orderkey % 24')} || '{{a}}' || {_S('1 + o_orderkey % 12')} || '{{b}}' || {_S('1 + o_custkey % 28')} || '{{c}}'"


def _day(a: str, b: str, c: str) -> str:
    return _DAY.format(a=a, b=b, c=c)


_YMD = lambda x, g: f"regexp_extract({x}, '(\\d+)[年./-](\\d+)[月./-](\\d+)', {g})::INTEGER"
_DATE = lambda x: f"make_date({_YMD(x, 1)}, {_YMD(x, 2)}, {_YMD(x, 3)})"
_YEARS = f"CASE o_orderkey % 7 WHEN 0 THEN {_S(_N)} || '-' || {_S('o_orderkey % 9 + 3')} || ' years of experience' WHEN 1 THEN 'at least ' || {_S(_N)} || ' years' WHEN 2 THEN {_S(_N)} || '+ yrs' WHEN 3 THEN 'founded ' || {_S(_N)} || ' years ago' WHEN 4 THEN 'No prior experience' WHEN 5 THEN 'Needs ' || {_S(_N)} || ' years professional experience' ELSE o_orderpriority END"
_CN_YEARS = f"CASE o_orderkey % 6 WHEN 0 THEN {_S(_N)} || '-' || {_S('o_orderkey % 9 + 3')} || '年' WHEN 1 THEN {_S(_N)} || '年以上经验' WHEN 2 THEN '不超过' || {_S(_N)} || '年' WHEN 3 THEN '应届' WHEN 4 THEN {_S(_N)} || '年经验' ELSE o_orderpriority END"
_span = lambda x: F.concat(F.coalesce(x["minYears"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(x["maxYears"].cast("string"), F.lit("")))
_NUMBER = "regexp_extract({0}, '(\\d+)', 1)"
_plain = lambda day: F.regexp_replace(day.cast("string"), r"^\+", "")  # noqa: E731  years of five digits come without a sign in SQL

DATE_RULES = {
    "epoch_date": Rule(["CASE WHEN o_orderkey % 2 = 0 THEN 1600000000 + o_orderkey * 86400 ELSE (1600000000 + o_orderkey * 86400) * 1000 END"], lambda n: _plain(dates.epoch_date(n.cast("double"))), "strftime(make_timestamp(CASE WHEN {0} < 10000000000 THEN {0} * 1000000 ELSE {0} * 1000 END::BIGINT), '%Y-%m-%d')"),
    "instant": Rule(["CASE WHEN o_orderkey % 3 = 0 THEN 1600000000 + o_orderkey * 61 END", "CASE WHEN o_orderkey % 3 = 1 THEN " + f"{_S('2001 + o_orderkey % 24')} || '-0' || {_S(_N)} || '-1' || {_S('o_custkey % 10')}" + " END"], lambda n, t: F.date_format(dates.instant(n, t), "yyyy-MM-dd HH:mm:ss"), "CASE WHEN {0} IS NOT NULL THEN strftime(make_timestamp({0}::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') WHEN {1} IS NOT NULL THEN {1} || ' 00:00:00' END"),
    "cn_date": Rule([f"CASE o_orderkey % 4 WHEN 0 THEN {_day('年', '月', '日')} WHEN 1 THEN {_day('.', '.', '')} WHEN 2 THEN {_day('/', '/', '')} ELSE o_orderpriority END"], dates.cn_date, f"CASE WHEN regexp_matches({{0}}, '\\d+[年./-]\\d+') THEN epoch_ms({_DATE('{0}')}::TIMESTAMP) END"),
    "event_dates": Rule([f"'报名' || {_day('年', '月', '日')} || CASE WHEN o_orderkey % 3 = 0 THEN '开始' ELSE '见面' END || '；' || {_day('-', '-', '').replace('2001 +', '2002 +')} || CASE WHEN o_orderkey % 2 = 0 THEN '截止' ELSE '结果' END", f"CASE WHEN o_orderkey % 5 = 0 THEN {_S('2001 + o_orderkey % 24')} || '-05-1' || {_S('o_custkey % 10')} END"], lambda t, a: (lambda e: F.concat_ws("~", F.coalesce(e["startAt"].cast("string"), F.lit("")), F.coalesce(e["closesAt"].cast("string"), F.lit(""))))(dates.event_dates(t, a, F.lit(None).cast("string"))), f"coalesce({{1}}, CASE WHEN {{0}} LIKE '%开始%' THEN strftime({_DATE('{0}')}, '%Y-%m-%d') END, '') || '~' || CASE WHEN {{0}} LIKE '%截止' THEN strftime({_DATE(chr(115) + 'plit_part({0}, ' + chr(39) + '；' + chr(39) + ', 2)')}, '%Y-%m-%d') ELSE '' END"),
    "range_days": Rule([f"CASE o_orderkey % 8 WHEN 0 THEN {_S(_N)} || ' Weeks' WHEN 1 THEN {_S(_N)} || '个月' WHEN 2 THEN {_S(_N)} || 'd' WHEN 3 THEN {_S(_N)} WHEN 4 THEN {_S(_N)} || '年' WHEN 5 THEN {_S(_N)} || 'w' WHEN 6 THEN 'last ' || {_S(_N)} || ' months' ELSE 'always' END"], lambda s: dates.range_days(s, 90), f"CASE WHEN NOT regexp_matches({{0}}, '\\d') THEN 90 ELSE {_NUMBER}::INTEGER * CASE WHEN regexp_matches(lower({{0}}), 'month|月') THEN 30 WHEN regexp_matches(lower({{0}}), 'week|\\dw$') THEN 7 WHEN {{0}} LIKE '%年' THEN 365 ELSE 1 END END"),
    "search_window": Rule(["CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE CAST(o_orderkey % 400 - 50 AS STRING) END"], lambda c: dates.search_window(c).cast("int"), "CASE WHEN {0} = 'x' THEN 90 ELSE greatest(1, least(180, {0}::INTEGER)) END"),
    "experience": Rule([_YEARS], lambda c: _span(dates.experience(c)), f"CASE WHEN {{0}} LIKE 'No prior%' THEN '0:0' WHEN {{0}} LIKE '%ago' OR NOT regexp_matches({{0}}, 'years|yrs') THEN ':' WHEN regexp_matches({{0}}, '^\\d+-\\d+ ') THEN regexp_extract({{0}}, '^(\\d+)-', 1) || ':' || regexp_extract({{0}}, '-(\\d+) ', 1) ELSE {_NUMBER} || ':' END"),
    "cn_experience": Rule([_CN_YEARS], lambda c: _span(dates.cn_experience(c)), f"CASE WHEN {{0}} = '应届' THEN '0:0' WHEN {{0}} NOT LIKE '%年%' THEN ':' WHEN {{0}} LIKE '不超过%' THEN ':' || {_NUMBER} WHEN {{0}} LIKE '%-%' THEN {_NUMBER} || ':' || regexp_extract({{0}}, '-(\\d+)年', 1) ELSE {_NUMBER} || ':' END"),
    "education": Rule(["CASE o_orderkey % 6 WHEN 0 THEN '硕士及以上' WHEN 1 THEN '本科或大专' WHEN 2 THEN '博士、硕士' WHEN 3 THEN '大专' WHEN 4 THEN '不限学历' ELSE o_orderpriority END"], dates.education, "CASE WHEN {0} LIKE '%博士%' THEN 'phd' WHEN {0} LIKE '%硕士%' THEN 'master' WHEN {0} LIKE '%本科%' THEN 'bachelor' WHEN {0} LIKE '%大专%' THEN 'associate' WHEN {0} LIKE '不限学历' THEN 'any' ELSE '' END"),
    "canonical_hash": Rule(["o_orderpriority", "'é' || o_orderstatus"], lambda a, b: dates.canonical_hash(F.struct(a.alias("a"), b.alias("b"))), "sha256('{{\"a\":\"' || {0} || '\",\"b\":\"' || {1} || '\"}}')"),
    "decode_list": Rule(["CASE o_orderkey % 3 WHEN 0 THEN '[\"' || o_orderpriority || '\", \"' || o_orderstatus || '\"]' WHEN 1 THEN 'broken ' || o_orderstatus END"], lambda c: F.array_join(values.decode_list(c), ","), "CASE WHEN json_valid({0}) THEN ({0}::JSON ->> 0) || ',' || ({0}::JSON ->> 1) ELSE '' END"),
    "company_type": Rule(["' ' || o_orderpriority", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 11 / 10.0 END"], lambda a, b: values.company_type(a, b.cast("double")), "CASE WHEN {1} >= 0.8 THEN trim({0}) ELSE '' END"),
    "union_evidence": Rule(["o_orderstatus || ' ' || o_orderpriority", "o_orderpriority || ' z'"], lambda a, b: F.array_join(values.union_evidence(F.split(a, " "), F.split(b, " ")), ","), "replace({0}, ' ', ',') || ',z'"),
    "matched_keywords": Rule(["CASE o_orderkey % 4 WHEN 0 THEN 'AI Lead ' WHEN 1 THEN 'Maid lead' WHEN 2 THEN 'ai' ELSE '' END || o_orderpriority"], lambda t: F.array_join(filters.matched_keywords(t, ["AI", "Lead", "", "High"]), ","), "concat_ws(',', CASE WHEN regexp_matches(lower({0}), '\\bai\\b') THEN 'AI' END, CASE WHEN lower({0}) LIKE '%lead%' THEN 'Lead' END, CASE WHEN lower({0}) LIKE '%high%' THEN 'High' END)"),
    "content_filter": Rule(["CASE o_orderkey % 4 WHEN 0 THEN 'python here' WHEN 1 THEN 'php here' WHEN 2 THEN '' ELSE 'go ' || o_orderstatus END", "CASE o_custkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'php dev' ELSE o_orderpriority END"], lambda d, t: filters.content_filter(d, t, ["dev", "php"], positive=["python"], by_title={"PHP": {"positive": ["php"]}}), "CASE WHEN {0} = '' THEN true WHEN {1} = 'php dev' THEN {0} LIKE '%php%' ELSE {0} LIKE '%python%' END"),
    "age_filter": Rule(["CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE '2026-01-' || CAST(10 + o_orderkey % 20 AS STRING) END"], lambda d: filters.age_filter(d.cast("timestamp"), F.lit("2026-01-31").cast("timestamp"), 10), "coalesce({0}::DATE >= DATE '2026-01-21', true)"),
    "is_settled": Rule(["CASE o_orderkey % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'cooldown:x:2026-01-' || CAST(10 + o_orderkey % 20 AS STRING) WHEN 2 THEN 'cooldown:x:2026-03-01' WHEN 3 THEN 'skipped_title' ELSE 'added' END", "'2026-01-' || CAST(10 + o_custkey % 20 AS STRING)"], lambda s, d: filters.is_settled(s, d, "2026-01-20", 5), "CASE WHEN {0} = 'skipped_title' THEN true WHEN {0} LIKE 'cooldown%' THEN split_part({0}, ':', 3) > '2026-01-20' ELSE {1}::DATE > DATE '2026-01-20' - 5 END"),
    "opening_rejection": Rule(["CASE WHEN o_orderkey % 7 = 0 THEN 'CLOSED' ELSE 'ACTIVE' END", "o_custkey % 5 > 0", "o_orderkey % 3 > 0", "o_custkey % 7 > 1", "o_totalprice > 100000"], filters.opening_rejection, "CASE WHEN {0} <> 'ACTIVE' THEN 'inactive' WHEN NOT {1} THEN 'role_mismatch' WHEN NOT {2} THEN 'location_mismatch' WHEN NOT {3} THEN 'no_entry' WHEN NOT {4} THEN 'stale' END"),
    "violations": Rule(["CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END", "o_totalprice / 200000"], lambda i, s: F.array_join(filters.violations(id=i == "", score=s > 1), ","), "concat_ws(',', CASE WHEN {0} = '' THEN 'id' END, CASE WHEN {1} > 1 THEN 'score' END)"),
    "known_sources": Rule(["CASE o_orderkey % 4 WHEN 0 THEN 'a z' WHEN 1 THEN o_orderstatus WHEN 2 THEN 'b a' END"], lambda c: F.array_join(builders.known_sources(F.split(c, " "), ["a", "b"]), ","), "CASE WHEN {0} = 'a z' THEN 'a' WHEN {0} = 'b a' THEN 'b,a' ELSE 'a,b' END"),
}
_VALUES = ("canonical_hash", "decode_list", "company_type", "union_evidence")
_FILTERS = ("matched_keywords", "content_filter", "age_filter", "is_settled", "opening_rejection", "violations", "known_sources")
rules_query("date_functions", "D2, D3, D4, D5, D6, D8", "orders", "o_orderkey", {n: r for n, r in DATE_RULES.items() if n not in _VALUES + _FILTERS})
rules_query("value_functions", "D12, M2, M5, M7", "orders", "o_orderkey", {n: DATE_RULES[n] for n in _VALUES})
rules_query("filter_functions", "F2, F4, F5, F9, F11, F20, K1, K9", "orders", "o_orderkey", {n: DATE_RULES[n] for n in _FILTERS})


def _first(*cases: tuple[str, str], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {default} END"


def _has(x: str, pattern: str) -> str:
    # the SQL's engine has no lookahead; for whether a text matches, a sign or the end is the same
    pattern = pattern.replace("(?![A-Za-z0-9_])", "(?:[^A-Za-z0-9_]|$)")
    return f"regexp_matches({x}, '(?i){_twice(pattern)}')"


_SEG = "lower(c_mktsegment)"
_HIT = f"CASE c_custkey % 9 WHEN 0 THEN 'https://www.baidu.com/s' WHEN 1 THEN 'https://www.liepin.com/company-jobs/' || {_S('c_custkey')} || '/' WHEN 2 THEN 'https://www.zhipin.com/gongsi/a' || {_S('c_custkey')} || '.html' WHEN 3 THEN 'https://job.' || {_SEG} || '.edu.cn/x' WHEN 4 THEN 'https://' || {_SEG} || '.com/news/1' WHEN 5 THEN 'https://boards.greenhouse.io/' || {_SEG} WHEN 6 THEN 'https://' || {_SEG} || '.com/careers' WHEN 7 THEN 'bad ' || c_name ELSE 'https://' || {_SEG} || '.com/about' END"
_HIT_TITLE = "CASE c_nationkey % 4 WHEN 0 THEN c_mktsegment || '招聘' WHEN 1 THEN 'Other招聘' WHEN 2 THEN c_mktsegment || ' 新闻' ELSE c_mktsegment END"
_HIT_KIND = "CASE WHEN c_nationkey % 7 = 0 THEN 'ad' WHEN c_nationkey % 7 = 1 THEN 'Organic' END"
_SAME = f"{_sub(_sub('lower({1})', '招聘'), _LETTERS)} = {_sub(_sub('lower({2})', '招聘'), _LETTERS)}"
_POLICY = _first(
    ("{0} NOT LIKE 'https:%' OR lower({3}) = 'ad'", "'DISCOVERY_LOG_ONLY invalid_or_nonorganic'"), ("{0} LIKE '%.baidu.com/%'", "'DISCOVERY_LOG_ONLY search_engine_page'"), ("{0} LIKE '%.edu.cn/%'", "'DISCOVERY_LOG_ONLY hard_excluded_source'"), ("{0} LIKE '%/news/%' OR {2} LIKE '%新闻%'", "'DISCOVERY_LOG_ONLY news_or_reprint'"),
    (f"regexp_matches({{0}}, '(liepin|zhipin)\\.com') AND {_SAME}", "'PLATFORM_CANDIDATE '"), ("regexp_matches({0}, '(liepin|zhipin)\\.com')", "'DISCOVERY_LOG_ONLY platform_identity_unconfirmed'"), default="'VERIFY_OFFICIAL_CANDIDATE '",
)
_SAYS = "CASE c_custkey % 10 WHEN 0 THEN '请输入验证码' WHEN 1 THEN '本次招聘已截止' WHEN 2 THEN '暂无职位' WHEN 3 THEN 'Submit application' WHEN 4 THEN 'Responsibilities: a' WHEN 5 THEN 'Open positions' WHEN 6 THEN 'Careers at ' || c_mktsegment WHEN 7 THEN '2026届校园招聘' WHEN 8 THEN c_mktsegment || ' summer intern' ELSE c_name END"
_PAGE = f"'<title>' || c_mktsegment || '</title><h1>' || CASE WHEN c_nationkey % 3 = 0 THEN '加入我们' ELSE c_mktsegment END || '</h1><p>' || {_SAYS} || '</p>'"
_PAGE_URL = f"'https://' || {_SEG} || '.com/' || CASE WHEN c_nationkey % 2 = 0 THEN 'apply/' ELSE 'x' END"
_READ = f"({{0}} || ' ' || {_sub('{1}', '<[^>]+>', ' ')})"
_H1 = "regexp_extract({1}, '<h1>(.*?)</h1>', 1)"
_SURFACE = _first(
    (f"{{2}} IN (401, 403) OR {_has(_READ, '验证码')}", "'BLOCKED_OR_CAPTCHA'"), (_has(_READ, "已截止"), "'EXPIRED_CAMPAIGN'"), (_has(_READ, "暂无职位"), "'VERIFIED_NO_OPENINGS'"), (f"{{0}} LIKE '%/apply/' AND {_has(_READ, 'submit application')}", "'APPLY_ACTION'"), (_has(_READ, "responsibilit"), "'ACTIVE_JOB_DETAIL'"),
    (_has(_READ, "open positions"), "'ACTIVE_JOB_LIST'"), (f"{_has(_H1, '加入我们|careers')}", "'VERIFIED_CAREER_HOME'"), (_has(_READ, "20\\d{2}届|校园招聘|summer intern"), "'VERIFIED_CAMPAIGN'"), default="'UNKNOWN'",
)
_TALK = "CASE c_custkey % 11 WHEN 0 THEN '日常实习' WHEN 1 THEN '校招 暑期实习' WHEN 2 THEN '2026届校园招聘' WHEN 3 THEN '社会招聘' WHEN 4 THEN 'Graduate program' WHEN 5 THEN 'intern ' || c_mktsegment WHEN 6 THEN '提前批 秋招' WHEN 7 THEN '春招补录 2027 届' WHEN 8 THEN 'experienced hire, early batch' WHEN 9 THEN '应届毕业生实习' ELSE c_mktsegment END"
_KIND = _first(
    (_has("{0}", "日常实习|长期实习|滚动实习|常规实习"), "'DAILY_INTERNSHIP'"), (_has("{0}", "(校招|校园|应届|毕业生).{0,20}实习|实习.{0,20}(校招|校园|应届)"), "'CAMPUS_INTERNSHIP'"), (_has("{0}", "校招|校园招聘|应届|毕业生|graduate|campus"), "'CAMPUS_FULL_TIME'"), (_has("{0}", "实习|internship|(^|[^a-z])intern([^a-z]|$)"), "'DAILY_INTERNSHIP'"), (_has("{0}", "社会招聘|社招|experienced"), "'EXPERIENCED'"), default="'SPECIAL_PROGRAM'",
)
_JOB = "CASE c_custkey % 8 WHEN 0 THEN 'Senior Dev' WHEN 1 THEN 'Dev intern' WHEN 2 THEN '实习生' WHEN 3 THEN 'Engineer III' WHEN 4 THEN '嵌入式软件' WHEN 5 THEN 'java dev' WHEN 6 THEN '产品经理' ELSE c_mktsegment END"
_YEARS_ASKED = "CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey % 7 END"
_ENGAGED = "CASE c_nationkey % 5 WHEN 0 THEN 'contract' WHEN 1 THEN 'internship' ELSE '' END"
_NAMED = lambda table, x: _first(*((_has(x, p), f"'{n}'") for n, p in table), default="NULL")
_WHO = "CASE c_custkey % 8 WHEN 0 THEN '北京大学' WHEN 1 THEN c_mktsegment || '医院' WHEN 2 THEN '某研究所' WHEN 3 THEN c_mktsegment || '银行' WHEN 4 THEN '税务局' WHEN 5 THEN c_mktsegment || '公司' ELSE c_mktsegment END"
_TRUST_KIND = "CASE c_custkey % 6 WHEN 0 THEN 'official_ats' WHEN 1 THEN 'university' WHEN 2 THEN 'aggregator' WHEN 3 THEN 'official_announcement' ELSE c_mktsegment END"
_TRUST_URL = f"CASE c_nationkey % 4 WHEN 0 THEN 'https://' || {_SEG} || '.com/careers' WHEN 1 THEN 'https://mp.weixin.qq.com/s/1' WHEN 2 THEN 'https://a.zhaopin.com/1' ELSE 'https://' || {_SEG} || '.com' END"
_STATUS = "CASE c_custkey % 6 WHEN 0 THEN 'Closed' WHEN 1 THEN 'open' WHEN 2 THEN '招聘中' WHEN 3 THEN 'inactive' WHEN 4 THEN 'Active' ELSE c_mktsegment END"
_DUE = f"CASE WHEN c_nationkey % 2 = 0 THEN '2026-0' || {_S('1 + c_nationkey % 5')} || '-15' END"

CLASS_RULES = {
    "source_policy": Rule([_HIT, "c_mktsegment", _HIT_TITLE, _HIT_KIND], lambda *c: text.let(classify.source_policy(*c), lambda p: F.concat(p["decision"], F.lit(" "), F.coalesce(p["reasonCode"], F.lit("")))), _POLICY),
    "result_class": Rule([_HIT, "c_mktsegment", _HIT_TITLE, _HIT_KIND], lambda u, c, t, k: classify.result_class(u, c, t, F.lit(""), k), _first((f"{_POLICY} LIKE 'DISCOVERY%'", "'excluded'"), (f"{_POLICY} LIKE 'PLATFORM%'", "'platform'"), ("{0} LIKE '%greenhouse.io%'", "'ats'"), (_has("{2} || ' ' || {0}", "招聘|/careers"), "'recruitment'"), default="'other'")),
    "surface_page": Rule([_PAGE_URL, _PAGE, "CASE WHEN c_custkey % 13 = 0 THEN 403 ELSE 200 END"], lambda u, h, s: classify.surface_page(u, h, s.cast("int"))["pageState"], _SURFACE),
    "target_evidence": Rule([_TALK], lambda c: (lambda x: F.concat_ws("|", F.array_join(x["recruitmentScopes"], ","), F.array_join(x["cohortYears"].cast("array<string>"), ","), F.array_join(x["recruitmentBatches"], ",")))(classify.target_evidence(c)), f"concat_ws(',', CASE WHEN {_has('{0}', '校招|校园招聘|应届|campus|graduate')} THEN 'CAMPUS' END, CASE WHEN {_has('{0}', '实习|intern')} THEN 'INTERNSHIP' END, CASE WHEN {_has('{0}', '社招|社会招聘|experienced')} THEN 'SOCIAL' END) || '|' || regexp_extract({{0}}, '(20\\d{{{{2}}}})\\s*届', 1) || '|' || concat_ws(',', CASE WHEN {_has('{0}', '秋招|autumn')} THEN 'AUTUMN' END, CASE WHEN {_has('{0}', '春招|spring')} THEN 'SPRING' END, CASE WHEN {_has('{0}', '提前批|early')} THEN 'EARLY' END, CASE WHEN {_has('{0}', '补录')} THEN 'SUPPLEMENTARY' END)"),
    "needs_render": Rule(["CASE WHEN c_custkey % 5 = 0 THEN 'FAILED' ELSE 'RESOLVED' END", "CASE WHEN c_nationkey % 3 = 0 THEN 'UNKNOWN' ELSE 'JOB_LIST' END", "CAST(c_acctbal / 10 AS INTEGER)", "c_custkey % 2 = 0"], classify.needs_render, "{0} = 'RESOLVED' AND ({1} = 'UNKNOWN' OR (NOT {3} AND {2} < 200))", {2: "CAST(rint(c_acctbal / 10) AS INTEGER)"}),
    "job_bucket": Rule([_JOB, _ENGAGED, _YEARS_ASKED], lambda t, j, y: classify.job_bucket(t, F.lit(""), j, y.cast("int"), F.lit(None)), _first((f"({{1}} = 'internship' OR {_has('{0}', '实习|' + chr(92) + 'bintern' + chr(92) + 'b')}) AND coalesce({{2}} < 3, true)", "'internship'"), ("{2} >= 3", "'experienced'"), (_has("{0}", r"\bsenior\b|engineer\s+(ii|iii|iv)\b"), "'experienced'"), ("{1} = 'contract'", "'experienced'"), default="'full_time'")),
    "role_family": Rule([_JOB], lambda t: classify.role_family(t, F.lit("")), f"coalesce({_NAMED(rules.ROLE_FAMILIES, '{0}')}, '其他')"),
    "role_categories": Rule([f"({_JOB}) || ' ' || ({_TALK})"], lambda t: F.array_join(classify.role_categories(t), ","), "concat_ws(',', " + ", ".join(f"CASE WHEN {_has('{0}', p)} THEN '{n}' END" for n, p in rules.ROLE_FAMILIES) + ")"),
    "recruitment_type": Rule([_TALK], classify.recruitment_type, _KIND),
    "recruitment_event": Rule([_TALK, "CASE WHEN c_custkey % 7 = 0 THEN 'bad' ELSE 'https://' || lower(c_mktsegment) || '.com/#a' END", "CASE WHEN c_nationkey % 6 = 0 THEN 'JOB_DETAIL' ELSE 'JOB_LIST' END"], lambda t, u, p: text.let(classify.recruitment_event(t, F.lit(""), F.lit(""), F.lit(""), F.lit(""), u, p, F.lit("OFFICIAL_SITE"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.array(F.lit("a"))), lambda e: F.coalesce(e["violation"], F.concat_ws(" ", e["recruitmentType"], e["directoryUrl"]))), f"CASE WHEN {{2}} = 'JOB_DETAIL' THEN 'unsupported_page_type' WHEN {{1}} = 'bad' THEN 'invalid_directory_url' ELSE {_KIND} || ' ' || split_part({{1}}, '#', 1) END"),
    "record_scope": Rule([_TALK, "CASE c_nationkey % 4 WHEN 0 THEN 'social' WHEN 1 THEN 'campus' ELSE '' END"], lambda t, g: classify.record_scope(t, F.lit(""), g, F.lit(""), F.lit(""), F.lit(None)), _first((_has("{0}", "实习|intern"), "'internship'"), (_has("{0}", "社招|社会招聘|经验招聘|experienced"), "'social'"), (_has("{0}", "校招|校园招聘|应届|秋招|春招|(20)?2[0-9]届"), "'campus'"), ("{1} <> ''", "{1}"), default="'campus'")),
    "batch": Rule([_TALK, "CASE c_nationkey % 3 WHEN 0 THEN 'internship' WHEN 1 THEN 'social' ELSE '' END"], classify.batch, f"coalesce({_NAMED([(n, p) for n, p in rules.BATCHES], '{0}')}, CASE {{1}} WHEN 'internship' THEN '日常实习' WHEN 'social' THEN '社招' ELSE '待确认批次' END)"),
    "database_bucket": Rule(["CASE WHEN c_nationkey % 3 = 0 THEN 2020 + c_nationkey WHEN c_nationkey % 3 = 1 THEN 0 END", "CASE c_custkey % 3 WHEN 0 THEN 'internship' WHEN 1 THEN 'social' ELSE 'campus' END"], lambda y, s: classify.database_bucket(y.cast("int"), s), "CASE WHEN {0} > 0 THEN 'cohort-' || {0} WHEN {1} = 'internship' THEN 'daily-internships' WHEN {1} = 'social' THEN 'social' ELSE 'cohort-unknown' END"),
    "organization_type": Rule([_WHO], classify.organization_type, _first(("{0} LIKE '%大学'", "'高校'"), ("{0} LIKE '%医院'", "'医院'"), ("{0} LIKE '%研究所'", "'科研院所'"), ("{0} LIKE '%银行'", "'金融机构'"), ("{0} LIKE '%局'", "'机关事业单位'"), ("{0} LIKE '%公司'", "'企业'"), default="'待确认'")),
    "source_trust": Rule([_TRUST_KIND, _TRUST_URL], lambda k, u: text.let(classify.source_trust(k, u), lambda x: F.concat_ws(" ", x["tier"], x["score"].cast("string"))), _first(("{0} = 'official_ats' OR {1} LIKE '%/careers' OR {1} LIKE '%.zhaopin.com/%'", "'official 100'"), ("{1} LIKE '%mp.weixin%' OR {0} = 'official_announcement'", "'high 90'"), ("{0} = 'university'", "'high 85'"), ("{0} = 'aggregator'", "'discovery 45'"), default="'lead 20'")),
    "page_identity": Rule(["'<title>' || c_mktsegment || ' jobs</title>' || CASE WHEN c_custkey % 2 = 0 THEN '<nav>x ' || c_mktsegment || '</nav>' ELSE '<nav>menu</nav>' END || CASE WHEN c_nationkey % 3 = 0 THEN '<footer>' || lower(c_mktsegment) || '</footer>' ELSE '' END", "CASE WHEN c_custkey % 5 = 0 THEN 'Zzz' ELSE c_mktsegment END"], lambda h, n: (lambda x: F.concat_ws(" ", F.array_join(x["signals"], ","), x["confirmed"].cast("string")))(classify.page_identity(h, F.array(n))), "(SELECT concat_ws(',', t, f, n) || ' ' || ((t IS NOT NULL)::INTEGER + (f IS NOT NULL)::INTEGER + (n IS NOT NULL)::INTEGER >= 2) FROM (SELECT CASE WHEN contains(lower(regexp_extract({0}, '<title>(.*?)</title>', 1)), lower({1})) THEN 'title' END AS t, CASE WHEN contains(lower(regexp_extract({0}, '<footer>(.*?)</footer>', 1)), lower({1})) THEN 'footer' END AS f, CASE WHEN contains(lower(regexp_extract({0}, '<nav>(.*?)</nav>', 1)), lower({1})) THEN 'nav' END AS n))"),
    "hard_negative": Rule([_HIT, "CASE c_nationkey % 4 WHEN 0 THEN 'Java培训班' WHEN 1 THEN '请加微信' ELSE c_name END"], classify.hard_negative, _first(("regexp_matches({0}, 'zhipin|liepin')", "'aggregator_domain'"), ("{0} LIKE '%.edu.cn/%'", "'university_employment_site'"), ("{0} LIKE '%/news/%'", "'news_reprint'"), ("{1} LIKE '%培训班%'", "'training_provider'"), ("{1} LIKE '%加微信%'", "'private_or_payment_risk'"))),
    "has_structure": Rule([_SAYS], classify.has_recruitment_structure, _has("{0}", "职位|岗位|招聘|投递|job|position|vacanc|opening")),
    "has_no_openings": Rule([_SAYS], classify.has_no_openings, _has("{0}", "暂无(开放)?职位|暂无岗位|没有在招职位|no (current )?open")),
    "is_search_blocked": Rule([_SAYS], classify.is_search_blocked, _has("{0}", "验证码|安全验证|captcha|unusual traffic")),
    "explicit_job_links": Rule(["'https://a.com/job/' || CAST(c_custkey AS STRING) || ' https://a.com/about https://a.com/' || CASE WHEN c_nationkey % 2 = 0 THEN 'apply/' ELSE lower(c_mktsegment) END"], lambda c: F.array_join(F.transform(classify.explicit_job_links(F.transform(F.split(c, " "), lambda u: F.struct(u.alias("url"), F.lit("").alias("text")))), lambda a: a["url"]), ","), "array_to_string(list_filter(string_split({0}, ' '), lambda u: regexp_matches(u, 'job/[^/]+|apply/')), ',')"),
    "field_errors": Rule(["CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END", "CASE WHEN c_nationkey % 4 = 0 THEN '' ELSE c_mktsegment END", _HIT, _DUE, "'2026-03-01'"], lambda *c: F.array_join(classify.field_errors(*c), ","), "concat_ws(',', CASE WHEN trim({0}) = '' THEN 'missing_company' END, CASE WHEN {1} = '' THEN 'missing_title' END, CASE WHEN {2} NOT LIKE 'https://%' THEN 'invalid_url' END, CASE WHEN {3} > {4} THEN 'dates_reversed' END)"),
    "opening_status": Rule([_STATUS, _DUE], lambda s, d: classify.opening_status(s, d, F.lit("2026-03-01").cast("date")), _first((f"{_has('{0}', 'closed|inactive')} OR {{1}} < '2026-03-01'", "'CLOSED'"), (_has("{0}", "active|open|招聘中"), "'ACTIVE'"), default="'UNKNOWN'")),
    "matches_role": Rule([f"CASE c_custkey % 3 WHEN 0 THEN 'Senior ' || c_mktsegment || '-Dev' WHEN 1 THEN c_mktsegment || '  Dev' ELSE 'Chef' END"], lambda t: classify.matches_role(t, ["building dev", " ", "furniture-dev"]), "regexp_matches(lower({0}), 'building +dev|furniture-dev')"),
    "matches_location": Rule(["CASE c_nationkey % 4 WHEN 0 THEN 'Rome, Italy|Paris' WHEN 1 THEN 'Om' WHEN 2 THEN c_mktsegment END"], lambda c: classify.matches_location(F.split(c, r"\|"), " rome "), "coalesce(contains(lower({0}), 'rome') OR contains('rome', lower({0})), true)"),
    "official_score": Rule([_HIT, _HIT_TITLE, "CASE WHEN c_nationkey % 2 = 0 THEN lower(c_mktsegment) || '.com' ELSE '' END"], lambda u, t, d: text.let(classify.official_score(u, t, F.lit("2026"), F.lit("BUILDING"), d, F.lit(False), F.lit(2026), F.lit(""), F.lit(1)), lambda x: F.concat_ws(" ", x["totalScore"].cast("string"), x["decision"])), "(SELECT n || ' ' || CASE WHEN n >= 75 AND strong THEN 'auto_verify' WHEN n < 55 THEN 'reject' ELSE 'review' END FROM (SELECT CASE WHEN regexp_matches({0}, '(zhipin|liepin)\\.com') THEN -50 ELSE 0 END + CASE WHEN own THEN 40 ELSE 0 END + CASE WHEN vendor AND named THEN 35 ELSE 0 END + CASE WHEN named THEN 25 ELSE -40 END + 20 + CASE WHEN {1} LIKE '%招聘%' THEN 10 ELSE 0 END + 5 AS n, own OR (vendor AND named) AS strong FROM (SELECT {2} <> '' AND starts_with({0}, 'https://' || {2} || '/') AS own, {0} LIKE '%greenhouse.io%' AS vendor, contains(lower({1}), 'building') AS named)))"),
    "identity": Rule(["CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE '' END", "CASE c_nationkey % 3 WHEN 0 THEN 'x y' WHEN 1 THEN 'x' ELSE '' END", "CASE WHEN c_custkey % 11 = 0 THEN 'punycode_domain' ELSE 'other' END", "CASE WHEN c_nationkey % 4 = 0 THEN 'JOB_LIST' WHEN c_nationkey % 4 = 1 THEN 'CAREER_HOME' ELSE 'UNKNOWN' END", "CASE c_custkey % 7 WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'UNKNOWN' ELSE 'ACTIVE' END"], lambda s, m, r, p, v: (lambda words: classify.identity(words(s), words(m), words(r), p, v, F.lit(200), F.lit(True), F.lit(False))["verdict"])(lambda x: F.filter(F.split(x, " "), lambda w: w != "")), _first(("{4} = 'BLOCKED'", "'BLOCKED'"), ("{2} = 'punycode_domain'", "'REJECT'"), ("{0} <> '' AND {3} <> 'UNKNOWN' AND {3} = 'JOB_LIST' AND {4} = 'ACTIVE'", "'AUTO_ACCEPT'"), ("{0} <> '' AND {3} <> 'UNKNOWN'", "'AUTO_ACCEPT_WITH_LIMITED_ROLE'"), ("{1} = 'x y'", "'MANUAL_REVIEW'"), default="'UNVERIFIED'")),
    "site_score": Rule([_HIT, "CASE WHEN c_nationkey % 2 = 0 THEN 'careers' ELSE '' END"], lambda u, t: classify.site_score(u, t, F.lit(""), F.array(F.lit("building")), F.lit("")).cast("double"), "(CASE WHEN {0} LIKE '%edu.cn%' OR {0} LIKE '%.com/%' OR {0} LIKE '%.io/%' THEN CASE WHEN {0} LIKE '%.building.edu.cn/%' THEN 0.8 + CASE WHEN {1} <> '' THEN 0.5 ELSE 0 END WHEN {0} LIKE 'https://building.com/%' THEN 1.0 + CASE WHEN {1} <> '' THEN 0.5 ELSE 0 END WHEN {0} LIKE '%//boards.greenhouse.io/%' THEN 0.4 + CASE WHEN {1} <> '' THEN 0.5 ELSE 0 END ELSE 0.0 END ELSE 0.0 END)::DOUBLE"),
    "domain_risks": Rule([f"CASE c_custkey % 5 WHEN 0 THEN 'https://10.2.3.' || {_S('c_nationkey')} || '/' WHEN 1 THEN 'https://acne.com/' WHEN 2 THEN 'bad' WHEN 3 THEN 'https://' || lower(c_mktsegment) || '.com:8443/' ELSE 'https://a-b-c-d-' || lower(c_mktsegment) || '.com/' END", "CASE WHEN c_nationkey % 3 = 0 THEN '加微信' ELSE c_name END"], lambda u, t: F.array_join(F.array_sort(classify.domain_risks(u, F.array(F.lit("acme.com")), t)), ","), "CASE WHEN {0} = 'bad' THEN 'invalid_url' ELSE concat_ws(',', CASE WHEN {0} LIKE '%//a-b-c-d-%' THEN 'abnormal_domain_shape' END, CASE WHEN {0} LIKE '%//10.%' THEN 'ip_literal_host' END, CASE WHEN {0} LIKE '%acne.com%' THEN 'lookalike_official_domain' END, CASE WHEN {0} LIKE '%:8443%' THEN 'non_standard_port' END, CASE WHEN {1} = '加微信' THEN 'payment_or_private_contact_risk' END) END"),
    "work_limits": Rule(["CASE c_nationkey % 5 WHEN 0 THEN 'No visa sponsorship here' WHEN 1 THEN 'under ITAR rules' WHEN 2 THEN 'guitar ' WHEN 3 THEN 'must be a U.S. citizen' ELSE '' END || c_name"], classify.work_authorization_limits, "regexp_matches({0}, '(?i)no visa sponsorship|\\bitar\\b|must be a u\\.s\\. citizen')"),
    "fresh_verification": Rule(["CASE WHEN c_custkey % 3 = 0 THEN 'verified_platform_apply' ELSE c_mktsegment END", "c_nationkey % 2 = 0", "CASE WHEN c_custkey % 4 = 0 THEN 'expired' ELSE 'active' END", f"'2026-01-{{{{d}}}}'".replace("'2026-01-{{d}}'", f"'2026-01-' || {_S('10 + c_custkey % 20')} || ' 06:00:00'")], lambda k, b, s, at: classify.fresh_verification(k, b, s, at.cast("timestamp"), F.lit("2026-01-22").cast("timestamp")), "({0} = 'verified_platform_apply' OR {1}) AND {2} = 'active' AND {3}::TIMESTAMP >= TIMESTAMP '2026-01-20 00:00:00'"),
    "should_open": Rule(["CASE c_custkey % 6 WHEN 0 THEN 'platform' WHEN 1 THEN 'ats' WHEN 2 THEN 'recruitment' WHEN 3 THEN 'excluded' ELSE lower(c_mktsegment) END"], classify.should_open, "{0} IN ('platform', 'ats', 'recruitment')"),
}
_MORE = ("target_evidence", "needs_render", "organization_type", "source_trust", "page_identity", "hard_negative", "has_structure", "has_no_openings", "is_search_blocked", "explicit_job_links", "field_errors", "opening_status", "matches_role", "matches_location", "database_bucket", "work_limits", "fresh_verification")
rules_query("class_functions", "C1, C3, C4, C10, C12, C13, C14, C27, C28, C29, P33", "customer", "c_custkey", {n: r for n, r in CLASS_RULES.items() if n not in _MORE})
rules_query("more_functions", "C5, C6, C14, C15, C16, C19, C20, C22, C23, C24, C30, C31, K17", "customer", "c_custkey", {n: CLASS_RULES[n] for n in _MORE})


LINK_RULES = {
    "surface_admits": Rule(["CASE page_id % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'example.org' ELSE 'example.net' END", "CASE page_id % 4 WHEN 0 THEN '/EN/' WHEN 1 THEN '/fr/' ELSE '' END", "url"], governance.surface_admits, "contains(lower(regexp_extract({2}, '^[a-z]+://([^/?#]+)', 1)), '.' || {0}) AND contains(lower({2}), lower({1}))"),
    "governed_role": Rule(["CASE page_id % 7 WHEN 0 THEN '/careers/' WHEN 1 THEN '/jobs?x=1' WHEN 2 THEN '/2026届秋招' WHEN 3 THEN '/apply/' || CAST(page_id AS STRING) WHEN 4 THEN '/jobs/' || CAST(page_id AS STRING) ELSE '/about' END", "CASE page_id % 5 WHEN 0 THEN 'wechat' WHEN 1 THEN 'university' WHEN 2 THEN 'media' ELSE 'x' END", "page_id % 2 = 0"], governance.governed_role, "CASE WHEN {1} = 'wechat' THEN 'official_wechat_announcement' WHEN {1} = 'university' THEN 'trusted_repost' WHEN {1} = 'media' THEN 'media_article' WHEN regexp_matches({0}, '/apply/|/jobs/[0-9]+$') THEN 'application_form' WHEN {0} LIKE '%秋招%' THEN 'campaign_announcement' WHEN regexp_matches({0}, 'jobs([?]|$)') THEN 'job_list' WHEN {0} LIKE '/careers/%' OR {2} THEN 'company_career_home' ELSE 'unknown' END"),
    "has_shared": Rule(["'a ' || CAST(page_id % 5 AS STRING)", "CAST(page_id % 3 AS STRING) || ' b'"], lambda a, b: resolve.has_shared(F.split(a, " "), F.split(b, " ")), "len(list_intersect(string_split({0}, ' '), string_split({1}, ' '))) > 0"),
    "markdown_url": Rule(["'  ' || url || CASE WHEN page_id % 2 = 0 THEN '|[x] more' ELSE ' more' END"], text.markdown_url, "replace(regexp_replace(split_part(trim({0}), ' ', 1), '([\\[\\]])', '\\\\\\1', 'g'), '|', '%7C')"),
    "hyperlink": Rule(["CASE WHEN page_id % 4 = 0 THEN '' ELSE url || '\"q' END", "'see ' || CAST(page_id AS STRING)"], files.hyperlink, "CASE WHEN {0} = '' THEN '' ELSE '=IFERROR(HYPERLINK(\"' || replace({0}, '\"', '\"\"') || '\",\"' || {1} || '\"),\"' || {1} || '\")' END"),
}
rules_query("link_functions", "F18, U15, E2, P24, S5", "pages", "page_id", LINK_RULES)
