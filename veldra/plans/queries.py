"""Queries of the library over the driver's tables, with the SQL that they are checked against.

The tables hold no postings; each query applies the library's own operators to stand-ins of the same shape.  Every
query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.functions import classify, dates, rules, text, urls, values
from veldra.operators import filters, graph, near_dup, pick, reports, resolve, rollup, store, verify

QUERIES: dict = {}
ORACLE: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes))


#: Rows of a task, where there are more than each core can have a thousand of.
TASK_ROWS = 20_000


def spread(rows: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows dealt to tasks by key: a narrow table is one file of few megabytes, which a single task would read and work on."""
    n = rows.count()
    tasks = max(-(-n // task_rows), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 1000)))
    return rows.repartition(tasks, key) if tasks > 1 else rows


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def _values(rows) -> str:
    quote = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


#: Codes of evidence that stand for the types of events; the hour tells the strong from the weak.
_CODES = {"view": "recruitment_structure", "click": "official_site_backlink", "signup": "official_domain_match", "purchase": "apply_action", "error": "blocked_page"}
_PORTAL = "CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d')"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    code = F.create_map(*(F.lit(v) for kv in _CODES.items() for v in kv))[F.col("event_type")]
    code = F.when((F.col("event_type") == "error") & (F.col("value") > 30), "aggregator_domain").otherwise(code)
    portal = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return e.select(portal.alias("portal"), code.alias("code"), F.when(F.col("value") > 1, "CAREER_HOME").otherwise("UNKNOWN").alias("page_type"), "ts", "event_id")


@query(f"""
WITH r(code, direction, weight, anchor, hard) AS (VALUES {_values([(k, *v) for k, v in rules.EVIDENCE.items()])}),
e AS (SELECT {_PORTAL} AS portal, CASE WHEN event_type = 'error' AND value > 30 THEN 'aggregator_domain' ELSE CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODES.items())} END END AS code,
 CASE WHEN value > 1 THEN 'CAREER_HOME' ELSE 'UNKNOWN' END AS page_type, ts, event_id FROM events),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY portal, code ORDER BY ts, event_id) = 1),
s AS (SELECT portal, sum(weight) AS w, bool_or(hard) AS rej, bool_or(f.code = 'blocked_page') AS blk, bool_or(direction = 'POSITIVE' AND anchor) AS anchored, arg_min(page_type, (ts, event_id)) AS page_type, count(*) AS n_evidence FROM f JOIN r USING (code) GROUP BY portal)
SELECT portal, greatest(0, least(100, w))::INTEGER AS score, CASE WHEN rej THEN 'REJECTED' WHEN blk THEN 'BLOCKED' WHEN least(100, w) >= 50 AND anchored AND page_type <> 'UNKNOWN' THEN 'VERIFIED' WHEN w < 45 THEN 'REJECTED' ELSE 'REVIEW' END AS status, anchored, n_evidence FROM s
""")
def evidence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, W2, A6"""
    return verify.verdicts(_evidence(spark, sf_dir), "portal", "page_type", F.col("ts"), F.col("event_id"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_verdict(spark, sf_dir).orderBy("portal")


_P1 = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_P2 = "trim(regexp_replace(regexp_replace(" + _P1 + ", '\\b(inc|incorporated|corp|corporation|company|co|ltd|limited|llc)\\b', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT c_custkey AS id, {_P1.format('c_name')} AS name, {_P2.format(chr(34) + 'n' + chr(34))} AS company FROM (SELECT *, c_name || ' ' || c_mktsegment || CASE c_custkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Co., Ltd' WHEN 2 THEN ' LLC' ELSE ' Company' END AS n FROM customer)")
def normalize_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2"""
    c = table(spark, sf_dir, "customer")
    form = F.element_at(F.array(F.lit(" Inc."), F.lit(" Co., Ltd"), F.lit(" LLC"), F.lit(" Company")), (F.col("c_custkey") % 4 + 1).cast("int"))
    n = F.concat("c_name", F.lit(" "), "c_mktsegment", form)
    return c.select(F.col("c_custkey").alias("id"), text.normalize_text(F.col("c_name"), True).alias("name"), text.canonical_company(n, True).alias("company"))


_P13 = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '<[^>]*>', ' ', 'g'), '&[a-z#0-9]+;', ' ', 'gi'), 'https?://\\S+', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(f"SELECT doc_id, sha1({_P13}) AS text_key, length({_P13}) AS n, substr(sha1(source || '|' || lang || '|' || CAST(n_chars AS VARCHAR)), 1, 20) AS id FROM documents")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, D11"""
    d = table(spark, sf_dir, "documents")
    x = text.posting_text(F.col("text"))
    key = F.substring(F.sha1(F.concat_ws("|", "source", "lang", F.col("n_chars").cast("string")).cast("binary")), 1, 20)
    return d.select("doc_id", F.sha1(x.cast("binary")).alias("text_key"), F.length(x).cast("long").alias("n"), key.alias("id"))


@query("""
WITH u AS (SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(\\?[^#]*)?', ['s', 'h', 'p', 'q']) AS m FROM pages),
q AS (SELECT page_id, m.s AS s, lower(m.h) AS h, CASE m.p WHEN '' THEN '/' ELSE m.p END AS p, list_filter(string_split(substr(m.q, 2), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:utm_[^=]*|spm|from|source|ref|referrer|campaign|bd_vid)(=|$)')) AS k, m.q AS q FROM u)
SELECT page_id, s || '://' || h || p || CASE q WHEN '?' THEN '' ELSE q END AS clean, s || '://' || h || p || CASE WHEN len(k) > 0 THEN '?' || list_aggregate(k, 'string_agg', '&') ELSE '' END AS canonical FROM q
""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, U2"""
    return table(spark, sf_dir, "pages").select("page_id", urls.clean_url(F.col("url")).alias("clean"), urls.canonical_url(F.col("url")).alias("canonical"))


@query("SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS bare, regexp_extract(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '([^.]+\\.[^.]+)$', 1) AS domain, regexp_matches(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '(^|\\.)example\\.(org|net)$') AS known FROM pages")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U6, U7, U8"""
    h = urls.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", h.alias("host"), urls.official_domain(F.col("url")).alias("bare"), urls.registrable_domain(F.col("url")).alias("domain"), urls.host_in(h, ["example.org", "example.net"]).alias("known"))


@query("""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*["'']([^"'']+)["''][^>]*>(.*?)</a>', 2)) AS t, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*["'']([^"'']+)["''][^>]*>(.*?)</a>', 1), 1) AS pos FROM pages),
b AS (SELECT page_id, pos, trim(href) AS url, trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text FROM b QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U14"""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(urls.links(F.col("html"))).alias("a")).select("page_id", "a.url", "a.text")


@query("""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) || ' ' || coalesce(regexp_extract(url, '(\\?[^#]*)', 1), '')) AS x FROM pages),
v AS (SELECT page_id, ' ' || x AS x FROM u)
SELECT page_id, CASE WHEN regexp_matches(x, 'apply|application') THEN 'APPLY' WHEN regexp_matches(x, '(?:job|position|vacanc)[a-z]*[/_-]?(?:detail|id)|(?:jobs?|positions?)/[^/?]*\\d') THEN 'JOB_DETAIL' WHEN regexp_matches(x, 'jobs|positions|vacanc|openings') THEN 'JOB_LIST' WHEN regexp_matches(x, 'campus|graduate') THEN 'CAMPAIGN' WHEN regexp_matches(x, 'career|join-?us|recruit|talent') THEN 'CAREER_HOME' ELSE 'UNKNOWN' END AS role FROM v
""")
def link_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U15"""
    return table(spark, sf_dir, "pages").select("page_id", urls.link_role(F.col("url"), F.lit("")).alias("role"))


_ENTITIES = "".join(["regexp_replace("] * len(text.NAMED_ENTITIES)) + "regexp_replace(regexp_replace(regexp_replace(html, '<script\\b[^>]*>.*?</script>', ' ', 'gis'), '<style\\b[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g')" + "".join(", '&" + n + ";', '" + c.replace("'", "''") + "', 'gi')" for n, c in text.NAMED_ENTITIES)


@query(f"SELECT page_id, sha1(t) AS text_key, length(t) AS n, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is') AS title, regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is') AS h1 FROM (SELECT page_id, html, trim(regexp_replace(replace({_ENTITIES}, '&#39;', ''''), '[\\s\\x{{A0}}\\x{{3000}}]+', ' ', 'g')) AS t FROM pages)")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, C19"""
    t = text.strip_tags(F.col("html"), False)
    part = lambda tag: F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.sha1(t.cast("binary")).alias("text_key"), F.length(t).cast("long").alias("n"), part("title").alias("title"), part("h1").alias("h1"))


_LIVE = lambda patterns: "(?i)(?:" + "|".join(p.replace("'", "''") for p in patterns) + ")"


@query(f"""
WITH p AS (SELECT page_id, page_id % 7 AS k, url, html, CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 403 ELSE 200 END AS status, CASE WHEN page_id % 7 = 2 THEN url || '&error=true' WHEN page_id % 7 = 3 THEN 'https://x.example.net/' ELSE url END AS final, regexp_replace(html, '<[^>]+>', ' ', 'g') AS body FROM pages),
q AS (SELECT *, regexp_extract_all(lower(url), '\\d{{5,}}') AS ids FROM p)
SELECT page_id, CASE WHEN status = 404 THEN 'expired' WHEN regexp_matches(body, '{_LIVE([p for p in rules.CHALLENGE_TEXT])}') THEN 'uncertain' WHEN status = 403 THEN 'uncertain' WHEN regexp_matches(final, '(?i)[?&]error=true') THEN 'expired' WHEN regexp_matches(body, '{_LIVE(rules.EXPIRED_TEXT)}') THEN 'expired'
 WHEN len(ids) > 0 AND NOT contains(lower(final), ids[-1]) THEN 'uncertain' WHEN k = 4 THEN 'active' WHEN regexp_matches(body, '{_LIVE(rules.LISTING_TEXT)}') THEN 'expired' WHEN length(trim(body, E' \\n\\t\\r')) < 300 THEN 'expired' ELSE 'uncertain' END AS result FROM q
""")
def liveness_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7"""
    k = F.col("page_id") % 7
    status = F.when(k == 0, 404).when(k == 1, 403).otherwise(200)
    final = F.when(k == 2, F.concat("url", F.lit("&error=true"))).when(k == 3, "https://x.example.net/").otherwise(F.col("url"))
    controls = F.when(k == 4, F.array(F.lit("Apply now"))).otherwise(F.array(F.lit("Back")))
    found = classify.liveness(status, F.col("url"), final, F.regexp_replace("html", "<[^>]+>", " "), controls)
    return table(spark, sf_dir, "pages").select("page_id", found["result"].alias("result"))


@query("""
WITH s AS (SELECT CASE WHEN NOT (contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') OR contains(lower(p_name), 'small')) OR contains(lower(p_name), 'bolt') THEN 'title' WHEN p_type = 'PROMO' THEN 'tier' WHEN contains(lower(p_brand), 'brand#1') AND NOT contains(lower(p_brand), 'brand#12') THEN 'location' WHEN p_size < 10 THEN 'age' WHEN p_retailprice < 950 THEN 'salary' ELSE 'added' END AS stage FROM part)
SELECT stage, count(*) AS rows FROM s GROUP BY stage
""")
def title_filter_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F3, F4, F6, F8, A21"""
    stage = filters.first_failed_stage(
        title=filters.title_filter(F.col("p_name"), ["red", " blue", "Small", ""], ["bolt"]),
        tier=filters.tier_filter(F.col("p_type"), ["PROMO"]),
        location=filters.location_filter(F.col("p_brand"), always=["Brand#12"], block=["brand#1"]),
        age=F.col("p_size") >= 10,
        salary=filters.salary_filter(F.col("p_retailprice"), F.col("p_retailprice"), F.lit("USD"), 950, 0, "usd"),
    )
    return filters.stage_counts(table(spark, sf_dir, "part").select(stage.alias("stage")))


@query("SELECT CASE WHEN o_orderdate IS NULL THEN 'undated' WHEN o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAYS THEN 'fresh' ELSE 'stale' END AS class, count(*) AS rows FROM orders GROUP BY 1")
def freshness_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10"""
    o = table(spark, sf_dir, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))
    return o.join(F.broadcast(now)).groupBy(filters.posting_date_class(F.col("o_orderdate"), F.col("now"), 180).alias("class")).agg(F.count("*").alias("rows"))


@query("""
WITH s AS (SELECT l_shipdate::DATE::VARCHAR AS shipped, l_extendedprice AS lo, CASE l_linenumber % 2 WHEN 0 THEN l_extendedprice * 1.1 END AS hi, CASE l_linestatus WHEN 'O' THEN 'usd' ELSE 'EUR' END AS cur, l_returnflag FROM lineitem)
SELECT l_returnflag, count(*) AS rows, count(*) FILTER (cur = 'usd' AND coalesce(hi, lo) >= 20000 AND lo <= 60000) AS kept FROM s GROUP BY l_returnflag
""")
def salary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6"""
    low = F.col("l_extendedprice")
    ok = filters.salary_filter(low, F.when(F.col("l_linenumber") % 2 == 0, low * 1.1), F.when(F.col("l_linestatus") == "O", "usd").otherwise("EUR"), 20000, 60000, "USD")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.count_if(ok).alias("kept"))


_WINDOWS = [(0, "NATION_1", "1999-01-01", 40, ["urgent"], None), (1, "NATION_12", "1998-06-01", 600, None, "high_roles"), (2, "nation 3", "1999-01-10", 30, ["high", "low"], "all_medium")]


@query(f"""
WITH w(pos, company, d, days, applied, bucket) AS (VALUES (0, 'NATION_1', DATE '1999-01-01', 40, ['urgent'], []), (1, 'NATION_12', DATE '1998-06-01', 600, [], ['high']), (2, 'nation 3', DATE '1999-01-10', 30, ['high', 'low'], ['medium'])),
o AS (SELECT o_orderkey, n_name, lower(o_orderpriority) AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT o_orderkey, pos, company, d + days AS until FROM o JOIN w ON (regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(company), '[^a-z0-9]', '', 'g')) AND d + days > DATE '1999-02-01' AND len(list_filter(list_concat(applied, bucket), lambda k: contains(t, k))) > 0)
SELECT o_orderkey, arg_min('cooldown:' || company || ':' || until::DATE::VARCHAR, pos) AS cooldown FROM o LEFT JOIN h USING (o_orderkey) GROUP BY o_orderkey
""")
def cooldown_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, J7, P18"""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    jobs = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    jobs = jobs.select("o_orderkey", F.col("n_name").alias("company"), F.col("o_orderpriority").alias("title"))
    windows = spark.createDataFrame(_WINDOWS, "pos int, company string, last_apply_date string, same_role_days int, applied_to array<string>, bucket string")
    return filters.cooldown(jobs, windows, "1999-02-01", "o_orderkey").select("o_orderkey", "cooldown")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unseen_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4"""
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return pick.unseen(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), seen, ["c_custkey"])


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1"""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return pick.first_by(e, ["user_id", "event_type"], F.col("ts"), F.col("event_id")).drop("ts")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def dedupe_best_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, W4"""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return pick.best_by(o, ["o_custkey"], F.col("o_totalprice"), F.col("o_orderkey"))


@query("""
WITH d AS (SELECT doc_id, source, sha256(text) AS k, length(text) + 50 + CASE WHEN lang = '' THEN 0 ELSE 30 END AS rich FROM documents)
SELECT source, k, doc_id, rich FROM d QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY rich DESC, doc_id) = 1
""")
def dedupe_richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the whole text, so that only equal texts of a source are merged."""
    rich = pick.richness(F.col("text"), F.col("source"), F.col("lang"), F.lit(None))
    d = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("k"), "doc_id", rich.cast("long").alias("rich"))
    return pick.best_by(d, ["source", "k"], F.col("rich"), F.col("doc_id"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7"""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return pick.last_by(e, ["user_id", "event_type"], F.col("ts"), F.col("event_id")).drop("ts")


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8, W10"""
    return pick.top_n(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], 3, F.desc("c_acctbal"), F.col("c_custkey"))


@query("""
SELECT o_custkey, arg_max(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS priority, bool_or(o_totalprice > 400000) AS large, count(*) AS merged,
 (SELECT string_agg(p, ',' ORDER BY k) FROM (SELECT o_orderpriority AS p, min(o_orderkey) AS k FROM orders i WHERE i.o_custkey = o.o_custkey GROUP BY p)) AS priorities FROM orders o GROUP BY o_custkey
""")
def merge_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1"""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("").alias("status"), F.col("o_orderpriority").alias("priority"), (F.col("o_totalprice") > 400000).alias("large"), F.array("o_orderpriority").alias("priorities"))
    return pick.merge_results(o, ["o_custkey"], ["status"], ["priority"], ["large"], ["priorities"]).withColumn("priorities", F.array_join("priorities", ","))


@query("SELECT regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g') AS company_key, arg_min(c_name, o_orderkey) AS company, count(*) AS open_jobs, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS locations, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS sources FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def company_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2"""
    jobs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    jobs = jobs.select(F.col("c_name").alias("company"), F.col("o_orderpriority").alias("location"), F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("seq"))
    return rollup.companies(jobs).withColumn("locations", F.array_join("locations", ",")).withColumn("sources", F.array_join("sources", ","))


@query("""
WITH r AS (SELECT o_custkey AS p, o_orderkey AS seq, c_name AS company, year(o_orderdate) AS cohort, o_orderpriority AS batch, epoch_ms(o_orderdate) AS posted, CASE o_orderstatus WHEN 'F' THEN epoch_ms(o_orderdate) + 86400000 END AS expires, CASE WHEN o_orderkey % 3 = 0 THEN 'https://a.example.com/' || (o_orderkey % 5) END AS apply_url, 'https://a.example.com/' || (o_orderkey % 4) AS detail, o_orderstatus AS src FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT p AS project_id, arg_max(company, (posted, -seq)) AS company, arg_max(cohort, (posted, -seq)) AS cohort_year, min(posted) AS posted_at, max(expires) AS expires_at, bool_or(src = 'F' AND seq % 2 = 0) AS official_verified, count(*) AS records, arg_min(apply_url, seq) FILTER (apply_url IS NOT NULL) AS apply_url, nullif(arg_min(detail, seq), coalesce(arg_min(apply_url, seq) FILTER (apply_url IS NOT NULL), '')) AS job_detail_url, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM r GROUP BY p
""")
def project_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3"""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ms, key, none = F.unix_millis("o_orderdate"), F.col("o_orderkey"), F.lit(None).cast("string")
    link = lambda n: F.concat(F.lit("https://a.example.com/"), (key % n).cast("string"))
    official = F.col("o_orderstatus") == "F"
    records = o.select(
        F.col("o_custkey").alias("project_id"), key.alias("seq"), F.col("c_name").alias("company"), F.year("o_orderdate").alias("cohort_year"), F.col("o_orderpriority").alias("batch"), F.col("o_orderpriority").alias("title"), F.col("c_mktsegment").alias("location"),
        ms.alias("posted_at"), F.when(official, ms + 86_400_000).alias("expires_at"), ms.alias("first_seen_at"), F.lit(None).cast("long").alias("verified_at"), F.col("o_orderstatus").alias("source"), official.alias("official_verified"), (key % 2 == 0).alias("identity_confirmed"), F.lit(True).alias("campaign_confirmed"),
        F.lit(None).cast("boolean").alias("application_active"), F.lit(False).alias("new_in_run"), F.when(key % 3 == 0, link(5)).alias("apply_url"), link(4).alias("job_detail_url"), none.alias("job_list_url"), none.alias("campaign_url"), none.alias("career_url"),
    )
    return rollup.projects(records).select("project_id", "company", F.col("cohort_year").cast("long").alias("cohort_year"), "posted_at", "expires_at", "official_verified", "records", "apply_url", "job_detail_url", F.array_join("sources", ",").alias("sources"))


@query("""
WITH j AS (SELECT l_orderkey, string_agg(DISTINCT p_name, '；' ORDER BY p_name) AS titles, string_agg(DISTINCT s_name, '、' ORDER BY s_name) AS places FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_linestatus = 'O' GROUP BY l_orderkey)
SELECT o_orderkey AS event, c_name AS company, year(o_orderdate) || ' 届' || CASE o_orderstatus WHEN 'F' THEN '校园招聘' WHEN 'O' THEN '社会招聘' ELSE o_orderpriority END AS batch, coalesce(titles, '') AS titles, coalesce(places, '') AS locations FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN j ON l_orderkey = o_orderkey
""")
def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, J1, O3"""
    c = table(spark, sf_dir, "customer")
    text_id = lambda x: F.col(x).cast("string")
    kind = F.when(F.col("o_orderstatus") == "F", "CAMPUS_FULL_TIME").when(F.col("o_orderstatus") == "O", "EXPERIENCED").otherwise("SPECIAL_PROGRAM")
    events = table(spark, sf_dir, "orders").select(
        text_id("o_orderkey").alias("id"), text_id("o_custkey").alias("companyId"), text_id("o_custkey").alias("careerPortalId"), F.lit("OFFICIAL_SITE").alias("sourceTier"), kind.alias("recruitmentType"), F.col("o_orderpriority").alias("campaignName"), F.year("o_orderdate").cast("string").alias("cohort"),
        F.lit(None).cast("string").alias("startAt"), F.lit(None).cast("string").alias("closesAt"), F.lit(None).cast("array<string>").alias("locations"), text_id("o_orderkey").alias("directoryUrl"), F.lit("OPEN").alias("status"), F.lit(None).cast("string").alias("lastVerifiedAt"),
    )
    companies = c.select(text_id("c_custkey").alias("id"), F.col("c_name").alias("canonicalName"), F.array("c_mktsegment").alias("industryTags"))
    portals = c.select(text_id("c_custkey").alias("id"), F.lit(None).cast("string").alias("supersededByPortalId"), F.lit(None).cast("string").alias("lastVerifiedAt"))
    jobs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    jobs = jobs.select(text_id("l_orderkey").alias("recruitmentEventId"), F.when(F.col("l_linestatus") == "O", "ACTIVE").otherwise("CLOSED").alias("status"), F.col("p_name").alias("title"), F.array("s_name").alias("locations"))
    rows = rollup.application_rows(events, companies, portals, jobs, ordered=False)
    return rows.select(F.col("url").cast("long").alias("event"), "company", "batch", "titles", "locations")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM documents")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies, by the whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("k"))
    least = d.groupBy("k").agg(F.min("doc_id").alias("class_id"))
    return d.join(least, "k").select("doc_id", "class_id")


_BITS = ", ".join(f"sum(CAST(substr(h, {k // 4 + 1}, 1) IN ({', '.join(repr('0123456789abcdef'[v]) for v in range(16) if v >> (3 - k % 4) & 1)}) AS INTEGER)) AS b{k}" for k in range(64))
_HEX = " || ".join("substr('0123456789abcdef', 1 + " + " + ".join(f"CASE WHEN b{k + j} * 2 > n THEN {8 >> j} ELSE 0 END" for j in range(4)) + ", 1)" for k in range(0, 64, 4))
_FP = f"""
x AS (SELECT doc_id, {_P13} AS t FROM documents),
w AS (SELECT doc_id, string_split(t, ' ') AS w FROM x WHERE length(t) >= 200),
s AS (SELECT doc_id, substr(sha1(list_aggregate(list_slice(w, p, p + 2), 'string_agg', ' ')), 1, 16) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w)),
b AS (SELECT doc_id, count(*) AS n, {_BITS} FROM s GROUP BY doc_id),
f AS (SELECT doc_id, {_HEX} AS fp FROM b)"""


@query(f"WITH {_FP} SELECT doc_id, coalesce(fp, '') AS fingerprint FROM documents LEFT JOIN f USING (doc_id)")
def posting_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14"""
    return table(spark, sf_dir, "documents").select("doc_id", near_dup.fingerprints(F.col("text")).alias("fingerprint"))


@query(f"""
WITH {_FP},
o AS (SELECT fp, min(doc_id) AS id, CAST('0x' || fp AS UBIGINT) AS v FROM f GROUP BY fp)
SELECT a.id AS a, b.id AS b, bit_count(xor(a.v, b.v))::INTEGER AS bits FROM o a JOIN o b ON a.id < b.id WHERE bit_count(xor(a.v, b.v)) <= 5
""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, J5"""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), near_dup.fingerprints(F.col("text")).alias("fingerprint"))
    return near_dup.near_pairs(d)


@query(f"""
WITH {_FP},
o AS (SELECT fp, min(doc_id) AS class_id FROM f GROUP BY fp)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id FROM documents LEFT JOIN f USING (doc_id) LEFT JOIN o USING (fp)
""")
def near_dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stands for it in ``near_dup_pairs``."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), near_dup.fingerprints(F.col("text")).alias("fingerprint"))
    return near_dup.members(d).select(F.col("id").alias("doc_id"), "class_id")


_RATE = lambda n, d: f"round(sum({n}) / nullif(sum({d}), 0), 4)"


@query(f"""
WITH o AS (SELECT *, o_orderstatus = 'O' AS o, o_orderstatus = 'P' AS p, o_orderstatus = 'F' AS f FROM orders JOIN customer ON o_custkey = c_custkey),
q AS (SELECT (o_totalprice > 200000)::INT AS verified, 1 AS one, (o AND o_totalprice > 100000)::INT AS extracted, o::INT AS tried, (p AND o_totalprice > 300000)::INT AS superseded, p::INT AS platform, (o_orderpriority = '1-URGENT')::INT AS dup, (o_orderpriority <> '1-URGENT')::INT AS valid, (f AND c_acctbal < 0)::INT AS wrong, f::INT AS known,
 (c_mktsegment = 'BUILDING')::INT AS unknown, (o_totalprice < 20000)::INT AS blocked, (c_nationkey = 3)::INT AS no_start, (c_nationkey < 5)::INT AS no_close, (c_nationkey = 99)::INT AS no_place, 0 AS never, CASE WHEN f THEN o_totalprice / 1000000 END AS score FROM o)
SELECT {_RATE('verified', 'one')} AS "officialVerificationRate", {_RATE('extracted', 'tried')} AS "jobExtractionSuccessRate", {_RATE('superseded', 'platform')} AS "platformOnlySupersededRate", {_RATE('dup', 'valid')} AS "duplicateRate", {_RATE('wrong', 'known')} AS "falsePositiveRate", {_RATE('unknown', 'one')} AS "unknownAvailabilityRate", {_RATE('blocked', 'one')} AS "blockedRate", {_RATE('no_start', 'valid')} AS "missingStartDateRate", {_RATE('no_close', 'valid')} AS "missingCloseDateRate", {_RATE('no_place', 'valid')} AS "missingLocationRate", round(avg(score), 2) AS "averageConfidenceScore", sum(platform)::BIGINT AS "platformOnlyAcceptanceCount" FROM q
""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counter from a column of the orders and their customers."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    status, price, nation = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("c_nationkey")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    flags = {
        "portalsVerified": price > 200000, "portalsEvaluated": F.lit(True), "extractionSuccesses": (status == "O") & (price > 100000), "extractionAttempts": status == "O", "platformOnlySupersededCount": (status == "P") & (price > 300000), "platformOnlyAcceptanceCount": status == "P",
        "duplicateCandidateResults": urgent, "validCandidateResults": ~urgent, "falsePositiveCount": (status == "F") & (F.col("c_acctbal") < 0), "groundTruthEvaluated": status == "F", "unknownAvailabilityCount": F.col("c_mktsegment") == "BUILDING", "availabilityEvaluated": F.lit(True), "blockedPortals": price < 20000,
        "missingStartDates": nation == 3, "missingCloseDates": nation < 5, "missingLocations": nation == 99, "recruitmentEventsEvaluated": ~urgent,
    }
    return reports.quality(rows.select(*(c.cast("int").alias(n) for n, c in flags.items()), F.when(status == "F", F.array(price / 1000000)).alias("confidenceScores")))


@query("""
WITH d AS (SELECT count(*) AS n, count(*) FILTER (text <> '') AS t, count(*) FILTER (lang <> '') AS l, count(quality) AS q FROM documents LEFT JOIN labels USING (doc_id))
SELECT * FROM (VALUES ('text', (SELECT t FROM d), (SELECT n FROM d), (SELECT round(t / n, 4) FROM d)), ('lang', (SELECT l FROM d), (SELECT n FROM d), (SELECT round(l / n, 4) FROM d)), ('quality', (SELECT q FROM d), (SELECT n FROM d), (SELECT round(q / n, 4) FROM d))) v(field, filled, rows, coverage)
""")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10"""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return reports.field_coverage(d, ["text", "lang", "quality"])


@query("""
WITH l AS (SELECT l_shipdate + INTERVAL 8 HOURS AS local, l_extendedprice / 1e6 AS usd, l_quantity AS q, CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS v, CASE l_linestatus WHEN 'O' THEN 'search_deferred_by_budget' ELSE 'ok' END AS status FROM lineitem),
s AS (SELECT sum(usd) FILTER (local::DATE = DATE '1999-03-15') AS d, sum(usd) AS m, sum(q) AS q, sum(v) AS v, count(*) FILTER (status <> 'ok') AS b, count(*) AS n FROM l WHERE strftime(local, '%Y-%m') = '1999-03')
SELECT round(coalesce(d, 0), 6) AS daily_cost_usd, round(coalesce(m, 0), 6) AS monthly_cost_usd, round(m / q, 6) AS cost_per_query, round(m / v, 6) AS cost_per_verified, round(greatest(0, 0.5 - coalesce(d, 0)), 6) AS daily_left_usd, round(greatest(0, 4.5 - coalesce(m, 0)), 6) AS monthly_left_usd, b AS blocked_by_budget FROM s
""")
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, D10"""
    ledger = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("at"), (F.col("l_extendedprice") / 1e6).alias("usd"), F.col("l_quantity").alias("queries"), (F.col("l_returnflag") == "R").cast("double").alias("verified"), F.when(F.col("l_linestatus") == "O", "search_deferred_by_budget").otherwise("ok").alias("status"))
    return reports.cost(ledger, F.lit("1999-03-15 02:00:00").cast("timestamp"))


_TIER = " ".join(f"WHEN regexp_matches(x, '(?i)\\b(?:{p})\\b') THEN '{n}'" for n, p in rules.TIERS)
_TITLE = "p_name || ' ' || CASE p_size % 9 WHEN 0 THEN 'Senior Engineer' WHEN 1 THEN 'intern' WHEN 2 THEN 'Engineer II' WHEN 3 THEN 'Jr. Associate' WHEN 4 THEN 'VP sales' WHEN 5 THEN 'graduate program' WHEN 6 THEN 'new grad' WHEN 7 THEN 'engineer i' ELSE 'analyst' END"


def _title() -> F.Column:
    names = ["Senior Engineer", "intern", "Engineer II", "Jr. Associate", "VP sales", "graduate program", "new grad", "engineer i", "analyst"]
    return F.concat("p_name", F.lit(" "), F.element_at(F.array(*map(F.lit, names)), (F.col("p_size") % 9 + 1).cast("int")))


@query(f"SELECT p_partkey, CASE {_TIER} WHEN regexp_matches(x, '(?i)\\bgraduate\\b') AND regexp_matches(x, '(?i)\\b(program|scheme)\\b') THEN 'intern' ELSE 'mid' END AS tier FROM (SELECT p_partkey, {_TITLE} AS x FROM part)")
def tier_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8"""
    return table(spark, sf_dir, "part").select("p_partkey", classify.tier(_title()).alias("tier"))


@query(f"""
SELECT p_partkey, CASE WHEN regexp_matches(x, '(?i)new grad|graduate program|university grad|campus|early career|entry[- ]level') THEN 'new_grad_full_time' WHEN regexp_matches(x, '(?i)intern(ship)?|co-?op') THEN 'internship' WHEN NOT regexp_matches(x, '(?i)senior|staff|principal|lead|manager|director') AND regexp_matches(x, '(?i)\\bengineer\\s+(i|1)\\b|\\b(junior|jr\\.?|associate)\\b') THEN 'early_career'
 WHEN p_type = 'PROMO' THEN 'contract' WHEN p_size >= 30 THEN 'experienced_hire' WHEN p_size < 5 THEN 'early_career' ELSE 'unspecified_full_time' END AS job_type FROM (SELECT p_partkey, p_type, p_size, {_TITLE} AS x FROM part)
""")
def job_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9"""
    years = F.when(F.col("p_size") >= 30, 3).when(F.col("p_size") < 5, 1)
    return table(spark, sf_dir, "part").select("p_partkey", classify.job_type(_title(), F.when(F.col("p_type") == "PROMO", "a contract").otherwise(""), years).alias("job_type"))


def _industry_sql() -> str:
    import re

    def has(w: str) -> str:
        k = w.lower().replace("'", "''")
        return f"CAST(regexp_matches(x, '(^|[^a-z0-9]){re.escape(k)}([^a-z0-9]|$)') AS INTEGER)" if re.fullmatch("[a-z0-9+#.]{2,3}", k) else f"CAST(contains(x, '{k}') AS INTEGER)"

    scores = {n: " + ".join([has(w) for w in words if len(w) > 1] or ["0"]) + "".join(f" - CAST(contains(x, '{a}') AS INTEGER)" for a in against) for n, (_, words, against) in rules.INDUSTRIES.items()}
    items = ", ".join(f"{{'s': {s}, 'i': {-i}, 'n': '{n}'}}" for i, (n, s) in enumerate(scores.items()))
    return f"SELECT p_partkey, CASE WHEN m.s > 0 THEN m.n END AS industry FROM (SELECT p_partkey, list_max([{items}]) AS m FROM (SELECT p_partkey, lower(p_name || ' ' || CASE p_partkey % 6 WHEN 0 THEN 'bank audit risk' WHEN 1 THEN 'software backend' WHEN 2 THEN 'solar battery' WHEN 3 THEN 'iot robotics' WHEN 4 THEN 'semiconductor software' ELSE '' END) AS x FROM part))"


@query(_industry_sql())
def industry_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11"""
    words = F.element_at(F.array(*map(F.lit, ["bank audit risk", "software backend", "solar battery", "iot robotics", "semiconductor software", ""])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", classify.industry(F.concat("p_name", F.lit(" "), words)).alias("industry"))


@query("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS h, page_id % 5 AS k, url FROM pages),
q AS (SELECT page_id, k, h, CASE k WHEN 0 THEN 'Example' WHEN 1 THEN 'Other Company' ELSE '' END AS c FROM p)
SELECT page_id, CASE WHEN k = 3 THEN 60 WHEN k = 4 THEN 50 ELSE 100 - CASE WHEN regexp_matches(h, '(^|\\.)spam-farm\\.example\\.org$') THEN 25 ELSE 0 END - CASE WHEN c = 'Other Company' AND NOT regexp_matches(h, 'othercompany|other|company') THEN 15 ELSE 0 END END AS score,
 CASE WHEN k = 3 THEN 'missing_apply_url' WHEN k = 4 THEN 'invalid_url' ELSE concat_ws(',', CASE WHEN regexp_matches(h, '(^|\\.)spam-farm\\.example\\.org$') THEN 'suspicious_domain' END, CASE WHEN c = 'Other Company' AND NOT regexp_matches(h, 'othercompany|other|company') THEN 'company_domain_mismatch' END) END AS flags FROM q
""")
def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C26"""
    k = F.col("page_id") % 5
    t = classify.trust(F.when(k == 3, "").when(k == 4, "ftp://x").otherwise(F.col("url")), F.when(k == 0, "Example").when(k == 1, "Other Company").otherwise(""), ["spam-farm.example.org"])
    return table(spark, sf_dir, "pages").select("page_id", t["score"].cast("long").alias("score"), F.array_join(t["flags"], ",").alias("flags"))


@query("""
WITH s AS (SELECT n_nationkey AS student, n_nationkey % 3 AS want FROM nation),
m AS (SELECT student, p_partkey, 35 * least(1, (CASE WHEN contains(p_name, ['red', 'blue', 'small'][want + 1]) THEN 1 ELSE 0 END) / 2) + 35 * least(1, CASE WHEN p_size % 4 = 0 THEN 0.25 ELSE (student % 3) / (p_size % 4) END) + CASE WHEN p_type = 'PROMO' THEN 15 WHEN p_size > 25 THEN -30 ELSE 0 END + CASE WHEN p_size % 2 = student % 2 THEN 10 ELSE 0 END - CASE WHEN p_type = 'LARGE' THEN 35 ELSE 0 END + 5 AS x FROM s, part)
SELECT student, CASE WHEN v >= 75 THEN 'High' WHEN v >= 55 THEN 'Medium' ELSE 'Low' END AS priority, count(*) AS jobs, sum(v)::BIGINT AS total FROM (SELECT student, greatest(0, least(100, floor(x + 0.5))) AS v FROM m) GROUP BY ALL
""")
def student_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students are a list of configuration, here the 25 nations, so that the product is meant and bounded."""
    s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("student"))
    want = F.element_at(F.array(F.lit("red"), F.lit("blue"), F.lit("small")), (F.col("student") % 3 + 1).cast("int"))
    n = F.col("p_size") % 4
    m = classify.student_match(F.col("p_name").contains(want).cast("int"), F.col("student") % 3, n, F.when(F.col("p_type") == "PROMO", "internship").otherwise("x"), F.when(F.col("p_size") > 25, 2), F.col("p_size") % 2 == F.col("student") % 2, F.col("p_type") == "LARGE", F.lit(True))
    rows = table(spark, sf_dir, "part").join(F.broadcast(s)).select("student", m.alias("m"))
    return rows.groupBy("student", F.col("m.priority").alias("priority")).agg(F.count("*").alias("jobs"), F.sum(F.col("m.score")).cast("long").alias("total"))


@query("""
WITH c AS (SELECT c_custkey AS id, c_custkey // 15 AS k, c_custkey % 2 AS odd FROM customer),
i AS (SELECT id, 'name ' || k AS name, 'd' || (k + odd) || '.com' AS domain FROM c),
s AS (SELECT s_suppkey + 1000000000000 AS target, 'name ' || s_suppkey AS name, 'd' || s_suppkey || '.com' AS domain FROM supplier),
m AS (SELECT id, target FROM i JOIN s ON i.name = s.name UNION SELECT id, target FROM i JOIN s ON i.domain = s.domain),
g AS (SELECT id, count(DISTINCT target) AS n, min(target) AS t FROM m GROUP BY id)
SELECT id, n AS targets, CASE WHEN n = 1 THEN t END AS target, n > 1 AS conflict FROM g
""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers against all suppliers, by keys that few share."""
    none, k = F.lit(None).cast("array<string>"), F.expr("c_custkey div 15")
    domain = lambda x: F.array(F.concat(F.lit("d"), x.cast("string"), F.lit(".com"))).alias("domains")
    name = lambda x: F.concat(F.lit("name "), x.cast("string")).alias("name")
    i = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name(k), domain(k + F.col("c_custkey") % 2), none.alias("aliases"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000_000).alias("id"), name(F.col("s_suppkey")), domain(F.col("s_suppkey")), none.alias("aliases"))
    return resolve.merge_targets(i, s).select("id", F.size("targets").cast("long").alias("targets"), "target", "conflict")


@query("""
WITH o AS (SELECT o_custkey AS id, max(o_orderpriority) AS name, max(o_orderdate) AS seen, min(o_orderdate) AS first, sum(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
n AS (SELECT o_custkey AS id, min(o_orderpriority) AS name, max(o_orderdate) AS seen, min(o_orderdate) AS first, sum(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.name, n.name) AS name, coalesce(n.seen, o.seen)::DATE::VARCHAR AS seen, coalesce(o.first, n.first)::DATE::VARCHAR AS first, round(coalesce(n.v, o.v), 2) AS v FROM o FULL JOIN n ON o.id = n.id
""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is on one of the two sides."""
    o = table(spark, sf_dir, "orders")
    side = lambda rows, f: rows.groupBy(F.col("o_custkey").alias("id")).agg(f("o_orderpriority").alias("name"), F.max("o_orderdate").alias("seen"), F.min("o_orderdate").alias("first"), F.sum("o_totalprice").alias("v"))
    merged = store.upsert(side(o.where("o_orderkey % 2 = 0"), F.max), side(o.where("o_orderkey % 2 = 1"), F.min), ["id"], {"name": store.OLD, "first": store.OLD})
    return merged.select("id", "name", F.col("seen").cast("date").cast("string").alias("seen"), F.col("first").cast("date").cast("string").alias("first"), F.round("v", 2).alias("v"))


@query("""
WITH e AS (SELECT c_nationkey AS company, min(c_custkey) AS by FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN e.by END AS superseded FROM supplier LEFT JOIN e ON s_nationkey = company
""")
def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7"""
    portals = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("companyId"), F.when(F.col("s_suppkey") % 2 == 0, "PLATFORM_ONLY").otherwise("OFFICIAL_SITE").alias("sourceTier"), F.lit(None).cast("long").alias("supersededByPortalId"))
    events = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("companyId"), F.col("c_custkey").alias("careerPortalId"), F.lit("OFFICIAL_SITE").alias("sourceTier"))
    return store.supersede(portals, events).select("id", F.col("supersededByPortalId").alias("superseded"))


@query("""
WITH e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, n_nationkey AS pos FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_suppkey FROM supplier),
h1 AS (SELECT src AS company, dst AS url FROM (SELECT DISTINCT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, n_nationkey AS pos FROM nation) QUALIFY row_number() OVER (PARTITION BY src ORDER BY src, pos) <= 20),
h2 AS (SELECT company, dst AS url FROM h1 JOIN e ON h1.url = e.src QUALIFY row_number() OVER (PARTITION BY company ORDER BY src, pos, dst) <= 20)
SELECT 'r' || r_regionkey AS company, 'r' || r_regionkey AS url, 0 AS depth FROM region UNION ALL SELECT company, url, 1 FROM h1 UNION ALL SELECT company, url, 2 FROM h2
""")
def frontier_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9"""
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    edges = table(spark, sf_dir, "nation").select(tag("r", "n_regionkey").alias("src"), tag("n", "n_nationkey").alias("dst"), F.col("n_nationkey").cast("long").alias("pos"))
    edges = edges.unionByName(table(spark, sf_dir, "supplier").select(tag("n", "s_nationkey").alias("src"), tag("s", "s_suppkey").alias("dst"), F.col("s_suppkey").cast("long").alias("pos")))
    seeds = table(spark, sf_dir, "region").select(tag("r", "r_regionkey").alias("company"), tag("r", "r_regionkey").alias("url"))
    return graph.frontier(seeds, edges)


@query("SELECT day, count(*) AS requests, least(count(*), 12) AS accepted FROM (SELECT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'purchase') GROUP BY day")
def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9, T2"""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id")
    return pick.running_budget(e, "day", 12, F.col("ts"), F.col("event_id")).groupBy("day").agg(F.count("*").alias("requests"), F.count_if("accepted").cast("long").alias("accepted"))


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_type, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_type, count(*) AS requests, count(*) FILTER (before IS NOT NULL AND ts < before + INTERVAL 6 HOURS) AS within_ttl FROM e GROUP BY ALL
""")
def ttl_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that come within six hours of the one before them, by a window."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w))
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("requests"), F.count_if(F.col("ts") < F.col("before") + F.expr("INTERVAL 6 HOURS")).alias("within_ttl"))


@query("""
WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'BLOCKED' WHEN 'signup' THEN 'HEALTHY_PROBE' WHEN 'purchase' THEN 'MANUAL_RESUME_REQUESTED' END AS type FROM events),
k AS (SELECT *, sum(CASE WHEN type = 'HEALTHY_PROBE' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM e WHERE type IS NOT NULL),
m AS (SELECT *, max(epoch) OVER (PARTITION BY user_id) AS last FROM k),
g AS (SELECT user_id, min(ts) FILTER (type = 'BLOCKED') AS opened, max((ts, event_id)) FILTER (type = 'BLOCKED') AS b, max((ts, event_id)) FILTER (type = 'MANUAL_RESUME_REQUESTED') AS r FROM m WHERE epoch = last GROUP BY user_id)
SELECT user_id, CASE WHEN opened IS NULL THEN 'CLOSED' WHEN r > b THEN 'PROBE_REQUIRED' ELSE 'OPEN' END AS state, strftime(opened, '%Y-%m-%d %H:%M:%S') AS opened_at FROM g
""")
def circuit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, W12"""
    from veldra.streaming.state import circuits

    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "BLOCKED").when(F.col("event_type") == "signup", "HEALTHY_PROBE").when(F.col("event_type") == "purchase", "MANUAL_RESUME_REQUESTED")
    events = e.select(F.col("user_id").alias("provider"), F.struct("ts", "event_id").alias("at"), "ts", kind.alias("type")).where("type is not null")
    return circuits(events).select(F.col("provider").alias("user_id"), "state", F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss").alias("opened_at"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 = 3 ORDER BY o_orderkey LIMIT 100")
def shard_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature."""
    return pick.shard(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 7, 3).orderBy("o_orderkey").limit(100)


@query("SELECT event_id, value FROM events ORDER BY ts DESC, event_id LIMIT 50")
def topk_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest events; the limit is the feature."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "value")


@query("SELECT event_type, count(*) AS rows, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over a JSON column, by Spark's own functions."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("k").alias("k"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, length(arg_max(text, turn)) AS last_chars FROM conversations GROUP BY conv_id")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of a conversation in order, by Spark's own functions."""
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), roles.alias("roles"), F.length(F.max_by("text", "turn")).cast("long").alias("last_chars"))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d %H:00:00') AS hour, count(*) AS rows, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-extension: the batch form of ``streaming.events.tumbling``."""
    from veldra.streaming.events import tumbling

    return tumbling(table(spark, sf_dir, "events"), "1 hour")


@query("""
WITH e AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOURS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS rows FROM s GROUP BY user_id, n
""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-extension: the batch form of ``streaming.events.sessions``."""
    from veldra.streaming.events import sessions

    return sessions(table(spark, sf_dir, "events"), "2 hours")


@query("""
WITH s AS (SELECT source, count(*) AS fetched, count(*) FILTER (n_chars >= 500) AS accepted FROM documents GROUP BY source),
p AS (SELECT lang || ':' || (doc_id % 97) AS project, list(DISTINCT source) AS srcs FROM documents GROUP BY 1),
u AS (SELECT unnest(srcs) AS source, len(srcs) = 1 AS alone FROM p),
c AS (SELECT source, count(*) FILTER (alone) AS unique_projects, count(*) FILTER (NOT alone) AS merged_projects FROM u GROUP BY source)
SELECT source, fetched, accepted, coalesce(unique_projects, 0) AS unique_projects, coalesce(merged_projects, 0) AS merged_projects FROM s FULL JOIN c USING (source)
""")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11"""
    d = table(spark, sf_dir, "documents")
    projects = d.groupBy(F.concat_ws(":", "lang", (F.col("doc_id") % 97).cast("string")).alias("project_id")).agg(F.collect_set("source").alias("sources"))
    return reports.source_coverage(d.select("source", (F.col("n_chars") >= 500).alias("accepted")), projects)


@query("""
WITH r AS (SELECT doc_id % 900 AS id, source, lang, n_chars, doc_id FROM documents),
t AS (SELECT id, unnest(list_filter([CASE WHEN n_chars < 100 THEN 'missing_title' END, CASE WHEN lang <> 'en' AND doc_id % 2 = 0 THEN 'campus_cohort_unknown' END], lambda x: x IS NOT NULL)) AS type FROM r),
d AS (SELECT id, count(*) AS n FROM r GROUP BY id HAVING count(*) > 1)
SELECT type, count(*) AS rows FROM (SELECT type FROM t UNION ALL SELECT 'duplicate_id' FROM d, range(d.n - 1)) GROUP BY type
""")
def database_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, W11"""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 900).alias("id"), F.col("source").alias("company"), F.when(F.col("n_chars") >= 100, F.col("lang")).alias("title"), F.col("source").alias("primary_url"), F.lit(0).alias("n_links"), F.lit(0).alias("posted_at"), F.when(F.col("lang") != "en", "campus").alias("scope"), F.when(F.col("doc_id") % 2 == 1, 2026).alias("cohort_year"))
    return reports.anomalies(d, 0).groupBy("type").agg(F.count("*").alias("rows"))


@query("""
SELECT page_id, CASE WHEN host LIKE '%.example.org' THEN 'org' WHEN host LIKE '%.example.net' THEN 'net' END AS entry FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages) WHERE host LIKE '%.example.org' OR host LIKE '%.example.net'
""")
def registry_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, U7"""
    registry = spark.createDataFrame([("example.org", "org"), ("example.net", "net"), ("nowhere.com", "no")], "domain string, entry string")
    return resolve.domain_hits(table(spark, sf_dir, "pages").select("page_id", "url"), registry).select("page_id", "entry")


@query("""
WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '2026-0' || (doc_id % 9 + 1) || '-' || (doc_id % 40 + 1) ELSE '发布于2025年' || (doc_id % 14 + 1) || '月' || (doc_id % 30 + 1) || '日。' END AS x FROM documents)
SELECT doc_id, strftime(try_strptime(CASE WHEN doc_id % 3 = 0 THEN x ELSE '2025-' || regexp_extract(x, '年(\\d+)月', 1) || '-' || regexp_extract(x, '月(\\d+)日', 1) END, '%Y-%-m-%-d'), '%Y-%m-%d') AS day FROM d
""")
def explicit_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1"""
    i = F.col("doc_id")
    s = lambda n: (i % n + 1).cast("string")
    x = F.when(i % 3 == 0, F.concat(F.lit("2026-0"), s(9), F.lit("-"), s(40))).otherwise(F.concat(F.lit("发布于2025年"), s(14), F.lit("月"), s(30), F.lit("日。")))
    return table(spark, sf_dir, "documents").select("doc_id", dates.explicit_date(x).cast("string").alias("day"))


@query("""
SELECT c_custkey AS id, c_mktsegment AS segment, upper('cn') || '|' || regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g') || '|' || lower(c_mktsegment) || '|' || CAST(c_nationkey AS VARCHAR) AS result_key, sha256(CAST(c_custkey AS VARCHAR) || '|CAMPUS_FULL_TIME|2026|https://a.example.com/' || c_nationkey) AS event_id FROM customer
""")
def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11"""
    nation = F.col("c_nationkey").cast("string")
    event = dates.event_id(F.col("c_custkey").cast("string"), F.lit("campus_full_time"), F.lit("2026"), F.concat(F.lit("https://a.example.com/"), nation, F.lit("#top")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), dates.result_key(F.lit("cn"), F.col("c_name"), F.col("c_mktsegment"), nation, True).alias("result_key"), event.alias("event_id"))


@query("""
WITH x AS (SELECT p_partkey, list_transform(string_split(p_name || ', ' || p_type || '/' || p_brand || '、' || p_name, '/'), lambda v: v) AS a, p_name || ', ' || p_type || '/' || p_brand || '、' || p_name AS raw FROM part)
SELECT p_partkey, (SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT trim(v) AS v, min(k) AS k FROM (SELECT unnest(regexp_split_to_array(raw, '[、，,/|]')) AS v, generate_subscripts(regexp_split_to_array(raw, '[、，,/|]'), 1) AS k) GROUP BY trim(v))) AS places FROM x
""")
def location_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P26, M1"""
    raw = F.concat("p_name", F.lit(", "), "p_type", F.lit("/"), "p_brand", F.lit("、"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(values.unique_strings(text.locations(raw)), "|").alias("places"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_retailprice * 2080 WHEN 1 THEN p_retailprice * 12 WHEN 2 THEN p_retailprice END AS low, CASE p_size % 4 WHEN 0 THEN p_retailprice * 1.5 * 2080 WHEN 1 THEN p_retailprice * 1.5 * 12 WHEN 2 THEN p_retailprice * 1.5 END AS high FROM part")
def salary_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25"""
    interval = F.element_at(F.array(F.lit("1 HOUR"), F.lit("1 MONTH"), F.lit("1 YEAR"), F.lit("1 MOON")), (F.col("p_size") % 4 + 1).cast("int"))
    pay = text.annual_salary(F.col("p_retailprice") * 1.5, F.col("p_retailprice"), interval, F.lit("usd"))
    return table(spark, sf_dir, "part").select("p_partkey", pay["min"].alias("low"), pay["max"].alias("high"))


# further queries register themselves
from veldra.plans import join_queries, operator_queries, rule_queries, scan_queries, source_queries  # noqa: E402, F401
