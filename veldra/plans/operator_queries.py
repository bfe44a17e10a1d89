"""More queries with their SQL: operators on stand-ins of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.functions import text, urls
from veldra.operators import builders, filters, pick, reports, resolve, rollup, store, verify
from veldra.plans.queries import query, table


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events WHERE event_type NOT IN ('error', 'signup')) WHERE rank <= 3")
def natural_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12"""
    kind = F.when(F.col("event_type") == "error", "Ad").when(F.col("event_type") == "signup", "news").when(F.col("event_type") == "view", "organic")
    rows = table(spark, sf_dir, "events").withColumn("kind", kind)
    return filters.natural_results(rows, ["user_id"], 3, F.col("ts"), F.col("event_id")).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE (c_nationkey % 3 <> 0 AND c_acctbal > 5000) OR (c_nationkey % 3 = 0 AND c_acctbal < 1000 AND o_orderstatus = 'O')")
def formal_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14, J2"""
    openings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("careerPortalId"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("CLOSED").alias("status"))
    portals = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 5000, "VERIFIED").otherwise("REVIEW").alias("verificationStatus"), (F.col("c_acctbal") < 1000).alias("platformIdentityConfirmed"), F.when(F.col("c_nationkey") % 3 == 0, "PLATFORM_ONLY").otherwise("OFFICIAL_SITE").alias("sourceTier"))
    return filters.formal_openings(openings, portals).select("id")


@query("SELECT o_orderkey, o_custkey AS \"companyId\" FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def pending_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15"""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("companyId"), F.when(F.col("o_orderstatus") == "F", "AUTO_ACCEPT").when(F.col("o_orderstatus") == "O", "MANUAL_REVIEW").alias("verdict"))
    companies = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("companyId"))
    return filters.pending_candidates(rows, companies).select("o_orderkey", "companyId")


@query("SELECT 'jobs in nation ' || n AS text, CASE WHEN p % 2 = 0 THEN 'p' ELSE '' END AS providers, CASE WHEN p % 3 = 0 THEN 20 ELSE 8 END AS top FROM (SELECT s_nationkey AS n, min(s_suppkey) AS p FROM supplier GROUP BY 1 ORDER BY 2 LIMIT 20)")
def plan_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """at most 20 queries are what a plan holds."""
    s = table(spark, sf_dir, "supplier")
    queries = s.select(F.col("s_suppkey").alias("pos"), F.concat(F.lit("  jobs in \t nation "), F.col("s_nationkey").cast("string")).alias("text"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("x"), F.lit("p"))).alias("providers"), F.when(F.col("s_suppkey") % 3 == 0, 99).alias("topK"))
    return filters.plan_queries(queries, ["p", "q"]).select("text", F.array_join("providers", ",").alias("providers"), F.col("topK").cast("int").alias("top"))


@query("""
WITH l AS (SELECT s_suppkey AS lead, s_nationkey % 5 AS c, CASE s_suppkey % 3 WHEN 0 THEN 'red widget' WHEN 1 THEN 'small ring expert' ELSE 'pilot' END AS t FROM supplier),
j AS (SELECT p_partkey AS pos, p_partkey % 5 AS c, p_name AS t FROM part),
m AS (SELECT lead, arg_min('https://j.example.com/' || pos, pos) AS url FROM l JOIN j USING (c) WHERE l.t = j.t OR len(list_intersect(string_split(l.t, ' '), string_split(j.t, ' '))) / least(len(list_distinct(string_split(l.t, ' '))), len(list_distinct(string_split(j.t, ' ')))) >= 0.6 GROUP BY lead)
SELECT lead, url AS official_url FROM l LEFT JOIN m USING (lead)
""")
def promote_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, P32"""
    company = lambda c: F.concat(F.lit("Firm "), (F.col(c) % 5).cast("string"), F.lit(" Inc")).alias("company")
    title = F.element_at(F.array(F.lit("red widget"), F.lit("small ring expert"), F.lit("pilot")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    leads = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("lead"), company("s_nationkey"), title.alias("title"))
    jobs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), company("p_partkey"), F.col("p_name").alias("title"), F.concat(F.lit("https://j.example.com/"), F.col("p_partkey").cast("string")).alias("url"))
    with_job, without = resolve.promote_leads(leads, jobs)
    return with_job.select("lead", "official_url").unionByName(without.select("lead", F.lit(None).cast("string").alias("official_url")))


@query("""
SELECT c_custkey AS id, CASE WHEN k < 20 THEN 'c' || k WHEN k < 30 THEN 'c' || (k - 20) ELSE 'firm' || k END AS "companyId", CASE WHEN k < 30 THEN 'known_alias' ELSE 'legal_suffix_normalization' END AS "matchedBy", CASE WHEN k < 30 THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence FROM (SELECT c_custkey, c_custkey % 40 AS k FROM customer)
""")
def resolve_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firms below 20 are known by name, those up to 30 as aliases of others."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Firm"), (F.col("c_custkey") % 40).cast("string"), F.lit("公司")).alias("company"))
    names = lambda n: F.concat(F.lit("Firm"), n.cast("string"))
    companies = spark.range(20).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("companyId"), names(F.col("id")).alias("canonicalName"), F.when(F.col("id") < 10, F.array(names(F.col("id") + 20))).alias("aliases"), F.col("id").alias("pos"))
    return resolve.resolve_companies(rows, companies).select("id", "companyId", "matchedBy", "confidence")


@query("SELECT 'https://u.example.com/' || (o_orderkey % 500) AS url, count(DISTINCT o_custkey) AS records FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1")
def shared_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17"""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.concat(F.lit("https://u.example.com/"), (F.col("o_orderkey") % 500).cast("string"))).alias("urls"))
    return resolve.shared_urls(o)


@query("""
WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events WHERE event_type <> 'view' GROUP BY user_id)
SELECT c_custkey AS id, s.status, CASE WHEN s.status IS NULL THEN 'FETCH_FAILED' ELSE 'FETCHED' END AS outcome FROM customer LEFT JOIN s ON user_id = c_custkey
""")
def lookup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14, S32"""
    url = lambda c: F.concat(F.lit("https://p.example.com/"), F.col(c).cast("string"))
    pages = table(spark, sf_dir, "events").where("event_type <> 'view'").select(url("user_id").alias("requestedUrl"), url("user_id").alias("finalUrl"), F.col("event_type").alias("status"), F.lit("").alias("html"), F.struct("ts", "event_id").alias("seq"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), url("c_custkey").alias("url"))
    return resolve.lookup_pages(asked, pages).select("id", "status", "outcome")


@query("SELECT p_brand AS project, o_orderkey FROM (SELECT DISTINCT p_brand, p_partkey % 50 AS q FROM part) JOIN orders ON o_orderkey % 50 = q")
def fan_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15"""
    queries = table(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), (F.col("p_partkey") % 50).alias("query")).distinct()
    return resolve.fan_back(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 50).alias("query")), queries).select("project", "o_orderkey")


@query("SELECT o_custkey, count(*) AS rows FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11"""
    return pick.duplicate_ids(table(spark, sf_dir, "orders"), "o_custkey")


@query("""
WITH f AS (SELECT user_id, min(date_trunc('hour', ts)) AS h FROM events WHERE value > 40 GROUP BY user_id)
SELECT user_id, count(*) AS rows FROM events LEFT JOIN f USING (user_id) WHERE h IS NULL OR date_trunc('hour', ts) <= h GROUP BY user_id
""")
def until_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9"""
    e = table(spark, sf_dir, "events").withColumn("round", F.date_trunc("hour", "ts"))
    return pick.until_confident(e, ["user_id"], "round", F.col("value") > 40).groupBy("user_id").agg(F.count("*").alias("rows"))


@query("SELECT c_custkey AS id, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def merge_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5, E6"""
    side = lambda t, p: table(spark, sf_dir, t).select(F.col(f"{p}key").alias("id"), F.col("c_acctbal" if t == "customer" else "s_acctbal").alias("v"))
    return pick.merge_keyed(side("customer", "c_cust"), side("supplier", "s_supp"), ["id"])


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new ' || c_custkey FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2"""
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("new "), F.col("c_custkey").cast("string")).alias("name"))
    return store.insert_or_ignore(old, new.unionByName(new), ["id"])


@query("SELECT o_custkey AS portal, o_orderkey AS code FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, -o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4"""
    o = table(spark, sf_dir, "orders")
    old = o.select(F.col("o_custkey").alias("portal"), F.col("o_orderkey").alias("code"))
    return store.replace_children(old, o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("portal"), (-F.col("o_orderkey")).alias("code")), "portal")


@query("""
WITH o AS (SELECT c_custkey AS id, c_acctbal AS d, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS company FROM customer),
n AS (SELECT o_custkey AS id, count(*) AS k, max(o_totalprice) AS p, max(o_orderkey) AS seen FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o.id, CASE WHEN o.company <> '' OR n.id IS NULL THEN o.company ELSE 'in ' || o.id END AS company, CASE WHEN n.id IS NULL THEN o.id * 100 ELSE greatest(o.id * 100, n.seen) END AS "postedAt", CASE WHEN n.id IS NULL THEN 2 ELSE 3 END AS "seenCount",
 CASE WHEN n.id IS NOT NULL THEN 'Rome' ELSE '' END AS location, CASE WHEN n.id IS NOT NULL THEN false ELSE true END AS "newInRun" FROM o LEFT JOIN n ON o.id = n.id
""")
def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: the longest-lived rules: filled names and places, the later date, one more sighting, nothing new any more."""
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("company"), (F.col("c_custkey") * 100).cast("long").alias("postedAt"), F.lit(2).alias("seenCount"), F.lit("").alias("location"), F.lit(True).alias("newInRun"))
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").cast("long").alias("postedAt"))
    new = new.select("id", F.concat(F.lit("in "), F.col("id").cast("string")).alias("company"), "postedAt", F.lit(1).alias("seenCount"), F.lit("Rome").alias("location"), F.lit(True).alias("newInRun"))
    return store.merge_records(old, new.join(c.select(F.col("c_custkey").alias("id")), "id", "left_semi"))


@query("""
WITH i AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'FAILED' ELSE 'SUCCEEDED' END AS s, o_custkey % 2 AS b FROM orders)
SELECT k, CASE WHEN b = 1 AND s IN ('PENDING', 'FAILED') THEN CASE WHEN k % 3 = 0 THEN 'SUCCEEDED' ELSE 'RUNNING' END ELSE CASE WHEN b = 1 AND k % 3 = 0 THEN 'SUCCEEDED' ELSE s END END AS status, CASE WHEN b = 1 AND s IN ('PENDING', 'FAILED') THEN 2 ELSE 1 END AS attempts FROM i
""")
def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one batch start, pending and failed ones, and a third of the results come in."""
    o = table(spark, sf_dir, "orders")
    items = o.select(F.concat(F.lit("b"), (F.col("o_custkey") % 2).cast("string")).alias("batchId"), F.col("o_orderkey").alias("itemKey"), F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("SUCCEEDED").alias("status"), F.lit(1).alias("attemptCount"), F.lit(None).cast("string").alias("errorMessage"))
    results = o.where("o_orderkey % 3 = 0 and o_custkey % 2 = 1").select(F.lit("b1").alias("batchId"), F.col("o_orderkey").alias("itemKey"), F.lit("SUCCEEDED").alias("status"), F.lit(None).cast("string").alias("errorMessage"))
    return store.complete_items(store.start_items(items, "b1", retry=True), results).select(F.col("itemKey").alias("k"), "status", F.col("attemptCount").alias("attempts"))


@query("""
WITH e AS (SELECT o_custkey AS id, min(strftime(o_orderdate, '%Y-%m-%d')) AS start_at, arg_min(o_totalprice, o_orderkey) AS first_seen_at FROM orders GROUP BY 1),
l AS (SELECT o_custkey AS id, string_agg(p, ',' ORDER BY k) AS locations FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY 1)
SELECT id, start_at, first_seen_at, locations FROM e JOIN l USING (id)
""")
def merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5"""
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("seq"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_at"), F.lit(None).cast("string").alias("closes_at"), F.col("o_totalprice").alias("first_seen_at"), F.array("o_orderpriority").alias("locations"))
    return rollup.merge_events(e).select(F.col("event_id").alias("id"), "start_at", "first_seen_at", F.array_join("locations", ",").alias("locations"))


@query("SELECT 'vendor' AS dimension, o_orderstatus AS value, count(*) AS rows FROM orders GROUP BY 2 UNION ALL SELECT 'type', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'company', o_custkey::VARCHAR, count(*) FROM orders GROUP BY 2")
def knowledge_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17"""
    return rollup.knowledge_baseline(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("vendor"), F.col("o_orderpriority").alias("type"), F.col("o_custkey").cast("string").alias("company")))


@query("SELECT count(*) FILTER (c_acctbal >= 0) AS kept, count(*) FILTER (c_acctbal < 0) AS quarantined, count(*) FILTER (c_nationkey = 3) AS remapped FROM customer")
def quarantine_and_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7, X16, E3"""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("companyId"), "c_acctbal")
    kept, bad = store.quarantine(c, F.col("c_acctbal") < 0)
    moved = store.remap(c, spark.createDataFrame([(3, 1000), (4, None)], "id long, target long"))
    tag = lambda df, t: df.select(F.lit(t).alias("t"))
    rows = tag(kept, "kept").unionByName(tag(bad, "quarantined")).unionByName(tag(moved.where("companyId = 1000"), "remapped"))
    return rows.agg(*(F.count_if(F.col("t") == t).cast("long").alias(t) for t in ("kept", "quarantined", "remapped")))


@query("""
WITH a AS (SELECT user_id, event_id, event_type, ts, CASE event_type WHEN 'purchase' THEN 'success' ELSE 'failed' END AS s FROM events),
f AS (SELECT user_id, count(*) AS attempts, min((ts, event_id)) FILTER (s = 'success') AS ok, max((ts, event_id)) AS last FROM a GROUP BY user_id)
SELECT f.user_id AS query, a.event_type AS provider, a.s AS status, attempts FROM f JOIN a ON a.user_id = f.user_id AND a.event_id = CASE WHEN ok IS NOT NULL THEN ok[2] ELSE last[2] END
""")
def search_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6"""
    from veldra.streaming.state import route

    e = table(spark, sf_dir, "events")
    return route(e.select(F.col("user_id").alias("query"), F.unix_micros("ts").alias("pos"), F.col("event_type").alias("provider"), F.when(F.col("event_type") == "purchase", "success").otherwise("failed").alias("status")))


@query("""
WITH g AS (SELECT event_type, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS gap FROM events)
SELECT event_type AS provider, count(*) AS searches, count(*) FILTER (gap < 60 * 1000000) AS too_soon FROM g GROUP BY 1
""")
def search_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4"""
    from veldra.streaming.state import intervals

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), "ts")
    return intervals(e, 60).groupBy("provider").agg(F.count("*").alias("searches"), F.count_if("too_soon").cast("long").alias("too_soon"))


@query("""
WITH m AS (SELECT max(ts) AS now FROM events)
SELECT user_id, event_type, event_id FROM events, m WHERE ts + INTERVAL 5 DAYS > now QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1
""")
def latest_unexpired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest entry of each key that hasn't expired."""
    from veldra.streaming.events import latest_unexpired as latest

    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    now = e.agg(F.max("ts").alias("now")).head()["now"]
    return latest(e, ["user_id", "event_type"], F.lit(now), "5 DAYS").select("user_id", "event_type", "event_id")


@query("SELECT o_orderkey, c_custkey IS NULL AS orphan FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13"""
    parents = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return verify.key_violations(table(spark, sf_dir, "orders"), parents, "o_custkey", "orphan").select("o_orderkey", "orphan")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0 AND s_nationkey < 20")
def registered_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12"""
    vendor = F.when(F.col("n_nationkey") % 2 == 0, "moka").otherwise("lever")
    tenants = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(vendor.alias("vendor"), F.col("n_name").alias("tenant"), F.col("n_nationkey").alias("company"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("moka").alias("vendor"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("tenant"), F.col("s_nationkey").alias("company"))
    return verify.registered(s, tenants).select("s_suppkey")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_totalprice > 300000) AS large, count(DISTINCT o_custkey) AS customers, count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_custkey END) AS waiting FROM orders")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, A16, A18, A19, A22, A23"""
    o = table(spark, sf_dir, "orders")
    rows = reports.flag_counts(o, {"done": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 300000})
    keys = reports.flag_counts(o, {"customers": F.lit(True), "waiting": F.col("o_orderstatus") == "P"}, "o_custkey")
    return rows.join(keys)


@query("""
WITH b AS (SELECT o_custkey AS batch, count(*) AS items, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 5 > 0) AS succeeded, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 5 = 0) AS failed, count(*) FILTER (o_orderstatus = 'P') AS deferred, count(*) FILTER (o_orderstatus = 'O') AS pending FROM orders GROUP BY 1)
SELECT *, CASE WHEN failed > 0 THEN 'COMPLETE_WITH_ERRORS' WHEN pending + deferred > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM b
""")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22, T5"""
    status = F.when(F.col("o_orderstatus") == "P", "DEFERRED").when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderkey") % 5 == 0, "FAILED").otherwise("SUCCEEDED")
    out = reports.batch_status(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batchId"), status.alias("status")))
    return out.select(F.col("batchId").alias("batch"), "items", "succeeded", "failed", "deferred", "pending", "status")


@query("SELECT o_orderpriority AS decision, count(*) AS links, count(DISTINCT o_custkey) AS records FROM orders GROUP BY 1")
def link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14"""
    one = F.array(F.struct(F.concat(F.lit("https://a.example.com/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderpriority").alias("decision")))
    return reports.link_audit(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), one.alias("links")))


@query("SELECT o_orderstatus AS verdict, count(*) AS candidates, count(DISTINCT o_custkey) AS companies FROM orders GROUP BY 1")
def verdict_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20"""
    return reports.verdict_metrics(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("verdict"), F.col("o_custkey").alias("companyId")))


@query("""
WITH p AS (SELECT s_nationkey AS c, bool_or(s_acctbal > 8000) AS active, bool_or(s_acctbal BETWEEN 4000 AND 8000) AS nothing, bool_or(s_acctbal < 1000) AS shut FROM supplier GROUP BY 1),
r AS (SELECT n_nationkey AS company, CASE WHEN coalesce(active, false) THEN 'OFFICIAL_SOURCE_AVAILABLE' WHEN n_nationkey % 4 = 0 THEN 'PLATFORM_IDENTITY_OR_JOBS_MISSING' WHEN coalesce(nothing, false) THEN 'OFFICIAL_NO_OPENINGS' WHEN coalesce(shut, false) THEN 'OFFICIAL_INACCESSIBLE' ELSE 'NO_OFFICIAL_FOUND' END AS reason FROM nation LEFT JOIN p ON c = n_nationkey)
SELECT company, reason, reason IN ('OFFICIAL_NO_OPENINGS', 'OFFICIAL_INACCESSIBLE', 'NO_OFFICIAL_FOUND') AS publish FROM r
""")
def platform_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2"""
    a = F.col("s_acctbal")
    seen = F.when(a > 8000, "OPENINGS_FOUND").when(a.between(4000, 8000), "NO_OPENINGS").otherwise("x")
    portals = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("company"), F.when(a < 1000, "BLOCKED").otherwise("VERIFIED").alias("status"), seen.alias("availability"))
    platforms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("company"), (F.col("n_nationkey") % 4 != 0).alias("confirmed"), F.lit(3).alias("n_jobs"))
    return verify.platform_fallback(portals, platforms).select("company", "reason", "publish")


@query("""
SELECT p_partkey AS intent, CASE WHEN contains(p_name, 'red') THEN 'colour' WHEN contains(p_name, 'ring') THEN 'shape' END AS family FROM part
""")
def occupations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C25"""
    taxonomy = spark.createDataFrame([(0, "colour", ["RED"], ["t"]), (1, "shape", ["ring", "red"], ["u"])], "pos int, family string, terms array<string>, titles array<string>")
    return builders.occupations(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("intent"), F.col("p_name").alias("role")), taxonomy).select("intent", "family")


@query("SELECT CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'unknown' END AS actor, round(sum(l_extendedprice / 1e6), 6) AS usd FROM lineitem WHERE strftime(l_shipdate + INTERVAL 8 HOURS, '%Y-%m') = '1999-03' GROUP BY 1")
def cost_by_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, D10"""
    actor = F.when(F.col("l_linenumber") % 3 == 0, "a").when(F.col("l_linenumber") % 3 == 1, "b")
    return reports.cost_by(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("at"), (F.col("l_extendedprice") / 1e6).alias("usd"), actor.alias("actor")), "actor", "1999-03")
