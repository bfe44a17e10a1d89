import random

import pytest
from pyspark.sql import functions as F

from veldra.operators import builders, graph, near_dup, pick, reports, resolve, rollup, store, verify


def test_picks_do_not_depend_on_the_order_of_rows(spark):
    rows = [(k % 7, k, (k * 37) % 11, f"v{k}") for k in range(200)]
    random.Random(0).shuffle(rows)
    for n in (1, 5):
        df = spark.createDataFrame(rows, "k int, seq int, score int, v string").repartition(n)
        firsts = {r.k: r.seq for r in pick.first_by(df, ["k"], F.col("seq")).collect()}
        lasts = {r.k: r.seq for r in pick.last_by(df, ["k"], F.col("seq")).collect()}
        best = {r.k: (r.score, r.seq) for r in pick.best_by(df, ["k"], F.col("score"), F.col("seq")).collect()}
        assert firsts == {k: k for k in range(7)}
        assert lasts == {k: max(s for q, s, _, _ in rows if q == k) for k in range(7)}
        assert best == {k: max(((sc, s) for q, s, sc, _ in rows if q == k), key=lambda x: (x[0], -x[1])) for k in range(7)}


def test_picks_keep_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1, None), (None, 2, "x"), (1, 1, None)], "k int, seq int, v string")
    assert sorted((str(r.k), r.seq, r.v) for r in pick.first_by(df, ["k"], F.col("seq")).collect()) == [("1", 1, None), ("None", 1, None)]
    assert pick.first_by(df.limit(0), ["k"], F.col("seq")).count() == 0


def test_dedupe_jobs(spark):
    rows = [
        ("NA", "https://a.com/1?utm_source=x", "Acme Inc", "Dev", "Rome", "short", None, "discovery", 0),
        ("NA", "https://a.com/1", "Acme", "Dev", "Rome", "a longer text", None, "discovery", 1),
        ("NA", "https://boards.io/9", "ACME", "dev", "rome", "x", None, "official_ats", 2),
        ("CN", "https://a.com/1", "Acme", "Dev", "Rome", "x", None, "discovery", 3),
    ]
    df = spark.createDataFrame(rows, "region string, url string, company string, title string, location string, description string, posted_at long, source_type string, seq int")
    got = {r.region: r for r in pick.dedupe_jobs(df).collect()}
    assert (got["NA"].url, got["NA"].alternate_urls, got["NA"].cross_source) == ("https://boards.io/9", ["https://a.com/1"], True)
    assert not got["CN"].cross_source


def test_merge_results(spark):
    df = spark.createDataFrame([("k", 0, "a", "x", False, ["1", "2"]), ("k", 2, "", None, True, ["2", "3"]), ("k", 1, "b", "y", None, None)], "k string, seq int, c string, d string, f boolean, l array<string>")
    r = pick.merge_results(df, ["k"], ["c"], ["d"], ["f"], ["l"]).head()
    assert (r.c, r.d, r.f, r.l, r.merged) == ("b", None, True, ["1", "2", "3"], 3)


def test_rounds_shards_samples(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, False), ("b", 2, False)], "k string, round int, ok boolean")
    assert sorted((r.k, r.round) for r in pick.until_confident(df, ["k"], "round", F.col("ok")).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    ids = spark.range(100).withColumnRenamed("id", "seq")
    assert sorted(r.seq for k in range(3) for r in pick.shard(ids, "seq", 3, k).collect()) == list(range(100))
    a, b = ({r.seq for r in pick.sample(ids.repartition(n), 10, 5, "seq").collect()} for n in (1, 7))
    assert a == b and len(a) == 10
    one, two = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "a int, c int")
    assert sorted(map(str, pick.append_all(one, two).collect())) == ["Row(a=1, b=2, c=None)", "Row(a=3, b=None, c=4)"]


def test_verdicts(spark):
    e = [("v", "official_domain_match", "CAREER_HOME", 0), ("v", "official_domain_match", "CAREER_HOME", 1), ("v", "recruitment_structure", "CAREER_HOME", 2), ("n", "recruitment_structure", "JOB_LIST", 0), ("h", "official_domain_match", "JOB_LIST", 0), ("h", "aggregator_domain", "JOB_LIST", 1), ("b", "official_domain_match", "JOB_LIST", 0), ("b", "blocked_page", "JOB_LIST", 1), ("r", "official_domain_match", "UNKNOWN", 0), ("r", "recruitment_structure", "UNKNOWN", 1)]
    df = spark.createDataFrame(e, "portal string, code string, page_type string, seq int")
    got = {r.portal: (r.score, r.status) for r in verify.verdicts(df, "portal", "page_type", F.col("seq")).collect()}
    assert got == {"v": (50, "VERIFIED"), "n": (15, "REJECTED"), "h": (0, "REJECTED"), "b": (35, "BLOCKED"), "r": (50, "REVIEW")}
    assert verify.unknown_codes(spark.createDataFrame([("x", "nope", "", 0)], df.schema)).count() == 1


def test_page_evidence(spark):
    rows = [("p1", "https://jobs.acme.com/", "<p>岗位 立即投递</p>", "Acme", "acme.com", False, True), ("p2", "https://www.zhipin.com/x", "<p>job</p>", "A", "", False, False), ("p3", "https://acme.mokahr.com/", "<p>x</p>", "A", "", True, False)]
    df = spark.createDataFrame(rows, "portal string, url string, html string, company string, official_domain string, tenant_verified boolean, official_linked boolean")
    got = {}
    for r in verify.page_evidence(df).collect():
        got.setdefault(r.portal, set()).add(r.code)
    assert got == {"p1": {"official_domain_match", "recruitment_structure", "apply_action", "official_site_backlink"}, "p2": {"recruitment_structure", "aggregator_domain"}, "p3": {"verified_ats_tenant"}}


def test_platform_fallback(spark):
    own = spark.createDataFrame([("a", "VERIFIED", "OPENINGS_FOUND"), ("b", "VERIFIED", "NO_OPENINGS"), ("c", "BLOCKED", "UNKNOWN")], "company string, status string, availability string")
    platform = spark.createDataFrame([(c, True, 1) for c in "abcd"] + [("e", True, 0)], "company string, confirmed boolean, n_jobs int")
    got = {r.company: (r.publish, r.reason) for r in verify.platform_fallback(own, platform).collect()}
    assert got == {"a": (False, "OFFICIAL_SOURCE_AVAILABLE"), "b": (True, "OFFICIAL_NO_OPENINGS"), "c": (True, "OFFICIAL_INACCESSIBLE"), "d": (True, "NO_OFFICIAL_FOUND"), "e": (False, "PLATFORM_IDENTITY_OR_JOBS_MISSING")}


def test_fingerprints_native_and_vectorised_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    a = {r.id: r.fingerprint for r in near_dup.native_fingerprints(docs, "doc_id", "text").collect()}
    b = {r.doc_id: r.f for r in docs.select("doc_id", near_dup.fingerprints(F.col("text")).alias("f")).collect()}
    assert a == b and near_dup.fingerprint("short") == "" and near_dup.fingerprint(None) == ""


def test_band_join_equals_the_nested_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), near_dup.fingerprints(F.col("text")).alias("fingerprint"))
    rows = {}
    for r in sorted(docs.where("fingerprint <> ''").collect()):
        rows.setdefault(r.fingerprint, r.id)
    ids = [(i, int(f, 16)) for f, i in rows.items()]
    want = {(min(a, b), max(a, b), (x ^ y).bit_count()) for a, x in ids for b, y in ids if a < b and (x ^ y).bit_count() <= 5}
    assert {(r.a, r.b, r.bits) for r in near_dup.near_pairs(docs).collect()} == want


def test_members_has_a_row_of_every_document(spark):
    a, b = "00ff00ff00ff00ff", "ffff0000ffff0000"
    docs = spark.createDataFrame([(5, a), (3, a), (4, a), (9, b), (1, ""), (2, ""), (7, None)], "id long, fingerprint string")
    assert sorted(tuple(r) for r in near_dup.members(docs).collect()) == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 3), (7, 7), (9, 9)]


def test_cross_listings(spark):
    base = "00ff00ff00ff00ff"
    near = f"{int(base, 16) ^ 0b10110:016x}"
    offers = spark.createDataFrame([("u1", "Acme", base), ("u2", "Acme", "")], "url string, company string, fingerprint string")
    history = spark.createDataFrame([("h1", "Agency", near, "2026-01-01"), ("h2", "ACME", near, "2026-01-01"), ("u1", "Agency", base, "2026-01-01"), ("h3", "Agency", near, "2025-01-01"), ("h4", "Agency", f"{int(base, 16) ^ 0x3F:016x}", "2026-01-01")], "url string, company string, fingerprint string, seen string").withColumn("seen", F.to_date("seen"))
    got = near_dup.cross_listings(offers, history, F.to_date(F.lit("2026-01-31"))).collect()
    assert [(r.offer_url, r.row_url, r.score) for r in got] == [("u1", "h1", 1 - 3 / 64)]


def test_resolution(spark):
    companies = spark.createDataFrame([("t", "腾讯", ["Tencent", "腾讯科技有限公司"], 0), ("x", "Tencent", None, 1)], "companyId string, canonicalName string, aliases array<string>, pos int")
    rows = spark.createDataFrame([("tencent",), ("腾讯科技",), ("Foo Co",), (None,)], "company string")
    got = {r.company: (r.companyId, r.matchedBy, r.confidence) for r in resolve.resolve_companies(rows, companies).collect()}
    assert got["tencent"] == got["腾讯科技"] == ("t", "known_alias", 1.0)
    assert got["Foo Co"] == ("fooco", "legal_suffix_normalization", 0.8) and got[None][2] == 0.0
    leads = spark.createDataFrame([("l1", "Acme", "Data engineer"), ("l2", "Acme", "Chef"), ("l3", "Zed", "Data engineer")], "lead string, company string, title string")
    jobs = spark.createDataFrame([(1, "Acme Inc", "Senior data engineer", "u1"), (0, "acme", "Driver", "u0")], "pos int, company string, title string, url string")
    a, b = resolve.promote_leads(leads, jobs)
    assert [(r.lead, r.official_url) for r in a.collect()] == [("l1", "u1")] and sorted(r.lead for r in b.collect()) == ["l2", "l3"]


def test_lookup_pages(spark):
    pages = spark.createDataFrame([("a", "b", 200, "old", 0), ("a", None, 200, "new", 1)], "requestedUrl string, finalUrl string, status int, html string, seq int")
    got = {r.url: (r.outcome, r.html) for r in resolve.lookup_pages(spark.createDataFrame([("a",), ("b",), ("c",)], "url string"), pages).collect()}
    assert got == {"a": ("FETCHED", "new"), "b": ("FETCHED", "old"), "c": ("FETCH_FAILED", None)}


def test_projects_keep_an_address_in_one_role(spark):
    schema = "project_id string, seq int, company string, cohort_year int, batch string, title string, location string, posted_at long, expires_at long, first_seen_at long, verified_at long, source string, official_verified boolean, identity_confirmed boolean, campaign_confirmed boolean, application_active boolean, new_in_run boolean, apply_url string, job_detail_url string, job_list_url string, campaign_url string, career_url string"
    rows = [("p", 0, "A", 2026, "秋招", "x", "r", 5, None, 1, None, "s", True, True, True, None, False, None, "u", "u", "v", None), ("p", 1, "B", None, "b", "y", "r", 9, 7, 2, None, None, False, None, None, True, True, "u", "w", None, None, "v")]
    r = rollup.projects(spark.createDataFrame(rows, schema)).head()
    assert (r.company, r.posted_at, r.expires_at, r.first_seen_at, r.job_titles, r.official_verified, r.new_in_run) == ("B", 5, 7, 1, ["x", "y"], True, True)
    assert (r.apply_url, r.job_detail_url, r.job_list_url, r.campaign_url, r.career_url, r.entry_role) == ("u", None, None, "v", None, "DIRECT_APPLICATION")


def test_reports(spark):
    p = spark.createDataFrame([("1", "A", 2026, "秋招", 100, True, True, ["s", "t"], ["r"], None), ("2", "B", None, "待确认批次", None, False, False, ["s"], [], None)], "project_id string, company string, cohort_year int, batch string, expires_at long, official_verified boolean, new_in_run boolean, sources array<string>, locations array<string>, verified_at long")
    r = reports.business_quality(p, 50).head()
    assert (r.projects, r.active_campaigns, r.merged_campaigns, r.recruitment_type_completeness, r.deadline_completeness) == (2, 2, 1, 0.5, 0.5)
    assert reports.business_quality(p.limit(0), 50).head().official_url_valid_rate == 0.0
    assert sorted(x.section for x in reports.daily_digest(p, 50).collect()) == ["changed", "closing_3_days", "closing_7_days", "new"]
    items = spark.createDataFrame([("b", "SUCCEEDED"), ("b", "FAILED"), ("c", "SUCCEEDED"), ("d", "PENDING")], "batchId string, status string")
    assert {x.batchId: x.status for x in reports.batch_status(items).collect()} == {"b": "COMPLETE_WITH_ERRORS", "c": "COMPLETE", "d": "PARTIAL"}
    assert {x.batchId: x.status for x in reports.batch_status(items, paused=True).collect()}["d"] == "PAUSED"
    calls = spark.createDataFrame([(1_000_000, 0), (None, 5)], "input_tokens long, output_tokens long")
    assert [x.cost_usd for x in reports.llm_cost(calls, F.lit(2.0), F.lit(3.0)).collect()] == [2.0, None]


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "f1", ["x"]), (2, None, "f2", None)], "id int, name string, first string, tags array<string>")
    new = spark.createDataFrame([(2, "b", "f9", ["y"]), (3, "c", "f3", ["z"]), (1, "z", "f8", ["x", "w"])], old.schema)
    rules = {"name": store.OLD, "first": store.OLD, "tags": store.union_of}
    once = store.upsert(old, new, ["id"], rules)
    want = [(1, "a", "f1", ["x", "w"]), (2, "b", "f2", ["y"]), (3, "c", "f3", ["z"])]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, store.upsert(once, new, ["id"], rules).collect())) == want
    assert sorted(map(tuple, store.upsert(old.limit(0), new, ["id"], rules).collect())) == sorted(map(tuple, new.collect()))


def test_children_and_supersession(spark):
    old = spark.createDataFrame([("p", 1), ("q", 2)], "portal string, n int")
    new = spark.createDataFrame([("p", 8), ("p", 9)], old.schema)
    assert sorted(map(tuple, store.replace_children(old, new, "portal").collect())) == [("p", 8), ("p", 9), ("q", 2)]
    assert sorted(map(tuple, store.insert_or_ignore(old, new, ["portal"]).collect())) == [("p", 1), ("q", 2)]
    portals = spark.createDataFrame([("a", "c", "PLATFORM_ONLY", None), ("b", "c", "PLATFORM_ONLY", "z"), ("d", "c", "OFFICIAL_SITE", None), ("e", "k", "PLATFORM_ONLY", None)], "id string, companyId string, sourceTier string, supersededByPortalId string")
    events = spark.createDataFrame([("c", "d", "OFFICIAL_SITE"), ("k", "e", "PLATFORM_ONLY")], "companyId string, careerPortalId string, sourceTier string")
    assert {r.id: r.supersededByPortalId for r in store.supersede(portals, events).collect()} == {"a": "d", "b": "z", "d": None, "e": None}


def test_commits_are_all_or_nothing(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("id int, v string")
    db = store.Store(spark, f"file://{tmp_path}/db", {"a": schema, "b": schema})
    row = lambda *r: spark.createDataFrame(list(r), schema)
    assert db.read("a").count() == 0
    assert db.commit({"a": row((1, "x")), "b": row((9, "y"))}) == 1
    with pytest.raises(ValueError, match="invariant"):
        db.commit({"a": row((2, "bad"))}, [row((2, "bad"))])
    assert [tuple(r) for r in db.read("a").collect()] == [(1, "x")]
    assert db.commit({"a": store.upsert(db.read("a"), row((2, "z")), ["id"])}) == 2
    assert sorted(tuple(r) for r in db.read("a").collect()) == [(1, "x"), (2, "z")] and db.read("b").count() == 1


def test_merge_records(spark):
    names = "id string, company string, title string, location string, batchName string, projectId string, cohortYear int, firstSeenAt long, firstRunId string, postedAt long, expiresAt long, verificationCheckedAt long, description string, finalApplyUrl string, announcementUrl string, detailUrl string, sources array<string>, staleOrExpired boolean, seenCount int, newInRun boolean, officialVerified boolean, reachable boolean, officialIdentityConfirmed boolean, campaignConfirmed boolean, verificationStatus string, verificationReason string"
    old = ("r", "A", "t", "", "", "p", None, 1, "run1", 5, None, 10, "long text", "u", "", "", ["s"], False, 1, True, True, True, True, True, "verified", "why")
    new = ("r", "B", "t2", "Rome", "x", "q", 2026, 9, "run2", 4, 7, 11, "short", "", "n", "", ["s", "z"], None, 1, True, False, False, None, None, "discovered", "new")
    r = store.merge_records(spark.createDataFrame([old], names), spark.createDataFrame([new], names)).head()
    assert (r.company, r.location, r.cohortYear, r.firstSeenAt, r.postedAt, r.expiresAt, r.description, r.finalApplyUrl, r.announcementUrl, r.sources) == ("A", "Rome", 2026, 1, 5, 7, "long text", "u", "n", ["s", "z"])
    assert (r.seenCount, r.newInRun, r.officialVerified, r.verificationStatus) == (2, False, False, "discovered")


def test_merge_records_keeps_what_a_sparse_record_lacks(spark):
    link = "array<struct<url:string,source:string>>"
    names = f"id string, scope string, officialVerified boolean, verificationCheckedAt long, verificationState string, primaryUrl string, officialUrl string, organizationType string, recruitmentLinks string, graduationYears array<int>, graduationYearRaw string, audienceType string, companyRawName string, recruitmentType string, companyStandardId string, officialCandidateFound boolean, searchStatus string, ats string, redirectChain array<string>, deadlineType string, positions array<string>, sourceLinks {link}, sources array<string>, recordType string"
    stored = ("r", "campus", True, 10, "VERIFIED", "p", "o", "private", "links", [2026], "2026", "campus", "Raw", "autumn", "c1", True, "done", "ats", ["a"], "fixed", ["dev"], [("https://liepin.com/1", "liepin")], ["liepin"], "job")
    sparse = ("r", "social", None, None, None, None, "", "state", None, [], "", None, "Other", "spring", "c2", None, "", None, None, "", None, [("https://nowcoder.com/1", "nowcoder"), ("https://liepin.com/1", "again"), ("https://acme.com/careers/1", "acme")], None, None)
    go = lambda a, b: store.merge_records(spark.createDataFrame([a], names), spark.createDataFrame([b], names)).head().asDict()
    got = go(stored, sparse)
    links = got.pop("sourceLinks")
    assert [x.source for x in links] == got.pop("sources") == ["acme", "liepin", "nowcoder"]
    fields = [f.split()[0] for f in names.split(", ")]
    assert got == {n: v for n, v in zip(fields, stored, strict=True) if n not in ("sourceLinks", "sources")} | {"scope": "social"}
    verified = sparse[:2] + (True, 11, None, "p2", "o2", "state", "new", [2027], "27", "all", *sparse[12:])
    got = go(stored, verified)
    assert (got["primaryUrl"], got["officialUrl"], got["recruitmentLinks"], got["graduationYears"], got["audienceType"], got["verificationState"], got["officialCandidateFound"]) == ("p2", "o2", "new", [2027], "all", None, False)
    empty = ("r", *[None] * (len(fields) - 1))
    got = go(empty, empty)
    assert (got["primaryUrl"], got["audienceType"], got["deadlineType"], got["positions"], got["verificationState"], got["sourceLinks"]) == ("", "unknown", "unknown", [], "UNVERIFIED", [])


def test_frontier(spark):
    edges = spark.createDataFrame([("s", "a", 0), ("s", "b", 1), ("s", "c", 2), ("a", "s", 0), ("a", "d", 1), ("d", "e", 0), ("b", "d", 0)], "src string, dst string, pos int")
    seeds = spark.createDataFrame([("k", "s"), ("k", "s")], "company string, url string")
    assert {(r.url, r.depth) for r in graph.frontier(seeds, edges).collect()} == {("s", 0), ("a", 1), ("b", 1), ("c", 1), ("d", 2)}
    assert {(r.url, r.depth) for r in graph.frontier(seeds, edges, children=1).collect()} == {("s", 0), ("a", 1), ("d", 2)}
    scores = spark.createDataFrame([("c", 5.0), ("b", 1.0)], "url string, score double")
    assert {r.url for r in graph.best_first(seeds, edges, scores, 1, 1).collect()} == {"s", "c"}


def test_redirects_and_closures(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), *((f"n{i}", f"n{i + 1}") for i in range(9))], "src string, dst string")
    urls = spark.createDataFrame([("a",), ("c",), ("x",), ("n0",)], "url string")
    assert {r.url: (r.final_url, r.hops, r.status) for r in graph.redirect_chains(urls, hops).collect()} == {"a": ("c", 2, "RESOLVED"), "c": ("c", 0, "RESOLVED"), "x": ("y", 1, "LOOP"), "n0": ("n5", 5, "TOO_MANY")}
    files = spark.createDataFrame([("src/a.mjs", "import x from './b.mjs'; import y from 'fs'"), ("src/b.mjs", "export * from '../lib/c.mjs'"), ("lib/c.mjs", "import '../src/a.mjs'")], "path string, content string")
    edges = graph.imports(files)
    assert {(r.src, r.dst) for r in edges.collect()} == {("src/a.mjs", "src/b.mjs"), ("src/b.mjs", "lib/c.mjs"), ("lib/c.mjs", "src/a.mjs")}
    assert {r.node for r in graph.closure(spark.createDataFrame([("src/a.mjs",)], "node string"), edges).collect()} == {"src/a.mjs", "src/b.mjs", "lib/c.mjs"}


def test_builders(spark):
    df = spark.createDataFrame([("Acme", 2026, "秋招", "acme.com"), ("", 0, "", "")], "c string, y int, k string, d string")
    got = [r.q for r in df.select(builders.official_queries(F.col("c"), F.col("y"), F.col("k"), F.col("d"), 99).alias("q")).collect()]
    assert got[0] == ['"Acme" 招聘官网', '"Acme" 校园招聘', '"Acme" careers', '"Acme" jobs', '"Acme" "2026届" 校园招聘', '"Acme" "秋招"', '"Acme" "2026届" "秋招"', "site:acme.com 招聘", "site:acme.com 校园招聘", "site:acme.com 2026届"] and got[1] == []
    roles = spark.createDataFrame([(i, f"r{i}") for i in range(13)], "pos int, role string")
    places = spark.createDataFrame([(0, "New York"), (1, "Rome")], "pos int, location string")
    got = builders.platform_searches(roles, places).collect()
    assert sorted({(r.source) for r in got}) == ["Indeed", "LinkedIn"] and len(got) == 40 and all("New+York" in r.url or "Rome" in r.url for r in got)
    sources = spark.createDataFrame([("a", "a.com")], "source string, domain string")
    assert sorted(r.text for r in builders.index_queries(sources, roles).collect())[0].startswith("site:a.com (r0 OR r1 OR r2 OR r3 OR r4 OR r5)")
