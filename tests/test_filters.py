import datetime as dt

from pyspark.sql import functions as F

from tests.helpers import values
from veldra.operators import filters as f

def now():
    return F.lit(dt.datetime(2026, 1, 31)).cast("timestamp")


def test_titles(spark):
    titles = ["AI Engineer", "Maid", "Sales lead", "iOS dev", None]
    got = lambda **k: values(spark, [(t,) for t in titles], lambda c: f.title_filter(c("t"), **k), "t string")
    assert got(positive=["AI", " ios "], negative=["sales"]) == [True, False, False, True, False]
    assert got(positive=[], negative=["lead"]) == [True, True, False, True, True]
    assert got(positive=["", " "]) == [True] * 5
    assert values(spark, [("AI lead",), ("x",)], lambda c: f.matched_keywords(c("t"), ["AI", "Lead", ""]), "t string") == [["AI", "Lead"], []]


def test_locations(spark):
    places = [None, " ", "Remote, US", "Paris", "Rome"]
    assert values(spark, [(p,) for p in places], lambda c: f.location_filter(c("p"), ["remote"], ["paris"], ["us", "rome"]), "p string") == [True, True, True, True, False]
    assert values(spark, [(p,) for p in places], lambda c: f.location_filter(c("p"), block=["rome"]), "p string") == [True, True, True, True, False]


def test_ages(spark):
    days = [(dt.datetime(2026, 1, 30),), (dt.datetime(2025, 1, 1),), (None,)]
    assert values(spark, days, lambda c: f.age_filter(c("d"), now(), 30), "d timestamp") == [True, False, True]
    assert values(spark, days, lambda c: f.age_filter(c("d"), now(), 0), "d timestamp") == [True] * 3
    assert values(spark, days, lambda c: f.is_recent(c("d"), now(), 30), "d timestamp") == [True, False, False]
    assert values(spark, days, lambda c: f.posting_date_class(c("d"), now(), 30), "d timestamp") == ["fresh", "stale", "undated"]


def test_contents(spark):
    cases = [("", "x"), ("python here", "dev"), ("php here", "dev"), ("php here", "php dev"), ("go", "php dev")]
    got = values(spark, cases, lambda c: f.content_filter(c("d"), c("t"), ["dev", "php"], positive=["python"], negative=[], by_title={"PHP": {"positive": ["php"]}}), "d string, t string")
    assert got == [True, True, False, True, False]


def test_salaries(spark):
    cases = [(None, None, None), (10.0, 20.0, "USD"), (None, 5.0, "USD"), (50.0, None, ""), (10.0, 20.0, "EUR"), (10.0, 20.0, None)]
    got = lambda *a: values(spark, cases, lambda c: f.salary_filter(c("a"), c("b"), c("c"), *a), "a double, b double, c string")
    assert got(8, 30, "usd") == [True, True, False, False, False, True]
    assert got(-1, 30) == got(30, 8) == got(0, 0) == [True] * 6


def test_history(spark):
    cases = [("added", "2026-01-01"), ("added", "2026-01-30"), ("cooldown:x:2026-03-01", None), ("cooldown:x:2026-01-01", None), ("skipped_title", None), (None, "bad")]
    assert values(spark, cases, lambda c: f.is_settled(c("s"), c("d"), "2026-01-31", 10), "s string, d string") == [False, True, True, False, True, True]
    assert values(spark, cases[:1], lambda c: f.is_settled(c("s"), c("d"), "2026-01-31", None), "s string, d string") == [True]


def test_cooldown(spark):
    jobs = spark.createDataFrame([(0, "Acme Inc", "Backend dev"), (1, "Acme", "EM, Payments"), (2, "Acme", "Chef"), (3, "Other", "Backend dev")], "seq int, company string, title string")
    schema = "pos int, company string, last_apply_date string, same_role_days int, applied_to array<string>, bucket string"
    windows = spark.createDataFrame([(0, "Acme", "2026-01-01", 5, ["backend"], None), (1, "acme", "2026-01-20", 60, ["backend"], "em_roles")], schema)
    got = {r.seq: r.cooldown for r in f.cooldown(jobs, windows, "2026-01-31").collect()}
    assert got == {0: "cooldown:acme:2026-03-21", 1: "cooldown:acme:2026-03-21", 2: None, 3: None}
    assert f.cooldown(jobs, windows.limit(0), "2026-01-31").where("cooldown is not null").count() == 0


def test_stages_and_plans(spark):
    df = spark.createDataFrame([(True, True), (False, True), (None, False)], "a boolean, b boolean")
    assert sorted(r.s for r in df.select(f.first_failed_stage(x=F.col("a"), y=F.col("b")).alias("s")).collect()) == ["added", "x", "y"]
    q = spark.createDataFrame([(0, " a  b ", ["p", "z"], 99), (1, "a b", ["q"], 1), (2, "", ["p"], 1), (3, "c", None, None)], "pos int, text string, providers array<string>, topK int")
    got = f.plan_queries(q, ["p", "q"]).collect()
    assert [(r.text, r.providers, r.topK) for r in got] == [("a b", ["p"], 20), ("c", [], 8)]
    hits = spark.createDataFrame([("q", "ad", 1), ("q", None, 2), ("q", "organic", 3), ("q", "news", 4)], "query string, kind string, rank int")
    assert [r.rank for r in f.natural_results(hits, ["query"], 1, F.col("rank")).collect()] == [1]


def test_openings(spark):
    o = spark.createDataFrame([("o1", "p1", "ACTIVE"), ("o2", "p2", "ACTIVE"), ("o3", "p3", "ACTIVE"), ("o4", "p3", "CLOSED"), ("o5", "p9", "ACTIVE")], "id string, careerPortalId string, status string")
    p = spark.createDataFrame([("p1", "VERIFIED", False, "OFFICIAL_SITE"), ("p2", "REVIEW", False, "OFFICIAL_SITE"), ("p3", "REVIEW", True, "PLATFORM_ONLY")], "id string, verificationStatus string, platformIdentityConfirmed boolean, sourceTier string")
    assert sorted(r.id for r in f.formal_openings(o, p).collect()) == ["o1", "o3"]
