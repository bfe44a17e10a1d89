import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tests.helpers import values
from veldra.functions import dates as d
from veldra.functions import values as v


def test_dates(spark):
    got = values(spark, [("on 2026-3-05T10:00Z.",), ("2026-02-30",), ("发布于2025年7月8日",), ("12026-01-011",), (None,)], lambda c: d.explicit_date(c("s")), "s string")
    assert got == [dt.date(2026, 3, 5), None, dt.date(2025, 7, 8), None, None]
    assert values(spark, [(1_700_000_000.0,), (1_700_000_000_000.0,)], lambda c: d.epoch_date(c("n")), "n double") == [dt.date(2023, 11, 14)] * 2
    got = values(spark, [("报名2026年1月2日开始；2026年2月3日截止", None, None), ("x", "2025-05-05", None)], lambda c: d.event_dates(c("t"), c("a"), c("b")), "t string, a string, b string")
    assert [tuple(g) for g in got] == [(dt.date(2026, 1, 2), dt.date(2026, 2, 3)), (dt.date(2025, 5, 5), None)]
    assert values(spark, [("2026-01-30", 3), ("bad", 1)], lambda c: d.add_days(c("a"), c("n")), "a string, n int") == ["2026-02-02", None]
    assert values(spark, [("2026-01-01", "2026-03-01"), ("2026-02-30", "2026-03-01"), ("1-1-1", "x")], lambda c: d.days_between(c("a"), c("b")), "a string, b string") == [59, None, None]
    assert values(spark, [("30",), ("2 weeks",), ("3个月",), ("?",), ("7d",)], lambda c: d.range_days(c("s"), 90), "s string") == [30, 14, 90, 90, 7]


def test_experience(spark):
    texts = ["3-5 years of experience", "at least 2 years", "7+ yrs", "founded 20 years ago", "No prior experience", "around 4 years of backend experience", ""]
    got = values(spark, [(t,) for t in texts], lambda c: d.experience(c("s")), "s string")
    assert [(g.minYears, g.maxYears) for g in got] == [(3, 5), (2, None), (7, None), (None, None), (0, 0), (4, None), (None, None)]
    got = values(spark, [("1-3年",), ("5年以上",), ("不超过2年",), ("应届",), ("x",)], lambda c: d.cn_experience(c("s")), "s string")
    assert [(g.minYears, g.maxYears) for g in got] == [(1, 3), (5, None), (None, 2), (0, 0), (None, None)]


def test_cohorts(spark):
    assert values(spark, [("26届校招",), ("2027 届",), ("2026 graduate program",), ("Campus hiring 2025",), ("x",)], lambda c: d.cohort(c("s")), "s string") == ["2026", "2027", "2026", "2025", None]
    at = 1_700_000_000_000
    assert values(spark, [(2024, "", "campus", at), (None, "25届", "campus", at), (None, "", "social", at), (None, "", "campus", at), (None, "", "campus", 0)], lambda c: d.cohort_year(c("e"), c("t"), c("s"), c("a")), "e int, t string, s string, a long") == [2024, 2025, None, 2024, None]
    assert values(spark, [("硕士及以上",), ("本科",), ("",)], lambda c: d.education(c("s")), "s string") == ["master", "bachelor", ""]


def test_keys(spark):
    one = lambda build: values(spark, [(1,)], lambda c: build, "z int")[0]
    L = F.lit
    assert one(d.job_key(L("Acme Inc"), L("Senior Dev"), L("Remote Rome"))) == hashlib.sha1(b"acme|dev|rome").hexdigest()[:20]
    assert one(d.opening_id(L("c"), L(None), L("9"), L(None), L(None), L("T"), L("R"))) == hashlib.sha256(b"c|source:9").hexdigest()
    assert one(d.opening_id(L("c"), L("e"), L(None), L("https://x.com/a#b"), L(None), L(" T "), L("R"))) == hashlib.sha256(b"c|event:e|https://x.com/a|t|r").hexdigest()
    assert one(d.ratio(L(1), L(3))) == 0.3333 and one(d.ratio(L(1), L(0))) is None
    assert one(d.clamp(L(120))) == 100


def test_lists_and_json(spark):
    assert values(spark, [([" a ", "b", "a", "", None],), (None,)], lambda c: v.unique_strings(c("s"), 2), "s array<string>") == [["a", "b"], []]
    assert values(spark, [('["a"]',), ("broken",), (None,)], lambda c: v.decode_list(c("s")), "s string") == [["a"], [], []]
    assert values(spark, [('{"a":{"isOfficial" : 1}}',), ('{"x":"isOfficial"}',)], lambda c: v.has_forbidden_key(c("s")), "s string") == [True, False]
    got = values(spark, [('{"u":"https:\\/\\/a.com","t":["x y"]}',), ("no",)], lambda c: v.json_document(c("s")), "s string")
    assert (got[0].valid, got[0].text, got[0].urls) == (True, "https://a.com x y", ["https://a.com"]) and not got[1].valid
    rows = values(spark, [([("u", 1), ("v", 2), ("u", 3)],)], lambda c: v.first_by(c("s"), "k"), "s array<struct<k:string,n:int>>")[0]
    assert [r.n for r in rows] == [1, 2]
    assert values(spark, [("x", 0.9), ("x", 0.5)], lambda c: v.company_type(c("s"), c("n")), "s string, n double") == ["x", ""]


def test_search_window(spark):
    assert values(spark, [("500",), ("0",), ("x",), (None,)], lambda c: d.search_window(c("s")), "s string") == [180.0, 1.0, 90.0, pytest.approx(90.0)]
