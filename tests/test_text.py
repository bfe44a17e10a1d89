import pytest

from tests.helpers import values
from veldra.functions import text as t
from pyspark.sql import functions as F

CASES = [
    (t.normalize_text, ["Ａcme　Co., Ltd", None, "  a--b "], ["acme co ltd", "", "a b"]),
    (t.canonical_company, ["Acme Co., Ltd", "Incorporated Co-op"], ["acme", "op"]),
    (t.planner_text, ["C++ / Node.js – Dev!", None], ["c++ node.js dev", ""]),
    (t.planner_company, ["Acme Technologies, Inc."], ["acme"]),
    (t.title_key, ["Senior iOS Engineer II (New Grad)", "Jr. C# Dev 2"], ["ios engineer", "c# dev"]),
    (t.clean, [" a　\n b ", None], ["a b", ""]),
    (t.company_alias, ["腾讯科技（深圳）有限公司", "Acme 公司"], ["腾讯科技深圳", "acme"]),
    (t.clean_company_name, ["腾讯2026届校招", "A 暑期实习 机械类"], ["腾讯", "A"]),
    (t.platform_identity, ["Acme 招聘 | BOSS直聘", "jobs"], ["acme", ""]),
    (t.decode_entities, ["a&nbsp;&amp;&LT;b&gt;&#65;&#x42;&#xD800;&#1114112;&bogus;"], ["a &<b>AB&#xD800;&#1114112;&bogus;"]),
    (t.html_to_text, ["<p>a</p><script>x</script><div>b<br>c  d</div>&amp;"], ["a\n\nb\nc d\n&"]),
    (t.strip_tags, ["<h1>a</h1>\n<style>p{}</style><b>b</b>"], ["a b"]),
    (t.posting_text, ["<b>Hi</b> there &nbsp; https://x.y/z Ünï-1"], ["hi there ünï 1"]),
    (t.latin_key, ["Ac-me 2!é"], ["acme2"]),
    (t.agency_key, ["Ａ-b 中！"], ["ab中"]),
    (t.markdown_field, ["a|b [c]\n\\d"], ["a/b \\[c\\] \\\\d"]),
    (t.tsv_field, ["=1+1", "a\tb", "-x"], ["'=1+1", "a b", "'-x"]),
    (t.redact, ["Bearer abc, api_key=xyz ok"], ["[REDACTED], [REDACTED] ok"]),
    (t.locations, ["北京、上海, Rome/ |"], [["北京", "上海", "Rome"]]),
    (t.slug_candidates, ["Acme Corp", ""], [["acmecorp", "acme-corp", "acme_corp", "acme", "acmecorpai", "acmecorptech", "acmecorpio", "acmecorphq", "acmecorplabs", "acmecorp.tech", "acmecorp.io", "acmeai", "acmetech", "acmeio", "acmehq", "acmelabs", "acme.tech", "acme.io"], []]),
    (t.skills, ["We use Go, C++ and node.js; Golang too. REST"], [["Node.js", "REST", "C++", "Go"]]),
    (t.bounded_error, [None, "x" * 300], ["unknown error", "x" * 240]),
]


@pytest.mark.parametrize("f,inputs,want", CASES, ids=lambda x: getattr(x, "__name__", None))
def test_scalars(spark, f, inputs, want):
    assert values(spark, [(i,) for i in inputs], lambda c: f(c("s")), "s string") == want


def test_company_match(spark):
    cases = [("Acme Inc", "acme"), ("Acme", "Acmeville"), ("A.B.", "ab"), ("", "x"), ("Foo Bar Baz", "bar baz"), ("x-y", "xy z")]
    assert values(spark, cases, lambda c: t.company_match(c("a"), c("b")), "a string, b string") == [True, False, True, False, True, False]


def test_sections(spark):
    body = "Intro\nResponsibilities:\n- Build things\n* Ship\nRequirements\nPython\nBenefits\nnone"
    assert values(spark, [(body,), ("x" * 40 + "\nshort",), (None,)], lambda c: t.responsibilities(c("s")), "s string") == ["Build things Ship", "x" * 40, ""]
    assert values(spark, [(body,)], lambda c: t.requirements(c("s")), "s string") == ["Python"]


def test_salary(spark):
    rows = values(spark, [(10.0, 20.0, "1 HOUR", "usd"), (None, 5.0, None, None), (1.0, 2.0, "1 MOON", "x"), (-1.0, None, "1 YEAR", "x")], lambda c: t.annual_salary(c("a"), c("b"), c("i"), c("c")), "a double, b double, i string, c string")
    assert [r and tuple(r) for r in rows] == [(20800.0, 41600.0, "USD"), (5.0, 5.0, ""), None, None]
    pay = lambda c: t.format_salary(F.struct(c("a").alias("min"), c("b").alias("max"), c("c").alias("currency")))
    assert values(spark, [(1.4, 2.6, "EUR"), (5.0, 5.0, ""), (None, None, "x")], pay, "a double, b double, c string") == ["1-3 EUR", "5", ""]


def test_places_tokens_and_hints(spark):
    assert values(spark, [("Rome", "Rome, Italy"), ("", "x"), ("Paris", "Rome")], lambda c: t.specific_location(c("a"), c("b")), "a string, b string") == ["Rome, Italy", "x", "Paris"]
    assert values(spark, [("data engineer ii", "senior data engineer"), ("", "x")], lambda c: t.overlap(c("a"), c("b")), "a string, b string") == [pytest.approx(2 / 3), 0.0]
    assert values(spark, [(None, "Acme Careers - x"), ("B", "y"), (None, "腾讯校园招聘")], lambda c: t.company_hint(c("a"), c("b")), "a string, b string") == ["Acme", "B", "腾讯"]
    assert values(spark, [("acme.com", "acne.com"), ("a.com", "a.com"), ("x.com", "acme.org")], lambda c: t.is_lookalike(c("a"), c("b")), "a string, b string") == [True, False, False]
    assert values(spark, [("招聘 - 华为技术有限公司", ""), ("前端工程师 | 字节", "")], lambda c: t.infer_company(c("a"), c("b")), "a string, b string") == ["华为技术有限公司", "字节"]


def test_fetch_errors(spark):
    got = values(spark, [(404, None, None), (None, "fetch failed", None), (503, "x", None), (None, "HTTP 401", None), (None, None, None), (200, "?", None)], lambda c: t.fetch_error_class(c("s"), c("m"), c("n")), "s int, m string, n string")
    assert got == ["slug_gone", "network", "server", "auth", "unknown", "unknown"]


def test_thread_comment(spark):
    got = values(spark, [('Acme | Dev | Rome<p>See <a href="https:&#x2F;&#x2F;a.io&#x2F;j">x</a>',), ("",), ("Only title",)], lambda c: t.thread_comment(c("s"), F.lit("https://t/1")), "s string")
    assert [g and tuple(g) for g in got] == [("Acme | Dev | Rome", "https://a.io/j", "Acme", "Rome"), None, ("Only title", "https://t/1", "", "")]
