import pytest
from pyspark.sql import functions as F

from tests.helpers import values
from veldra.functions import urls as u

CASES = [
    (u.clean_url, ["HTTPS://User@Ex.COM:443/a?b#c", "http://x.com", "ftp://x", "http://a b.com", None, "http://x.com:8080?"], ["https://ex.com/a?b", "http://x.com/", None, None, None, "http://x.com:8080/"]),
    (u.canonical_url, ["https://x.com/a?utm_source=1&id=2&spm=3", "bad"], ["https://x.com/a?id=2", ""]),
    (u.unwrap, ["https://www.nowcoder.com/jump?url=https%3A%2F%2Fa.com%2Fb", "https://x.com/y", "no"], ["https://a.com/b", "https://x.com/y", ""]),
    (u.registrable_domain, ["www.a.b.com", "https://x.y.com.cn/z", "localhost", "a.co.uk"], ["b.com", "y.com.cn", "localhost", "a.co.uk"]),
    (u.official_domain, ["https://www.Acme.com/x", "", "acme.com:80"], ["acme.com", None, "acme.com"]),
    (u.ats, ["https://acme.mokahr.com/x", "https://boards.greenhouse.io/a", "https://acme.com"], ["moka", "greenhouse", None]),
    (u.market_region, ["china", "us", "??"], ["CN", "NA", "NA"]),
    (u.market, ["中国", "Canada", "Mars"], ["CN", "NA", None]),
    (u.is_static_asset, ["/a.css?x", "/a"], [True, False]),
    (u.wechat_key, ["https://mp.weixin.qq.com/s?__biz=AB", "https://mp.weixin.qq.com/s/xyz", "x"], ["mp.weixin.qq.com|AB", "mp.weixin.qq.com|article:xyz", "mp.weixin.qq.com|invalid"]),
    (u.is_company_ats_host, ["https://acme.mokahr.com", "https://app.mokahr.com", "mokahr.com"], [True, False, False]),
    (u.host_suffixes, ["a.b.c"], [["a.b.c", "b.c", "c"]]),
    (u.is_private_host, ["10.1.2.3", "172.16.0.1", "8.8.8.8", "localhost", "a.local", "::1", "example.com", "100.64.0.1", "fd00::1"], [True, True, False, True, True, True, False, True, True]),
]


@pytest.mark.parametrize("f,inputs,want", CASES, ids=lambda x: getattr(x, "__name__", None))
def test_scalars(spark, f, inputs, want):
    assert values(spark, [(i,) for i in inputs], lambda c: f(c("s")), "s string") == want


def test_structs(spark):
    got = values(spark, [("https://x.com/a/?utm_source=1#t",), ("https://x.com/a.png",), ("x",)], lambda c: u.governed_url(c("s")), "s string")
    assert [(g.canonicalUrl, g.reason) for g in got] == [("https://x.com/a", ""), ("", "static_asset"), ("", "invalid_url")]
    got = values(spark, [("https://acme.com/careers",), ("http://zhipin.com/x",), ("https://mp.weixin.qq.com/s",), ("https://a.zhaopin.com",), ("https://a.com",), ("-",)], lambda c: u.recruitment_channel(c("s")), "s string")
    assert [(g.channel, g.rank) for g in got] == [("official_careers", 5), ("discovery_index", 1), ("official_wechat", 4), ("delegated_official", 3), ("official_candidate", 2), ("invalid", 0)]
    got = values(spark, [(["http://zhipin.com", "https://a.com", "https://b.com/jobs"],), ([],)], lambda c: u.best_channel(c("s")), "s array<string>")
    assert [g and g.url for g in got] == ["https://b.com/jobs", None]
    got = values(spark, [("https://jobs.lever.co/a",), ("https://uk.indeed.com/x",), ("https://acme.com",), ("?",)], lambda c: u.source(c("s")), "s string")
    assert [tuple(g) for g in got] == [("Lever", "official_ats"), ("Indeed", "discovery"), ("acme.com", "company_site"), ("unknown", "unknown")]
    got = values(spark, [("https://a.com:8443/",), ("http://127.0.0.1/",), ("ftp://a",), ("https://a.com/",)], lambda c: u.public_target(c("s")), "s string")
    assert [(g.safe, g.reasonCode) for g in got] == [(False, "non_standard_port"), (False, "private_ip"), (False, "unsupported_protocol"), (True, None)]


def test_links_and_resolution(spark):
    html = "<a href='/a'>A</a><a class=x href=\"b?c#d\">B <b>b</b></a><a href='mailto:x'>m</a><a href='../e'>E</a><a href='/a'>again</a>"
    got = values(spark, [(html, "https://x.com/p/q/r")], lambda c: u.links(c("h"), c("b")), "h string, b string")[0]
    assert [tuple(g) for g in got] == [("https://x.com/a", "A"), ("https://x.com/p/q/b?c", "B b"), ("https://x.com/p/e", "E")]


def test_rediscovery_and_entry(spark):
    hrefs = ["//duckduckgo.com/l/?uddg=https%3A%2F%2Fjobs.acme.com%2F1", "https://other.com"]
    assert values(spark, [(hrefs, "jobs.acme.com"), (hrefs, "z.com")], lambda c: u.rediscovered(c("h"), c("d")), "h array<string>, d string") == ["https://jobs.acme.com/1", None]
    got = values(spark, [(None, "x", "https://l.com/a")], lambda c: u.best_entry(c("a"), c("b"), c("c"), F.lit(None).cast("string"), F.lit(None).cast("string")), "a string, b string, c string")[0]
    assert tuple(got) == ("JOB_LIST", "https://l.com/a")
