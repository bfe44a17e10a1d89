import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from veldra.sources import connectors, files, pages

PAYLOADS = [
    ("greenhouse", "Acme", "", '{"jobs":[{"title":" A ","absolute_url":"https://x.io/1","location":{"name":"Rome"},"first_published":"2024-01-02T03:04:05Z"},{"title":"","absolute_url":"https://x.io/2"},{"title":"No url"}]}', [("A", "https://x.io/1", "Acme", "Rome", 1704164645000)]),
    ("lever", "Acme", "", '[{"text":"B","hostedUrl":"https://x.io/3","categories":{"location":"NY"},"createdAt":1700000000000}]', [("B", "https://x.io/3", "Acme", "NY", 1700000000000)]),
    ("bytedance", "", "", '{"data":{"job_post_list":[{"id":"7 8","title":"后端","city_list":[{"name":"北京"},{"name":"上海"}]}]}}', [("后端", "https://jobs.bytedance.com/campus/position/7%208/detail", "字节跳动", "北京/上海", None)]),
    ("arbeitnow", "", "", '{"data":[{"title":"C","url":"https://a.de/1","company_name":"Z","location":"Bonn","remote":true,"created_at":1700000000}]}', [("C", "https://a.de/1", "Z", "Bonn, Remote", 1700000000000)]),
    ("tencent", "", "", '{"Data":{"Posts":[{"RecruitPostName":"D","PostURL":"https://t.com/1","CountryName":"中国","LocationName":"深圳","LastUpdateTime":"2026年01月02日"}]}}', [("D", "https://t.com/1", "腾讯", "中国-深圳", 1767312000000)]),
    ("workday", "Acme", "https://a.wd1.myworkdayjobs.com/s/", '{"jobPostings":[{"title":"E","externalPath":"/job/x/y","locationsText":"2 Locations"}]}', [("E", "https://a.wd1.myworkdayjobs.com/s/job/x/y", "Acme", "2 Locations", None)]),
    ("weworkremotely", "", "", "<rss><item><title><![CDATA[Foo: Bar dev]]></title><link>https://w.co/1</link><region>Any</region><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item></rss>", [("Bar dev", "https://w.co/1", "Foo", "Any", 1704164645000)]),
    ("nodesk", "", "", "<item><title>Dev at Acme Co</title><link>https://n.co/1</link></item>", [("Dev", "https://n.co/1", "Acme Co", "", None)]),
    ("personio", "P", "https://p.jobs.personio.de", "<workzag-jobs><position><id>5</id><name>F &amp; G</name><office>Berlin</office></position></workzag-jobs>", [("F & G", "https://p.jobs.personio.de/job/5", "P", "Berlin", None)]),
    ("rheinmetall", "RM", "https://r.com", '<a href="/en/job/dev/12"><div class="md:text-xl x">Dev &amp; Ops</div></a>', [("Dev & Ops", "https://r.com/en/job/dev/12", "RM", "", None)]),
    ("workable", "W", "", "| Title | Dept | Loc | Link |\n| Dev | D | Berlin | [View](https://apply.workable.com/w/j/1.md) |", [("Dev", "https://apply.workable.com/w/j/1", "W", "Berlin", None)]),
    ("hackernews", "", "https://hn", '{"children":[{"text":"Acme | Dev | Remote<p>see https://acme.io/jobs."},{"text":null}]}', [("Acme | Dev | Remote", "https://acme.io/jobs", "Acme", "Remote", None)]),
    ("smartrecruiters", "S", "", "not json", []),
    ("remotive", "S", "", '{"jobs": "odd"}', []),
    ("ashby", None, None, None, []),
    ("ashby", "A", "", '{"jobs":[{"title":"G","jobUrl":"https://a.co/1","location":"Canada","secondaryLocations":[{"location":"Europe","address":{"postalAddress":{"addressLocality":"Berlin","addressCountry":"Germany"}}},{"location":"Canada"}]}]}', [("G", "https://a.co/1", "A", "Canada · Europe · Berlin · Germany", None)]),
    ("workday", "A", "https://w.com/s", '{"jobPostings":[{"title":"H","externalPath":"/job/New-York/dev_1","postedOn":"Posted 30+ Days Ago"}]}', [("H", "https://w.com/s/job/New-York/dev_1", "A", "New York", None)]),
    ("recruitee", "A", "", '{"offers":[{"title":"I","url":"https://r.co/1","city":"Bonn","country":"DE","remote":true},{"title":"J","careers_url":"https://r.co/2","location":"Rome"}]}', [("I", "https://r.co/1", "A", "Bonn, DE, Remote", None), ("J", "https://r.co/2", "A", "Rome", None)]),
    ("breezy", "A", "", '[{"name":"K","url":"https://b.hr/1","location":{"city":"Rome","country":{"name":"IT"},"is_remote":true}},{"name":"L","url":"https://b.hr/2","location":{"name":"Remote EU","is_remote":true}}]', [("K", "https://b.hr/1", "A", "Rome, IT, Remote", None), ("L", "https://b.hr/2", "A", "Remote EU", None)]),
    ("bamboohr", "A", "https://a.bamboohr.com", '{"result":[{"id":"7","jobOpeningName":"M","location":{"city":"Rome"},"isRemote":1}]}', [("M", "https://a.bamboohr.com/careers/7", "A", "Rome, Remote", None)]),
]


@pytest.mark.parametrize("provider,company,origin,payload,want", PAYLOADS, ids=lambda x: x if isinstance(x, str) and len(x) < 20 else "")
def test_connectors(spark, provider, company, origin, payload, want):
    df = spark.createDataFrame([(provider, company, origin, payload)], "provider string, company string, origin string, payload string")
    got = connectors.parse(df, provider).collect()
    assert [(r.title, r.url, r.company, r.location, r.posted_at) for r in got] == want


def test_every_connector_compiles_and_bears_nonsense(spark):
    assert len(connectors.PROVIDERS) == 60
    rows = [(p, "c", "https://o.com", x) for p in connectors.PROVIDERS for x in ("", "[]", "{}", "<item></item>", None)]
    df = spark.createDataFrame(rows, "provider string, company string, origin string, payload string")
    for k in range(0, 60, 20):
        assert connectors.parse_all(df, connectors.PROVIDERS[k : k + 20]).count() == 0


def test_pay_and_labels(spark):
    payload = '{"jobs":[{"title":"G","jobUrl":"https://a.co/1","compensation":{"minValue":"50","maxValue":20,"interval":"1 HOUR","currency":" usd "}},{"title":"H","jobUrl":"https://a.co/2"}]}'
    df = spark.createDataFrame([("ashby", "A", "", payload), ("workday", "B", "https://w.com", '{"jobPostings":[{"title":"T","externalPath":"/x","postedOn":"Posted 2 Days Ago"},{"title":"U","externalPath":"/y","postedOn":"Posted Today"}]}')], "provider string, company string, origin string, payload string")
    got = {r.title: r for r in connectors.parse_all(df, ["ashby", "workday"]).withColumn("days", (F.unix_millis(F.current_timestamp()) - F.col("posted_at")) / 86_400_000).collect()}
    assert tuple(got["G"].salary) == (41600.0, 104000.0, "USD") and got["H"].salary is None
    assert abs(got["T"].days - 2) < 0.1 and abs(got["U"].days) < 0.1


def made(feed):
    """A payload with one posting that has every field where the feed says it is, and what is to be read from it."""

    def put(doc, path, value):
        steps = re.findall(r"[.]([A-Za-z0-9_]+)|\[([0-9*]+)\]", path)
        at = doc
        for k, (key, index) in enumerate(steps):
            nxt = [] if k + 1 < len(steps) and steps[k + 1][1] else {}
            last = k == len(steps) - 1
            if index:
                if not at:
                    at.append(value if last else nxt)
                at = at[0]
            else:
                at = at.setdefault(key, value if last else nxt)

    if isinstance(feed, connectors.Json):
        item, want = {}, {}
        put(item, feed.title, "Dev")
        if feed.url.startswith("$"):
            put(item, feed.url, "https://x.example.com/1")
        for name in re.findall(r"\{(\$[^}]*)\}", feed.url):
            put(item, name, "7")
        for k, p in enumerate(feed.location):
            put(item, p, f"Place{k}")
        if feed.company:
            put(item, feed.company, "Acme")
        doc = [item]
        if feed.items != "$":
            doc = {}
            put(doc, feed.items, [item])
        url = "https://x.example.com/1" if feed.url.startswith("$") else re.sub(r"\{[^}]*\}", "7", feed.url.replace("{origin}", "https://o.example.com"))
        return json.dumps(doc), ("Dev", url, "Acme" if feed.company else "Firm", feed.joined.join(f"Place{k}" for k in range(len(feed.location))))
    if isinstance(feed, connectors.Xml):
        tags = {feed.title: {"": "Dev", ":": "Acme: Dev", "at": "Dev at Acme"}[feed.split], feed.url: "5" if feed.url == "id" else "https://x.example.com/1", **{p: f"Place{k}" for k, p in enumerate(feed.location)}}
        if feed.company:
            tags[feed.company] = "Acme"
        where = [f"Place{k}" for k in range(len(feed.location))]
        body = "".join(f"<{k}>{v}</{k}>" for k, v in tags.items())
        return f"<rss><{feed.item}>{body}</{feed.item}></rss>", ("Dev", "https://o.example.com/job/5" if feed.url == "id" else "https://x.example.com/1", "Acme" if feed.company or feed.split else "Firm", where[0] if feed.split == ":" else ", ".join(where))
    return None


PAGES = {
    "avature": '<article><a href="https://x.example.com/JobDetail/1">Dev</a><span class="location">Rome</span></article>',
    "deutschebahn": '<a class="m-search-hit" href="https://x.example.com/1"><span class="m-search-hit__title-text">Dev</span><ul><li><i aria-label="Arbeitsort"></i>Rome</li></ul></a>',
    "hecklerkoch": '<a href="https://x.example.com/1"><h3>Dev</h3></a>',
    "radancy": '<li><a class="search-results-list__job-link" href="https://x.example.com/1">Dev</a><div class="search-results-list__job-info--location"><span>Rome</span></div></li>',
    "rheinmetall": '<a href="/en/job/dev/12"><div class="md:text-xl x">Dev</div><div class="flex flex-wrap mr-6">Rome</div></a>',
    "softgarden": '<div id="job_id_1"><a href="https://x.example.com/job/1">Dev</a><div class="location-container">Rome</div></div>',
    "gank-interview": '<tr><td><a href="https://x.example.com/1">Dev</a></td><td class="city">Rome</td><td>2026-01-02</td></tr>',
    "niuqizhipin": '<li><a href="https://x.example.com/1">Dev</a> 2026-01-02</li>',
    "yingjiesheng": '<li><a href="https://x.example.com/1">Dev</a> 2026-01-02</li>',
}


def test_every_feed_reads_a_posting(spark):
    payloads, want = [], {}
    for name, feed in connectors.FEEDS.items():
        got = made(feed)
        if got:
            payloads.append((name, "Firm", "https://o.example.com/", got[0]))
            want[name] = got[1]
        else:
            payloads.append((name, "Firm", "https://o.example.com/", PAGES[name]))
    payloads.append(("workable", "Firm", "", "| Title | Dept | Loc | Link |\n| Dev | D | Rome | [View](https://x.example.com/1.md) |"))
    payloads.append(("hackernews", "", "https://hn", '{"children":[{"text":"Acme | Dev | Remote<p>see https://acme.io/jobs."}]}'))
    assert {p[0] for p in payloads} == set(connectors.PROVIDERS) and len(payloads) == 60
    df = spark.createDataFrame(payloads, "provider string, company string, origin string, payload string")
    got = {}
    for k in range(0, 60, 20):
        got |= {r.provider: (r.title, r.url, r.company, r.location) for r in connectors.parse_all(df, connectors.PROVIDERS[k : k + 20]).collect()}
    assert set(got) == set(connectors.PROVIDERS), set(connectors.PROVIDERS) - set(got)
    assert {k: v for k, v in got.items() if k in want} == want
    for name in PAGES:
        assert got[name][0] == "Dev" and got[name][1].startswith("https://") and got[name][3] in ("Rome", "")


def test_resolve_provider(spark):
    rules = spark.createDataFrame([(0, "lever", "jobs\\.lever\\.co"), (1, "any", ".")], "pos int, id string, pattern string")
    e = spark.createDataFrame([("a", "", "https://jobs.lever.co/x"), ("b", "ashby", "https://jobs.lever.co/x"), ("c", None, None)], "entry string, provider string, url string")
    assert {r.entry: r.provider for r in connectors.resolve_provider(e, rules).collect()} == {"a": "lever", "b": "ashby", "c": None}


def test_json_ld(spark):
    ld = {"@graph": [{"@type": "WebPage"}, {"@type": ["Thing", "JobPosting"], "title": "Dev", "hiringOrganization": {"name": "Acme"}, "jobLocation": [{"address": {"addressLocality": "Rome", "addressCountry": "IT"}}], "datePosted": "2026-01-01", "identifier": {"value": 7}}]}
    html = f'<script type="application/ld+json">broken</script><script type="application/ld+json">{json.dumps(ld)}</script>'
    df = spark.createDataFrame([(html, "https://u"), ("<p>x</p>", "https://u"), (None, None)], "html string, url string")
    got = [r.x for r in df.select(pages.json_ld(F.col("html"), F.col("url")).alias("x")).collect()]
    assert tuple(got[0]) == ("7", "Dev", "Acme", "Rome, IT", "", "2026-01-01", None, "https://u") and got[1] is None and got[2] is None


def test_pages(spark):
    html = "<title>T &amp; x</title><meta content='D' name='description'><h1>H</h1>"
    df = spark.createDataFrame([(html, "https://boards.greenhouse.io/acme/jobs/12?x"), ("", "https://a.wd5.myworkdayjobs.com/en-US/site/job/x/y"), ("", "https://x.com")], "h string, u string")
    got = df.select(pages.basic_page(F.col("h")).alias("p"), pages.detail_api(F.col("u")).alias("d"), pages.page_provider(F.col("u")).alias("k")).collect()
    assert tuple(got[0].p) == ("H", "", "D") and got[0].d.api == "https://boards-api.greenhouse.io/v1/boards/acme/jobs/12"
    assert got[1].d.api == "https://a.wd5.myworkdayjobs.com/wday/cxs/a/site/job/x/y" and got[2].d is None and got[2].k == "generic-jsonld"


def test_record_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"market": "CN", "companies": [{"company": "A", "market": ""}, {"company": "B", "market": "NA"}]}')
    (tmp_path / "b.jsonl").write_text('{"company": "A"}\n{"company": "B"}\n')
    (tmp_path / "c.csv").write_text('company, title\n"A ""x""",dev\nB,\n')
    assert sorted((r.company, r.market) for r in files.read_records(spark, str(tmp_path / "a.json")).collect()) == [("A", "CN"), ("B", "NA")]
    assert files.read_records(spark, str(tmp_path / "b.jsonl")).count() == 2
    assert [tuple(r) for r in files.read_records(spark, str(tmp_path / "c.csv")).select("company", "title").collect()] == [('A "x"', "dev"), ("B", None)]
    df = spark.createDataFrame([("t", "A", ["x"], None)], "title string, company string, tags array<string>, note string")
    files.write_records(df, str(tmp_path / "out"), "csv")
    assert files.ordered(df).columns == ["company", "title", "tags", "note"]
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).collect()] == [("A", "t", '["x"]', None)]


def test_workbook(spark, tmp_path):
    df = spark.createDataFrame([("Acme", None, "b", "t", "r", "2026-01-02", None, "until_filled", "https://x.com/?a=1&b=\"2\""), ("B", "x", "b", "t", "r", None, None, None, None)], "company string, companyType string, batch string, title string, location string, publishedAt string, closesAt string, deadlineType string, url string")
    rows = files.student_rows(df)
    got = rows.collect()
    assert got[0]["发布时间"] == "2026-01-02" and got[0]["截止时间"] == "招满即止" and got[1]["截止时间"] == "未披露" and got[1]["投递链接"] == ""
    assert files.write_workbook(rows, str(tmp_path / "w.xlsx")) == 2
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row ") == 3 and "IFERROR(HYPERLINK(" in sheet and "&amp;b=" in sheet


def test_history_and_lists(spark, tmp_path):
    offers = spark.createDataFrame([("https://x.com/1", "src", "=cmd", "Ac|me", "Rome", "", 1704164645000, (1.0, 2.0, "EUR"), "n")], "url string, source string, title string, company string, location string, fingerprint string, posted_at long, salary struct<min:double,max:double,currency:string>, note string")
    files.append_history(files.history_rows(offers, "2026-01-01"), str(tmp_path / "h"))
    r = files.read_history(spark, str(tmp_path / "h")).head()
    assert (r.url, r.title, r.status, r.posted) == ("https://x.com/1", "'=cmd", "added", "2024-01-02")
    lines = files.pipeline_lines(offers)
    assert lines.head().value == "- [ ] https://x.com/1 | Ac/me | =cmd | Rome | 1-2 EUR | posted: 2024-01-02 | note: n"
    lines.coalesce(1).write.text(str(tmp_path / "p"))
    assert tuple(files.pending(spark, str(tmp_path / "p")).head()) == ("https://x.com/1", "Ac/me", "=cmd")
    assert [r.url for r in files.seen_urls(spark, [str(tmp_path / "p")]).collect()] == ["https://x.com/1"]


def test_tracker(spark, tmp_path):
    (tmp_path / "t.md").write_text("# x\n| # | Date | Company | Role | Status | Score | Via |\n|---|---|---|---|---|---|---|\n| 1 | d | Acme | Dev | 4.5/5 | Applied | Ag |\n| x | d | a | b | c | d | e |\n")
    got = files.read_tracker(spark, str(tmp_path / "t.md")).collect()
    assert [(r.num, r.company, r.role, r.score, r.status, r.via) for r in got] == [(1, "Acme", "Dev", "4.5/5", "Applied", "Ag")]


def test_small_readers(spark):
    lines = spark.createDataFrame([(0, "log"), (1, '{"a":1}'), (2, '{"a":2}'), (3, "end")], "pos int, value string")
    assert files.last_json_line(lines).head().value == '{"a":2}'
    seeds = spark.createDataFrame([(1, '[{"name":"B","slug":"Acme"}]'), (0, '[{"name":" A ","slug":"acme"},{"name":"x","slug":"-bad-!"}]')], "seq int, payload string")
    assert [(r.slug, r.name) for r in files.seed_companies(seeds).collect()] == [("acme", "A")]
