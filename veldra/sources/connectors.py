"""Job feeds: a projection of each provider's payload to postings.  S25, S24, P27, P28.

Input rows are (provider, company, origin, payload): the provider's id, the company's name as configured, the origin
of its site and the text that its feed gave.  A feed is data, not code: where its list stands and where in an item the
fields are.  Everything is native: JSON by ``get_json_object`` and ``from_json``, XML and HTML by patterns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions.dates import cn_date
from veldra.functions.text import annual_salary, clean, decode_named_entities, fold_locations, replace, thread_comment, trim
from veldra.functions.urls import clean_url
from veldra.operators.scratch import listed

PAY = "struct<min:double,max:double,currency:string>"
JOB = f"struct<title:string,url:string,company:string,location:string,posted_at:bigint,description:string,salary:{PAY}>"


@dataclass(frozen=True)
class Json:
    """Fields are paths below an item; ``{path}`` in a url is put in encoded, ``{origin}`` as it is.

    ``other_url`` and ``other_location`` stand in where the first is empty.  ``pay``: paths of least and greatest
    amount, interval and currency.
    """

    items: str
    title: str
    url: str
    company: str = ""
    location: tuple[str, ...] = ()
    joined: str = ", "
    posted: str = ""
    time: str = "iso"
    description: tuple[str, ...] = ()
    remote: str = ""
    name: str = ""
    other_url: str = ""
    other_location: tuple[str, ...] = ()
    pay: tuple[str, ...] = ()


@dataclass(frozen=True)
class Xml:
    """``item`` is the element of a posting; a field is an element in it."""

    item: str = "item"
    title: str = "title"
    url: str = "link"
    company: str = ""
    location: tuple[str, ...] = ()
    posted: str = "pubDate"
    name: str = ""
    #: How a title holds the company too: ``company: title``, ``title at company`` or not.
    split: str = ""


@dataclass(frozen=True)
class Html:
    """``item`` cuts the page into blocks; each field is a pattern with one group."""

    item: str
    title: str
    url: str
    location: str = ""
    posted: str = ""
    name: str = ""
    fields: dict = field(default_factory=dict)


#: Where feeds have their fields.
FEEDS: dict[str, Json | Xml | Html] = {
    "4dayweek": Json("$.jobs", "$.title", "$.url", "$.company_name", ("$.locations[0].city", "$.locations[0].country"), posted="$.posted", remote="$.remote"),
    "amazon": Json("$.jobs", "$.title", "https://www.amazon.jobs{$.job_path}", "$.company_name", ("$.normalized_location",), posted="$.posted_date"),
    "arbeitnow": Json("$.data", "$.title", "$.url", "$.company_name", ("$.location",), posted="$.created_at", time="s", remote="$.remote"),
    "arbeitsagentur": Json("$.stellenangebote", "$.titel", "https://www.arbeitsagentur.de/jobsuche/jobdetail/{$.refnr}", "$.arbeitgeber", ("$.arbeitsort.ort", "$.arbeitsort.region")),
    "ashby": Json("$.jobs", "$.title", "$.jobUrl", location=("$.location",), posted="$.publishedAt", pay=("$.compensation.minValue", "$.compensation.maxValue", "$.compensation.interval", "$.compensation.currency")),
    "bamboohr": Json("$.result", "$.jobOpeningName", "{origin}/careers/{$.id}", location=("$.location.city", "$.location.state"), remote="$.isRemote"),
    "beesite": Json("$.SearchResult.SearchResultItems", "$.MatchedObjectDescriptor.PositionTitle", "$.MatchedObjectDescriptor.PositionURI", location=("$.MatchedObjectDescriptor.PositionLocation[*].CityName",), joined=" / ", posted="$.MatchedObjectDescriptor.PublicationStartDate"),
    "breezy": Json("$", "$.name", "$.url", location=("$.location.name",), posted="$.published_date", remote="$.location.is_remote", other_location=("$.location.city", "$.location.state", "$.location.country.name")),
    "bytedance": Json("$.data.job_post_list", "$.title", "https://jobs.bytedance.com/campus/position/{$.id}/detail", location=("$.city_list[*].name",), joined="/", posted="$.publish_time", time="ms", description=("$.description", "$.requirement"), name="字节跳动"),
    "comeet": Json("$", "$.name", "$.url_active_page", location=("$.location.name",), posted="$.time_updated", remote="$.location.is_remote"),
    "csod": Json("$.data.requisitions", "$.displayJobTitle", "{origin}/requisition/{$.requisitionId}", location=("$.locations[*].city",), posted="$.postingEffectiveDate"),
    "echojobs": Json("$.jobs", "$.title", "$.url", "$.company.name", ("$.locations[*].name",), posted="$.posted_at", time="ms"),
    "getonbrd": Json("$.data", "$.attributes.title", "$.links.public_url", "$.attributes.company.data.attributes.name", ("$.attributes.countries[*]",), posted="$.attributes.published_at", time="s", remote="$.attributes.remote"),
    "glints": Json("$.data.searchJobsV3.jobsInPage", "$.title", "{origin}/id/opportunities/jobs/{$.id}", "$.company.name", ("$.city.name",), posted="$.createdAt"),
    "greenhouse": Json("$.jobs", "$.title", "$.absolute_url", location=("$.location.name",), posted="$.first_published"),
    "himalayas": Json("$.jobs", "$.title", "$.applicationLink", "$.companyName", ("$.locationRestrictions[*]",), posted="$.pubDate", time="s"),
    "ibm": Json("$.hits.hits", "$._source.title", "$._source.url", location=("$._source.field_keyword_19", "$._source.field_keyword_17"), joined=" · ", name="IBM"),
    "jibeapply": Json("$.jobs", "$.data.title", "{origin}/jobs/{$.data.slug}", "$.data.hiring_organization", ("$.data.full_location",)),
    "jobicy": Json("$.jobs", "$.jobTitle", "$.url", "$.companyName", ("$.jobGeo",), posted="$.pubDate"),
    "jobstreet": Json("$.data", "$.title", "{origin}/id/job/{$.id}", "$.advertiser.description", ("$.locations[0].label",), posted="$.listingDate"),
    "justjoin": Json("$.data", "$.title", "https://justjoin.it/job-offer/{$.slug}", "$.companyName", ("$.city",), posted="$.publishedAt"),
    "landingjobs": Json("$", "$.title", "$.url", "$.company_name", ("$.locations[0].city", "$.locations[0].country_code"), posted="$.published_at", remote="$.remote"),
    "lever": Json("$", "$.text", "$.hostedUrl", location=("$.categories.location",), posted="$.createdAt", time="ms", description=("$.descriptionPlain",)),
    "nofluffjobs": Json("$.postings", "$.title", "https://nofluffjobs.com/job/{$.url}", "$.name", ("$.location.places[*].city",), posted="$.posted", time="ms"),
    "nowcoder": Json("$.data.datas", "$.jobName", "https://www.nowcoder.com/jobs/detail/{$.id}", "$.recommendInternCompany.companyName", ("$.jobCityList[*]",), joined="/", posted="$.createTime", time="ms", description=("$.infos", "$.requirements")),
    "nowcoder-schedule": Json("$.data.datas", "$.batchName", "https://www.nowcoder.com/jobs/school/schedule?company={$.companyId}", "$.name", ("$.cityList[*]",), joined="/", posted="$.updateTime", time="ms", description=("$.companyEvaluation", "$.batchName", "$.wangshenTime")),
    "phenom": Json("$.refineSearch.data.jobs", "$.title", "{origin}/job/{$.jobId}", "$.companyName", ("$.location",), posted="$.postedDate"),
    "pinpoint": Json("$.data", "$.title", "$.url", location=("$.location.name",)),
    "recruitee": Json("$.offers", "$.title", "$.careers_url", location=("$.location",), other_url="$.url", other_location=("$.city", "$.country"), remote="$.remote"),
    "remoteok": Json("$", "$.position", "$.url", "$.company", ("$.location",), name="RemoteOK"),
    "remotive": Json("$.jobs", "$.title", "$.url", "$.company_name", ("$.candidate_required_location",), name="Remotive"),
    "rippling": Json("$", "$.name", "$.url", location=("$.workLocation.label",)),
    "smartrecruiters": Json("$.content", "$.name", "https://jobs.smartrecruiters.com/{$.company.identifier}/{$.id}", location=("$.location.city", "$.location.region", "$.location.country"), remote="$.location.remote"),
    "solidjobs": Json("$", "$.title", "$.url", "$.company", ("$.locations[*]",)),
    "successfactors": Json("$.jobSearchResult", "$.response.unifiedStandardTitle", "{origin}/job/{$.response.urlTitle}/{$.response.id}", location=("$.response.jobLocationShort[*]",), posted="$.response.unifiedStandardStart"),
    "tencent": Json("$.Data.Posts", "$.RecruitPostName", "$.PostURL", location=("$.CountryName", "$.LocationName"), joined="-", posted="$.LastUpdateTime", time="cn", description=("$.Responsibility",), name="腾讯"),
    "thehub": Json("$.jobs.docs", "$.title", "https://thehub.io/jobs/{$.key}", "$.company.name", ("$.location.locality", "$.location.country"), posted="$.publishedAt", remote="$.isRemote"),
    "themuse": Json("$.results", "$.name", "$.refs.landing_page", "$.company.name", ("$.locations[*].name",)),
    "tkms": Json("$.results", "$.title", "{origin}/job/{$.id}", location=("$.city", "$.country"), posted="$.publicationDate"),
    "workday": Json("$.jobPostings", "$.title", "{origin}{$.externalPath}", location=("$.locationsText",), posted="$.postedOn", time="label"),
    "workingnomads": Json("$", "$.title", "$.url", "$.company_name", ("$.location",), name="Working Nomads"),
    "higheredjobs": Xml(company="description"),
    "jobspresso": Xml(company="job_listing:company", location=("job_listing:location",), name="Jobspresso"),
    "larajobs": Xml(company="job:company", location=("job:location",), name="LaraJobs"),
    "nodesk": Xml(split="at", name="NoDesk"),
    "teamtailor": Xml(location=("tt:city", "tt:country")),
    "weworkremotely": Xml(split=":", location=("region", "category"), name="We Work Remotely"),
    "personio": Xml(item="position", title="name", url="id", location=("office",), posted="createdAt"),
    "dassault": Xml(item="Hit", title="content_title", url="content_cta_1_url", posted="content_start_datetime", name="Dassault Systèmes"),
    "avature": Html(r"(?is)<article[^>]*>(.*?)</article>", r'(?is)<a[^>]+href="[^"]*/JobDetail/[^"]*"[^>]*>(.*?)</a>', r'(?is)<a[^>]+href="([^"]*/JobDetail/[^"]*)"', r'(?is)class="[^"]*location[^"]*"[^>]*>(.*?)<'),
    "deutschebahn": Html(r'(?is)(<a[^>]+class="[^"]*m-search-hit.*?</a>)', r'(?is)m-search-hit__title-text"[^>]*>(.*?)</span>', r'(?is)href="([^"]+)"', r'(?is)aria-label="Arbeitsort"[^>]*></i>(.*?)</li>', name="Deutsche Bahn"),
    "hecklerkoch": Html(r"(?is)(<a[^>]+href=\"[^\"]+\"[^>]*>(?:(?!</a>).)*<h3.*?</a>)", r"(?is)<h3[^>]*>(.*?)</h3>", r'(?is)href="([^"]+)"'),
    "radancy": Html(r"(?is)(<li[^>]*>(?:(?!</li>).)*search-results-list__job-link.*?</li>)", r'(?is)search-results-list__job-link[^>]*>(.*?)</a>', r'(?is)search-results-list__job-link[^"]*"[^>]*href="([^"]+)"', r"(?is)__job-info--location.*?<span>(.*?)</span>"),
    "rheinmetall": Html(r'(?is)(<a[^>]+href="/[a-z]{2}/job/.*?</a>)', r'(?is)md:text-xl[^"]*">(.*?)</div>', r'(?is)href="(/[a-z]{2}/job/[^"]+)"', r'(?is)class="flex flex-wrap mr-6">(.*?)</div>'),
    "softgarden": Html(r'(?is)id="job_id_(.*?)(?=id="job_id_|$)', r'(?is)<a href="[^"]*/job/[^"]+"[^>]*>(.*?)</a>', r'(?is)<a href="([^"]*/job/[^"]+)"', r'(?is)class="[^"]*location-container[^"]*"[^>]*>(.*?)</div>', r'(?is)class="matchValue date"[^>]*>(.*?)</div>'),
    "gank-interview": Html(r"(?is)(<tr[^>]*>.*?</tr>)", r"(?is)<a[^>]*>(.*?)</a>", r'(?is)href="([^"]+)"', r'(?is)class="[^"]*city[^"]*"[^>]*>(.*?)<', r"(\d{4}[-./年]\d{1,2}[-./月]\d{1,2}日?)"),
    "niuqizhipin": Html(r"(?is)(<li[^>]*>.*?</li>)", r"(?is)<a[^>]*>(.*?)</a>", r'(?is)href="([^"]+)"', "", r"(\d{4}[-./年]\d{1,2}[-./月]\d{1,2}日?)"),
    "yingjiesheng": Html(r"(?is)(<(?:li|tr)[^>]*>.*?</(?:li|tr)>)", r"(?is)<a[^>]*>(.*?)</a>", r'(?is)href="([^"]+)"', "", r"(\d{4}[-./年]\d{1,2}[-./月]\d{1,2}日?)"),
}


def _get(item: Column, path: str) -> Column:
    """The text at a path; the parts of a list, joined."""
    raw = F.get_json_object(item, path)
    if "[*]" not in path:
        return raw
    # of one part alone Spark gives the part, in its quotes, not a list
    parts = F.when(F.startswith(raw, F.lit("[")), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    return F.array_join(F.from_json(parts, "array<string>"), "\x01")


def _time(raw: Column, kind: str) -> Column:
    n = raw.try_cast("double")
    if kind == "cn":
        return cn_date(raw)
    if kind == "label":
        # so many days before the time of reading; more than so many is no date
        days = F.when(raw.rlike(r"(?i)posted\s+today"), 0).when(raw.rlike(r"(?i)posted\s+yesterday"), 1).otherwise(F.regexp_extract(raw, r"(?i)posted\s+(\d+)\s*day", 1).try_cast("int"))
        return F.unix_millis(F.current_timestamp()) - days.cast("long") * 86_400_000
    parsed = F.unix_millis(F.try_to_timestamp(raw))
    # the date of a mail or feed, without its weekday
    mail = replace(replace(raw, "^[A-Za-z]{3}, *"), "(?:GMT|UTC|Z)$", "+0000")
    if kind == "s":
        return F.coalesce((n * 1000).cast("long"), parsed)
    return F.coalesce(F.when(n > 0, F.when(n < 1e10, n * 1000).otherwise(n).cast("long")), parsed, F.unix_millis(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))))


def _posting(title: Column, url: Column, company: Column, location: Column, posted: Column, description: Column, salary: Column | None = None) -> Column:
    pay = F.lit(None).cast(PAY) if salary is None else salary.cast(PAY)
    return F.struct(title.alias("title"), url.alias("url"), company.alias("company"), location.alias("location"), posted.alias("posted_at"), description.alias("description"), pay.alias("salary"))


def _fill(item: Column, template: str, origin: Column) -> Column:
    if template.startswith("$"):
        return trim(_get(item, template))
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        value = replace(F.coalesce(origin, F.lit("")), "/$") if name == "origin" else _get(item, name)
        # a path keeps its slashes, an id is encoded
        parts += [F.lit(before), value if name == "origin" or "ath" in name or name.endswith("slug") else F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))]
    return F.concat(*parts, F.lit(rest))


def _json(feed: Json, payload: Column, company: Column, origin: Column) -> Column:
    items = F.from_json(payload if feed.items == "$" else F.get_json_object(payload, feed.items), "array<string>")

    def places(item: Column, paths: tuple[str, ...]) -> Column:
        found = F.array(*(_get(item, p) for p in paths), F.lit(None).cast("string"))
        return F.filter(F.transform(F.flatten(F.transform(F.array_compact(found), lambda x: F.split(x, "\x01"))), trim), lambda x: x != "")

    def one(item: Column) -> Column:
        parts = places(item, feed.location)
        if feed.other_location:
            other = places(item, feed.other_location)
            parts = F.when(F.size(parts) > 0, parts).otherwise(other)
        if feed.remote:
            away = F.lower(F.coalesce(_get(item, feed.remote), F.lit(""))).isin("true", "remote", "1") & ~F.exists(parts, lambda x: F.lower(x).contains("remote"))
            parts = F.concat(parts, F.when(away, F.array(F.lit("Remote"))).otherwise(F.array().cast("array<string>")))
        own = F.nullif(trim(_get(item, feed.company)), F.lit("")) if feed.company else F.lit(None).cast("string")
        name = F.coalesce(own, F.nullif(company, F.lit("")), F.lit(feed.name))
        text = F.concat_ws("\n", *(_get(item, p) for p in feed.description)) if feed.description else F.lit("")
        posted = _time(_get(item, feed.posted), feed.time) if feed.posted else F.lit(None).cast("long")
        url = _fill(item, feed.url, origin)
        if feed.other_url:
            url = F.coalesce(F.nullif(url, F.lit("")), _fill(item, feed.other_url, origin))
        pay = annual_salary(*(_get(item, p) for p in feed.pay)) if feed.pay else None
        return _posting(clean(replace(_get(item, feed.title), "<[^>]*>", " ")), url, name, F.array_join(F.array_distinct(parts), feed.joined), posted, text, pay)

    return F.transform(items, one)


def _element(block: Column, name: str) -> Column:
    inner = F.regexp_extract(block, rf"(?is)<{name}(?![A-Za-z0-9_:-])[^>]*>(.*?)</{name}>", 1)
    inner = replace(inner, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    return clean(decode_named_entities(replace(inner, "<[^>]*>", " ")))


def _xml(feed: Xml, payload: Column, company: Column, origin: Column) -> Column:
    blocks = F.regexp_extract_all(payload, F.lit(rf"(?is)(<{feed.item}(?![A-Za-z0-9_:-]).*?</{feed.item}>)"), F.lit(1))

    def one(b: Column) -> Column:
        raw = _element(b, feed.title)
        own = F.nullif(_element(b, feed.company), F.lit("")) if feed.company else F.lit(None).cast("string")
        title = raw
        if feed.split == ":":
            own, title = F.when(raw.contains(":"), F.trim(F.split(raw, ":", 2)[0])), F.when(raw.contains(":"), F.trim(F.split(raw, ":", 2)[1])).otherwise(raw)
        elif feed.split == "at":
            own, title = F.nullif(F.regexp_extract(raw, r"(?i)^.*? at (.+)$", 1), F.lit("")), F.coalesce(F.nullif(F.regexp_extract(raw, r"(?i)^(.*?) at .+$", 1), F.lit("")), raw)
        link = _element(b, feed.url)
        url = F.concat(replace(F.coalesce(origin, F.lit("")), "/$"), F.lit("/job/"), link) if feed.url == "id" else link
        places = F.array_distinct(F.filter(F.array(*(_element(b, p) for p in feed.location), F.lit("")), lambda x: x != ""))
        where = F.array_join(places, ", ") if feed.split != ":" else F.coalesce(F.get(places, F.lit(0)), F.lit(""))
        return _posting(title, url, F.coalesce(own, F.nullif(company, F.lit("")), F.lit(feed.name)), where, _time(_element(b, feed.posted), "iso"), F.lit(""))

    return F.transform(blocks, one)


def _html(feed: Html, payload: Column, company: Column, origin: Column) -> Column:
    blocks = F.regexp_extract_all(payload, F.lit(feed.item), F.lit(1))

    def one(b: Column) -> Column:
        part = lambda p: clean(decode_named_entities(replace(F.regexp_extract(b, p, 1), "<[^>]*>", " "))) if p else F.lit("")
        href = decode_named_entities(F.regexp_extract(b, feed.url, 1))
        url = F.when(F.startswith(href, F.lit("/")), F.concat(replace(F.coalesce(origin, F.lit("")), "/$"), href)).otherwise(href)
        return _posting(part(feed.title), url, F.coalesce(F.nullif(company, F.lit("")), F.lit(feed.name)), part(feed.location), cn_date(part(feed.posted)) if feed.posted else F.lit(None).cast("long"), F.lit(""))

    return F.transform(blocks, one)


def _workable(payload: Column, company: Column) -> Column:
    rows = F.filter(F.split(payload, "\n"), lambda x: F.startswith(F.trim(x), F.lit("|")) & x.contains("[View]"))

    def one(line: Column) -> Column:
        cells = F.transform(F.split(F.trim(line), r"\|"), trim)
        url = replace(F.regexp_extract(line, r"\[View\]\(([^)]+)\)", 1), r"\.md$")
        return _posting(F.get(cells, F.lit(1)), url, F.coalesce(company, F.lit("")), F.coalesce(F.get(cells, F.lit(3)), F.lit("")), F.lit(None).cast("long"), F.lit(""))

    return F.transform(rows, one)


def _ashby(jobs: Column, payload: Column) -> Column:
    """The postings with the places of their further regions."""
    more = "array<struct<location:string,address:struct<postalAddress:struct<addressLocality:string,addressCountry:string>>>>"
    items = F.from_json(F.get_json_object(payload, "$.jobs"), "array<string>")

    def places(item: Column) -> Column:
        second = F.from_json(F.get_json_object(item, "$.secondaryLocations"), more)
        parts = F.transform(second, lambda s: F.struct(s["location"].alias("location"), s["address"]["postalAddress"]["addressLocality"].alias("locality"), s["address"]["postalAddress"]["addressCountry"].alias("country")))
        return fold_locations(_get(item, "$.location"), parts)

    return F.zip_with(jobs, items, lambda j, item: j.withField("location", places(item)))


def _workday(jobs: Column, payload: Column) -> Column:
    """The postings; a place that isn't stated is taken from the address."""
    items = F.from_json(F.get_json_object(payload, "$.jobPostings"), "array<string>")
    slug = lambda item: F.replace(F.try_url_decode(F.regexp_extract(_get(item, "$.externalPath"), "/job/([^/]+)/", 1)), F.lit("-"), F.lit(" "))
    return F.zip_with(jobs, items, lambda j, item: j.withField("location", F.when(j["location"] == "", F.coalesce(slug(item), F.lit(""))).otherwise(j["location"])))


def _hackernews(payload: Column, origin: Column) -> Column:
    comments = F.from_json(F.get_json_object(payload, "$.children"), "array<struct<text:string>>")
    found = F.transform(comments, lambda t: thread_comment(t["text"], origin))
    return F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: _posting(x["title"], x["url"], x["company"], x["location"], F.lit(None).cast("long"), F.lit("")))


PROVIDERS = sorted([*FEEDS, "workable", "hackernews"])


def postings(provider: str, payload: Column, company: Column, origin: Column) -> Column:
    """array<JOB> of one provider's payload; broken payloads give null or nothing."""
    if provider == "workable":
        return _workable(payload, company)
    if provider == "hackernews":
        return _hackernews(payload, origin)
    feed = FEEDS[provider]
    kind = _json if isinstance(feed, Json) else _xml if isinstance(feed, Xml) else _html
    jobs = kind(feed, payload, company, origin)
    return _ashby(jobs, payload) if provider == "ashby" else _workday(jobs, payload) if provider == "workday" else jobs


def parse(payloads: DataFrame, provider: str) -> DataFrame:
    """(provider, JOB columns) of one provider's payloads; postings without title or valid url are dropped."""
    rows = payloads.where(F.col("provider") == provider)
    jobs = rows.select("provider", F.explode(postings(provider, F.col("payload"), F.col("company"), F.col("origin")).cast(f"array<{JOB}>")).alias("j")).select("provider", "j.*")
    return jobs.where((F.coalesce("title", F.lit("")) != "") & clean_url(F.col("url")).isNotNull())


def parse_all(payloads: DataFrame, providers: list[str] | None = None) -> DataFrame:
    """Postings of several providers, in one pass over the payloads: each row takes its provider's projection."""
    every = list(providers or PROVIDERS)
    found = F.lit(None).cast(f"array<{JOB}>")
    for p in reversed(every):
        found = F.when(F.col("provider") == p, postings(p, F.col("payload"), F.col("company"), F.col("origin")).cast(f"array<{JOB}>")).otherwise(found)
    jobs = payloads.where(F.col("provider").isin(every)).select("provider", F.explode(found).alias("j")).select("provider", "j.*")
    return jobs.where((F.coalesce("title", F.lit("")) != "") & clean_url(F.col("url")).isNotNull())


def resolve_provider(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries (entry, provider, url) with the explicit provider, or else the first rule (pos, id, pattern) that
    fits the url.  ``rules`` is the list of providers."""
    hit = entries.join(listed(rules.select("pos", "id", "pattern")), F.rlike(F.coalesce("url", F.lit("")), F.col("pattern"))).groupBy("entry").agg(F.min_by("id", "pos").alias("_p"))
    return entries.join(hit, "entry", "left").withColumn("provider", F.coalesce(F.nullif("provider", F.lit("")), "_p")).drop("_p")
