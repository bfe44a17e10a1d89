"""Dates, ranges, ratios and stable keys over Columns.  The IDs are those of the operator inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldra.functions.text import B, E, _s, canonical_company, clean, company_alias, let, normalize_text, planner_company, planner_text, replace, title_key, trim
from veldra.functions.urls import clean_url

_YMD = r"(20\d{2})[-/](\d{1,2})[-/](\d{1,2})"


def _ymd(text: Column, pattern: str) -> Column:
    """The first match's three groups as a date; null if there is none or no such day."""
    part = lambda i, n: F.lpad(F.regexp_extract(text, pattern, i), n, "0")
    return F.when(text.rlike(pattern), F.try_to_timestamp(F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)), F.lit("yyyy-MM-dd")).cast("date"))


def explicit_date(text: Column) -> Column:
    """The first complete date of a text, ISO-like before Chinese; null if the calendar lacks it."""
    x = clean(text)
    iso = rf"{B}{_YMD}(?![0-9])(?:[T ]\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:\.\d+)?)?(?:Z|[+-]\d{{2}}:?\d{{2}})?)?{E}"
    return F.when(x.rlike(iso), _ymd(x, iso)).otherwise(_ymd(x, r"(20\d{2})年(\d{1,2})月(\d{1,2})日"))


def epoch_date(number: Column) -> Column:
    """A date from seconds, or from milliseconds of ten digits and more."""
    n = number.cast("double")
    return F.timestamp_millis(F.when(n < 1e10, n * 1000).otherwise(n).cast("long")).cast("date")


def instant(number: Column, text: Column) -> Column:
    """A time from seconds or milliseconds, or else from the text of one."""
    n = number.cast("double")
    from_number = F.timestamp_millis(F.when(F.abs(n) < 1e10, n * 1000).otherwise(n).cast("long"))
    return F.coalesce(F.when(n > 0, from_number), F.try_to_timestamp(trim(text)), explicit_date(text).cast("timestamp"))


def cn_date(text: Column) -> Column:
    """D3: a date written with 年月日 or with dashes, dots or slashes, as milliseconds."""
    x = trim(_s(text))
    day = F.coalesce(_ymd(x, r"(\d{4})[年\-./](\d{1,2})[月\-./](\d{1,2})日"), _ymd(x, r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})"))
    return F.unix_millis(F.coalesce(day.cast("timestamp"), F.try_to_timestamp(F.nullif(x, F.lit("")))))


def event_dates(text: Column, start: Column, close: Column) -> Column:
    """Struct of startAt and closesAt: the structured dates, or those of the first sentence that says so."""
    sentences = F.split(_s(text), "[。；;，,\n]")
    said = lambda words: F.get(F.filter(F.transform(F.filter(sentences, lambda s: s.rlike(f"(?i){words}")), explicit_date), lambda d: d.isNotNull()), F.lit(0))
    return F.struct(F.coalesce(explicit_date(start), said("启动|开始|开放|发布|上线")).alias("startAt"), F.coalesce(explicit_date(close), said("截止|结束|关闭|停止")).alias("closesAt"))


def range_days(phrase: Column, fallback: int) -> Column:
    """A phrase for a time range in days: ``30``, ``7d``, ``2 weeks``, ``3个月``, at least one."""
    x = F.lower(trim(_s(phrase)))
    n = F.regexp_extract(x, r"(\d+)", 1).try_cast("int")
    unit = F.when(x.rlike("month|个月|月|(?<=\\d)m$"), 30).when(x.rlike("week|周|星期|(?<=\\d)w$"), 7).when(x.rlike("year|年|(?<=\\d)y$"), 365).otherwise(1)
    return F.coalesce(F.when(n > 0, n * unit), F.lit(fallback))


def search_window(days: Column, fallback: int = 90) -> Column:
    """A number of days from 1 to 180."""
    n = days.cast("string").try_cast("double")
    return F.greatest(F.lit(1.0), F.least(F.lit(180.0), F.when(n.isNull() | F.isnan(n), float(fallback)).otherwise(n)))


#: How texts state years of experience; the first group is the least, the second the most.
_EXPERIENCE = [
    (rf"(?:minimum|min\.?|at least|至少)?\s*(\d{{1,2}})\s*(?:-|to|至)\s*(\d{{1,2}})\s*(?:\+\s*)?(?:years?|yrs?|年)", 2),
    (r"(?:minimum|min\.?|at least|至少|不少于)\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?|年)", 1),
    (r"(\d{1,2})\s*\+\s*(?:years?|yrs?|年)", 1),
    (r"(?:around|about|roughly|approximately|circa)\s*(\d{1,2})\s*(?:years?|yrs?)\s+(?:of\s+)?[^.\n]{0,50}?experience", 1),
    (r"(?<![-\d])(\d{1,2})\s*(?:years?|yrs?|年)\s+(?:of\s+)?(?:professional\s+)?experience", 1),
]


def experience(text: Column) -> Column:
    """Struct of minYears, maxYears and evidence, over all statements; maxYears is null if one is open."""
    return let(planner_text(replace(_s(text), "[‐‑‒–—−]", "-")), lambda x: _experience(x, text))


def _experience(x: Column, text: Column) -> Column:
    # statements about the past or about old things are blanked first, with their numbers
    x = replace(x, r"\d{1,2}\s*(?:years? ago|year-old)", " ")
    found = []
    for pattern, groups in _EXPERIENCE:
        all_of = lambda g, pattern=pattern: F.regexp_extract_all(x, F.lit(pattern), F.lit(g))
        most = all_of(2) if groups == 2 else F.transform(all_of(1), lambda _: F.lit("x"))
        rows = F.arrays_zip(all_of(1).alias("a"), most.alias("b"), all_of(0).alias("e"))
        found.append(F.transform(rows, lambda r: F.struct(r["a"].try_cast("int").alias("a"), r["b"].try_cast("int").alias("b"), F.trim(r["e"]).alias("e"))))
    none = F.when(_s(text).rlike("(?i)no (?:prior|professional) experience|required experience.*none|无需经验|经验不限|freshers? welcome"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("no prior experience required").alias("e")))
    every = F.filter(F.concat(*found), lambda r: (r["a"] <= 30) & (r["b"].isNull() | ((r["b"] >= r["a"]) & (r["b"] <= 40))))
    return let(F.concat(every, F.array_compact(F.array(none))), _range)


def _range(every: Column) -> Column:
    open_end = F.exists(every, lambda r: r["b"].isNull())
    return F.struct(
        F.array_min(F.transform(every, lambda r: r["a"])).alias("minYears"),
        F.when(~open_end, F.array_max(F.transform(every, lambda r: r["b"]))).alias("maxYears"),
        F.slice(F.array_distinct(F.transform(every, lambda r: r["e"])), 1, 5).alias("evidence"),
    )


def cn_experience(text: Column) -> Column:
    """Struct of minYears, maxYears and evidence by the first Chinese form that fits."""
    x = _s(text)
    row = lambda a, b, e: F.struct(a.cast("int").alias("minYears"), b.cast("int").alias("maxYears"), F.array(e).alias("evidence"))
    get = lambda p, g: F.regexp_extract(x, p, g)
    span, least, below, single = r"(\d{1,2})\s*[-–—~]\s*(\d{1,2})\s*年", r"(\d{1,2})\s*年以上", r"(?:不超过|不多于|小于|低于)\s*(\d{1,2})\s*年", r"(\d{1,2})\s*年[以上以下经验价]"
    nothing = F.struct(F.lit(None).cast("int").alias("minYears"), F.lit(None).cast("int").alias("maxYears"), F.array().cast("array<string>").alias("evidence"))
    return (
        F.when(x.rlike("应届|没有工作经验要求|不限经验"), row(F.lit(0), F.lit(0), F.lit("campus-no-exp")))
        .when(x.rlike(span), row(get(span, 1), get(span, 2), get(span, 0)))
        .when(x.rlike(least), row(get(least, 1), F.lit(None), get(least, 0)))
        .when(x.rlike(below), row(F.lit(None), get(below, 1), get(below, 0)))
        .when(x.rlike(single), row(get(single, 1), F.lit(None), get(single, 0)))
        .otherwise(nothing)
    )


def cohort(text: Column) -> Column:
    """The year of a class: ``2026届``, ``26届``, ``2026 graduate program`` or ``campus hiring 2026``."""
    x = _s(text)
    cn = F.regexp_extract(x, r"(?:20)?(\d{2})\s*届", 1)
    words = r"(?:graduate|campus|new[\s-]?grad)(?:\s+(?:program|programme|hiring|recruitment))?"
    after, before = F.regexp_extract(x, rf"(?i){B}(20\d{{2}})\s+{words}{E}", 1), F.regexp_extract(x, rf"(?i){B}{words}\s+(20\d{{2}}){E}", 1)
    return F.when(cn != "", F.concat(F.lit("20"), cn)).when(after != "", after).when(before != "", before)


def cohort_year(explicit: Column, text: Column, scope: Column, opened_at: Column) -> Column:
    """The class of a record: as given, as its text says, or for others than experienced hires the year after it
    opened (``opened_at``: milliseconds)."""
    said = F.regexp_extract(_s(text), r"(?:20)?(2[0-9])届", 1)
    opened = F.year(F.timestamp_millis(opened_at.cast("long")))
    return F.when(explicit.between(2020, 2100), explicit.cast("int")).when(said != "", 2000 + said.try_cast("int")).when(scope == "social", F.lit(None)).when((opened_at != 0) & opened.between(2020, 2099), opened + 1)


def graduation(text: Column) -> Column:
    """Struct of graduationYears, cohortYear (if there is one) and audienceType."""
    years = F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(_s(text), F.lit(r"20\d{2}"), F.lit(0)), lambda y: y.cast("int")), lambda y: y.between(2020, 2035))))
    kind = F.when(_s(text).rlike("在校生|所有学生"), "current_students").when(F.size(years) > 0, "graduation_years").otherwise("unknown")
    return F.struct(years.alias("graduationYears"), F.when(F.size(years) == 1, years[0]).alias("cohortYear"), kind.alias("audienceType"))


def education(text: Column) -> Column:
    """The least education that a text asks for, by its highest word."""
    x = _s(text)
    return F.when(x.contains("博士"), "phd").when(x.rlike("硕士|研究生"), "master").when(x.contains("本科"), "bachelor").when(x.contains("大专"), "associate").when(x.contains("不限学历"), "any").otherwise("")


def add_days(day: Column, days: Column) -> Column:
    """An ISO date so many days later; null if it isn't one."""
    return F.date_add(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date"), days.cast("int")).cast("string")


def days_between(start: Column, end: Column) -> Column:
    """Whole days between two ISO dates; null unless both are."""
    d = lambda x: F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date"))
    return F.datediff(d(end), d(start))


def china_day(at: Column) -> Column:
    """The day in China of a time in UTC."""
    return F.date_format(F.from_utc_timestamp(at, "Asia/Shanghai"), "yyyy-MM-dd")


def china_month(at: Column) -> Column:
    """D10"""
    return F.date_format(F.from_utc_timestamp(at, "Asia/Shanghai"), "yyyy-MM")


def result_key(market: Column, company: Column, title: Column, location: Column, ascii_only: bool = False) -> Column:
    """Key of a job result: market, company, title and place."""
    return F.concat_ws("|", F.upper(_s(market)), canonical_company(company, ascii_only), normalize_text(title, ascii_only), normalize_text(location, ascii_only))


def job_key(company: Column, title: Column, location: Column) -> Column:
    """20 hex digits of SHA-1 over company, title and place; remote is no place."""
    place = F.trim(F.replace(planner_text(location), F.lit("remote"), F.lit("")))
    return F.substring(F.sha1(F.concat_ws("|", planner_company(company), title_key(title), place).cast("binary")), 1, 20)


def opening_id(company: Column, event: Column, source_job: Column, detail_url: Column, source_url: Column, title: Column, location: Column) -> Column:
    """SHA-256 over company, event and the source's own id, or else address, title and first place."""
    event = F.when(_s(event) != "", F.concat(F.lit("event:"), event))
    by_id = F.concat_ws("|", F.nullif(_s(company), F.lit("")), event, F.concat(F.lit("source:"), source_job))
    by_page = F.concat_ws("|", _s(company), event, F.coalesce(clean_url(detail_url), clean_url(source_url), F.lit("")), F.lower(clean(title)), F.lower(clean(location)))
    return F.sha2(F.when(_s(source_job) != "", by_id).otherwise(by_page).cast("binary"), 256)


def event_id(company: Column, kind: Column, cohort: Column, url: Column) -> Column:
    """SHA-256 over company, type, class and address of an event."""
    return F.sha2(F.concat_ws("|", clean(company), F.upper(clean(kind)), F.lower(clean(cohort)), _s(clean_url(url))).cast("binary"), 256)


def record_key(*parts: Column) -> Column:
    """24 hex digits of SHA-1 over parts without signs."""
    bare = [replace(F.lower(clean(p)), r"[\s·•（）()\-_—–|｜/\\.,，。:：]+") for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *bare).cast("binary")), 1, 24)


def project_key(company: Column, cohort_year: Column, scope: Column, batch: Column, year: Column) -> Column:
    """24 hex digits of SHA-1 over company, class, batch and year."""
    who = F.coalesce(F.nullif(cohort_year.cast("string"), F.lit("0")), F.when(scope == "internship", "daily").otherwise("unknown"))
    return F.substring(F.sha1(F.concat_ws("|", company_alias(company), who, batch, year.cast("string")).cast("binary")), 1, 24)


def prefixed_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 20 hex digits of SHA-1."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("|", *map(_s, parts)).cast("binary")), 1, 20))


def canonical_hash(row: Column) -> Column:
    """SHA-256 of the JSON of a struct, whose fields the caller gives in sorted order."""
    return F.sha2(F.to_json(row).cast("binary"), 256)


def ratio(n: Column, d: Column, places: int = 4) -> Column:
    """A rounded ratio, null over zero; negative and null counts are zero."""
    count = lambda x: F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.round(F.try_divide(count(n), F.nullif(count(d), F.lit(0.0))), places)


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    """D14"""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
