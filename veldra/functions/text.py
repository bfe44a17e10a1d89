"""Text functions over Columns.  The IDs are those of the operator inventory.

All are native expressions but for ``nfkc`` and ``decode_numeric_entities``, which Spark lacks and which run as
vectorised UDFs over Arrow.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's patterns have it, for use inside a character class.
WS = r"\t\n\x0B\f\r    -     　﻿"
#: The edges of an ASCII word; Java's own \b also knows other letters.
B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def whole(words: str) -> str:
    """A pattern of alternatives as a whole ASCII word."""
    return f"{B}(?:{words}){E}"


def _s(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it: keeps expressions small."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def replace(x: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(x, pattern, by)


def trim(x: Column) -> Column:
    return replace(x, f"^[{WS}]+|[{WS}]+$")


def clean(x: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(replace(_s(x), f"[{WS}]+", " "))


def present(x: Column) -> Column:
    """The cleaned text, or null if nothing is left."""
    return F.nullif(clean(x), F.lit(""))


def nfkc(x: Column, ascii_only: bool = False) -> Column:
    """Unicode compatibility composition; with ``ascii_only`` the caller vouches that there is nothing to compose."""
    if ascii_only:
        return x

    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(composed, "string")(x)


def normalize_text(x: Column, ascii_only: bool = False) -> Column:
    """Compatibility form, lower case, letters and digits only, one space between."""
    return F.trim(replace(F.lower(nfkc(_s(x), ascii_only)), r"[^\p{L}\p{N}]+", " "))


def canonical_company(x: Column, ascii_only: bool = False) -> Column:
    """``normalize_text`` without words of legal form."""
    return clean(replace(normalize_text(x, ascii_only), whole("inc|incorporated|corp|corporation|company|co|ltd|limited|llc")))


def planner_text(x: Column) -> Column:
    """Lower case, letters, digits and + # . - kept."""
    return F.trim(replace(F.lower(_s(x)), r"[^\p{L}\p{N}+#.\-]+", " "))


def planner_company(x: Column) -> Column:
    """``planner_text`` without words of legal form and trade, and without signs."""
    words = "inc|incorporated|corp|corporation|company|co|llc|ltd|limited|technologies|technology"
    return F.trim(replace(replace(planner_text(x), whole(words)), r"[^\p{L}\p{N}]+", " "))


def title_key(x: Column) -> Column:
    """P5: a title without level and graduate words."""
    x = replace(planner_text(x), whole("sr|senior|jr|junior|i{1,3}|1|2|3"), " ")
    x = replace(x, whole("new grad|graduate|early career|entry level"), " ")
    return F.trim(replace(x, r"[^\p{L}\p{N}+#]+", " "))


def company_alias(x: Column) -> Column:
    """A company's alias key: no legal form at the end, no signs."""
    x = replace(F.lower(clean(x)), "(?:股份有限公司|有限责任公司|有限公司|集团控股|集团公司|公司)$")
    return replace(x, r"[\s·•（）()\-_—–|｜/\\.,，。:：]+")


def clean_company_name(x: Column) -> Column:
    """A company name without the words of a campaign."""
    x = replace(clean(x), r"(?iu)(?:20\d{2}|\d{2})届(?:校招|秋招|春招|实习)?|暑期实习|日常实习|校园招聘|校招|秋招|春招|提前批|补录|预告|剩余岗位")
    return trim(replace(x, r"\s*(?:机械类|电气类|岗位)$"))


def platform_identity(x: Column) -> Column:
    """P10: what is left of a company or page title without the words of job platforms."""
    words = "招聘职位|招聘岗位|招聘信息|正在招聘|最新招聘|社会招聘|校园招聘|公司招聘|招聘|职位|岗位|careers?|jobs?|hiring|liepin|猎聘|boss直聘|boss"
    return replace(replace(F.lower(_s(x)), f"(?iu)(?:{words})"), r"[^\p{L}\p{N}]+")


def same_identity(company: Column, title: Column) -> Column:
    """P10: whether both have the same identity, and one at all."""
    a, b = platform_identity(company), platform_identity(title)
    return (a != "") & (a == b)


#: The named character references that are decoded, in order.
NAMED_ENTITIES = [("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")]


def decode_numeric_entities(x: Column) -> Column:
    """&#n; and &#xn; of valid code points."""
    pattern = re.compile(r"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));")

    def one(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or "&#" not in t else pattern.sub(one, t))

    return F.pandas_udf(decoded, "string")(x)


def decode_named_entities(x: Column) -> Column:
    for name, char in NAMED_ENTITIES:
        x = replace(x, f"(?i)&{name};", char.replace("\\", "\\\\").replace("$", "\\$"))
    return x


def decode_entities(x: Column) -> Column:
    """Named references, then numeric ones."""
    return decode_numeric_entities(decode_named_entities(_s(x)))


def html_to_text(html: Column, numeric: bool = True) -> Column:
    """Visible text: scripts and styles dropped, blocks on lines of their own.  Without ``numeric`` it is native."""
    x = replace(replace(_s(html), r"(?is)<script(?![A-Za-z0-9_])[^>]*>.*?</script>", " "), r"(?is)<style(?![A-Za-z0-9_])[^>]*>.*?</style>", " ")
    x = replace(x, r"(?i)</?(?:p|div|section|article|li|ul|ol|h[1-6]|br|tr|td|th)(?![A-Za-z0-9_])[^>]*>", "\n")
    x = replace(x, "<[^>]+>", " ")
    x = decode_entities(x) if numeric else replace(decode_named_entities(x), "&#39;", "'")
    x = replace(replace(replace(x, "\r"), "[ \\t]+", " "), "\n[ \\t]+", "\n")
    return trim(replace(x, "\n{3,}", "\n\n"))


def strip_tags(html: Column, numeric: bool = True) -> Column:
    """Visible text on one line."""
    x = replace(replace(_s(html), r"(?is)<script(?![A-Za-z0-9_])[^>]*>.*?</script>", " "), r"(?is)<style(?![A-Za-z0-9_])[^>]*>.*?</style>", " ")
    x = replace(x, "<[^>]+>", " ")
    return clean(decode_entities(x) if numeric else replace(decode_named_entities(x), "&#39;", "'"))


def posting_text(x: Column) -> Column:
    """A posting's text for shingles: no markup, references or addresses, only lower-case letters and digits."""
    x = replace(F.lower(_s(x)), "<[^>]*>", " ")
    x = replace(replace(x, "(?i)&[a-z#0-9]+;", " "), f"https?://[^{WS}]+", " ")
    return F.trim(replace(x, r"[^\p{L}\p{N}]+", " "))


def latin_key(x: Column) -> Column:
    """A company key of ASCII letters and digits."""
    return replace(F.lower(_s(x)), "[^a-z0-9]")


def agency_key(x: Column) -> Column:
    """An agency key of letters and digits of any script."""
    return replace(F.lower(nfkc(_s(x))), r"[^\p{L}\p{N}]")


def spaced_key(x: Column) -> Column:
    return clean(replace(F.lower(_s(x)), rf"[^a-z0-9{WS}]", " "))


def company_match(a: Column, b: Column) -> Column:
    """Equal keys, or one name is a run of whole words of the other."""
    inside = lambda small, large: F.concat(F.lit(" "), large, F.lit(" ")).contains(F.concat(F.lit(" "), small, F.lit(" ")))
    words = let(F.struct(spaced_key(a).alias("x"), spaced_key(b).alias("y")), lambda k: (k["x"] != "") & (k["y"] != "") & (inside(k["x"], k["y"]) | inside(k["y"], k["x"])))
    return (latin_key(a) == latin_key(b)) | words


def has_keyword(lower: Column, keyword: str) -> Column:
    """Whether a lower-case text has a keyword; two or three ASCII letters only as a whole word."""
    if re.fullmatch("[a-z]{2,3}", keyword):
        return lower.rlike(whole(keyword))
    return lower.contains(keyword)


def brand_tokens(company: Column) -> Column:
    """P20: struct of query, tokens, englishTokens and cjkOnly of a company's name."""
    name = trim(_s(company))
    parts = F.transform(F.split(name, rf"[{WS}\-·‧()]+"), lambda t: replace(t, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$"))
    tokens = F.filter(parts, lambda t: F.length(t) >= 2)
    english = F.transform(F.filter(tokens, lambda t: t.rlike(r"^[A-Za-z][A-Za-z0-9_.\-]+$")), F.lower)
    cjk = replace(name, f"[{WS}]+")
    query = F.when(F.size(english) > 0, F.concat(F.lit('"'), F.array_join(english, " "), F.lit('"'))).otherwise(cjk)
    return F.struct(query.alias("query"), tokens.alias("tokens"), english.alias("englishTokens"), cjk.alias("cjkOnly"))


#: Skills looked for in texts, in the order they are reported.
SKILLS = [
    "Swift", "SwiftUI", "UIKit", "Objective-C", "Xcode", "Combine", "Core Data", "Firebase", "TestFlight", "App Store",
    "Flutter", "React Native", "Kotlin", "Java", "JavaScript", "TypeScript", "React", "Node.js", "Python", "SQL",
    "PostgreSQL", "MySQL", "MongoDB", "AWS", "Azure", "GCP", "Docker", "Kubernetes", "Git", "REST", "GraphQL", "C++",
    "C#", "Go", "Ruby", "Machine Learning", "LLM", "RAG", "CI/CD", "MVVM", "MVC", "Agile", "Excel", "Tableau",
    "Power BI", "Looker", "Snowflake", "Databricks", "dbt", "Spark", "Pandas", "NumPy", "R", "SAS", "Stata", "MATLAB",
    "Spring", "Django", "FastAPI", ".NET", "Kafka", "Redis", "Terraform", "Jira", "Figma", "A/B Testing",
    "Product Analytics", "Roadmapping", "Financial Modeling", "Valuation", "Bloomberg", "Capital IQ", "Salesforce",
    "HubSpot", "CRM", "B2B", "SaaS", "Account Management", "Google Analytics", "SEO", "SEM", "Content Marketing",
    "Verilog", "SystemVerilog", "VHDL", "FPGA", "PCB", "Simulink", "CAD", "Altium", "PyTorch", "TensorFlow",
    "scikit-learn", "Hugging Face", "LangChain",
]


def _planner_text(s: str) -> str:
    return re.sub(r"[^\w+#.\-]+|_+", " ", s.lower()).strip()


def skills(text: Column) -> Column:
    """The known skills that a text names as whole words."""

    def named(x: Column) -> Column:
        found = []
        for s in SKILLS:
            # a cheap test comes first: most texts lack most skills
            key = _planner_text(s)
            hit = x.contains(key) & x.rlike(rf"(?:^|[^\p{{L}}\p{{N}}+#]){re.escape(key)}(?:$|[^\p{{L}}\p{{N}}+#])")
            found.append(F.when(hit, F.lit(s)))
        return F.array_compact(F.array(*found))

    return let(planner_text(text), named)


#: Headings at which a section ends.
SECTION_STOPS = ["qualifications", "requirements", "what you bring", "what we look for", "skills", "preferred", "nice to have", "benefits", "compensation", "salary", "about you", "who you are", "education", "location"]
RESPONSIBILITIES = ["responsibilities", "what you will do", "what you'll do", "the work", "岗位职责", "工作职责"]
REQUIREMENTS = ["requirements", "qualifications", "what you bring", "what we look for", "任职要求", "岗位要求"]


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(_s(text), "\n"), trim), lambda x: x != "")


def section(text: Column, starts: list[str], most: int = 1200) -> Column:
    """The lines under the first heading that begins with one of ``starts``, up to the next heading or so many
    characters."""
    return let(_lines(text), lambda lines: _section(lines, starts, most))


def _section(lines: Column, starts: list[str], most: int) -> Column:
    any_of = lambda x, names: F.exists(F.array(*map(F.lit, names)), lambda n: F.startswith(x, n))
    headed = F.transform(lines, lambda x, i: F.when(any_of(planner_text(x), starts), i))
    at = F.array_min(F.array_compact(headed))
    below = let(at, lambda k: F.slice(lines, k + 2, F.greatest(F.size(lines) - k - 1, F.lit(0))))
    return F.coalesce(let(below, lambda b: _body(b, most)), F.lit(""))


def _body(below: Column, most: int) -> Column:
    stop = lambda x: F.exists(F.array(*map(F.lit, SECTION_STOPS)), lambda n: (x == n) | F.startswith(x, F.concat(n, F.lit(" "))))
    stops = F.array_min(F.array_compact(F.transform(below, lambda x, i: F.when(stop(planner_text(replace(x, ":$"))), i))))
    body = F.transform(F.slice(below, 1, F.coalesce(stops, F.size(below))), lambda x: replace(x, rf"^[-*•][{WS}]*"))
    joined = F.aggregate(body, F.lit(""), lambda a, x: F.when(F.length(a) >= most, a).when(a == "", x).otherwise(F.concat(a, F.lit(" "), x)))
    return F.when(below.isNotNull(), F.trim(joined))


def responsibilities(text: Column) -> Column:
    """The section, or else the first five lines of 35 characters and more, cut at 1200."""
    long = F.slice(F.filter(_lines(text), lambda x: F.length(x) >= 35), 1, 5)
    return F.coalesce(F.nullif(section(text, RESPONSIBILITIES), F.lit("")), F.substring(F.array_join(long, " "), 1, 1200))


def requirements(text: Column) -> Column:
    """The section, cut at 1200."""
    return F.substring(section(text, REQUIREMENTS), 1, 1200)


def specific_location(detail: Column, seed: Column) -> Column:
    """The detail page's location unless the seed's says the same and more."""
    d, s = trim(_s(detail)), trim(_s(seed))
    x, y = planner_text(d), planner_text(s)
    return F.when(d == "", s).when(s == "", d).when(F.startswith(y, x) & (F.length(y) > F.length(x)), s).otherwise(d)


def _scalar(x: Column) -> Column:
    return trim(replace(replace(_s(x), r"[\r\n\t]+", " "), " {2,}", " "))


def markdown_field(x: Column) -> Column:
    """One line, brackets and backslashes escaped, bars as slashes."""
    return replace(replace(_scalar(x), r"([\\\[\]])", r"\\$1"), r"\|", "/")


def first_word(x: Column) -> Column:
    return F.split(trim(_s(x)), f"[{WS}]+")[0]


def markdown_url(x: Column) -> Column:
    """As ``markdown_field`` for an address; bars are percent-encoded."""
    return replace(replace(first_word(x), r"([\\\[\]])", r"\\$1"), r"\|", "%7C")


def tsv_field(x: Column) -> Column:
    """One line; what a spreadsheet would take for a formula gets an apostrophe."""
    x = _scalar(x)
    return F.when(x.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


#: How often an interval of pay fits into a year.
PAY_INTERVALS = {"1 HOUR": 2080.0, "1 DAY": 260.0, "1 WEEK": 52.0, "2 WEEK": 26.0, "0.5 MONTH": 24.0, "1 MONTH": 12.0, "2 MONTH": 6.0, "3 MONTH": 4.0, "6 MONTH": 2.0, "1 YEAR": 1.0}


def annual_salary(low: Column, high: Column, interval: Column, currency: Column) -> Column:
    """P25: struct of min, max and currency a year; null without a known interval or any valid amount."""
    times = F.create_map(*(F.lit(v) for kv in PAY_INTERVALS.items() for v in kv))[F.coalesce(F.nullif(interval, F.lit("")), F.lit("1 YEAR"))]
    number = lambda x: F.when((F.expr("double('inf')") > n) & (n >= 0), n) if (n := x.cast("string").try_cast("double")) is not None else x
    a, b = number(low) * times, number(high) * times
    a, b = F.coalesce(a, b), F.coalesce(b, a)
    pay = F.struct(F.least(a, b).alias("min"), F.greatest(a, b).alias("max"), F.upper(trim(_s(currency))).alias("currency"))
    return F.when(times.isNotNull() & a.isNotNull(), pay)


def format_salary(salary: Column) -> Column:
    """P25: ``low-high currency`` as far as known and positive."""
    number = lambda x: F.when(x > 0, F.floor(x + 0.5).cast("string"))
    low, high = number(salary["min"]), number(salary["max"])
    span = F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(low, F.lit("-"), high)).otherwise(F.coalesce(low, high))
    currency = trim(_s(salary["currency"]))
    return markdown_field(F.when(span.isNull(), "").when(currency != "", F.concat(span, F.lit(" "), currency)).otherwise(span))


def locations(raw: Column) -> Column:
    """A string of locations as a list."""
    return F.filter(F.transform(F.split(_s(raw), r"[、，,/|]"), trim), lambda x: x != "")


def fold_locations(primary: Column, secondary: Column) -> Column:
    """A posting's location and the location, locality and country of its others, distinct, in one string.

    ``secondary``: array of structs location, locality, country."""
    more = F.flatten(F.transform(F.coalesce(secondary, F.array().cast(_PLACES)), lambda s: F.array(s["location"], s["locality"], s["country"])))
    every = F.transform(F.array_compact(F.concat(F.array(primary), more)), trim)
    return F.array_join(F.array_distinct(F.filter(every, lambda x: x != "")), " · ")


_PLACES = "array<struct<location:string,locality:string,country:string>>"


def thread_comment(text: Column, thread_url: Column) -> Column:
    """Struct of title, url, company and location of a hiring thread's comment, whose first line is
    ``company | role | location``; null without a title or an address."""
    x = replace(_s(text), r'(?i)<a\s[^>]*href="([^"]+)"[^>]*>.*?</a>', "$1")
    x = replace(replace(x, r"(?i)</?(?:p|br|div|li|h[1-6])(?![A-Za-z0-9_])[^>]*>", "\n"), "<[^>]+>", " ")
    for name, char in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&#x2F;", "/"), ("&nbsp;", " ")]:
        x = F.replace(x, F.lit(name), F.lit(char))
    head = F.get(_lines(replace(x, r"\r\n?", "\n")), F.lit(0))
    parts = F.transform(F.split(head, r"\|"), trim)
    n = F.size(parts)
    place = F.when(n >= 3, trim(replace(F.get(parts, F.lit(2)), f"https?://[^{WS}]+"))).otherwise("")
    title = trim(replace(replace(head, f"https?://[^{WS}]+"), f"[{WS}]{{2,}}", " "))
    url = F.coalesce(F.nullif(replace(F.regexp_extract(x, rf"(https?://[^{WS}<>\"]+)", 1), r"[.,;:!?)\]]+$"), F.lit("")), F.nullif(thread_url, F.lit("")))
    row = F.struct(title.alias("title"), url.alias("url"), F.when(n >= 2, parts[0]).otherwise("").alias("company"), place.alias("location"))
    return F.when((title != "") & url.isNotNull(), row)


def bounded_error(x: Column) -> Column:
    """At most 240 characters of an error."""
    return F.substring(F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown error")), 1, 240)


def redact(x: Column) -> Column:
    """A diagnostic without credentials, at most 240 characters."""
    return F.substring(replace(_s(x), rf"(?i)(?:authorization|bearer|api[_-]?key|token)[{WS}]*[:=]?[{WS}]*[^{WS},;]+", "[REDACTED]"), 1, 240)


def slug_candidates(name: Column) -> Column:
    """Likely slugs of a company at job boards, most specific first."""
    return let(F.filter(F.split(clean(replace(F.lower(_s(name)), rf"[^a-z0-9{WS}]", " ")), " "), lambda x: x != ""), _slugs)


def _slugs(w: Column) -> Column:
    shapes = [F.array_join(w, ""), F.array_join(w, "-"), F.array_join(w, "_"), w[0]]
    for base in (F.array_join(w, ""), w[0]):
        shapes += [F.concat(base, F.lit(end)) for end in ("ai", "tech", "io", "hq", "labs", ".tech", ".io")]
    return F.when(F.size(w) > 0, F.array_distinct(F.array(*shapes))).otherwise(F.array().cast("array<string>"))


def fetch_error_class(status: Column, message: Column, name: Column) -> Column:
    """Why a probe failed."""
    m = _s(message)
    nothing = status.isNull() & message.isNull() & name.isNull()
    return (
        F.when(nothing, "unknown")
        .when(name.eqNullSafe(F.lit("AbortError")) | m.rlike("(?i)ECONNREFUSED|ENOTFOUND|ETIMEDOUT|fetch failed|network"), "network")
        .when(status.isin(404, 410), "slug_gone")
        .when(status.isin(401, 403), "auth")
        .when(status >= 500, "server")
        .when(m.rlike("HTTP 404|HTTP 410"), "slug_gone")
        .when(m.rlike("HTTP 401|HTTP 403"), "auth")
        .when(m.rlike(r"HTTP 5\d\d"), "server")
        .otherwise("unknown")
    )


def company_hint(company: Column, title: Column) -> Column:
    """The company that a search hit names, or what its title has before a word for jobs."""
    head = F.regexp_extract(clean(title), rf"(?iu)^(.{{2,80}}?)(?:招聘官网|招聘职位|校园招聘|社会招聘|招聘|Careers|Jobs)(?:[{WS}]|[-–—:：|｜]|$)", 1)
    return F.coalesce(present(company), trim(head))


def infer_company(title: Column, snippet: Column) -> Column:
    """The first name with a legal form in a hit, or else the first part of its title that isn't about jobs."""
    text = replace(F.concat(_s(title), F.lit(" "), _s(snippet)), "(?iu)(?:实习僧|应届生求职网|BOSS直聘|智联招聘|国家大学生就业服务平台)", " ")
    text = replace(text, "[｜|_—–]+", " ")
    legal = F.regexp_extract(text, r"([㐀-鿿A-Za-z0-9·（）()\-]{2,40}(?:股份有限公司|有限责任公司|有限公司|集团|银行|证券|研究院|研究所|事务所|学校|医院))", 1)
    parts = F.transform(F.split(_s(title), r"[-｜|_—–]"), trim)
    other = F.filter(parts, lambda x: x.rlike(r"[㐀-鿿]") & ~x.rlike("招聘|校招|实习|岗位|职位|工程师|求职"))
    return F.when(legal != "", trim(legal)).otherwise(F.coalesce(F.substring(F.get(other, F.lit(0)), 1, 40), F.lit("")))


def tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(planner_text(x), " "), lambda t: F.length(t) > 1))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller number of tokens."""
    return let(F.struct(tokens(a).alias("x"), tokens(b).alias("y")), lambda t: _overlap(t["x"], t["y"]))


def _overlap(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.least(F.size(x), F.size(y)).cast("double")), F.lit(0.0))


def is_lookalike(domain: Column, official: Column) -> Column:
    """Another domain within two edits of the official one."""
    return (official != "") & (domain != official) & F.levenshtein(domain, official, 2).between(0, 2)
