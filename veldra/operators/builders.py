"""Queries for searches, as lists made by native functions.  B1 to B6, C25, K9."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions.text import _s, brand_tokens, trim
from veldra.operators.scratch import listed


def official_queries(company: Column, year: Column, kind: Column, domain: Column, limit: int = 3) -> Column:
    """B1: distinct queries for a company's own pages, the first so many."""
    c, k, d = trim(_s(company)), trim(_s(kind)), trim(_s(domain))
    q = F.concat(F.lit('"'), c, F.lit('"'))
    cohort = F.when(year > 0, F.concat(year.cast("string"), F.lit("届")))
    some = [
        F.concat(q, F.lit(" 招聘官网")),
        F.concat(q, F.lit(" 校园招聘")),
        F.concat(q, F.lit(" careers")),
        F.concat(q, F.lit(" jobs")),
        F.concat(q, F.lit(' "'), cohort, F.lit('" 校园招聘')),
        F.when(k != "", F.concat(q, F.lit(' "'), k, F.lit('"'))),
        F.when(k != "", F.concat(q, F.lit(' "'), cohort, F.lit('" "'), k, F.lit('"'))),
        *(F.when(d != "", F.concat(F.lit("site:"), d, F.lit(" "), tail)) for tail in (F.lit("招聘"), F.lit("校园招聘"), cohort)),
    ]
    return F.when(c != "", F.slice(F.array_distinct(F.array_compact(F.array(*some))), 1, max(1, limit))).otherwise(F.array().cast("array<string>"))


def company_queries(company: Column, market: Column, role: Column) -> Column:
    """Queries for a company's careers and campus pages in its market."""
    b = brand_tokens(company)
    name = F.when(F.size(b["englishTokens"]) > 0, b["query"]).otherwise(F.concat(F.lit('"'), trim(_s(company)), F.lit('"')))
    r = trim(_s(role))
    cn = [F.concat(name, F.lit(" 校园招聘 官网")), F.concat(name, F.lit(" 招聘 加入我们")), F.when(r != "", F.concat(name, F.lit(" "), r, F.lit(" 招聘")))]
    na = [F.concat(name, F.lit(" careers")), F.concat(name, F.lit(" university campus jobs")), F.when(r != "", F.concat(name, F.lit(" "), r, F.lit(" jobs")))]
    return F.array_distinct(F.array_compact(F.when(market == "CN", F.array(*cn)).otherwise(F.array(*na))))


def index_queries(sources: DataFrame, roles: DataFrame, group: int = 6) -> DataFrame:
    """(source, group, text): every source (source, domain) with every six roles (pos, role).

    Both are lists of configuration of some tens of rows; the product is meant."""
    groups = roles.groupBy(F.floor(F.col("pos") / group).alias("group")).agg(F.array_sort(F.collect_list(F.struct("pos", "role"))).alias("r"))
    text = F.concat(F.lit("site:"), F.col("domain"), F.lit(" ("), F.array_join(F.transform("r", lambda x: x["role"]), " OR "), F.lit(") 校园招聘"))
    return sources.join(listed(groups)).select("source", "group", text.alias("text"))


def platform_searches(roles: DataFrame, locations: DataFrame, days: int = 90, most: int = 20) -> DataFrame:
    """(source, role, location, url) of at most 12 roles and 8 places, 20 for a source."""
    from veldra.operators.pick import top_n

    pairs = roles.orderBy("pos").limit(12).select(F.col("pos").alias("rp"), "role").join(locations.orderBy("pos").limit(8).select(F.col("pos").alias("lp"), "location"))
    q, at = F.url_encode("role"), F.url_encode("location")
    span = F.lit("&f_TPR=r604800" if days <= 7 else "&f_TPR=r2592000" if days <= 30 else "")
    urls = F.create_map(F.lit("LinkedIn"), F.concat(F.lit("https://www.linkedin.com/jobs/search/?keywords="), q, F.lit("&location="), at, F.lit("&f_E=2%2C3&f_JT=F%2CI&sortBy=DD"), span), F.lit("Indeed"), F.concat(F.lit("https://www.indeed.com/jobs?q="), q, F.lit("&l="), at, F.lit(f"&sort=date&fromage={min(days, 30)}")))
    rows = pairs.select("rp", "lp", "role", "location", F.explode(urls).alias("source", "url"))
    return top_n(rows, ["source"], most, F.col("rp"), F.col("lp")).drop("rp", "lp")


def search_plan(roles: Sequence[str], region: str = "NA", days: int = 90, negative: Sequence[str] = ()) -> dict:
    """A plan as data: title words, negative words, window and market."""
    words = list(dict.fromkeys(r.strip() for r in roles if r.strip()))
    return {"roles": words, "title_filter": {"positive": words, "negative": list(dict.fromkeys(negative))}, "max_age_days": max(1, min(180, days)), "market": region}


def occupations(intents: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(intent columns, family, titles): the first family, in the order of pos, one of whose terms the role
    contains.  ``taxonomy``: (pos, family, terms array, titles array), a list of configuration."""
    term = F.explode(F.transform("terms", F.lower)).alias("term")
    t = taxonomy.select("pos", "family", "titles", term)
    hit = intents.join(listed(t), F.lower(_s(F.col("role"))).contains(F.col("term"))).groupBy("intent").agg(F.min_by(F.struct("family", "titles"), "pos").alias("f"))
    return intents.join(hit, "intent", "left").select(*intents.columns, "f.family", "f.titles")


def known_sources(given: Column, known: Sequence[str]) -> Column:
    """K9: the given sources that are known, all known ones if none is."""
    every = F.array(*map(F.lit, known))
    some = F.array_intersect(F.coalesce(given, F.array().cast("array<string>")), every)
    return F.when(F.size(some) > 0, some).otherwise(every)
