"""Filters of postings.  The IDs are those of the operator inventory.

Each is a boolean Column built once from its configuration; ``first_failed_stage`` names the first that a row fails.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions.dates import add_days, days_between
from veldra.functions.text import _s, company_match, has_keyword, trim, whole


def _words(values: Sequence[str] | str | None) -> list[str]:
    values = [values] if isinstance(values, str) else values or []
    return [k for k in (v.strip().lower() for v in values if isinstance(v, str)) if k]


def _any(tests: list[Column], default: bool = False) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(default)


def title_filter(title: Column, positive: Sequence[str] = (), negative: Sequence[str] = ()) -> Column:
    """any positive word (all titles if there is none) and no negative one."""
    x = F.lower(_s(title))
    return _any([has_keyword(x, k) for k in _words(positive)], True) & ~_any([has_keyword(x, k) for k in _words(negative)])


def matched_keywords(title: Column, positive: Sequence[str]) -> Column:
    """the positive words of a title."""
    x = F.lower(_s(title))
    return F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(has_keyword(x, k.strip().lower()), k) for k in positive if k.strip())))


def location_filter(location: Column, always: Sequence[str] = (), allow: Sequence[str] = (), block: Sequence[str] = ()) -> Column:
    """unknown passes; always beats block beats allow."""
    x = F.lower(_s(location))
    has = lambda words: _any([x.contains(k) for k in _words(words)])
    return F.when(trim(x) == "", True).when(has(always), True).when(has(block), False).otherwise(has(allow) if _words(allow) else F.lit(True))


def age_filter(posted_at: Column, now: Column, days: int | None) -> Column:
    """undated passes; ``posted_at`` and ``now`` are of one type of time."""
    if not days or days <= 0:
        return F.lit(True)
    return F.coalesce(posted_at >= now - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(True))


def _rule(x: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    return ~_any([x.contains(k) for k in _words(negative)]) & _any([x.contains(k) for k in _words(positive)], True)


def content_filter(description: Column, title: Column, title_words: Sequence[str], positive: Sequence[str] = (), negative: Sequence[str] = (), by_title: Mapping[str, Mapping[str, Sequence[str]]] | None = None) -> Column:
    """words of the description; a title word with rules of its own overrides the general ones, any of several
    suffices.  An empty description passes."""
    x, t = F.lower(_s(description)), F.lower(_s(title))
    rules = {k.strip().lower(): v for k, v in (by_title or {}).items() if k.strip()}
    own = [(has_keyword(t, k), _rule(x, rules[k].get("positive", ()), rules[k].get("negative", ()))) for k in _words(title_words) if k in rules]
    general = _rule(x, positive, negative)
    return F.when(trim(x) == "", True).when(_any([hit for hit, _ in own]), _any([hit & ok for hit, ok in own])).otherwise(general)


def salary_filter(salary_min: Column, salary_max: Column, currency: Column, low: float = 0, high: float = 0, wanted: str = "") -> Column:
    """ranges overlap; another currency fails only if both are known; unknown pay and senseless bounds pass."""
    if low < 0 or high < 0 or (high > 0 and low > high) or (low == 0 and high == 0):
        return F.lit(True)
    a, b = F.coalesce(salary_min, salary_max), F.coalesce(salary_max, salary_min)
    own = F.upper(trim(_s(currency)))
    other = (own != "") & (own != wanted.strip().upper()) if wanted.strip() else F.lit(False)
    bad = other | (F.lit(low > 0) & (b < low)) | (F.lit(high > 0) & (a > high))
    return F.coalesce(~F.when(b.isNotNull(), bad), F.lit(True))


def cooldown(jobs: DataFrame, windows: DataFrame, today: str, key: str = "seq") -> DataFrame:
    """``jobs`` (seq, company, title) with cooldown: ``cooldown:company:until`` of the first window that
    holds, or null.

    ``windows``: a table of some rows of configuration (pos, company, last_apply_date, same_role_days, applied_to
    array, bucket).  Names are matched once for each company, not for each job; jobs then meet their company's windows
    by an equi-join.
    """
    from veldra.operators.scratch import listed

    names = jobs.select(F.col("company").alias("_name")).where("_name is not null").distinct()
    matched = names.join(listed(windows).alias("v"), company_match(F.col("_name"), F.col("v.company"))).select("_name", "v.*")
    until = add_days(F.col("w.last_apply_date"), F.coalesce(F.col("w.same_role_days"), F.lit(0)))
    t = F.lower(_s(F.col("j.title")))
    applied = F.exists(F.coalesce(F.col("w.applied_to"), F.array().cast("array<string>")), lambda r: t.contains(F.lower(r)))
    generic = F.array(*map(F.lit, ["", "all", "roles", "role", "family", "bucket", "group", "team"]))
    bucket = F.filter(F.split(F.lower(_s(F.col("w.bucket"))), "_"), lambda k: ~F.array_contains(generic, k))
    crossed = F.exists(bucket, lambda k: F.when(k == "em", t.rlike(whole("em")) | t.contains("engineering manager")).otherwise(t.contains(k)))
    holds = (F.col("j.company") == F.col("w._name")) & (F.lit(today) < until) & (applied | crossed)
    hit = jobs.alias("j").join(matched.alias("w"), holds).groupBy(F.col(f"j.{key}").alias("_k")).agg(F.min_by(F.concat(F.lit("cooldown:"), F.col("w.company"), F.lit(":"), until), F.col("w.pos")).alias("cooldown"))
    return jobs.join(hit, jobs[key] == F.col("_k"), "left").drop("_k")


def tier_filter(tier: Column, skip: Sequence[str]) -> Column:
    """F8"""
    return ~tier.isin(*skip) if skip else F.lit(True)


def is_settled(status: Column, first_seen: Column, today: str, recheck_days: int | None) -> Column:
    """whether a row of history still keeps its url from being added (Q10: any other status than added does)."""
    s = F.coalesce(status, F.lit("added"))
    age = days_between(first_seen, F.lit(today))
    recheck = F.lit(True) if recheck_days is None else F.coalesce(age < recheck_days, F.lit(True))
    return F.when(F.startswith(s, F.lit("cooldown:")), F.lit(today) < F.element_at(F.split(s, ":"), -1)).when(s != "added", True).otherwise(recheck)


def is_recent(published: Column, now: Column, days: int) -> Column:
    """dated and within the window."""
    return F.coalesce(published >= now - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(False)) & F.lit(days > 0)


def posting_date_class(posted: Column, now: Column, days: int) -> Column:
    """fresh, stale or undated."""
    return F.when(posted.isNull(), "undated").when(is_recent(posted, now, days), "fresh").otherwise("stale")


def opening_rejection(status: Column, role_ok: Column, place_ok: Column, has_entry: Column, recent: Column) -> Column:
    """why an opening isn't kept; null if it is."""
    return F.when(status != "ACTIVE", "inactive").when(~role_ok, "role_mismatch").when(~place_ok, "location_mismatch").when(~has_entry, "no_entry").when(~recent, "stale")


def first_failed_stage(**stages: Column) -> Column:
    """The name of the first stage that a row fails, ``added`` if none; a null test passes."""
    out = F.lit("added")
    for name, ok in reversed(stages.items()):
        out = F.when(~F.coalesce(ok, F.lit(True)), name).otherwise(out)
    return out


def stage_counts(df: DataFrame, stage: str = "stage") -> DataFrame:
    """Rows of each stage."""
    return df.groupBy(stage).agg(F.count("*").alias("rows"))


def natural_results(rows: DataFrame, keys: list[str], top: int, *order: Column) -> DataFrame:
    """organic hits ranked anew, the first ``top`` of each search."""
    from pyspark.sql import Window

    organic = rows.where(~F.lower(F.coalesce(F.col("kind"), F.lit("organic"))).isin("ad", "advertisement", "sponsored", "promotion", "news"))
    return organic.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)


def formal_openings(openings: DataFrame, portals: DataFrame) -> DataFrame:
    """Openings of verified official portals, and open ones of confirmed platform portals."""
    p = portals.select(F.col("id").alias("_pid"), "verificationStatus", "platformIdentityConfirmed", F.col("sourceTier").alias("_tier"))
    official = (F.col("_tier") != "PLATFORM_ONLY") & (F.col("verificationStatus") == "VERIFIED")
    platform = (F.col("_tier") == "PLATFORM_ONLY") & F.col("platformIdentityConfirmed") & (F.col("status") == "ACTIVE")
    return openings.join(p, openings["careerPortalId"] == F.col("_pid")).where(official | platform).select(*openings.columns)


def pending_candidates(candidates: DataFrame, companies: DataFrame | None = None, recheck: bool = False) -> DataFrame:
    """candidates not decided yet (or all), of some companies (or all)."""
    open_ones = candidates if recheck else candidates.where(F.coalesce(F.col("verdict"), F.lit("")).isin("", "MANUAL_REVIEW", "BLOCKED"))
    return open_ones if companies is None else open_ones.join(companies.select("companyId").distinct(), "companyId", "left_semi")


def plan_queries(queries: DataFrame, providers: Sequence[str], most: int = 20) -> DataFrame:
    """queries (pos, text, providers array, topK) trimmed to 240, distinct, with known providers, topK 1 to 20."""
    from veldra.operators.pick import first_by

    text = F.substring(F.trim(F.regexp_replace(_s(F.col("text")), r"(?U)\s+", " ")), 1, 240)
    known = F.array_intersect(F.coalesce("providers", F.array().cast("array<string>")), F.array(*map(F.lit, providers)))
    rows = queries.select("pos", text.alias("text"), known.alias("providers"), F.greatest(F.lit(1), F.least(F.lit(20), F.coalesce("topK", F.lit(8)))).alias("topK")).where("text <> ''")
    return first_by(rows, ["text"], F.col("pos")).orderBy("pos").limit(most)


def violations(**rules: Column) -> Column:
    """Names of the invariants that a row breaks."""
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in rules.items())))
