"""Verification of career portals by weighted evidence.  J3, W2, A6, A7, D15, C2, J12, J13."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.functions import rules
from veldra.functions.dates import clamp
from veldra.operators.pick import first_by


def evidence_rules(spark: SparkSession) -> DataFrame:
    """The rule table, 18 rows."""
    return spark.createDataFrame([(k, *v) for k, v in rules.EVIDENCE.items()], "code string, direction string, weight int, anchor boolean, hard_reject boolean")


def unknown_codes(evidence: DataFrame) -> DataFrame:
    """Rows whose code has no rule; any is an error."""
    return evidence.where(~F.col("code").isin(list(rules.EVIDENCE)) | F.col("code").isNull())


def verdicts(evidence: DataFrame, portal: str = "portal", page_type: str = "page_type", *order: Column) -> DataFrame:
    """(portal, score, status, anchored, n_evidence): the first evidence of each code counts, with its rule's weight.

    Any hard reject rejects; else a blocked page blocks; else 50 points, an anchor and a known page type verify; else
    fewer than 45 points reject; else it is for review.  The rules are 18 rows by definition and are broadcast.
    """
    rows = evidence.select(F.col(portal).alias("portal"), "code", F.col(page_type).alias("page_type"), F.struct(*order).alias("o"))
    one = first_by(rows, ["portal", "code"], F.col("o"))
    known = one.join(F.broadcast(evidence_rules(evidence.sparkSession)), "code")
    sums = known.groupBy("portal").agg(
        F.sum("weight").alias("w"),
        F.bool_or("hard_reject").alias("rejected"),
        F.bool_or(F.col("code") == "blocked_page").alias("blocked"),
        F.bool_or((F.col("direction") == "POSITIVE") & F.col("anchor")).alias("anchored"),
        F.min_by("page_type", "o").alias("page_type"),
        F.count("*").alias("n_evidence"),
    )
    score = clamp(F.col("w"), 0, 100).cast("int")
    known_page = F.coalesce(F.col("page_type"), F.lit("UNKNOWN")) != "UNKNOWN"
    status = F.when(F.col("rejected"), "REJECTED").when(F.col("blocked"), "BLOCKED").when((score >= 50) & F.col("anchored") & known_page, "VERIFIED").when(score < 45, "REJECTED").otherwise("REVIEW")
    return sums.select("portal", score.alias("score"), status.alias("status"), "anchored", "n_evidence")


def page_evidence(pages: DataFrame) -> DataFrame:
    """(portal, code, observed) from pages (portal, url, html, company, official_domain, tenant_verified,
    official_linked)."""
    from veldra.functions.classify import hard_negative, has_recruitment_structure
    from veldra.functions.text import _s, strip_tags
    from veldra.functions.urls import ats, host, is_private_host

    h, text = host(F.col("url")), strip_tags(F.col("html"), False)
    own = (_s(F.col("official_domain")) != "") & ((h == F.col("official_domain")) | F.endswith(h, F.concat(F.lit("."), F.col("official_domain"))))
    vendor = ats(F.col("url"))
    row = lambda cond, code, seen: F.when(cond, F.struct(F.lit(code).alias("code"), seen.cast("string").alias("observed")))
    found = F.array_compact(
        F.array(
            row(own, "official_domain_match", h),
            row(vendor.isNotNull() & F.col("tenant_verified"), "verified_ats_tenant", vendor),
            row(vendor.isNotNull() & F.col("official_linked"), "official_site_confirms_ats_tenant", vendor),
            row(has_recruitment_structure(text), "recruitment_structure", F.lit("text")),
            row(text.rlike("(?i)立即投递|立即申请|apply now|submit application"), "apply_action", F.lit("text")),
            row(F.col("official_linked") & vendor.isNull(), "official_site_backlink", h),
            row(vendor.isNotNull() & ~F.col("tenant_verified") & ~F.col("official_linked"), "ats_fingerprint_only", vendor),
            row(hard_negative(F.col("url"), text).isNotNull(), "x", F.lit("")),
            row(is_private_host(h), "private_or_payment_risk", h),
        )
    )
    negative = hard_negative(F.col("url"), text)
    found = F.transform(found, lambda e: F.when(e["code"] == "x", F.struct(negative.alias("code"), h.alias("observed"))).otherwise(e))
    return pages.select("portal", F.explode(found).alias("e")).select("portal", "e.code", "e.observed")


def platform_fallback(portals: DataFrame, platforms: DataFrame, coverage: str = "PARTIAL") -> DataFrame:
    """(company, publish, reason): whether a company's platform page may stand in for its own portals."""
    own = portals.groupBy("company").agg(
        F.bool_or((F.col("status") == "VERIFIED") & (F.col("availability") == "OPENINGS_FOUND")).alias("active"),
        F.bool_or((F.col("status") == "VERIFIED") & (F.col("availability") == "NO_OPENINGS")).alias("none"),
        F.bool_or((F.col("status") == "BLOCKED") | (F.col("availability") == "UNKNOWN")).alias("shut"),
    )
    has = F.coalesce(F.col("confirmed"), F.lit(False)) & (F.coalesce(F.col("n_jobs"), F.lit(0)) > 0)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = F.when(flag("active"), "OFFICIAL_SOURCE_AVAILABLE").when(~has, "PLATFORM_IDENTITY_OR_JOBS_MISSING").when(flag("none"), "OFFICIAL_NO_OPENINGS").when(flag("shut"), "OFFICIAL_INACCESSIBLE").otherwise("NO_OFFICIAL_FOUND")
    out = platforms.join(own, "company", "left").select("company", reason.alias("reason"))
    return out.withColumn("publish", F.col("reason").startswith("OFFICIAL_NO") | F.col("reason").isin("OFFICIAL_INACCESSIBLE", "NO_OFFICIAL_FOUND")).withColumn("coverage", F.when(F.col("publish"), coverage))


def registered(candidates: DataFrame, tenants: DataFrame) -> DataFrame:
    """Candidates whose vendor, tenant and company are registered."""
    return candidates.join(tenants, ["vendor", "tenant", "company"], "left_semi")


def key_violations(rows: DataFrame, parents: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a column of that name: whether the key has no parent."""
    there = parents.select(F.col(key).alias("_p")).distinct().withColumn("_there", F.lit(True))
    return rows.join(there, rows[key] == F.col("_p"), "left").withColumn(name, F.col("_there").isNull()).drop("_p", "_there")
