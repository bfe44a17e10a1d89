"""Entity resolution and registry look-ups.  J6, J8, J10, J11, P8, U7, J17, J15, J14."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions.text import company_alias, planner_company, planner_text, present, tokens
from veldra.functions.urls import host, host_suffixes
from veldra.operators.pick import first_by
from veldra.operators.scratch import materialize
from veldra.operators.similarity import set_key, similar_sets


def resolve_companies(rows: DataFrame, companies: DataFrame, name: str = "company") -> DataFrame:
    """``rows`` with companyId, canonicalName, matchedBy and confidence.

    ``companies``: (companyId, canonicalName, aliases array, pos); the first company that has the alias wins.  An
    equi-join on the alias key, which Spark broadcasts if the table is small.
    """
    names = companies.select("companyId", "canonicalName", "pos", F.explode(F.concat(F.array("canonicalName"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    table = first_by(names.select("companyId", "canonicalName", "pos", company_alias(F.col("n")).alias("_key")), ["_key"], F.col("pos")).drop("pos")
    table = table.select(F.col("companyId").alias("_id"), F.col("canonicalName").alias("_name"), "_key")
    key = company_alias(F.col(name))
    out = rows.withColumn("_k", key).join(table, F.col("_k") == F.col("_key"), "left")
    known = F.col("_id").isNotNull()
    return (
        out.withColumn("companyId", F.coalesce("_id", "_k"))
        .withColumn("canonicalName", F.coalesce("_name", present(F.col(name)), F.lit("")))
        .withColumn("matchedBy", F.when(known, "known_alias").otherwise("legal_suffix_normalization"))
        .withColumn("confidence", F.when(known, 1.0).when(F.col("_k") != "", 0.8).otherwise(0.0))
        .drop("_k", "_key", "_id", "_name")
    )


def domain_hits(pages: DataFrame, registry: DataFrame, url: str = "url") -> DataFrame:
    """(page columns, domain, entry) of pages whose host is a registered domain or below one; the longest
    domain wins.  ``registry``: (domain, entry), each domain once.

    Hosts are resolved once each, by an equi-join of their suffixes with the registry, and joined back.
    """
    hosts = pages.select(host(F.col(url)).alias("_h")).where("_h is not null").distinct()
    found = hosts.withColumn("domain", F.explode(host_suffixes(F.col("_h")))).join(registry, "domain")
    best = found.groupBy("_h").agg(F.max_by(F.struct("domain", "entry"), F.length("domain")).alias("_hit"))
    return pages.withColumn("_h", host(F.col(url))).join(best, "_h").select(*pages.columns, "_hit.domain", "_hit.entry")


def promote_leads(leads: DataFrame, jobs: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(leads with their official job, leads without): the first job of the company with the same title or enough
    shared words.  ``leads``: (lead, company, title); ``jobs``: (pos, company, title, url).

    Different titles of a company are compared once, by a set-similarity join; see ``similarity.similar_sets``.
    """
    named = lambda df: df.withColumn("_c", planner_company(F.col("company"))).withColumn("_t", planner_text(F.col("title"))).withColumn("_set", set_key(F.col("_c"), tokens(F.col("title"))))
    a, b = named(leads), named(jobs)
    best = lambda df, keys: df.groupBy(keys).agg(F.min("pos").alias("_pos"), F.min_by("url", "pos").alias("_url"))
    same = a.select("lead", "_c", "_t").join(best(b, ["_c", "_t"]), ["_c", "_t"]).select("lead", "_pos", "_url")
    sets = lambda df: df.select(F.col("_c").alias("block"), tokens(F.col("title")).alias("items"))
    pairs = similar_sets(sets(a), sets(b), least).select(F.col("a").alias("_set"), F.col("b").alias("_b"))
    # the first job of each set stands for it; leads with one set share its answer
    answers = pairs.join(best(b, ["_set"]).withColumnRenamed("_set", "_b"), "_b").groupBy("_set").agg(F.min("_pos").alias("_pos"), F.min_by("_url", "_pos").alias("_url"))
    alike = a.select("lead", "_set").join(answers, "_set").select("lead", "_pos", "_url")
    found = materialize(same.unionByName(alike).groupBy("lead").agg(F.min_by("_url", "_pos").alias("official_url")))
    return leads.join(found, "lead"), leads.join(found, "lead", "left_anti")


def merge_targets(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, targets, target, conflict) of incoming companies (id, name, domains, aliases): the stored ones that
    share id, domain, name or alias; several different ones are a conflict.

    Four equi-joins in one: every company is exploded into its tagged keys, and keys meet.  A key that more than one
    stored company has cannot tell them apart; it still counts as a match with each, which is what makes a conflict.
    """

    def keys(df: DataFrame, as_id: str) -> DataFrame:
        tag = lambda t, c: F.concat(F.lit(t), c)
        lists = lambda t, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.concat(F.lit(t), company_alias(x) if t == "name:" else F.lower(x)))
        every = F.concat(F.array(tag("id:", F.col("id").cast("string")), tag("name:", company_alias(F.col("name")))), lists("domain:", "domains"), lists("name:", "aliases"))
        return df.select(F.col("id").alias(as_id), F.explode(F.array_distinct(F.array_compact(every))).alias("key")).where("key not in ('name:', 'domain:')")

    met = keys(incoming, "id").join(keys(stored, "target"), "key").select("id", "target").distinct()
    out = met.groupBy("id").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    return out.select("id", "targets", F.when(F.size("targets") == 1, F.col("targets")[0]).alias("target"), (F.size("targets") > 1).alias("conflict"))


def shared_urls(records: DataFrame, urls: str = "urls") -> DataFrame:
    """(url, records) of addresses that several records have, and how many."""
    return records.select("id", F.explode(F.array_distinct(urls)).alias("url")).groupBy("url").agg(F.count("*").alias("records")).where("records > 1")


def fan_back(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Results of each query to all projects that asked it."""
    return queries.join(results, "query")


def lookup_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests (url) with the last page seen (seq) under that address, asked for or arrived at; status
    FETCH_FAILED where there is none."""
    from veldra.operators.pick import last_by

    seen = pages.withColumn("_u", F.explode(F.array_distinct(F.array_compact(F.array("requestedUrl", "finalUrl")))))
    table = last_by(seen.select("_u", "finalUrl", "status", "html", "seq"), ["_u"], F.col("seq")).drop("seq")
    out = requests.join(table, requests["url"] == F.col("_u"), "left").drop("_u")
    return out.withColumn("outcome", F.when(F.col("status").isNull(), "FETCH_FAILED").otherwise("FETCHED"))


def has_shared(a: Column, b: Column) -> Column:
    """E2"""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))
