"""A versioned store of Parquet tables with upserts and all-or-nothing commits.  S7, S8, X1 to X16, X11.

Each commit writes new versions of the tables it changes beside the old ones and then one manifest, which names the
version of every table; readers only follow the newest manifest.  A failed commit leaves files that nothing names.
Manifests are written and read by Spark, so that any file system will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veldra.functions.urls import host, host_in, recruitment_channel
from veldra.functions.values import first_by as first_of

#: Rules of a column when a row is both stored and incoming.
OLD, NEW = "old", "new"


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: Mapping[str, str | Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """A full outer join by key.  A column's rule says what a row that is on both sides gets:
    ``new`` (the default), ``old`` (kept if not null, as first-seen times and names are), or a function of both."""
    rules = rules or {}
    a = old.select(*(F.col(c).alias(f"o_{c}") for c in old.columns), F.lit(True).alias("_o"))
    b = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns), F.lit(True).alias("_n"))
    on = reduce(lambda x, y: x & y, (F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in keys))
    both = F.col("_o").isNotNull() & F.col("_n").isNotNull()

    def value(c: str) -> Column:
        x, y = F.col(f"o_{c}"), F.col(f"n_{c}") if c in new.columns else F.lit(None)
        rule = rules.get(c, NEW)
        merged = F.coalesce(x, y) if rule == OLD else y if rule == NEW else rule(x, y)
        return F.when(both, merged).when(F.col("_n").isNotNull(), y).otherwise(x).cast(old.schema[c].dataType).alias(c)

    return a.join(b, on, "full_outer").select(*map(value, old.columns))


def prefer_new(x: Column, y: Column) -> Column:
    """The incoming value unless it is null."""
    return F.coalesce(y, x)


def union_of(x: Column, y: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(x, F.slice(y, 1, 0)), F.coalesce(y, F.slice(x, 1, 0))))


#: X1
COMPANY_RULES = {"canonicalName": OLD, "chineseName": OLD, "englishName": OLD, "primaryOfficialDomain": prefer_new, "aliases": union_of, "officialDomains": union_of, "industryTags": union_of, "createdAt": OLD}
#: X3, X5, X6
PORTAL_RULES = {"firstSeenAt": OLD}

_later = lambda x, y: F.greatest(x, y)
_filled = lambda x, y: F.coalesce(F.nullif(x, F.lit("")), y)
_newer = lambda x, y: F.coalesce(F.nullif(y, F.lit("")), x)
_longer = lambda x, y: F.when(F.length(F.coalesce(y, F.lit(""))) > F.length(F.coalesce(x, F.lit(""))), y).otherwise(x)
_newer_or = lambda default: lambda x, y: F.coalesce(F.nullif(y, F.lit("")), F.nullif(x, F.lit("")), F.lit(default))
_listed = lambda x, y: F.when(F.size(F.coalesce(y, F.array())) > 0, y).otherwise(F.coalesce(x, F.array()))
_number = lambda x, y: F.nullif(F.coalesce(F.nullif(y, F.lit(0)), x), F.lit(0))
KEEP = lambda x, y: x
#: X11: columns of a record of the bucketed database.
RECORD_RULES = {
    "company": _filled, "title": _filled, "location": _filled, "batchName": _filled, "projectId": _filled, "cohortYear": OLD, "firstSeenAt": OLD, "firstRunId": OLD,
    "postedAt": _later, "expiresAt": _later, "verificationCheckedAt": _later, "description": _longer,
    "finalApplyUrl": _newer, "announcementUrl": _newer, "detailUrl": _newer, "sources": union_of,
    "staleOrExpired": lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)),
    "seenCount": lambda x, y: F.coalesce(x, F.lit(1)) + 1,
    "newInRun": lambda x, y: F.lit(False),
    "scope": NEW, "jobType": NEW, "lastSeenAt": prefer_new, "lastRunId": prefer_new,
    "organizationType": lambda x, y: F.when(x == "待确认", y).otherwise(x),
    "recruitmentLinks": prefer_new, "verification": prefer_new,
    "recruitmentType": _filled, "companyStandardId": _filled, "companyRawName": lambda x, y: F.coalesce(_filled(x, y), F.lit("")),
    **{c: _newer_or("") for c in ("companyCleanName", "graduationYearRaw", "searchStatus", "ats")}, "audienceType": _newer_or("unknown"), "deadlineType": _newer_or("unknown"),
    **dict.fromkeys(("graduationYears", "redirectChain", "positions", "majors", "requirements", "campaignSources"), _listed),
    "searchDeferredByBudgetAt": _number, "officialLinkGovernedAt": _number,
    "positionsIncomplete": lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)),
}

#: Places of the sites in the order of a scope's records; other scopes have the last.  The order also names nowcoder,
#: which has no domain in the reference's catalogue and so ranks with the rest.
_SITES = {"internship": {"shixiseng.com": 50, "zhipin.com": 48, "liepin.com": 47}, "social": {"liepin.com": 50, "zhipin.com": 49, "zhaopin.com": 48}, "": {"zhipin.com": 49, "yingjiesheng.com": 48, "ncss.cn": 47}}


def _link_rank(url: Column, scope: Column) -> Column:
    """Official channels, then the scope's sites in their order, then the rest."""
    h = F.regexp_replace(F.coalesce(host(url), F.lit("")), r"^www\.", "")
    place = lambda sites: reduce(lambda out, s: F.when(host_in(h, [s[0]]), s[1]).otherwise(out), sites.items(), F.lit(1))
    official = recruitment_channel(url)["rank"]
    site = F.when(scope == "internship", place(_SITES["internship"])).when(scope == "social", place(_SITES["social"])).otherwise(place(_SITES[""]))
    return F.when(official >= 3, official + 100).otherwise(site)


def merge_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """X11: records merged by id; a verification at least as new as the stored one decides all its columns.  A column
    without a rule keeps its stored value."""
    for field in old.schema:
        if field.name not in new.columns:
            new = new.withColumn(field.name, F.lit(None).cast(field.dataType))
    checked = lambda side, df: F.coalesce(F.col(f"{side}_verificationCheckedAt"), F.lit(0)) if "verificationCheckedAt" in df.columns else F.lit(0)
    current = (checked("n", new) > 0) & (checked("n", new) >= checked("o", old))
    official = F.coalesce(F.col("n_officialVerified"), F.lit(False)) if "officialVerified" in new.columns else F.lit(False)
    some = lambda x, y: F.coalesce(F.nullif(x, F.lit("")), F.nullif(y, F.lit("")))
    yes = lambda x: F.coalesce(x, F.lit(False))
    rules = {c: KEEP for c in old.columns} | RECORD_RULES
    rules |= {c: (lambda x, y: F.when(current, yes(y)).otherwise(yes(x) | yes(y))) for c in ("officialVerified", "reachable", "officialCandidateFound", "officialIdentityConfirmed", "campaignConfirmed")}
    rules |= {c: (lambda x, y: F.when(current | official, y).otherwise(some(x, y))) for c in ("verificationStatus", "verificationReason")}
    rules["verificationState"] = lambda x, y: F.when(current, y).when(official, F.coalesce(F.nullif(y, F.lit("")), F.lit("VERIFIED"))).otherwise(F.coalesce(some(x, y), F.lit("UNVERIFIED")))
    rules["applicationActive"] = lambda x, y: F.when(current, y).otherwise(F.coalesce(y, x))
    rules["primaryUrl"] = lambda x, y: F.coalesce(F.when(official, some(y, x)).otherwise(some(x, y)), F.lit(""))
    rules["officialUrl"] = lambda x, y: F.when(official, some(y, x)).otherwise(some(x, y))
    if "sourceLinks" in old.columns:
        scope = F.coalesce(F.col("n_scope"), F.lit("")) if "scope" in new.columns else F.lit("")

        def links(x: Column, y: Column) -> Column:
            both = F.filter(F.concat(F.coalesce(x, F.slice(y, 1, 0)), F.coalesce(y, F.slice(x, 1, 0))), lambda l: F.coalesce(l["url"], F.lit("")) != "")
            ranked = F.transform(first_of(both, "url"), lambda l, i: F.struct((-_link_rank(l["url"], scope)).alias("r"), i.alias("i"), l.alias("l")))
            return F.coalesce(F.transform(F.array_sort(ranked), lambda l: l["l"]), F.array())

        rules["sourceLinks"] = links
        rules["sources"] = lambda x, y: F.array_distinct(F.filter(F.transform(links(F.col("o_sourceLinks"), F.col("n_sourceLinks")), lambda l: l["source"]), lambda v: F.coalesce(v, F.lit("")) != ""))
    return upsert(old, new, ["id"], rules)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New keys are added, known ones stay."""
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents that come in are replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def drop_unverified(openings: DataFrame, portals: DataFrame) -> DataFrame:
    """Openings of portals that aren't verified go."""
    bad = portals.where(F.col("verificationStatus") != "VERIFIED").select(F.col("id").alias("careerPortalId"))
    return openings.join(bad, "careerPortalId", "left_anti").select(*openings.columns)


def supersede(portals: DataFrame, events: DataFrame) -> DataFrame:
    """Platform portals of companies with official events are superseded by the smallest id of these events'
    portals; others, and those superseded already, stay as they are."""
    official = events.where(F.col("sourceTier") != "PLATFORM_ONLY").groupBy(F.col("companyId").alias("_c")).agg(F.min("careerPortalId").alias("_by"))
    joined = portals.join(official, portals["companyId"] == F.col("_c"), "left")
    by = F.when((F.col("sourceTier") == "PLATFORM_ONLY") & F.col("supersededByPortalId").isNull(), F.col("_by")).otherwise(F.col("supersededByPortalId"))
    return joined.withColumn("supersededByPortalId", by).select(*portals.columns)


def remap(rows: DataFrame, targets: DataFrame, column: str = "companyId") -> DataFrame:
    """Ids of merged companies become those of their targets (id, target)."""
    t = targets.where("target is not null").select(F.col("id").alias("_id"), "target")
    return rows.join(t, rows[column] == F.col("_id"), "left").withColumn(column, F.coalesce("target", column)).select(*rows.columns)


def start_items(items: DataFrame, batch: str, retry: bool = False, resume: bool = False) -> DataFrame:
    """Which items of a batch run next: pending ones, failed ones on request, deferred ones when the
    provider is healthy; their attempts are counted."""
    runs = (F.col("status") == "PENDING") | (F.lit(retry) & (F.col("status") == "FAILED")) | (F.lit(resume) & (F.col("status") == "DEFERRED"))
    due = (F.col("batchId") == batch) & runs
    return items.withColumn("attemptCount", F.when(due, F.col("attemptCount") + 1).otherwise(F.col("attemptCount"))).withColumn("status", F.when(due, "RUNNING").otherwise(F.col("status")))


def complete_items(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items (batchId, itemKey) with the outcome (status, errorMessage) of their run."""
    r = results.select("batchId", "itemKey", F.col("status").alias("_s"), F.col("errorMessage").alias("_e"))
    out = items.join(r, ["batchId", "itemKey"], "left")
    return out.withColumn("status", F.coalesce("_s", "status")).withColumn("errorMessage", F.when(F.col("_s").isNotNull(), F.substring("_e", 1, 240)).otherwise(F.col("errorMessage"))).select(*items.columns)


def quarantine(registry: DataFrame, legacy: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) entries."""
    bad = F.coalesce(legacy, F.lit(False))
    return registry.where(~bad), registry.where(bad)


class Store:
    """Tables under a root folder; see the module."""

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, StructType]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), dict(schemas)

    def _manifest(self) -> dict[str, str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return {}
        rows = self.spark.read.schema("seq long, name string, version string").json(f"{self.root}/_manifest")
        # one manifest is a row a table; the newest is the one with the greatest number
        last = rows.agg(F.max("seq")).head()[0]
        return {"": str(last or 0)} | {r["name"]: r["version"] for r in rows.where(F.col("seq") == last).collect()}

    def _claim(self, seq: int) -> None:
        """Take a commit's number: the file of that name is made by one writer only, the others' commits fail.  A writer
        that is lost between its claim and its manifest leaves the claim behind and no other can commit until ``release``
        takes it back.  This holds where making a file that must not exist is atomic, as on HDFS and local disks; on object
        stores, where it isn't, only one writer may commit at a time."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_claims/{seq}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).createNewFile(path):
            raise RuntimeError(f"commit {seq} is another writer's: read the tables again and repeat")

    def release(self) -> None:
        """Give up the claim of a writer that was lost, once it is known to be gone."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_claims/{int(self._manifest().get('', 0)) + 1}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)

    def read(self, name: str) -> DataFrame:
        """A table as of the newest commit; empty if never written."""
        version = self._manifest().get(name)
        if version is None:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}/{version}")

    def commit(self, tables: Mapping[str, DataFrame], checks: Sequence[DataFrame] = ()) -> int:
        """Write new versions of some tables and then the manifest.  ``checks``: frames of violations, which must be
        empty; else nothing is committed.  Returns the commit's number."""
        now = self._manifest()
        versions = {k: v for k, v in now.items() if k}
        for name, df in tables.items():
            versions[name] = uuid.uuid4().hex
            df.select(*self.schemas[name].names).write.parquet(f"{self.root}/{name}/{versions[name]}")
        for bad in checks:
            row = bad.head(1)
            if row:
                raise ValueError(f"the commit breaks an invariant: {row[0].asDict()}")
        seq = int(now.get("", 0)) + 1
        self._claim(seq)
        rows = self.spark.createDataFrame([(seq, k, v) for k, v in versions.items()], "seq long, name string, version string")
        # one file, whose name appears only when it is whole
        rows.coalesce(1).write.mode("append").json(f"{self.root}/_manifest")
        return seq


def write_buckets(records: DataFrame, path: str, bucket: str = "bucket") -> None:
    """A table partitioned by bucket; only the buckets that come in are overwritten."""
    records.write.partitionBy(bucket).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
