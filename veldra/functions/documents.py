"""JSON of unknown depth as VARIANT values, walked level by level on the JVM's side.  S26, M3, M4."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions.text import clean
from veldra.functions.values import FORBIDDEN_KEYS

#: Levels that a document may have; beyond them the walk fails, as it would on a table that refers to itself.
LEVELS = 1000


def walk(docs: DataFrame, json: str = "json", levels: int = LEVELS) -> DataFrame:
    """Every value of every document: the columns of ``docs`` but the text, then depth, steps array<string> (an
    object's key, or an array's place, ten digits wide so that steps sort in document order for arrays), key (null in
    arrays) and value (variant).  What isn't JSON has no values; behind a whole value Spark's parser reads no further.

    A recursive query: each level explodes the objects and arrays of the level before it, all documents at once, so
    the rounds are as many as the deepest document has levels and no row is visited twice.
    """
    spark = docs.sparkSession
    for limit, value in (("RowLimit", "-1"), ("LevelLimit", str(levels))):
        spark.conf.set(f"spark.sql.cteRecursion{limit}", value)
    name = "walk_" + uuid.uuid4().hex
    own = [c for c in docs.columns if c != json]
    docs.select(*own, F.try_parse_json(json).alias("value")).where("value is not null").createOrReplaceTempView(name)
    kept, again = (", ".join(f"{t}`{c}`" for c in own) + (", " if own else "") for t in ("", "w."))
    return spark.sql(f"""
        WITH RECURSIVE w AS (
            SELECT {kept} 0 AS depth, CAST(array() AS ARRAY<STRING>) AS steps, CAST(NULL AS STRING) AS key, value FROM {name}
            UNION ALL
            SELECT {again} w.depth + 1, array_append(w.steps, coalesce(e.key, lpad(CAST(e.pos AS STRING), 10, '0'))), e.key, e.value
            FROM w, LATERAL variant_explode(w.value) AS e
        )
        SELECT * FROM w
    """)


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, or another type's name."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def forbidden_keys(docs: DataFrame, id_col: str = "id", json: str = "json", keys: list[str] = FORBIDDEN_KEYS) -> DataFrame:
    """M3: (id, keys): which forbidden keys a document has at any depth, in any case, in order; documents without are
    left out.  Text that isn't JSON has none."""
    lower = F.lower("key")
    found = walk(docs.select(F.col(id_col).alias("id"), F.col(json).alias("json"))).where(lower.isin([k.lower() for k in keys]))
    return found.groupBy("id").agg(F.array_sort(F.collect_set(lower)).alias("keys"))


def document_texts(docs: DataFrame, id_col: str = "id", json: str = "json") -> DataFrame:
    """M4: (id, strings, text, urls) of JSON documents: all strings of a document in the order of their steps, these cleaned
    and joined by spaces, and the addresses among them, each once."""
    rows = walk(docs.select(F.col(id_col).alias("id"), F.col(json).alias("json")))
    # of what is no string only the whole document is needed, so that it has a row
    rows = rows.withColumn("text", F.when(kind(F.col("value")) == "STRING", F.try_variant_get("value", "$", "string"))).where("text is not null or depth = 0")
    strings = rows.select("id", F.struct("steps", F.col("text").alias("s")).alias("x"))
    one = strings.groupBy("id").agg(F.array_compact(F.array_sort(F.collect_list("x"))["s"]).alias("s"))
    return one.select("id", F.col("s").alias("strings"), clean(F.array_join("s", " ")).alias("text"), F.array_distinct(F.filter("s", lambda s: s.rlike("^https?://"))).alias("urls"))


def postings(docs: DataFrame, id_col: str = "id", json: str = "json") -> DataFrame:
    """(id, n, title, company, place, date) of each document's first object whose @type is or holds JobPosting, at
    any depth, and the number of such objects; the first by depth, then by steps."""
    rows = walk(docs.select(F.col(id_col).alias("id"), F.col(json).alias("json")))
    get = lambda path: F.try_variant_get("value", path, "string")
    named = F.coalesce(F.try_variant_get("value", '$["@type"]', "array<string>"), F.array(get('$["@type"]')))
    found = rows.where((kind(F.col("value")) == "OBJECT") & F.array_contains(named, "JobPosting"))
    first = F.struct("depth", "steps")
    company = F.coalesce(get("$.hiringOrganization.name"), get("$.hiringOrganization"))
    place = F.coalesce(get("$.jobLocation.address.addressLocality"), get("$.jobLocation[0].address.addressLocality"), get("$.jobLocation"))
    fields = F.struct(get("$.title").alias("title"), company.alias("company"), place.alias("place"), get("$.datePosted").alias("date"))
    return found.groupBy("id").agg(F.count("*").alias("n"), F.min_by(fields, first).alias("f")).select("id", "n", "f.*")
