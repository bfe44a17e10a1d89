"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import cols, discard, fresh, materialize

#: A line on more than this share of its host's pages is boilerplate.
RATIO = 0.05
#: On fewer pages of its host than this no line is.
MIN_PAGES = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of the trimmed line; null for a blank one, which never counts."""
    line = F.trim(line)
    return F.when(line != "", F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines array<struct<a, b>>): keys of each host's boilerplate lines.  A host of p pages of n lines
    each has at most n / ratio of them, whatever p."""
    page = docs.select(F.col(host_col).alias("host"), F.array_compact(F.array_distinct(F.transform(_lines(F.col(text_col)), _key))).alias("keys"))
    # a page's line and the page itself (key null) are counted by one aggregate that combines before it shuffles
    one = page.select("host", F.explode(F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")), "keys")).alias("k"))
    counts = one.groupBy("host", F.col("k.a").alias("a"), F.col("k.b").alias("b")).agg(F.count("*").alias("pages"))
    counts = materialize(counts.where((F.col("pages") >= min_pages) | F.col("a").isNull()))
    hosts = counts.where("a is null").select(F.col("host").alias("h"), F.col("pages").alias("total"))
    often = counts.where("a is not null").join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("pages") > ratio * F.col("total"))
    out = often.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("lines"))
    out._scratch = counts._scratch
    return out


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the text freed of its host's boilerplate lines and a column ``_dropped``, the number of them.

    Lines are compared trimmed of spaces and kept as they are; blank lines never count.  A null text counts as a page
    without lines and stays null; null hosts are one host.  Repeated rows are pages of their own.  An empty table
    gives no rows; a column named _dropped is replaced, all others are kept, whatever their names.  Only keys and
    counts are shuffled; the texts are joined with the hosts' lists, which Spark broadcasts if their written size is
    under its threshold, and joins by host, splitting large hosts, if not.  A page goes through its host's list once,
    by hash of the first 64 bits, and looks its lines up among the few keys that it shares with it.
    """
    columns = [c for c in docs.columns if c.lower() != "_dropped"]
    host, listed, common, bad = (fresh(n, columns) for n in ("_host", "_lines", "_common", "_bad"))
    found = boilerplate(docs, host_col, text_col, ratio, min_pages)
    written = materialize(found)
    discard(found)
    lists = written.select(F.col("host").alias(host), F.col("lines").alias(listed))
    joined = docs.select(*cols(columns)).join(lists, docs[host_col].eqNullSafe(F.col(host)), "left")
    every = _lines(F.col(text_col))
    shared = F.array_intersect(F.array_compact(F.transform(every, lambda x: _key(x)["a"])), F.col(f"{listed}.a"))
    joined = joined.withColumn(common, shared)
    joined = joined.withColumn(bad, F.when(F.size(common) > 0, F.filter(F.col(listed), lambda k: F.array_contains(F.col(common), k["a"]))))
    kept = F.filter(every, lambda x: ~F.coalesce(F.array_contains(F.col(bad), _key(x)), F.lit(False)))
    none = F.col(bad).isNull() | F.col(text_col).isNull()
    clean = F.when(none, F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    gone = F.when(none, 0).otherwise(F.size(every) - F.size(kept))
    out = joined.select(*(clean.alias(c) if c == text_col else own for c, own in zip(columns, cols(columns), strict=True)), gone.cast("long").alias("_dropped"))
    out._scratch = written._scratch
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text, n_lines, n_dropped.  See ``drop_boilerplate``."""
    out = drop_boilerplate(docs.select("doc_id", "text", "source", F.size(_lines(F.col("text"))).cast("long").alias("n_lines")))
    return out.select("doc_id", "text", "n_lines", F.col("_dropped").alias("n_dropped"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with boilerplate lines dropped from the texts; n_chars is that of the new text where it changed."""
    columns = docs.columns
    clean = out = drop_boilerplate(docs)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    done = out.select(*cols(columns))
    done._scratch = clean._scratch
    return done


#: Rows are told by their place, so that repeated rows are pages of their own.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
l AS (SELECT r, doc_id, source, text, pos, line FROM (SELECT r, doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM d)),
c AS (SELECT source, trim(line, ' ') AS t, count(DISTINCT r) AS pages FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL),
h AS (SELECT source, count(*) AS total FROM documents GROUP BY ALL),
b AS (SELECT c.source, c.t FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE pages >= {MIN_PAGES} AND pages > {RATIO} * total),
x AS (SELECT l.*, b.t IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.t)
SELECT doc_id, CASE WHEN any_value(text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') END AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM x GROUP BY r, doc_id
"""
