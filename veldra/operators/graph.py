"""Link frontiers, redirect chains and import closures.  J9, O10, F16, F18, S19, K7, K20."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def frontier(seeds: DataFrame, edges: DataFrame, depth: int = 2, children: int = 20) -> DataFrame:
    """(company, url, depth) reached from the seeds (company, url) over edges (src, dst, pos), at most so many new
    pages of a company in each hop, none twice.

    The loop has ``depth`` hops; each is an equi-join, an anti-join with what was seen, and a rank that Spark limits
    below the shuffle.
    """
    seen = seeds.select("company", "url").distinct().withColumn("depth", F.lit(0))
    last = seen
    for hop in range(1, depth + 1):
        found = last.join(edges, last["url"] == edges["src"]).groupBy("company", F.col("dst").alias("url")).agg(F.min(F.struct(F.col("src"), F.col("pos"))).alias("at"))
        found = found.join(seen.select("company", "url"), ["company", "url"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("company").orderBy("at", "url"))
        last = found.withColumn("n", rank).where(F.col("n") <= children).select("company", "url", F.lit(hop).alias("depth"))
        seen = seen.unionByName(last)
    return seen


def best_first(seeds: DataFrame, edges: DataFrame, scores: DataFrame, nodes: int = 25, depth: int = 2) -> DataFrame:
    """As ``frontier``, but of each hop the pages with the highest scores (url, score)."""
    ranked = edges.join(scores, edges["dst"] == scores["url"], "left").select("src", "dst", (-F.coalesce("score", F.lit(0.0))).alias("pos"))
    return frontier(seeds, ranked.withColumn("src", F.col("src")), depth, nodes)


def priority_drill(seeds: DataFrame, edges: DataFrame, nodes: int = 25, depth: int = 2, first_score: float = 100.0) -> DataFrame:
    """(company, url, depth, visit) of pages in the order in which each company's priority queue gives them out.

    ``seeds``: (company, url); ``edges``: (src, dst, pos, score).  The queue begins with the seeds and lasts over all hops:
    the page with the best score is visited next, and what it links to joins the queue with the link's score less the
    page's depth, down to ``depth``; ties go to the lesser depth, then by pos and url.  A page is visited once, ``nodes``
    pages of a company at most.

    A page's links behind its ``nodes`` best ones can't be visited: those before them are visited, or wait, first.  So each
    hop keeps so many links of a page, by a rank that Spark limits below the shuffle, and what is left of a company
    (651 rows with these numbers) is small enough for a heap in a task.
    """
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "pos", "dst"))
    kept = edges.withColumn("n", best).where(F.col("n") <= nodes).select("src", "dst", "pos", "score")
    level = seeds.select("company", F.col("url").alias("src")).distinct()
    rows = level.select("company", F.lit(None).cast("string").alias("src"), F.col("src").alias("dst"), F.lit(0).cast("long").alias("pos"), F.lit(float(first_score)).alias("score"))
    for hop in range(depth):
        found = level.join(kept, "src").select("company", "src", "dst", F.col("pos").cast("long").alias("pos"), F.col("score").cast("double").alias("score"))
        if hop + 1 < depth:
            # of a level, no more pages can be visited either
            order = F.row_number().over(Window.partitionBy("company", "src").orderBy(F.desc("score"), "pos", "dst"))
            level = found.withColumn("n", order).where(F.col("n") <= nodes).select("company", F.col("dst").alias("src")).distinct()
        rows = rows.unionByName(found)

    def visits(key, frame):
        import heapq

        import pandas as pd

        links: dict = {}
        for src, dst, pos, score in zip(frame["src"], frame["dst"], frame["pos"], frame["score"], strict=True):
            links.setdefault(src, {})[(dst, pos, score)] = None
        # rows without a source are the seeds
        heap = [(-score, 0, pos, dst) for (dst, pos, score) in links.pop(None, {})]
        heapq.heapify(heap)
        seen: dict[str, int] = {}
        while heap and len(seen) < nodes:
            _, at, _, url = heapq.heappop(heap)
            if url in seen:
                continue
            seen[url] = at
            if at < depth:
                for dst, pos, score in links.get(url, ()):
                    heapq.heappush(heap, (at - score, at + 1, pos, dst))
        return pd.DataFrame([(key[0], url, at, n + 1) for n, (url, at) in enumerate(seen.items())], columns=["company", "url", "depth", "visit"])

    return rows.distinct().groupBy("company").applyInPandas(visits, f"company {dict(seeds.dtypes)['company']}, url string, depth int, visit int")


def redirect_chains(urls: DataFrame, redirects: DataFrame, most: int = 5) -> DataFrame:
    """(url, final_url, hops, status) over redirects (src, dst): RESOLVED, LOOP or TOO_MANY."""
    # chains of all addresses advance together; an address that has arrived drops out of the join by itself
    now = urls.select("url", F.col("url").alias("at"), F.array("url").alias("path"), F.lit(False).alias("loop"))
    r = redirects.groupBy("src").agg(F.min("dst").alias("dst"))
    for _ in range(most):
        step = now.join(r, (now["at"] == r["src"]) & ~now["loop"], "left")
        again = F.coalesce(F.array_contains("path", F.col("dst")), F.lit(False))
        now = step.select("url", F.when(again | F.col("dst").isNull(), F.col("at")).otherwise(F.col("dst")).alias("at"), F.when(again | F.col("dst").isNull(), F.col("path")).otherwise(F.concat("path", F.array("dst"))).alias("path"), (F.col("loop") | again).alias("loop"))
    more = now.join(r.select(F.col("src").alias("at"), F.lit(True).alias("more")), "at", "left")
    status = F.when(F.col("loop"), "LOOP").when(F.col("more"), "TOO_MANY").otherwise("RESOLVED")
    return more.select("url", F.col("at").alias("final_url"), (F.size("path") - 1).alias("hops"), status.alias("status"))


def imports(files: DataFrame) -> DataFrame:
    """(src, dst) of relative imports of files (path, content)."""
    names = F.regexp_extract_all("content", F.lit(r"""(?:from|import)\s*\(?\s*["'](\.{1,2}/[^"']+)["']"""), F.lit(1))
    rows = files.select("path", F.explode(F.array_distinct(names)).alias("name"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    joined = F.concat(folder, F.regexp_replace("name", r"^\./", ""))
    for _ in range(8):
        joined = F.regexp_replace(joined, r"(^|/)[^/.][^/]*/\.\./", "$1")
    return rows.select(F.col("path").alias("src"), F.regexp_replace(joined, r"/\./", "/").alias("dst"))


def closure(roots: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """All nodes reachable from the roots (node), by hops until nothing is new."""
    from veldra.operators.scratch import materialize

    seen = materialize(roots.select("node").distinct())
    last = seen
    for _ in range(most):
        last = materialize(last.join(edges, last["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if last.isEmpty():
            return seen
        seen = materialize(seen.unionByName(last))
    raise ValueError(f"the closure is deeper than {most}")


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256) of files."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
