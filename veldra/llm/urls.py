"""URL filters: a trie over reversed host labels and path segments, broadcast, longest match first."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import BROADCAST_BYTES

#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: The verdict where no rule fits.
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes are dicts.  Host labels come from the last to the first, then the whole segments of the path; what a
    rule has after its last slash is a prefix of one segment and stands under the key ``None``."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.top: dict = {}
        for verdict, name, start in rules:
            node = self.top
            for label in reversed(name.split(".")):
                node = node.setdefault(("host", label), {})
            *whole, rest = start.split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            rank = (len(name) + len(start), len(name), verdict == "block")
            ends = node.setdefault(None, [])
            ends.append((rest, rank, name + start, verdict))

    def longest(self, name: str, where: str) -> tuple[str | None, str | None]:
        """Rule and verdict of the longest rule that fits (in characters; then the longer host, then block)."""
        best: tuple = ((-1, -1, False), None, None)
        segments = where.split("/")
        node = self.top
        labels = name.split(".")
        for label in reversed(labels):
            node = node.get(("host", label))
            if node is None:
                break
            at = node
            for depth in range(len(segments)):
                for rest, rank, rule, verdict in at.get(None, ()):
                    if segments[depth].startswith(rest) and rank > best[0]:
                        best = (rank, rule, verdict)
                at = at.get(("path", segments[depth]))
                if at is None:
                    break
        return best[1], best[2]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict; other columns are dropped.

    A null url, one without ``://`` and an empty one have empty host and path, fit no rule and get the default.
    An empty table gives no rows.  Repeated rows are judged each.  Of rules equally long the one with the longer
    host wins, then a block.  A list of rules over ``BROADCAST_BYTES`` isn't broadcast: the host's suffixes are
    joined with the rules instead.
    """
    base = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    if sum(len(a) + len(b) + len(c) + 300 for a, b, c in rules) > BROADCAST_BYTES:
        return _joined(base, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def verdicts(batches):
        import pandas as pd

        find = trie.value.longest
        for b in batches:
            got = [find(h, p) for h, p in zip(b["host"], b["path"], strict=True)]
            b["rule"] = pd.Series([x[0] for x in got], dtype=object, index=b.index)
            b["verdict"] = pd.Series([x[1] or default for x in got], dtype=object, index=b.index)
            yield b

    kind = base.schema["page_id"].dataType.simpleString()
    return base.mapInPandas(verdicts, f"page_id {kind}, host string, path string, rule string, verdict string")


def _joined(base: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """The same by an equi-join of host suffixes with the rules."""
    given = base.sparkSession.createDataFrame(rules, "r_verdict string, r_host string, r_path string").distinct()
    keyed = base.withColumn("_row", F.struct(F.col("page_id"), F.col("host"), F.col("path")))
    labels = F.split("host", r"\.", -1)
    keyed = keyed.groupBy("_row").agg(F.count("*").alias("_n")).select("_row", "_n", F.col("_row.host").alias("host"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = keyed.select("_row", F.explode(suffixes).alias("r_host"))
    fits = wide.join(given, "r_host").where(F.expr("startswith(_row.path, r_path)"))
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), (F.col("r_verdict") == "block").cast("int"))
    best = fits.groupBy("_row").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), rank).alias("_b"))
    out = keyed.select(F.col("_row").alias("_k"), "_n").join(best, F.col("_k").eqNullSafe(F.col("_row")), "left")
    out = out.select("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"), "_b")
    return out.select("_k.page_id", "_k.host", "_k.path", F.col("_b.rule").alias("rule"), F.coalesce("_b.r_verdict", F.lit(default)).alias("verdict"))
