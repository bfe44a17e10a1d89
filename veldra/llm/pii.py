"""Personal data by base patterns and bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, cards and phones.  They, and half of the long random strings of
hexadecimal digits, seed the bootstrap: the words around them are lexical patterns, patterns and the identifiers they
stand by form a graph, and Spark scores both in turns.  What a trusted pattern stands by counts as known in the next
turn and may make other patterns trusted, until nothing new is known.  The trusted patterns mark identifiers that no
base pattern knows.  The other half of the hexadecimal strings is not known at first, nor are identifiers of any other
form: the patterns have to find them, which the tests measure on that half.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import discard, materialize, small_batches

#: Kinds in their order; what the bootstrap adds is of the last.
KINDS = ["email", "ip", "card", "phone", "id"]
#: Least confidence of a pattern and least number of different known identifiers that it stands by, to be trusted.
CONFIDENCE, SEEDS = 0.7, 5
#: What an identifier of unknown kind takes from a pattern's confidence; one that a base pattern has dropped takes 1.
UNKNOWN = 0.2
#: Of the hexadecimal strings those are seeds whose hash has this remainder by two.
SEED_FOLD = 0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be an identifier: a run of at least six of these with at least three digits.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9][A-Za-z0-9_-]{5,}+")
#: What is one by itself and seeds patterns, without being marked by itself.
_SECRET = re.compile(r"(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}|(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{32,}")
_HAS_DIGIT = re.compile(r"[0-9]")
_AROUND = re.compile(r"[^\W\d_]+|[^\w\s]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in linear time: each at sign is
    looked for first and its local part runs back from it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, sorted; per kind leftmost and without overlap."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if not _HAS_DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(word: str) -> str:
    """a for letters, A for letters that begin with a capital; signs stand for themselves."""
    return word if not word[0].isalpha() else "A" if word[0].isupper() else "a"


class Words:
    """Words and signs of a text, to look up what stands before and after a place."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in _AROUND.finditer(text)]
        self.starts = [a for a, _ in self.spans]

    def before(self, at: int) -> list[str]:
        """The three before a place, however far; one that goes on behind it is cut there."""
        k = bisect_left(self.starts, at)
        return [self.text[a : min(b, at)] for a, b in self.spans[max(0, k - 3) : k]]

    def after(self, at: int) -> list[str]:
        """The one after a place."""
        k = bisect_left(self.starts, at)
        if k and self.spans[k - 1][1] > at:
            k -= 1
        return [self.text[max(a, at) : b] for a, b in self.spans[k : k + 1]]


def patterns(words: Words, start: int, end: int) -> list[str]:
    """The lexical patterns of an identifier's place: two and three words or signs before it, one on either side, and
    one of shapes: two before it, its own and the one after it."""
    left, right = words.before(start), words.after(end)
    low = [w.lower() for w in left]
    out = []
    if len(left) >= 2:
        out.append(" ".join([*low[-2:], "_"]))
    if len(left) == 3:
        out.append(" ".join([*low, "_"]))
    if left and right:
        out.append(" ".join([low[-1], "_", right[0].lower()]))
    if len(left) >= 2 and right and not (left[-1][0].isalpha() and right[0][0].isalpha()):
        kind = re.sub(r"[0-9]+", "0", re.sub(r"[^\W\d_]+", "a", words.text[start:end]))
        own = "hex" if _SECRET.fullmatch(words.text, start, end) else kind if len(kind) <= 8 else "mixed"
        out.append(" ".join(["shape", *map(shape, left[-2:]), f"<{own}>", shape(right[0])]))
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool, bool, bool, list[str]]]:
    """(start, end, hash of the string, whether it is a base span, a seed, or dropped by a base pattern, patterns) of all
    that may be identifiers.  Dropped are numbers as long as a card's that are none."""
    if not _HAS_DIGIT.search(text) and not base:
        return []
    words, out = None, []
    for a, _, b in base:
        words = words or Words(text)
        out.append((a, b, _hash(text[a:b]), True, True, False, patterns(words, a, b)))
    # of the base spans that begin before a token's end, one that ends after its start overlaps it
    k, reach = 0, -1
    for m in _TOKEN.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start() and len(digits := _digits(m[0])) >= 3:
            words = words or Words(text)
            h = _hash(m[0])
            dropped = len(digits) >= 14 and all(c in "0123456789-" for c in m[0])
            out.append((m.start(), m.end(), h, False, h % 2 == SEED_FOLD and bool(_SECRET.fullmatch(m[0])), dropped, patterns(words, m.start(), m.end())))
    return out


def _hash(s: str) -> int:
    x = xxhash.xxh64_intdigest(s.lower().encode("utf-8", "replace"))
    return x - (1 << 64) if x >> 63 else x


def trusted_patterns(seen: DataFrame) -> DataFrame:
    """(pattern) of the patterns that are trusted when nothing new is known any more.

    ``seen``: rows (pattern, instance, seed, dropped).  Seeds are known and score 1, all others 0 at first.  In each turn
    a pattern's confidence is the sum of its different instances' scores over their number, where those that a base
    pattern has dropped count 1, those of unknown kind ``UNKNOWN``, and one more is added; with at least ``CONFIDENCE`` and
    at least ``SEEDS`` different known instances it is trusted.  An instance scores the noisy-or of its trusted
    patterns, or what it had if that is more, and is known from the next turn on if it has one.  Scores only grow, so
    the turns end.  All are sums that combine before they are shuffled.
    """
    edges = materialize(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("dropped").alias("dropped")))
    # patterns with fewer instances than that can never be trusted
    rich = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SEEDS)
    graph = materialize(edges.join(rich.select("pattern"), "pattern", "left_semi"))
    discard(edges)
    known = materialize(graph.groupBy("instance").agg(F.max("seed").alias("seed")).where("seed").select("instance", F.lit(1.0).alias("score")))
    n = known.count()
    while True:
        weight = F.when(F.col("score").isNotNull() | F.col("dropped"), 1.0).otherwise(UNKNOWN)
        rated = graph.join(known, "instance", "left").groupBy("pattern").agg((F.sum(F.coalesce("score", F.lit(0.0))) / (F.sum(weight) + 1)).alias("p"), F.count("score").alias("known"))
        trusted = materialize(rated.where((F.col("p") >= CONFIDENCE) & (F.col("known") >= SEEDS)).select("pattern", "p"))
        doubt = F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999)))))
        found = graph.join(trusted, "pattern").groupBy("instance").agg((1 - doubt).alias("score"))
        new = materialize(known.unionByName(found).groupBy("instance").agg(F.max("score").alias("score")))
        discard(known)
        before, n, known = n, new.count(), new
        if n == before:
            discard(known, graph)
            out = trusted.select("pattern")
            out._scratch = trusted._scratch
            return out
        discard(trusted)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and spans array<struct<start, kind, end>>, kind the place in ``KINDS``.

    Offsets are code points of the whole text, the end exclusive; sorted by start, then kind.  A null text is empty.
    Base spans of different kinds may overlap; spans that the bootstrap adds overlap no base span.  Repeated rows are
    read each and count once as instances; an empty table gives no rows; a null id is no harm.  Texts are read once;
    afterwards only what was found in them is written and shuffled.
    """

    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base = base_spans(t or "")
                rows.append((base, mentions(t or "", base)))
            yield pd.DataFrame(rows, columns=["base", "seen"])

    small_batches(docs.sparkSession)
    kind = "base array<struct<start:int,kind:int,end:int>>, seen array<struct<start:int,end:int,instance:long,base:boolean,seed:boolean,dropped:boolean,patterns:array<string>>>"
    found = F.pandas_udf(marked, kind)(F.col(text_col))
    table = materialize(docs.select(F.col(id_col).alias("doc_id"), found.alias("f")).select("doc_id", "f.base", "f.seen").withColumn("row", F.monotonically_increasing_id()))
    seen = table.select("row", F.explode("seen").alias("s")).select("row", "s.*").withColumn("pattern", F.explode("patterns"))
    trusted = trusted_patterns(seen.select("pattern", "instance", "seed", "dropped"))
    # what a base pattern has dropped stays so, wherever it stands
    new = seen.where("not base and not dropped").join(trusted, "pattern", "left_semi")
    new = new.groupBy("row").agg(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")).alias("more"))
    return table.join(new, "row", "left").select("doc_id", "base", F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))).alias("spans"))


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_id, the number of spans that the
    bootstrap added.  See ``find``."""

    def number(kind: int) -> Column:
        return F.size(F.filter("spans" if kind == 4 else "base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [number(k) for k in range(4)]
    return find(docs).select("doc_id", *counts, F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"), number(4))
