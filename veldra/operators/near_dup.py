"""Near-duplicate postings: 64-bit SimHash over three-token shingles and a band join.  P14, P15, J5, T8."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions.text import latin_key
from veldra.operators.scratch import materialize

#: Shortest text, least similarity and window in days of a cross listing.
MIN_TEXT, THRESHOLD, WINDOW_DAYS = 200, 0.92, 90
#: Fingerprints of a key beyond which it is cut into parts.
PART = 4096
#: Fingerprints that a key may have on average where numpy compares them, which costs less than a longer list of keys, and
#: where a join does.
MET, _JOINED = 2048, 512
#: Rows of a task and those it holds at least before it compares them, and pairs that leave it at once.
_TASK_ROWS, _ROWS_HELD, _ROWS_OUT = 200_000, 50_000, 100_000
#: Pairs compared at once, and those of a key from which on it is worth calls of its own.
_AT_ONCE, _ALONE = 1 << 17, 4096

_STRIP = re.compile(r"<[^>]*>|&[a-z#0-9]+;|https?://\S+", re.I)
_LETTERS = re.compile(r"[^\W_]+")


def fingerprint(text: str | None) -> str:
    """16 hex digits; empty for fewer than 200 characters or three tokens.  Bit k is set if more shingles' SHA-1 have
    it than not."""
    x = (text or "").lower()
    for pattern in (r"<[^>]*>", r"&[a-z#0-9]+;", r"https?://\S+"):
        x = re.sub(pattern, " ", x)
    tokens = _LETTERS.findall(x)
    if len(tokens) < 3 or sum(map(len, tokens)) + len(tokens) - 1 < MIN_TEXT:
        return ""
    sha = hashlib.sha1
    heads = b"".join(sha(" ".join(t).encode()).digest()[:8] for t in zip(tokens, tokens[1:], tokens[2:], strict=False))
    bits = np.unpackbits(np.frombuffer(heads, dtype=np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(axis=0) * 2 > len(bits)).tobytes().hex()


def fingerprints(text: Column) -> Column:
    """P14, vectorised over Arrow; ``native_fingerprints`` is the same in native functions."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint)

    return F.pandas_udf(each, "string")(text)


def native_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fingerprint) without Python: shingles, SHA-1 and 64 conditional sums that combine before the shuffle."""
    from veldra.functions.text import posting_text

    t = F.split("x", " ")
    shingles = F.when((F.length("x") >= MIN_TEXT) & (F.size(t) >= 3), F.transform(F.sequence(F.lit(1), F.size(t) - 2), lambda i: F.array_join(F.slice(t, i, 3), " ")))
    rows = docs.select(F.col(id_col).alias("id"), posting_text(F.col(text_col)).alias("x")).select("id", F.explode(shingles).alias("s"))
    rows = rows.select("id", F.conv(F.substring(F.sha1(F.col("s").cast("binary")), 1, 8), 16, 10).cast("long").alias("hi"), F.conv(F.substring(F.sha1(F.col("s").cast("binary")), 9, 8), 16, 10).cast("long").alias("lo"))
    bit = lambda k: F.shiftright(F.col("hi" if k < 32 else "lo"), 31 - k % 32).bitwiseAND(F.lit(1))
    sums = rows.groupBy("id").agg(F.count("*").alias("n"), *(F.sum(bit(k)).alias(f"b{k}") for k in range(64)))
    nibble = lambda k: F.hex(sum(F.when(F.col(f"b{k + j}") * 2 > F.col("n"), 8 >> j).otherwise(0) for j in range(4)))
    found = sums.select("id", F.lower(F.concat(*(nibble(k) for k in range(0, 64, 4)))).alias("fingerprint"))
    return docs.select(F.col(id_col).alias("id")).join(found, "id", "left").select("id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


def _half(x: Column, at: int) -> Column:
    return F.conv(F.substring(x, at, 8), 16, 10).cast("long")


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints."""
    return F.bit_count(_half(a, 1).bitwiseXOR(_half(b, 1))) + F.bit_count(_half(a, 9).bitwiseXOR(_half(b, 9)))


def similarity(a: Column, b: Column) -> Column:
    """Share of equal bits; 0 for what is no fingerprint."""
    ok = a.rlike("^[0-9a-f]{16}$") & b.rlike("^[0-9a-f]{16}$")
    return F.when(ok, 1 - distance(a, b) / 64.0).otherwise(0.0)


def bands(fingerprint: Column, radius: int, agreeing: int = 1) -> Column:
    """Keys of a fingerprint: of ``radius + agreeing`` pieces of the 64 bits every choice of ``agreeing`` ones; two
    fingerprints that differ in at most ``radius`` bits share a key."""
    n = radius + agreeing
    bits = F.concat(F.lpad(F.conv(F.substring(fingerprint, 1, 8), 16, 2), 32, "0"), F.lpad(F.conv(F.substring(fingerprint, 9, 8), 16, 2), 32, "0"))
    cuts = [round(64 * i / n) for i in range(n + 1)]
    piece = lambda i: F.substring(bits, cuts[i] + 1, cuts[i + 1] - cuts[i])
    return F.array(*(F.concat(F.lit("-".join(map(str, c)) + ":"), *map(piece, c)) for c in combinations(range(n), agreeing)))


def agreeing(n: int, radius: int, met: int = MET) -> int:
    """Pieces that must agree so that n fingerprints spread over enough keys: the more of them, the more pieces."""
    k = 1
    while k < 4 and n >> (64 * k // (radius + k)) > met:
        k += 1
    return k


def number(fingerprint: Column) -> Column:
    """The 64 bits of a fingerprint as a long."""
    return F.shiftleft(_half(fingerprint, 1), 32).bitwiseOR(_half(fingerprint, 9))


def masks(radius: int, agreeing: int = 1) -> np.ndarray:
    """The bits that each of ``bands`` is made of, in their order."""
    n = radius + agreeing
    cuts = [64 - round(64 * i / n) for i in range(n + 1)]
    pieces = [(1 << a) - (1 << b) for a, b in zip(cuts, cuts[1:], strict=False)]
    return np.array([sum(c) for c in combinations(pieces, agreeing)], dtype=np.uint64)


def close(values: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of the pairs of ``values`` (uint64) within the radius, i of a range (start, size) of ``a`` and j of
    the range of ``b`` beside it; of a range beside itself some pairs are left out that are there with i < j.  Memory: a
    few times ``_AT_ONCE`` pairs, or one value against a range."""
    (s, m), (t, n) = a, b
    alone = m * n >= _ALONE
    for start, size, other, width in zip(*(x[alone].tolist() for x in (s, m, t, n)), strict=True):
        step = max(1, _AT_ONCE // width)
        for at in range(start, start + size, step):
            least = at if start == other else other
            i, j = np.nonzero(np.bitwise_count(values[at : min(at + step, start + size), None] ^ values[None, least : other + width]) <= radius)
            if len(i):
                yield i + at, j + least
    few = ~alone & (m * n > 0)
    s, m, t, n = s[few], m[few], t[few], n[few]
    # every value of the ranges of a, with the range that it meets
    count = lambda sizes: np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, first, width = np.repeat(s, m) + count(m), np.repeat(t, m), np.repeat(n, m)
    ends = np.cumsum(width)
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, side="right")))
        i, j = np.repeat(row[at:to], width[at:to]), np.repeat(first[at:to], width[at:to]) + count(width[at:to])
        ok = np.bitwise_count(values[i] ^ values[j]) <= radius
        if ok.any():
            yield i[ok], j[ok]
        at = to


def first_met(differ: np.ndarray, band: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether a pair with these differing bits, which agrees in ``band`` of the masks ``of``, agrees in no earlier one."""
    first = np.ones(len(band), dtype=bool)
    for k in range(int(band.max(initial=0))):
        first &= (band <= k) | (differ & of[k] != 0)
    return first


def _meet(radius: int, of: np.ndarray):
    columns = ["a", "a_fp", "b", "b_fp", "bits"]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by band, key and part.  Memory: some batches, one part of a key and pairs about to leave."""
        held: list[pd.DataFrame] = []

        def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if not len(rows):
                return
            groups = rows[["band", "key", "part"]].to_numpy()
            group = np.cumsum(np.r_[True, (groups[1:] != groups[:-1]).any(axis=1)]) - 1
            kind = rows["kind"].to_numpy()
            order = np.lexsort((kind, group))
            fp, band, item = rows["fp"].to_numpy()[order].view(np.uint64), rows["band"].to_numpy()[order], rows["item"].to_numpy()[order]
            sizes = np.bincount(group * 3 + kind, minlength=3 * (group[-1] + 1)).reshape(-1, 3)
            starts = (np.cumsum(sizes) - sizes.ravel()).reshape(-1, 3)
            same = starts[:, 0], np.where(sizes[:, 0] > 1, sizes[:, 0], 0)
            out, n = [], 0

            def found() -> pd.DataFrame:
                i, j = (np.concatenate(x) for x in zip(*out, strict=True))
                return pd.DataFrame({"a": item[i], "a_fp": fp[i].view(np.int64), "b": item[j], "b_fp": fp[j].view(np.int64), "bits": np.bitwise_count(fp[i] ^ fp[j]).astype(np.int32)}, columns=columns)

            for a, b in ((same, same), ((starts[:, 1], sizes[:, 1]), (starts[:, 2], sizes[:, 2]))):
                for i, j in close(fp, a, b, radius):
                    ok = (item[i] != item[j]) & ((i < j) | (kind[order[i]] > 0))
                    i, j = i[ok], j[ok]
                    ok = first_met(fp[i] ^ fp[j], band[i], of)
                    out.append((i[ok], j[ok]))
                    n += int(ok.sum())
                    if n >= _ROWS_OUT:
                        yield found()
                        out, n = [], 0
            if n:
                yield found()

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < _ROWS_HELD:
                continue
            rows, last = pd.concat(held, ignore_index=True), batch.iloc[-1]
            open_ = ((rows["band"] == last["band"]) & (rows["key"] == last["key"]) & (rows["part"] == last["part"])).to_numpy()
            yield from pairs(rows[~open_])
            held = [rows[open_]]
        if held:
            yield from pairs(pd.concat(held, ignore_index=True))

    return meet


def keyed(rows: DataFrame, of: np.ndarray) -> DataFrame:
    """``rows`` in each band: (band, key) beside their columns, of which ``fp`` is a fingerprint as a long."""
    return rows.select("*", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(int(m))) for m in of.view(np.int64)))).alias("band", "key"))


def met(wide: DataFrame, radius: int, of: np.ndarray, rows: int) -> DataFrame:
    """(a, a_fp, b, b_fp, bits): the pairs within the radius of some ``rows`` rows (band, key, part, kind, item, fp) that
    agree in band, key and part, each pair in its first band only, items different.  Rows of kind 0 pair up with each other,
    those of kind 1 with those of kind 2."""
    item = dict(wide.dtypes)["item"]
    tasks = max(wide.sparkSession.sparkContext.defaultParallelism, rows // _TASK_ROWS)
    dealt = wide.select("band", "key", F.col("part").cast("long").alias("part"), F.col("kind").cast("int").alias("kind"), "item", "fp")
    dealt = dealt.repartition(tasks, "band", "key", "part").sortWithinPartitions("band", "key", "part")
    return dealt.mapInPandas(_meet(radius, of), f"a {item}, a_fp long, b {item}, b_fp long, bits int")


def near_pairs(docs: DataFrame, radius: int = 5, part: int = PART) -> DataFrame:
    """(a, b, bits) of rows (id, fingerprint) within the radius.

    Distinct fingerprints are compared, each standing for its rows by its smallest id, so that copies don't pair up;
    ``members`` tells who they stand for.  Keys get longer as fingerprints get more, and the fingerprints of a key that
    many share are cut into parts, each pair of which is a group of its own, so that no task holds a large one.
    """
    # written once: fingerprints cost most, and what follows reads them several times
    some = docs.where("id is not null and fingerprint rlike '^[0-9a-fA-F]{16}$'")
    one = materialize(some.groupBy("fingerprint").agg(F.min("id").alias("item")).select("item", number(F.col("fingerprint")).alias("fp")))
    n = one.count()
    of = masks(radius, agreeing(n, radius))
    wide = keyed(one, of)
    large = materialize(wide.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > part).select("band", "key", F.ceil(F.col("n") / max(1, part // 2)).cast("int").alias("s")))
    if large.isEmpty():
        wide = wide.withColumn("part", F.lit(0)).withColumn("kind", F.lit(0))
    else:
        # a row goes to the groups of its part with every part; there it meets the other part, or its own in the group of it alone
        wide = wide.join(large, ["band", "key"], "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
        wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        wide = wide.withColumn("part", F.least("mine", "other") * F.col("s").cast("long") + F.greatest("mine", "other"))
        wide = wide.withColumn("kind", F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2))
    found = met(wide, radius, of, n * len(of))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits")


def members(docs: DataFrame) -> DataFrame:
    """(id, class_id) of every row (id, fingerprint): the smallest id with the same fingerprint; a row without a
    fingerprint is its own class."""
    # written once: fingerprints cost most, and both sides of the join read them
    rows = materialize(docs.select("id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint")))
    some = rows.where("fingerprint <> ''")
    least = some.groupBy("fingerprint").agg(F.min("id").alias("class_id"))
    return some.join(least, "fingerprint").select("id", "class_id").unionByName(rows.where("fingerprint = ''").select("id", F.col("id").alias("class_id")))


def cross_listings(offers: DataFrame, history: DataFrame, today: Column, days: int = WINDOW_DAYS, threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """(offer_url, row_url, score) of offers (url, company, fingerprint) that rows of history (url,
    company, fingerprint, seen date) list for another company under another address.

    Each side's different pairs of company and fingerprint are compared once, whatever rows have them, and rows are
    joined to them at the end.  Keys get longer as fingerprints get more, and a key that many share on either side is
    cut into parts on both, each pair of which is a task's of its own.
    """
    radius = int((1 - threshold) * 64)
    recent = history.where(F.col("seen") >= F.date_sub(today, days))
    rows = lambda df: df.where("fingerprint rlike '^[0-9a-f]{16}$'").select("url", latin_key(F.col("company")).alias("company"), number(F.col("fingerprint")).alias("fp"))
    sides = {"a": materialize(rows(offers)), "b": materialize(rows(recent))}
    one = {n: df.select("company", "fp").distinct() for n, df in sides.items()}
    of = masks(radius, agreeing(max(df.count() for df in one.values()), radius, _JOINED))
    wide = {n: keyed(df, of) for n, df in one.items()}
    count = {n: df.groupBy("band", "key").agg(F.count("*").alias(n)) for n, df in wide.items()}
    # what is exploded has many times the size that Spark supposes, so it is kept from broadcasting it through the driver
    cuts = count["a"].hint("merge").join(count["b"].hint("merge"), ["band", "key"]).where(F.greatest("a", "b") > part)
    cuts = materialize(cuts.select("band", "key", F.ceil(F.col("a") / part).cast("int").alias("x"), F.ceil(F.col("b") / part).cast("int").alias("y")))
    met = {}
    for n, own, other in (("a", "x", "y"), ("b", "y", "x")):
        df = wide[n].join(cuts, ["band", "key"], "left").withColumn(own, F.pmod(F.xxhash64("company", "fp"), F.coalesce(own, F.lit(1))).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        met[n] = df.select("band", "key", "x", "y", F.col("company").alias(f"{n}_company"), F.col("fp").alias(f"{n}_fp"))
    differ = F.col("a_fp").bitwiseXOR(F.col("b_fp"))
    # a pair that agrees in several bands is taken in the first of them
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(int(m))) == 0, k) for k, m in enumerate(of.view(np.int64))))
    close = (F.bit_count(differ) <= radius) & (F.col("a_company") != F.col("b_company")) & (first == F.col("band"))
    pairs = met["a"].hint("merge").join(met["b"].hint("merge"), ["band", "key", "x", "y"]).where(close).withColumn("score", 1 - F.bit_count(differ) / 64.0)
    pairs = pairs.where(F.col("score") >= threshold).select("a_company", "a_fp", "b_company", "b_fp", "score")
    back = lambda n, url: sides[n].select(F.col("url").alias(url), F.col("company").alias(f"{n}_company"), F.col("fp").alias(f"{n}_fp"))
    out = pairs.join(back("a", "offer_url"), ["a_company", "a_fp"]).join(back("b", "row_url"), ["b_company", "b_fp"]).where("offer_url <> row_url")
    return out.select("offer_url", "row_url", "score").distinct()
