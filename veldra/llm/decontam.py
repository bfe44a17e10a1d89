"""Benchmark decontamination by Wu-Manber multi-pattern search over windows of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import cols, fresh, materialize, small_batches

WORDS = 10
#: Test strings that are compiled into one set of tables; a task goes through its texts once for each set.
STRINGS_PER_PASS = 40_000
#: Test strings up to which they are sent to the tasks in such sets; beyond them windows are joined.
SENT_STRINGS = 10 * STRINGS_PER_PASS
#: Bits of the filter by which windows are chosen to be joined, for each test string, and at most (64 MB).
BITS_PER_STRING, FILTER_BITS = 16, 1 << 29
#: Bits of a part of the filter.
PART_BITS = 1 << 19
#: Characters of text that a task gathers to go through them with more than one set.
GATHERED = 32 << 20

#: ASCII letters in lower case, digits and all bytes over 0x7F are word characters; the rest separates.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(text: str | None, size: int = WORDS) -> list[bytes]:
    """Windows of the text, each with a space before and after; a shorter text, but not an empty one, is one window."""
    w = words(text)
    if not w:
        return []
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))]


class WuManber:
    """Looks for many byte strings at once.

    The shift table gives, for the block that ends at a position, how far the search may move on without missing
    an occurrence.  A block with shift 0 selects the bucket of strings that have it at the end of their first
    ``m`` bytes; the bucket is keyed by these bytes, and the rest of each string is compared directly.
    """

    def __init__(self, strings: dict[bytes, tuple]):
        self.m = m = min(map(len, strings))
        self.block = block = max(1, min(12, m // 2))
        self.step = m - block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, dict[int, dict[bytes, tuple]]]] = {}
        for s, owners in strings.items():
            for end in range(block, m + 1):
                key = s[end - block : end]
                self.shift[key] = min(self.shift.get(key, self.step), m - end)
            self.bucket.setdefault(s[m - block : m], {}).setdefault(s[:m], {}).setdefault(len(s), {})[s] = owners

    def find(self, text: bytes) -> Iterator[tuple[int, bytes, tuple]]:
        """(start, string, its owners) of every occurrence, by start."""
        m, block, step, shift, n = self.m, self.block, self.step, self.shift.get, len(text)
        at = m
        while at <= n:
            key = text[at - block : at]
            move = shift(key, step)
            if move:
                at += move
                continue
            start = at - m
            for size, same in self.bucket[key].get(text[start:at], {}).items():
                owners = same.get(text[start : start + size])
                if owners is not None:
                    yield start, text[start : start + size], owners
            at += 1


def compile_strings(items: list[tuple[str | None, list[bytes]]]) -> list[WuManber]:
    """Short and long strings apart, so that a short one doesn't shorten the shifts of all."""
    owners: dict[bytes, list[str | None]] = {}
    for item, strings in items:
        for s in strings:
            owners.setdefault(s, []).append(item)
    groups: dict[int, dict[bytes, tuple]] = {}
    for s, own in owners.items():
        groups.setdefault(min(5, (len(s) - 1).bit_length()), {})[s] = tuple(dict.fromkeys(own))
    return [WuManber(g) for g in groups.values()]


def scan(text: str | None, searches: list[WuManber]) -> tuple[int, list[int], set[str | None]]:
    """Number of words, hit words as merged (first, end) intervals laid flat, and the items found."""
    w = words(text)
    if not w:
        return 0, [], set()
    line = b" " + b" ".join(w) + b" "
    found: list[tuple[int, int]] = []
    items: set[str | None] = set()
    for search in searches:
        word = seen = 0
        for start, s, owners in search.find(line):
            word += line.count(b" ", seen, start)
            seen = start
            found.append((word, word + s.count(b" ") - 1))
            items.update(owners)
    return len(w), merged(found), items


def merged(intervals: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _passes(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The benchmark's strings, at most ``STRINGS_PER_PASS`` at a time, drawn partition by partition.

    An item of more windows than that fills sets of its own."""
    batch, n = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for row in rows.toLocalIterator():
        strings = list(dict.fromkeys(windows(row["t"], size)))
        for k in range(0, len(strings), STRINGS_PER_PASS):
            part = strings[k : k + STRINGS_PER_PASS]
            if batch and n + len(part) > STRINGS_PER_PASS:
                yield batch
                batch, n = [], 0
            batch.append((row["i"], part))
            n += len(part)
    if batch:
        yield batch


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WORDS, name: str = "_leak", sent_strings: int | None = None) -> DataFrame:
    """``docs`` with a struct<n_words long, hits array<int>, n_items long, items array<string>> in place of any column ``name``.

    hits holds merged (first, end) word positions; n_items counts the items of which a window occurs, those with a null
    id as one; items are their ids, sorted as strings, without the null.  A null or empty text has no words, an item
    without words never occurs, and an empty benchmark hits nothing.  Rows are scanned one by one, whole, whatever they
    repeat, and nothing is shuffled or written.  The benchmark goes to the executors as sets of bounded size, each a
    broadcast of its own; where there are several, a task gathers rows of ``GATHERED`` characters, compiles one set
    after the other and goes through them with each.  A benchmark of more than ``sent_strings`` strings (``SENT_STRINGS``) isn't drawn to
    the driver: see ``_joined``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if (benchmark.select(_count(size)(*cols([item_text])).alias("n")).agg(F.sum("n")).head()[0] or 0) > (SENT_STRINGS if sent_strings is None else sent_strings):
        return _joined(docs, benchmark, text_col, item_col, item_text, size, name)
    sets = [spark.sparkContext.broadcast(x) for x in _passes(benchmark, item_col, item_text, size)]
    keep = [c for c in docs.columns if c.lower() != name.lower()]
    return docs.select(*cols(keep), _scanner(sets)(*cols([text_col])).alias(name))


def _count(size: int):
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        n = texts.map(lambda t: len(words(t)))
        return (n - size + 1).clip(lower=1).where(n > 0, 0)

    return count


def _test_strings(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item, w binary, n) of the distinct windows of all items; n is their number of words."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(i, w[1:-1], w.count(b" ") - 1) for i, t in zip(batch["i"], batch["t"], strict=True) for w in dict.fromkeys(windows(t, size))], columns=["item", "w", "n"])

    item, text = cols([id_col, text_col])
    return benchmark.select(item.cast("string").alias("i"), text.alias("t")).mapInPandas(run, "item string, w binary, n int").distinct()


def _bit(w: bytes, bits: int) -> int:
    return xxhash.xxh64_intdigest(w) % bits


def _filter(strings: DataFrame, bits: int) -> bytes:
    """A bit for each string, by its hash.  Tasks make parts of it, which are united by part before they are drawn."""

    def made(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for w in batch["w"]:
                b = _bit(bytes(w), bits)
                part = parts.setdefault(b // PART_BITS, np.zeros(PART_BITS // 8, "uint8"))
                part[b % PART_BITS >> 3] |= 1 << (b & 7)
        yield pd.DataFrame([(k, v.tobytes()) for k, v in parts.items()], columns=["part", "bits"])

    def united(key, table):
        import pyarrow as pa

        out = np.bitwise_or.reduce([np.frombuffer(x, "uint8") for x in table["bits"].to_pylist()])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    whole = bytearray(max(bits, PART_BITS) // 8)
    for r in strings.select("w").mapInPandas(made, "part int, bits binary").groupBy("part").applyInArrow(united, "part int, bits binary").toLocalIterator():
        whole[r["part"] * PART_BITS // 8 : (r["part"] + 1) * PART_BITS // 8] = r["bits"]
    return bytes(whole)


def _joined(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, size: int, name: str) -> DataFrame:
    """The same for a benchmark of any number of strings, by an equi-join of windows.

    Test strings stay in a table; the driver gets a filter of hashes of bounded size.  Windows of the texts that pass
    the filter are joined with the strings themselves, so a chance hit of the filter costs a row and nothing else.  Texts
    are written once, as their rows must be told apart; only windows that passed are shuffled.
    """
    spark = docs.sparkSession
    number, found = (fresh(x, docs.columns) for x in ("_row", "_windows"))
    keep = [c for c in docs.columns if c.lower() != name.lower()]
    strings = materialize(_test_strings(benchmark, item_col, item_text, size))
    counts = {r["n"]: r["c"] for r in strings.groupBy("n").agg(F.countDistinct("w").alias("c")).collect()}
    bits = min(FILTER_BITS, max(PART_BITS, 1 << (BITS_PER_STRING * sum(counts.values()) - 1).bit_length()))
    sent = spark.sparkContext.broadcast(_filter(strings, bits))

    @F.pandas_udf("n_words long, hits array<struct<first:int,n:int,w:binary>>")
    def chosen(texts: pd.Series) -> pd.DataFrame:
        table, rows = sent.value, []
        for t in texts:
            w, passed = words(t), []
            for n in counts:
                for i in range(len(w) - n + 1):
                    g = b" ".join(w[i : i + n])
                    b = _bit(g, bits)
                    if table[b >> 3] >> (b & 7) & 1:
                        passed.append((i, n, g))
            rows.append((len(w), passed))
        return pd.DataFrame(rows, columns=["n_words", "hits"])

    @F.pandas_udf("array<int>")
    def flat(spans: pd.Series) -> pd.Series:
        return spans.map(lambda x: merged((s["first"], s["last"]) for s in x))

    written = materialize(docs.select(*cols(keep), chosen(*cols([text_col])).alias(found)).withColumn(number, F.monotonically_increasing_id()))
    passed = written.select(F.col(number).alias("row"), F.explode(f"{found}.hits").alias("h")).select("row", "h.first", (F.col("h.first") + F.col("h.n")).alias("last"), "h.w")
    met = materialize(passed.join(strings.select("w").distinct(), "w"))
    spans = met.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans")).select("row", flat("spans").alias("hits"))
    items = met.select("row", "w").distinct().join(strings.select("w", "item"), "w").select("row", "item").distinct()
    items = items.groupBy("row").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    at, leak = fresh("_at", [*docs.columns, number]), spans.join(items, "row")
    leak = leak.select(F.col("row").alias(at), F.struct("hits", "n_items", "items").alias(fresh("_l", docs.columns)))
    l_ = leak.columns[1]
    part = lambda field, empty: F.coalesce(F.col(f"{l_}.{field}"), empty).alias(field)
    result = F.struct(F.col(f"{found}.n_words").alias("n_words"), part("hits", F.array().cast("array<int>")), part("n_items", F.lit(0).cast("long")), part("items", F.array().cast("array<string>")))
    return written.join(leak, F.col(number) == F.col(at), "left").select(*cols(keep), result.alias(name))


def _scanner(sets):
    def frame(found: list[tuple[int, list[int], set]]) -> pd.DataFrame:
        return pd.DataFrame([(n, h, len(i), sorted(x for x in i if x is not None)) for n, h, i in found], columns=["n_words", "hits", "n_items", "items"])

    @F.pandas_udf("n_words long, hits array<int>, n_items long, items array<string>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if len(sets) < 2:
            searches = compile_strings(sets[0].value) if sets else []
            for texts in batches:
                yield frame([scan(t, searches) for t in texts])
            return
        for texts in gathered(batches):
            found: list = [(0, [], set())] * len(texts)
            for one in sets:
                searches = compile_strings(one.value)
                for k, t in enumerate(texts):
                    n, g, new = scan(t, searches)
                    _, h, old = found[k]
                    found[k] = n, merged([*zip(h[::2], h[1::2], strict=True), *zip(g[::2], g[1::2], strict=True)]), old | new
            yield frame(found)

    return scanned


def gathered(batches: Iterator[pd.Series]) -> Iterator[list[str | None]]:
    texts: list[str | None] = []
    size = 0
    for batch in batches:
        texts.extend(batch)
        size += sum(len(t) for t in batch if t)
        if size >= GATHERED:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.  See ``find_leaks``."""
    leaks = find_leaks(docs.select(F.col(id_col).alias("doc_id"), "text"), benchmark)
    ends = F.filter("_leak.hits", lambda x, i: i % 2 == 1)
    firsts = F.filter("_leak.hits", lambda x, i: i % 2 == 0)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    return leaks.select(
        "doc_id",
        F.col("_leak.n_words").alias("n_words"),
        (total(ends) - total(firsts)).alias("n_hit"),
        F.col("_leak.n_items").alias("n_items"),
        F.sha2(F.array_join("_leak.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_leak.hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which no benchmark window occurs, with their own columns, whatever their names."""
    name = fresh("_leak", docs.columns)
    return find_leaks(docs, benchmark, name=name).where(F.size(f"{name}.hits") == 0).select(*cols(docs.columns))
