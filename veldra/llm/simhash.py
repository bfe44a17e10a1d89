"""SimHash near-dedup with bit-sliced comparison.

Distinct fingerprints meet in bands that any two within the radius must share.  Within a band the bit planes of
64 fingerprints at a time stand in one machine word; a carry-save counter adds the differing planes for 64 pairs
at once, and a block is abandoned once every pair in it exceeds the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import components, discard, forest, fresh, materialize, small_batches

RADIUS = 4
SHINGLE = 4
#: Members of a band beyond which it is split into parts that are compared pair by pair of parts, all of them.
PART = 2048
_BLOCKS_AT_ONCE = 512
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the shingles of a whole text, repeats included; zero if it has no words.

    XXH64 with seed 42 of the UTF-8 shingle; a bit is set if it is set in over half of the hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    if len(words) >= size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = [0], [len(line) + 1]
    digest, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _HASHES_AT_ONCE):
        to = min(n, at + _HASHES_AT_ONCE)
        hashes = np.fromiter((digest(line[a : b - 1], 42) for a, b in zip(starts[at:to], ends[at:to], strict=True)), "<u8", to - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(text: Column) -> Column:
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64")

    return F.pandas_udf(fingerprints, "long")(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(values: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int = RADIUS, work: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of the pairs of ``values`` (uint64) within ``radius``.

    ``left`` and ``right`` list pairs of blocks: block b holds the 64 values from 64 * b on.  Every few bits the pairs
    of blocks in which no pair is left within the radius are taken out.  ``work`` is given the number of pairs of
    blocks that each bit was counted for.
    """
    n = len(values)
    padded = np.zeros(-(-n // 64) * 64, dtype=np.uint64)
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # value, bit
    planes = np.packbits(bits.reshape(-1, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little").view("<u8")[:, :, 0]  # bit, block
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    asks = np.where(bits.reshape(-1, 64, 64).transpose(2, 0, 1), full, np.uint64(0))  # bit, block, value
    lane = np.arange(64, dtype=np.uint64)
    later = (full << lane) << np.uint64(1)  # lanes after one's own
    later[63] = 0
    exists = np.full(len(padded) // 64, full)
    if n % 64:
        exists[-1] = (np.uint64(1) << np.uint64(n % 64)) - np.uint64(1)
    need = max(1, (radius + 1).bit_length())
    for at in range(0, len(left), _BLOCKS_AT_ONCE):
        a, b = left[at : at + _BLOCKS_AT_ONCE], right[at : at + _BLOCKS_AT_ONCE]
        over = ~(np.where((a == b)[:, None], later[None, :], full) & exists[b][:, None])
        # a query beyond the end asks nothing
        over |= np.where((exists[a][:, None] >> lane[None, :]) & np.uint64(1), np.uint64(0), full)
        count = [np.zeros_like(over) for _ in range(need)]
        for bit in range(64):
            if work is not None:
                work.append(len(a))
            carry = asks[bit][a] ^ planes[bit][b][:, None]
            for c in count:
                c ^= carry
                carry &= ~c  # the carry of a half adder: what was set before and is not now
            over |= carry
            if bit % 4 == 3 and bit > radius:
                live = ((over | _exceeds(count, radius)) != full).any(axis=1)
                if not live.any():
                    break
                if live.mean() < 0.9:
                    a, b, over, count = a[live], b[live], over[live], [c[live] for c in count]
        else:
            found = ~(over | _exceeds(count, radius))
            p, q = np.nonzero(found)
            if len(p):
                hit = np.unpackbits(found[p, q].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                r, lanes = np.nonzero(hit)
                yield a[p[r]] * 64 + q[r], b[p[r]] * 64 + lanes


def _exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is greater than ``radius``."""
    greater, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            equal = equal & count[k]
        else:
            greater = greater | equal & count[k]
            equal = equal & ~count[k]
    return greater


def bands(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks, one of which any two fingerprints within the radius agree on.

    With ``radius + k`` parts, k of them agree; k grows with the number of fingerprints so that a band's share of
    them stays small.
    """
    k = 1
    while k < 5 and n >> (64 * k // (radius + k)) > 256:
        k += 1
    parts = radius + k
    cuts = [64 * i // parts for i in range(parts + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(masks, k)]


def _compared(radius: int):
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by band; links leave as a forest.  Memory: one band's part and the partition's forest."""
        pairs: list[tuple[int, int]] = []
        held: list[pd.DataFrame] = []

        def flush(frame: pd.DataFrame) -> None:
            nonlocal pairs
            if len(frame) < 2:
                return
            frame = frame.drop_duplicates(["band", "key", "part", "fp"])
            group = (frame[["band", "key", "part"]] != frame[["band", "key", "part"]].shift()).any(axis=1).cumsum().to_numpy()
            sizes = np.bincount(group)[1:]
            sizes, starts = sizes[sizes > 1], (np.cumsum(sizes) - sizes)[sizes > 1]
            if not len(sizes):
                return
            # each group starts a block; groups of up to 64 are one block each
            fps, own, left, right, at = frame["fp"].to_numpy(), [], [], [], 0
            for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                n = -(-size // 64)
                own.append((at * 64, start, size))
                i, j = np.triu_indices(n)
                left.append(i + at)
                right.append(j + at)
                at += n
            values, there = np.zeros(at * 64, dtype=np.int64), np.zeros(at * 64, dtype=bool)
            for to, start, size in own:
                values[to : to + size] = fps[start : start + size]
                there[to : to + size] = True
            for i, j in near_pairs(values.view(np.uint64), np.concatenate(left), np.concatenate(right), radius):
                ok = there[i] & there[j]
                pairs += zip(values[i[ok]].tolist(), values[j[ok]].tolist(), strict=True)
                if len(pairs) > 200_000:
                    pairs = forest(pairs)

        for batch in batches:
            held.append(batch)
            last = batch.iloc[-1] if len(batch) else None
            if last is None or sum(map(len, held)) < 20_000:
                continue
            frame = pd.concat(held, ignore_index=True)
            same = (frame["band"] == last["band"]) & (frame["key"] == last["key"]) & (frame["part"] == last["part"])
            flush(frame[~same])
            held = [frame[same]]
        if held:
            flush(pd.concat(held, ignore_index=True))
        out = forest(pairs)
        yield pd.DataFrame({"a": [x for x, _ in out], "b": [y for _, y in out]}, dtype="int64")

    return compared


def link(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints of column ``fp`` (long) as all links within the radius do."""
    n = fps.count()
    masks = [_signed(m) for m in bands(n, radius)]
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("band", "key"))
    large = materialize(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > PART))
    if large.isEmpty():
        discard(large)
        parted = keyed.withColumn("part", F.lit(0))
    else:
        # a large band is cut into s parts by hash; each member goes to the groups of its part with every part
        s = F.coalesce(F.ceil(F.col("n") / (PART // 2)), F.lit(1)).cast("int")
        mine = F.pmod(F.xxhash64("fp"), s).cast("int")
        both = F.transform(F.sequence(F.lit(0), s - 1), lambda i: F.least(i, mine) * s + F.greatest(i, mine))
        parted = keyed.join(large, ["band", "key"], "left").select("fp", "band", "key", F.explode(both).cast("int").alias("part"))
    dealt = parted.repartition("band", "key", "part").sortWithinPartitions("band", "key", "part")
    return dealt.select("band", "key", "part", "fp").mapInPandas(_compared(radius), "a long, b long")


def _grouped(marked: DataFrame, least: Column, radius: int) -> DataFrame:
    """(fp, least): the smallest ``least`` of each group, for the fingerprints ``fp`` that are in one with others or
    that several rows of ``marked`` have.  Only distinct fingerprints are compared."""
    fps = materialize(marked.groupBy("fp").agg(F.min(least).alias("first"), F.count("*").alias("n")))
    groups = components(link(fps.select("fp"), radius))
    rooted = fps.join(groups, F.col("fp") == F.col("node"), "left").where("n > 1 or node is not null").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("least"))
    known = materialize(rooted.join(best, "root").select("fp", "least"))
    discard(fps, groups)
    return known


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id; other columns are dropped.

    Texts whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest id reachable.
    Null, empty and word-free texts have fingerprint zero and are linked like any other.  Repeated rows share their
    component; a null id is never the smallest (null if a component has no other).  An empty table gives no rows.
    Only distinct fingerprints are compared and only those in groups are joined back, so a fingerprint that many
    documents share costs no more than one.
    """
    small_batches(docs.sparkSession)
    marked = materialize(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col).cast("string")).alias("fp")))
    known = _grouped(marked, F.col("doc_id"), radius)
    return marked.join(known, "fp", "left").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), F.coalesce("least", "doc_id").alias("component_id"))


def hexadecimal(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one with the smallest doc_id, and its own columns.

    A row is told by its id and 128 bits of its text, so rows of one id and different texts are rows of their own.  A
    null id is greater than all others; of equal ids the text's bits decide, and of rows that are alike in both one
    stays.  Whatever else is equal or null, each group keeps one row.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    names = {n: fresh(f"_{n}", docs.columns) for n in ("id", "a", "b")}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = [F.col("doc_id").alias(names["id"]), F.xxhash64(text).alias(names["a"]), F.xxhash64(F.lit(1), text).alias(names["b"])]
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")
    marked = materialize(docs.select(F.col("doc_id"), told[1].alias("a"), told[2].alias("b"), _fingerprints(F.col("text").cast("string")).alias("fp")))
    known = _grouped(marked, row, radius)
    inside = materialize(marked.join(known, "fp").select("doc_id", "a", "b", row.eqNullSafe(F.col("least")).alias("stays")).groupBy("doc_id", "a", "b", "stays").agg(F.count("*").alias("n")))
    gone = inside.where("not stays").select(F.col("doc_id").alias(names["id"]), F.col("a").alias(names["a"]), F.col("b").alias(names["b"]))
    same = lambda df: F.col("doc_id").eqNullSafe(df[names["id"]]) & (told[1] == df[names["a"]]) & (told[2] == df[names["b"]])
    # the rejected rows grow with the documents and are never broadcast, however few they are today
    left = docs.join(gone.hint("merge"), same(gone), "left_anti")
    again = inside.where("stays and n > 1").select(F.col("doc_id").alias(names["id"]), F.col("a").alias(names["a"]), F.col("b").alias(names["b"]))
    discard(marked, known)
    if again.isEmpty():
        return left
    # rows alike in id and text that stay: one of each
    alone, alike = left.join(again.hint("merge"), same(again), "left_anti"), left.join(again.hint("merge"), same(again), "left_semi")
    return alone.unionByName(alike.select("*", *told).dropDuplicates(list(names.values())).drop(*names.values()))
