"""Similarity joins: sets by shared items (J8, P32) and short strings by edits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.operators.scratch import listed, materialize

#: Items of left sets that a task holds at once.  The left sets of a block that has more are cut into parts.
PART = 1_000_000
#: Parts of a block's right sets, so that tasks are enough.  They get more only where PART // 20 sets a part don't do, and
#: fewer where PART // 2000 do: what is shuffled for them grows with the left sets, not with both sides.
SPREAD = 32
#: Pairs that a task gathers before it hands them on.
_ROWS_OUT = 50_000
_LAST = 2**63 - 1


def set_key(block: Column, items: Column) -> Column:
    """Digest of a block's set, whatever the items' order."""
    tidy = F.array_sort(F.array_distinct(F.array_compact(items)))
    return F.md5(F.to_json(F.struct(block.cast("string").alias("b"), tidy.alias("i"))).cast("binary"))


def _tidy(sets: DataFrame, *more: str) -> DataFrame:
    """(block, items, more) of the sets that aren't empty, written once: what items come from may be much larger."""
    items = F.array_sort(F.array_distinct(F.array_compact("items")))
    return materialize(sets.select(F.col("block").cast("string").alias("block"), items.alias("items"), *more)).where("block is not null and size(items) > 0")


def _dealt(left: DataFrame, right: DataFrame, part: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Deals the different sets of ``left`` and ``right`` to groups (of, i, j), in which the left ones (side 0) come first.

    Each part of a block's left sets meets each part of its right ones in a group of its own.  Blocks of one part share
    groups.  A set is there once for each part of the other side, whatever items it has, and pairs are nowhere."""
    count = lambda df: df.groupBy("block").agg(F.approx_count_distinct(F.xxhash64("items")).alias("sets"), F.avg(F.size("items")).alias("long"))
    few, many = max(1, part // 2000), max(10, part // 20)
    up = lambda c, n: F.ceil(F.col(c) / n).cast("int")
    x, y = up("l", part), F.greatest(F.least(F.lit(SPREAD), up("r", few)), up("r", many))
    sizes = count(left).select("block", F.ceil(F.col("sets") * F.col("long")).alias("l")).join(count(right).select("block", F.col("sets").alias("r")), "block")
    sizes = materialize(sizes.select("block", "l", "r", x.alias("x"), y.alias("y"), F.monotonically_increasing_id().alias("of")))
    large = (F.col("x") > 1) | (F.col("y") > 1)
    shared = sizes.where(~large).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).select(F.greatest(F.lit(1), x, y)).first()[0]
    groups = shared + (sizes.where(large).agg(F.sum(F.col("x").cast("long") * F.col("y"))).first()[0] or 0)
    cut = listed(sizes.where(large).select("block", "of", "x", "y"))
    tasks = min(2 * groups, max(8 * left.sparkSession.sparkContext.defaultParallelism, groups // 8))

    def side(df: DataFrame, k: int) -> DataFrame:
        wide = df.join(cut, "block", "left").withColumn("of", F.coalesce("of", -1 - F.pmod(F.xxhash64("block"), F.lit(shared))))
        own = lambda n: F.pmod(F.xxhash64("items"), F.coalesce(n, F.lit(1))).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
        i, j = (each("x"), own("y")) if k else (own("x"), each("y"))
        return wide.select("of", i.alias("i"), j.alias("j"), F.lit(k).alias("side"), *df.columns)

    def deal(a: DataFrame, b: DataFrame) -> DataFrame:
        both = side(a, 0).unionByName(side(b, 1), allowMissingColumns=True)
        return both.repartition(tasks, "of", "i", "j").sortWithinPartitions("of", "i", "j", "side")

    return deal


def _needed(n: np.ndarray, least: float) -> np.ndarray:
    """Items that a set of n must share with one that isn't smaller."""
    some = np.maximum(1, np.ceil(n * least - 1e-9).astype(np.int64))
    return some + (some / n < least)


class _Group:
    """The left sets of a group, by item: a list of them, or for an item of more than a sixteenth a row of zeros and ones."""

    def __init__(self, held: list[pa.RecordBatch], least: float):
        rows = pa.Table.from_batches(held).combine_chunks()
        block, items, self.set = (rows[c].combine_chunks() for c in ("block", "items", "set"))
        self.size, self.least = pc.list_value_length(items).to_numpy().astype(np.int64), least
        self.need = _needed(self.size, least)
        kind = np.min_scalar_type(int(self.size.max()))
        self.low, self.high, self.need = int(self.need.min()), int(self.need.max()), self.need.astype(kind)
        self.blocks, self.words = block.unique(), items.flatten().unique()
        row, key = self._keys(block, items)
        order = np.argsort(key, kind="stable")
        self.keys, starts = np.unique(key[order], return_index=True)
        self.lists = np.split(row[order], starts[1:])
        self.often = [16 * len(x) > len(self.size) for x in self.lists]
        for k in np.flatnonzero(self.often).tolist():
            every = np.zeros(len(self.size), kind)
            every[self.lists[k]] = 1
            self.lists[k] = every

    def _keys(self, block: pa.Array, items: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each item and the number of block and item, -1 where no left set has one of them."""
        code = lambda x, known: pc.fill_null(pc.index_in(x, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(items)), pc.list_value_length(items).to_numpy())
        b, w = code(block, self.blocks)[row], code(items.flatten(), self.words)
        return row, np.where((b >= 0) & (w >= 0), b * len(self.words) + w, -1)

    def similar(self, rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each right set that has similar ones on the left: its row, theirs, and how many items they share."""
        row, key = self._keys(rows["block"], rows["items"])
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        row, at = row[known], at[known]
        need = np.minimum(_needed(pc.list_value_length(rows["items"]).to_numpy(), self.least), self.high)
        ends = np.searchsorted(row, np.arange(rows.num_rows + 1))
        shared, enough = np.empty_like(self.need), np.empty_like(self.need)
        for k in np.flatnonzero(np.diff(ends) >= np.minimum(need, self.low)).tolist():
            shared[:] = 0
            for item in at[ends[k] : ends[k + 1]].tolist():
                if self.often[item]:
                    shared += self.lists[item]
                else:
                    shared[self.lists[item]] += 1
            np.minimum(self.need, int(need[k]), out=enough)
            found = np.flatnonzero(shared >= enough)
            if len(found):
                yield k, found, shared[found]


def _met(group: Callable[[list[pa.RecordBatch]], Callable[[pa.RecordBatch | None], Iterator[pa.RecordBatch]]]):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Memory: the left sets of a group, a batch of the right ones, and pairs about to leave."""
        held, take, last = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch[c].to_numpy() for c in ("of", "i", "j", "side")], axis=1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
                rows, at = batch.slice(start, end - start), place[start].tolist()
                if at[:3] != last:
                    if take:
                        yield from take(None)
                    held, take, last = [], None, at[:3]
                if not at[3]:
                    held.append(rows)
                elif held:
                    take = take or group(held)
                    yield from take(rows)
        if take:
            yield from take(None)

    return meet


def _pairs(least: float):
    def group(held: list[pa.RecordBatch]):
        left = _Group(held, least)

        def take(rows: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if rows is None:
                return
            size, out, n = pc.list_value_length(rows["items"]).to_numpy(), [], 0

            def found() -> pa.RecordBatch:
                a, b, shared = (np.concatenate(x) for x in zip(*out, strict=True))
                sets = left.set.take(pa.array(a)), rows["set"].take(pa.array(b))
                return pa.RecordBatch.from_arrays([*sets, pa.array(shared.astype(np.int32)), pa.array(shared / np.minimum(left.size[a], size[b]))], ["a", "b", "shared", "overlap"])

            for k, a, shared in left.similar(rows):
                out.append((a, np.full(len(a), k), shared))
                n += len(a)
                if n >= _ROWS_OUT:
                    yield found()
                    out, n = [], 0
            if n:
                yield found()

        return take

    return _met(group)


def _totals(least: float):
    def group(held: list[pa.RecordBatch]):
        left = _Group(held, least)
        n, first, most = np.zeros(len(left.size), np.int64), np.full(len(left.size), _LAST), np.zeros(len(left.size), np.int32)

        def take(rows: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if rows is None:
                some = np.flatnonzero(n)
                if len(some):
                    yield pa.RecordBatch.from_arrays([left.set.take(pa.array(some)), *(pa.array(x[some]) for x in (n, first, most))], ["a", "n", "first", "most"])
                return
            many, least_id = rows["n"].to_numpy(), rows["first"].to_numpy()
            for k, found, shared in left.similar(rows):
                n[found] += many[k]
                first[found] = np.minimum(first[found], least_id[k])
                most[found] = np.maximum(most[found], shared)

        return take

    return _met(group)


def similar_sets(left: DataFrame, right: DataFrame, least: float = 0.6, part: int = PART) -> DataFrame:
    """(a, b, shared, overlap) of all pairs of sets of ``left`` and ``right`` (block, items array<string>) in one
    block with an overlap, shared items over items of the smaller set, of ``least`` or more.  a and b are digests as
    ``set_key`` gives them; a set that many rows have is compared once, and rows find their sets by an equi-join with the
    digest.  Each pair is found in one group, so nothing is shuffled or aggregated behind it."""
    left, right = _tidy(left), _tidy(right)
    one = lambda df: df.distinct().withColumn("set", set_key(F.col("block"), F.col("items")))
    return _dealt(left, right, part)(one(left), one(right)).mapInArrow(_pairs(least), "a string, b string, shared int, overlap double")


def similar_totals(left: DataFrame, right: DataFrame, least: float = 0.6, part: int = PART) -> DataFrame:
    """(a, n, first, most) for each set a of ``left`` (block, items) that rows of ``right`` (block, items, id long)
    are similar to, as ``similar_sets`` tells it: how many rows, their smallest id, and the most items that one shares.

    Tasks add up what they meet: pairs, which grow with both sides, are neither rows nor on disk."""
    left, right = _tidy(left), _tidy(right, "id")
    a = left.distinct().withColumn("set", set_key(F.col("block"), F.col("items")))
    b = right.groupBy("block", "items").agg(F.count("*").alias("n"), F.coalesce(F.min("id"), F.lit(_LAST)).alias("first"))
    parts = _dealt(left, right, part)(a, b).mapInArrow(_totals(least), "a string, n long, first long, most int")
    return parts.groupBy("a").agg(F.sum("n").alias("n"), F.nullif(F.min("first"), F.lit(_LAST)).alias("first"), F.max("most").alias("most"))


def candidate_sets(left: DataFrame, right: DataFrame, least: float = 0.6, part: int = PART) -> DataFrame:
    """(a, b, a_items, b_items): the pairs of ``similar_sets`` with their items."""
    named = lambda df, n: _tidy(df).distinct().select(set_key(F.col("block"), F.col("items")).alias(n), F.col("items").alias(f"{n}_items"))
    return similar_sets(left, right, least, part).select("a", "b").join(named(left, "a"), "a").join(named(right, "b"), "b")


def deletions(x: Column, edits: int = 2) -> Column:
    """Hashes of the text and of all that is left of it after up to so many characters are deleted.

    Two texts within k edits have such a rest in common when each gives up to k characters; of n characters there are
    some n ** k / k! of them."""
    now = F.array(x)
    rests = [now]
    for _ in range(edits):
        now = F.array_distinct(F.flatten(F.transform(now, _shorter)))
        rests.append(now)
    return F.array_distinct(F.transform(F.flatten(F.array(*rests)), lambda s: F.xxhash64(s)))


def _shorter(x: Column) -> Column:
    """All texts that lack one character of ``x``."""
    cut = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
    return F.when(F.length(x) > 0, cut(x)).otherwise(F.array().cast("array<string>"))


def fuzzy_pairs(left: DataFrame, right: DataFrame, edits: int = 2) -> DataFrame:
    """(a, b, distance) of all different texts of ``left`` and ``right`` (column value) within so many edits, equal
    ones with 0.  Null texts are near nothing.

    Both sides' deletion neighbourhoods meet in an equi-join of hashes, and ``levenshtein`` decides.  A list holds
    different texts that have a rest in common, which are few but for very short ones: texts of at most ``edits``
    characters all share the empty rest, and there are not many of them.
    """
    index = lambda df, n: df.select(F.col("value").alias(n)).where(F.col(n).isNotNull()).distinct().withColumn("rest", F.explode(deletions(F.col(n), edits)))
    met = index(left, "a").join(index(right, "b"), "rest").select("a", "b", F.levenshtein("a", "b", edits).alias("distance"))
    return met.where(F.col("distance") >= 0).distinct()


def lookalikes(hosts: DataFrame, registry: DataFrame, edits: int = 2) -> DataFrame:
    """(value, official, distance) of hosts (column value) that are no registered name and within so many edits of
    one; of several the nearest, then the first by name."""
    pairs = fuzzy_pairs(hosts.join(registry.select("value"), "value", "left_anti"), registry, edits)
    best = pairs.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m"))
    return best.select(F.col("a").alias("value"), F.col("m.b").alias("official"), F.col("m.distance").alias("distance"))


def nearest_aliases(keys: DataFrame, known: DataFrame, edits: int) -> DataFrame:
    """(value, known): for each key (column value) the nearest known ones, itself if it is known."""
    pairs = fuzzy_pairs(keys, known, edits)
    nearest = pairs.groupBy("a").agg(F.min("distance").alias("nearest"))
    return pairs.join(nearest, "a").where("distance = nearest").select(F.col("a").alias("value"), F.col("b").alias("known"))


