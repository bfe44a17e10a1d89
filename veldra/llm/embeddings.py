"""Embedding near-dedup with a pivot-permutation index.

A vector is described by its nearest pivots in order.  Inverted lists are kept for pairs of pivots: a vector stands
in the list of its two nearest and asks the lists of all pairs among its ``PREFIX`` nearest.  Lists hold ids and
descriptions only; members and askers that share enough pivots are candidates, and only these vectors are fetched, once
for each list that they are needed in, to be compared by cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import components, discard, forest, materialize

THRESHOLD = 0.98
#: Nearest pivots that describe a vector.
PREFIX = 6
#: Pivots that two vectors must share among these to be compared.
SHARED = 3
#: Vectors the pivots are chosen from, the most pivots of a length, and the cosine that no two of them exceed: a group
#: of near copies in the sample gives one pivot.
PIVOT_SAMPLE, PIVOTS, PIVOT_COSINE = 4096, 1024, 0.7
#: Lengths of vectors that have pivots: the ones with most vectors.  Vectors of other lengths are compared with all.
LENGTHS = 16
#: Members, and askers, of a list beyond which it is cut into parts: as many as an even task holds, within these.
LEAST_BLOCK, MOST_BLOCK = 64, 4096
#: Pairs that a task looks at at once.
PAIRS = 400_000
#: The list of vectors without two pivots.
_EVERY = -1
_BITS = 10


def _finite(x):
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _unit(vectors: list) -> np.ndarray:
    """Rows of length one, whatever the size of their components."""
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` unit vectors, no two close, drawn in hash order from a bounded sample of the distinct vectors
    (columns v, a, b: vector and hashes), which have one length."""
    hashes = vectors.select("a", "b").distinct().orderBy("a", "b").limit(PIVOT_SAMPLE)
    rows = vectors.join(F.broadcast(hashes), ["a", "b"]).groupBy("a", "b").agg(F.first("v").alias("v")).orderBy("a", "b").collect()
    chosen: list[np.ndarray] = []
    for x in _unit([r["v"] for r in rows]):
        if not chosen or np.max(np.stack(chosen) @ x) <= PIVOT_COSINE:
            chosen.append(x)
            if len(chosen) == n:
                break
    return np.stack(chosen)


def near(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept; other columns are dropped.

    Vectors are compared only when labels are equal and not null, by cosine in double precision.  A vector that is
    null, empty, zero or has null or non-finite components links with nothing and is its own component, and so does
    one with a null id; vectors of different length don't link.  Equal vectors (repeated rows too) are compared once
    and counted with their number.  An empty table gives no rows.  Every vector is indexed; the pivots come from a
    bounded sample, and the share of links found is measured against brute force in the tests.

    Through the shuffles go, for each distinct vector, its hashes and id, up to 15 asks of some 40 bytes, the vector once,
    and once more for each part of a list in which it has a candidate.  No part of a list holds more than
    ``MOST_BLOCK`` members and as many askers.
    """
    spark = embeddings.sparkSession
    single = embeddings.schema[vector_col].dataType.simpleString() == "array<float>"
    e = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"), F.col(label_col).alias("label"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    good &= F.forall("v", _finite) & F.exists("v", lambda x: x != 0)
    # 128 bits tell vectors apart; a vector that links with nothing has none
    hashed = [F.when(F.coalesce(good, F.lit(False)), h).alias(n) for n, h in (("a", F.xxhash64("v")), ("b", F.xxhash64(F.lit(1), "v")))]
    e = materialize(e.select("vec_id", "label", "v", *hashed))
    usable = e.where("a is not null")
    sizes = usable.groupBy(F.size("v").alias("d")).agg(F.approx_count_distinct("a").alias("n"), F.approx_count_distinct("label").alias("l")).orderBy(F.desc("n"), "d").limit(LENGTHS).collect()
    alone = e.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not sizes:
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    # about two lists to a vector, as far as bounded pivots can give them
    wanted = {r["d"]: min(PIVOTS, max(32, 2 * math.ceil(math.sqrt(r["n"] / max(1, r["l"]))))) for r in sizes}
    sent = spark.sparkContext.broadcast({d: pivots(usable.where(F.size("v") == d), n) for d, n in wanted.items()})
    label = e.schema["label"].dataType.simpleString()
    described = usable.mapInPandas(_described(sent), f"vec_id long, label {label}, a long, b long, dim int, near long")
    classes = described.groupBy("label", "a", "b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.max("dim").alias("dim"), F.max("near").alias("near"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    needed = _candidates(classes, label)
    needed = needed.join(classes.select("cid", "a", "b", "m"), "cid")
    vectors = usable.groupBy("label", "a", "b").agg(F.first("v").alias("v"))
    place = ["label", "dim", "key", "mine", "other"]
    fetched = needed.join(vectors, ["label", "a", "b"]).select(*place, "member", "cid", "m", "near", "v")
    found = materialize(fetched.repartition(*place).sortWithinPartitions(*place).mapInPandas(_compared(threshold), "a long, b long, n long"))
    # rows with b: links of the forest; rows without: so many vectors linked with a
    roots = components(found.where("b is not null").select("a", "b"))
    others = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "c")
    linked = classes.join(others, F.col("cid") == F.col("c"), "left").join(roots, F.col("cid") == F.col("node"), "left").where("m > 1 or c is not null or node is not null")
    linked = linked.select("label", "a", "b", "rep", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("root", "cid").alias("root"))
    least = linked.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("least"))
    linked = materialize(linked.join(least, F.col("root") == F.col("r")).select(F.col("label").alias("l"), F.col("a").alias("ha"), F.col("b").alias("hb"), "n", "least"))
    discard(classes, found, roots)
    out = e.select("vec_id", "label", "a", "b").join(linked, (F.col("label") == F.col("l")) & (F.col("a") == F.col("ha")) & (F.col("b") == F.col("hb")), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")) & F.col("vec_id").isNotNull())


def _described(sent):
    """The nearest pivots of each vector: ``_BITS`` bits for each, the nearest lowest, and their number above them."""

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 2000):
                b = whole.iloc[start : start + 2000].reset_index(drop=True)
                dim = b["v"].map(len).astype("int32")
                near = np.zeros(len(b), dtype=np.int64)
                for d, rows in b.groupby(dim).indices.items():
                    at = sent.value.get(int(d))
                    if at is None:
                        continue
                    k = min(PREFIX, len(at))
                    first = np.argsort(-(_unit(b["v"].iloc[rows].to_list()) @ at.T), axis=1, kind="stable")[:, :k]
                    near[rows] = (first << (_BITS * np.arange(k))).sum(axis=1) | k << _BITS * PREFIX
                yield b.assign(dim=dim, near=near)[["vec_id", "label", "a", "b", "dim", "near"]]

    return described


def _candidates(classes: DataFrame, label: str) -> DataFrame:
    """Of each part of a list the members and askers that share enough pivots with one of the other side."""
    count = F.shiftright("near", _BITS * PREFIX)
    pivot = lambda i: F.shiftright("near", _BITS * i).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
    pair = lambda i, j: F.when(count > j, F.least(pivot(i), pivot(j)) * (1 << _BITS) + F.greatest(pivot(i), pivot(j)))
    home = F.coalesce(pair(0, 1), F.lit(_EVERY))
    asks = F.when(count < 2, F.array(F.lit(_EVERY))).otherwise(F.array_compact(F.array(*(pair(i, j) for i in range(PREFIX) for j in range(i + 1, PREFIX)))))
    own = ["label", "dim", "cid", "near"]
    homes = classes.groupBy("label", "dim", home.alias("key")).agg(F.count("*").alias("members"))
    # lists without members are gone by the join
    asked = materialize(classes.select(*own, F.explode(asks).alias("key")).join(homes, ["label", "dim", "key"]))
    rows = asked.count()
    even = rows // max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))) // 2
    block = min(MOST_BLOCK, max(LEAST_BLOCK, even))
    lists = asked.groupBy("label", "dim", "key").agg(F.max("members").alias("members"), F.count("*").alias("askers"))
    lists = lists.where((F.col("members") > block) | (F.col("askers") > block)).select("label", "dim", "key", *(F.ceil(F.col(c) / block).cast("int").alias(n) for c, n in (("members", "s"), ("askers", "t"))))
    cut = asked.join(lists, ["label", "dim", "key"], "left")
    s, t, h = F.coalesce("s", F.lit(1)), F.coalesce("t", F.lit(1)), F.xxhash64("cid")
    part = lambda n: F.pmod(h, n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    # a member meets every part of the askers, an asker every part of the members
    asker = F.transform(every(s), lambda i: F.struct(i.alias("mine"), part(t).alias("other"), F.lit(False).alias("member")))
    member = F.transform(every(t), lambda j: F.struct(part(s).alias("mine"), j.alias("other"), F.lit(True).alias("member")))
    dealt = cut.select(*own, "key", F.explode(F.when(F.col("key") == home, F.concat(asker, member)).otherwise(asker)).alias("x")).select(*own, "key", "x.*")
    place = ["label", "dim", "key", "mine", "other"]
    kept = dealt.repartition(*place).sortWithinPartitions(*place).mapInPandas(_shared, f"label {label}, dim int, key int, mine int, other int, member boolean, cid long, near long")
    out = materialize(kept)
    discard(asked)
    return out


def blocks(batches: Iterator[pd.DataFrame], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames of whole parts of lists, whose rows come sorted; a column ``group`` numbers them.  Memory: one part more."""
    keys = ["label", "dim", "key", "mine", "other"]
    held: list[pd.DataFrame] = []

    def numbered(frame: pd.DataFrame) -> pd.DataFrame:
        new = (frame[keys] != frame[keys].shift()).any(axis=1)
        return frame.assign(group=new.cumsum().to_numpy() - 1).reset_index(drop=True)

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1)
        if not last.all():
            yield numbered(frame[~last])
        held = [frame[last]]
    if held:
        yield numbered(pd.concat(held, ignore_index=True))


def pairs(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (member, asker) of the frame's parts that share enough pivots, each pair of vectors in one list only."""
    member = frame["member"].to_numpy(dtype=bool)
    group, cid, key = frame["group"].to_numpy(), frame["cid"].to_numpy(), frame["key"].to_numpy()
    packed = frame["near"].to_numpy()
    known = packed >> _BITS * PREFIX
    near = (packed[:, None] >> (_BITS * np.arange(PREFIX))) & ((1 << _BITS) - 1)
    there = np.arange(PREFIX) < known[:, None]
    # what isn't there equals nothing of the other side
    here, theirs = np.where(there, near, -1).astype(np.int16), np.where(there, near, -2).astype(np.int16)
    members, askers = np.nonzero(member)[0], np.nonzero(~member)[0]
    n = np.bincount(group[members], minlength=group[-1] + 1)
    first = np.cumsum(n) - n
    each = n[group[askers]]
    askers, each = askers[each > 0], each[each > 0]
    ends = np.cumsum(each)
    at = 0
    while at < len(askers):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        y, k = askers[at:to], each[at:to]
        at = to
        x = members[np.repeat(first[group[y]] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        y = np.repeat(y, k)
        other = cid[x] != cid[y]
        x, y = x[other], y[other]
        common = np.zeros(len(x), dtype=np.int8)
        for i in range(PREFIX):
            common += (here[x, i][:, None] == theirs[y]).any(axis=1)
        enough = (common >= SHARED) | (known[x] < SHARED)
        x, y = x[enough], y[enough]
        # a pair that also meets in the asker's own list is taken where the member's number is the smaller one
        meets = (here[x] == theirs[y, :1]).any(axis=1) & (here[x] == theirs[y, 1:2]).any(axis=1) | (key[x] == _EVERY)
        once = ~meets | (cid[x] < cid[y])
        yield x[once], y[once]


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in blocks(batches):
        wanted = np.zeros(len(frame), dtype=bool)
        for x, y in pairs(frame):
            wanted[x] = wanted[y] = True
        yield frame.loc[wanted, ["label", "dim", "key", "mine", "other", "member", "cid", "near"]]


def _compared(threshold: float):
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links leave as a forest, with the number of vectors linked to each.  Memory: one part's vectors, and two
        numbers for each vector of the task."""
        counts: dict[int, int] = {}
        links: list[tuple[int, int]] = []
        for frame in blocks(batches, 5_000):
            cid, m = frame["cid"].to_numpy(), frame["m"].to_numpy()
            unit: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            dim = frame["dim"].to_numpy()
            place = np.zeros(len(frame), dtype=np.int64)
            for d in np.unique(dim):
                rows = np.nonzero(dim == d)[0]
                place[rows] = np.arange(len(rows))
                unit[d] = _unit(frame["v"].iloc[rows].to_list())
            total = np.zeros(len(frame), dtype=np.int64)
            for x, y in pairs(frame):
                for d, u in unit.items():
                    own = np.nonzero(dim[x] == d)[0]
                    for at in range(0, len(own), 100_000):
                        i, j = x[own[at : at + 100_000]], y[own[at : at + 100_000]]
                        ok = np.einsum("ij,ij->i", u[place[i]], u[place[j]]) >= threshold
                        i, j = i[ok], j[ok]
                        total += np.bincount(i, m[j], len(frame)).astype(np.int64) + np.bincount(j, m[i], len(frame)).astype(np.int64)
                        links += zip(cid[i].tolist(), cid[j].tolist(), strict=True)
                        if len(links) > 200_000:
                            links = forest(links)
            for c, n in zip(cid[total > 0].tolist(), total[total > 0].tolist(), strict=True):
                counts[c] = counts.get(c, 0) + n
        yield pd.DataFrame({"a": pd.Series(counts.keys(), dtype="int64"), "b": pd.Series([None] * len(counts), dtype="Int64"), "n": pd.Series(counts.values(), dtype="int64")})
        out = forest(links)
        yield pd.DataFrame({"a": pd.Series([x for x, _ in out], dtype="int64"), "b": pd.Series([y for _, y in out], dtype="Int64"), "n": pd.Series([0] * len(out), dtype="int64")})

    return compared
