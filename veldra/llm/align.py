"""Alignment of two tokenizers' tokens on the bytes that they spell, with corpus-wide counts of linked ids."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import beside, cols, discard, fresh, materialize
from veldra.llm.tokens import ByteLevel, PieceBPE, live, portions, read

#: Id pairs that are sent to the tasks, the most frequent ones: 17 bytes each.  Links of others meet their counts in a join.
SENT_PAIRS = 2_000_000
#: A pair is counted in so many places before these counts are added up.
SALTS = 16
#: What is added to a table whose texts are aligned.
ADDED = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links_a", "links_b")
#: Distinct pairs that a task counts before it passes the counts on.
COUNTED = 2_000_000


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each A token and of each B token, then the places of the A and the B token of every link.

    Ends ascend.  Offsets where tokens of both end cut them into groups.  A link is a pair of tokens with the same end;
    of several with one end (tokens without bytes) each is paired with each.
    """
    once = lambda ends: ends[np.diff(ends, prepend=-1) > 0]
    cuts = np.intersect1d(once(ends_a), once(ends_b), assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    if not len(cuts):
        none = np.zeros(0, "int64")
        return group_a, group_b, none, none
    at_a = np.flatnonzero(cuts[np.minimum(group_a, len(cuts) - 1)] == ends_a)
    at_b = np.flatnonzero(cuts[np.minimum(group_b, len(cuts) - 1)] == ends_b)
    in_b = np.bincount(group_b[at_b], minlength=len(cuts))
    each = in_b[group_a[at_a]]  # B tokens that an A token is linked with
    left = np.repeat(at_a, each)
    nth = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
    first = np.cumsum(in_b) - in_b
    return group_a, group_b, left, at_b[np.repeat(first[group_a[at_a]], each) + nth]


class Aligner:
    def __init__(self, byte_level: bytes, pieces: bytes):
        self.a, self.b = ByteLevel(byte_level, special=False), PieceBPE(pieces)
        # an id with what follows it: a comma, or the mark that ends the group's A or B ids
        self.text_a = np.array([f"{i}{end}" for end in ",|" for i in range(len(self.a.lengths))], dtype=object)
        self.text_b = np.array([f"{i}{end}" for end in ",;" for i in range(len(self.b.lengths))], dtype=object)

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """Columns of the texts' results; links_a and links_b are flat, n_links of them for each text."""
        ids_a, ids_b = [], []
        whole = [" " + t for t in map(_known, texts)]
        for text, b in zip(whole, self.b.encode([t[1:] for t in whole]), strict=True):
            same = len(text) > 1 and self.b.spells(b, text.encode("utf-8", "replace"))
            ids_b.append(b if same else [])
            ids_a.append(self.a.encode(text) if same else np.zeros(0, "uint32"))
        n_a, n_b = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
        a, b = np.concatenate(ids_a).astype("int64"), np.fromiter(chain.from_iterable(ids_b), "int64", int(n_b.sum()))
        # offsets go on from text to text: both tokenizers' tokens of a text end where it ends
        group_a, group_b, left, right = links(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]))
        text_a, text_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        n_links = np.bincount(text_a[left], minlength=len(texts))
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[: len(a)], np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        n_groups = np.bincount(text_b[last_b], minlength=len(texts))
        # each token's place when every group's A ids are followed by its B ids
        laid = np.empty(len(a) + len(b), dtype=object)
        laid[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = self.text_a[a + len(self.a.lengths) * last_a]
        laid[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = self.text_b[b + len(self.b.lengths) * last_b]
        shas, at = [], 0
        for n in (n_a + n_b).tolist():
            shas.append(hashlib.sha256("".join(laid[at : at + n].tolist())[:-1].encode()).hexdigest() if n else "")
            at += n
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": shas, "links_a": a[left], "links_b": b[right]}


def _known(text: str | None) -> str:
    return text or ""


def aligned(docs: DataFrame, byte_level: str, pieces: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but the text, unless given) with n_a, n_b, n_groups, n_links, groups_sha256 and the links'
    ids, links_a and links_b (arrays of equal lengths), in place of any columns of these names.

    Null and empty texts, and those whose tokens don't spell a space and the text, have no tokens.  Whole texts; repeated
    rows are aligned each; an empty table gives no rows.
    """
    import pyarrow as pa

    added = {c: "string" if c == "groups_sha256" else "array<int>" if c.startswith("links_") else "long" for c in ADDED}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added and c != text_col]
    sent = docs.sparkSession.sparkContext.broadcast((read(byte_level), read(pieces)))
    job = uuid.uuid4().hex

    def start():
        align = live(job, lambda: Aligner(*sent.value)).align

        def work(columns):
            texts = columns[0].to_pylist()
            for own in portions(texts):
                got = align(texts[own])
                ends = pa.array(np.concatenate(([0], np.cumsum(got["n_links"]))), pa.int32())
                for name in ("links_a", "links_b"):
                    got[name] = pa.ListArray.from_arrays(ends, pa.array(got[name], pa.int32()))
                yield own, [got[c] for c in ADDED]

        return work

    return beside(docs, keep, cols([text_col]), added, start)


def pair_counts(links_: DataFrame, salts: int = SALTS) -> DataFrame:
    """(a, b, n): how many links hold each pair of ids.

    Tasks count what they read and pass on (a, b, n) for each of their distinct pairs.  These are added up by pair and
    salt first and by pair then, so that a pair that every task has doesn't meet in one place.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    def counted(batches: Iterator) -> Iterator:
        codes, n = np.zeros(0, "int64"), np.zeros(0, "int64")
        waiting, size = [], 0

        def added(codes, n):
            new, back = np.unique(np.concatenate([codes, *waiting]), return_inverse=True)
            total = np.bincount(back[len(n) :], minlength=len(new))
            total[back[: len(n)]] += n
            return new, total

        salt = TaskContext.get().partitionId() % salts

        def rows(codes, n):
            ids = [pa.array(x, pa.int32()) for x in (codes >> 32, codes & 0xFFFFFFFF, np.full(len(codes), salt))]
            return pa.RecordBatch.from_arrays([*ids, pa.array(n)], names=["a", "b", "salt", "n"])

        for batch in batches:
            a, b = (c.flatten().to_numpy().astype("int64") for c in batch.columns)
            waiting.append(a << 32 | b)
            size += len(a)
            if size > COUNTED:
                codes, n = added(codes, n)
                waiting, size = [], 0
                if len(codes) > COUNTED:
                    yield rows(codes, n)
                    codes, n = codes[:0], n[:0]
        codes, n = added(codes, n)
        yield rows(codes, n)

    parts = links_.select("links_a", "links_b").mapInArrow(counted, "a int, b int, salt int, n long")
    salted = parts.groupBy("a", "b", "salt").agg(F.sum("n").alias("n"))
    return salted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def with_counts(links_: DataFrame, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """``links_`` (of ``aligned``) with n_best and count_sum in place of its links.

    count_sum adds up the counts of a row's links; n_best tells how many have the highest count of their B id in the
    whole table, ties included.  The most frequent pairs, at most ``sent_pairs``, go to the tasks as one sorted
    array.  Links of other pairs, which are rare ones by then, are joined with the counts by pair and added up by row.
    """
    number, met = (fresh(x, links_.columns) for x in ("_row", "_met"))
    written = materialize(links_.withColumn(number, F.monotonically_increasing_id()))
    counts = materialize(pair_counts(written))
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    ranked = materialize(counts.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))
    every = counts.limit(sent_pairs + 1).count() <= sent_pairs
    hot = (ranked if every else ranked.orderBy(F.desc("n"), "a", "b").limit(sent_pairs)).toArrow()
    codes = hot["a"].to_numpy().astype("int64") << 32 | hot["b"].to_numpy().astype("int64")
    order = np.argsort(codes)
    sent = links_.sparkSession.sparkContext.broadcast((codes[order], hot["n"].to_numpy()[order], hot["best"].to_numpy()[order].astype("bool")))

    @F.pandas_udf("n_best long, count_sum long, rest_a array<int>, rest_b array<int>")
    def looked_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known, n, best = sent.value
        for a, b in batches:
            size = a.map(len).to_numpy("int64")
            a, b = (np.concatenate([np.zeros(0, "int32"), *x]).astype("int64") for x in (a, b))
            code = a << 32 | b
            ends = np.cumsum(size)
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            there = known[at] == code if len(known) else np.zeros(len(code), "bool")
            # by row: what its links add up to, in whole numbers
            upto = lambda x: np.concatenate(([0], np.cumsum(x, dtype="int64")))[ends]
            add = lambda x: np.diff(upto(np.where(there, x[at], 0) if len(known) else there * 0), prepend=0)
            cuts = upto(~there)[:-1]
            rest = [np.split(x[~there].astype("int32"), cuts) if len(size) else [] for x in (a, b)]
            yield pd.DataFrame({"n_best": add(best), "count_sum": add(n), "rest_a": rest[0], "rest_b": rest[1]})

    keep = [c for c in links_.columns if c not in ("links_a", "links_b") and c.lower() not in ("n_best", "count_sum")]
    names = cols(keep)
    looked = written.withColumn(met, looked_up("links_a", "links_b"))
    if every:
        out = looked.select(*names, f"{met}.n_best", f"{met}.count_sum")
        discard(counts, ranked)
        out._scratch = written._scratch
        return out
    looked = materialize(looked.select(*names, number, met))
    rest = looked.where(F.size(f"{met}.rest_a") > 0).select(number, F.explode(F.arrays_zip(f"{met}.rest_a", f"{met}.rest_b")).alias("p"))
    rest = rest.groupBy(number, F.col("p.rest_a").alias("a"), F.col("p.rest_b").alias("b")).agg(F.count("*").alias("times")).join(ranked, ["a", "b"])
    rest = rest.groupBy(F.col(number).alias("of")).agg(F.sum(F.col("times") * F.col("best")).alias("best"), F.sum(F.col("times") * F.col("n")).alias("sum"))
    rest = rest.select("of", F.struct("best", "sum").alias("rest"))
    more = fresh("_rest", looked.columns)
    rest = rest.select(F.col("of").alias(fresh("_of", looked.columns)), F.col("rest").alias(more))
    total = lambda one, two: (F.col(f"{met}.{one}") + F.coalesce(F.col(f"{more}.{two}"), F.lit(0))).alias(one)
    return looked.join(rest, looked[number] == rest[rest.columns[0]], "left").select(*names, total("n_best", "best"), total("count_sum", "sum"))


def report(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.  See ``aligned``."""
    out = with_counts(aligned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), byte_level, pieces))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
