"""Target-distribution importance resampling over hashed word features, drawn by Gumbel keys."""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import beside, cols, fresh, materialize, small_batches
from veldra.llm.decontam import words

BUCKETS = 10_000
ORDER = 1
SEED = 2024
#: Documents of fewer words are never drawn; percent of the others that are.
MIN_WORDS, PERCENT = 20, 10
#: Rows of a sorted run, and rows that the merge of one range of keys goes through, about.
RUN_ROWS, RANGE_ROWS = 1_000_000, 500_000
#: Keys looked at for each border between ranges; borders only divide the work.
PER_BORDER = 16
#: What eligible rows are sorted by: score from the highest on, null ids last, id, number of the row.
KEY = ("s", "u", "i", "row")


def features(text: str | None, order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """Buckets of all runs of 1 to ``order`` consecutive words, repeats included, and the number of words."""
    w = words(text)
    runs = [w, *([b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] for n in range(2, order + 1))]
    return np.concatenate([np.fromiter(map(zlib.crc32, r), "int64", len(r)) for r in runs]) % buckets, len(w)


def bucket_counts(texts: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket.  Tasks add up arrays; a row for each bucket comes to the driver."""
    import pyarrow as pa

    small_batches(texts.sparkSession)

    def counted(batches: Iterator) -> Iterator:
        n = np.zeros(buckets, "int64")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    n += np.bincount(features(text, order, buckets)[0], minlength=buckets)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], names=["bucket", "n"])

    out = np.zeros(buckets, "int64")
    for r in texts.select(cols([text_col])[0].alias("t")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the log of how much likelier it is in the target, rounded down."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], "int64")


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of the id, a thousandfold and rounded down; a null id is as the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but the text, unless given) with n_features, n_words, weight and score (all long).

    Two passes over whole texts, nothing shuffled but bucket counts: the corpus's and the target's features are counted
    first, then each text's gains are added up from an array.  A null or empty text has no features and weight 0.
    """
    gain = gains(bucket_counts(docs, text_col, order, buckets), bucket_counts(target, "text", order, buckets))
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    added = dict.fromkeys(("n_features", "n_words", "weight", "score"), "long")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added and c != text_col]

    def start():
        gain = sent.value

        def work(columns):
            rows = []
            for i, text in zip(*(c.to_pylist() for c in columns), strict=True):
                f, n = features(text, order, buckets)
                weight = int(gain[f].sum())
                rows.append((len(f), n, weight, weight + noise(i, seed)))
            yield slice(0, len(rows)), list(np.array(rows, "int64").reshape(-1, 4).T)

        return work

    own_id, text = cols([id_col, text_col])
    return beside(docs, keep, [own_id.cast("long"), text], added, start)


class Tournament:
    """Merges sorted runs: a tree of losers.  Each inner node holds the run that lost there, so the next smallest key
    takes one game on each level of the winner's path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        n = len(runs)
        self.loser = [0] * n
        winner = [0] * n + list(range(n))  # of each node, leaves last
        for k in range(n - 1, 0, -1):
            winner[k], self.loser[k] = self._game(winner[2 * k], winner[2 * k + 1])
        self.first = winner[1] if n > 1 else 0

    def _game(self, x: int, y: int) -> tuple[int, int]:
        a, b = self.heads[x], self.heads[y]
        return (x, y) if b is None or (a is not None and a <= b) else (y, x)

    def __iter__(self) -> Iterator[tuple]:
        n = len(self.runs)
        while n and (head := self.heads[self.first]) is not None:
            yield head
            now = self.first
            self.heads[now] = next(self.runs[now], None)
            k = (now + n) // 2
            while k:
                now, self.loser[k] = self._game(now, self.loser[k])
                k //= 2
            self.first = now


def _borders(keyed: DataFrame, n: int, most: int) -> list[tuple]:
    """At most ``most - 1`` keys that cut ``n`` rows into ranges of like numbers, from a bounded sample."""
    if most < 2:
        return []
    want = most * PER_BORDER
    rows = keyed.sample(min(1.0, want / n), seed=7).limit(4 * want).collect() if n > want else keyed.collect()
    found = sorted(tuple(r) for r in rows)
    return sorted({found[len(found) * k // most] for k in range(1, most)}) if found else []


def drawn(scores: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, id_col: str = "doc_id", run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``scores`` with rank (long): 1, 2, 3 ... for the highest scores among the rows of at least ``min_words`` words, so many
    percent of them rounded down; ties go to the smaller id, null ids last, and equal rows in any order; else null.

    Each task sorts its eligible rows into runs and cuts them at the borders of the ranges into blocks of keys.  A task then
    merges the blocks of a range in a tournament, counts ranks on from the number of rows in the ranges before it, and
    stops at the draw count; ranges beyond it aren't read.  Only numbers are shuffled; rows get their ranks by the
    number that each got when the scores were written.
    """
    import pyarrow as pa

    spark = scores.sparkSession
    number, at = (fresh(x, scores.columns) for x in ("_row", "_at"))
    keep = [c for c in scores.columns if c.lower() != "rank"]
    quoted = cols(keep)
    written = materialize(scores.select(*quoted).withColumn(number, F.monotonically_increasing_id()))
    eligible = written.where(F.col("n_words") >= min_words)
    own = cols([id_col])[0]
    keyed = eligible.select((-F.col("score")).alias("s"), own.isNull().cast("long").alias("u"), F.coalesce(own.cast("long"), F.lit(0)).alias("i"), F.col(number).alias("row"))
    n = eligible.count()
    draw = n * percent // 100
    sent = spark.sparkContext.broadcast(_borders(keyed, n, -(-n // range_rows)))

    def runs(batches: Iterator) -> Iterator:
        borders = sent.value

        def blocks(parts):
            rows = np.concatenate(parts, axis=1)
            rows = rows[:, np.lexsort(rows[::-1])]
            keys = list(zip(*rows.tolist(), strict=True)) if borders else []
            ends = [0, *(bisect_left(keys, b) for b in borders), rows.shape[1]]
            out = [(r, a, b) for r, (a, b) in enumerate(itertools.pairwise(ends)) if b > a]
            lists = [pa.array([row[a:b] for _, a, b in out], pa.list_(pa.int64())) for row in rows]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([b - a for _, a, b in out], pa.int64()), *lists], names=["range", "size", *KEY])

        waiting, size = [], 0
        for batch in batches:
            waiting.append(np.stack([c.to_numpy() for c in batch.columns]))
            size += batch.num_rows
            if size >= run_rows:
                yield blocks(waiting)
                waiting, size = [], 0
        if size:
            yield blocks(waiting)

    sorted_runs = materialize(keyed.mapInArrow(runs, "range int, size long, " + ", ".join(f"{c} array<long>" for c in KEY)))
    before, total = {}, 0
    for r in sorted_runs.groupBy("range").agg(F.sum("size").alias("n")).orderBy("range").collect():
        before[r["range"]] = total
        total += r["n"]
    starts = spark.sparkContext.broadcast(before)

    def merge(key, blocks):
        rank, rows = starts.value[key[0].as_py()], []
        first = rank
        for _, _, _, row in Tournament([zip(*(r[c] for c in KEY), strict=True) for r in blocks.to_pylist()]):
            if rank == draw:
                break
            rank += 1
            rows.append(row)
        return pa.table({at: pa.array(rows, pa.int64()), "rank": pa.array(range(first + 1, rank + 1), pa.int64())})

    needed = [r for r, n in before.items() if n < draw]
    chosen = sorted_runs.where(F.col("range") <= max(needed, default=-1)).select("range", *KEY)
    ranked = chosen.groupBy("range").applyInArrow(merge, f"{at} long, rank long")
    out = written.join(ranked, F.col(number) == F.col(at), "left").select(*quoted, "rank")
    out._scratch = written._scratch
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank.  See ``scored`` and ``drawn``."""
    weighed = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    return drawn(weighed).select("doc_id", "n_features", "weight", "score", "rank")
