"""Best-fit packing of token sequences by exact complements.

Pieces of one length are alike, so which lengths share a sequence is settled on the number of pieces of each length:
at most ``size`` numbers, whatever the corpus.  The plan says for ranges of each length's pieces, by their rank, which
sequence and place they have; pieces are looked up in it where they are.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm.common import beside, cols, fresh, materialize
from veldra.llm.tokens import ByteLevel, live, portions, read

#: Tokens of a sequence.
SIZE = 2048
#: Id that ends each document.
END = 0
#: Bits that hold the rank of a piece among those of its length.
_RANK = 48


class Complements:
    """Available lengths, with the sums of single ones, pairs and triples that fill a gap exactly.

    A number of pieces only falls.  So a pair of lengths that fails once, as one of them is used up, fails for ever, and
    the search for a sum goes on behind it.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.left = [0] * (size + 1)
        for length, n in counts.items():
            self.left[length] = n
        self.lengths = sorted((x for x, n in counts.items() if n), reverse=True)
        #: of each sum, the place in ``lengths`` of the first pair that may still be there
        self.at: dict[int, int] = {}

    def single(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] > used[gap] else None

    def pair(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        left, lengths = self.left, self.lengths
        k = self.at.get(gap, 0)
        dead = True
        while k < len(lengths) and 2 * lengths[k] >= gap:
            a, b = lengths[k], gap - lengths[k]
            if b > 0:
                alive = left[a] > 1 if a == b else left[a] and left[b]
                if alive and left[a] > used[a] + (a == b) and left[b] > used[b]:
                    return a, b
                dead = dead and not alive
            k += 1
            if dead:
                self.at[gap] = k
        return None

    def triple(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        for a in self.lengths:
            if a >= gap or 3 * a < gap:
                continue
            if self.left[a] > used[a]:
                used[a] += 1
                rest = self.pair(gap - a, used)
                used[a] -= 1
                if rest:
                    return (a, *rest)
        return None

    def exact(self, gap: int, used: Counter, parts: int) -> tuple[int, ...] | None:
        """Up to so many lengths that fill the gap beside what is used already, as few as possible."""
        for search in (self.single, self.pair, self.triple)[:parts]:
            if found := search(gap, used):
                return found
        return None


def exact_patterns(counts: dict[int, int], size: int = SIZE, turns: int = 4) -> tuple[list[tuple[Counter, int]], dict[int, int]]:
    """((lengths of a full sequence, how many such sequences) ..., pieces left of each length).

    Sequences begin with one piece, from the longest on, whose gap is filled exactly: first all that a single piece
    completes, then those that a pair does, then triples, so that combinations don't use up single complements.  At last
    the longest piece that fits may join the first one before the gap is filled.  Each pattern is used until one of its
    lengths runs out, so there are no more patterns than lengths, and as many failures in each turn.
    """
    index = Complements(counts, size)
    left, out = index.left, []
    for parts in range(1, turns + 1):
        for length in index.lengths:
            while left[length] and (used := _filled(index, length, size, parts)):
                times = min(left[x] // n for x, n in used.items())
                for x, n in used.items():
                    left[x] -= times * n
                out.append((used, times))
    return out, {x: n for x, n in enumerate(left) if n}


def _filled(index: Complements, length: int, size: int, parts: int) -> Counter | None:
    """Lengths of a full sequence that begins with ``length``."""
    used, gap = Counter([length]), size - length
    while gap:
        if fits := index.exact(gap, used, parts):
            used.update(fits)
            break
        # a sum of three or fewer can't fill what is left: the longest piece that fits goes in first
        more = next((x for x in range(min(gap, length), 0, -1) if index.left[x] > used[x]), None) if parts > 3 else None
        if more is None:
            return None
        used[more] += 1
        gap -= more
    return +used


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[Counter, int]]:
    """Best fit of the pieces from the longest on, on groups of sequences that hold the same lengths."""
    gaps: dict[int, list[tuple[Counter, int]]] = {}
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for gap in sorted(g for g in gaps if g >= length):
            groups = gaps[gap]
            while groups and n:
                held, bins = groups.pop()
                per = gap // length
                full = min(bins, n // per)
                rest = n - full * per if full < bins and n - full * per < per else 0
                n -= full * per + rest
                for k, m in ((per, full), (rest, 1 if rest else 0)):
                    if m:
                        gaps.setdefault(gap - k * length, []).append((held + Counter({length: k}), m))
                if bins - full - (1 if rest else 0):
                    groups.append((held, bins - full - (1 if rest else 0)))
            if not groups:
                gaps.pop(gap, None)
            if not n:
                break
        per = size // length
        for k, m in ((per, n // per), (n % per, 1)):
            if k and m:
                gaps.setdefault(size - k * length, []).append((Counter({length: k}), m))
    return [x for groups in gaps.values() for x in groups]


def fewest(counts: dict[int, int], size: int = SIZE) -> list[tuple[Counter, int]]:
    """(lengths of a sequence, how many such sequences) ...: exact complements, then best fit of the rest.

    Combinations of small pieces may fill gaps that best fit would sooner leave to larger ones, so the turn after which
    best fit takes over is the one that comes to the fewest sequences, the last of equal ones.  Where no piece can be
    spared the total is the least possible and the search ends.
    """
    best: list[tuple[Counter, int]] = []
    least, bound = None, -(-sum(x * n for x, n in counts.items()) // size)
    for turns in (4, 3, 2, 1):
        patterns, rest = exact_patterns(counts, size, turns)
        found = patterns + best_fit(rest, size)
        n = sum(times for _, times in found)
        if least is None or n < least:
            best, least = found, n
        if n == bound:
            break
    return best


def plan(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Rows (length and first rank in one number, pieces a sequence, first sequence, place in it), sorted.

    Ranks from the first one on fill the sequences from the first on, so many in each."""
    rows, ranks, sequence = [], Counter(), 0
    for held, times in fewest(counts, size):
        place = 0
        for length in sorted(held, reverse=True):
            rows.append((length << _RANK | ranks[length], held[length], sequence, place))
            ranks[length] += held[length] * times
            place += held[length] * length
        sequence += times
    return np.array(sorted(rows), "int64").reshape(-1, 4)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: whole ones behind a first one that may be shorter."""
    first = (n - 1) % size + 1
    return [(0, first), *((k, size) for k in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end: int = END, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but the text, unless given) with piece, start, length and ids_crc32 of each piece, part
    and nth: the nth piece of its length in the part of the table that a task has encoded.

    A null text is an empty one, of which the closing id is left, so each row has a piece.  Repeated rows are cut
    each, an empty table gives no rows, other columns of these names (in any case) are replaced.
    """
    added = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "part": "int", "nth": "long"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added and c != text_col]
    sent = docs.sparkSession.sparkContext.broadcast(read(tokenizer_path))
    job = uuid.uuid4().hex

    def start():
        from pyspark import TaskContext

        encode = live(job, lambda: ByteLevel(sent.value, special=True)).encode
        part, seen = TaskContext.get().partitionId(), Counter()
        closing = np.array([end], "<u4")

        def work(columns):
            texts = columns[0].to_pylist()
            for own in portions(texts):
                rows = []
                for k, text in enumerate(texts[own], own.start):
                    ids = np.concatenate((encode(text or "").astype("<u4", copy=False), closing))
                    for p, (first, n) in enumerate(cut(len(ids), size)):
                        rows.append((k, p, first, n, zlib.crc32(ids[first : first + n].data), part, seen[n]))
                        seen[n] += 1
                place, *made = zip(*rows, strict=True)
                yield place, made

        return work

    return beside(docs, keep, cols([text_col]), added, start)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end: int = END, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset in place of part and nth.

    Each sequence holds at most ``size`` ids, its pieces lie side by side from 0 on.  Texts are read once and never
    shuffled.  A piece's rank among those of its length is its number in its part and the number of such pieces in the
    parts before it, a sum over one row for each part and length.  Through the driver go the number of pieces of
    each length and the plan, both bounded by ``size``.
    """
    written = materialize(pieces(docs, tokenizer_path, size, end, text_col, keep))
    counts = written.groupBy("length", "part").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(plan(total, size))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = fresh("_before", written.columns)
    ahead = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias(base))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows = sent.value
        key = length.to_numpy("int64") << _RANK | rank.to_numpy("int64")
        k = np.searchsorted(rows[:, 0], key, "right") - 1
        _, each, sequence, place = rows[k].T
        nth = key - rows[k, 0]
        return pd.DataFrame({"sequence_id": sequence + nth // each, "offset": place + nth % each * length.to_numpy("int64")})

    own = [c for c in written.columns if c not in ("part", "nth") and c.lower() not in ("sequence_id", "offset")]
    at = fresh("_at", written.columns)
    out = written.join(ahead, ["length", "part"]).withColumn(at, placed("length", F.col("nth") + F.col(base)))
    out = out.select(*cols(own), f"{at}.sequence_id", f"{at}.offset")
    out._scratch = written._scratch
    return out


def report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  See ``pack``."""
    return pack(docs, tokenizer_path, keep=["doc_id"])


