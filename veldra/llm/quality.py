"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features are its own and its neighbours'; the marginals of forward-backward, weighted by the lengths of the
lines, make the document's score.  The labels of lines are latent: only a document's label is known, and it is the
length-weighted mean of the marginals that is fitted to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import fold, small_batches

#: Labelled documents of each label that the field is fitted on (in expectation), with their whole texts.
FIT_DOCUMENTS = 3000
#: Lines of one chain while fitting: longer documents are several chains, all of which count.
CHAIN = 256
#: A feature counts up to so many spreads from its mean, so that one odd line can't outweigh a page.
CLIP = 6.0
#: A document is good if its score reaches this.
GOOD = 0.3
FOLDS, HELD_OUT = 5, 0

_CLASSES = bytes.maketrans(
    bytes(range(256)),
    bytes(
        0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else 0x20 if c in (0x20, 0x09, 0x0D) else 0x2C if c in b".,;:'\"()-?" else 0x21 if c == 0x21 else 0x23
        for c in range(256)
    ),
)
_STARTS = re.compile(rb"(?:^|(?<= ))A")
OWN = 18


def line_features(line: str, seen: int) -> list[float]:
    """Of one line; ``seen``: how often its document has it."""
    raw = line.encode("utf-8", "replace")
    kinds = raw.translate(_CLASSES)
    n = len(raw) or 1
    words = raw.split()
    w = len(words) or 1
    upper, lower, digit = kinds.count(b"A"), kinds.count(b"a"), kinds.count(b"0")
    different = len(set(words))
    return [
        np.log1p(n),
        np.log1p(w),
        n / w / 10,
        upper / n,
        digit / n,
        kinds.count(b",") / n * 10,
        min(1.0, kinds.count(b"!") / w),
        min(1.0, kinds.count(b"#") / w),
        (upper + lower) / n,
        different / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        len(set(zip(words, words[1:]))) / max(1, w - 1),
        float(kinds[:1] == b"A"),
        float(raw[-1:] in b".?!" and bool(raw)),
        len(_STARTS.findall(kinds)) / w,
        np.log1p(seen - 1),
        float(not words),
        len(max(words, key=len, default=b"")) / 20 if len(words) else 0.0,
    ]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features) and the lines' lengths; an empty text is one empty line."""
    lines = (text or "").split("\n")
    seen = Counter(lines)
    return np.array([line_features(x, seen[x]) for x in lines], dtype=np.float32), np.array([len(x) + 1 for x in lines], dtype=np.float64)


def with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it in its document, and where it stands."""
    n = len(own)
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0
    after[last] = 0
    return np.hstack([own, before, after, first[:, None], last[:, None], np.ones((n, 1))]).astype(np.float64)


class Pack:
    """The lines of many documents by their place: all first lines, longest document first, then all second ones."""

    def __init__(self, starts: np.ndarray, n: int):
        sizes = np.diff(np.append(starts, n))
        self.order = np.argsort(-sizes, kind="stable")
        first, sizes = starts[self.order], sizes[self.order]
        there = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # documents longer than t, for each t
        self.cuts = np.concatenate([[0], np.cumsum(there)]).astype(int)
        self.lines = np.concatenate([first[:k] + t for t, k in enumerate(there)]) if len(there) else np.zeros(0, dtype=int)


class Field:
    """Two labels, bad 0 and good 1.  ``weights``: what a line's features say for good; ``steps``: from label to label."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray, steps: np.ndarray):
        self.centre, self.spread, self.weights, self.steps = centre, spread, weights, steps

    def lines(self, own: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return with_neighbours(((own - self.centre) / self.spread).clip(-CLIP, CLIP), starts) @ self.weights

    def marginals(self, emit: np.ndarray, starts: np.ndarray, pack: Pack | None = None, steps: np.ndarray | None = None) -> np.ndarray:
        """P(good) of every line of many documents, which are laid end to end; exact, in log space.

        Messages are log odds.  All documents advance together, so the work is a few vector operations for each line
        of the longest.  ``steps``: 2 by 2 by documents, where documents have steps of their own.
        """
        pack = pack or Pack(starts, len(emit))
        s = (self.steps[:, :, None] if steps is None else steps)[:, :, pack.order if steps is not None else slice(None)]
        s = np.broadcast_to(s, (2, 2, len(starts)))
        fore, cuts = emit[pack.lines], pack.cuts
        e = fore.copy()
        for t in range(1, len(cuts) - 1):
            k = cuts[t + 1] - cuts[t]
            p, u = fore[cuts[t - 1] : cuts[t - 1] + k], s[:, :, :k]
            fore[cuts[t] : cuts[t + 1]] += np.logaddexp(u[0, 1], p + u[1, 1]) - np.logaddexp(u[0, 0], p + u[1, 0])
        back = np.zeros(len(emit))
        for t in range(len(cuts) - 3, -1, -1):
            k = cuts[t + 2] - cuts[t + 1]
            q, u = back[cuts[t + 1] : cuts[t + 2]] + e[cuts[t + 1] : cuts[t + 2]], s[:, :, :k]
            back[cuts[t] : cuts[t] + k] = np.logaddexp(u[1, 0], q + u[1, 1]) - np.logaddexp(u[0, 0], q + u[0, 1])
        out = np.empty(len(emit))
        out[pack.lines] = 1 / (1 + np.exp(-np.clip(fore + back, -700, 700)))
        return out

    @classmethod
    def fit(cls, documents: list[tuple[np.ndarray, int]], lengths: list[np.ndarray] | None = None, rounds: int = 40, rate: float = 0.05, ridge: float = 3e-3) -> Field:
        """Greatest likelihood of the documents' labels, by Adam over all documents at once.

        It starts from the field without steps whose lines all have their document's label.  Then lines are latent:
        a document is good with the probability that its score states.
        """
        lengths = lengths or [np.ones(len(x)) for x, _ in documents]
        documents, lengths = cls.chains(documents, lengths)
        own, w = np.concatenate([x for x, _ in documents]), np.concatenate(lengths)
        sizes = np.array([len(x) for x, _ in documents])
        starts = np.cumsum(sizes) - sizes
        w = w / np.repeat(np.add.reduceat(w, starts), sizes)
        centre, spread = own.mean(axis=0), own.std(axis=0) + 1e-3
        x = with_neighbours(((own - centre) / spread).clip(-CLIP, CLIP), starts)
        y = np.array([y for _, y in documents], dtype=np.float64)
        # the two labels weigh alike, and so do all documents
        each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        field = cls(centre, spread, np.zeros(x.shape[1]), np.zeros((2, 2)))
        theta = np.zeros(x.shape[1] + 1)

        def descend(gradient, rounds: int, rate: float) -> None:
            nonlocal theta
            m, v = np.zeros_like(theta), np.zeros_like(theta)
            for k in range(1, rounds + 1):
                grad = gradient() + ridge * theta
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
                theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)

        # five fields at once: as it is, emissions moved up and down, steps moved up and down
        pack = Pack(np.concatenate([starts + k * len(own) for k in range(5)]), 5 * len(own))
        label, weight = np.repeat(y, sizes), np.repeat(each, sizes) * w

        def alone() -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(x @ theta[:-1], -700, 700)))
            return np.append(x.T @ ((p - label) * weight), 0.0)

        def latent() -> np.ndarray:
            return field.gradient(theta, x, w, starts, y, each, pack)[1]

        descend(alone, 2 * rounds, 2 * rate)
        descend(latent, rounds, rate)
        field.weights, field.steps = theta[:-1], theta[-1] * np.eye(2)
        return field

    def gradient(self, theta: np.ndarray, x: np.ndarray, w: np.ndarray, starts: np.ndarray, y: np.ndarray, each: np.ndarray, pack: Pack | None = None, eps: float = 1e-3) -> tuple[float, np.ndarray]:
        """Loss of the documents' labels, and its gradient by the features' weights and the step's.

        A document's score is the slope of its log partition function as its lines' emissions move by their shares
        ``w`` of its length; so its slopes by the emissions are differences of marginals on both sides of that move.
        """
        n, d = len(x), len(starts)
        sizes = np.diff(np.append(starts, n))
        self.weights, self.steps = theta[:-1], theta[-1] * np.eye(2)
        emit = x @ self.weights
        # moved far enough for long documents to show, not so far that it bends
        move = eps / np.repeat(np.maximum.reduceat(w, starts), sizes)
        pack = pack or Pack(np.concatenate([starts + k * n for k in range(5)]), 5 * n)
        steps = np.eye(2)[:, :, None] * (theta[-1] + np.repeat([0, 0, 0, eps, -eps], d))
        p = self.marginals(np.concatenate([emit, emit + move * w, emit - move * w, emit, emit]), np.concatenate([starts + k * n for k in range(5)]), pack, steps).reshape(5, n)
        score, more, less = (np.add.reduceat(p[k] * w, starts) for k in (0, 3, 4))
        score = np.clip(score, 1e-6, 1 - 1e-6)
        slope = each * (score - y) / (score * (1 - score))
        by_emit = (p[1] - p[2]) / (2 * move)
        loss = -(each * (y * np.log(score) + (1 - y) * np.log(1 - score))).sum()
        return float(loss), np.append(x.T @ (by_emit * np.repeat(slope, sizes)), ((more - less) / (2 * eps) * slope).sum())

    @staticmethod
    def chains(documents: list[tuple[np.ndarray, int]], lengths: list[np.ndarray]) -> tuple[list[tuple[np.ndarray, int]], list[np.ndarray]]:
        """Documents longer than ``CHAIN`` lines as several of at most as many."""
        out, sizes = [], []
        for (x, y), n in zip(documents, lengths, strict=True):
            for at in range(0, len(x), CHAIN):
                out.append((x[at : at + CHAIN], y))
                sizes.append(n[at : at + CHAIN])
        return out, sizes

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each text."""
        found = [document_features(t) for t in texts]
        if not found:
            return np.zeros(0)
        sizes = np.array([len(x) for x, _ in found])
        starts = np.cumsum(sizes) - sizes
        p = self.marginals(self.lines(np.concatenate([x for x, _ in found]), starts), starts)
        length = np.concatenate([n for _, n in found])
        return np.add.reduceat(p * length, starts) / np.add.reduceat(length, starts)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field | None:
    """Fitted on a bounded sample, drawn by a hash of the id, of the labelled documents that aren't held out.

    Of each label about ``FIT_DOCUMENTS`` documents with their whole texts; fewer if there are fewer.
    Labels other than 0 and 1 and null ids count for nothing; an id with both labels has the lower.  None if a label
    has no document: nothing can be told apart then.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = known.where(fold("_id", FOLDS) != HELD_OUT).groupBy("_id").agg(F.min("_y").alias("_y"))
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    drawn = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    limit = F.when(F.col("_y") == 0, int(min(1, FIT_DOCUMENTS / n[0]) * (1 << 30))).otherwise(int(min(1, FIT_DOCUMENTS / n[1]) * (1 << 30)))
    sample = known.where(drawn < limit)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                found = [document_features(t) for t in b["_text"]]
                yield pd.DataFrame({"y": b["_y"], "x": [x.tobytes() for x, _ in found], "n": [n.tobytes() for _, n in found]})

    # the sample has some thousand rows by its definition
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_text", "_y").mapInPandas(features, "y int, x binary, n binary").collect()
    documents = sorted((bytes(r["x"]), r["y"], bytes(r["n"])) for r in rows)
    if len({y for _, y, _ in documents}) < 2:
        return None
    return Field.fit([(np.frombuffer(x, dtype=np.float32).reshape(-1, OWN), y) for x, y, _ in documents], [np.frombuffer(n) for _, _, n in documents])


def score(field: Field | None, text: Column) -> Column:
    """Quality, 0 to 1, of whole texts; 0.5 without a field.  Null and empty texts are one empty line."""
    if field is None:
        return F.lit(0.5)
    sent = field

    def scored(texts: pd.Series) -> pd.Series:
        parts = [sent.score(texts.iloc[i : i + 200].tolist()) for i in range(0, len(texts), 200)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return F.pandas_udf(scored, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted; other columns are dropped.

    Only texts are inputs of a score.  Rows are scored one by one: repeated rows and ties score alike, an empty table
    gives no rows, a null id is in the fold of the empty text.
    """
    small_batches(docs.sparkSession)
    field = fit(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), score(field, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text scores ``GOOD`` or more, with their own columns."""
    small_batches(docs.sparkSession)
    return docs.where(score(fit(docs, labels), F.col("text")) >= GOOD)
