"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order, grown from the words of a sample and then frozen.  A word
costs the exact code length of its bytes and its end; a byte that a context hasn't seen costs the context's escape
and is coded by the next shorter one.  What is coded is the text's letters in lower case, word by word with one break
between them: digits, signs and the kind of white space cost every language the same and are left out.  Contexts begin
with the word, so that a word's cost depends on it alone and is computed once for all its occurrences; the score is
the code length of the sequence of words, not of how they follow each other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import fold, small_batches

#: Longest context in bytes.
ORDER = 4
#: Documents of each language whose words the trees grow from (in expectation), drawn by a hash of the text.
FIT_DOCUMENTS = 400
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_END = b" "


def words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    found = _WORD.findall((text or "").lower())
    if found and not all(map(str.isalpha, found)):
        found = [x for x in ("".join(c for c in w if c.isalpha()) for w in found) if x]
    return found


class Tree:
    """Context -> (next byte -> bits of that byte here, bits of an escape)."""

    def __init__(self, counts: Counter):
        seen: dict[bytes, Counter] = {}
        for word, n in counts.items():
            s = _END + word.encode("utf-8", "replace") + _END
            for at in range(1, len(s)):
                for k in range(min(ORDER, at) + 1):
                    seen.setdefault(s[at - k : at], Counter())[s[at]] += n
        self.nodes: dict[bytes, tuple[dict[int, float], float]] = {}
        for context, after in seen.items():
            total, kinds = sum(after.values()), len(after)
            whole = math.log2(total + kinds)
            self.nodes[context] = ({b: whole - math.log2(n) for b, n in after.items()}, whole - math.log2(kinds))

    def bits(self, word: str) -> float:
        """Code length of a word and its end."""
        s = _END + word.encode("utf-8", "replace") + _END
        get, total = self.nodes.get, 0.0
        for at in range(1, len(s)):
            b = s[at]
            for k in range(min(ORDER, at), -1, -1):
                node = get(s[at - k : at])
                if node is None:
                    continue
                cost = node[0].get(b)
                if cost is not None:
                    total += cost
                    break
                total += node[1]
            else:
                total += 8.0
        return total


class Model:
    """All languages' trees in one table of frozen code lengths.

    A row holds, for a context and a byte that some language has after it, the byte's code length in every language,
    with the escapes that lead to it; another kind of row holds a context's escapes.  Rows are found by the bytes.
    """

    def __init__(self, trees: dict[str, Tree]):
        self.langs = sorted(trees)
        nodes = [trees[x].nodes for x in self.langs]
        self.grams: dict[bytes, int] = {}
        self.escapes: dict[bytes, int] = {}
        table: list[list[float]] = [[8.0] * len(nodes)]  # no context has the byte
        contexts = sorted({c for n in nodes for c in n}, key=len)
        for context in contexts:
            own = [n.get(context) for n in nodes]
            for b in sorted({b for x in own if x for b in x[0]}):
                gram = context + bytes([b])
                shorter = table[self.grams[gram[1:]]] if context else table[0]
                bits = [rest if x is None else x[0].get(b, x[1] + rest) for x, rest in zip(own, shorter, strict=True)]
                self.grams[gram] = len(table)
                table.append(bits)
        for context in contexts:
            self.escapes[context] = len(table)
            table.append([0.0 if x is None else x[1] for x in (n.get(context) for n in nodes)])
        self.table = np.array(table)
        self.rows: dict[str, int] = {}
        self.costs = np.zeros((0, len(self.langs)))

    def path(self, word: str) -> list[int]:
        """The rows whose sum is the code length of a word and its end."""
        s = _END + word.encode("utf-8", "replace") + _END
        out, gram, escape = [], self.grams.get, self.escapes.get
        for at in range(1, len(s)):
            low, end = max(0, at - ORDER), at + 1
            row = gram(s[low:end])
            while row is None:
                if (up := escape(s[low:at])) is not None:
                    out.append(up)
                low += 1
                row = gram(s[low:end]) if low <= at else 0
            out.append(row)
        return out

    def learn(self, new: list[str]) -> None:
        """Find the costs of words that aren't remembered."""
        if len(self.rows) + len(new) > REMEMBERED:
            self.rows.clear()
            self.costs = self.costs[:0]
        paths = [self.path(w) for w in new]
        starts = np.cumsum([0, *map(len, paths[:-1])])
        flat = np.fromiter(chain.from_iterable(paths), dtype=np.int64)
        at = len(self.rows)
        self.rows.update(zip(new, range(at, at + len(new)), strict=True))
        if at + len(new) > len(self.costs):
            more = np.zeros((max(4096, at + len(new)), len(self.langs)))
            self.costs = np.vstack([self.costs, more])
        self.costs[at : at + len(new)] = np.add.reduceat(self.table[flat], starts, axis=0)

    def bits(self, found: list[str]) -> np.ndarray:
        """Code length of all words in each language."""
        total = np.zeros(len(self.langs))
        for at in range(0, len(found), 50_000):
            part = found[at : at + 50_000]
            different = set(part)
            new = sorted(w for w in different if w not in self.rows)
            if new:
                if len(self.rows) + len(new) > REMEMBERED:
                    new = sorted(different)
                    self.rows.clear()
                self.learn(new)
            known = np.fromiter(map(self.rows.__getitem__, part), dtype=np.int64, count=len(part))
            total += self.costs[known].sum(axis=0)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the shortest code, the first in order of equals, and its share of the probability."""
        found = words(text)
        if not found or not self.langs:
            return UNKNOWN, 0.0
        bits = self.bits(found)
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.clip(bits[best] - bits, -1000, 0)).sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, Counter]:
    """Word counts of a bounded sample of each language's documents that aren't held out; null languages don't count.

    About ``FIT_DOCUMENTS`` documents of each language, chosen by a hash of the text; words of any length are counted,
    on the executors.
    """
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"), fold(id_col, FOLDS).alias("f")).where(f"lang is not null and f <> {HELD_OUT} and t is not null")
    n = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not n:
        return {}
    share = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, FIT_DOCUMENTS / r["n"]) * (1 << 30))) for r in n], "lang string, share long")
    # a row for each language
    sample = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < F.col("share"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["t"]:
                found: Counter = Counter()
                for t in texts:
                    found.update(words(t))
                if found:
                    yield pd.DataFrame({"lang": lang, "word": list(found.keys()), "n": list(found.values())})

    out: dict[str, Counter] = {}
    counts = sample.select("lang", "t").mapInPandas(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for r in counts.collect():
        out.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    return out


def predict(docs: DataFrame, counts: dict[str, Counter], text: Column) -> Column:
    """Struct of lang_pred and score."""
    model = Model({lang: Tree(n) for lang, n in counts.items()})
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.grams, model.escapes, model.table))

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model({})
        own.langs, own.grams, own.escapes, own.table = sent.value
        own.costs = np.zeros((0, len(own.langs)))
        for texts in batches:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score"])

    return F.pandas_udf(predicted, "lang_pred string, score double")(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score; other columns are dropped.

    Learns only from texts and languages outside the held-out fold; only the text is an input of a prediction.  Null
    texts, texts without letters and all texts when nothing was learned get ``und`` and 0.  Rows are independent:
    repeated rows get the same, an empty table gives no rows, a null id is in the fold of the empty text, and texts of
    any length are read whole.
    """
    small_batches(docs.sparkSession)
    got = predict(docs, fit(docs, id_col, text_col, lang_col), F.col(text_col))
    out = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), got.alias("_p"))
    return out.select("doc_id", "held_out", "_p.lang_pred", "_p.score")
