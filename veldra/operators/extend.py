"""Interfaces for operators of a user's own: expanders, which make rows of a row, and folds, which make one row of a
key's rows.  G5; U14, S26, A1 and X11 in this form."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expander:
    """A table function: ``make`` gives the rows (tuples of ``schema``) that some values of a row stand for.

    Values and rows travel over Arrow in batches; nothing is gathered, as ``make`` may be a generator.  An error is the
    query's error: an expander that must go on catches what it expects by itself.
    """

    schema: str
    make: Callable[..., Iterable[tuple]]

    def _function(self):
        make = self.make

        class Expand:
            def eval(self, *values):
                yield from make(*values)

        return F.udtf(Expand, returnType=self.schema, useArrow=True)

    def over(self, df: DataFrame, *values: Column, outer: bool = False) -> DataFrame:
        """``df`` with the columns of ``schema``: a lateral join; with ``outer`` rows that make nothing stay, with nulls."""
        return df.lateralJoin(self._function()(*(v.outer() for v in values)), how="left" if outer else "inner", on=F.lit(True) if outer else None)

    def register(self, spark: SparkSession, name: str) -> None:
        """For SQL: ``SELECT ... FROM t, LATERAL name(column, ...)``."""
        spark.udtf.register(name, self._function())


@dataclass(frozen=True)
class Fold:
    """An aggregate whose states are rows.

    ``lift`` makes a row a state (name -> Column), ``combine`` takes a pandas frame of keys and states and gives one row
    a key, and ``finish`` makes results of states.  ``combine`` must not care how rows are split or in what order they
    come, so a state that needs an order carries it.  It runs on what a task reads, ``rows`` states at a time, before
    the shuffle and once more behind it, where a key has a state for each task and chunk at most, however many rows.
    """

    lift: dict[str, Column]
    combine: Callable[[pd.DataFrame, list[str]], pd.DataFrame]
    finish: dict[str, Column] = field(default_factory=dict)
    rows: int = 50_000

    def over(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        keys, combine, most = list(keys), self.combine, self.rows
        states = df.select(*keys, *(c.alias(n) for n, c in self.lift.items()))
        columns = states.columns

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            waiting, n = [], 0
            for batch in batches:
                waiting.append(batch)
                n += len(batch)
                if n >= most:
                    done = combine(pd.concat(waiting, ignore_index=True), keys)[columns]
                    # what has come down to few keys waits for more, the rest goes on
                    waiting, n = ([done], len(done)) if len(done) < most // 2 else ([], 0)
                    if not waiting:
                        yield done
            if waiting:
                yield combine(pd.concat(waiting, ignore_index=True), keys)[columns]

        def final(states: pd.DataFrame) -> pd.DataFrame:
            return combine(states, keys)[columns]

        out = states.mapInPandas(partial, states.schema).groupBy(*keys).applyInPandas(final, states.schema)
        return out.select(*keys, *(c.alias(n) for n, c in self.finish.items())) if self.finish else out


_ANCHOR = re.compile(r"""<a(?=\s)[^>]*?\shref\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>""", re.I | re.S)
_WHITE = re.compile(r"\s+")


def _links(html: str | None) -> Iterator[tuple]:
    seen: set[str] = set()
    for pos, (href, text) in enumerate(_ANCHOR.findall(html or "")):
        href = href.strip()
        if href not in seen:
            seen.add(href)
            yield pos, href, _WHITE.sub(" ", re.sub("<[^>]+>", " ", text)).strip()


#: A page's anchors in page order, the first of each address.
LINKS = Expander("pos int, url string, text string", _links)


_BLOCK = re.compile(r"<(title|h[1-6]|p|li|td|th|blockquote)(?![a-z0-9])[^>]*>(.*?)</\1>", re.I | re.S)
_LD = re.compile(r"""<script[^>]+type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>""", re.I | re.S)


def _sections(html: str | None) -> Iterator[tuple]:
    pos = 0
    for block in _BLOCK.finditer(html or ""):
        tag, inner = block.groups()
        text = _WHITE.sub(" ", entities.unescape(re.sub("<[^>]+>", " ", inner))).strip()
        if text:
            yield pos, tag.lower(), text, block.group()
            pos += 1
    for script in _LD.findall(html or ""):
        try:
            found = json.loads(script)
        except (ValueError, RecursionError):
            continue
        for x in found if isinstance(found, list) else [found]:
            if isinstance(x, dict):
                yield pos, "json", json.dumps(x, sort_keys=True, ensure_ascii=False), script
                pos += 1


#: What a page says, part by part: title, headings, paragraphs, cells, and its JSON-LD objects; ``raw`` is the part
#: as the page has it.
SECTIONS = Expander("pos int, kind string, text string, raw string", _sections)


def _last(frame: pd.DataFrame, keys: list[str], value: str, at: str, empty: bool) -> pd.DataFrame:
    """Of each key the value with the greatest place; with ``empty`` only values that aren't empty count."""
    rows = frame[[*keys, value, at]]
    if empty:
        rows = rows[rows[value].map(lambda v: v is not None and v == v and str(v) != "")]
    return rows.sort_values(at, kind="stable").drop_duplicates(keys, keep="last")


def results_fold(last_non_empty: list[str], last: list[str], any_true: list[str], seq: str = "seq") -> Fold:
    """A1: the last value that isn't empty, the last even if null, whether any is true, and how many rows, as
    ``pick.merge_results`` has them natively."""
    lift = {f"{c}_{end}": F.col(x) for c in (*last_non_empty, *last) for end, x in (("value", c), ("at", seq))}
    lift |= {c: F.coalesce(F.col(c), F.lit(False)) for c in any_true} | {"merged": F.lit(1).cast("long")}

    def combine(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
        out = frame.groupby(keys, dropna=False, as_index=False).agg(**{c: (c, "max") for c in any_true}, merged=("merged", "sum"))
        for c in (*last_non_empty, *last):
            out = out.merge(_last(frame, keys, f"{c}_value", f"{c}_at", c in last_non_empty), on=keys, how="left")
            out[f"{c}_at"] = out[f"{c}_at"].astype("Int64")
        return out

    return Fold(lift, combine, {**{c: F.col(f"{c}_value") for c in (*last_non_empty, *last)}, **{c: F.col(c) for c in any_true}, "merged": F.col("merged")})


def sightings_fold(seq: str = "seq") -> Fold:
    """X11: sightings of a record (posted, expires, description, stale, seq) as one incoming record: latest dates, the
    longest description (the first of equally long ones), whether any is stale, and how often it was seen."""
    lift = {"posted": F.col("posted"), "expires": F.col("expires"), "description": F.col("description"), "size": F.coalesce(F.length("description"), F.lit(-1)), "at": F.col(seq), "stale": F.coalesce("stale", F.lit(False)), "seen": F.lit(1).cast("long")}

    def combine(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
        out = frame.groupby(keys, dropna=False, as_index=False).agg(posted=("posted", "max"), expires=("expires", "max"), stale=("stale", "max"), seen=("seen", "sum"))
        longest = frame.sort_values(["size", "at"], ascending=[False, True], kind="stable").drop_duplicates(keys)
        return out.merge(longest[[*keys, "description", "size", "at"]], on=keys)

    return Fold(lift, combine, {c: F.col(c) for c in ("posted", "expires", "description", "stale", "seen")})
