"""Lists and JSON over Columns.  The IDs are those of the operator inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldra.functions.text import _s, clean


def unique_strings(values: Column, most: int | None = None) -> Column:
    """M1: cleaned, not empty, distinct, in order, at most so many."""
    out = F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), clean), lambda x: x != ""))
    return out if most is None else F.slice(out, 1, most)


def encode_json(value: Column) -> Column:
    """M2"""
    return F.to_json(value)


def decode_list(text: Column) -> Column:
    """M2: a JSON list of strings; empty if the text isn't one."""
    return F.coalesce(F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


#: Keys that a plan made by a model may not have.
FORBIDDEN_KEYS = ["isOfficial", "verificationStatus", "confidenceScore", "officialDomain", "officialUrl", "verified"]


def has_forbidden_key(text: Column, keys: list[str] = FORBIDDEN_KEYS) -> Column:
    """M3: whether JSON text has one of the keys at any depth."""
    return _s(text).rlike('(?i)"(?:' + "|".join(keys) + r')"\s*:')


def json_document(text: Column) -> Column:
    """M4: struct of valid, text (all strings in it) and urls (distinct, in order) of a JSON document."""
    # every string, key or value, so that none is taken from between two others; keys have a colon after them
    p = F.lit(r'"((?:[^"\\]|\\.)*)"(\s*:)?')
    every = F.arrays_zip(F.regexp_extract_all(_s(text), p, F.lit(1)).alias("s"), F.regexp_extract_all(_s(text), p, F.lit(2)).alias("k"))
    strings = F.transform(F.filter(every, lambda x: x["k"] == ""), lambda x: F.replace(x["s"], F.lit("\\/"), F.lit("/")))
    urls = F.array_distinct(F.filter(strings, lambda s: s.rlike("^https?://")))
    return F.struct(F.try_parse_json(text).isNotNull().alias("valid"), clean(F.array_join(strings, " ")).alias("text"), urls.alias("urls"))


def union_evidence(a: Column, b: Column) -> Column:
    """M5: union of two lists of structs, first place kept."""
    return F.array_distinct(F.concat(F.coalesce(a, b), F.when(a.isNull(), F.slice(b, 1, 0)).otherwise(F.coalesce(b, F.slice(a, 1, 0)))))


def first_by(values: Column, key: str) -> Column:
    """M6: of a list of structs the first of each value of a field; those without it go."""
    keys = F.transform(values, lambda x: x[key])
    return F.filter(values, lambda x, i: x[key].isNotNull() & (F.array_position(keys, x[key]) == i + 1))


def company_type(value: Column, confidence: Column, least: float = 0.8) -> Column:
    """M7: a label only if it is sure enough."""
    return F.when(confidence >= least, clean(value)).otherwise("")
