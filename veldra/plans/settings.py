"""Settings, plug-in manifests and ports: plain functions on the driver.  K19, K22, G1, G2, G3, G4, K24.

G3: a pipeline's dependencies are its parameters: tables and ``now``.  K24: the package's modules are its interface.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping
from typing import Protocol

from pyspark.sql import Column, DataFrame

HOOKS = ("provider", "ingest", "search", "notify", "export")


class Provider(Protocol):
    """G1: what a feed offers: its id, whether an address is its own, and the postings of a payload."""

    id: str

    def detect(self, url: Column) -> Column: ...

    def postings(self, payload: Column, company: Column, origin: Column) -> Column: ...


class Repository(Protocol):
    """What pipelines ask of a store."""

    def read(self, name: str) -> DataFrame: ...

    def commit(self, tables: Mapping[str, DataFrame], checks=()) -> int: ...


_REGISTRY: dict[tuple[str, str], Callable] = {}


def hook(kind: str, name: str) -> Callable:
    """Register a function for a hook; a name is taken once."""
    if kind not in HOOKS:
        raise ValueError(f"unknown hook {kind}")

    def register(f: Callable) -> Callable:
        if _REGISTRY.setdefault((kind, name), f) is not f:
            raise ValueError(f"{kind} {name} is registered already")
        return f

    return register


def hooks(kind: str) -> dict[str, Callable]:
    """The functions of a hook by name, in order of names."""
    return {n: f for (k, n), f in sorted(_REGISTRY.items(), key=lambda x: x[0]) if k == kind}


def manifest_errors(m: object, folder: str) -> list[str]:
    """What is wrong with a plug-in's manifest."""
    if not isinstance(m, dict):
        return ["not an object"]
    texts = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
    env, hosts = [*m.get("requiredEnv", []), *m.get("optionalEnv", [])], m.get("allowedHosts", [])
    checks = {
        "id": isinstance(m.get("id"), str) and bool(re.fullmatch(r"[a-z0-9][a-z0-9-]*", m["id"])) and m["id"] == folder,
        "apiVersion": m.get("apiVersion") == 1,
        "description": isinstance(m.get("description"), str) and bool(m["description"].strip()) and "\n" not in m["description"],
        "humanInTheLoop": m.get("humanInTheLoop") is True,
        "hooks": texts(m.get("hooks")) and bool(m["hooks"]) and set(m["hooks"]) <= set(HOOKS),
        "env": texts(env) and not {"PATH", "HOME", "PYTHONPATH"} & set(env),
        "allowedHosts": texts(hosts) and not any(re.fullmatch(r"[\d.]+", h) or h.endswith(".internal") for h in hosts) and bool(hosts or not m.get("requiredEnv")),
        "entry": ".." not in str(m.get("entry", "")) and not str(m.get("entry", "")).startswith("/"),
    }
    return [k for k, ok in checks.items() if not ok]


def tree_hash(files: Mapping[str, bytes]) -> str:
    """SHA-256 over sorted names and contents."""
    out = hashlib.sha256()
    for name in sorted(files):
        out.update(name.encode() + b"\0" + hashlib.sha256(files[name]).digest())
    return out.hexdigest()


def version_key(v: str) -> tuple[int, ...]:
    """Versions compare by their numbers."""
    return tuple(int(x) for x in re.findall(r"\d+", v.split("-")[0]))


def runtime_settings(env: Mapping[str, str]) -> dict:
    """Settings within their bounds; what isn't a positive number takes its default."""

    def number(key: str, default: int, most: int | None = None) -> int:
        raw = str(env.get(key, ""))
        n = int(raw) if raw.isdigit() and int(raw) > 0 else default
        return n if most is None else min(n, most)

    return {"max_results": number("SEARCH_MAX_RESULTS", 8, 20), "daily_budget": number("SEARCH_DAILY_QUERY_BUDGET", 300), "cache_days": number("SEARCH_CACHE_TTL_DAYS", 14), "max_queries": number("DISCOVERY_MAX_QUERIES", 12, 20), "max_openings": number("DISCOVERY_MAX_RESULTS", 100, 1000)}


def doctor(tables: Mapping[str, DataFrame], required: Mapping[str, list[str]]) -> dict[str, list[str]]:
    """Columns that tables lack; a table that is missing lacks all."""
    return {n: [c for c in cols if n not in tables or c not in tables[n].columns] for n, cols in required.items()}
