import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb

from veldra.llm import queries, resample


def brute(rows, target, order=1, buckets=10_000, least=20, percent=10):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)], len(w)

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x)[0])
    for x in target:
        t.update(features(x)[0])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for i, x in rows:
        f, n = features(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def cases(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(1000 + k, "the same twenty words " * 6) for k in range(40)]
    rows += [(500, None), (501, ""), (502, "!? ..."), (None, "null id " * 30), (503, "ÄÖ É日本 a b " * 20), (504, "few words only")]
    return rows, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]


def test_against_brute_force(spark, sf):
    rows, target = cases(spark, sf)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    want = brute(rows, target)
    assert sorted((tuple(r) for r in resample.report(docs, bench).collect()), key=str) == want
    # many short runs and ranges, other parameters
    for order, percent, run, size in ((1, 10, 7, 5), (2, 50, 20, 30), (3, 100, 3, 400), (1, 0, 50, 10)):
        scores = resample.scored(docs, bench, order=order)
        got = resample.drawn(scores, percent=percent, run_rows=run, range_rows=size).select("doc_id", "n_features", "weight", "score", "rank")
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, target, order=order, percent=percent)


def test_repeated_rows_get_ranks_of_their_own(spark):
    docs = spark.createDataFrame([(7, "one and the same text " * 5)] * 30, "doc_id long, text string").repartition(4)
    got = resample.drawn(resample.scored(docs, docs), percent=50, run_rows=4, range_rows=6).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 16)) and len(got) == 30


def test_query_and_sql_agree(spark, sf):
    rows, target = cases(spark, sf)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    db.execute("CREATE TABLE benchmark(text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    db.executemany("INSERT INTO benchmark VALUES (?)", [(t,) for t in target])
    assert sorted(db.execute(queries.OP12).fetchall(), key=str) == brute(rows, target)


def test_tournament_against_sort():
    import random

    r = random.Random(5)
    for n in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((r.randrange(9), r.randrange(9)) for _ in range(r.randrange(6))) for _ in range(n)]
        assert list(resample.Tournament([iter(x) for x in runs])) == sorted(sum(runs, []))


def test_odd_rows_and_names(spark, odd, none, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = odd.withColumnsRenamed({"ids": "a.b", "fingerprint": "_row", "component_id": "_AT", "lang": "_text", "source": "_id"})
    got = resample.drawn(resample.scored(docs, bench))
    assert got.count() == odd.count() and {"a.b", "_row", "_AT", "_text", "_id", "score", "rank"} < set(got.columns)
    assert resample.report(none, bench).count() == 0
    assert resample.report(odd, bench.limit(0)).count() == odd.count()
    assert {r.weight for r in resample.report(odd.where("text is null or trim(text) = ''"), bench).collect()} == {0}
