import hashlib
import random
import re

from veldra.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = words(t)
        if w:
            for k in range(max(1, len(w) - size + 1)):
                wins.setdefault(tuple(w[k : k + size]), set()).add(None if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for size_ in {len(x) for x in wins}:
            for k in range(len(w) - size_ + 1):
                if (g := tuple(w[k : k + size_])) in wins:
                    hit |= set(range(k, k + size_))
                    own |= wins[g]
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own - {None})).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def make(seed):
    r = random.Random(seed)
    vocab = ["a", "bb", "ccc", "É", "日本", "x1", "the", "THE", "of"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 3, 9, 10, 11, 25]))) for k in range(30)] + [(7, text(12)), (None, "the of"), (99, None)]
    docs = []
    for k in range(60):
        body = text(r.randrange(60))
        if k % 2:
            body += (r.choice(items)[1] or "").upper() + " " + text(5)
        docs.append((k, body))
    return docs + [(None, "the of a"), (3, None), (3, None), (4, "")], items


def test_against_brute_force(spark, monkeypatch):
    # with one set, with several, and with strings that are joined, by a filter with few bits to a string and with many
    for seed, limit, size, sent, bits in ((1, 40_000, 1 << 25, 1000, 16), (2, 12, 1 << 25, 1000, 16), (3, 50, 200, 1000, 16), (1, 50, 200, 0, 16), (2, 50, 200, 5, 1), (3, 50, 200, 0, 16)):
        monkeypatch.setattr(decontam, "SENT_STRINGS", sent)
        monkeypatch.setattr(decontam, "BITS_PER_STRING", bits)
        monkeypatch.setattr(decontam, "FILTER_BITS", 64 if bits == 1 else 1 << 29)
        monkeypatch.setattr(decontam, "PART_BITS", 64 if bits == 1 else 1 << 12)
        monkeypatch.setattr(decontam, "STRINGS_PER_PASS", limit)
        monkeypatch.setattr(decontam, "GATHERED", size)
        docs, items = make(seed)
        d = spark.createDataFrame([(*x, "l") for x in docs], "doc_id long, text string, _leak string")
        b = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, doc_id string")
        got = sorted((tuple(r) for r in decontam.report(d, b).collect()), key=str)
        assert got == brute(docs, items)
        kept = decontam.drop_contaminated(d, b)
        assert kept.columns == d.columns and kept.count() == sum(not r[-1] for r in got)
        assert {r._leak for r in kept.collect()} == {"l"}


def test_an_item_without_an_id_hits_as_the_sql_says(spark):
    import duckdb

    from veldra.llm.queries import OP10

    docs, items = make(5)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark(item_id BIGINT, text VARCHAR)")
    docs = [(k, t) for k, (_, t) in enumerate(docs)] + [(900, "x the of y")]
    db.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    db.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    got = decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {r[0]: r for r in db.execute(OP10).fetchall()}
    assert {r.doc_id: tuple(r) for r in got} == want and want[900][2] >= 2


def test_search_against_find():
    r = random.Random(3)
    for _ in range(200):
        strings = {bytes(r.choices(b"ab", k=r.randint(2, 9))): ("x",) for _ in range(r.randint(1, 20))}
        text = bytes(r.choices(b"abc", k=200))
        got = sorted((a, s) for a, s, _ in decontam.WuManber(strings).find(text))
        assert got == sorted((a, s) for s in strings for a in range(len(text)) if text.startswith(s, a))


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "plain text of a page")], "item_id long, text string")
    assert decontam.report(none, items).count() == 0
    assert not any(r.contaminated for r in decontam.report(odd, items.limit(0)).collect())
    got = {r.doc_id: r.contaminated for r in decontam.report(odd, items).collect()}
    assert got[0] and got[4] and not got[1]
    assert decontam.drop_contaminated(odd, items).columns == odd.columns


def test_joined_windows_of_odd_documents(spark, odd, none, monkeypatch):
    bench = spark.createDataFrame([("a", "plain text of a page a second line here"), (None, "12345"), ("b", None)], "item_id string, text string")
    want = sorted((tuple(r) for r in decontam.report(odd, bench).collect()), key=str)
    monkeypatch.setattr(decontam, "SENT_STRINGS", 0)
    assert sorted((tuple(r) for r in decontam.report(odd, bench).collect()), key=str) == want and any(r[-1] for r in want)
    assert decontam.report(none, bench).count() == 0
    docs = odd.withColumnsRenamed({"ids": "a.b", "fingerprint": "_ROW", "component_id": "_windows", "lang": "_leak"})
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns
