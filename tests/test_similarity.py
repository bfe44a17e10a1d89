import random

from pyspark.sql import functions as F

from veldra.functions import documents
from veldra.operators import governance, resolve, similarity


def brute_sets(left, right, least):
    return sorted((a, b) for a, (x, s) in enumerate(left) for b, (y, t) in enumerate(right) if x == y and s and t and len(set(s) & set(t)) / min(len(set(s)), len(set(t))) >= least)


def joined(spark, left, right, least, part):
    make = lambda rows: spark.createDataFrame([(k, x, s) for k, (x, s) in enumerate(rows)], "row int, block string, items array<string>").repartition(3)
    a, b = make(left), make(right)
    pairs = similarity.similar_sets(a, b, least, part)
    of = lambda df, row, name: df.select(F.col("row").alias(row), similarity.set_key(F.col("block"), F.col("items")).alias(name))
    rows = pairs.join(of(a, "x", "a"), "a").join(of(b, "y", "b"), "b").select("x", "y")
    return sorted(tuple(r) for r in rows.collect()), similarity.candidate_sets(a, b, least, part).count(), pairs.count()


def test_sets_against_the_nested_loop(spark):
    r = random.Random(1)
    words = [f"w{k}" for k in range(40)]
    # one firm has most of the rows; a few words are in most titles
    title = lambda: list({w for w in r.choices(words, weights=[1 / (k + 1) for k in range(40)], k=r.randrange(1, 7))})
    side = lambda n: [("firm" if r.random() < 0.7 else f"f{r.randrange(4)}", title()) for _ in range(n)]
    left = side(150) + [("firm", []), ("firm", None), (None, ["a"]), ("firm", ["w0", "w0", None])]
    right = side(250) + [("firm", []), ("firm", ["w0"]), (None, ["a"])]
    known = lambda rows: [(x if x is not None else object(), [w for w in s or [] if w]) for x, s in rows]
    for least, part in ((0.6, 2000), (0.6, 7), (0.8, 20), (1.0, 2000), (0.01, 50)):
        got, candidates, pairs = joined(spark, left, right, least, part)
        assert got == brute_sets(known(left), known(right), least)
        assert candidates >= pairs
        if least == 0.8:
            assert candidates < 2 * pairs  # few of the pairs compared are in vain


def test_leads_take_their_first_job(spark):
    leads = spark.createDataFrame([(1, "Acme Inc", "Senior Data Engineer"), (2, "Acme", "Chef"), (3, "Acme", "C"), (4, "Other", "Data Engineer"), (5, "Acme", None)], "lead int, company string, title string")
    jobs = spark.createDataFrame([(9, "ACME", "Data Engineer", "u9"), (4, "Acme Co", "data engineer", "u4"), (7, "Acme", "C", "u7"), (8, "Acme", "c", "u8")], "pos int, company string, title string, url string")
    found, rest = resolve.promote_leads(leads, jobs)
    # "C" is no token, but the same title
    assert sorted((r.lead, r.official_url) for r in found.collect()) == [(1, "u4"), (3, "u7")]
    assert sorted(r.lead for r in rest.collect()) == [2, 4, 5]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_pairs_against_all_pairs(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abc", k=r.randrange(0, 7)))
    left, right = [word() for _ in range(60)] + ["é日本", None, "x" * 60], [word() for _ in range(60)] + ["é本日", "x" * 58 + "yz", None]
    side = lambda ws: spark.createDataFrame([(w,) for w in ws], "value string")
    for most in (1, 2):
        want = sorted({(a, b, edits(a, b)) for a in left for b in right if a is not None and b is not None and edits(a, b) <= most})
        assert sorted(tuple(x) for x in similarity.fuzzy_pairs(side(left), side(right), most).collect()) == want


def test_lookalikes(spark):
    side = lambda *ws: spark.createDataFrame([(w,) for w in ws], "value string")
    got = similarity.lookalikes(side("acme.com", "acne.com", "acmee.con", "far.org", "acne.com"), side("acme.com", "acme.con"))
    assert sorted(tuple(r) for r in got.collect()) == [("acmee.con", "acme.con", 1), ("acne.com", "acme.com", 1)]


def test_domains_of_companies_spelled_alike(spark):
    records = spark.createDataFrame([(1, "Acmee", False), (2, "Acme", None), (3, "Acme", True), (4, "Zebra", False)], "id int, company string, has_career boolean")
    domains = spark.createDataFrame([("Acme", "Acme.com"), ("Acne", "acne.org")], "company string, domain string")
    tries = lambda n: sorted((r.id, r.url) for r in governance.infer_domains(records, domains, n).collect() if r.url.startswith("https://jobs."))
    assert tries(0) == [(2, "https://jobs.acme.com/")]
    assert tries(1) == [(1, "https://jobs.acme.com/"), (2, "https://jobs.acme.com/")]
    assert tries(2) == [(1, "https://jobs.acme.com/"), (1, "https://jobs.acne.org/"), (2, "https://jobs.acme.com/")] or tries(2)[0] == (1, "https://jobs.acme.com/")


HOSTILE = ['{"a":' * 50 + "1" + "}" * 50, "[" * 30 + "]" * 30, "", " ", "nul", '{"a":1,}', '{"a":1}{"b":2}', "{}", "[]", "null", '{"":{"":{"isOfficial":null}}}', '{"VERIFIED":[]}', '{"x":"\\"verified\\":1"}', '{"k":"https:\\/\\/a.com\\/b","l":["two  words","https://a.com/b"]}']


def test_walk_of_hostile_documents(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*HOSTILE, None])], "id int, json string")
    depth = {r.id: r.d for r in documents.walk(docs).groupBy("id").agg(F.max("depth").alias("d")).collect()}
    assert depth == {0: 50, 1: 29, 6: 1, 7: 0, 8: 0, 9: 0, 10: 3, 11: 1, 12: 1, 13: 2}
    assert sorted((r.id, r["keys"]) for r in documents.forbidden_keys(docs).collect()) == [(10, ["isofficial"]), (11, ["verified"])]
    texts = {r.id: (r.text, r.urls) for r in documents.document_texts(docs).collect()}
    assert texts[13] == ("https://a.com/b two words https://a.com/b", ["https://a.com/b"]) and texts[12] == ('"verified":1', []) and texts[9] == ("", [])
    assert documents.walk(docs.limit(0)).count() == 0


def test_postings_at_any_depth(spark):
    ld = '{"@graph":[{"@type":"Thing"},{"x":{"@type":["Thing","JobPosting"],"title":"Dev","hiringOrganization":{"name":"Acme"},"jobLocation":[{"address":{"addressLocality":"Rome"}}],"datePosted":"2026-01-02"}},{"@type":"JobPosting","title":"First","hiringOrganization":"B"}]}'
    docs = spark.createDataFrame([(1, ld), (2, '{"@type":"Person"}'), (3, "broken")], "id int, json string")
    assert [tuple(r) for r in documents.postings(docs).collect()] == [(1, 2, "First", "B", None, None)]
