import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from veldra.llm import pii

PATTERNS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(m[0]))


def test_base_spans_against_plain_patterns():
    r = random.Random(0)
    parts = ["0", "1", "25", "9", ".", "@", "a", "-", "+", " ", "(", ")", "b.c", "4111 1111 1111 1111", "é", "%", "+1 (578) 555-6437"]
    for _ in range(20_000):
        t = "".join(r.choices(parts, k=r.randrange(25)))
        assert pii.base_spans(t) == brute(t), t


@pytest.mark.parametrize("text", ["1" * 300_000, "1." * 100_000, "a@" * 100_000, "a." * 100_000 + "@", "+1" + " " * 200_000, "1-" * 100_000, "a" * 300_000])
def test_long_texts_take_linear_time(text):
    pii.mentions(text, pii.base_spans(text))


def test_report(spark, odd, none):
    rows = {r.doc_id: r for r in pii.report(odd).collect()}
    assert rows[6].n_email == 1 and rows[6].spans.startswith("email:")
    start = "ÄÖÜ ß 日本語 😀 <|endoftext|> a@b.com".index("a@b")
    assert rows[6].base_sha256 == hashlib.sha256(f"email:{start}:{start + 7}".encode()).hexdigest()
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() == rows[2].base_sha256
    assert pii.report(odd).count() == odd.count() and pii.report(none).count() == 0


def test_counts(spark):
    text = "a@b.com 10.0.0.1 c@d.org +1 (578) 555-6437 and 4111 1111 1111 1111, 10.0.0.300 e@f.net"
    r = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (3, 1, 1, 1)
    want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute(text))
    assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans == want


def test_patterns_find_unseen_identifiers(spark):
    texts = [f"my contact is user{i}@mail.com thanks" for i in range(20)] + ["my contact is KX4471-99 thanks", "see part KX5571-99 there", "my contact is here thanks"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    at = texts[20].index("KX")
    assert rows[20] == f"id:{at}:{at + 9}" and rows[21] == "" and rows[22] == ""
    assert all(rows[i].startswith("email:14:") for i in range(20))


def test_a_found_identifier_leads_to_further_patterns(spark):
    """Two hops: addresses make the first pattern trusted, what it finds the second, and that finds what no other has."""
    texts = [f"Then my contact is user{i}@mail.com thanks" for i in range(60)]
    texts += [f"so my contact is KX44{i}-99 thanks" for i in range(12)] + [f"the badge number KX44{i}-99 of ours" for i in range(12)]
    last = len(texts)
    texts += ["a badge number ZZ9981-00 of theirs", "see part ZZ5571-99 there", "badge number nine of theirs"]
    rows = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    at = texts[last].index("ZZ")
    assert rows[last].spans == f"id:{at}:{at + 9}" and rows[last].n_id == 1
    assert rows[last + 1].spans == rows[last + 2].spans == ""
    assert all(rows[k].n_id == 1 for k in range(60, 84)) and all(rows[k].n_id == 0 and rows[k].n_email == 1 for k in range(60))


def test_an_identifier_of_any_length(spark):
    texts = [f'x token = "{i:040x}" y' for i in range(10 ** 17, 10 ** 17 + 49)] + ['x token = "' + "a1b2" * 50 + '" y', 'x token = "none of it" y', "hash " + "0a" * 20 + " alone"]
    rows = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[49] == "id:11:211" and rows[50] == rows[51] == "" and all(rows[k] == "id:11:51" for k in range(49))


def plain_trusted(rows):
    graph = {}
    for p, i, seed, dropped in rows:
        graph.setdefault(p, {})
        was = graph[p].get(i, (False, False))
        graph[p][i] = was[0] or seed, was[1] or dropped
    score = {i: 1.0 for own in graph.values() for i, (s, _) in own.items() if s}
    while True:
        rated = {p: sum(score.get(i, 0.0) for i in own) / (1 + sum(1 if i in score or d else pii.UNKNOWN for i, (_, d) in own.items())) for p, own in graph.items()}
        trusted = {p: x for p, x in rated.items() if x >= pii.CONFIDENCE and sum(i in score for i in graph[p]) >= pii.SEEDS}
        new = dict(score)
        for i in {i for p in trusted for i in graph[p]}:
            doubt = 1.0
            for p, x in trusted.items():
                if i in graph[p]:
                    doubt *= 1 - min(x, 0.999)
            new[i] = max(new.get(i, 0.0), 1 - doubt)
        if len(new) == len(score):
            return set(trusted)
        score = new


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trusted_patterns_against_a_plain_loop(spark, seed):
    r = random.Random(seed)
    rows = []
    for p in range(40):
        kind = p % 4
        for _ in range(r.randrange(3, 30)):
            i = r.randrange(25) + 25 * (kind if r.random() < 0.97 else r.randrange(4))
            rows.append((f"p{p}", i, i < 20, i % 25 == 24))
    rows += [("q", 1000 + i, True, False) for i in range(4)] + [("q2", 1000 + i % 6, i < 5, False) for i in range(6)] * 2
    got = pii.trusted_patterns(spark.createDataFrame(rows, "pattern string, instance long, seed boolean, dropped boolean"))
    assert {x.pattern for x in got.collect()} == plain_trusted(rows)
    assert pii.trusted_patterns(spark.createDataFrame([], "pattern string, instance long, seed boolean, dropped boolean")).count() == 0


def test_secrets_that_no_seed_knows_are_found_by_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null")
    secret = F.regexp_extract(F.lower("text"), 'token = "([0-9a-f]+)"', 1)
    got = pii.report(docs).join(docs.select("doc_id", secret.alias("secret")), "doc_id").toPandas()
    has = got.secret != ""
    held_out = has & got.secret.map(lambda x: pii._hash(x) % 2 != pii.SEED_FOLD)
    assert 50 < held_out.sum() < has.sum() - 50
    assert (got[held_out].n_id > 0).mean() > 0.98 and (got[has].n_id > 0).mean() > 0.98
    # numbers as long as a card's that are none stand between words too, and are left alone
    assert (got[~has].n_id > 0).sum() == 0


def test_words_around_a_place():
    r = random.Random(6)
    for _ in range(3000):
        text = "".join(r.choices(["ab", "C", " ", "  ", "7", "_", ".", "é", "@"], k=r.randrange(14)))
        at = r.randrange(len(text) + 1)
        words = pii.Words(text)
        assert words.before(at) == pii._AROUND.findall(text, 0, at)[-3:]
        assert words.after(at) == pii._AROUND.findall(text, at)[:1]
