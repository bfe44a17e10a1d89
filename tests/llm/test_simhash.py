import random
import re
import string

import numpy as np
import xxhash

from veldra.llm import simhash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    up = {k: k for k in range(len(fps))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                up[root(a)] = root(b)
    group = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            group[root(k)] = min(i, group.get(root(k), i))
    return sorted(((i, f"{f:016x}", group.get(root(k), i)) for k, (i, f) in enumerate(fps)), key=str)


def make(seed, n=120):
    r = random.Random(seed)
    words = ["".join(r.choices(string.ascii_letters + "é日", k=r.randint(1, 8))) for _ in range(400)]
    rows = []
    for _ in range(n):
        w = r.choices(words, k=r.choice([0, 1, 3, 4, 60, 150]))
        rows.append((len(rows), " ".join(w)))
        for _ in range(r.choice([0, 0, 2])):
            v = w[:]
            for _ in range(r.choice([0, 1])):
                if v:
                    v[r.randrange(len(v))] = r.choice(words)
            rows.append((len(rows), r.choice([" ", "\n", "\t "]).join(v)))
    return rows


def test_against_brute_force(spark):
    rows = make(1) + [(None, "a b c"), (7, None), (3, "\xa0 A\x0bB"), (3, "\xa0 A\x0bB")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute_components(rows)


def test_split_bands_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 8)
    rows = make(2, 60)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_components(rows)


def test_bit_sliced_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flip = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False)) for _ in range(200)], dtype=np.uint64)
    values = np.concatenate([base, base[rng.integers(0, 40, 200)] ^ flip])
    n = -(-len(values) // 64)
    i, j = np.triu_indices(n)
    for radius in (0, 1, 3, 4, 7):
        got = {(int(a), int(b)) for x, y in simhash.near_pairs(values, i, j, radius) for a, b in zip(x, y, strict=True)}
        want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if (int(values[a]) ^ int(values[b])).bit_count() <= radius}
        assert {tuple(sorted(p)) for p in got} == want


def test_any_two_within_the_radius_share_a_band():
    r = random.Random(5)
    for n in (10, 10**7, 10**9, 10**12):
        masks = simhash.bands(n)
        for _ in range(200):
            x = r.getrandbits(64)
            y = x ^ sum(1 << b for b in r.sample(range(64), 4))
            assert any(x & m == y & m for m in masks)


def test_blocks_are_abandoned_one_by_one():
    rng = np.random.default_rng(7)
    values = rng.integers(0, 1 << 63, 64 * 40, dtype=np.uint64)
    values[65] = values[3] ^ np.uint64(5)  # a close pair in the blocks 0 and 1
    i, j = np.triu_indices(40, 1)
    work = []
    found = [(int(a), int(b)) for x, y in simhash.near_pairs(values, i, j, 4, work) for a, b in zip(x, y, strict=True)]
    assert (3, 65) in found
    batches = -(-len(i) // 512)
    # the pair's blocks are counted to the end and nearly all others left long before
    assert len(work) > 64 and work[63] < 20 and sum(work) < 0.75 * 64 * len(i) and batches == 2


def test_keep_one(spark, odd, none):
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [0, 1, 3, 6]
    assert simhash.keep_one(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_keep_one_loses_no_text_of_a_repeated_id(spark):
    a, b = "one text of some words that are its own", "quite another page about something else here"
    rows = [(5, a), (5, b), (2, b), (7, None), (7, ""), (None, a), (None, "third text with words of no other one"), (None, "third text with words of no other one")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, _gone string, _id string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    want = [(5, a), (2, b), (7, ""), (None, "third text with words of no other one")]
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted(want, key=str)


def test_keep_one_keeps_one_row_of_each_group(spark):
    r = random.Random(9)
    rows = make(4, 60)
    rows = [(r.choice([None, r.randrange(40)]), t) for _, t in rows] + rows[:30] + rows[:10]
    rows = [(i, t if r.random() < 0.95 else None) for i, t in rows]
    groups = {}
    for k, (_, _, c) in enumerate(brute_components([(k, t) for k, (_, t) in enumerate(rows)])):
        groups.setdefault(c, 0)
    got = [(x.doc_id, x.text) for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(groups)
    kept = {simhash.fingerprint(t) for _, t in got}
    by = {}
    for _, f, c in brute_components([(k, t) for k, (_, t) in enumerate(rows)]):
        by.setdefault(c, set()).add(int(f, 16))
    assert all(len(own & kept) == 1 for own in by.values())
