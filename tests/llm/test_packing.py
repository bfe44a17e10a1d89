import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from veldra.llm import packing

PATH = P.path("byte_bpe_50k.json")


def check(rows, texts, size):
    """Each text is there in whole pieces, sequences have no gap and no overlap; how many sequences."""
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % size + 1
        for p, start in enumerate([0, *range(first, len(ids), size)]):
            part = ids[start : first if not p else start + size]
            want[i, p, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


def test_documents(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += [(500, None), (501, ""), (502, "x<|endoftext|>y"), (502, "x<|endoftext|>y"), (None, "no id"), (503, "word " * 5000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    rows = packing.report(docs, PATH).collect()
    total = sum(r.length for r in rows)
    assert check(rows, texts, packing.SIZE) == -(-total // packing.SIZE)  # none fewer is possible
    for size in (7, 64):
        rows = packing.pack(docs, PATH, size=size, keep=["doc_id"]).collect()
        assert check(rows, texts, size) <= 1.01 * sum(r.length for r in rows) / size + 1


def slow_best_fit(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        gap = min(fits) if fits else size
        if fits:
            gaps.remove(gap)
        gaps.append(gap - n)
    return len(gaps)


def test_plans():
    r = random.Random(3)
    cases = [[r.randrange(1, 101) for _ in range(400)], [r.randrange(20, 40) for _ in range(300)], [100] * 9, [1] * 205, [34] * 20 + [33] * 20, [60, 41, 40, 39, 20, 1, 99], []]
    for lengths in cases:
        counts = Counter(lengths)
        assert sum(m for _, m in packing.best_fit(counts, 100)) == slow_best_fit(lengths, 100)
        for turns in (1, 2, 3, 4):
            full, rest = packing.exact_patterns(counts, 100, turns)
            assert all(sum(x * n for x, n in held.items()) == 100 and times > 0 for held, times in full)
            used = Counter()
            for held, times in full + packing.best_fit(rest, 100):
                assert sum(x * n for x, n in held.items()) <= 100
                for x, n in held.items():
                    used[x] += n * times
            assert used == counts
        assert sum(m for _, m in packing.fewest(counts, 100)) <= slow_best_fit(lengths, 100)


def test_exact_combinations_are_found():
    # one sequence each of a single complement, a pair, a triple, and one that takes four pieces behind the first
    for lengths in ([70, 30], [70, 19, 11], [50, 23, 16, 11], [40, 25, 14, 11, 10], [25, 25, 25, 25]):
        full, rest = packing.exact_patterns(Counter(lengths), 100)
        assert [(sorted(h.elements()), n) for h, n in full] == [(sorted(lengths), 1)] and not rest


def test_cut():
    for n in range(1, 40):
        parts = packing.cut(n, 8)
        assert [p for p, _ in parts] == [sum(x for _, x in parts[:k]) for k in range(len(parts))] and sum(x for _, x in parts) == n
        assert all(x == 8 for _, x in parts[1:]) and 1 <= parts[0][1] <= 8


def test_odd_rows_and_names(spark, odd, none):
    docs = odd.withColumnsRenamed({"score": "a.b", "ids": "_before", "fingerprint": "PART", "component_id": "_at", "lang": "_TEXT", "source": "Offset"})
    got = packing.pack(docs, PATH)
    assert {"a.b", "_before", "_at", "_TEXT"} < set(got.columns) and "PART" not in got.columns
    assert got.where("piece = 0").count() == odd.count()
    assert packing.report(none, PATH).count() == 0
