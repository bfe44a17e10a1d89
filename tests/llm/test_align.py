import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veldra.llm import align
from veldra.llm.tokens import ByteLevel, read

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def test_byte_level_ids_are_the_librarys_for_every_code_point(library):
    plain, special = ByteLevel(read(A), False), ByteLevel(read(A), True)
    own = Tokenizer.from_file(A)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c}!{c}  " for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    texts += ["x<|endoftext|> y<|endoftext|", "<|endoftext|>", "", " ", "a" * 50_000, " " * 50_000 + "x", "\r\n\t   don't DON'T we'll"]
    for k in range(0, len(texts), 2000):
        some = texts[k : k + 2000]
        for t, x, y in zip(some, library[0].encode_batch_fast(some, add_special_tokens=False), own.encode_batch_fast(some, add_special_tokens=False), strict=True):
            assert plain.encode(t).tolist() == x.ids, t
            assert special.encode(t).tolist() == y.ids, t


def brute(rows, library):
    a, b = library
    inverse = {c: i for i, c in enumerate(align.ByteLevel.__init__.__globals__["byte_chars"]())}
    spelled_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for i, t in rows:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bx = [bytes(inverse[c] for c in a.id_to_token(k)) for k in x]
        by = [spelled_b(k) for k in y]
        if not t or b"".join(bx) != (" " + t).encode() or b"".join(by) != (" " + t).encode():
            found.append((i, [], [], [], []))
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ex, ey = ends(bx), ends(by)
        links = [(p, q) for p, e in zip(x, ex, strict=True) for q, f in zip(y, ey, strict=True) if e == f]
        groups, at = [], 0
        for cut in sorted(set(ex) & set(ey)):
            groups.append(([p for p, e in zip(x, ex, strict=True) if at < e <= cut], [q for q, f in zip(y, ey, strict=True) if at < f <= cut]))
            at = cut
        found.append((i, x, y, groups, links))
    count = Counter(p for *_, links in found for p in links)
    best = {}
    for (_, q), n in count.items():
        best[q] = max(best.get(q, 0), n)
    out = []
    for i, x, y, groups, links in found:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, len(x), len(y), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=str)


ODD = ["", None, " ", "  two  spaces ", "a▁b", "tab\tnew\nline\r\n", "<|endoftext|><s></s> <0x0A>", "日本語 ééé é ﬁ 😀👩‍🚀", "word " * 400, "x" * 700, "12345 67.8", "\u0000\u0001"]


def test_against_brute_force(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 1500][:60]
    rows += [(1000 + k, t) for k, t in enumerate(ODD)] + [(1, "again and again"), (1, "again and again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, library)
    assert sorted((tuple(r) for r in align.report(docs, A, B).collect()), key=str) == want
    # only some of the pairs are sent to the tasks, or none: links of the others are joined
    for sent in (50, 0):
        links = align.aligned(docs, A, B)
        got = align.with_counts(links, sent_pairs=sent).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_links_of_tokens_without_bytes():
    ends_a, ends_b = np.array([2, 3, 3, 5]), np.array([1, 3, 3, 3, 5, 5])
    group_a, group_b, left, right = align.links(ends_a, ends_b)
    want = [(i, j) for i, x in enumerate(ends_a) for j, y in enumerate(ends_b) if x == y]
    assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == want
    assert group_a.tolist() == [0, 0, 0, 1] and group_b.tolist() == [0, 0, 0, 0, 1, 1]


def test_odd_rows_and_names(spark, odd, none):
    docs = odd.withColumnsRenamed({"score": "a.b", "ids": "_row", "fingerprint": "_TEXT", "component_id": "N_A"})
    got = align.with_counts(align.aligned(docs, A, B))
    assert got.count() == odd.count() and {"a.b", "_row", "_TEXT"} < set(got.columns) and "N_A" not in got.columns
    assert align.report(none, A, B).count() == 0
