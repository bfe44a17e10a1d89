import hashlib
import random
import unicodedata
from functools import cache

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from veldra.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Library.from_file(PATH)
SPEC = bpe.Tokenizer.read(PATH)


def own(words=()):
    plain = bpe.Tokenizer(SPEC)
    blob = bpe.Automaton.build({w.encode(): list(plain.piece_ids(w)) for w in words})
    return bpe.Tokenizer(SPEC, bpe.Automaton(bpe.mapped(blob)))


@cache
def shared():
    return own(["the", "'s", "é"])


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FF), max_size=60))
def test_encodes_and_decodes_as_the_library(text):
    t = shared()
    ids = t.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert t.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " \n", " a<|endoftext|>b <|startoftext|>", "<|endoftext|", "É́ İSTANBUL ΣΑΣ ΟΔΟΣ", "x\x1cy\x85z\u200b\u3000", "it's we'll 'SS don'T ½ ² 日本語 😀👍🏽 \x00", "a" * 5000, "ab" * 3000 + "!" * 3000, "word " * 20_000])
def test_odd_texts(text):
    assert own().encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_code_point_in_context():
    t = own()
    # of planes without characters, and of ideographs and syllables that are all alike, one in so many
    alike = lambda c: c >= 0x40000 and not 0xE0000 <= c < 0xE1000 or 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A0 or 0x20000 <= c < 0x32000
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (not alike(c) or c % 61 == 0 or c & 0xFFFF < 2)]
    for at in range(0, len(codes), 20_000):
        some = codes[at : at + 20_000]
        texts = [f"a{chr(c)}b {chr(c)}1{chr(c)} a{chr(c)}\u0301\u0316 \u0316{chr(c)}!" for c in some]
        for text, want in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
            assert t.encode(text) == want.ids, ascii(text)


def test_compositions():
    t = own()
    for c in range(0x110000):
        d = unicodedata.decomposition(chr(c))
        if d and not d.startswith("<"):
            text = "a" + unicodedata.normalize("NFD", chr(c)) + "\u0316b"
            assert t.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids, ascii(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=30), st.text(st.sampled_from(sorted(bpe.younger().all)[::50]), max_size=4))
def test_any_characters(text, odd):
    t, text = shared(), odd.join([text[:7], text[7:15], text[15:]])
    ids = t.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert t.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_automaton():
    r = random.Random(1)
    words = {bytes(r.choices(b"abc", k=r.randint(1, 9))): [r.randrange(1000) for _ in range(r.randint(1, 4))] for _ in range(3000)}
    a = bpe.Automaton(bpe.mapped(bpe.Automaton.build(words)))
    assert all(a.find(w) == ids for w, ids in words.items())
    for _ in range(3000):
        w = bytes(r.choices(b"abcd", k=r.randint(0, 10)))
        assert (a.find(w) is not None) == (w in words)
    empty = bpe.Automaton(bpe.mapped(bpe.Automaton.build({})))
    assert empty.find(b"a") is None


def test_automaton_is_minimal():
    words = {w: [1] for w in (b"tap", b"taps", b"top", b"tops")}
    blob = bpe.Automaton.build(words)
    assert len(bpe.Automaton(blob).final) == 5


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    t = own()
    text = " ".join(f"w{i}" for i in range(500))
    assert t.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert max(len(t.known), len(t.before)) <= 20


def test_operator(spark, odd, none):
    got = bpe.encode(odd, PATH)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "fingerprint", "component_id", "score", "_dropped", "ids", "decoded"]
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in got.collect():
        want = LIBRARY.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == LIBRARY.decode(want, skip_special_tokens=False)
    d = {r.doc_id: r for r in bpe.digests(odd, PATH).collect()}
    assert d[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and d[1].n_tokens == 0
    assert d[0].ids_sha256 == hashlib.sha256(" ".join(map(str, LIBRARY.encode(texts[0], add_special_tokens=False).ids)).encode()).hexdigest()
    assert bpe.encode(none, PATH).count() == 0


def test_frequent_words(spark):
    docs = spark.createDataFrame([("a a a b b",), ("b c c d d A",), (None,), ("e",)], "text string")
    assert set(bpe.frequent_words(docs, most=2)) == {"a", "b"}
    assert set(bpe.frequent_words(docs, most=3)) == {"a", "b", "c"}
    assert set(bpe.frequent_words(docs)) == {"a", "b", "c", "d"}
