import math
import random
import zlib
from collections import Counter

import pytest

from veldra.llm import langid


def test_table_holds_the_trees_code_lengths():
    counts = {"en": Counter({"the": 9, "then": 3, "house": 2}), "de": Counter({"der": 7, "den": 3, "haus": 2}), "ja": Counter({"日本": 4})}
    trees = {k: langid.Tree(v) for k, v in counts.items()}
    model = langid.Model(trees)
    for w in ["the", "der", "x", "日", "thhhhhe", "z" * 200, "日本語den"]:
        got = model.bits([w])
        assert got == pytest.approx([trees[x].bits(w) for x in model.langs])


def test_code_lengths_are_of_a_probability():
    tree = langid.Tree(Counter({"ab": 3, "b": 1}))
    for context, (costs, escape) in tree.nodes.items():
        assert sum(2**-c for c in costs.values()) + 2**-escape == pytest.approx(1), context


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(langid, "REMEMBERED", 10)
    model = langid.Model({"en": langid.Tree(Counter({"a": 1}))})
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    whole = model.bits(words)
    assert len(model.rows) <= 200 and whole[0] == pytest.approx(sum(model.bits([w])[0] for w in words))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) > 2000 and (got.lang_pred == got.lang).mean() > 0.98


def plain_bits(counts, word):
    """Code length of one word by the rules alone: contexts from the longest to none, escapes in between."""
    after = {}
    for w, n in counts.items():
        t = b" " + w.encode() + b" "
        for at in range(1, len(t)):
            for k in range(min(langid.ORDER, at) + 1):
                own = after.setdefault(t[at - k : at], {})
                own[t[at]] = own.get(t[at], 0) + n
    t, bits = b" " + word.encode() + b" ", 0.0
    for at in range(1, len(t)):
        for k in range(min(langid.ORDER, at), -1, -1):
            own = after.get(t[at - k : at])
            if own is None:
                continue
            total = sum(own.values()) + len(own)
            if t[at] in own:
                bits -= math.log2(own[t[at]] / total)
                break
            bits -= math.log2(len(own) / total)
        else:
            bits += 8
    return bits


def test_identify_against_brute_force(spark):
    r = random.Random(3)
    vocab = {"aa": ["the", "house", "then", "of"], "bb": ["der", "haus", "dann", "über"], "cc": ["la", "maison", "été", "de"]}
    rows = [(i, " ".join(r.choices(vocab[x], k=9)) + r.choice([".", " 12!", "\n"]), x) for i, x in enumerate(r.choices(list(vocab), k=80))]
    rows += [(900 + k, t, r.choice(list(vocab))) for k, t in enumerate(["xyz", "the der la", "Über ÉTÉ", "日本 the", "a", "thththth haus"])] + [(990, None, "aa"), (991, "12 !!", "bb"), (992, "the", None)]
    counts = {}
    for i, t, lang in rows:
        if lang and t and zlib.crc32(str(i).encode()) % 4 != 2 and langid.words(t):
            counts.setdefault(lang, Counter()).update(langid.words(t))
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    for i, t, _ in rows:
        row = next(x for x in got if x.doc_id == i)
        assert row.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        bits = {lang: sum(plain_bits(c, w) for w in langid.words(t)) for lang, c in counts.items()}
        if not langid.words(t):
            assert (row.lang_pred, row.score) == ("und", 0.0)
        else:
            best = min(sorted(bits), key=bits.get)
            assert row.lang_pred == best and row.score == pytest.approx(1 / sum(2 ** max(bits[best] - b, -1000) for b in bits.values()))


def test_ties_go_to_the_first_language():
    same = Counter({"ab": 2})
    model = langid.Model({"zz": langid.Tree(same), "aa": langid.Tree(same), "mm": langid.Tree(same)})
    assert model.predict("ab ab c") == ("aa", pytest.approx(1 / 3))


def test_odd_rows(odd, none):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 5, None))
    assert by[0].lang_pred == "en" and math.isclose(by[0].score, by[4].score) and all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_all_languages_and_long_runs_are_learned(spark):
    rows = [(i, "".join(chr(97 + (i // 8 * 7 + k) % 26) for k in range(5)), f"l{i // 8:03}") for i in range(8 * 205)]
    rows += [(9000 + i, "xyz" * 40, "run") for i in range(20)]
    counts = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(counts) == 206 and counts["run"]["xyz" * 40] > 0
