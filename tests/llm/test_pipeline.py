import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_lines import brute as boilerplate
from tests.llm.test_simhash import brute_components
from veldra.llm import lines, quality


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in now.collect()]
        out = stage(spark, now, sf)
        rows = out.collect()
        if name != "bpe_encoding":
            assert out.columns == docs.columns
            assert {r.doc_id: r.n_chars for r in rows} == {r.doc_id: len(r.text) for r in rows}
        got = sorted((r.doc_id, r.text) for r in rows) if name != "bpe_encoding" else None
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            good = {r.doc_id for r in quality.classify(now, labels).collect() if r.score >= 0.3}
            assert got == sorted((i, t) for i, t, _ in before if i in good)
        elif name == "line_dedup":
            assert got == sorted(boilerplate(before, lines.RATIO, lines.MIN_PAGES))
        elif name == "simhash_dedup":
            first = {i for i, _, c in brute_components([(i, t) for i, t, _ in before]) if i == c}
            assert got == sorted((i, t) for i, t, _ in before if i in first)
        elif name == "decontamination":
            clean = {x[0] for x in leaks([(i, t) for i, t, _ in before], bench) if not x[-1]}
            assert got == sorted((i, t) for i, t, _ in before if i in clean)
        else:
            library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
            texts = {i: t for i, t, _ in before}
            assert {r.doc_id: r.ids for r in rows} == {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
        now = out
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.doc_id for r in now.collect())


def test_odd_and_empty_documents(spark, sf, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, d, sf).count() <= docs.count()


def test_columns_of_any_name(spark, sf, odd):
    """Dotted names, other cases, and names that stages use themselves are kept, and so are their values."""
    renamed = {"fingerprint": "a.b", "component_id": "_Fp", "score": "_row", "_dropped": "c`d"}
    docs = odd.withColumnsRenamed(renamed).drop("ids")
    for extra in ("IDS", "_text", "_Leak", "k0", "i0", "_host", "text.x"):
        given = docs.withColumn(extra, docs["doc_id"])
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, sf)
            if name == "bpe_encoding":
                assert set(out.columns) == ({c for c in given.columns if c.lower() != "ids"} - {"text"}) | {"ids", "decoded"}
            else:
                assert out.columns == given.columns
            if extra == "IDS" or name == "line_dedup":
                kept = {(r["doc_id"], r["a.b"], r["_Fp"], r["_row"], r["c`d"]) for r in out.collect()}
                assert kept <= {(r["doc_id"], r["fingerprint"], r["component_id"], r["score"], r["_dropped"]) for r in odd.collect()}
            else:
                out.schema  # analysed without clashes
