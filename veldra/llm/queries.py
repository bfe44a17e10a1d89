"""Queries of this subpackage: one for each operator, with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veldra.llm import align, bpe, decontam, embeddings, html, langid, lines, packing, pii, quality, resample, simhash, urls
from veldra.llm.common import table

TOKENIZER = "word_bpe_49k.json"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near(table(spark, sf_dir, "embeddings"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL))


QUERIES = {f.__name__: f for f in (op1_quality, op2_line_dedup, op3_embedding_dedup, op4_simhash_dedup, op5_language, op6_url_filter, op7_pii, op8_bpe, op9_html_text, op10_decontamination, op11_alignment, op12_resampling, op13_packing)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r AS (WITH RECURSIVE r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, min(b) AS b FROM r GROUP BY a),
c AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(r.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(r.b, vec_id)) AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN r ON r.a = vec_id
"""

_RULES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(urls.RULES, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1])))
)
OP6 = f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r AS (SELECT page_id, host, path, CASE {_RULES} END AS r FROM u)
SELECT page_id, host, path, split_part(r, ' ', 2) AS rule, coalesce(split_part(r, ' ', 1), '{urls.DEFAULT}') AS verdict FROM r
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, list_slice(w, p, p + k - 1) AS g FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, p, list_slice(w, p, p + k - 1) AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT doc_id, p, k, item_id FROM dw JOIN iw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM m)) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(o.n, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)
"""

#: CRC-32 is written out, on distinct words: its table, then a fold over the word's bytes.
OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT r, unnest(w) AS x FROM d),
bf AS (SELECT unnest({_WORDS}) AS x FROM benchmark),
k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, n: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
wd AS (SELECT DISTINCT x, hex(encode(x)) AS h FROM (SELECT x FROM f UNION ALL SELECT x FROM bf)),
wb AS (SELECT x, list_transform(range(1, length(h), 2), lambda i: 16 * (instr('0123456789ABCDEF', substr(h, i, 1)) - 1) + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1) AS b FROM wd),
b AS (SELECT x, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])), 4294967295) % 10000 AS bucket FROM wb, k),
s AS (SELECT bucket, count(*) AS n FROM f JOIN b USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN b USING (x) GROUP BY bucket),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, sum(gain)::BIGINT AS weight FROM f JOIN b USING (x) JOIN g USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, list_reduce(list_prepend(0, list_transform(string_split(substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8), ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda a, c: a * 16 + c) AS h FROM d LEFT JOIN w USING (r)),
v AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM v WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM o) * 10 // 100 THEN rank END AS rank FROM v LEFT JOIN o USING (r)
"""

ORACLE = {"op2_line_dedup": lines.ORACLE, "op3_embedding_dedup": OP3, "op6_url_filter": OP6, "op10_decontamination": OP10, "op12_resampling": OP12}
