"""Queries of the training-data operators: one per operator and the pipeline, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontaminate, html_text, language, lines, mixing, prefix_trie, quality, simhash, sketch, substrings, tokens, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents")).drop("copies", "source")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=16)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"), min_documents=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bi),
ns AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
h AS (SELECT x.doc_id, x.i, x.n, bw.item_id FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM di) x JOIN bw ON bw.n = x.n AND bw.g = x.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256, hit.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""

OP3_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
c AS (SELECT *, CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 8 + ((size >> (length(bin(size)) - 4)) & 7) END AS class, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS key FROM s),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM c GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, total * 2.0::DOUBLE AS cap, sum(total) OVER () * 1.5::DOUBLE AS budget FROM t),
l AS (SELECT *, (budget - sum(cap) OVER o + cap) / (sum(w) OVER () - sum(w) OVER o + w) AS level, cap / w AS limit_ FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
g AS (SELECT source, total, least(cap, coalesce(w * max(CASE WHEN limit_ > level THEN level END) OVER (), cap)) AS target FROM l),
r AS (SELECT c.*, g.total, g.target, CASE WHEN g.total > 0 THEN g.target / g.total ELSE 0.0::DOUBLE END AS rate, ('0x' || substr(md5('42|' || coalesce(c.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off_,
 row_number() OVER (PARTITION BY c.source ORDER BY class, key, doc_id, size) AS rank FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, total AS source_size, target, CAST(floor(off_ + rate * rank) - floor(off_ + rate * (rank - 1)) AS BIGINT) * size AS taken FROM r
"""

OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_bytes, payload_digest, max(page_id) AS top, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN m.n > 1 AND p.page_id IS DISTINCT FROM m.top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN m.n > 1 AND p.page_id IS DISTINCT FROM m.top THEN m.top END AS refers_to
FROM p LEFT JOIN m ON m.payload_bytes = p.payload_bytes AND m.payload_digest = p.payload_digest
"""

OP12_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(length(role) || ' ' || role || text)) AS x FROM t GROUP BY conv_id),
c AS (SELECT conv_id, x, conv_id - conv_id % 20 AS base, (list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ord(s)::UBIGINT)),
 lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]), lambda u, i: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384::UBIGINT) ELSE u >> 1 END)) & 3) AS crc FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(list_slice(b.x, 1, 3 - crc), []), list_slice(c.x, 4 - crc, len(c.x))) AS x FROM c LEFT JOIN o b ON b.conv_id = c.base),
m AS (SELECT conv_id, x, unnest(range(len(x) + 1)) AS depth FROM r),
n AS (SELECT list_slice(x, 1, depth) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(x) = depth), '')) AS ends_sha256,
 CASE WHEN depth > 0 THEN len(regexp_extract_all(any_value(x[depth].text), '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM m GROUP BY path, depth),
k AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path),
s AS (SELECT path, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT list_slice(path, 1, unnest(range(depth + 1))) AS path, n_children, (n_convs - 1) * words AS saved FROM v) GROUP BY path)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s ON s.path = v.path LEFT JOIN n p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.path = list_slice(v.path, 1, v.depth - 1)
"""

OP13_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r.key IS NOT NULL) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (r.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN r ON r.key = k.key GROUP BY doc_id
"""

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_html_text": op4_html_text,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_sketch": op7_sketch,
    "op8_warc": op8_warc,
    "op9_token_output": op9_token_output,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_line_dedup": op13_line_dedup,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op1_decontaminate": OP1_SQL, "op3_mix_sources": OP3_SQL, "op8_warc": OP8_SQL, "op12_prefix_trie": OP12_SQL, "op13_line_dedup": OP13_SQL}
