"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import bfd_output, bpe, conversation_trie, exact_dedup, hard_negatives, html_blocks, importance, jaccard_join, kk_packing, license_scan, maxscore, mixing, repeated_spans
from tremor.llm.common import documents


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.labelled(documents(spark, sf_dir))


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return maxscore.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


def op6_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kk_packing.pack(documents(spark, sf_dir))


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.digests(repeated_spans.strip_repeats(documents(spark, sf_dir)))


def op8_bfd_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfd_output.digests(bfd_output.packed_rows(documents(spark, sf_dir)))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.component_rows(documents(spark, sf_dir))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(documents(spark, sf_dir)))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.mining_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, rows.where(F.col("vec_id") % 50 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixture, op2_main_text, op3_exact_dedup, op4_importance, op5_maxscore, op6_kk_packing, op7_repeated_spans, op8_bfd_output, op9_license_scan, op10_jaccard_join, op11_bpe, op12_trie, op13_hard_negatives)
}

OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-length(text), doc_id)) AS keep_id, max(length(text)) AS n_points
  FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND length(text) = n_points AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

OP5_SQL = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM x q JOIN x c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op9_sql() -> str:
    rows = ", ".join(f"('{name}', '{' '.join(license_scan.words_of(text))}')" for name, text in sorted(license_scan.TEMPLATES.items()))
    grams = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' #'] ELSE [] END"
    return f"""
WITH t AS (SELECT license, string_split(words, ' ') AS w FROM (VALUES {rows}) v(license, words)),
h AS (SELECT license, list_distinct({grams}) AS h FROM t),
d AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT doc_id, {grams} AS g FROM d),
m AS (SELECT doc_id, license, len(h)::BIGINT AS n_shingles, len(list_intersect(h, g))::BIGINT AS n_found FROM g CROSS JOIN h)
SELECT doc_id, license, n_shingles, n_found FROM m WHERE 100 * n_found >= 80 * n_shingles
"""


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' #'] ELSE [] END) AS h
  FROM d),
n AS (SELECT doc_id, len(h)::BIGINT AS n FROM g),
s AS (SELECT doc_id, hash(unnest(h)) AS t FROM g),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
  FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY ALL),
l AS (
  SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
  WHERE 180 * n_both >= 80 * (x.n + y.n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  SELECT doc_id, doc_id AS comp FROM n
  UNION
  SELECT e.b, r.comp FROM r JOIN e ON e.a = r.doc_id WHERE r.comp < e.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.comp) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""

# The remainder of a conv_id's CRC-32 (of its decimal digits) is worked out bit by bit.
OP12_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY conv_id),
h AS (
  SELECT *, conv_id - conv_id % 5 AS first_id,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
             lambda a, x: CASE WHEN xor(a, x) % 2 = 1 THEN xor(xor(a, x) // 2, 3988292384::BIGINT) ELSE xor(a, x) // 2 END), 4294967295::BIGINT) % 9 AS h
  FROM c),
r AS (SELECT a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS path FROM h a LEFT JOIN c b ON b.conv_id = a.first_id),
p AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM r),
m AS (SELECT conv_id, depth, path[1:depth] AS node, depth = len(path) AS ended FROM p),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(node[depth].text) END AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM m GROUP BY node, depth),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
u AS (SELECT node[1:d] AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS d FROM l) GROUP BY ALL)
SELECT l.conv_id, l.depth, q.conv_id AS parent_conv_id, l.n_convs, l.n_children, u.n_leaves, u.saved_tokens, l.ends_sha256
FROM l JOIN u USING (node) LEFT JOIN n q ON l.depth > 0 AND q.node = l.node[1:l.depth - 1]
"""

OP13_SQL = """
WITH x AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         list_sum(list_transform(range(1, least(len(a.v), len(c.v)) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
  FROM x a JOIN x c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY rank <= 3
"""

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL,
    "op5_maxscore": OP5_SQL,
    "op9_license_scan": _op9_sql(),
    "op10_jaccard_join": OP10_SQL,
    "op12_trie": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
