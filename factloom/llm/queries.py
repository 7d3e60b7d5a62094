"""The operators over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import language_id, toxicity
from factloom.llm.common import table
from factloom.llm.exact_dedup import exact_duplicates
from factloom.llm.hard_negatives import hard_negatives
from factloom.llm.jaccard_join import jaccard_join
from factloom.llm.line_dedup import dedup_lines
from factloom.llm.mixing import mix
from factloom.llm.neighbours import nearest
from factloom.llm.packing import pack, pieces
from factloom.llm.prefix_trie import conversation_trie
from factloom.llm.secrets import secrets
from factloom.llm.suffix_dedup import dedup_passages
from factloom.llm.token_counts import token_counts

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        LLM_QUERIES[fn.__name__] = fn
        if sql is not None:
            LLM_ORACLE[fn.__name__] = sql
        return fn

    return add


@query()
def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), width=2)


@query()
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query()
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query(
    r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         CAST([1.0, 2.0, 3.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
         CAST([-0.5, 0.0, 0.5][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS a
  FROM docs GROUP BY source),
level AS (
  SELECT 0 AS i, (SELECT CAST(sum(s) AS DOUBLE) / sum(w) FROM src) AS l
  UNION ALL
  SELECT i + 1, (SELECT CAST(sum(s) - coalesce(sum(3 * s) FILTER (3 * s < l * w), 0) AS DOUBLE)
                        / sum(w) FILTER (NOT (3 * s < l * w)) FROM src)
  FROM level WHERE i < 64),
aims AS (
  SELECT source, s, a, least(CAST(3 * s AS DOUBLE), w * (SELECT l FROM level WHERE i = 64)) AS target FROM src),
placed AS (
  SELECT doc_id, source, size, CAST(coalesce(sum(size) OVER (
           PARTITION BY source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM docs),
full_rows AS (
  SELECT p.*, s, target, a, CAST(floor(target + 0.5) AS BIGINT) AS quota
  FROM placed p JOIN aims m ON p.source IS NOT DISTINCT FROM m.source),
taken_rows AS (
  SELECT *, CAST((quota // greatest(s, 1)) * size + greatest(0, least(size, quota % greatest(s, 1) - before)) AS BIGINT) AS taken,
         CAST(before AS DOUBLE) / greatest(quota, 1) AS u
  FROM full_rows)
SELECT doc_id, size, s AS source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN a = 0 THEN u
            ELSE (sqrt((1.0 - a) * (1.0 - a) + 4.0 * a * u) - (1.0 - a)) / (2.0 * a) END END AS position
FROM taken_rows"""
)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    columns = ("doc_id", "size", "source_size", "target", "taken", "position")
    return mixed.select(*columns).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.remainder("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held).select("text", "lang"))
    found = language_id.identify(docs.withColumn("held_out", held), model, "doc_id", "text", "held_out")
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query()
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = table(spark, sf_dir, "labels").where(language_id.remainder("doc_id", 5) != 0)
    scored = toxicity.toxicity(docs, toxicity.fit(docs, learned))
    held = language_id.remainder("doc_id", 5) == 0
    return scored.select("doc_id", held.alias("held_out"), F.col("score"), "predicted")


@query(
    r"""
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
liked AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM liked p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query(
    r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(coalesce(role, '')), encode(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)), lambda k, i: xor(k >> 1, 3988292384::BIGINT * (k & 1))))) % 6 AS h
  FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND pos < h
  UNION ALL
  SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos >= h),
placed AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, list(md5(role) || md5(text)) OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
keyed AS (
  SELECT conv_id, depth, chars, md5(array_to_string(path, '')) AS node, md5(array_to_string(path[:-2], '')) AS parent FROM placed
  UNION ALL SELECT conv_id, 0, 0, md5(''), NULL FROM convs),
nodes AS (
  SELECT node, min(conv_id) AS conv_id, max(depth) AS depth, max(chars) AS chars, max(parent) AS parent, count(*) AS n_convs
  FROM keyed GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent),
below AS (
  SELECT k.node, sum(CASE WHEN c.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM nodes n JOIN keyed k ON k.conv_id = n.conv_id AND k.depth <= n.depth LEFT JOIN children c ON c.node = n.node
  GROUP BY k.node),
ends AS (
  SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM keyed GROUP BY conv_id) GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN below USING (node) LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.node = n.node
LEFT JOIN ends e ON e.node = n.node"""
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    return conversation_trie(table(spark, sf_dir, "conversations"), conv - conv % 100, head, most=5)


@query()
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents"))
