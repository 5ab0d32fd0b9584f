"""Contract queries over the corpus operators, one per operator, and their SQL.

Each takes (spark, sf_dir), applies its operator with production parameters to the
whole `documents` (op13: `embeddings`) table and returns the full result.  For null ids and texts, empty and
very long texts, ties, repeated rows, empty tables and extra columns the results are
those that the operator's docstring defines; extra columns of `documents` never reach a
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossmill.llm import byte_bpe, exact_dedup, filter_audit, hard_negatives, language_id, mixing, packing, quality_cnn, quality_rules, secret_scan, sharding, simhash, token_files
from glossmill.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the forest's verdict for every row; null and empty texts fail the base rules."""
    measured = quality_rules.measure(table(spark, sf_dir, "documents"))
    return quality_rules.judge_measured(measured, quality_rules.fit_measured(measured, table(spark, sf_dir, "labels")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids as read back from the token files; null ids first, null texts their end id alone."""
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed and learned spans of every row; null and empty texts have none."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every row's ids and decoded bytes; null and empty texts have no ids."""
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row, repeated ones too; texts without words have fingerprint zero."""
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for every row, null and empty texts included."""
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.classify(docs, quality_cnn.fit(docs, table(spark, sf_dir, "labels")))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken for every row; null sources are one source, null texts size 0."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every row; `und` for null texts and those without a letter."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who stays for every row, dropped ones too; null texts equal empty ones."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row by the law `bytes`; null texts have size 1."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every filter of every order removes, by language; a null language is the empty string's part."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's sequence and place; null and empty texts are their end id alone."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; rows without a label or a finite vector take no part."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality_rules, op2_token_files, op3_secret_scan, op4_byte_bpe, op5_simhash,
        op6_quality_cnn, op7_mix_sources, op8_language_id, op9_exact_dedup, op10_shard_documents,
        op11_filter_audit, op12_pack_documents, op13_hard_negatives,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators whose whole result SQL can state."""
    return {"op9_exact_dedup": OP9_SQL, "op11_filter_audit": OP11_SQL, "op13_hard_negatives": OP13_SQL}


OP9_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id,
             max(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS keep_id,
             count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) AS group_size,
             sha256(coalesce(text, '')) AS text_sha256
      FROM documents)
"""

#: Orders by recursion; a document's failures as a string of letters, and steps looked up in the order's string.
OP11_SQL = r"""
WITH RECURSIVE orders AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(filter_order, f)),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders WHERE length(filter_order) = 5),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS words FROM documents),
judged AS (
  SELECT doc_id, part,
         (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS failed
  FROM texts),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, failed, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM judged LEFT JOIN marks USING (doc_id) GROUP BY ALL),
walked AS (
  SELECT c.*, filter_order, step, filter_order[step] AS letter, contains(failed, filter_order[step]) AS fails,
         translate(filter_order[1:step - 1], failed, '') <> filter_order[1:step - 1] AS gone
  FROM cells c, steps),
counted AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = letter), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM walked GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, letter AS "filter", kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""

OP13_SQL = """
WITH v AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
