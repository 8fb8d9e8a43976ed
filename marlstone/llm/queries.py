"""Registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import byte_bpe, exact_dedup, language_id, license_scan, near_dup, quality_rules, rule_quality, token_mix, toxicity, warc
from marlstone.llm.shared import documents, labels


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_quality_rules that SQL can express: counts of whole texts, and the base rules."""
    counted = quality_rules.text_statistics(documents(spark, sf_dir), quality_rules.POOLED, keep=["doc_id"])
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op2_token_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_mix.mix_sources(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path(byte_bpe.RANKS), with_ids=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(documents(spark, sf_dir), with_spans=False)


def op7_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_quality.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.simhash_groups(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


BASE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT r, i, list_slice(ws, i, i + 4) AS five FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)
), p AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS times FROM w) WHERE times > 1
), c AS (
  SELECT r, CAST(sum(least(5, coalesce(next - i, 5))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM p) GROUP BY r
), l AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), s AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d JOIN l USING (r) LEFT JOIN c USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
"""


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
), g AS (
  SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY content
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.content) AS text_sha256
FROM d JOIN g ON d.content = g.content
"""


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest, payload FROM p
), g AS (
  SELECT payload, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY payload
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN g.last <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.last <> d.page_id THEN g.last END AS refers_to
FROM d LEFT JOIN g ON d.payload_bytes >= 1000 AND d.payload = g.payload
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_rules,
            op2_token_mix,
            op3_license_scan,
            op4_exact_dedup,
            op5_byte_bpe,
            op6_language_id,
            op7_rule_quality,
            op8_warc,
            op9_simhash_near_dup,
            op10_toxicity,
            quality_base_rules,
            pipeline,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"quality_base_rules": BASE_SQL, "op2_token_mix": token_mix.duckdb_sql(), "op3_license_scan": license_scan.duckdb_sql(), "op4_exact_dedup": OP4_SQL, "op8_warc": OP8_SQL}
