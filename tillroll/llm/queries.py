"""The registered queries of this subpackage: each applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import bpe, jaccard, language, leaks, licenses, manifest, oracles, pages, passages, pii, quality, resample, simhash, toxicity
from tillroll.llm.workers import find_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.merkle_manifest(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_rules,
        op2_language_id,
        op3_main_text,
        op4_repeated_passages,
        op5_decontaminate,
        op6_jaccard_join,
        op7_license_scan,
        op8_bpe,
        op9_toxicity,
        op10_personal_data,
        op11_simhash,
        op12_merkle_manifest,
        op13_importance_resampling,
    )
    return {f.__name__: f for f in found}


_JACCARD_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE
      WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1),
                                           lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM worded),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM shingle x JOIN shingle y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM met JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
  WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN reach ON reach.a = d.doc_id
GROUP BY d.doc_id, size.n
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the whole result; the others are tested by brute force."""
    return {
        "op6_jaccard_join": _JACCARD_SQL,
        "op12_merkle_manifest": oracles.MERKLE,
        "op13_importance_resampling": oracles.RESAMPLE,
    }
