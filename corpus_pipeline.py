"""The corpus pipeline: stages over the documents table, each written before the next.

language_id drops documents that no language claims; near_duplicates keeps the first
document of each group of near copies (shingles of five words, similarity 0.8);
decontaminate drops documents into which a benchmark item leaks; personal_data masks the
spans it finds; bpe encodes what is left. All but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import bpe, jaccard, language, leaks, pii
from tillroll.llm.workers import find_package
from tillroll.operators.scratch import materialize

#: Near copies in a corpus: shingles of so many words, and this similarity in per cent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
VOCABULARY = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_of_each(docs, SIMILAR_PERCENT, SHINGLE_WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The workers serve all stages.
    return bpe.bpe_digests(docs, public_tokenizers.path(VOCABULARY), keep_tables=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("bpe", encode),
]

#: The stages hold trained models and a tokenizer; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    find_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
