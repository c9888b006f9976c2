"""A corpus made ready for training: five stages over ``documents``, each working on all that the one before kept.

1. Language: texts of no learned language go.
2. Near-duplicates (five words, similarity 0.8): the document of the smallest id of each group stays.
3. Benchmark decontamination: documents that contain a test item go.
4. Personal data: spans are replaced by the name of their kind, and ``n_chars`` is set anew.
5. Packing: a row per piece with its place in a sequence of at most 2048 tokens.

All stages but the last return the columns of ``documents``. The result is not SQL's to express; tests hold every
stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievra.llm import decontamination, language_id, near_dedup, packing, pii
from sievra.llm.queries import prepare, tokenizer_path
from sievra.session import settle

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dedup.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.without_personal_data(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
