"""The registered query of each operator, and the SQL it is checked with where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievra.llm import chat_format, decontamination, fingerprints, hard_negatives, language_id, licenses, merkle, near_dedup, packing, pii
from sievra.llm import simhash, sql, token_counts, toxicity
from sievra.session import ship_package

ROWS_PER_BATCH = 1000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package, and exchange fewer rows with Python at once than Spark's default of 10,000.

    Rows here are whole texts, so that the default means tens of megabytes in either direction for every task.
    A setting other than the default is left as it is.
    """
    ship_package(spark)
    if spark.conf.get(_SETTING) == "10000":
        spark.conf.set(_SETTING, str(ROWS_PER_BATCH))


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def language_query(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.predict_languages(_table(spark, sf, "documents"))


def decontamination_query(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contained_items(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def licenses_query(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(_table(spark, sf, "documents"))


def toxicity_query(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def chat_query(spark: SparkSession, sf: str) -> DataFrame:
    turns = chat_format.with_marked_conversation(_table(spark, sf, "conversations"))
    return chat_format.digests(chat_format.format_conversations(turns))


def tokenizer_path(name: str) -> str:
    """A tokenizer file of the machine; the tasks open the same path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts_query(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"))


def fingerprints_query(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprints_with_neighbours(_table(spark, sf, "documents"))


def pii_query(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf, "documents"))


def near_dedup_query(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf, "documents"))


def packing_query(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


def merkle_query(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest_digests(_table(spark, sf, "documents"))


def hard_negatives_query(spark: SparkSession, sf: str) -> DataFrame:
    return hard_negatives.mined_embeddings(_table(spark, sf, "embeddings"))


def simhash_query(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf, "documents"))


REGISTRY = {
    "op1_language_id": (language_query, None),
    "op2_decontamination": (decontamination_query, sql.CONTAINED_ITEMS),
    "op3_licenses": (licenses_query, sql.licenses()),
    "op4_toxicity": (toxicity_query, None),
    "op5_chat_format": (chat_query, sql.CHAT_FORMAT),
    "op6_token_counts": (token_counts_query, None),
    "op7_fingerprints": (fingerprints_query, None),
    "op8_pii": (pii_query, None),
    "op10_packing": (packing_query, None),
    "op9_minhash_near_dedup": (near_dedup_query, sql.NEAR_DEDUP),
    "op11_merkle_manifest": (merkle_query, sql.MERKLE),
    "op12_hard_negatives": (hard_negatives_query, sql.HARD_NEGATIVES),
    "op13_simhash_near_dedup": (simhash_query, None),
}
