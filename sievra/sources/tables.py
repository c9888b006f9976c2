"""Readers and writers of articles, tokens, questions, answers and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

ARTICLE_SCHEMA = "id STRING, url STRING, title STRING, text STRING"
QUESTION_SCHEMA = "question_text STRING, document_url STRING"
ANSWER_SCHEMA = "answer STRING, text STRING"
# A task's table of words, with their sorted copy, takes about 40 times the bytes of the text.
TEXT_PER_PARTITION = 8 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition a scan by its ids if it has fewer partitions than there are cores, for work that needs no partitioning.

    A small table is often one file with one row group, which a scan cannot split, so that all text work on it
    would run in one task. Results do not depend on it, and nothing may rely on the partitioning.
    """
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(*keys) if few else df


def text_partitions(df: DataFrame, text_col: str = "text") -> int:
    """In how many partitions a table goes whose texts are taken apart in words: one for ``TEXT_PER_PARTITION`` bytes, and
    at least as many as shuffle partitions. A task then holds the words of so much text, however large the table is."""
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TEXT_PER_PARTITION))


def read_articles(spark: SparkSession, path: str, schema: str | StructType | None = ARTICLE_SCHEMA) -> DataFrame:
    """Article corpus from Parquet. The schema is stated, so no file is opened to find it out."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_tokens(
    spark: SparkSession,
    path: str,
    columns: tuple[str, ...] = ("doc_id", "tokens"),
    skip_corrupt: bool = False,
    schema: str | StructType | None = None,
) -> DataFrame:
    """Processed corpus, only the columns asked for; ``skip_corrupt`` goes on past unreadable files.

    With a ``schema`` no file is opened to find it out, which might be an unreadable one.
    """
    reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
    reader = reader if schema is None else reader.schema(schema)
    return reader.parquet(path).select(*columns)


def write_tokens(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Processed corpus to Parquet, one file or more per task."""
    df.write.mode(mode).parquet(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``(question, url, position)`` from JSON lines.

    ``position`` is a struct that sorts as the lines stand in the files: file, block of the file, line
    within the scan of the block.
    """
    rows = spark.read.schema(QUESTION_SCHEMA).json(path)
    return rows.select(
        F.col("question_text").alias("question"),
        F.col("document_url").alias("url"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("position"),
    )


def read_answers(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``(answer, text)`` and the partition columns, if any, from CSV with a header.

    Quoted fields may hold line breaks, for which a file is read by one task; ``multi_line=False`` reads files without such
    fields in splits. An empty field is a missing value.
    """
    return (
        spark.read.schema(ANSWER_SCHEMA)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )


def _one_line(c: Column) -> Column:
    """``c`` without line breaks; :func:`_as_written` undoes it. The percent sign goes first, so what it marks is plain."""
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("\r"), F.lit("%0D"))


def _as_written(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))


def read_runs(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """``(question_id, answer, text, model, mode)`` as :func:`write_answers` stored them, with the same ``one_line``."""
    rows = (
        spark.read.schema("question_id BIGINT, answer STRING, text STRING, model STRING, mode STRING")
        .option("header", True)
        .option("multiLine", not one_line)
        .option("escape", '"')
        .csv(path)
    )
    return rows.withColumns({c: _as_written(F.col(c)) for c in ("answer", "text")}) if one_line else rows


def write_answers(df: DataFrame, path: str, mode: str = "errorifexists", one_line: bool = False) -> None:
    """Answers of all runs as CSV, one folder per model and mode.

    With ``one_line``, line breaks and percent signs of answers and texts are written as ``%0A``, ``%0D`` and ``%25``, so a
    row is a line and long files are read in splits.
    """
    if one_line:
        df = df.withColumns({c: _one_line(F.col(c)) for c in ("answer", "text")})
    df.write.mode(mode).partitionBy("model", "mode").option("header", True).option("escape", '"').csv(path)


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; built and saved there first unless a finished write left its mark.

    What an aborted build left behind is overwritten.
    """
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has finished, by the mark that Spark's writers leave last."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def write_vectors(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Embedded corpus to Parquet."""
    df.write.mode(mode).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Embedded corpus from Parquet."""
    return spark.read.parquet(path)
