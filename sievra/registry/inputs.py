"""The given tables in the roles of the library's inputs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievra.operators.analysis import clean_documents
from sievra.operators.block_search import deal_blocks
from sievra.operators.lexical import LexicalIndex, build_lexical_index
from sievra.operators.vectors import VectorIndex, assign_lists, embed_chunks, pq_encode
from sievra.session import settle
from sievra.sources.tables import spread, text_partitions

DIM = 64  # numbers in the given embeddings, also used for hashed chunk vectors
SUBVECTORS = 8
NPROBE = 3
LIMITS = {"min_df": 3, "max_df": 0.7, "max_features": 150_000}
PAGE_URL = "https://en.wikipedia.org/wiki/P"


def table(spark: SparkSession, sf: str, name: str, *keys: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, *keys) if keys else df


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents", "doc_id")


def tokens(spark, sf, partitions: int | None = None) -> DataFrame:
    """Tokens of documents that were partitioned by their id before, at any size: what follows counts by document."""
    docs = table(spark, sf, "documents")
    return clean_documents(docs.repartition(partitions or text_partitions(docs), "doc_id"))


def lexical_index(spark, sf, sample_size: int | None = None) -> LexicalIndex:
    n = text_partitions(table(spark, sf, "documents"))
    return build_lexical_index(tokens(spark, sf, n), sample_size=sample_size, colocated=True, partitions=n, **LIMITS)


def dealt_index(spark, sf) -> LexicalIndex:
    """The index of :func:`lexical_index` over documents that are dealt in whole blocks."""
    docs = table(spark, sf, "documents")
    n = text_partitions(docs)
    dealt, blocks = deal_blocks(docs, n)
    return build_lexical_index(clean_documents(dealt), sample_size=None, colocated=True, partitions=n, blocks=blocks, **LIMITS)


def search_queries(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def titled_articles(spark, sf) -> DataFrame:
    """Documents with the URL of the page of the same number as title, where there is one."""
    titles = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("title"))
    return table(spark, sf, "documents").select("doc_id", "text").join(titles, "doc_id", "left")


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings", "vec_id")


def vector_queries(spark, sf) -> DataFrame:
    return vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "embedding")


def label_means(vecs: DataFrame) -> DataFrame:
    """Fixed centres: the mean vector of each label, over all vectors."""
    means = vecs.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(
        F.avg(F.col("x").cast("double")).alias("m")
    )
    ordered = F.sort_array(F.collect_list(F.struct("d", "m")))
    centers = means.groupBy(F.col("label").alias("list_id")).agg(
        F.transform(ordered, lambda p: p["m"]).alias("center")
    )
    return settle(centers, "label-means")


def label_books(means: DataFrame) -> DataFrame:
    """Fixed codebooks: the parts of the label means."""
    width = DIM // SUBVECTORS
    return means.select(
        F.explode(F.sequence(F.lit(0), F.lit(SUBVECTORS - 1))).alias("sub"),
        F.col("list_id").alias("code"),
        "center",
    ).withColumn("center", F.slice("center", F.col("sub") * width + 1, width))


def flat_index(spark, sf) -> VectorIndex:
    vecs = vectors(spark, sf)
    centroids = label_means(vecs)
    lists = assign_lists(vecs.select("vec_id", "embedding"), centroids)
    return VectorIndex(centroids, lists, ("vec_id",), DIM, nprobe=NPROBE)


def code_index(spark, sf) -> VectorIndex:
    flat = flat_index(spark, sf)
    books = label_books(flat.centroids)
    codes = pq_encode(flat.lists, books)
    return VectorIndex(flat.centroids, codes, ("vec_id",), DIM, nprobe=NPROBE, codebooks=books)


def chunk_vectors(spark, sf) -> DataFrame:
    return embed_chunks(documents(spark, sf), dim=DIM)


def doc_labels(spark, sf) -> DataFrame:
    """Pair labels of two runs: quality supports, toxic contradicts, neither is neutral."""
    labels = table(spark, sf, "labels")
    name = (
        F.when(F.col("quality") == 1, "supports")
        .when(F.col("toxic") == 0, "neutral")
        .otherwise("contradiction")
    )
    mode = F.when(F.col("doc_id") % 2 == 0, "without_rag").otherwise("with_rag")
    return labels.select("doc_id", F.lit("m").alias("model"), mode.alias("mode"), name.alias("label"))


def all_questions(spark, sf) -> DataFrame:
    """User turns as questions; the page of three times the conversation's number as their source."""
    turns = table(spark, sf, "conversations").where(F.col("role") == "user")
    return turns.select(
        F.col("text").alias("question"),
        F.concat(F.lit(PAGE_URL), (F.col("conv_id") * 3).cast("string")).alias("url"),
        "conv_id",
        "turn",
    )


def answers(spark, sf, questions: DataFrame) -> DataFrame:
    """The assistant's reply in the turn after a question, where there is one."""
    replies = table(spark, sf, "conversations").where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return questions.join(replies, ["conv_id", "turn"]).select("question_id", "answer")


def page_texts(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(
        F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("title"), F.col("html").alias("extract")
    )


def id_url(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"),
        F.concat(F.lit(PAGE_URL), F.col("page_id").cast("string")).alias("url"),
    )


def article_urls(spark, sf) -> DataFrame:
    """Page URLs, and from them article URLs of both forms."""
    pages = table(spark, sf, "pages")
    tail = F.regexp_extract("url", r"^[a-z]+://[^/]*/(.*)$", 1)
    return pages.select(
        "page_id",
        F.explode(
            F.array(
                F.col("url"),
                F.concat(F.lit("https://en.wikipedia.org/wiki/"), tail),
                F.concat(F.lit("https://en.wikipedia.org//w/index.php?title=Page%20"), tail, F.lit("+x&oldid=1")),
                F.concat(F.lit("//de.wikipedia.org/w/?title=&oldid=1"), tail),
            )
        ).alias("url"),
    )


def dialogue_runs(spark, sf) -> DataFrame:
    """Replies as answers of two runs, judged against the document numbered as the conversation."""
    replies = table(spark, sf, "conversations", "conv_id", "turn").where(F.col("role") == "assistant")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("evidence"))
    mode = F.when(F.floor(F.col("turn") / 2) % 2 == 0, "without_rag").otherwise("with_rag")
    return replies.join(texts, "conv_id", "left").select(
        "conv_id", "turn", F.lit("m").alias("model"), mode.alias("mode"),
        F.col("text").alias("answer"), F.col("evidence").alias("text"),
    )


def overlap_scores(answer: Column, evidence: Column) -> Column:
    """Offline stand-in for an entailment model: scores from the words both texts share."""
    said, known = (F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), " ")) for c in (answer, evidence))
    shared = F.size(F.array_intersect(said, known))
    return F.array(*[n.cast("double") for n in (3 * shared, F.size(said), F.size(said) - shared)])


def sql_list(words) -> str:
    return "[" + ", ".join("'" + re.sub("'", "''", w) + "'" for w in words) + "]"
