"""What happens to hits: merging by document, and joining ids, URLs, titles and texts to them.

Hits are few (``k`` per query) next to the tables they are joined to. They are counted, and as long as
they fit they go to the big table's tasks; the big table is then filtered where it lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievra.functions.text import ARTICLE_DOMAIN, text_or_default, title_from_url
from sievra.operators.lexical import top_k
from sievra.operators.sampling import MAPPING_BUCKET
from sievra.session import broadcast_if_fits, fits, settle

# What stands in for a missing title.
TITLE_NOT_FOUND = "Not found"
UNKNOWN_PREFIX = "Unknown_"


def group_hits(hits: DataFrame) -> DataFrame:
    """``(query_id, doc_id, hits ARRAY<STRUCT<rank, score>>)`` in rank order.

    A group is the hits of one query on one document, at most ``k``.
    """
    return hits.groupBy("query_id", "doc_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("hits")
    )


def best_doc_hits(hits: DataFrame, metric: str = "l2", k: int | None = None) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the best hit of each document, ranked again.

    The best is the smallest distance or the largest product; ties go to the lower id.
    """
    distance = metric == "l2"
    best = F.min("score") if distance else F.max("score")
    docs = hits.groupBy("query_id", "doc_id").agg(best.alias("score"))
    ranked = top_k(docs, k, "score", descending=not distance)
    return ranked.select("query_id", "rank", "doc_id", "score")


def _matching(big: DataFrame, hits: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``big`` that a hit refers to."""
    wanted = settle(hits.select(*keys).distinct(), "wanted")
    return big.join(broadcast_if_fits(wanted), list(keys), "left_semi")


def _left(hits: DataFrame, big: DataFrame, *keys: str) -> DataFrame:
    """``hits`` with the columns of ``big``; hits without a key match nothing and are not dealt by it.

    The hits are written once, as they are read for their keys and for the join.
    """
    hits = settle(hits, "hits")
    keyed = F.lit(True)
    for key in keys:
        keyed &= F.col(key).isNotNull()
    known = hits.where(keyed)
    wanted = known.select(*keys).distinct()
    if fits(wanted):
        # What few hits match is few as well, since the keys of the big table are unique.
        big = big.join(F.broadcast(wanted), list(keys), "left_semi")
    return known.join(big, list(keys), "left").unionByName(hits.where(~keyed), allowMissingColumns=True)


def attach_page_text(
    df: DataFrame, pages: DataFrame, url_col: str = "url", domain: str = ARTICLE_DOMAIN, text_col: str = "text"
) -> DataFrame:
    """Add the text of the page that ``url_col`` points to, from ``pages(title, extract)``.

    The default sentence stands in when the URL has no title, the page is not there or has no extract.
    """
    titled = df.withColumn("title", title_from_url(F.col(url_col), domain))
    joined = _left(titled, pages.select("title", "extract"), "title")
    return joined.withColumn(text_col, text_or_default(F.col("extract"))).drop("title", "extract")


def lookup_urls(hits: DataFrame, id_url: DataFrame) -> DataFrame:
    """Add ``url`` of ``id_url(doc_id, url)``; null where it is missing."""
    return _left(hits, id_url.select("doc_id", "url"), "doc_id")


def lookup_doc_ids(hits: DataFrame, id_map: DataFrame) -> DataFrame:
    """Add ``doc_id`` of ``id_map(bucket, pos, doc_id)``, or ``Unknown_<pos>``.

    The bucket follows from the position, so a table stored by bucket is read only in part.
    """
    keyed = hits.withColumn("bucket", F.floor(F.col("pos") / MAPPING_BUCKET).cast("int"))
    found = _left(keyed, id_map.select("bucket", "pos", "doc_id"), "bucket", "pos").drop("bucket")
    unknown = F.concat(F.lit(UNKNOWN_PREFIX), F.col("pos").cast("string"))
    return found.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), unknown))


def hit_texts(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of every document that was hit, once, in the order of the corpus (by id)."""
    return _matching(articles.select("doc_id", "text"), hits, "doc_id").orderBy("doc_id")


def hydrate_hits(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """``(query_id, rank, doc_id, score, title)``; scores to four decimals, ``Not found`` without title."""
    titled = _left(hits, articles.select("doc_id", "title"), "doc_id")
    return titled.select(
        "query_id",
        "rank",
        "doc_id",
        F.round("score", 4).alias("score"),
        F.coalesce("title", F.lit(TITLE_NOT_FOUND)).alias("title"),
    )
