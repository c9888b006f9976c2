"""Lexical search over postings by term and block of documents, whose greatest weights bound the scores.

A row holds what one term has in one block: the greatest weight and the entries. The greatest weights of a query's terms
add up to a bound of the score of any document in the block. The ``k`` blocks of the highest bounds are scored first;
each has a document with a score, so the ``k``-th best of these is a score that the result cannot fall below, and only
blocks whose bound reaches it are scored after that. The hits are those of a search of all postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sievra.operators.lexical import (
    MAX_FEATURES, PUSHED_TERMS, SCORE_DIGITS, TOP_K, LexicalIndex, match_terms, pad_hits, query_weights, top_k,
)
from sievra.session import MAX_BROADCAST_ROWS, settle, unnest

DOCUMENTS_PER_BLOCK = 128
TERMS_PER_SHARD = 1000
MAX_SHARDS = 4096


@dataclass(frozen=True)
class BlockIndex:
    """``vocab`` and ``docs`` as in :class:`LexicalIndex`; ``blocks(shard, term, block, most, entries)``.

    ``entries`` are ``(doc_id, weight)``, ``most`` is their greatest weight. ``shard`` is a hash of the term, below ``shards``.
    """

    vocab: DataFrame
    blocks: DataFrame
    docs: DataFrame
    shards: int


def _shard(shards: int):
    return F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard")


def _block(n_blocks: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks))


def deal_blocks(df: DataFrame, partitions: int, docs_per_block: int = DOCUMENTS_PER_BLOCK) -> tuple[DataFrame, int]:
    """``df(doc_id, ...)`` in ``partitions`` that hold whole blocks, with ``part``, and the number of blocks.

    The postings of a block are then gathered by term where the document was counted, without a shuffle.
    """
    n_blocks = max(1, -(-df.count() // docs_per_block))
    part = F.pmod(_block(n_blocks), F.lit(partitions)).cast("int")
    return df.withColumn("part", part).repartitionById(partitions, F.col("part")), n_blocks


def build_block_index(idx: LexicalIndex, shards: int | None = None, docs_per_block: int = DOCUMENTS_PER_BLOCK) -> BlockIndex:
    """Gather the postings of ``idx`` by term and block.

    Blocks are dealt by a hash of the document, so none is much larger than ``docs_per_block`` and a group is no
    larger than a block, however frequent its term. Documents that :func:`deal_blocks` dealt have its blocks, which are gathered
    where they are.
    """
    n_blocks = idx.blocks or max(1, -(-idx.docs.count() // docs_per_block))
    shards = shards or min(MAX_SHARDS, max(8, idx.vocab.count() // TERMS_PER_SHARD))
    by = () if idx.blocks is None else ("part",)
    rows = idx.postings.select(*by, "term", _block(n_blocks).alias("block"), "doc_id", "weight")
    if idx.blocks is None and idx.partitions is not None:
        # As many partitions as the index has, since all postings are gathered again.
        rows = rows.repartition(idx.partitions, "term", "block")
    rows = rows.groupBy(*by, "term", "block").agg(
        F.max("weight").alias("most"), F.collect_list(F.struct("doc_id", "weight")).alias("entries")
    )
    return BlockIndex(idx.vocab, rows.select(_shard(shards), "term", "block", "most", "entries"), idx.docs, shards)


def _asked(weights: DataFrame, idx: BlockIndex) -> DataFrame:
    """The rows of the shards that hold a term of the batch, as literals for the scan; at most ``shards`` of them."""
    wanted = weights.select(_shard(idx.shards)).distinct().toArrow()["shard"].to_pylist()
    blocks = idx.blocks.where(F.col("shard").isin(sorted(wanted)))
    few = weights.select("term").distinct().limit(PUSHED_TERMS + 1).toArrow()["term"].to_pylist()
    return blocks.where(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else blocks


def block_bounds(weights: DataFrame, idx: BlockIndex) -> DataFrame:
    """``(query_id, block, bound)``: no document of the block scores more. Of the postings only ``most`` is read."""
    rows = _asked(weights, idx).select("term", "block", "most")
    return match_terms(weights, rows, "block").groupBy("query_id", "block").agg(
        F.sum(F.col("query_weight") * F.col("most")).alias("bound")
    )


def _score(pairs: DataFrame, weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)`` of the documents in ``pairs(query_id, block)``, a written table.

    Blocks nobody asks for are dropped before their entries are taken apart.
    """
    wanted = settle(pairs.join(weights, "query_id").select("query_id", "block", "term", "query_weight"), "wanted-blocks")
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_ROWS else wanted
    found = blocks.join(wanted, ["term", "block"])
    rows = unnest(found, F.col("entries"), "entry", keep=["query_id", "query_weight"])
    return (
        rows.groupBy("query_id", F.col("entry.doc_id").alias("doc_id"))
        .agg(F.sum(F.col("query_weight") * F.col("entry.weight")).alias("score"))
        .where(F.col("score") > 0)
        .withColumn("score", F.round("score", SCORE_DIGITS))
    )


def search_rounds(weights: DataFrame, idx: BlockIndex, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(bounds, first, rest)``: all pairs of query and block with a bound, those scored first, and the first's hits.

    ``bounds`` has ``(query_id, block, bound, rank)``; the hits are ``(query_id, doc_id, score, rank)``, the best ``k``.
    """
    bounds = settle(block_bounds(weights, idx).where(F.col("bound") > 0), "block-bounds")
    first = settle(top_k(bounds, k, "bound", tie_cols=("block",)).select("query_id", "block"), "first-blocks")
    hits = settle(top_k(_score(first, weights, _asked(weights, idx)), k), "first-hits")
    return bounds, first, hits


def blocks_left(bounds: DataFrame, first: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """``(query_id, block)``: what was not scored yet and may hold one of the best ``k``.

    Bounds are sums in another order than scores, so they may be below by what scores are rounded by.
    """
    least = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    slack = 10.0**-SCORE_DIGITS
    # A query of fewer than k hits had fewer than k blocks, and all of these are scored.
    reached = bounds.join(least, "query_id").where(F.col("bound") + F.lit(slack) >= F.col("least"))
    return reached.join(first, ["query_id", "block"], "left_anti").select("query_id", "block")


def block_search(
    queries: DataFrame, idx: BlockIndex, k: int = TOP_K, pad: bool = False, max_features: int | None = MAX_FEATURES
) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the hits of :func:`sievra.operators.lexical.lexical_search`."""
    weights = settle(query_weights(queries, idx.vocab, max_features), "query-weights")
    bounds, first, hits = search_rounds(weights, idx, k)
    left = settle(blocks_left(bounds, first, hits, k), "blocks-left")
    more = top_k(_score(left, weights, _asked(weights, idx)), k).drop("rank")
    best = top_k(hits.select("query_id", "doc_id", "score").unionByName(more), k).select("query_id", "rank", "doc_id", "score")
    return pad_hits(best, queries, idx.docs, k) if pad else best
