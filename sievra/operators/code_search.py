"""Search of inverted lists by tables of code distances, with an exact ranking where the lists are read.

The squared distance of a query to what a code stands for is a sum over sub-vectors. What depends on the query, its
products with all code centres, is a table per query; what depends on the row and its list is a number per row. So a row
costs one table entry per sub-vector and query, and no vector is decoded. The best ``share`` of the rows of a batch are
ranked by the exact vectors that the list holds beside the codes: nothing is joined, and of a task's rows at most ``k``
per query leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sievra.operators.lexical import top_k
from sievra.operators.neighbours import MAX_CELLS, RunningBest, _output_schema, add_best, matrix
from sievra.session import scratch_path, settle

SHARE = 0.15
# Numbers of the queries of one block, their tables of code products included (doubles: 128 MB).
MAX_TABLE_NUMBERS = 1 << 24


def query_tables(turned: np.ndarray, books: np.ndarray) -> np.ndarray:
    """``(query, sub, code)``: minus twice the product of each part of a query with each code centre."""
    m, codes, width = books.shape
    parts = turned.reshape(len(turned), m, width)
    return -2.0 * np.einsum("qmw,mcw->qmc", parts, books, optimize=True)


def row_numbers(codes: np.ndarray, centers: np.ndarray | None, books: np.ndarray) -> np.ndarray:
    """Per row the squared length of what its code stands for, less that of its list's centre."""
    m, _, width = books.shape
    own = (books * books).sum(axis=2)
    total = np.zeros(len(codes))
    for j in range(m):
        total += own[j, codes[:, j]]
        if centers is not None:
            total += 2.0 * (centers[:, j * width : (j + 1) * width] * books[j, codes[:, j]]).sum(axis=1)
    return total


def rough_costs(tables: np.ndarray, turned: np.ndarray, codes: np.ndarray, rest: np.ndarray, centers: np.ndarray | None) -> np.ndarray:
    """``(query, row)``: squared distances to what the codes stand for, less the query's own squared length."""
    out = np.broadcast_to(rest, (len(tables), len(codes))).copy()
    for j in range(codes.shape[1]):
        out += tables[:, j, codes[:, j]]
    if centers is not None:
        out += (centers * centers).sum(axis=1)[None, :] - 2.0 * turned @ centers.T
    return out


def _scan(sent, ids: list[str], k: int, share: float):
    """A task's search; ``sent``: a broadcast dictionary with queries, their lists, code books and list centres."""

    def search(batches):
        a = sent.value
        asked, turned, books = a["asked"], a["turned"], a["books"]
        tables = query_tables(turned, books)
        best = RunningBest(len(asked), k, ids)
        probed = np.zeros((len(asked), len(a["list_ids"])), bool)
        probed[a["query"], a["place"]] = True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            codes, rows = matrix(table["codes"]).astype(np.int64), matrix(table["embedding"])
            place = np.searchsorted(a["list_ids"], table["list_id"].to_numpy())
            centers = a["centers"][place] if a["residual"] else None
            rest = row_numbers(codes, centers, books)
            step = max(1, MAX_CELLS // len(rows))
            # A batch has few of the lists, which few queries ask for.
            asking = np.flatnonzero(probed[:, np.unique(place)].any(axis=1))
            for at in range(0, len(asking), step):
                some = asking[at : at + step]
                rough = rough_costs(tables[some], turned[some], codes, rest, centers)
                rough[~probed[np.ix_(some, place)]] = np.inf
                n = min(len(rows), max(k, int(np.ceil(share * len(rows)))))
                near = np.zeros(rough.shape, bool)
                np.put_along_axis(near, np.argpartition(rough, n - 1, axis=1)[:, :n], True, axis=1)
                near &= np.isfinite(rough)
                add_best(best, asked[some], rows, near, table, some, "l2")
        yield from best.hits(a["query_ids"], "l2")

    return search


def search_codes(
    queries: DataFrame, lists: DataFrame, ids: list[str], k: int, books: np.ndarray, list_ids: np.ndarray, centers: np.ndarray,
    residual: bool, share: float = SHARE, max_query_numbers: int = MAX_TABLE_NUMBERS,
) -> DataFrame:
    """``(query_id, rank, *ids, score)`` for ``queries(query_id, embedding, turned, lists)`` over ``lists(list_id, *ids, codes,
    embedding)``; ``turned`` is the query as the codes were trained.

    Queries are sent to the tasks in blocks whose numbers, tables included, are bounded; only their lists are read.
    """
    spark = queries.sparkSession
    schema = _output_schema(lists, ids, queries.schema["query_id"])
    numbers = 2 * books.shape[0] * books.shape[2] + books.shape[0] * books.shape[1]
    queries = settle(queries.select("query_id", "embedding", "turned", F.array_distinct("lists").alias("lists")), "queries")
    n = queries.count()
    blocks = max(1, -(-n * numbers // max_query_numbers))
    path = scratch_path(spark, "code-hits")
    spark.createDataFrame([], schema).write.parquet(path)
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        _search_block(spark, mine, lists, ids, k, books, list_ids, centers, residual, share, schema).write.mode("append").parquet(path)
    hits = top_k(spark.read.schema(schema).parquet(path), k, "score", descending=False, tie_cols=tuple(ids))
    return hits.select("query_id", "rank", *ids, "score")


def _search_block(spark, queries, lists, ids, k, books, list_ids, centers, residual, share, schema) -> DataFrame:
    table = queries.toArrow()
    wanted = table["lists"].combine_chunks()
    flat = wanted.flatten().to_numpy(zero_copy_only=False)
    width = books.shape[0] * books.shape[2]
    sent = spark.sparkContext.broadcast({
        "query_ids": table["query_id"].combine_chunks(),
        "asked": matrix(table["embedding"]) if table.num_rows else np.zeros((0, width)),
        "turned": matrix(table["turned"]) if table.num_rows else np.zeros((0, width)),
        "query": np.repeat(np.arange(table.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False)),
        "place": np.searchsorted(list_ids, flat), "list_ids": list_ids, "centers": centers, "books": books, "residual": residual,
    })
    # Literal list numbers prune the folders of a stored index.
    some = lists.where(F.col("list_id").isin([int(x) for x in np.unique(flat)])).select("list_id", *ids, "codes", "embedding")
    return some.mapInArrow(_scan(sent, ids, k, share), schema)
