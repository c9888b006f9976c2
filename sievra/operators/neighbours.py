"""Top-k nearest vectors: the batch kernel and the two ways to bring vectors and queries together.

Few queries travel to every task and the vectors stay where they are. Many queries are cut in blocks,
and so are the vectors; a group is one block of each, so that no group outgrows a task. A block of vectors holds whole
lists, or a part of a large one, and a query goes once to each block that has one of its lists, not once per list. In both
ways a task keeps the best of all it has seen and hands back at most ``k`` rows per query, once; Spark ranks the rest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sievra.operators.lexical import top_k
from sievra.session import settle

METRICS = ("l2", "ip", "cosine")
TOP_K = 10

# Distances are rounded to this many decimals before ranking, so that equal vectors tie exactly.
SCORE_DIGITS = 9
# Matrix products only preselect rows; this allowance covers their rounding error for the exact pass.
SLACK = 1e-7
# Numbers of a query matrix that may go to every task, and of one block of queries or of vectors (doubles: 32 MB).
MAX_QUERY_NUMBERS = 1 << 22
BLOCK_NUMBERS = 1 << 22
# Hits that a task may hold for its queries.
MAX_HITS = 1 << 20
# Cells of one distance matrix inside a task (doubles: 32 MB).
MAX_CELLS = 1 << 22
# Cells of a distance matrix that are ranked in the time in which one pair is summed exactly, and how many pairs there are to a
# cell at most where all pairs are summed, without a matrix product.
RANKED_CELLS = 50
PAIRS_PER_CELL = 0.02
# Groups of two blocks per core, if there are enough rows.
GROUPS_PER_CORE = 4
MAX_PARTITIONS = 4096

Decode = Callable[[pa.Table], np.ndarray]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles; every vector must have the same length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def embedding_matrix(table: pa.Table) -> np.ndarray:
    return matrix(table["embedding"])


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _cost(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Smaller is better, for each (query, row) pair of two equally long matrices."""
    if metric == "l2":
        diff = queries - rows
        return (diff * diff).sum(axis=1)
    return -(queries * rows).sum(axis=1)


def rough_costs(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """``(query, row)``: what :func:`_cost` gives, by a matrix product; squared distances less the query's own squared length."""
    if metric != "l2":
        return -(queries @ rows.T)
    rough = (-2.0 * queries) @ rows.T
    rough += np.einsum("ij,ij->i", rows, rows)
    return rough


def add_best(
    best: RunningBest, queries: np.ndarray, rows: np.ndarray, near: np.ndarray, table: pa.Table, first: int | np.ndarray, metric: str
) -> None:
    """Rank the rows ``near`` marks for each query by their exact costs; ``queries`` are those of ``best`` from ``first`` on, or of
    the numbers ``first``.

    The matrix product tells which of them may be among the best ``k``; only these are summed exactly and held.
    """
    own = first + np.arange(len(queries)) if np.isscalar(first) else first
    if np.count_nonzero(near) <= PAIRS_PER_CELL * near.size:
        q, r = np.nonzero(near)
        cost = _exact(queries, rows, q, r, metric)
        good = cost <= best.bound[own[q]]
        best.add(own[q][good], table, r[good], cost[good])
        return
    rough = rough_costs(queries, rows, metric)
    square = np.einsum("ij,ij->i", queries, queries) if metric == "l2" else np.zeros(len(queries))
    slack = SLACK * (1.0 + square + max(rough.max(initial=0.0), -rough.min(initial=0.0)))
    np.copyto(rough, np.inf, where=~near)
    limit = best.bound[own] - square
    if len(rows) > best.k:
        open_ = np.flatnonzero(np.isinf(limit))
        limit[open_] = np.partition(rough[open_], best.k - 1, axis=1)[:, best.k - 1]
    q, r = np.nonzero((rough <= (limit + slack)[:, None]) & near)
    cost = _exact(queries, rows, q, r, metric)
    good = cost <= best.bound[own[q]]
    best.add(own[q][good], table, r[good], cost[good])


def _exact(queries, rows, q, r, metric) -> np.ndarray:
    # Many equal vectors can all tie at the k-th place, so the candidates are taken in portions.
    cost = np.empty(len(q))
    portion = max(1, MAX_CELLS // max(1, rows.shape[1]))
    for at in range(0, len(q), portion):
        part = slice(at, at + portion)
        cost[part] = _cost(queries[q[part]], rows[r[part]], metric)
    return np.round(cost, SCORE_DIGITS)


def _nearest(
    queries: np.ndarray, rows: np.ndarray, id_rank: np.ndarray, k: int, metric: str, bound: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, row number and cost of the best ``k`` rows per query.

    ``bound`` holds a cost per query that the ``k``-th best is known not to exceed. ``id_rank`` breaks ties.
    """
    picked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, MAX_CELLS // max(1, len(rows)))
    longest = np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0.0))
    # So many rows, taken evenly, tell a limit that the k-th best does not exceed and not many rows reach.
    apart = max(1, len(rows) // max(k, math.isqrt(RANKED_CELLS * k * len(rows)))) if len(rows) else 1
    for at in range(0, len(queries), step):
        block = queries[at : at + step]
        rough = rough_costs(block, rows, metric)
        own = np.einsum("ij,ij->i", block, block)
        slack = SLACK * (1.0 + (np.sqrt(own) + longest) ** 2)
        limit = bound[at : at + step] - (own if metric == "l2" else 0.0)
        # A query that has found k rows before has a limit already.
        open_ = np.flatnonzero(np.isinf(limit)) if len(rows) > k else np.zeros(0, np.int64)
        if len(open_):
            limit[open_] = np.partition(rough[open_, ::apart], k - 1, axis=1)[:, k - 1] + slack[open_]
        q, r = np.nonzero(rough <= (limit + slack)[:, None])
        cost = _exact(block, rows, q, r, metric)
        # Copies that tie go at once, so at most k rows a query wait for the other queries.
        order = np.lexsort((id_rank[r], cost, q))
        q, r, cost = q[order], r[order], cost[order]
        best = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
        picked.append((q[best] + at, r[best], cost[best]))
    return tuple(np.concatenate(part) for part in zip(*picked))


def _ranks(table: pa.Table, ids: list[str]) -> np.ndarray:
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ids]).to_numpy()
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.arange(len(order))
    return ranks


def _score(cost: np.ndarray, metric: str) -> np.ndarray:
    return (cost if metric == "l2" else -cost) + 0.0


def pair_scores(metric: str):
    """Scores of two columns of vectors, row by row, as exact search gives them."""

    @F.arrow_udf("double")
    def run(queries: pa.Array, rows: pa.Array) -> pa.Array:
        if not len(rows):
            return pa.array([], pa.float64())
        asked, found = matrix(queries), matrix(rows)
        if metric == "cosine":
            asked, found = _unit(asked), _unit(found)
        return pa.array(_score(np.round(_cost(asked, found, metric), SCORE_DIGITS), metric))

    return run


def _output_schema(vectors: DataFrame, ids: list[str], query_id_field: StructField) -> StructType:
    fields = [StructField("query_id", query_id_field.dataType)]
    fields += [StructField(c, vectors.schema[c].dataType) for c in ids]
    return StructType([*fields, StructField("score", DoubleType())])


def _scan(
    query_ids: pa.Array,
    query_matrix: np.ndarray,
    probes: dict[int, np.ndarray] | None,
    ids: list[str],
    k: int,
    metric: str,
    decode: Decode,
):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = RunningBest(len(query_matrix), k, ids)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if table.num_rows == 0:
                continue
            rows = decode(table)
            rows = _unit(rows) if metric == "cosine" else rows
            ranks = _ranks(table, ids)
            for wanted, subset in _by_list(table, probes, len(query_matrix)):
                limit = best.bound[wanted]
                q, r, cost = _nearest(query_matrix[wanted], rows[subset], ranks[subset], k, metric, limit)
                best.add(wanted[q], table, subset[r], cost)
        yield from best.hits(query_ids, metric)

    return search


class RunningBest:
    """The best ``k`` rows of each query over all batches of a task: lower costs first, then lower ids.

    ``bound``: the cost of a query's ``k``-th best so far, infinite while it has fewer.
    """

    # Rows that may wait until the next sort, besides the best.
    WAITING = 1 << 18

    def __init__(self, queries: int, k: int, ids: list[str]):
        self.k, self.ids = k, ids
        self.bound = np.full(queries, np.inf)
        self.kept: pa.Table | None = None
        self.new: list[pa.Table] = []

    def add(self, q: np.ndarray, table: pa.Table, r: np.ndarray, cost: np.ndarray) -> None:
        if len(q):
            named = {"__q": pa.array(q), "__cost": pa.array(cost)} | {c: table[c].take(pa.array(r)) for c in self.ids}
            self.new.append(pa.table(named))
            if sum(t.num_rows for t in self.new) > self.WAITING:
                self._sort()

    def _sort(self) -> None:
        if not self.new:
            return
        rows = pa.concat_tables([*([self.kept] if self.kept is not None else []), *self.new])
        rows = rows.sort_by([(c, "ascending") for c in ("__q", "__cost", *self.ids)])
        q = rows["__q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        self.kept, self.new = rows.filter(pa.array(place < self.k)), []
        last = place == self.k - 1
        self.bound[q[last]] = np.minimum(self.bound[q[last]], rows["__cost"].to_numpy()[last])

    def hits(self, query_ids: pa.Array, metric: str) -> Iterator[pa.RecordBatch]:
        """``(query_id, *ids, score)``, at most ``k`` rows a query."""
        self._sort()
        if self.kept is not None:
            q, cost = self.kept["__q"].to_numpy(), self.kept["__cost"].to_numpy()
            yield _hits(query_ids, q, self.kept, np.arange(len(q)), self.ids, _score(cost, metric))


    def ranked(self, query_ids: pa.Array, metric: str) -> Iterator[pa.RecordBatch]:
        """``(query_id, rank, *ids, score)``, ids that are null first among equal scores, as Spark sorts them."""
        self._sort()
        if self.kept is not None:
            keys = [(c, "ascending") for c in ("__q", "__cost", *self.ids)]
            kept = self.kept.take(pc.sort_indices(self.kept, sort_keys=keys, null_placement="at_start")).combine_chunks()
            q, cost = kept["__q"].to_numpy(), kept["__cost"].to_numpy()
            rank = np.arange(len(q)) - np.searchsorted(q, q, side="left") + 1
            hits = _hits(query_ids, q, kept, np.arange(len(q)), self.ids, _score(cost, metric))
            yield hits.add_column(1, "rank", pa.array(rank, pa.int32()))


def _by_list(table: pa.Table, probes: dict[int, np.ndarray] | None, n_queries: int):
    """(query numbers, row numbers) that are to be compared."""
    if probes is None:
        yield np.arange(n_queries), np.arange(table.num_rows)
        return
    lists = table["list_id"].to_numpy()
    order = np.argsort(lists, kind="stable")
    values, starts = np.unique(lists[order], return_index=True)
    for value, rows in zip(values, np.split(order, starts[1:])):
        wanted = probes.get(int(value))
        if wanted is not None:
            yield wanted, rows


def _hits(query_ids, q, table, r, ids, scores) -> pa.RecordBatch:
    columns = [query_ids.take(pa.array(q))]
    columns += [table[c].combine_chunks().take(pa.array(r)) for c in ids]
    return pa.RecordBatch.from_arrays([*columns, pa.array(scores)], names=["query_id", *ids, "score"])


def _pair_blocks(ids: list[str], k: int, metric: str, decode: Decode, blocks: list[np.ndarray]):
    """The search of one block of queries in one block of vectors; ``blocks`` are the lists of each block, ascending."""

    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        query_ids = queries["query_id"].combine_chunks()
        if queries.num_rows == 0 or vectors.num_rows == 0:
            empty = pa.array([], pa.int64())
            return pa.Table.from_batches([_hits(query_ids, empty, vectors, empty, ids, np.array([], np.float64))])
        best = _Block(vectors, ids, metric, decode, blocks).best(queries, k)
        hits = list(best.hits(query_ids, metric))
        return pa.Table.from_batches(hits) if hits else search(queries, vectors.slice(0, 0))

    return search


class _Block:
    """A block of vectors as it is searched by blocks of queries."""

    def __init__(self, vectors: pa.Table, ids: list[str], metric: str, decode: Decode, blocks: list[np.ndarray]):
        self.vectors, self.ids, self.metric = vectors, ids, metric
        rows = decode(vectors)
        self.rows, self.ranks = _unit(rows) if metric == "cosine" else rows, _ranks(vectors, ids)
        held = blocks[vectors["__vb"][0].as_py()]
        self.held, self.place = len(held), np.searchsorted(held, vectors["list_id"].to_numpy())

    def best(self, queries: pa.Table, k: int) -> RunningBest:
        sought = matrix(queries["__query"])
        sought = _unit(sought) if self.metric == "cosine" else sought
        best = RunningBest(len(sought), k, self.ids)
        bits = np.frombuffer(b"".join(queries["__bits"].to_pylist()), np.uint8).reshape(len(sought), -1)
        for wanted, subset in _asked_rows(bits, self.place, self.held):
            q, r, cost = _nearest(sought[wanted], self.rows[subset], self.ranks[subset], k, self.metric, best.bound[wanted])
            best.add(wanted[q], self.vectors, subset[r], cost)
        return best


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Tables of neighbouring rows that are equal in ``columns``, with their values; a run may come in several tables."""
    for batch in batches:
        if batch.num_rows:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                yield tuple(keys[:, begin].tolist()), pa.Table.from_batches([batch.slice(begin, end - begin)])


def _ranked_blocks(ids: list[str], k: int, metric: str, decode: Decode, blocks: list[np.ndarray], held_hits: int):
    """The search of queries that have all of their lists in one block of vectors, with the rank of each hit.

    Of each group the rows of the vectors come first; queries follow in portions whose hits are at most ``held_hits``.
    """
    portion = max(1, held_hits // k)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, vectors, block = None, [], None
        for (*own, is_query), table in _runs(batches, ["__vb", "__qb", "__kind"]):
            if own != group:
                group, vectors, block = own, [], None
            if not is_query:
                vectors.append(table)
            elif vectors or block:
                if block is None:
                    block, vectors = _Block(pa.concat_tables(vectors).combine_chunks(), ids, metric, decode, blocks), []
                for at in range(0, table.num_rows, portion):
                    some = table.slice(at, portion).combine_chunks()
                    yield from block.best(some, k).ranked(some["query_id"].combine_chunks(), metric)

    return search


def _asked_rows(bits: np.ndarray, place: np.ndarray, held: int):
    """(query numbers, row numbers) that are to be compared; a bit says that a query asks for the list of that place.

    Queries that ask for all lists of the block are compared with all its rows at once.
    """
    whole = (bits == np.packbits(np.ones(held, bool))).all(axis=1)
    if whole.any():
        yield np.flatnonzero(whole), np.arange(len(place))
    if whole.all():
        return
    order = np.argsort(place, kind="stable")
    values, starts = np.unique(place[order], return_index=True)
    for value, subset in zip(values, np.split(order, starts[1:])):
        wanted = np.flatnonzero(~whole & ((bits[:, value >> 3] >> (7 - (value & 7))) & 1).astype(bool))
        if len(wanted):
            yield wanted, subset


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    ids: list[str],
    k: int,
    metric: str,
    decode: Decode = embedding_matrix,
    payload: str = "embedding",
    max_query_numbers: int = MAX_QUERY_NUMBERS,
    block_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """``(query_id, rank, *ids, score)``: the best ``k`` of ``vectors(*ids, payload)`` per query.

    ``queries(query_id, embedding)``; with ``lists ARRAY<INT>`` a query is compared with the vectors
    of those ``list_id`` only.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    by_list = "lists" in queries.columns
    schema = _output_schema(vectors, ids, queries.schema["query_id"])
    carried = [*ids, payload, *(["list_id"] if by_list else [])]
    # Queries are the output of an encoder; they are written once, then counted and read from there.
    asked = [F.array_distinct("lists").alias("lists")] if by_list else []
    queries = settle(queries.select("query_id", "embedding", *asked), "queries")
    shape = queries.agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"),
        (F.max(F.size("lists")) if by_list else F.lit(0)).alias("width"),
    ).first()
    numbers = shape["n"] * (shape["dim"] + (shape["width"] or 0))
    if numbers <= max_query_numbers and shape["n"] * k <= MAX_HITS:
        scored = _search_broadcast(queries, vectors.select(*carried), ids, k, metric, decode, by_list, schema)
        ranked = None
    else:
        scored, ranked = _search_blocks(
            queries, vectors.select(*carried), ids, k, metric, decode, by_list, schema, shape["n"], shape["dim"],
            max_query_numbers, block_numbers,
        )
    hits = top_k(scored, k, "score", descending=metric != "l2", tie_cols=tuple(ids)).select("query_id", "rank", *ids, "score")
    return hits if ranked is None else hits.unionByName(ranked)


def _search_broadcast(queries, vectors, ids, k, metric, decode, by_list, schema):
    # The size was checked, so the query matrix may pass through the driver to the tasks.
    table = queries.toArrow()
    sought = matrix(table["embedding"]) if table.num_rows else np.zeros((0, 1))
    sought = _unit(sought) if metric == "cosine" else sought
    probes = None
    if by_list:
        flat = table["lists"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(table.num_rows), pc.list_value_length(table["lists"]).to_numpy())
        order = np.argsort(flat, kind="stable")
        values, starts = np.unique(flat[order], return_index=True)
        probes = dict(zip((int(v) for v in values), np.split(owner[order], starts[1:])))
        # Literal list numbers prune the folders of a table that is partitioned by list_id.
        vectors = vectors.where(F.col("list_id").isin(list(probes)))
    if table.num_rows == 0:
        vectors = vectors.limit(0)
    query_ids = table["query_id"].combine_chunks()
    return vectors.mapInArrow(_scan(query_ids, sought, probes, ids, k, metric, decode), schema)


def _cut_lists(sizes: np.ndarray, per_block: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of lists in order, the first block of each and the number of its blocks.

    Whole lists share a block as long as they fit; one that is larger than a block has several for itself, or one if it
    has at most ``most`` rows.
    """
    cuts = np.where(sizes <= (most or per_block), 1, -(-sizes // per_block))
    first, at, room = np.zeros(len(sizes), np.int64), 0, per_block
    for i, n in enumerate(sizes.tolist()):
        if n > room and room < per_block:
            at, room = at + 1, per_block
        first[i] = at
        at, room = (at, room - n) if cuts[i] == 1 else (at + int(cuts[i]), per_block)
    return first, cuts


def _to_blocks(lists: np.ndarray, blocks: list[np.ndarray]):
    """A query's row per block that has one of its lists, with a bit per list of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion = max(1, MAX_CELLS // max(1, len(lists)))
        for batch in batches:
            for at in range(0, batch.num_rows, portion):
                part = batch.slice(at, portion)
                wanted = part.column("lists")
                flat = wanted.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(wanted), 0).to_numpy(zero_copy_only=False))
                place = np.minimum(np.searchsorted(lists, flat), len(lists) - 1)
                known = lists[place] == flat
                asked = np.zeros((part.num_rows, len(lists)), bool)
                asked[owner[known], place[known]] = True
                for block, held in enumerate(blocks):
                    begin = np.searchsorted(lists, held[0])
                    some = asked[:, begin : begin + len(held)]
                    rows = np.flatnonzero(some.any(axis=1))
                    if len(rows):
                        bits = np.packbits(some[rows], axis=1)
                        columns = {c: part.column(c).take(pa.array(rows)) for c in part.schema.names if c != "lists"}
                        columns |= {"__vb": np.full(len(rows), block, np.int32), "__bits": pa.array([b.tobytes() for b in bits], pa.binary())}
                        yield pa.RecordBatch.from_pydict(columns)

    return run


def _search_blocks(
    queries, vectors, ids, k, metric, decode, by_list, schema, n, dim, max_query_numbers, block_numbers
):
    spark = queries.sparkSession
    if not by_list:
        queries, vectors = queries.withColumn("lists", F.array(F.lit(0))), vectors.withColumn("list_id", F.lit(0))
    # One row per list; the number of lists is limited.
    sizes = vectors.where(F.col("list_id").isNotNull()).groupBy("list_id").agg(F.count("*").alias("n")).toArrow().sort_by("list_id")
    lists, rows = sizes["list_id"].to_numpy(), sizes["n"].to_numpy()
    if not len(lists):
        return spark.createDataFrame([], schema), None
    even = math.ceil(math.sqrt(GROUPS_PER_CORE * spark.sparkContext.defaultParallelism))
    per_query_block = max(1, min(max_query_numbers // max(1, dim), MAX_HITS // k, -(-n // even)))
    largest = max(1, block_numbers // max(1, dim))
    per_vector_block = max(1, min(largest, -(-int(rows.sum()) // even)))
    many_hits = by_list and n * k > MAX_HITS
    first, cuts = _cut_lists(rows, per_vector_block, largest if many_hits else None)
    blocks = [lists[(first <= b) & (b < first + cuts)] for b in range(int(first[-1] + cuts[-1]))]
    deal = _to_blocks(lists, blocks)
    plan = F.broadcast(spark.createDataFrame(pa.table({"list_id": lists, "__first": first.astype(np.int32), "__cuts": cuts.astype(np.int32)})))
    placed = vectors.join(plan, "list_id").withColumn(
        "__vb", F.col("__first") + F.pmod(F.xxhash64(*ids), F.col("__cuts")).cast("int")
    ).drop("__first", "__cuts")

    ranked = None
    if many_hits:
        per_task = max(1, min(max_query_numbers // max(1, dim), -(-n // (GROUPS_PER_CORE * spark.sparkContext.defaultParallelism))))
        # A query that is found once, in one block, gets all of its hits from one task: they are not moved to be ranked.
        kind = queries.schema["query_id"].dataType.simpleString()
        copies = queries.select("query_id", "lists").mapInArrow(deal, f"query_id {kind}, __vb INT, __bits BINARY")
        once = copies.groupBy("query_id").agg(F.count("*").alias("__n")).where("__n = 1").select("query_id")
        once = settle(once.where(F.col("query_id").isNotNull()), "queries-of-one-block")
        whole = settle(queries.join(once, "query_id", "left_semi"), "queries-of-one-block")
        queries = settle(queries.join(once, "query_id", "left_anti"), "other-queries")
        asked, held, group, groups = _meet(whole, placed, ids, deal, per_task)
        rows_first = held.withColumn("__kind", F.lit(0)).unionByName(asked.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
        rows_first = rows_first.repartition(groups, *group).sortWithinPartitions(*group, "__kind")
        fields = schema.fields
        kinds = StructType([fields[0], StructField("rank", IntegerType()), *fields[1:]])
        ranked = rows_first.mapInArrow(_ranked_blocks(ids, k, metric, decode, blocks, MAX_HITS), kinds)
    asked, held, group, groups = _meet(queries, placed, ids, deal, per_query_block)
    # As many partitions as groups: their rows are few for the work on them, and must not be gathered by size.
    asked, held = (side.repartition(groups, *group) for side in (asked, held))
    scored = asked.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(_pair_blocks(ids, k, metric, decode, blocks), schema)
    return scored, ranked


def _meet(queries, placed, ids, deal, per_query_block):
    """Queries and vectors by the columns of their group, these columns, and the number of groups, as partitions."""
    kind, element = (queries.schema[c].dataType.simpleString() for c in ("query_id", "embedding"))
    copies = queries.select("query_id", "lists").mapInArrow(deal, f"query_id {kind}, __vb INT, __bits BINARY")
    # A row per block of vectors: into how many blocks the queries go that ask for one of its lists.
    parts = copies.groupBy("__vb").agg(F.ceil(F.count("*") / per_query_block).cast("int").alias("__nq")).toArrow()
    groups = max(1, min(sum(parts["__nq"].to_pylist()), MAX_PARTITIONS))
    parts = F.broadcast(queries.sparkSession.createDataFrame(parts))
    asked = queries.select("query_id", F.col("embedding").alias("__query"), "lists").mapInArrow(
        deal, f"query_id {kind}, __query {element}, __vb INT, __bits BINARY"
    )
    asked = asked.join(parts, "__vb").withColumn("__qb", F.pmod(F.xxhash64("query_id"), F.col("__nq")).cast("int")).drop("__nq")
    held = placed.join(parts, "__vb").withColumn("__qb", F.explode(F.sequence(F.lit(0), F.col("__nq") - 1))).drop("__nq")
    return asked, held, ["__vb", "__qb"], groups


def knn_exact(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = TOP_K,
    metric: str = "l2",
    ids: tuple[str, ...] = ("doc_id", "chunk_no"),
    max_query_numbers: int = MAX_QUERY_NUMBERS,
    block_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """``(query_id, rank, *ids, score)``: exact neighbours for ``queries(query_id, embedding)``.

    ``l2`` scores are squared distances, smaller is better; ``ip`` and ``cosine`` scores are products,
    larger is better. Rank 1 is the best in every metric, ties go to the lower id.
    """
    return nearest(
        queries.select("query_id", "embedding"), vectors, list(ids), k, metric,
        max_query_numbers=max_query_numbers, block_numbers=block_numbers,
    )
