"""From signature bands to verified links and connected components, without pairs within a group.

Documents that share a band value meet at the smallest of them, the pivot, so a band value with ``n`` documents
gives ``n - 1`` rows however large it is. All documents that meet at one pivot are then compared on their full
sets inside tasks: first with the pivot, then those it did not take with everything else in the group, so no link
is lost between two documents that share a band. A group larger than ``block_items`` shingles is cut in blocks,
and what its blocks left apart from the pivot is compared with all the other blocks. Only links that join two
parts leave a task, hence fewer rows than documents enter it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sievra.llm.words import WHITESPACE, distinct_by_row, long_lists, pieces_of, shingle_hashes, text_buffers, word_hashes
from sievra.session import broadcast_if_fits, settle

PIECE_BYTES = 1 << 20


def row_sets(
    column: pa.Array, k: int, separators: np.ndarray = WHITESPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``k`` words of each text: ``(hashes, n_rows + 1 places)``, sorted within a row."""
    raw, offsets = text_buffers(column)
    words, starts = word_hashes(raw, offsets, separators)
    return distinct_by_row(*shingle_hashes(words, starts, k))


def set_key(hashes: np.ndarray, places: np.ndarray, multiplier: int) -> np.ndarray:
    """A 64-bit sum over each row's set; two of them with different multipliers name the set."""
    x = hashes * np.uint64(multiplier)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x ^ (x >> np.uint64(32)))])
    return (sums[places[1:]] - sums[places[:-1]]).view(np.int64)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, k: int, separators: np.ndarray = WHITESPACE) -> DataFrame:
    """``(id, items)``: the full set of every text, as 64-bit hashes."""

    def run(batches):
        for batch in batches:
            raw_ends = text_buffers(batch.column(1))[1]
            for a, b in pieces_of(raw_ends, PIECE_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), long_lists(*row_sets(part.column(1), k, separators))], ["id", "items"]
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id BIGINT, items ARRAY<BIGINT>")


def meeting_points(bands: DataFrame) -> DataFrame:
    """``(pivot, id)`` for ``bands(id, n, bands)``: documents that share a band, ``n`` items each, meet at the smallest.

    The pivot itself is not among the rows. The sums are combined in the tasks before they move, and the join is
    one that Spark may split where a value is frequent.
    """
    rows = bands.select("id", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("id").alias("pivot"), F.max("id").alias("__most"))
    shared = shared.where(F.col("pivot") < F.col("__most")).drop("__most")
    met = rows.join(shared, "band").where(F.col("id") != F.col("pivot"))
    return met.groupBy("pivot", "id").agg(F.max("n").alias("n"))


class _Parts:
    """Disjoint parts of the rows of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _similar(flat, starts, sizes, ranks, percent: int) -> Callable[[int], np.ndarray]:
    """A function from a row to the rows whose Jaccard similarity with it is at least ``percent`` / 100."""
    mark = np.zeros(ranks, bool)

    def rows_like(i: int) -> np.ndarray:
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = True
        sums = np.concatenate([[0], np.cumsum(mark[flat])])
        mark[own] = False
        shared = sums[starts[1:]] - sums[starts[:-1]]
        union = sizes + sizes[i] - shared
        return np.flatnonzero((100 * shared >= percent * union) & (union > 0))

    return rows_like


def link_rows(ids: np.ndarray, items: list[np.ndarray], ask: np.ndarray, parts_of: np.ndarray, percent: int):
    """Links that join two parts: ``(a, b)`` ids. Rows with ``ask`` are compared with all rows of other parts.

    ``ask`` gives the order of the questions (0: never asked); rows of equal ``parts_of`` start in one part.
    """
    sizes = np.array([len(x) for x in items], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    every = np.concatenate(items) if len(items) else np.zeros(0, np.int64)
    values, flat, counts = np.unique(every, return_inverse=True, return_counts=True)
    common = counts[flat] > 1  # what only one row has adds to no intersection
    starts = np.concatenate([[0], np.cumsum(common)])[starts]
    rows_like = _similar(flat[common], starts, sizes, max(1, len(values)), percent)
    parts, first = _Parts(len(ids)), {}
    for i, p in enumerate(parts_of):
        parts.join(i, first.setdefault(p, i))
    found = []
    order = [i for i in np.argsort(ask, kind="stable") if ask[i] > 0]
    for step, i in enumerate(order):
        root = parts.find(i)
        if step and ask[i] > 1 and parts.find(order[0]) == root and ask[order[0]] == 1:
            continue  # already with the pivot: whoever is not will ask for itself
        for j in rows_like(i):
            if parts.join(i, int(j)):
                found.append((ids[i], ids[j]))
    return found


def _group_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("id").to_numpy()
        lists = table.column("items").chunk(0) if table.num_rows else None
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        items = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        pairs = link_rows(ids, items, table.column("ask").to_numpy(), table.column("part").to_numpy(), percent)
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def verified_links(
    met: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, block_items: int = 1 << 18
) -> DataFrame:
    """``(a, b)``: links of Jaccard similarity of ``percent`` or more that connect what ``met(pivot, id, n)`` brought together.

    Not every similar pair is listed, but every similar pair is connected through listed ones. ``sets_of`` gives
    ``(id, items)`` for a table of ids. ``block_items``: items of one block of a group; a task holds two such blocks.
    """
    met = settle(met, "met")
    groups = met.groupBy("pivot").agg(F.sum("n").alias("items")).select(
        "pivot", F.greatest(F.ceil(F.col("items") / block_items), F.lit(1)).cast("int").alias("blocks")
    )
    groups = settle(groups, "groups")
    involved = met.select("id").union(groups.select(F.col("pivot").alias("id"))).distinct()
    sets = settle(sets_of(settle(involved, "involved")), "sets")
    block = F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int")
    members = met.join(groups, "pivot").select("pivot", block.alias("block"), "id", F.lit(2).alias("ask"))
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    pivots = groups.select("pivot", every_block, F.col("pivot").alias("id"), F.lit(1).alias("ask"))
    rows = members.unionByName(pivots).withColumn("part", F.col("id"))
    compare = _group_links(percent)
    links = rows.join(sets, "id").groupBy("pivot", "block").applyInArrow(compare, "a BIGINT, b BIGINT")
    links = settle(links, "links")
    large = groups.where("blocks > 1")
    if large.isEmpty():
        return links
    return links.unionByName(_stray_links(met.join(large, "pivot"), links, sets, compare, block_items))


def _stray_links(met: DataFrame, links: DataFrame, sets: DataFrame, compare, block_items: int) -> DataFrame:
    """Links of the large groups between a document that is still apart from its pivot and any other block."""
    parts = settle(components(links), "parts")
    part_of = parts.select(F.col("id"), F.col("component").alias("part"))
    pivot_part = parts.select(F.col("id").alias("pivot"), F.col("component").alias("pivot_part"))
    rows = met.join(part_of, "id", "left").join(pivot_part, "pivot", "left").select(
        "pivot", "id", "n", "blocks",
        F.coalesce("part", "id").alias("part"), F.coalesce("pivot_part", "pivot").alias("pivot_part"),
    )
    rows = settle(rows.withColumn("stray", F.col("part") != F.col("pivot_part")), "strays")
    asking = rows.where("stray").groupBy("pivot").agg(F.sum("n").alias("items")).select(
        "pivot", F.greatest(F.ceil(F.col("items") / block_items), F.lit(1)).cast("int").alias("asking")
    )
    rows = rows.join(asking, "pivot")
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int")
    turn = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("asking").cast("bigint")).cast("int")
    # Every (block, asking block) pair of a group is one task's work: a block of all, a block of strays.
    answer = rows.select(
        "pivot", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("turn"),
        "id", "part", F.lit(0).alias("ask"),
    )
    ask = rows.where("stray").select(
        "pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), turn.alias("turn"),
        "id", "part", F.lit(2).alias("ask"),
    )
    both = answer.unionByName(ask).join(sets, "id")
    return settle(both.groupBy("pivot", "block", "turn").applyInArrow(compare, "a BIGINT, b BIGINT"), "stray-links")


def unused(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def keyed_texts(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a 64-bit hash of its text (null: null) for every row, and the name of that column.

    A stage that decides by text finds its rows again by it, so that no copy of the table is written. The hash does not
    depend on the order of rows, and of ten million texts two have equal ones with a probability of 3e-6.
    """
    key = unused(docs, "text_key")
    return docs.withColumn(key, F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col))), key


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller id."""
    return edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def _to_smallest(edges: DataFrame, among: Column) -> DataFrame:
    """Each ``(node, near)`` row with the smallest id that its node knows."""
    least = edges.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least"))
    return edges.join(least, "node").where(among)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links(a, b)``: the smallest id reachable.

    Large-star and small-star steps in turn, each a sum by node and a join that Spark may split at a frequent
    node; both are written tables, so neither lineage nor what a lost executor costs grows with the rounds.
    """
    edges = settle(_directed(links), "edges")
    seen = _digest(edges)
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        large = _to_smallest(both, F.col("near") > F.col("node")).select(F.col("near").alias("a"), F.col("least").alias("b"))
        large = settle(_directed(large), "large-star")
        down = large.select(F.col("a").alias("node"), F.col("b").alias("near"))
        small = _to_smallest(down, F.lit(True))
        small = small.select(F.col("near").alias("a"), F.col("least").alias("b")).unionByName(
            small.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
        edges = settle(_directed(small), "small-star")
        before, seen = seen, _digest(edges)
        if seen == before:
            break
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def sets_by_scan(docs: DataFrame, id_col: str, text_col: str, k: int, separators: np.ndarray = WHITESPACE):
    """``sets_of`` for :func:`verified_links`: the involved texts are picked from a scan and cut in shingles again.

    The ids go to the scan if a count shows that they fit, else ids and texts meet by a join. Rows that are equal in
    both give one set.
    """

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = broadcast_if_fits(ids.select(F.col("id").alias(id_col)))
        texts = docs.select(id_col, text_col).join(wanted, id_col, "left_semi").distinct()
        return shingle_sets(texts, id_col, text_col, k, separators)

    return sets_of
