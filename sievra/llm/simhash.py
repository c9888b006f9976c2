"""Near-duplicate groups by SimHash fingerprints that BK-trees bring together.

A text's fingerprint has a bit set where over half of the hashes of its shingles have it. Texts are linked if their
fingerprints differ in ``radius`` bits at most. Equal fingerprints are one node; from there on the work is on distinct
fingerprints only, so any number of exact copies costs one row each.

Fingerprints are dealt to shards by parts of their bits: with ``radius + 1`` parts, two that are linked agree in one
of them, and meet in that part's shard. A shard that is still large is dealt again by parts of the bits that its
members need not share, for linked ones still differ in ``radius`` of these at most. What is large even then is a crowd of
distinct fingerprints around one another; it is cut in blocks, and each two blocks are a shard. So none is larger than
two blocks, also where a third of all fingerprints share a part. A shard is one BK-tree, children keyed by their integer Hamming
distance to the parent. All fingerprints of the shard go down the tree together and follow only the edges within
the radius of their own distance, which holds every fingerprint within the radius (triangle inequality). The tree lives
where the shard's rows are: it is sent to no other task and never to the driver, since that would be the fingerprints of
all documents. Of what the tree finds, only links that join two parts leave the task, fewer than the shard has members.

Cases: a null or empty text, or one of separators only, has the fingerprint zero, which is linked like any other. A text
of fewer than ``k`` words is one shingle. Rows that share an id but not the text have each their own fingerprint and
component. A row without id has a fingerprint, links others, and takes the smallest id reachable, null if
there is none. Empty tables give empty results, and other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sievra.llm.links import components
from sievra.llm.words import give_back, pieces_of, text_buffers
from sievra.session import broadcast_if_fits, settle

SEED = 42
RADIUS = 3
WORDS = 3
# Fingerprints that a shard should have at first, and above which it is dealt again.
SHARD_GOAL = 512
SHARD_LIMIT = 1 << 14
# How often a large shard is dealt by further bits before its blocks meet in pairs.
DEALS = 2
# Hashes of one text that are in memory at a time, and pairs of a query and a node of a level of the tree.
HASHES = 1 << 15
PAIRS = 1 << 17
PIECE_BYTES = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# Fingerprints ---------------------------------------------------------------------------------


def _bit_counts(shingles: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    made = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    return np.unpackbits(made, axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, k: int = WORDS) -> int:
    """The 64-bit fingerprint of a text in UTF-8, read in stretches of ``HASHES`` words."""
    text = text.lower()  # bytes: A-Z only
    counts, total = np.zeros(64, np.int64), 0
    words: list[bytes] = []
    for found in _WORD.finditer(text):
        words.append(found.group())
        if len(words) >= HASHES + k:
            shingles = [b" ".join(w) for w in zip(*(words[i:] for i in range(k)))]
            counts, total, words = counts + _bit_counts(shingles), total + len(shingles), words[len(words) - k + 1 :]
    if len(words) >= k:
        shingles = [b" ".join(w) for w in zip(*(words[i:] for i in range(k)))]
    else:
        shingles = [b" ".join(words)] if words and not total else []
    if shingles:
        counts, total = counts + _bit_counts(shingles), total + len(shingles)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS) -> DataFrame:
    """``(id, code)``: the fingerprint of every text as a signed 64-bit number; map-only."""

    def run(batches):
        for batch in batches:
            raw, ends = text_buffers(batch.column(1))
            for a, b in pieces_of(ends, PIECE_BYTES):
                codes = [fingerprint(raw[ends[i] : ends[i + 1]].tobytes(), k) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.array(codes, np.uint64).view(np.int64))], ["id", "code"]
                )
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, code BIGINT")


# BK-tree --------------------------------------------------------------------------------------


class BKTree:
    """A BK-tree over distinct codes as arrays, built and searched a level at a time.

    ``codes``: the nodes in the order of the levels, so the children of a node stand together, in the order of their
    distances ``edge`` to it. ``first``: where the children of a node with an edge of at least d begin, for d = 0 to 65.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = np.empty_like(codes)
        self.first = np.zeros((len(codes), 66), np.int32)
        self.edge = np.zeros(len(codes), np.uint8)
        # A subtree is a range of ``waiting`` codes with their owners; its first code becomes the node.
        waiting, owners, done = codes, np.zeros(len(codes), np.int64), 0
        while len(waiting):
            heads = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            nodes = np.arange(done, done + len(heads))
            self.codes[nodes] = waiting[heads]
            rest = np.ones(len(waiting), bool)
            rest[heads] = False
            parent = (np.cumsum(~rest) - 1)[rest]
            waiting = waiting[rest]
            apart = np.bitwise_count(waiting ^ self.codes[nodes[parent]]).astype(np.int64)
            order = np.lexsort((apart, parent))
            waiting, parent, apart = waiting[order], parent[order], apart[order]
            key = parent * 65 + apart
            fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            owners = np.cumsum(fresh) - 1
            done += len(heads)
            self.edge[done : done + int(fresh.sum())] = apart[fresh]
            # A node's children with an edge of at least d begin behind all smaller (parent, edge) pairs.
            wanted = np.arange(len(heads))[:, None] * 65 + np.arange(66)[None, :]
            self.first[nodes] = done + np.searchsorted(key[fresh], wanted.ravel()).reshape(wanted.shape)

    def within(self, queries: np.ndarray, radius: int):
        """Pairs ``(query number, node number)`` within the radius, some at a time; only edges within it are followed."""
        work = [(np.arange(len(queries)), np.zeros(len(queries), np.int64))] if len(self.codes) else []
        while work:
            asked, nodes = work.pop()
            if len(asked) > PAIRS:
                half = len(asked) // 2
                work += [(asked[half:], nodes[half:]), (asked[:half], nodes[:half])]
                continue
            apart = np.bitwise_count(queries[asked] ^ self.codes[nodes]).astype(np.int64)
            hit = apart <= radius
            if hit.any():
                yield asked[hit], nodes[hit]
            begin = self.first[nodes, np.maximum(apart - radius, 0)].astype(np.int64)
            n = self.first[nodes, np.minimum(apart + radius + 1, 65)] - begin
            if n.any():
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                work.append((np.repeat(asked, n), np.repeat(begin, n) + at))


def joined_codes(codes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links ``(a, b)`` between positions of ``codes`` that connect all within ``radius`` of one another, a forest."""
    tree = BKTree(codes)
    place = np.empty(len(codes), np.int64)
    place[np.argsort(tree.codes, kind="stable")] = np.argsort(codes, kind="stable")
    root = np.arange(len(codes))
    links = []
    for asked, nodes in tree.within(codes, radius):
        a, b = asked, place[nodes]
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            # Every part joins the smallest part it meets among smaller ones, all parts at once.
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            keep = order[np.r_[True, high[order][1:] != high[order][:-1]]]
            links += zip(a[keep].tolist(), b[keep].tolist())
            root[high[keep]] = low[keep]
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return links


# Shards ---------------------------------------------------------------------------------------


def _parts_of(free: list[int], parts: int) -> list[list[int]]:
    """Bit numbers in ``parts`` parts of nearly equal size."""
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [free[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _shard_rows(rows: DataFrame, taken: dict[str, list[int]], bits: int | None, radius: int) -> tuple[DataFrame, dict[str, list[int]]]:
    """``rows(way, shard, code)`` dealt by each of ``radius + 1`` parts of the bits that their way has not taken.

    ``way`` names which bits a row has been dealt by so far; ``taken`` lists them. ``bits``: how many of a part count.
    """
    dealt, ways = None, {}
    for way, used in taken.items():
        free = [b for b in range(64) if b not in used]
        for i, part in enumerate(_parts_of(free, radius + 1)):
            part = part if bits is None else part[:bits]
            name = f"{way}{i}"
            ways[name] = used + part
            mask = F.lit(np.uint64(sum(1 << b for b in part)).view(np.int64).item())
            some = rows.where(F.col("way") == way).select(
                F.lit(name).alias("way"), F.xxhash64(F.lit(name), "shard", F.col("code").bitwiseAND(mask)).alias("shard"), "code"
            )
            dealt = some if dealt is None else dealt.unionByName(some)
    return dealt, ways


def _block_pairs(rows: DataFrame, limit: int) -> DataFrame:
    """``rows(way, shard, code, n)`` of shards of ``n`` codes dealt to pairs of blocks of about ``limit`` codes."""
    blocks = F.ceil(F.col("n") / limit).cast("int")
    own = F.pmod(F.xxhash64("code"), blocks.cast("bigint")).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    met = rows.select("way", "shard", "code", own.alias("own"), other)
    return met.select("way", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "code")


def code_links(codes: DataFrame, radius: int = RADIUS, goal: int = SHARD_GOAL, limit: int = SHARD_LIMIT) -> DataFrame:
    """``(a, b)``: links between distinct ``codes(code)`` that connect all codes within ``radius`` bits of one another."""
    if not 0 <= radius < 16:
        raise ValueError("a radius of 0 to 15 bits")
    spark = codes.sparkSession
    codes = settle(codes.select("code"), "codes")
    bits = max(0, (max(1, codes.count()) // goal).bit_length())
    rows = codes.select(F.lit("").alias("way"), F.lit(0).cast("bigint").alias("shard"), "code")
    ways: dict[str, list[int]] = {"": []}
    if bits:
        rows, ways = _shard_rows(rows, ways, bits, radius)
    ready = []
    for deals_left in range(DEALS, -1, -1):
        rows = settle(rows, "shards")
        sizes = rows.groupBy("way", "shard").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        sizes = settle(sizes, "large-shards")
        left = {r["way"] for r in sizes.select("way").distinct().collect()}
        if not left:
            ready.append(rows)
            break
        large = broadcast_if_fits(sizes.select("shard", "n"))
        ready.append(rows.join(large, "shard", "left_anti"))
        if deals_left:
            rows, ways = _shard_rows(rows.join(large, "shard", "left_semi"), {w: ways[w] for w in left}, None, radius)
        else:
            ready.append(_block_pairs(rows.join(large, "shard"), limit))
    all_rows = ready[0]
    for more in ready[1:]:
        all_rows = all_rows.unionByName(more.select(*all_rows.columns))

    def link(table: pa.Table) -> pa.Table:
        held = table["code"].to_numpy().view(np.uint64)
        pairs = np.array(joined_codes(held, radius), np.int64).reshape(-1, 2)
        found = held.view(np.int64)
        return pa.table({"a": found[pairs[:, 0]], "b": found[pairs[:, 1]]})

    # Rows of a few bytes that take long to search: by their size alone, Spark would put them in few tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = all_rows.select("shard", "code").repartition(tasks, "shard")
    return shards.groupBy("shard").applyInArrow(link, "a BIGINT, b BIGINT")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``(id_col, fingerprint, component_id)``, a row per input row.

    ``fingerprint`` has 16 lowercase hex digits, ``component_id`` is the smallest id reachable over links of ``radius`` bits or
    fewer, the row's own included.
    """
    coded = settle(fingerprints(docs, id_col, text_col, k), "fingerprints")
    classes = settle(coded.groupBy("code").agg(F.min("id").alias("least")), "classes")
    links = settle(code_links(classes, radius), "code-links")
    parts = components(links).select(F.col("id").alias("code"), F.col("component").alias("part"))
    placed = settle(classes.join(parts, "code", "left").withColumn("part", F.coalesce("part", "code")), "parts")
    smallest = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    owners = settle(placed.join(smallest, "part").select("code", "component_id"), "components")
    rows = coded.join(broadcast_if_fits(owners), "code")
    return rows.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")
