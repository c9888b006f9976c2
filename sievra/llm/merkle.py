"""A Merkle manifest of a dataset, kept as blocks in van Emde Boas layout, with proofs for every row.

Every row is a leaf. Per group the leaves, in id order, are the bottom of a binary tree; its top is the subroot. The
subroots, in group order, are the bottom of one more tree, whose top is the root. Where the last run of a level has
one node only, its parent is the digest of that node alone.

A tree is cut in aligned blocks of ``2 ** height`` nodes of a level. A block holds the whole subtree above its nodes
as one binary value in van Emde Boas layout: the upper half of the levels first, then the lower subtrees one after
the other, each laid out in the same way. Where a node lies is arithmetic on its depth and number
(:func:`addresses`), which serves building a block and finding siblings alike. The roots of the blocks are the nodes of
the next round, so a table of n rows takes log(n) / height rounds of Spark jobs, and no task holds more than one
block, whatever the size of a group.

Cases: a null field counts as ``-``, an empty text as ``0:``. Rows without group come first, as a group of their
own; rows without id come first in their group, and rows of equal id follow by digest, so equal rows are leaves of their
own that any order of them leaves equal. A group of one row has its leaf as subroot, one group's subroot is the root.
An empty table has no root and no proofs. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievra.operators.sampling import assign_positions
from sievra.session import broadcast_if_fits, settle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEIGHT = 9  # a block has 512 nodes at its bottom, 1023 digests of 32 bytes in all
DIGEST = 32
MAX_PATHS = 1 << 15  # ways of block roots, of about a thousand bytes, that may be broadcast
# What stands at a step of a proof: no sibling, a sibling to the right, one to the left.
ALONE, RIGHT, LEFT = 0, 1, 2
_BLOCKS = "tree BIGINT, n BIGINT, block BIGINT, count INT, root BINARY, nodes BINARY"


# Layout ---------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """Places of the nodes of a tree of ``levels`` levels in van Emde Boas layout, by depth and number.

    The upper ``levels // 2`` levels are a tree of that layout at the front; below each of its missing children
    stands a tree of the other levels.
    """
    if levels == 1:
        return (np.zeros(1, np.int64),)
    upper = levels // 2
    top, below = addresses(upper), addresses(levels - upper)
    starts = (1 << upper) - 1 + np.arange(1 << upper) * ((1 << (levels - upper)) - 1)
    return top + tuple((starts[:, None] + places[None, :]).ravel() for places in below)


def levels_of(n: int, height: int) -> int:
    """Levels of a block of a tree whose level has ``n`` nodes in all: the whole tree, if one block holds it."""
    return (height if n > 1 << height else max(0, int(n - 1).bit_length())) + 1


def parent(*nodes: bytes) -> bytes:
    """The digest of nodes, joined as lowercase hex text."""
    return hashlib.sha256(b"".join(n.hex().encode() for n in nodes)).digest()


def build_block(leaves: list[bytes], levels: int) -> bytearray:
    """The nodes above ``leaves`` in van Emde Boas layout; places without a node are zero."""
    places = addresses(levels)
    nodes = bytearray(((1 << levels) - 1) * DIGEST)
    row = leaves
    for depth in range(levels - 1, -1, -1):
        for at, digest in zip(places[depth].tolist(), row):
            nodes[at * DIGEST : (at + 1) * DIGEST] = digest
        if depth:
            row = [parent(*row[i : i + 2]) for i in range(0, len(row), 2)]
    return nodes


def block_proofs(nodes: bytes, count: int, levels: int) -> tuple[list[bytes], list[bytes]]:
    """Steps and siblings of each of the ``count`` bottom nodes, from the bottom of the block to its root.

    A level's siblings lie at the addresses of the numbers with the last bit flipped.
    """
    places = addresses(levels)
    view = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    steps = np.zeros((count, levels - 1), np.uint8)
    siblings = np.zeros((count, levels - 1, DIGEST), np.uint8)
    number, there = np.arange(count), count
    for step, depth in enumerate(range(levels - 1, 0, -1)):
        other = number ^ 1
        known = other < there
        steps[:, step] = np.where(known, np.where(number & 1, LEFT, RIGHT), ALONE)
        siblings[known, step] = view[places[depth][other[known]]]
        number, there = number >> 1, (there + 1) >> 1
    return [r.tobytes() for r in steps], [s[k != ALONE].tobytes() for s, k in zip(siblings, steps)]


def fold(leaf: bytes, steps: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    node, at = leaf, 0
    for step in steps:
        if step == ALONE:
            node = parent(node)
            continue
        other = siblings[at : at + DIGEST]
        node, at = (parent(node, other) if step == RIGHT else parent(other, node)), at + DIGEST
    return node


# Leaves ---------------------------------------------------------------------------------------


def leaf_digest(*values: Column) -> Column:
    """SHA-256 over the values: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""

    def field(value):
        text = value.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def leaf_table(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", shown: dict[str, Column] | None = None
) -> DataFrame:
    """``(grp, id, leaf, shown)``: a leaf per row, and the leaf that a holder of the row shows for a check.

    ``shown`` gives other values for some of the fields, as a copy that may be damaged has them; the shown leaf is
    null where they are the same.
    """
    leaf = leaf_digest(*[F.col(f) for f in fields])
    other = leaf_digest(*[(shown or {}).get(f, F.col(f)) for f in fields]) if shown else F.lit(None).cast("binary")
    differs = F.lit(False)
    for f, value in (shown or {}).items():
        differs = differs | ~value.eqNullSafe(F.col(f))
    return docs.select(
        F.col(group_col).alias("grp"), F.col(id_col).alias("id"), leaf.alias("leaf"), F.when(differs, other).alias("shown")
    )


# Manifest -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """Blocks of the trees of all groups, and of the tree over their subroots.

    ``leaves(tree, n, block, count, root, nodes, ids, shown)``: the blocks at the bottom, with the ids of their rows;
    ``levels``: the blocks above them, round by round; ``groups(grp, tree, n)``: the tree of each group, which is known by
    the position of its first row; ``top``: the blocks over the subroots, round by round.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    groups: DataFrame
    top: list[DataFrame]
    height: int

    def subroots(self) -> DataFrame:
        """``(tree, subroot)``."""
        return _roots([self.leaves, *self.levels], self.height).withColumnRenamed("root", "subroot")

    def root(self) -> DataFrame:
        """One row, ``(root)``, as lowercase hex; none for an empty table."""
        return _roots(self.top, self.height).select(F.lower(F.hex("root")).alias("root"))


def _roots(rounds: list[DataFrame], height: int) -> DataFrame:
    """``(tree, root)``: each tree's last block is the one that holds all of its level."""
    done = [r.where(F.col("n") <= (1 << height)).select("tree", "root") for r in rounds]
    out = done[0]
    for r in done[1:]:
        out = out.unionByName(r)
    return out


def _block_rows(height: int, carried: tuple[str, ...]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        n, pos = table["n"][0].as_py(), table["pos"][0].as_py()
        levels = levels_of(n, height)
        nodes = build_block(table["digest"].to_pylist(), levels)
        root_at = int(addresses(levels)[0][0]) * DIGEST
        row = {
            "tree": [table["tree"][0].as_py()], "n": [n], "block": [pos >> height], "count": pa.array([len(table)], pa.int32()),
            "root": [bytes(nodes[root_at : root_at + DIGEST])], "nodes": [bytes(nodes)],
        }
        for c in carried:
            kind = pa.list_(table.schema.field(c).type)
            row[c] = pa.array([table[c].to_pylist()], kind)
        return pa.table(row)

    return run


def _blocks(nodes: DataFrame, height: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per block of ``nodes(tree, n, pos, digest, *carried)``."""
    schema = ", ".join([_BLOCKS, *[f"{c} ARRAY<{nodes.schema[c].dataType.simpleString()}>" for c in carried]])
    rows = nodes.select("tree", "n", "pos", "digest", *carried, F.shiftright("pos", height).alias("block"))
    return rows.groupBy("tree", "block").applyInArrow(lambda t: _block_rows(height, carried)(t.drop_columns(["block"])), schema)


def _rounds(first: DataFrame, height: int) -> list[DataFrame]:
    """The blocks over the roots of ``first``, over theirs, and so on until every tree is one block."""
    out, below = [], first
    while True:
        rest = below.where(F.col("n") > (1 << height))
        if rest.isEmpty():
            return out
        size = 1 << height
        nodes = rest.select(
            "tree", F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("block").alias("pos"), F.col("root").alias("digest")
        )
        below = settle(_blocks(nodes, height), "merkle-blocks")
        out.append(below)


def build_manifest(leaves: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest of ``leaves(grp, id, leaf, shown)``.

    Rows are numbered in ranges of (group, id, digest, place in the table as written), so neither a group with most of
    the rows nor a row that repeats is a task of its own.
    """
    leaves = settle(leaves.withColumn("place", F.monotonically_increasing_id()), "merkle-leaves")
    placed = assign_positions(leaves, "grp", "id", "leaf", "shown", "place")
    groups = settle(placed.groupBy("grp").agg(F.min("pos").alias("tree"), F.count("*").alias("n")), "merkle-groups")
    known = broadcast_if_fits(groups.select(F.col("grp").alias("__grp"), "tree", "n"))
    nodes = placed.join(known, F.col("grp").eqNullSafe(F.col("__grp"))).select(
        "tree", "n", (F.col("pos") - F.col("tree")).alias("pos"), F.col("leaf").alias("digest"), F.col("id").alias("ids"), "shown"
    )
    bottom = settle(_blocks(nodes, height, ("ids", "shown")), "merkle-blocks")
    levels = _rounds(bottom, height)
    # The subroots are the leaves of the tree over all groups; trees are numbered in group order.
    order = assign_positions(groups, "tree").select("tree", "pos")
    subroots = _roots([bottom, *levels], height).join(order, "tree").select(
        F.lit(0).cast("bigint").alias("tree"), F.lit(groups.count()).cast("bigint").alias("n"), "pos", F.col("root").alias("digest")
    )
    over = settle(_blocks(subroots, height), "merkle-top")
    return Manifest(bottom, levels, groups, [over, *_rounds(over, height)], height)


def write_manifest(manifest: Manifest, path: str) -> None:
    """Tables ``leaves``, ``groups``, ``level-i``, ``top-i`` and, written last, ``meta``."""
    manifest.leaves.write.parquet(f"{path}/leaves")
    manifest.groups.write.parquet(f"{path}/groups")
    for name, rounds in (("level", manifest.levels), ("top", manifest.top)):
        for i, blocks in enumerate(rounds):
            blocks.write.parquet(f"{path}/{name}-{i}")
    spark = manifest.leaves.sparkSession
    sizes = [(manifest.height, len(manifest.levels), len(manifest.top))]
    spark.createDataFrame(sizes, "height INT, levels INT, top INT").coalesce(1).write.parquet(f"{path}/meta")


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """The manifest that :func:`write_manifest` stored."""
    meta = spark.read.parquet(f"{path}/meta").first()
    read = spark.read.parquet
    return Manifest(
        read(f"{path}/leaves"), [read(f"{path}/level-{i}") for i in range(meta["levels"])], read(f"{path}/groups"),
        [read(f"{path}/top-{i}") for i in range(meta["top"])], meta["height"],
    )


# Proofs ---------------------------------------------------------------------------------------


def _child_proofs(height: int, with_leaves: bool):
    """Blocks with the proof of their root in, their bottom nodes with whole proofs out."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("tree", "n", "block", "count", "nodes", "steps", "siblings", "subroot", "top")}
                n, levels = row["count"], levels_of(row["n"], height)
                steps, siblings = block_proofs(row["nodes"], n, levels)
                out = {
                    "tree": pa.array([row["tree"]] * n, pa.int64()),
                    "pos": pa.array(np.arange(n, dtype=np.int64) + (row["block"] << height)),
                    "steps": pa.array([s + row["steps"] for s in steps], pa.binary()),
                    "siblings": pa.array([s + row["siblings"] for s in siblings], pa.binary()),
                    "subroot": pa.array([row["subroot"]] * n, pa.binary()),
                    "top": pa.array([row["top"]] * n, pa.binary()),
                }
                if with_leaves:
                    view = np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST)
                    bottom = view[addresses(levels)[-1][:n]]
                    out |= {
                        "id": batch.column("ids")[i].values, "shown": batch.column("shown")[i].values,
                        "leaf": pa.array([r.tobytes() for r in bottom], pa.binary()),
                    }
                yield pa.RecordBatch.from_pydict(out)

    return run


def _down(blocks: DataFrame, above: DataFrame, height: int, leaf_type: str | None = None) -> DataFrame:
    """Proofs of the bottom nodes of ``blocks``, given those of their roots: ``above(tree, block, steps, siblings, subroot, top)``."""
    names = "tree BIGINT, pos BIGINT, steps BINARY, siblings BINARY, subroot BINARY, top BINARY"
    names += f", id {leaf_type}, shown BINARY, leaf BINARY" if leaf_type else ""
    rows = blocks.join(broadcast_if_fits(above, MAX_PATHS), ["tree", "block"])
    return rows.mapInArrow(_child_proofs(height, leaf_type is not None), names)


def _whole(blocks: DataFrame, height: int, known: DataFrame) -> DataFrame:
    """``above`` of the trees that are one block of ``blocks``; ``known(tree, steps, siblings, top)`` leads from them on."""
    done = blocks.where(F.col("n") <= (1 << height)).select("tree", "block", F.col("root").alias("subroot"))
    return done.join(broadcast_if_fits(known), "tree").select("tree", "block", "steps", "siblings", "subroot", "top")


def _descend(rounds: list[DataFrame], known: DataFrame, height: int, leaf_type: str | None) -> DataFrame:
    """Proofs of the bottom nodes of the first of ``rounds``, from the highest round down."""
    above = None
    for i in range(len(rounds) - 1, -1, -1):
        whole = _whole(rounds[i], height, known)
        above = settle(whole if above is None else whole.unionByName(above), "merkle-paths")
        found = _down(rounds[i], above, height, leaf_type if i == 0 else None)
        above = found.select("tree", F.col("pos").alias("block"), "steps", "siblings", "subroot", "top")
    return found


def proofs(manifest: Manifest) -> DataFrame:
    """``(grp, id, leaf, shown, subroot, root, steps, siblings)``: a row per leaf.

    ``siblings`` are the digests beside the way from the leaf over the subroot to the root, in that order; ``steps`` has a
    byte per level: no sibling, one to the right, one to the left. A block's task adds its own part to the way of its root, so the
    rows that move are one per block.
    """
    top_root = _roots(manifest.top, manifest.height).select(
        "tree", F.lit(b"").alias("steps"), F.lit(b"").alias("siblings"), F.col("root").alias("top")
    )
    over = settle(_descend(manifest.top, top_root, manifest.height, None), "merkle-subroots")
    order = assign_positions(manifest.groups, "tree").select("tree", "pos")
    known = settle(over.select("pos", "steps", "siblings", "top").join(order, "pos").select("tree", "steps", "siblings", "top"), "merkle-known")
    kind = manifest.leaves.schema["ids"].dataType.elementType.simpleString()
    found = _descend([manifest.leaves, *manifest.levels], known, manifest.height, kind)
    groups = broadcast_if_fits(manifest.groups.select("grp", "tree"))
    return found.join(groups, "tree").select("grp", "id", "leaf", "shown", "subroot", F.col("top").alias("root"), "steps", "siblings")


def verify(proved: DataFrame) -> DataFrame:
    """:func:`proofs` with ``proof_sha256``, the digest of the siblings, and ``folded_root``, what the shown leaf (else the
    leaf) and the siblings lead to; digests as lowercase hex; ``verified`` if that is the root."""

    @F.arrow_udf("struct<proof: string, folded: string>")
    def check(leaf: pa.Array, shown: pa.Array, steps: pa.Array, siblings: pa.Array) -> pa.Array:
        proof, folded = [], []
        for a, b, s, others in zip(leaf.to_pylist(), shown.to_pylist(), steps.to_pylist(), siblings.to_pylist()):
            proof.append(hashlib.sha256(others.hex().encode()).hexdigest())
            folded.append(fold(a if b is None else b, s, others).hex())
        return pa.StructArray.from_arrays([pa.array(proof, pa.string()), pa.array(folded, pa.string())], ["proof", "folded"])

    checked = proved.withColumn("__check", check("leaf", "shown", "steps", "siblings"))
    return checked.select(
        "grp", "id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.col("__check.proof").alias("proof_sha256"), F.col("__check.folded").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def damaged(id_col: str = "doc_id", col: str = "n_chars") -> dict[str, Column]:
    """A copy of the rows that is damaged where 7 divides the CRC-32 of the id: ``col`` is one more there."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 0
    return {col: F.when(hit, F.col(col) + 1).otherwise(F.col(col))}


def manifest_digests(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Manifest and proofs of all rows, and what a copy damaged in some rows leads to."""
    manifest = build_manifest(leaf_table(docs, shown=damaged()), height)
    return verify(proofs(manifest)).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
