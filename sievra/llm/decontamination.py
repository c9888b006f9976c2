"""Benchmark decontamination: size-partitioned MinHash containment search, verified on the words themselves.

A test item is contained in a document if at least ``percent`` / 100 of its distinct ``k``-word shingles occur there.
Items are partitioned by the size of their sets in classes of powers of two. The sketch of an item is the bottom of a
min-wise order of its shingles, and its length follows from the class: one more than a contained item of that class
can lack. A document is a candidate if it holds more of the sketch than that allows for, which no contained item
escapes, however long the document; candidates are then compared shingle by shingle on their words.

Words are runs of letters and digits of the lower-cased text, so case and punctuation do not matter. An item or a
document of fewer than ``k`` words is one shingle, its whole sequence. Items are taken in blocks of bounded size, each
sent to all tasks and held against every document; documents are never shuffled.

Cases: null or empty texts on either side contain nothing and are contained nowhere; repeated rows are reported
as often as they occur; rows without id are searched and reported with a null id; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievra.llm.links import PIECE_BYTES, keyed_texts
from sievra.llm.words import NOT_ALPHANUMERIC, mix, pieces_of, shingle_hashes, text_buffers, word_hashes
from sievra.session import broadcast_if_fits, settle

BLOCK_BYTES = 16 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BITS = 22


def word_shingles(text: str, k: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a lower-cased text, as words."""
    words = _WORD.findall(text.encode())
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


def may_lack(size: int, percent: int) -> int:
    """How many of ``size`` shingles a document may lack and still contain the item."""
    return size - -(-percent * size // 100)


class ItemBlock:
    """A block of items with the index of their sketches."""

    def __init__(self, ids: list, texts: list[str], k: int, percent: int):
        self.k, self.percent, self.ids, self.texts = k, percent, ids, texts
        raw, offsets = text_buffers(pa.array(texts, pa.large_string()))
        hashes, places = shingle_hashes(*word_hashes(raw, offsets, NOT_ALPHANUMERIC), k)
        keys, owners = [], []
        self.need = np.zeros(len(ids), np.int64)
        for i, (a, b) in enumerate(zip(places[:-1], places[1:])):
            items = np.unique(hashes[a:b])
            if not len(items):
                continue
            largest = (1 << len(items).bit_length()) - 1  # of the item's size class
            length = min(len(items), may_lack(largest, percent) + 1)
            sketch = items[np.argsort(mix(items ^ np.uint64(0x5851F42D4C957F2D)))[:length]]
            self.need[i] = length - may_lack(len(items), percent)
            keys.append(sketch)
            owners.append(np.full(length, i))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.owners = owners[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.concatenate([self.first, [len(order)]])
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.keys >> np.uint64(64 - _BITS)] = True

    def candidates(self, hashes: np.ndarray, places: np.ndarray) -> list[tuple[int, int]]:
        """``(row, item)`` pairs whose sketches agree enough."""
        at = np.flatnonzero(self.bits[hashes >> np.uint64(64 - _BITS)])
        if not len(at) or not len(self.keys):
            return []
        rank = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        real = self.keys[rank] == hashes[at]
        at, rank = at[real], rank[real]
        row = np.searchsorted(places, at, "right") - 1
        # A shingle that a document repeats counts once.
        once = np.unique(row * len(self.keys) + rank)
        row, rank = once // len(self.keys), once % len(self.keys)
        n = self.first[rank + 1] - self.first[rank]
        owner = self.owners[np.repeat(self.first[rank] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pair, count = np.unique(np.repeat(row, n) * len(self.ids) + owner, return_counts=True)
        row, owner = pair // len(self.ids), pair % len(self.ids)
        enough = count >= self.need[owner]
        return list(zip(row[enough].tolist(), owner[enough].tolist()))

    def verify(self, text: str, owners: list[int], shingles: dict[int, set]) -> list[tuple[int, int, int]]:
        """``(item, shared, size)`` of the items that the text contains."""
        held, out = word_shingles(text, self.k), []
        for i in owners:
            if i not in shingles:
                shingles[i] = word_shingles(self.texts[i], self.k)
            wanted = shingles[i]
            shared = len(wanted & held)
            if 100 * shared >= self.percent * len(wanted):
                out.append((i, shared, len(wanted)))
        return out


def _search(block_of_items):
    def run(batches):
        block, shingles = block_of_items.value, {}
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            found = {"doc": [], "item": [], "shared": [], "size": []}
            for a, b in pieces_of(text_buffers(column)[1], PIECE_BYTES):
                part = column.slice(a, b - a)
                raw, offsets = text_buffers(part)
                hashes, places = shingle_hashes(*word_hashes(raw, offsets, NOT_ALPHANUMERIC), block.k)
                rows: dict[int, list[int]] = {}
                for row, owner in block.candidates(hashes, places):
                    rows.setdefault(row, []).append(owner)
                for row, owners in rows.items():
                    doc = ids[a + row].as_py()
                    for item, shared, size in block.verify(part[row].as_py(), owners, shingles):
                        for name, value in zip(found, (doc, block.ids[item], shared, size)):
                            found[name].append(value)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in found.items()})

    return run


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(id_col, item_col, n_shared, n_item, containment)``: every document and test item that it contains.

    ``block_bytes``: text of the items sent to the tasks at once; more items take more passes over the documents.
    """
    spark = docs.sparkSession
    lowered = docs.select(F.col(id_col).cast("bigint"), F.lower(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("bigint").alias("item"), F.lower(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + 2 * size // block_bytes if size > block_bytes else 1
    out = None
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i).orderBy("item", "text").collect()
        block = ItemBlock([r["item"] for r in rows], [r["text"] or "" for r in rows], k, percent)
        shared = spark.sparkContext.broadcast(block)
        found = lowered.mapInArrow(_search(shared), "doc BIGINT, item BIGINT, shared BIGINT, size BIGINT")
        out = found if out is None else out.unionByName(found)
    return out.select(
        F.col("doc").alias(id_col),
        F.col("item").alias(item_col),
        F.col("shared").alias("n_shared"),
        F.col("size").alias("n_item"),
        (F.col("shared") / F.col("size")).alias("containment"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that contain a test item; all columns as they were. Rows count each for themselves, with
    or without an id."""
    rows, key = keyed_texts(docs, text_col)
    leaks = contained_items(rows, items, key, text_col, **options).select(key).distinct()
    return rows.join(broadcast_if_fits(settle(leaks, "leaks")), key, "left_anti").select(*docs.columns)
