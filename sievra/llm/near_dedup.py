"""Near-duplicate groups by min-max hashing.

Every permutation of a document's shingles gives two signature values, its minimum and its maximum, so 64
evaluations give 128 values. Bands of four values bring documents together, and links are confirmed on full
shingle sets (:mod:`sievra.llm.links`). At a similarity of 0.8 two documents share none of the 32 bands with a
probability of about 5e-8; there is no cap on partners or groups.

Cases: a null or empty text, or one of separators only, has no shingles, is linked with nothing and kept. A text of
fewer than ``k`` words is one shingle. Rows that share an id count as one document, whose sets are all linked. A row
without id takes the component of its text and is kept only if no row with an id has the same set. Empty tables
give empty results, and other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievra.llm.links import PIECE_BYTES, components, keyed_texts, meeting_points, row_sets, set_key, sets_by_scan, verified_links
from sievra.llm.words import give_back, mix, pieces_of, text_buffers
from sievra.session import broadcast_if_fits, settle

PERMUTATIONS = 64
BANDS = 32


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``n`` hash functions x -> (a x + b mod 2**64) >> 32."""
    rng = np.random.default_rng(97)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minmax_signature(items: np.ndarray, places: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """``(rows, 2 * permutations)`` values: minimum and maximum under each permutation; zeros for empty sets."""
    out = np.zeros((len(places) - 1, 2 * permutations), np.uint32)
    full = np.flatnonzero(np.diff(places) > 0)
    if not len(full):
        return out
    starts, work = places[full], np.empty_like(items)
    for i, (a, b) in enumerate(zip(*_permutations(permutations))):
        np.multiply(items, a, out=work)
        work += b
        y = (work >> np.uint64(32)).astype(np.uint32)
        out[full, 2 * i] = np.minimum.reduceat(y, starts)
        out[full, 2 * i + 1] = np.maximum.reduceat(y, starts)
    return out


def band_values(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """``(rows, bands)`` hashes of equal, successive parts of the signature, each marked with its band."""
    width = signature.shape[1] // bands
    out = np.empty((len(signature), bands), np.uint64)
    for band in range(bands):
        value = np.full(len(signature), band + 1, np.uint64)
        for column in range(band * width, (band + 1) * width):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + signature[:, column])
        out[:, band] = value
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, bands: int = BANDS) -> DataFrame:
    """``(id, n, set_a, set_b, bands)``: size, name and bands of each text's set of ``k``-word shingles."""

    def run(batches):
        for batch in batches:
            for a, b in pieces_of(text_buffers(batch.column(1))[1], PIECE_BYTES):
                items, places = row_sets(batch.column(1).slice(a, b - a), k)
                values = band_values(minmax_signature(items, places), bands)
                ends = np.arange(b - a + 1, dtype=np.int32) * bands
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(places), pa.int64()),
                        pa.array(set_key(items, places, 0x9E3779B97F4A7C15), pa.int64()),
                        pa.array(set_key(items, places, 0xC2B2AE3D27D4EB4F), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().view(np.int64))),
                    ],
                    ["id", "n", "set_a", "set_b", "bands"],
                )
        give_back()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id BIGINT, n BIGINT, set_a BIGINT, set_b BIGINT, bands ARRAY<BIGINT>")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, percent: int = 80, block_items: int = 1 << 18
) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)``, a row per input row.

    ``component_id`` is the smallest id reachable over links of Jaccard similarity ``percent`` / 100 or more; the
    document of that id is the one kept.
    """
    signed = settle(signatures(docs, id_col, text_col, k), "signatures")
    named = signed.where("n > 0")
    # Size and bands are those of the set, so any row of a class has them.
    classes = named.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = settle(classes.where("rep IS NOT NULL"), "classes")
    reps = classes.select(F.col("rep").alias("id"), "n", "bands")
    links = verified_links(meeting_points(reps), sets_by_scan(docs, id_col, text_col, k), percent, block_items)
    parts = settle(components(links), "components").withColumnRenamed("id", "rep")
    owners = classes.join(parts, "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    rows = named.select("id", "n", "set_a", "set_b").join(owners, ["set_a", "set_b"], "left").select("id", "n", "component")
    rows = rows.unionByName(signed.where("n = 0").select("id", "n", F.lit(None).cast("bigint").alias("component")))
    component = F.coalesce("component", "id")
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` per group of near-duplicates, all columns as they were.

    Rows count each for themselves, whatever their ids. Of a group the row of the smallest id stays, one without id only if
    all are, and of rows that share that id any one. Rows without a shingle are in no group and stay. ``docs`` is scanned
    several times and not copied; rows are found again by id and text.
    """
    rows, key = keyed_texts(docs, text_col)
    found = near_duplicates(rows, key, text_col, k, percent).where("n_shingles > 0")
    found = settle(found.select(F.col(key).alias("key"), F.col("component_id").alias("group")), "groups-of-texts")
    groups = found.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    found = settle(found.join(groups, "group").distinct(), "texts-in-groups")
    named = rows.select(F.col(key).alias("key"), F.col(id_col).alias("id")).join(broadcast_if_fits(found), "key")
    named = settle(named.groupBy("group", "id", "key").agg(F.count("*").alias("n")), "rows-in-groups")
    first = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first"))
    first = settle(first, "first-rows")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    named = settle(named.join(broadcast_if_fits(first), "group").select("id", "key", "n", stays.alias("stays")), "named")
    gone, repeated = named.where("NOT stays"), named.where("stays AND n > 1")

    def among(found: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        found = broadcast_if_fits(found.select("id", "key"))
        return rows.join(found, (rows[key] == found["key"]) & rows[id_col].eqNullSafe(found["id"]), how)

    rows = among(gone, "left_anti", rows)
    if not repeated.isEmpty():
        one = among(repeated, "left_semi", rows).dropDuplicates([key, id_col])
        rows = among(repeated, "left_anti", rows).unionByName(one)
    return rows.select(*docs.columns)
