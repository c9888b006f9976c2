"""Document fingerprints: MinHash signatures over word shingles.

A fingerprint holds the minimum of a text's ``k``-word shingles under each of 128 universal hash functions, 16 bits
of each, as lowercase hex. Equal texts have equal fingerprints, and the share of equal places estimates the Jaccard
similarity of the shingle sets. :func:`similar_documents` joins bands of whole signatures in Spark and verifies
links on full sets.

Cases: a null text is empty; a text without words has a fingerprint of its own, all ones, which is like itself (1)
and unlike any other (0). A text of fewer than ``k`` words is one shingle. Rows without id come first in the order
of documents, rows of equal id are ordered by text; a single document is its own next one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, DoubleType, IntegerType

from sievra.llm.links import PIECE_BYTES, components, meeting_points, set_key, sets_by_scan, verified_links
from sievra.llm.near_dedup import band_values
from sievra.llm.words import distinct_by_row, pieces_of, shingle_hashes, text_buffers, word_hashes
from sievra.session import settle

PERMUTATIONS = 128
SHINGLE = 5
BANDS = 32
_NONE = 0xFFFF


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(4111)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(hashes: np.ndarray, places: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """``(rows, permutations)`` minima of (a x + b mod 2**64) >> 32; all ones for a row without shingles."""
    out = np.full((len(places) - 1, permutations), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(places) > 0)
    if not len(full):
        return out
    starts, work = places[full], np.empty_like(hashes)
    for i, (a, b) in enumerate(zip(*_functions(permutations))):
        np.multiply(hashes, a, out=work)
        work += b
        out[full, i] = np.minimum.reduceat((work >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _text_signatures(column: pa.Array, k: int) -> np.ndarray:
    raw, offsets = text_buffers(column)
    return signature(*shingle_hashes(*word_hashes(raw, offsets), k))


def text_fingerprints(column: pa.Array, k: int = SHINGLE) -> pa.Array:
    """The fingerprint of each text: the 16 low bits of each minimum; all ones for texts without words."""
    out = []
    for a, b in pieces_of(text_buffers(column)[1], PIECE_BYTES):
        minima = _text_signatures(column.slice(a, b - a), k)
        out += [bytes(row) for row in (minima & 0xFFFF).astype(">u2")]
    return pa.array(out, pa.binary())


@arrow_udf(BinaryType())
def fingerprint(text: pa.Array) -> pa.Array:
    return text_fingerprints(text)


@arrow_udf(DoubleType())
def likeness(one: pa.Array, other: pa.Array) -> pa.Array:
    """Share of equal places of two fingerprints; a text without words is like nothing but its own kind."""

    def places(column):
        return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, PERMUTATIONS)

    a, b = places(one), places(other)
    same = (a == b).mean(axis=1)
    none = (a == _NONE).all(axis=1), (b == _NONE).all(axis=1)
    return pa.array(np.where(none[0] != none[1], 0.0, same), pa.float64())


def with_next_text(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: Column | None = None
) -> DataFrame:
    """``(id, text, next_text)``: each document with the text of the next one by ascending id, the last with the first's.

    ``extra``: a column over ``text``, computed once per document and returned as ``extra`` and ``next_extra``.

    Documents are dealt to ranges of ids bounded by quantiles. The first document of each range is also sent to the
    range before, so every neighbour is in its range and texts move once. What the driver sees is a bound and a
    smallest id per range, four ranges a shuffle partition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = F.coalesce("id", F.lit(-(2**63)))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    @arrow_udf(IntegerType())
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False), "right"), pa.int32())

    # ``extra`` is computed before the one exchange, as a column of a Python function hides how rows are dealt.
    dealt = rows.withColumn("key", order).withColumns({"range": range_of("key"), "extra": F.lit(None) if extra is None else extra})
    firsts = rows.select(order.alias("key")).withColumn("range", range_of("key")).groupBy("range").agg(F.min("key").alias("key"))
    firsts = sorted((r["range"], r["key"]) for r in firsts.collect())
    borrow = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]
    borrowers = spark.createDataFrame(borrow, "key BIGINT, borrower INT")
    copies = dealt.join(F.broadcast(borrowers), "key", "left").select(
        "id", "key", "text", "extra",
        F.explode(
            F.when(F.col("borrower").isNull(), F.array(F.struct(F.col("range"), F.lit(0).alias("borrowed")))).otherwise(
                F.array(
                    F.struct(F.col("range"), F.lit(0).alias("borrowed")),
                    F.struct(F.col("borrower").alias("range"), F.lit(1).alias("borrowed")),
                )
            )
        ).alias("at"),
    ).select("id", "key", "text", "extra", "at.range", "at.borrowed")
    within = Window.partitionBy("range").orderBy("borrowed", "key", "text")
    leads = [F.lead(c).over(within).alias(f"next_{c}") for c in ("text", "extra")]
    return copies.select("*", *leads).where("borrowed = 0").drop("key", "range", "borrowed")


def edited(text: Column, next_text: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by as many of the first of ``next_text``, or all."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(next_text, half))


def fingerprints_with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they and the next document's are."""
    rows = with_next_text(docs, id_col, text_col, fingerprint("text"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        F.col("id").alias(id_col),
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("extra").alias("fingerprint"),
        fingerprint("edited").alias("edited_fingerprint"),
        F.col("next_extra").alias("next_fingerprint"),
    )
    return rows.select(
        id_col, "n_chars", "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = 80
) -> DataFrame:
    """``(id, component)`` of all documents that have a similar one: bands joined in Spark, Jaccard verified on full sets.

    Texts of the same set take part as one, the smallest id among them.
    """

    def run(batches):
        for batch in batches:
            for a, b in pieces_of(text_buffers(batch.column(1))[1], PIECE_BYTES):
                column = batch.column(1).slice(a, b - a)
                raw, offsets = text_buffers(column)
                hashes, places = shingle_hashes(*word_hashes(raw, offsets), k)
                values = band_values(signature(hashes, places), BANDS)
                items, ends = distinct_by_row(hashes, places)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array(set_key(items, ends, 0x9E3779B97F4A7C15), pa.int64()),
                        pa.array(set_key(items, ends, 0xC2B2AE3D27D4EB4F), pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(values.ravel().view(np.int64))
                        ),
                    ],
                    ["id", "n", "set_a", "set_b", "bands"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull())
    signed = settle(rows.mapInArrow(run, "id BIGINT, n BIGINT, set_a BIGINT, set_b BIGINT, bands ARRAY<BIGINT>"), "fingerprints").where("n > 0")
    classes = settle(signed.groupBy("set_a", "set_b").agg(F.min("id").alias("rep")), "classes")
    reps = signed.join(classes.withColumnRenamed("rep", "id"), ["set_a", "set_b", "id"], "left_semi")
    met = meeting_points(reps.select("id", "n", "bands"))
    links = verified_links(met, sets_by_scan(docs, id_col, text_col, k), percent)
    same = signed.join(classes, ["set_a", "set_b"]).where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    return components(links.unionByName(same)).withColumnRenamed("id", id_col)
