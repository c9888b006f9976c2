"""Hard negatives by angular triangle filtering: of another label, and almost but not quite as near as a positive.

Vectors are turned into whole numbers, so scores are exact. For every vector its length and its angles to a few
reference directions are stored. The angle between an anchor and a vector is at least the difference of their
angles to any direction and at most the sum of them (or what that sum lacks to a full turn); the cosines of the
tightest two, times both lengths, bound the score. Vectors are stored in order of (nearest direction, angle to it) and
worked through in windows of ``WINDOW`` neighbours in that order, with the least and greatest angle and length of the
window. Only windows whose bounds, widened for rounding, overlap the scores still wanted get integer scores.

Anchors are taken in blocks of bounded size, each block against all vectors. A task keeps the best of all it sees and
hands them over once. So that tasks start with a limit, and what they hand over grows with the anchors and not with
anchors times tasks, the same search first runs over every 64th vector: the k-th best of these is a limit that the
k-th best of all cannot be below.

Cases: rows with a null label, a null vector or any null or non-finite component take no part. A row without id is never an
anchor, comes last among equal scores, and is returned with a null id. Rows that repeat an id stand each for themselves
as positives or negatives of others; one that repeats the anchor's id is never its positive, and anchors equal in
id, label and vector are one. Shorter vectors count as filled up with zeros. Scores that leave 64 bits stay at its ends.
An anchor without positives, or none of whose negatives lies in the limits, has no rows; an empty table gives none.
Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sievra.operators.neighbours import matrix
from sievra.operators.sampling import assign_positions
from sievra.session import scratch_path, settle

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
# Scores of negatives lie between these hundredths of the positive's score.
LEAST, MOST = 30, 90
REFERENCES = 16
REFERENCE_SAMPLE = 4096  # vectors, at most twice as many, that the directions are fitted on; they steer the order only
WINDOW = 256
# Numbers of a block of anchors, which every task holds, and of the vectors of one stored part.
ANCHOR_NUMBERS = 1 << 20
PART_NUMBERS = 1 << 21
PILOT = 64
# What angles and scores may be off by rounding: radians, and share of the score besides one whole number.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_NO_ID = _HIGH
_ROWS = "id BIGINT, label BIGINT, x ARRAY<DOUBLE>, norm DOUBLE, angles ARRAY<DOUBLE>, cell INT, near DOUBLE"
_HITS = "anchor INT, slot INT, id BIGINT, score BIGINT"


# Vectors and angles ---------------------------------------------------------------------------


def whole_numbers(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``floor(256 * x)``, filled up with zeros to ``dim`` numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    out = np.zeros((len(column), dim))
    at = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)
    with np.errstate(over="ignore"):
        out[np.repeat(np.arange(len(column)), sizes), at] = np.clip(np.floor(SCALE * flat), -1e300, 1e300)
    return out


def lengths_and_angles(x: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of each row and its angles to the reference directions; zero for a row of zeros."""
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
        cosine = (x @ references.T) / np.where(norm > 0, norm, 1.0)[:, None]
        angles = np.arccos(np.clip(cosine, -1.0, 1.0))
    angles[norm == 0] = 0.0
    return norm, angles


def fit_references(x: np.ndarray, n: int = REFERENCES, rounds: int = 5) -> np.ndarray:
    """At most ``n`` directions that rows of a sample point to, by spherical k-means."""
    norm, _ = lengths_and_angles(x, np.zeros((1, x.shape[1])))
    unit = x[norm > 0] / norm[norm > 0, None]
    unit = unit[np.isfinite(unit).all(axis=1)]
    if not len(unit):
        return np.eye(1, x.shape[1])
    centers = unit[np.linspace(0, len(unit) - 1, min(n, len(unit))).astype(int)]
    for _ in range(rounds):
        nearest = (unit @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, unit)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(size > 1e-9, sums / np.where(size > 1e-9, size, 1.0), centers)
    return centers


def usable(vectors: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """``(id, label, vector)`` of the rows that take part."""
    bad = F.exists(vector_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull() & ~bad)
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector_col).alias("vector"))
    return rows.where("label IS NOT NULL")


def with_angles(rows: DataFrame, references: np.ndarray, dim: int) -> DataFrame:
    """The rows as whole numbers, with lengths, angles, nearest direction and the angle to it."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_numbers(batch.column("vector"), dim)
            norm, angles = lengths_and_angles(x, references)
            cell = np.argmin(np.nan_to_num(angles, nan=9.0), axis=1)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "label": batch.column("label"), "x": _lists(x), "norm": norm, "angles": _lists(angles),
                "cell": cell.astype(np.int32), "near": angles[np.arange(len(x)), cell],
            })

    return rows.mapInArrow(run, _ROWS)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))


def score_bounds(norm: np.ndarray, angles: np.ndarray, lengths: tuple[float, float], low: np.ndarray, high: np.ndarray):
    """Least and greatest score of each anchor with any vector whose length and angles lie between the given ones."""
    below, above = angles + low, angles + high
    gap = np.maximum(np.maximum(angles - high, low - angles).max(axis=1), 0.0)
    wide = np.where(above <= np.pi, above, np.where(below >= np.pi, 2 * np.pi - below, np.pi)).min(axis=1)
    most = np.cos(np.maximum(gap - ANGLE_SLACK, 0.0))
    least = np.cos(np.minimum(wide + ANGLE_SLACK, np.pi))
    upper = norm * np.where(most >= 0, most * lengths[1], most * lengths[0])
    lower = norm * np.where(least >= 0, least * lengths[0], least * lengths[1])
    slack = 1.0 + SCORE_SLACK * norm * lengths[1]
    return np.floor(lower - slack), np.ceil(upper + slack)


def integer_scores(a: np.ndarray, x: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of rows of whole numbers; ``bound`` is the greatest product of two lengths."""
    if bound < 2.0**52:  # every partial sum is a whole number that a double holds
        return (a @ x.T).astype(np.int64)
    exact = [[min(max(sum(int(p) * int(q) for p, q in zip(u, v) if p and q), _LOW), _HIGH) for v in x] for u in a]
    return np.array(exact, np.int64).reshape(len(a), len(x))


# Search in a task -----------------------------------------------------------------------------


class Best:
    """The best ``k`` of each key so far: higher scores first, then lower ids. ``floor``: what the k-th best is known to reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.score = np.full((len(floor), k), _LOW)
        self.id = np.full((len(floor), k), _NO_ID)
        self.n = np.zeros(len(floor), np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        touched = np.unique(key)
        r, c = np.nonzero(np.arange(self.k)[None, :] < self.n[touched, None])
        old = touched[r]
        key = np.r_[old, key]
        score, ident = np.r_[self.score[old, c], score], np.r_[self.id[old, c], ident]
        order = np.lexsort((ident, -score.astype(object) if len(score) and score.min() == _LOW else -score, key))
        key, score, ident = key[order], score[order], ident[order]
        place = np.arange(len(key)) - np.searchsorted(key, key, side="left")
        kept = place < self.k
        key, place = key[kept], place[kept]
        self.score[key, place], self.id[key, place] = score[kept], ident[kept]
        self.n[touched] = np.bincount(np.searchsorted(touched, key), minlength=len(touched))
        full = touched[self.n[touched] == self.k]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, self.k - 1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, c = np.nonzero(np.arange(self.k)[None, :] < self.n[:, None])
        return key, self.score[key, c], self.id[key, c]


def _windows(batch: pa.RecordBatch):
    """Successive windows: ids, labels, vectors, lengths, and least and greatest angles."""
    x, angles = matrix(batch.column("x")), matrix(batch.column("angles"))
    ids = batch.column("id").fill_null(_NO_ID).to_numpy()
    labels, norm = batch.column("label").to_numpy(), batch.column("norm").to_numpy()
    for at in range(0, len(ids), WINDOW):
        part = slice(at, at + WINDOW)
        yield ids[part], labels[part], x[part], (norm[part].min(), norm[part].max()), angles[part].min(axis=0), angles[part].max(axis=0)


def _search(anchors, slots: int, k: int, same_label: bool):
    """A task's search for ``anchors``, a broadcast dictionary with ``least``, ``most``, ``floor``: a row per anchor, a column per slot."""

    def run(batches):
        a = anchors.value
        best = Best(a["floor"].ravel(), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            for ids, labels, x, lengths, low, high in _windows(batch):
                with np.errstate(all="ignore"):
                    lower, upper = score_bounds(a["norm"], a["angles"], lengths, low, high)
                wanted = np.maximum(best.floor.reshape(-1, slots), a["least"])
                # Written so that a bound that is no number leaves the window in.
                out = (upper[:, None] < wanted) | (lower[:, None] > a["most"]) | (wanted > a["most"])
                if same_label:
                    out |= ~np.isin(a["label"], labels)[:, None]
                asked = np.flatnonzero(~out.all(axis=1))
                if not len(asked):
                    continue
                score = integer_scores(a["x"][asked], x, float(a["norm"][asked].max() * lengths[1]))
                alike = a["label"][asked][:, None] == labels[None, :]
                fits = alike & (a["id"][asked][:, None] != ids[None, :]) if same_label else ~alike
                for slot in range(slots):
                    r, c = np.nonzero(fits & (score >= wanted[asked, slot, None]) & (score <= a["most"][asked, slot, None]))
                    if len(r):
                        best.add(asked[r] * slots + slot, score[r, c], ids[c])
        key, score, ident = best.rows()
        yield pa.RecordBatch.from_pydict({
            "anchor": pa.array((key // slots).astype(np.int32)), "slot": pa.array((key % slots).astype(np.int32)),
            "id": pa.array(ident, mask=ident == _NO_ID), "score": pa.array(score),
        })

    return run


def _best_rows(hits: DataFrame, k: int) -> DataFrame:
    """``hits`` with ``rank`` up to ``k``; Spark drops what cannot be among them before it moves rows."""
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floors(hits: DataFrame, shape: tuple[int, int], k: int) -> np.ndarray:
    """Score of the ``k``-th best of each anchor and slot, where there is one."""
    rows = hits.where(F.col("rank") == k).select("anchor", "slot", "score").toArrow()
    floor = np.full(shape, _LOW)
    floor[rows["anchor"].to_numpy(), rows["slot"].to_numpy()] = rows["score"].to_numpy()
    return floor


def _limits(scores: np.ndarray, there: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores within the limits of each positive; none where there is no positive."""
    low, high = np.full(scores.shape, _HIGH), np.full(scores.shape, _LOW)
    for at in zip(*np.nonzero(there)):
        s = int(scores[at])
        low[at], high[at] = -((-least * s) // 100), (most * s) // 100
    return low, high


# Mining ---------------------------------------------------------------------------------------


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    anchor_numbers: int = ANCHOR_NUMBERS, part_numbers: int = PART_NUMBERS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    For each row where ``is_anchor(id)`` holds, its first ``positives`` other rows of the same label, and for each of
    them the first ``negatives`` rows of other labels whose score is ``least`` to ``most`` hundredths of its own.
    """
    spark = vectors.sparkSession
    raw = usable(vectors, id_col, F.col("label") if label is None else label, vector_col)
    shape = raw.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim")).first()
    n, dim = shape["n"], max(1, shape["dim"])
    some = raw.select("vector").sample(min(1.0, REFERENCE_SAMPLE / max(1, n)), seed=11).limit(2 * REFERENCE_SAMPLE).toArrow()
    references = fit_references(whole_numbers(some["vector"], dim)) if some.num_rows else np.eye(1, dim)

    def stored(rows: DataFrame, expected: int, name: str) -> DataFrame:
        # The last key only parts rows that are equal in all others.
        parts = 1 + expected * (dim + REFERENCES) // part_numbers
        order = rows.repartitionByRange(parts, "cell", "near", "id", F.rand(5)).sortWithinPartitions("cell", "near")
        return settle(order, name)

    rows = stored(with_angles(raw, references, dim), n, "angles")
    pilot = stored(rows.where(F.pmod(F.xxhash64("id"), F.lit(PILOT)) == 0), n // PILOT, "pilot")
    keys = ("id", "label", "x", "norm", "angles")
    anchors = assign_positions(rows.where(is_anchor).select(*keys).dropDuplicates(["id", "label", "x"]), *keys)
    anchors = settle(anchors.drop("bucket"), "anchors")
    block = max(1, anchor_numbers // (dim + REFERENCES))
    path = scratch_path(spark, "hard-negatives")
    names = "anchor_id BIGINT, positive_id BIGINT, rank INT, negative_id BIGINT, positive_score BIGINT, negative_score BIGINT"
    spark.createDataFrame([], names).write.parquet(path)
    for at in range(0, anchors.count(), block):
        table = anchors.where((F.col("pos") >= at) & (F.col("pos") < at + block)).toArrow()
        _mine_block(spark, table, rows, pilot, positives, negatives, least, most).write.mode("append").parquet(path)
    return spark.read.schema(names).parquet(path)


def _mine_block(spark, table: pa.Table, rows, pilot, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    m = table.num_rows
    block = {
        "id": table["id"].to_numpy(), "label": table["label"].to_numpy(), "norm": table["norm"].to_numpy(),
        "x": matrix(table["x"]), "angles": matrix(table["angles"]),
    }

    def search(where: DataFrame, limits: dict, slots: int, k: int, same_label: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(block | limits)
        return _best_rows(where.mapInArrow(_search(sent, slots, k, same_label), _HITS), k)

    limits = {"least": np.full((m, 1), _LOW), "most": np.full((m, 1), _HIGH), "floor": np.full((m, 1), _LOW)}
    limits["floor"] = _floors(search(pilot, limits, 1, positives, True), (m, 1), positives)
    chosen = settle(search(rows, limits, 1, positives, True), "positives")
    found = chosen.toArrow()  # at most as many as a block has anchors, times the positives
    scores, there = np.zeros((m, positives), np.int64), np.zeros((m, positives), bool)
    place = found["anchor"].to_numpy(), found["rank"].to_numpy() - 1
    scores[place], there[place] = found["score"].to_numpy(), True
    low, high = _limits(scores, there, least, most)
    limits = {"least": low, "most": high, "floor": np.full((m, positives), _LOW)}
    limits["floor"] = _floors(search(pilot, limits, positives, negatives, False), (m, positives), negatives)
    mined = search(rows, limits, positives, negatives, False)
    ids = spark.createDataFrame(pa.table({"anchor": pa.array(range(m), pa.int32()), "anchor_id": table["id"]}))
    named = chosen.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = F.broadcast(named.join(F.broadcast(ids), "anchor"))  # of one block
    return mined.join(pairs, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mined_embeddings(vectors: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth vector, where every seventh vector's label is moved to the next of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("id") % 100 == 0, moved)
