"""K-means for several parts of the vectors at once, with the same centres however the vectors are partitioned.

A training takes whole passes over a sample: every task works on all parts (one for inverted lists, one per sub-vector
for codes) and hands on a row per part and centre. Sums are of whole numbers, which add up alike in any order, and
what is random is a hash of the vector itself, so neither the number of partitions nor a repeated task changes a centre.

Seeds are different vectors, drawn in a few rounds with a chance in proportion to their squared distance to the seeds
so far. After every pass a centre without vectors moves to the vector that lies farthest from its centre in one of the largest
lists, which splits that list. There are always as many centres as asked for; with fewer different vectors the last
ones are copies, which get no vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType

from sievra.operators.neighbours import matrix
from sievra.session import settle

SEED_ROUNDS = 4
# Cells of one distance matrix inside a task, lengths up to which it is made in single precision, and bits that the sum of all
# vectors may take.
MAX_CELLS = 1 << 21
MAX_SINGLE = 1e15
SUM_BITS = 61
_SUMS = "part INT, code INT, n BIGINT, sums ARRAY<BIGINT>, gap DOUBLE, name BIGINT, far ARRAY<DOUBLE>"


def nearest_centers(rows: np.ndarray, centers: np.ndarray, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ``n`` nearest centres per row, nearest first, lower position on ties, and their distances.

    A matrix product in single precision preselects, with an allowance for all its rounding; distances are summed row by row
    in double precision and rounded, so they do not depend on which rows come together.
    """
    n = min(n, len(centers))
    found, gaps = np.empty((len(rows), n), np.int64), np.empty((len(rows), n))
    length = np.sqrt((centers * centers).sum(axis=1))
    most = max(length.max(initial=0.0), np.sqrt((rows * rows).sum(axis=1).max(initial=0.0)))
    # Numbers whose squares single precision cannot hold are compared in double precision.
    kind = np.float32 if most < MAX_SINGLE else np.float64
    sides = np.concatenate([centers, (length * length)[:, None]], axis=1).astype(kind)
    # As many bytes in either precision.
    block = max(1, MAX_CELLS * 8 // sides.itemsize // max(1, len(centers)))
    error = 4.0 * (rows.shape[1] + 4) * np.finfo(kind).eps
    for at in range(0, len(rows), block):
        part = slice(at, at + block)
        found[part], gaps[part] = _nearest_of_block(rows[part], centers, sides, length.max(initial=0.0), error, n)
    return found, gaps


def _nearest_of_block(rows: np.ndarray, centers: np.ndarray, sides: np.ndarray, longest: float, error: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``sides``: the centres, each with its squared length, so one product gives all distances less the row's own length."""
    own = np.sqrt((rows * rows).sum(axis=1))
    rough = np.concatenate([-2.0 * rows, np.ones((len(rows), 1))], axis=1).astype(sides.dtype) @ sides.T
    if n == len(centers):
        kth = np.full(len(rows), np.inf)
    elif n == 1:
        first = rough.argmin(axis=1)
        kth = rough[np.arange(len(rows)), first]
    else:
        kth = np.partition(rough, n - 1, axis=1)[:, n - 1]
    limit = kth.astype(np.float64) + 2e-7 + error * (own + longest) ** 2
    # Rounded up, so that the limit is no lower in single precision.
    limit = np.nextafter(limit.astype(sides.dtype), sides.dtype.type(np.inf))
    if n == 1 < len(centers):
        # Most rows have one centre within the limit; only the others are looked through again.
        rough[np.arange(len(rows)), first] = np.inf
        own_first, more = np.flatnonzero(kth <= limit), np.flatnonzero(rough.min(axis=1) <= limit)
        r, c = np.nonzero(rough[more] <= limit[more, None])
        r, c = np.r_[own_first, more[r]], np.r_[first[own_first], c]
    else:
        r, c = np.nonzero(rough <= limit[:, None])
    exact = np.empty(len(r))
    for at in range(0, len(r), 1 << 16):
        part = slice(at, at + (1 << 16))
        exact[part] = np.round(((rows[r[part]] - centers[c[part]]) ** 2).sum(axis=1), 9)
    order = np.lexsort((c, exact, r))
    r, c, exact = r[order], c[order], exact[order]
    place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
    return c[place < n].reshape(len(rows), n), exact[place < n].reshape(len(rows), n)


@F.arrow_udf(BinaryType())
def _packed(column: pa.Array) -> pa.Array:
    """Vectors as the bytes of their numbers: passes over a table move them whole instead of number by number."""
    rows = np.ascontiguousarray(matrix(column)) if len(column) else np.zeros((0, 1))
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(np.float64).reshape(len(column), -1)


def _parts(column: pa.Array, parts: int) -> list[np.ndarray]:
    rows = _unpacked(column) if pa.types.is_binary(column.type) else matrix(column)
    width = rows.shape[1] // parts
    return [np.ascontiguousarray(rows[:, j * width : (j + 1) * width]) for j in range(parts)]


def _draws(rows: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of each row's numbers, and a random number in (0, 1) made of it and the seed."""
    bits = np.ascontiguousarray(rows + 0.0).view(np.uint64)
    rng = np.random.default_rng(seed)
    weights = rng.integers(0, 2**63, (2, rows.shape[1]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    name, other = ((bits ^ (bits >> np.uint64(29))) * w for w in weights)
    name, other = ((x ^ (x >> np.uint64(32))).sum(axis=1, dtype=np.uint64) for x in (name, other))
    other = (other ^ (other >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return name.view(np.int64), ((other >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _seed_pass(centers: list[np.ndarray], wanted: list[int], seed: int):
    """Per task and part the ``wanted`` rows that come first in a race whose speed is the distance to the nearest centre."""

    def run(batches):
        best: list[tuple] = [(np.zeros(0), np.zeros(0, np.int64), None)] * len(centers)
        for batch in batches:
            if not batch.num_rows:
                continue
            for j, rows in enumerate(_parts(batch.column(0), len(centers))):
                name, draw = _draws(rows, seed + j)
                speed = nearest_centers(rows, centers[j])[1][:, 0] if len(centers[j]) else np.ones(len(rows))
                moving = speed > 0
                key = -np.log(draw[moving]) / speed[moving]
                old_key, old_name, old_rows = best[j]
                key, name = np.r_[old_key, key], np.r_[old_name, name[moving]]
                rows = rows[moving] if old_rows is None else np.concatenate([old_rows, rows[moving]])
                _, once = np.unique(name, return_index=True)
                once = once[np.lexsort((name[once], key[once]))][: wanted[j]]
                best[j] = key[once], name[once], rows[once]
        for j, (key, name, rows) in enumerate(best):
            if len(key):
                yield pa.RecordBatch.from_pydict({
                    "part": np.full(len(key), j, np.int32), "key": key, "name": name, "row": _lists(rows),
                })

    return run


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))


def _last_keys(part: np.ndarray, key: np.ndarray, name: np.ndarray, wanted: list[int]) -> list[float]:
    """Of each part, the key of the last of the ``wanted`` first different rows."""
    last = []
    for j, n in enumerate(wanted):
        mine = np.unique(np.rec.fromarrays([key[part == j], name[part == j]]))
        last.append(mine["f0"][min(n, len(mine)) - 1] if n and len(mine) else -1.0)
    return last


def _seeds(sample: DataFrame, k: int, parts: int, seed: int, width: int) -> list[np.ndarray]:
    """``k`` different rows of each part, or all there are."""
    centers = [np.zeros((0, width))] * parts
    for step in range(SEED_ROUNDS):
        wanted = [-(-(k - len(c)) // (SEED_ROUNDS - step)) for c in centers]
        drawn = settle(
            sample.mapInArrow(_seed_pass(centers, wanted, seed + 1000 * step), "part INT, key DOUBLE, name BIGINT, row ARRAY<DOUBLE>"),
            "seeds",
        )
        # The driver sees keys, of each task and part at most as many as seeds are wanted, and the rows of the seeds.
        keys = drawn.select("part", "key", "name").toArrow()
        last = _last_keys(keys["part"].to_numpy(), keys["key"].to_numpy(), keys["name"].to_numpy(), wanted)
        limit = F.element_at(F.array(*[F.lit(float(x)) for x in last]), F.col("part") + 1)
        rows = drawn.where(F.col("key") <= limit).dropDuplicates(["part", "key", "name"]).toArrow()
        rows = rows.sort_by([("part", "ascending"), ("key", "ascending"), ("name", "ascending")])
        part, found = rows["part"].to_numpy(), matrix(rows["row"]) if rows.num_rows else np.zeros((0, width))
        centers = [np.concatenate([c, found[part == j][: wanted[j]]]) for j, c in enumerate(centers)]
        if all(len(c) == k for c in centers) or not rows.num_rows:
            break
    return centers


class _Totals:
    """Per centre of a part: rows, their sum in whole numbers, and the row farthest away (by its name, if several are)."""

    def __init__(self):
        self.held: dict[tuple[int, int], list] = {}

    def add(self, part: int, code: int, n: int, sums: np.ndarray, gap: float, name: int, far: np.ndarray) -> None:
        old = self.held.get((part, code))
        if old is None:
            self.held[part, code] = [n, sums, gap, name, far]
            return
        old[0], old[1] = old[0] + n, old[1] + sums
        if (gap, name) > (old[2], old[3]):
            old[2:] = [gap, name, far]

    def batches(self):
        items = list(self.held.items())
        if items:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([k[0] for k, _ in items], pa.int32()), "code": pa.array([k[1] for k, _ in items], pa.int32()),
                "n": pa.array([v[0] for _, v in items], pa.int64()), "sums": _lists(np.stack([v[1] for _, v in items])),
                "gap": pa.array([v[2] for _, v in items], pa.float64()), "name": pa.array([v[3] for _, v in items], pa.int64()),
                "far": _lists(np.stack([v[4] for _, v in items])),
            })


def _sum_pass(centers: list[np.ndarray], scale: float):
    def run(batches):
        totals = _Totals()
        for batch in batches:
            if not batch.num_rows:
                continue
            for j, rows in enumerate(_parts(batch.column(0), len(centers))):
                code, apart = (x[:, 0] for x in nearest_centers(rows, centers[j]))
                name, _ = _draws(rows, j)
                order = np.lexsort((name, apart, code))
                found, start, count = np.unique(code[order], return_index=True, return_counts=True)
                sums = np.add.reduceat(np.rint(rows[order] * scale).astype(np.int64), start)
                last = order[start + count - 1]
                for i, row in enumerate(last):
                    totals.add(j, int(found[i]), int(count[i]), sums[i], float(apart[row]), int(name[row]), rows[row])
        yield from totals.batches()

    return run


def _merge_pass(batches):
    totals = _Totals()
    for batch in batches:
        if batch.num_rows:
            sums, far = matrix_of_longs(batch.column("sums")), matrix(batch.column("far"))
            part, code, n, gap, name = (batch.column(c).to_pylist() for c in ("part", "code", "n", "gap", "name"))
            for i in range(batch.num_rows):
                totals.add(part[i], code[i], n[i], sums[i], gap[i], name[i], far[i])
    yield from totals.batches()


def matrix_of_longs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _step(sample: DataFrame, centers: list[np.ndarray], scale: float) -> list[np.ndarray]:
    """Centres after one pass; those without rows split the largest lists."""
    added = sample.mapInArrow(_sum_pass(centers, scale), _SUMS).repartition("part", "code").mapInArrow(_merge_pass, _SUMS)
    table = added.toArrow().sort_by([("part", "ascending"), ("code", "ascending")])
    part, code = table["part"].to_numpy(), table["code"].to_numpy()
    n, gap = table["n"].to_numpy(), table["gap"].to_numpy()
    means, far = matrix_of_longs(table["sums"]) / scale / n[:, None], matrix(table["far"])
    out = []
    for j, old in enumerate(centers):
        mine = part == j
        new = old.copy()
        new[code[mine]] = means[mine]
        empty = np.setdiff1d(np.arange(len(old)), code[mine])
        largest = np.lexsort((code[mine], -gap[mine], -n[mine]))
        largest = largest[gap[mine][largest] > 0][: len(empty)]
        new[empty[: len(largest)]] = far[mine][largest]
        out.append(new)
    return out


def _greatest(v: Column) -> Column:
    """The greatest absolute value of a vector."""
    return F.greatest(F.array_max(v), -F.array_min(v))


def train(sample: DataFrame, k: int, parts: int = 1, seed: int = 0, max_iter: int = 10, column: str = "embedding") -> np.ndarray:
    """Centres as an array of ``parts`` x ``k`` x width, for vectors cut in ``parts`` even parts.

    The driver and every task hold the centres; the sample stays where it is.
    """
    v = F.col(column).cast("array<double>")
    sample = settle(sample.select(_packed(v).alias("v"), F.size(v).alias("dim"), _greatest(v).alias("most")), "training")
    # Empty columns are nothing to sum over; the greatest number bounds every sum.
    shape = sample.agg(F.count("*").alias("n"), F.max("dim").alias("dim"), F.max("most").alias("most")).first()
    sample = sample.select("v")
    if not shape["n"] or not shape["dim"]:
        raise ValueError("no vectors to train on")
    if shape["dim"] % parts:
        raise ValueError(f"{parts} parts do not divide {shape['dim']} numbers")
    width = shape["dim"] // parts
    scale = 2.0 ** (SUM_BITS - int(np.ceil(np.log2(max(shape["n"] * max(shape["most"], 1e-9), 1e-9)))))
    scale = min(scale, 2.0 ** (SUM_BITS - 1 - int(np.ceil(np.log2(max(shape["most"], 1e-9))))))
    centers = _seeds(sample, k, parts, seed, width)
    for _ in range(max_iter):
        moved = _step(sample, centers, scale)
        same = all(np.array_equal(a, b) for a, b in zip(centers, moved))
        centers = moved
        if same:
            break
    return np.stack([c[np.arange(k) % len(c)] for c in centers])


def scatter(sample: DataFrame, column: str = "embedding", bits: int = 14) -> np.ndarray:
    """The covariance of the vectors, times a constant: sums of whole numbers again, so the same for any partitioning.

    Numbers are rounded to ``bits`` bits below the greatest; a task's products stay exact in doubles.
    """
    vectors = sample.select(F.col(column).cast("array<double>").alias("v"))
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(_greatest(F.col("v"))).alias("most")).first()
    n, dim, scale = shape["n"], shape["dim"], 2.0**bits / max(shape["most"], 1e-300)

    def products(batches):
        total = np.zeros((dim + 1, dim), np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = np.rint(matrix(batch.column(0)) * scale)
                total[:dim] += (rows.T @ rows).astype(np.int64)
                total[dim] += rows.sum(axis=0).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"row": np.arange(dim + 1, dtype=np.int32), "cells": _lists(total)})

    def add_up(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, cells in zip(batch.column("row").to_pylist(), matrix_of_longs(batch.column("cells")) if batch.num_rows else ()):
                held[row] = held[row] + cells if row in held else cells
        if held:
            yield pa.RecordBatch.from_pydict({"row": pa.array(list(held), pa.int32()), "cells": _lists(np.stack(list(held.values())))})

    kind = "row INT, cells ARRAY<BIGINT>"
    added = vectors.mapInArrow(products, kind).repartition("row").mapInArrow(add_up, kind)
    cells = matrix_of_longs(added.toArrow().sort_by("row")["cells"]).astype(np.float64)  # dimension by dimension numbers
    return cells[:dim] - np.outer(cells[dim], cells[dim]) / n
