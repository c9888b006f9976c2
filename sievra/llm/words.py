"""Words and shingles of whole Arrow batches as 64-bit hashes, in vectorised numpy.

A batch is one byte buffer with row offsets. It is worked through in pieces of about ``PIECE`` bytes that end
at a separator or at the end of a row, so memory beyond the hashes themselves does not depend on the length of
a text. Hashes are sums of per-byte random numbers times powers of an odd base modulo 2**64, finished by a
mixing step; they depend on the bytes of a word alone and are the same in every task and run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 3
_RNG = np.random.default_rng(20240607)
_BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

WHITESPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
# Letters and digits of ASCII and every byte of a longer UTF-8 sequence belong to words.
NOT_ALPHANUMERIC = ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def _lowered() -> np.ndarray:
    table = _BYTE_VALUES.copy()
    table[65:91] = table[97:123]
    return table


_LOWER_VALUES = _lowered()


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            table = np.multiply.accumulate(steps)
            if size > 4 * PIECE:  # a single huge word: do not keep its table
                return table, _power_tables_once(size, pow(_BASE, -1, 1 << 64))
            _powers[name] = table
    return _powers["up"], _powers["down"]


def _power_tables_once(size: int, base: int) -> np.ndarray:
    steps = np.full(size, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    ends = ends.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def _cuts(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray, piece: int) -> list[int]:
    """Places to cut the bytes, each after a separator or at the end of a row."""
    cuts, at, n = [0], 0, len(raw)
    while n - at > piece:
        goal = at + piece
        row_end = int(offsets[np.searchsorted(offsets, goal, "right") - 1])
        found = np.flatnonzero(separators[raw[max(at, goal - 65536) : goal]])
        cut = max(row_end, max(at, goal - 65536) + int(found[-1]) + 1 if len(found) else 0)
        while cut <= at:  # one word fills the piece: go on to where it ends
            stop = min(n, goal + piece)
            after = np.flatnonzero(separators[raw[goal:stop]])
            bound = int(offsets[np.searchsorted(offsets, goal, "left")])
            cut = min(goal + int(after[0]) + 1 if len(after) else n, bound)
            if not len(after) and bound > stop and stop < n:
                cut, goal = at, stop
        cuts.append(cut)
        at = cut
    return [*cuts, n]


def word_hashes(
    raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITESPACE, lower: bool = True, piece: int = PIECE
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, per row, where its words begin: ``(hashes, n_rows + 1 places)``.

    A word is a maximal run of bytes that are not ``separators``; ``lower`` folds A-Z.
    """
    values = _LOWER_VALUES if lower else _BYTE_VALUES
    hashes, begins = [], []
    cuts = _cuts(raw, offsets, separators, piece)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        part = raw[a:b]
        inside = ~separators[part]
        lo, hi = np.searchsorted(offsets, [a, b], "left")
        edges = offsets[lo:hi] - a
        edges = edges[(edges > 0) & (edges < b - a)]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[edges - 1] = inside[edges - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(start):
            continue
        up, down = _power_tables(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[part] * up[: b - a], out=sums[1:])
        hashes.append(mix((sums[end] - sums[start]) * down[start]))
        begins.append(start + a)
    found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    place = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return found, np.searchsorted(place, offsets, "left")


def shingle_hashes(words: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` successive words of each row: ``(hashes, n_rows + 1 places)``, with repetitions.

    A row of fewer than ``k`` words has one shingle, its whole sequence; a row without words has none.
    """
    counts = np.diff(starts)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    places = np.concatenate([[0], np.cumsum(n)])
    if not places[-1]:
        return np.zeros(0, np.uint64), places
    # Position of each shingle's first word: the row's first word plus the rank of the shingle in the row.
    first = np.arange(places[-1]) + np.repeat(starts[:-1] - places[:-1], n)
    ends = np.repeat(starts[1:], n)
    total = np.repeat(np.minimum(counts, k), n).astype(np.uint64) * _PLACES[-1]
    for j in range(k):
        at = first + j
        there = at < ends
        total += np.where(there, words[np.minimum(at, len(words) - 1)], np.uint64(0)) * _PLACES[j]
    return mix(total), places


def distinct_by_row(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes sorted and without repetitions."""
    out = []
    for a, b in zip(places[:-1], places[1:]):
        row = np.sort(hashes[a:b])
        out.append(row[np.concatenate([[True], row[1:] != row[:-1]])] if b > a else row)
    sizes = np.array([len(r) for r in out], np.int64)
    return (np.concatenate(out) if out else hashes[:0]), np.concatenate([[0], np.cumsum(sizes)])


def pieces_of(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` items each (a longer row stands alone), so that temporaries stay bounded."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        out.append((at, min(end, n)))
        at = min(end, n)
    return out


def give_back() -> None:
    """Return memory that a finished task no longer uses: workers live on, and their next task may need it elsewhere."""
    pa.default_memory_pool().release_unused()


def long_lists(values: np.ndarray, places: np.ndarray) -> pa.Array:
    """Rows of 64-bit numbers as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(values.view(np.int64), pa.int64()))
