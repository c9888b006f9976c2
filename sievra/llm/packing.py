"""Best-fit packing of token sequences with a swap-based local search.

Documents become token ids and a closing id; only what is longer than a sequence is cut. Pieces are dealt to groups
of bounded size, and each group is packed by itself: best fit by decreasing length first, then a local search that
moves a document, exchanges one for one or two for one between underfull sequences whenever that raises the sum of
squared fills, taking from the emptiest until it is gone, and ends when no sequence of the group has an exchange left
or the group has as few as its tokens need. The emptiest sequences of every group are opened again, so many that those
left closed lack less than a sixteenth of a sequence together or half of the group's pieces are open, and packed
together in at most half as many groups, until one group is left; so no task sees more than a group.

Cases: a null or empty text is its closing id alone, one piece of length 1. Rows without id are packed like others.
Repeated rows are packed as often as they occur. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sievra.session import settle

CAPACITY = 2048
GROUP_ROWS = 8192
CLOSED_LACK = 16
MOST_REMEMBERED = 300_000

_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which may begin a token of letters
_LAST_LATIN = "\u024f"  # up to here letters are single code points in their composed form


def _byte_signs() -> list[str]:
    """The sign a byte-level vocabulary writes for each byte: visible Latin-1 ones stand for themselves, others follow 255."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


_BYTE_SIGNS = _byte_signs()


class WordIds(dict):
    """Token ids of words, as bytes of unsigned 32-bit numbers, the last ``MOST_REMEMBERED`` new ones and as many older.

    Valid for byte-level tokenizers that lower-case, drop white space and part letters from marks, so that words between
    white space do not influence each other, nor letters and marks in a word; ASCII letters are lowered first, which such a
    tokenizer does anyway. Words of Latin letters go straight to the library's merges.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.older: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, text: str) -> bytes:
        """Token ids of small Latin letters, which nothing splits or changes before merges are made."""
        if not text.isascii():
            text = "".join(map(_BYTE_SIGNS.__getitem__, text.encode()))
        return np.array([token.id for token in self.model.tokenize(text)], "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            core = word.rstrip(_MARKS)  # a letter and a mark never share a token
            text = core.decode()
            if not (text.isalpha() and max(text) <= _LAST_LATIN and text == text.lower()):
                ids = self._encode(word.decode())
            elif len(core) == len(word):
                ids = self._letters(text)
            else:
                ids = self[core] + self[word[len(core) :]]
        if len(self) >= MOST_REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def ids(self, raw: bytes) -> bytes:
        """All ids of a text in UTF-8."""
        if b"<|" in raw:  # special strings are found before letters are lowered
            return self._encode(raw.decode())
        return b"".join(map(self.__getitem__, raw.lower().split()))


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def document_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, closing: int, with_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])`` of every document."""

    def run(batches):
        words = encoder(path)
        end = np.array([closing], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("row", "piece", "start", "length", "ids_crc32", "ids")}
            for row, text in enumerate(batch.column(1)):
                ids = words.ids((text.as_py() or "").encode()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    values = (row, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)
                    for column, value in zip(out.values(), values):
                        column.append(value)
            columns = [batch.column(0).take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32())]
            columns += [pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32")]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(out["ids"], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    schema = "id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT" + (", ids BINARY" if with_ids else "")
    return rows.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length: longest first, into the fullest bin that has room, else a new one."""
    bins = np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of ``rooms``: a bin with r free places exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, n
            n += 1
        bins[i] = b
        left = room - size
        if left:
            with_room[left].append(b)
            rooms |= 1 << left
    return bins


class LocalSearch:
    """Exchanges between underfull bins that raise the sum of squared fills.

    What a bin can hand over, nothing, one piece or two, is kept as sorted numbers ``bin * width + tokens``. The best
    exchange of ``given`` tokens with a bin is the one that fills it most, so it takes the least amount that makes room:
    one search in those numbers. A bin has few amounts, since different sizes add up to at most its capacity.
    """

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.width = capacity + 1
        self.fill = np.bincount(bins, weights=lengths).astype(np.int64)
        self.moves = 0
        self.changed = np.zeros(len(self.fill), np.int64)  # the move that a bin took part in last
        self.asked = np.full(len(self.fill), -1)  # the move after which nothing could be taken from a bin

    def _amounts(self) -> None:
        """The amounts of all bins: ``ones`` of no piece or one, ``twos`` of two."""
        keys, n = np.unique(self.bins * self.width + self.lengths, return_counts=True)
        twos, b = [(2 * keys - keys // self.width * self.width)[n > 1]], keys // self.width
        for apart in range(1, len(keys)):
            same = np.flatnonzero(b[apart:] == b[:-apart])
            if not len(same):
                break
            twos.append(keys[same] + keys[same + apart] % self.width)
        self.twos = np.unique(np.concatenate(twos))
        self.ones = np.union1d(np.arange(len(self.fill)) * self.width, keys)

    def _own(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The amounts of one and of two pieces of a bin."""
        sizes, n = np.unique(self.lengths[self.bins == b], return_counts=True)
        x, y = np.triu_indices(len(sizes), 1)
        return sizes, np.unique(np.concatenate([2 * sizes[n > 1], sizes[x] + sizes[y]]))

    def _pieces(self, b: int, amount: int, two: bool) -> list[int]:
        """One or two pieces of a bin of so many tokens together; none for no tokens."""
        rows = np.flatnonzero(self.bins == b)
        if not two:
            return rows[self.lengths[rows] == amount][:1].tolist()
        place = {int(n): int(i) for i, n in zip(rows, self.lengths[rows])}
        for i in rows.tolist():
            other = place.get(amount - int(self.lengths[i]), i)
            if other != i:
                return [i, other]
        raise ValueError(f"no two pieces of {amount} tokens")

    def _put(self, rows: list[int], b: int) -> None:
        for i in rows:
            self.fill[self.bins[i]] -= self.lengths[i]
            self.fill[b] += self.lengths[i]
            self.bins[i] = b

    def _renew(self, b: int) -> None:
        """The amounts of a bin whose pieces are others now."""
        one, two = self._own(b)
        low, high = b * self.width, (b + 1) * self.width
        for name, values in (("ones", np.concatenate([[0], one])), ("twos", two)):
            keys = getattr(self, name)
            x, y = np.searchsorted(keys, (low, high))
            setattr(self, name, np.concatenate([keys[:x], low + values, keys[y:]]))
        self.changed[b] = self.moves

    def _best(self, giving: int, given: np.ndarray, into: np.ndarray, keys: np.ndarray) -> tuple[int, int, int, int]:
        """``(gain, given, bin, taken)`` of the best exchange of an amount for one of ``keys``; gain 0 if there is none."""
        best = (0, 0, 0, 0)
        if not len(keys) or not len(into):
            return best
        base, room, more_full = into * self.width, self.capacity - self.fill[into], self.fill[into] - self.fill[giving]
        rows = max(1, 1_000_000 // len(into))
        for at in range(0, len(given), rows):
            some = given[at : at + rows, None]
            found = keys[np.minimum(np.searchsorted(keys, base + np.maximum(some - room, 0)), len(keys) - 1)] - base
            more = some - found
            real = (found >= 0) & (more > 0) & (more <= room)
            gain = np.where(real, 2 * more * (more_full + more), 0)
            top = int(gain.argmax())
            if gain.flat[top] > best[0]:
                g, b = divmod(top, len(into))
                best = (int(gain.flat[top]), int(some[g, 0]), int(into[b]), int(found[g, b]))
        return best

    def _step(self, giving: int) -> bool:
        """The best exchange that takes from ``giving``; False if none raises the sum of squared fills.

        Two for one and one for two are tried if there is no move and no exchange of one for one. If neither this bin nor
        another has changed since it was asked, the answer is the same, so only changed ones are asked again.
        """
        open_bins = (self.fill > 0) & (self.fill < self.capacity)
        if self.changed[giving] <= self.asked[giving]:
            open_bins &= self.changed > self.asked[giving]
        open_bins[giving] = False
        into = np.flatnonzero(open_bins)
        if not len(into):
            return False
        one, two = self._own(giving)
        gain, given, b, taken = self._best(giving, one, into, self.ones)
        give_two = take_two = False
        if not gain:
            ways = (self._best(giving, one, into, self.twos), self._best(giving, two, into, self.ones))
            take_two, give_two = ways[0][0] >= ways[1][0], ways[0][0] < ways[1][0]
            gain, given, b, taken = max(ways, key=lambda way: way[0])
        if not gain:
            self.asked[giving] = self.moves
            return False
        out, back = self._pieces(giving, given, give_two), self._pieces(b, taken, take_two)
        self._put(out, b)
        self._put(back, giving)
        self.moves += 1
        self._renew(giving)
        self._renew(b)
        return True

    def run(self) -> np.ndarray:
        """Bins after the search: it ends when there are as few as the tokens need, or no bin has an exchange left.

        It does end, for every exchange raises an integer sum that has a bound.
        """
        least = -(-int(self.lengths.sum()) // self.capacity)
        left = int((self.fill > 0).sum())
        if left > least:
            self._amounts()
        before = -1
        while left > least and self.moves > before:
            before = self.moves
            for b in np.argsort(self.fill, kind="stable").tolist():
                while left > least and 0 < self.fill[b] < self.capacity and self._step(b):
                    left -= self.fill[b] == 0
        return self.bins


def _to_open(fill: np.ndarray, pieces: np.ndarray, capacity: int) -> np.ndarray:
    """The emptiest bins: what stays closed lacks less than ``capacity / CLOSED_LACK`` together, or half the pieces are open."""
    order = np.argsort(fill, kind="stable")
    lack = (capacity - fill)[order]
    behind = lack.sum() - np.cumsum(lack) + lack  # what is lacking from this bin on
    opened = np.zeros(len(fill), bool)
    opened[order] = (lack > 0) & (behind * CLOSED_LACK >= capacity) & (2 * np.cumsum(pieces[order]) <= pieces.sum())
    return opened


def _pack_group(capacity: int, level: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy().astype(np.int64)
        search = LocalSearch(lengths, best_fit(lengths, capacity), capacity)
        bins = search.run()
        used, bins = np.unique(bins, return_inverse=True)
        opened = np.zeros(len(used), bool) if last else _to_open(search.fill[used], np.bincount(bins), capacity)
        order = np.lexsort((np.arange(len(bins)), bins))
        ends = np.cumsum(lengths[order])
        before = ends - lengths[order]
        first = np.searchsorted(bins[order], np.arange(len(used)))
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - before[first][bins[order]]
        group = key[0].as_py()
        out = table.drop_columns(["group"])
        out = out.append_column("sequence_id", pa.array((level << 56) + (group << 24) + bins, pa.int64()))
        out = out.append_column("offset", pa.array(offset, pa.int64()))
        return out.append_column("opened", pa.array(opened[bins]))

    return run


def place_in_file() -> Column:
    """A number for each row of a written table that is the same whenever the table is read."""
    return F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index"))


def assign(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces``, a written table with a ``length``, with ``sequence_id`` and ``offset`` of each row.

    Groups are dealt by the place of a row in the written files, so repeated keys spread like any other.
    """
    columns = pieces.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    schema = f"{fields}, sequence_id BIGINT, offset BIGINT, opened BOOLEAN"
    done, level, rows = None, 0, pieces
    groups = None
    while True:
        needed = max(1, -(-rows.count() // group_rows))
        groups = needed if groups is None else min(needed, max(1, groups // 2))
        dealt = rows.withColumn("group", F.pmod(place_in_file(), F.lit(groups)))
        packed = dealt.groupBy("group").applyInArrow(_pack_group(capacity, level, groups == 1), schema)
        packed = settle(packed, f"packed-{level}")
        closed = packed.where("NOT opened").drop("opened")
        done = closed if done is None else done.unionByName(closed)
        if groups == 1:
            return done
        rows, level = settle(packed.where("opened").select(*columns), f"opened-{level}"), level + 1


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, closing: int = 0
) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32, sequence_id, offset)``: where every piece of every document goes."""
    pieces = settle(document_pieces(docs, path, id_col, text_col, capacity, closing), "pieces")
    return assign(pieces, capacity).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, packed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """``(sequence_id, ids)``: the packed sequences themselves, for documents with an id of their own each."""
    ids = document_pieces(docs, path, id_col, text_col, capacity, closing, with_ids=True).select("id", "piece", "ids")
    rows = ids.withColumnRenamed("id", id_col).join(packed.select(id_col, "piece", "sequence_id", "offset"), [id_col, "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    binary = F.aggregate(parts, F.lit(b""), lambda all_ids, part: F.concat(all_ids, part["ids"]))
    return rows.groupBy("sequence_id").agg(binary.alias("ids"))
