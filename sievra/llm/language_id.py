"""Language identification by prediction by partial matching.

For every language, a tree of byte contexts of up to ``order`` bytes holds how often each byte followed. A byte is coded
in its longest known context; one that the context has not seen costs an escape and is coded in the next shorter
one, without the bytes that the longer has already ruled out, down to all 256 bytes alike. Statistics are
frozen after training, so the exact code length of a byte depends on its context alone: training works out the
length of every (context, byte, language), and scoring a text is a walk along its contexts and a sum. The language of
the shortest code wins, and the score is its probability if all languages are equally likely beforehand.

The contexts of all languages form one tree, looked up once per byte. Code lengths are kept for the (context, byte) pairs that
occur; any other byte costs what it does in the next shorter context, and a cost of the context on top. Every context
seen ``min_count`` times stays, so the size follows the texts learned from, about ``rows`` of each language; a pair that occurs
has a number for every language. Whole texts are scored, in pieces of bounded size.

Cases: a null text, or one without a letter, is ``und`` with a score of 0. Ties go to the language of the smaller name.
Null languages, texts and repeated texts are not learned from. Without any text to learn from, all texts are ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sievra.llm.links import unused
from sievra.llm.words import give_back, text_buffers
from sievra.session import settle

ORDER = 4
TRAIN_ROWS = 1000
# The limit of the filter: share above what held-out texts cost, bits that any text may cost besides, bytes from which a
# text counts for the limit, and how many such texts it takes.
MARGIN, START_BITS, LONG, FEWEST = 1.25, 32, 64, 100
MIN_COUNT = 3
_PIECE = 1 << 18


class Lookup:
    """Places of 64-bit keys (not negative, each once) in an open hash table."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys) + 1).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.places = np.zeros(len(self.slots), np.int32)
        left, at = np.arange(len(keys)), self._start(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[left[free]]
            mine = self.slots[at] == keys[left]
            self.places[at[mine]] = left[mine]
            left, at = left[~mine], (at[~mine] + 1) & (len(self.slots) - 1)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is not there."""
        at = self._start(keys)
        there = self.slots[at]
        out = np.where(there == keys, self.places[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.slots) - 1)
            there = self.slots[at]
            hit = there == keys[left]
            out[left[hit]] = self.places[at[hit]]
            more = ~hit & (there >= 0)
            left, at = left[more], at[more]
        return out


@dataclass
class ContextTree:
    """Frozen statistics: the tree of contexts and the code lengths, in bits, of the (context, byte class) pairs that occur."""

    languages: list[str]
    classes: np.ndarray  # byte -> class
    width: int  # number of classes
    parent: np.ndarray  # node -> node of the context one byte shorter
    edges: Lookup  # node * width + class of the byte further back -> node - 1
    pairs: Lookup  # node * width + class -> row of bits; node 0 has every class
    bits: np.ndarray  # (pair, language)
    seen: np.ndarray  # (pair, language): whether the language has the pair
    known: np.ndarray  # (node, language): bits on top of the next shorter context's if the language has the byte there
    other: np.ndarray  # (node, language): the same if it has not
    order: int

    def costs(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Bits of byte classes in their contexts: ``(bytes, languages)``."""
        place = self.pairs.find(node * self.width + symbol)
        out = self.bits[place]
        left = np.flatnonzero(place < 0)
        if not len(left):
            return out
        out[left] = 0
        below = node[left].astype(np.int64)
        while len(left):
            shorter = self.parent[below]
            place = self.pairs.find(shorter * self.width + symbol[left])
            there = place >= 0
            at, row = left[there], place[there]
            out[at] += self.bits[row] + np.where(self.seen[row], self.known[below[there]], self.other[below[there]])
            out[left[~there]] += self.other[below[~there]]
            left, below = left[~there], shorter[~there]
        return out

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths in bits: ``(rows, languages)``."""
        n = len(raw)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for a in range(0, n, _PIECE):
            b = min(n, a + _PIECE)
            lead = min(a, self.order)
            symbols = self.classes[raw[a - lead : b]]
            # How many bytes of the same text stand before each byte.
            first, last = np.searchsorted(offsets, [a, b], "right") - 1
            starts = offsets[first : last + 1]
            row_of = np.searchsorted(offsets, np.arange(a, b), "right") - 1 if first != last else None
            begin = offsets[row_of] if row_of is not None else np.full(b - a, offsets[first])
            before = np.arange(a, b) - begin
            node = np.zeros(b - a, np.int64)
            deeper = np.arange(b - a)
            for back in range(1, self.order + 1):
                previous = symbols[np.maximum(np.arange(lead - back, lead - back + b - a), 0)]
                deeper = deeper[before[deeper] >= back]
                step = self.edges.find(node[deeper] * self.width + previous[deeper]) + 1
                deeper, step = deeper[step > 0], step[step > 0]
                node[deeper] = step
            costs = self.costs(node, symbols[lead:])
            if row_of is None:
                out[first] += costs.sum(axis=0, dtype=np.float64)
            else:
                places = np.unique(np.clip(starts - a, 0, b - a))
                places = np.concatenate([[0], places[(places > 0) & (places < b - a)]])
                out[row_of[places]] += np.add.reduceat(costs, places, axis=0, dtype=np.float64)
        return out


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """``(lang, gram, n)``: how often each run of ``order`` + 1 bytes occurs in ``texts(lang, text)``, the newest byte lowest.

    Bytes before a text's first are missing: a gram's number is marked by a leading 1 above its bytes, so shorter
    runs at the start of a text are told apart.
    """

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            raw, offsets = text_buffers(batch.column(1))
            at = np.arange(len(raw))
            row = np.searchsorted(offsets, at, "right") - 1
            before = at - offsets[row]
            for lang in sorted(set(langs)):
                mine = np.flatnonzero(langs[row] == lang)
                grams = raw[mine].astype(np.int64)
                for back in range(1, order + 1):
                    there = before[mine] >= back
                    older = raw[np.maximum(mine - back, 0)].astype(np.int64) << (8 * back)
                    grams = np.where(there, grams + older, np.where(before[mine] == back - 1, grams + (1 << (8 * back)), grams))
                grams = np.where(before[mine] >= order, grams + (1 << (8 * (order + 1))), grams)
                values, counts = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts, pa.int64())], ["lang", "gram", "n"]
                )

    counted = texts.select("lang", "text").mapInArrow(run, "lang STRING, gram BIGINT, n BIGINT")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def training_texts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """``(lang, text)``: about ``rows`` different texts of each language, chosen by a hash of the text.

    Two passes: a count by language, which sets each language's share, then a filter; nothing is sorted.
    """
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    totals = known.groupBy("lang").agg(F.count("*").alias("total"))
    share = F.lit(float(rows)) / F.col("total") * 2.0**31
    chosen = known.join(F.broadcast(totals), "lang").where(F.pmod(F.xxhash64("text"), F.lit(2**31)) < share)
    return chosen.select("lang", "text").distinct()


def _symbols(grams: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each gram, newest first, and how many of them are context."""
    marks = np.zeros(len(grams), np.int64)
    for length in range(1, order + 2):
        marks[(grams >> (8 * length)) == 1] = length - 1
    return np.stack([(grams >> (8 * i)) & 255 for i in range(order + 1)], axis=1), marks


def grow(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, min_count: int = MIN_COUNT) -> ContextTree:
    """The tree over ``counts``: language -> (grams, how often). Contexts seen less than ``min_count`` times are left out."""
    languages = sorted(counts)
    symbols, marks = _symbols(np.concatenate([counts[lang][0] for lang in languages]), order)
    n = np.concatenate([counts[lang][1] for lang in languages]).astype(np.float64)
    owner = np.repeat(np.arange(len(languages)), [len(counts[lang][0]) for lang in languages])
    seen = np.unique(symbols[:, 0])
    classes = np.zeros(256, np.int64)  # class 0: bytes that training has not seen
    classes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    # Level by level: the node of every gram's context of so many bytes, as long as it is known.
    use, node, nodes = np.arange(len(n)), np.zeros(len(n), np.int64), 1
    edges, parent = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    keys, rows = [np.arange(width)], []  # all classes of the root are pairs
    for depth in range(order + 1):
        if depth:
            there = marks[use] >= depth
            use, node = use[there], node[there]
            key, back = np.unique(node * width + classes[symbols[use, depth]], return_inverse=True)
            keep = np.bincount(back, n[use], len(key)) >= min_count
            number = np.where(keep, nodes - 1 + np.cumsum(keep), 0)
            edges.append(key[keep])
            parent.append(key[keep] // width)
            nodes += int(keep.sum())
            use, node = use[keep[back]], number[back[keep[back]]]
        pair = node * width + classes[symbols[use, 0]]
        keys.append(np.unique(pair))
        rows.append((use, pair))
    pairs = np.unique(np.concatenate(keys))
    table = np.zeros((len(pairs), len(languages)))
    for use, pair in rows:
        np.add.at(table, (np.searchsorted(pairs, pair), owner[use]), n[use])
    parent = np.concatenate(parent)
    bits, known, other = _code_lengths(pairs, table, parent, width)
    return ContextTree(
        languages, classes, width, parent, Lookup(np.concatenate(edges)), Lookup(pairs), bits.astype(np.float32), table > 0,
        known.astype(np.float32), other.astype(np.float32), order,
    )


def _code_lengths(pairs: np.ndarray, counts: np.ndarray, parent: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of every pair, and of every node on top of its parent's: escapes by distinct bytes (method C), with exclusion."""
    node, nodes = pairs // width, len(parent)
    first = np.searchsorted(node, np.arange(nodes))
    has = counts > 0
    total, kinds = np.add.reduceat(counts, first), np.add.reduceat(has.astype(np.float64), first)
    shorter = np.searchsorted(pairs, parent[node] * width + pairs % width)  # the same byte in the parent
    # What the parent has beyond the node: an escape goes on among that, without the bytes the node has.
    some = total[parent] - np.add.reduceat(np.where(has, counts[shorter], 0), first)
    new_kinds = kinds[parent] - kinds
    leave = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
    escape = np.where(some > 0, new_kinds / np.maximum(some + new_kinds, 1), 1.0)
    # A language that has never seen a context codes in the next shorter one, at no cost.
    at_work = total > 0
    beyond = leave * (total + kinds)[parent] / np.maximum(some + new_kinds, 1)
    known = np.where(at_work & (some > 0), -np.log2(np.where(at_work, beyond, 1.0)), 0.0)
    other = np.where(at_work, -np.log2(leave * escape / leave[parent]), 0.0)
    own = -np.log2(np.where(has, counts / np.maximum(total + kinds, 1)[node], 1.0))
    per_class = np.ones((width, 1))
    per_class[0] = 256 - (width - 1)
    left = np.where(has[:width], 0, per_class).sum(axis=0)
    bits = np.empty(counts.shape)
    bits[:width] = np.where(has[:width], own[:width], -np.log2(np.maximum(leave[0] / np.maximum(left, 1e-300), 1e-30)))
    # Parents have lower numbers, and a level is a range of nodes: bits of a level need those of the one before.
    depth = np.zeros(nodes, np.int64)
    for v in range(1, nodes):
        depth[v] = depth[parent[v]] + 1
    for level in range(1, int(depth.max(initial=0)) + 1):
        i = np.flatnonzero(depth[node] == level)
        up = shorter[i]
        bits[i] = np.where(has[i], own[i], bits[up] + np.where(has[up], known[node[i]], other[node[i]]))
    return bits, known, other


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, rows: int = TRAIN_ROWS) -> ContextTree | None:
    """The frozen tree of the languages in ``docs``; None if there is nothing to learn from.

    Counting runs in tasks; the driver gets the grams of the bounded sample that occur more than once.
    """
    texts = settle(training_texts(docs, text_col, lang_col, rows), "lang-sample")
    table = gram_counts(texts, order).toArrow()
    if not table.num_rows:
        return None
    langs = np.array(table.column("lang").to_pylist(), object)
    grams, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    return grow({lang: (grams[langs == lang], n[langs == lang]) for lang in sorted(set(langs.tolist()))}, order)


def identify(
    docs: DataFrame, tree: ContextTree | None, text_col: str = "text", names: tuple = ("lang_pred", "score", "bits_per_byte")
) -> DataFrame:
    """``docs`` with the columns ``names``: language, score and bits per byte of the winner; columns of these names are replaced."""
    docs = docs.drop(*names)
    if tree is None:
        return docs.withColumns(dict(zip(names, (F.lit("und"), F.lit(0.0), F.lit(None).cast("double")))))
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    at, fields = docs.columns.index(text_col), [*docs.columns, *names]

    def run(batches):
        model = shared.value
        languages = np.array(model.languages, object)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(at))
            if not batch.num_rows:
                continue
            lengths = model.score(raw, offsets)
            best = lengths.argmin(axis=1)
            least = lengths[np.arange(len(best)), best]
            score = 1.0 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1)
            no_letter = ~batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            size = np.diff(offsets)
            columns = list(batch.columns[:-1])
            columns.append(pa.array(np.where(no_letter, "und", languages[best]), pa.string()))
            columns.append(pa.array(np.where(no_letter, 0.0, score), pa.float64()))
            columns.append(pa.array(least / np.maximum(size, 1), pa.float64(), mask=size == 0))
            yield pa.RecordBatch.from_arrays(columns, fields)
        give_back()

    flag = unused(docs, "has_letter")
    letter: Column = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    added = [StructField(n, kind) for n, kind in zip(names, (StringType(), DoubleType(), DoubleType()))]
    schema = StructType([*docs.schema.fields, *added])
    return docs.withColumn(flag, letter).mapInArrow(run, schema)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id is as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id_col, held_out, lang_pred, score)``: trained on what is not held out, predicted from the text alone."""
    tree = train(docs.where(~held_out(id_col, 4, 2)), text_col, lang_col)
    rows = docs.select(id_col, held_out(id_col, 4, 2).alias("held_out"), text_col)
    return identify(rows, tree, text_col).select(id_col, "held_out", "lang_pred", "score", "bits_per_byte")


def usual_bits(docs: DataFrame, tree: ContextTree, text_col: str = "text", lang_col: str = "lang") -> float | None:
    """Bits per byte that 99 of 100 texts of ``docs`` with a language stay below; None if there are too few to tell.

    All of them are scored; texts under ``LONG`` bytes are left out, for they pay mostly for their beginning.
    """
    texts = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) >= LONG)).select(text_col)
    names = tuple(unused(texts, n) for n in ("lang_pred", "score", "bits_per_byte"))
    found = identify(texts, tree, text_col, names).where(F.col(names[0]) != "und")
    row = found.agg(F.count("*").alias("n"), F.percentile_approx(names[2], 0.99, 1000).alias("bits")).first()
    return row["bits"] if row["n"] >= FEWEST else None


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.0, max_bits: float | None = None
) -> DataFrame:
    """``docs`` without texts of no learned language: no letter, or a code that is longer than theirs. All columns as they were.

    A text goes if its bits per byte exceed ``max_bits`` and ``START_BITS`` spread over its bytes. By default ``max_bits`` is
    ``MARGIN`` times what 99 of 100 held-out texts of the learned languages stay below (:func:`usual_bits`), or 8, which
    is writing the bytes down, where fewer than ``FEWEST`` are held out. A short text may fit several languages alike;
    ``min_score`` above 0 lets such texts go, too.
    """
    held = held_out(id_col, 4, 2)
    tree = train(docs.where(~held), text_col, lang_col)
    if tree is None:
        return docs
    if max_bits is None:
        usual = usual_bits(docs.where(held), tree, text_col, lang_col)
        max_bits = 8.0 if usual is None else MARGIN * usual
    names = tuple(unused(docs, n) for n in ("lang_pred", "score", "bits_per_byte"))
    found = identify(docs, tree, text_col, names)
    lang, score, bits = (F.col(n) for n in names)
    most = max_bits + START_BITS / F.octet_length(text_col)
    return found.where((lang != "und") & (score >= min_score) & (bits <= most)).select(*docs.columns)
