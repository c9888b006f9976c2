"""Exact token counts by prefix dynamic programming over a byte-level pair-merging vocabulary.

The encoding of a prefix of a word ends in exactly one token ``t`` such that the rest of the prefix, encoded,
ends in a token that does not merge with ``t``: a sequence is a valid encoding if and only if all neighbours in it
are. One pass over the ends of a word therefore gives the exact count at every prefix, each from an earlier one:
count(end) = count(end - len(t)) + 1. Words are cut by the tokenizer's own pre-tokenizer, and counts of words add up
to counts of texts, so any budget or truncation question is answered from stored numbers without encoding again.

Texts are taken apart at single spaces and line feeds between visible characters, where the encoding of either side does not
depend on the other, and what is found in between is remembered in each worker up to a bounded number of entries.

Cases: null and empty texts have no tokens and one prefix, the empty one, of count 0. Strings of special tokens
inside a text count as the library counts them by default, one token each. Repeated rows are counted each.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType

MOST_REMEMBERED = 1_000_000
# Characters that are neither white space nor subject to the version of a library's tables.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_VISIBLE = f"[!-~{_LATIN}]"
_SAFE_SPACE = re.compile(f"(?<={_VISIBLE}) (?={_VISIBLE})")
# A line feed between such characters is a word by itself, and what follows starts anew.
_SAFE_LINE = re.compile(f"(?<={_VISIBLE})\n(?={_VISIBLE})")
_SAFE_PIECE = re.compile(f"{_VISIBLE}(?:.*{_VISIBLE})?", re.DOTALL)
_SAFE_CUT = re.compile(f"(?<={_VISIBLE})[ \n](?={_VISIBLE})")
# Latin letters, then marks that end sentences: two words for any pre-tokenizer of this kind.
_PLAIN = re.compile(f"( ?[{_LATIN}]+)([.,;:!?]*)")
UNSAFE = 1 << 40
_PART = 1 << 20
_WIDEST = 40  # longer words are counted one by one
_TOGETHER = 4096
_SLOT_BITS = 21


def byte_alphabet() -> dict[str, int]:
    """The published byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Counts by prefix for one tokenizer file (byte-level, no normaliser)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        spec = json.loads(library.to_str())
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("prefix counts need a byte-level pair-merging tokenizer without a normaliser")
        self.cut = library.pre_tokenizer.pre_tokenize_str
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if t not in specials}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.made_of = {a + b: (a, b) for a, b in self.ranks}
        if len(self.made_of) != len(self.ranks):
            raise ValueError("prefix counts need a vocabulary in which every token comes of one merge")
        self.never = len(self.ranks) + 1
        self.numbered = sorted(self.tokens)
        self._grow_tree()
        self.slot_keys = np.zeros(1 << _SLOT_BITS, np.int64)
        self.slot_answers = np.zeros(1 << _SLOT_BITS, bool)
        self.longest = max(map(len, self.tokens))
        specials.sort(key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.edges: tuple[dict, dict] = ({}, {})
        self.valid: dict[tuple[bytes, bytes], bool] = {}
        self.after_space, self.at_start = _Counts(self, " "), _Counts(self, "")

    def _grow_tree(self) -> None:
        """The vocabulary as a tree over bytes: steps sorted by (node, byte), where they lead, and the token there."""
        steps: dict[int, int] = {}
        token_at = [-1]
        for number, token in enumerate(self.numbered):
            node = 0
            for byte in token:
                node = steps.setdefault(node * 256 + byte, len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
            token_at[node] = number
        self.steps = np.array(sorted(steps), np.int64)
        self.step_to = np.array([steps[k] for k in sorted(steps)], np.int64)
        self.token_at = np.array(token_at, np.int64)

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The tokens on one edge of a token's merge tree, whole first, each with the rank of the merge that ends it."""
        known = self.edges[side].get(token)
        if known is None:
            known, ends = [], self.never
            while True:
                known.append((token, ends))
                if token not in self.made_of:
                    break
                parts = self.made_of[token]
                token, ends = parts[side], self.ranks[parts]
            self.edges[side][known[0][0]] = known
        return known

    def _apart(self, one: bytes, two: bytes) -> bool:
        """Whether two tokens stay two when they meet: no merge across comes before what each is made by.

        Of equal ranks the leftmost pair merges first, so one inside the left token wins over one across.
        """
        ranks = self.ranks
        for x, x_ends in self._edge(one, 1):
            for y, y_ends in self._edge(two, 0):
                rank = ranks.get((x, y))
                if rank is not None and rank < x_ends and rank <= y_ends:
                    return False
        return True

    def table(self, word: bytes) -> list[int]:
        """The count at every byte prefix of a word, from the empty one on."""
        counts, ends = [0], [b""]
        tokens, valid, longest = self.tokens, self.valid, self.longest
        for end in range(1, len(word) + 1):
            # Short tokens first: they are the likely last ones, and only one candidate is valid.
            for begin in range(end - 1, end - longest - 1 if end > longest else -1, -1):
                token = word[begin:end]
                if token in tokens:
                    before = ends[begin]
                    apart = not begin or valid.get((before, token))
                    if apart is None:
                        if len(valid) > MOST_REMEMBERED:
                            valid.clear()
                        apart = valid[before, token] = self._apart(before, token)
                    if apart:
                        counts.append(counts[begin] + 1)
                        ends.append(token)
                        break
            else:
                raise ValueError(f"no encoding of {word[:end]!r}")
        return counts

    def tables(self, words: list[bytes]) -> np.ndarray:
        """The tables of many words at once: row i holds the counts at the prefixes of word i, from the empty one on.

        The tokens at every place are found by walking all words through the vocabulary's tree together; then ends
        are taken in order, each with its candidates from the shortest on until every word has its last token.
        """
        n, width = len(words), max(map(len, words))
        sizes = np.fromiter(map(len, words), np.int64, n)
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        letters = np.ascontiguousarray(letters.T).astype(np.int64)
        ending: list[list] = [[] for _ in range(width + 1)]
        for begin in range(width):
            rows = np.flatnonzero(sizes > begin)
            nodes = np.zeros(len(rows), np.int64)
            for end in range(begin + 1, min(width, begin + self.longest) + 1):
                keys = nodes * 256 + letters[end - 1][rows]
                at = np.minimum(np.searchsorted(self.steps, keys), len(self.steps) - 1)
                there = self.steps[at] == keys
                nodes, rows = self.step_to[at[there]], rows[there]
                keep = sizes[rows] >= end
                nodes, rows = nodes[keep], rows[keep]
                if not len(rows):
                    break
                tokens = self.token_at[nodes]
                real = tokens >= 0
                ending[end].append((begin, rows[real], tokens[real]))
        counts = np.zeros((width + 1, n), np.int32)
        last = np.full((width + 1, n), -1, np.int64)
        for end in range(1, width + 1):
            for begin, rows, tokens in reversed(ending[end]):
                open_rows = last[end][rows] < 0
                rows, tokens = rows[open_rows], tokens[open_rows]
                if begin and len(rows):
                    apart = self._all_apart(last[begin][rows], tokens)
                    rows, tokens = rows[apart], tokens[apart]
                last[end][rows] = tokens
                counts[end][rows] = counts[begin][rows] + 1
        if (last[sizes, np.arange(n)] < 0).any():
            raise ValueError("a word has no encoding in this vocabulary")
        return counts.T

    def _all_apart(self, ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
        """:meth:`_apart` for pairs of token numbers; answers stay in a table of fixed size."""
        keys = ones * len(self.numbered) + twos + 1
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        known = self.slot_keys[slots] == keys
        out = self.slot_answers[slots]
        if not known.all():
            missing = np.flatnonzero(~known)
            unique, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            numbered = self.numbered
            pairs = ((numbered[ones[i]], numbered[twos[i]]) for i in missing[first])
            answers = np.fromiter((self._apart(a, b) for a, b in pairs), bool, len(unique))
            out[missing] = answers[back]
            self.slot_keys[slots[missing[first]]] = unique
            self.slot_answers[slots[missing[first]]] = answers
        return out

    def learn(self, pieces: set[str], counts: _Counts) -> None:
        """Remember the counts of these pieces of text, each after the lead of ``counts``; plain words together."""
        plain = [m for m in map(_PLAIN.fullmatch, (counts.lead + p for p in pieces.difference(counts))) if m and m.end(1) <= _WIDEST]
        plain.sort(key=lambda m: m.end(1))
        marks: dict[str, int] = {"": 0}
        for i in range(0, len(plain), _TOGETHER):
            some = plain[i : i + _TOGETHER]
            words = [m.group(1).encode() for m in some]
            table = self.tables(words)
            totals = table[np.arange(len(words)), [len(w) for w in words]].tolist()
            for m, n in zip(some, totals):
                end = m.group(2)
                if end not in marks:
                    marks[end] = self.table(end.encode())[-1]
                counts.put(m.string[len(counts.lead) :], n + marks[end])

    def words(self, text: str) -> list[tuple[int, int]]:
        """The places of the pre-tokenizer's words in a text without special strings."""
        return [place for _, place in self.cut(text)]

    def _segments(self, text: str) -> list[str]:
        return self.special.split(text) if self.special else [text]

    def piece(self, text: str) -> int:
        """The count of a text, its words summed up."""
        plain = _PLAIN.fullmatch(text)
        if plain:  # cut as the pre-tokenizer does
            word, marks = plain.groups()
            return self.table(word.encode())[-1] + (self.table(marks.encode())[-1] if marks else 0)
        total = 0
        for i, segment in enumerate(self._segments(text)):
            if i % 2:
                total += 1
            else:
                total += sum(self.table(segment[a:b].encode())[-1] for a, b in self.words(segment))
        return total

    def _line(self, pieces: list[str], counts: _Counts) -> int:
        """The count of a line split at its spaces, its first piece counted by ``counts``."""
        total = counts[pieces[0]] + sum(map(self.after_space.__getitem__, pieces[1:]))
        if total < UNSAFE:
            return total
        # A piece begins or ends with something else than a visible character: only safe spaces part.
        pieces = _SAFE_SPACE.split(" ".join(pieces))
        return self.piece(counts.lead + pieces[0]) + sum(self.piece(" " + p) for p in pieces[1:])

    def count(self, text: str) -> int:
        """The number of tokens of a whole text."""
        return self.count_all([text])[0]

    def count_all(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text, in groups of bounded size whose new words are learnt together."""
        out = [0] * len(texts)
        feed = self.table(b"\n")[-1]
        group: list[tuple[int, str, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for lead, part in _parts(text):
                group.append((i, lead, part))
                size += len(part)
                if size >= _PART:
                    self._count_group(group, out, feed)
                    group, size = [], 0
        self._count_group(group, out, feed)
        return out

    def _count_group(self, group: list[tuple[int, str, str]], out: list[int], feed: int) -> None:
        split = []
        first: set[str] = set()
        later: set[str] = set()
        for i, lead, part in group:
            for j, line in enumerate(_SAFE_LINE.split(part)):
                pieces = line.split(" ")
                after = self.after_space if lead == " " and not j else self.at_start
                split.append((i, after, pieces))
                out[i] += feed * (j > 0 or lead == "\n")
                (later if after is self.after_space else first).add(pieces[0])
                later.update(pieces[1:])
        self.learn(first, self.at_start)
        self.learn(later, self.after_space)
        for i, after, pieces in split:
            out[i] += self._line(pieces, after)

    def prefixes(self, text: str) -> list[int]:
        """The count at every prefix of a text by code points, from the empty one to the whole."""
        out, base, at = [0], 0, 0
        segments = self._segments(text)
        for i, segment in enumerate(segments):
            if i % 2:  # a special string: one token when complete, plain text until then
                stable = self._stable(text, at - len(segments[i - 1]), at)
                before = out[stable]
                out += [before + self.piece(text[stable : at + j]) for j in range(1, len(segment))]
                base += 1
                out.append(base)
            else:
                out += self._segment_prefixes(segment, base)
                base += sum(self.table(segment[a:b].encode())[-1] for a, b in self.words(segment))
                if segment:
                    out[-1] = base
            at += len(segment)
        return out

    def _stable(self, text: str, start: int, at: int) -> int:
        """A place from ``start`` to ``at`` where a word ends whatever follows: after a letter or digit, before another kind."""
        for i in range(at, start, -1):
            if re.match(r"[0-9A-Za-z][!-&(-/:-@\[-`{-~\s]", text[i - 1 : i + 1], re.ASCII):
                return i
        return start

    def _segment_prefixes(self, segment: str, base: int) -> list[int]:
        out: list[int] = []
        run = base  # the count before the run of white space that ends here
        words = self.words(segment)
        blank_from = None
        for a, b in words:
            word = segment[a:b]
            table = self.table(word.encode())
            ends, size = [], 0
            for c in word:
                size += len(c.encode())
                ends.append(table[size])
            if len(word) == 3 and word in ("'re", "'ve", "'ll"):
                ends[1] = ends[0] + self.table(word[1].encode())[-1]
            if word.isspace() or (word[0] == " " and blank_from is not None):
                # A prefix that ends in white space has that whole run as one word.
                if blank_from is None:
                    blank_from, run = a, base
                blanks = b if word.isspace() else a + 1
                for end in range(a + 1, blanks + 1):
                    ends[end - a - 1] = run - base + self.table(segment[blank_from:end].encode())[-1]
            out += [base + e for e in ends]
            base += table[-1]
            if not word.isspace():
                blank_from = None
        return out


def _parts(text: str):
    """``(lead, part)``: a text cut in parts of bounded size at safe spaces and line feeds, which are the leads."""
    lead, at = "", 0
    while len(text) - at > _PART and (cut := _SAFE_CUT.search(text, at + _PART)):
        yield lead, text[at : cut.start()]
        lead, at = cut.group(), cut.end()
    yield lead, text[at:]


class _Counts(dict):
    """Counts of pieces of text, each computed once until ``MOST_REMEMBERED`` are known.

    A piece that does not begin and end with a visible character counts ``UNSAFE``: what is around it matters.
    """

    def __init__(self, counter: PrefixCounter, lead: str):
        super().__init__()
        self.counter, self.lead = counter, lead

    def __missing__(self, piece: str) -> int:
        n = self.counter.piece(self.lead + piece) if _SAFE_PIECE.fullmatch(piece) else UNSAFE
        self.put(piece, n)
        return n

    def put(self, piece: str, n: int) -> None:
        if len(self) >= MOST_REMEMBERED:
            self.clear()
        self[piece] = n


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a tokenizer file, one in each worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of each text."""

    @arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        tokens = counter(path)
        return pa.array(tokens.count_all([t or "" for t in texts.to_pylist()]), pa.int64())

    return count(text)


def prefix_counts(text: Column, path: str) -> Column:
    """The stored table of each text: the count at every prefix by code points, the empty one first."""

    @arrow_udf(ArrayType(IntegerType()))
    def counts(texts: pa.Array) -> pa.Array:
        tokens = counter(path)
        return pa.array([tokens.prefixes(t.as_py() or "") for t in texts], pa.list_(pa.int32()))

    return counts(text)


def tokens_before(counts: Column, place: Column | int) -> Column:
    """From stored counts: the number of tokens of the first ``place`` code points."""
    return F.get(counts, F.lit(place) if isinstance(place, int) else place)


def longest_within(counts: Column, budget: int) -> Column:
    """From stored counts: the longest prefix, in code points, of at most ``budget`` tokens."""
    fits = F.transform(counts, lambda n, i: F.when(n <= budget, i).otherwise(-1))
    return F.array_max(fits)


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)``, a row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("bigint").alias("n_bytes"), token_count(text, path).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
