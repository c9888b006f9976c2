"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them.

Patterns give the base spans of four kinds: email, ip, card (Luhn) and phone. The field labels words, runs of characters
that are not white space, as beginning, continuing or outside a span of a kind. Only words with a digit or an ``@`` can
carry a kind, by construction; every other word is outside, so runs of such words between others are decoded by
themselves, exactly as in the whole text, and texts without any are done. Features are the shapes of a word, of its
neighbours, and the words beside it. Training maximises the likelihood of a small labelled table by forward and
backward sums; decoding is Viterbi. Both work on all runs of a batch at once.

Spans of the field that touch a base span are left out, so base spans stay as they are. Offsets count code points.

Cases: null and empty texts have no spans; rows without id keep their null; repeated rows are searched each; an empty
labelled table adds nothing to the patterns.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sievra.llm.words import give_back, text_buffers

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{part}-{kind}" for kind in KINDS for part in "BI"))
SPAN_TYPE = "ARRAY<STRUCT<kind: STRING, start: INT, end: INT, base: BOOLEAN>>"
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
_FEATURES = 1 << 14

# Fixed patterns. The look-behind and possessive repeats change no match: a match can only begin where digits begin.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost spans of each kind that do not overlap others of it, by start and kind; failing matches are dropped."""
    found = []
    at = ended = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > ended and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            ended = match.end()
        at = match.end() if match else at + 1
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m.group().split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


class _Signs(dict):
    """The sign of each code point in a shape, found once."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        return self[point]


_SIGNS = _Signs()


def shape(word: str, short: bool = False) -> str:
    """Letters as x or X, digits as d, the rest as it is; ``short`` writes repeats once."""
    out = word.translate(_SIGNS)
    return re.sub(r"(.)\1+", r"\1", out) if short else out


def word_features(words: list[str], i: int) -> list[int]:
    """Numbers of the features of word ``i`` among the words of its surroundings."""
    word = words[i]
    before = words[i - 1] if i else ""
    after = words[i + 1] if i + 1 < len(words) else ""
    core = word.strip(".,;:!?\"'()[]<>")
    digits = sum(c.isdigit() for c in word)
    named = (
        "bias",
        "shape " + shape(core),
        "short " + shape(core, True),
        "digits %d" % min(digits, 24),
        "only digits %s" % core.isdigit(),
        "has @ %s" % ("@" in word),
        "front " + shape(word[:2]),
        "before " + shape(before, True),
        "before word " + before.lower().strip(".,;:!?\"'()"),
        "before shape " + shape(before.strip(".,;:!?\"'")),
        "after shape " + shape(after.strip(".,;:!?\"'")),
        "pair " + shape(before.strip(".,;:!?\"'")) + " " + shape(core),
        "next " + shape(core) + " " + shape(after.strip(".,;:!?\"'")),
    )
    return [zlib.crc32(name.encode()) % _FEATURES for name in named]


@dataclass
class Field:
    """Weights of the features by label and of neighbouring labels; row and column 0 are outside."""

    emit: np.ndarray
    move: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(axis=1)


def _allowed() -> np.ndarray:
    """0 where a label may follow another, minus infinity where not: I only after B or I of its kind."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            out[:, j] = -np.inf
            out[[j - 1, j], j] = 0
    return out


def _padded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of every run in a (run, step) grid, and which of them are real."""
    width = int(lengths.max())
    ends = np.cumsum(lengths)
    grid = (ends - lengths)[:, None] + np.arange(width)
    real = np.arange(width) < lengths[:, None]
    return np.where(real, grid, 0), real


def viterbi(field: Field, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels of all words, run by run; a run stands between words that are outside."""
    labels = np.zeros(len(emissions), np.int64)
    move = field.move + _allowed()
    # Runs of similar length go together, so that padding stays within a factor of two.
    classes = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(classes):
        runs = np.flatnonzero(classes == size)
        n, width = lengths[runs], int(lengths[runs].max())
        grid = np.where(np.arange(width) < n[:, None], starts[runs][:, None] + np.arange(width), 0)
        best = move[0] + emissions[grid[:, 0]]
        came = np.zeros((len(runs), width, len(LABELS)), np.int8)
        last = best.copy()
        for t in range(1, width):
            ways = best[:, :, None] + move
            came[:, t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + emissions[grid[:, t]]
            live = n > t
            last[live] = best[live]
        label = (last + move[:, 0]).argmax(axis=1)
        for t in range(width - 1, -1, -1):
            live = n > t
            labels[grid[live, t]] = label[live]
            step = came[np.arange(len(runs)), t, label]
            label = np.where(live & (t > 0), step, label)
    return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class _Likelihood:
    """The regularised negative log-likelihood of labelled runs, by forward and backward sums, and its gradient."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, ridge: float):
        self.labels, self.lengths, self.ridge = labels, lengths, ridge
        self.grid, self.real = _padded(lengths)
        self.used, column = np.unique(features, return_inverse=True)
        self.column = column.reshape(features.shape)
        # Words by feature, so that a gradient is a sum over neighbouring rows.
        order = np.argsort(self.column.ravel(), kind="stable")
        self.word = order // features.shape[1]
        self.begin = np.searchsorted(self.column.ravel()[order], np.arange(len(self.used)))
        k = len(LABELS)
        self.gold_move = np.zeros((k, k))
        previous = np.concatenate([[0], labels[:-1]])
        first = np.cumsum(lengths) - lengths
        previous[first] = 0
        np.add.at(self.gold_move, (previous, labels), 1)
        np.add.at(self.gold_move, (labels[first + lengths - 1], 0), 1)
        self.size = (len(self.used) + k) * k

    def parts(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights of features and of neighbouring labels in one vector of weights."""
        both = theta.reshape(-1, len(LABELS))
        return both[: len(self.used)], both[len(self.used) :]

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        emit, between = self.parts(theta)
        lengths, n, k, width = self.lengths, len(self.lengths), len(LABELS), self.grid.shape[1]
        words = emit[self.column].sum(axis=1)
        emissions, move = words[self.grid], between + _allowed()
        alpha = np.empty((n, width, k))
        alpha[:, 0] = move[0] + emissions[:, 0]
        for t in range(1, width):
            alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + move, 1) + emissions[:, t]
        beta = np.zeros((n, width, k))
        for t in range(width - 1, -1, -1):
            after = _log_sum(move[None] + (emissions[:, t + 1] + beta[:, t + 1])[:, None, :], 2) if t + 1 < width else 0
            beta[:, t] = np.where((lengths > t + 1)[:, None], after, move[:, 0])
        total = _log_sum(alpha[:, 0] + beta[:, 0], 1)
        share = np.exp(alpha + beta - total[:, None, None]) * self.real[:, :, None]
        expected = np.zeros((k, k))
        expected[0] += share[:, 0].sum(axis=0)
        for t in range(width - 1):
            ways = alpha[:, t, :, None] + move + (emissions[:, t + 1] + beta[:, t + 1])[:, None, :] - total[:, None, None]
            expected += (np.exp(ways) * (lengths > t + 1)[:, None, None]).sum(axis=0)
        expected[:, 0] += share[np.arange(n), lengths - 1].sum(axis=0)
        error = share[self.real]  # in the order of the words
        at = np.arange(len(self.labels)), self.labels
        error[at] -= 1
        value = (total.sum() - words[at].sum() - (self.gold_move * between).sum()) / n + self.ridge / 2 * float(theta @ theta)
        slope = np.concatenate([np.add.reduceat(error[self.word], self.begin), expected - self.gold_move]) / n
        return float(value), slope.ravel() + self.ridge * theta


def _minimum(function, start: np.ndarray, tolerance: float, most: int | None = None, memory: int = 10) -> np.ndarray:
    """Where a smooth convex function has no slope above ``tolerance``, by limited-memory quasi-Newton steps.

    It also ends after ``most`` steps, if given, or where steps no longer lower the value in floating point.
    """
    x, steps, done = start, [], 0
    value, slope = function(x)
    while np.abs(slope).max() > tolerance and done != most:
        done += 1
        way, weights = -slope, []
        for s, y in reversed(steps):
            weights.append((s @ way) / (s @ y))
            way = way - weights[-1] * y
        if steps:
            s, y = steps[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), w in zip(steps, reversed(weights)):
            way = way + (w - (y @ way) / (s @ y)) * s
        length = 1.0 if steps else 1 / np.linalg.norm(slope)
        while True:
            new = x + length * way
            new_value, new_slope = function(new)
            if new_value <= value + 1e-4 * length * (slope @ way):
                break
            length /= 2
            if length < 1e-12:
                return x
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps, (s, y)][-memory:]
        x, value, slope = new, new_value, new_slope
    return x


def _table(examples: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and label of every word that is in a run, and the lengths of the runs."""
    features, labels, lengths = [], [], []
    for text, spans in examples:
        places, runs = _runs_of(text)
        words = [text[a:b] for a, b in places]
        for run in runs:
            lengths.append(len(run))
            open_span = None
            for i in run:
                a, b = places[i]
                span = next((s for s in spans if s[1] < b and a < s[2]), None)
                features.append(word_features(words, i))
                inside = span is not None and span == open_span
                labels.append(0 if span is None else 1 + 2 * KINDS.index(span[0]) + inside)
                open_span = span
    return np.array(features), np.array(labels), np.array(lengths)


def train(
    examples: list[tuple[str, list[tuple[str, int, int]]]], steps: int | None = None, ridge: float = 1e-3, tolerance: float = 1e-4
) -> Field | None:
    """The field that makes the labels of ``examples(text, spans)`` most likely.

    The regularised likelihood has one maximum; it is approached until no slope is above ``tolerance``, or for a number of
    ``steps`` if that is given.
    """
    features, labels, lengths = _table(examples)
    if not len(lengths):
        return None
    likelihood = _Likelihood(features, labels, lengths, ridge)
    weights, move = likelihood.parts(_minimum(likelihood, np.zeros(likelihood.size), tolerance, steps))
    emit = np.zeros((_FEATURES, len(LABELS)))
    emit[likelihood.used] = weights
    return Field(emit, move)


_ACTIVE = re.compile(r"[0-9@]")
_RUN = re.compile(r"[^\x20\t\n\r\x0b\x0c]+")


def _runs_of(text: str) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Places of a text's words, and the runs of neighbouring words in a line that have a digit or an ``@``."""
    places = [m.span() for m in _RUN.finditer(text)]
    runs: list[list[int]] = []
    for i, (a, b) in enumerate(places):
        if _ACTIVE.search(text, a, b):
            joined = runs and runs[-1][-1] == i - 1 and "\n" not in text[places[i - 1][1] : a]
            if joined:
                runs[-1].append(i)
            else:
                runs.append([i])
    return places, runs


def _trimmed(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """A span without the marks around it; a phone number keeps an opening bracket or plus."""
    while b > a and not (text[b - 1].isalnum()):
        b -= 1
    while a < b and not (text[a].isalnum() or kind == "phone" and text[a] in "+("):
        a += 1
    return a, b


def field_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """The spans that the field finds in each text."""
    features, lengths, where = [], [], []
    all_places = []
    for row, text in enumerate(texts):
        places, runs = _runs_of(text)
        all_places.append(places)
        for run in runs:
            # Words of the surroundings: the run and one word on either side decide its features.
            low = max(0, run[0] - 1)
            words = [text[a:b] for a, b in places[low : run[-1] + 2]]
            features += [word_features(words, i - low) for i in run]
            lengths.append(len(run))
            where.append((row, run))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not lengths:
        return out
    labels = viterbi(field, field.emissions(np.array(features)), np.array(lengths))
    at = 0
    for (row, run), n in zip(where, lengths):
        text, places = texts[row], all_places[row]
        i = 0
        while i < n:
            label = labels[at + i]
            if not label:
                i += 1
                continue
            kind, end = KINDS[(label - 1) // 2], i + 1
            while end < n and LABELS[labels[at + end]] == "I-" + kind:
                end += 1
            a, b = _trimmed(text, places[run[i]][0], places[run[end - 1]][1], kind)
            if a < b:
                out[row].append((kind, a, b))
            i = end
        at += n
    return out


def all_spans(texts: list[str], field: Field | None) -> list[list[tuple[str, int, int, bool]]]:
    """Base spans and what the field adds to them, by start and kind."""
    added = field_spans(texts, field) if field else [[] for _ in texts]
    out = []
    for text, more in zip(texts, added):
        base = base_spans(text)
        more = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)]
        rows = [(*s, True) for s in base] + [(*s, False) for s in more]
        out.append(sorted(rows, key=lambda s: (s[1], KINDS.index(s[0]))))
    return out


def labelled_examples(seed: int = 11, rows: int = 600) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table, made by rule: sentences around personal data in usual notations, and around other numbers."""
    rng = np.random.default_rng(seed)
    fill = lambda form: "".join(str(rng.integers(0, 10)) if c == "#" else str(rng.integers(2, 10)) if c == "N" else c for c in form)
    letters = lambda n: "".join(chr(97 + int(i)) for i in rng.integers(0, 26, n))
    word = lambda: letters(int(rng.integers(2, 10)))
    secret = lambda: "".join("0123456789abcdef"[int(i)] for i in rng.integers(0, 16, int(rng.integers(12, 40))))
    # Fixed notations. Base patterns are among them, so that the field agrees with them.
    private = {
        "phone": ["(N##) N##-####", "N##-N##-####", "N##.N##.####", "+1 (N##) 555-####", "+49 ### #######", "+33 # ## ## ## ##", "1-800-N##-####", "N## N## ####"],
        "email": ["{w}.##@{w}.example.com", "{w}@{w}.org", "{w}.{w}@{w}.co.uk", "{w}_{w}@{w}", "{w}+{w}@mail#.{w}.net"],
        "ip": ["N#.##.##.##", "1N#.#.#.1", "10.#.##.N#", "192.168.#.##", "2001:db8::#:N#", "fe80::#N##:####"],
        "card": ["4### #### #### ####", "5###-####-####-####", "4###############", "4###.####.####.####", "3### ###### #####"],
    }
    other = [
        "{w} N,###.##", "$N##.##", "20##-0#-1#", "1#/0#/20##", "1#:##", "version N.#", "Version 2.0.", "CC BY-NC 4.0.", "{w} N.", "19##", "20##",
        'token = "{h}"', "password={h}", "password={h}", "{h}", "AKIA#F#BUK#TZDYK##BD", "page N##", "N##", "#### {w}", "ISBN 978-3-##-######-#",
        "{w}#", "No. ####", "N# %", "id=####-##", "#.##e-##", "@{w}", "{w}@", "N##.##.#", "v#.##.#", "##########", "####-####", "N# N## ###", "{w}#{w}#",
    ]
    cues = {"phone": ["call", "phone", "tel:", "at"], "email": ["write", "mail", "to"], "ip": ["from", "host", "ip"], "card": ["card", "paid", "with"]}
    out = []
    for i in range(rows):
        text, spans = " ".join(word() for _ in range(int(rng.integers(0, 5)))), []
        for _ in range(int(rng.integers(1, 4))):
            if rng.random() < 0.55:
                kind = KINDS[int(rng.integers(0, 4))]
                form = private[kind][int(rng.integers(0, len(private[kind])))]
                if rng.random() < 0.3:
                    text += " " + cues[kind][int(rng.integers(0, len(cues[kind])))]
            else:
                kind, form = None, other[int(rng.integers(0, len(other)))]
            value = fill(form)
            while "{w}" in value:
                value = value.replace("{w}", word(), 1)
            value = value.replace("{h}", secret())
            text += " " if text else ""
            if kind:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + ("." if rng.random() < 0.1 else "," if rng.random() < 0.1 else "")
            text += "".join(" " + word() for _ in range(int(rng.integers(0, 4))))
        out.append((text, spans))
    return out


def _marked(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with a digit or an ``@``: no other can have a span."""
    sums = np.concatenate([[0], np.cumsum(((raw >= 48) & (raw <= 57)) | (raw == 64), dtype=np.int32)])
    return np.flatnonzero(sums[offsets[1:]] > sums[offsets[:-1]])


def _spans_of(column: pa.Array, field: Field | None) -> list:
    found: list = [[] for _ in range(len(column))]
    rows = _marked(*text_buffers(column)).tolist()
    for at in range(0, len(rows), 256):
        some = rows[at : at + 256]
        texts = column.take(pa.array(some, pa.int64())).to_pylist()
        for row, spans in zip(some, all_spans(texts, field)):
            found[row] = spans
    return found


def find_spans(docs: DataFrame, field: Field | None, text_col: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with the spans of every text as an array ``name`` of (kind, start, end, base)."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at, fields = docs.columns.index(text_col), [*docs.columns, name]

    def run(batches):
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "base"), s)) for s in row] for row in _spans_of(batch.column(at), shared.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW_SPAN)], fields)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{types}, `{name}` {SPAN_TYPE}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: list | None = None) -> DataFrame:
    """``(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans)``: base counts and digest, and all spans as text."""
    field = train(labelled_examples() if examples is None else examples)
    rows = find_spans(docs.select(id_col, text_col), field, text_col, "found")
    base = F.filter("found", lambda s: s["base"])
    counts = [F.size(F.filter(base, _of_kind(kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return rows.select(id_col, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with every span replaced by the name of its kind; spans that overlap become one, named by the first."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", examples: list | None = None) -> DataFrame:
    """``docs`` with personal data in texts replaced and, where there is such a column, their length in code points set anew."""
    field = train(labelled_examples() if examples is None else examples)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at, fields = docs.columns.index(text_col), docs.columns

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            spans = _spans_of(column, shared.value)
            hit = np.array([bool(s) for s in spans], bool)
            if hit.any():
                clean = [redact(column[i].as_py(), spans[i]) for i in np.flatnonzero(hit).tolist()]
                column = pc.replace_with_mask(column, pa.array(hit), pa.array(clean, column.type))
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], fields)
        give_back()

    out = docs.mapInArrow(run, docs.schema)
    if length_col not in docs.columns:
        return out
    kind = docs.schema[length_col].dataType
    return out.withColumn(length_col, F.coalesce(F.char_length(text_col).cast(kind), F.col(length_col)))
