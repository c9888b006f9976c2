"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts, labelled or not, are unlabelled. A linear classifier over the
presence of words minimises the class-prior-corrected risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]),      l(z) = log(1 + exp(-z)),

whose second part estimates the risk on negatives and is kept from going below zero: when it does, the step goes the
other way. Which words take part is decided on counts of all texts, made in tasks: every word whose share among positives
differs from its share among unlabelled texts by ``min_z`` standard errors, and that occurs in ``min_texts`` texts at least.

The weights are fitted on ``max_positive`` and ``max_unlabelled`` different texts, chosen by a hash; the driver gets the
numbers of their telling words, as lists, and no table of texts by words. Scoring takes every telling word of every text.

Cases: null and empty texts have no words and get the score of the intercept. Repeated texts are learned from once. If a
document has several labels, one toxic label makes it a positive. Without positives, or words that tell, all texts
get the prior as their score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sievra.llm.language_id import held_out
from sievra.llm.links import PIECE_BYTES
from sievra.llm.words import NOT_ALPHANUMERIC, distinct_by_row, pieces_of, text_buffers, word_hashes
from sievra.session import broadcast_if_fits, settle

MAX_POSITIVE = 5000
MAX_UNLABELLED = 20000
MIN_Z = 4.0
MIN_TEXTS = 5
# Words a task holds before it adds up their counts.
_HELD = 1 << 20


@dataclass
class WordModel:
    """A linear model over the presence of words: sorted word hashes, their weights, and an intercept."""

    words: np.ndarray
    weights: np.ndarray
    intercept: float

    def rows(self, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, word number)`` of every known word of every row, each once."""
        if not len(self.words) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == hashes)
        row = np.searchsorted(places, hit, "right") - 1
        once = np.unique(row * len(self.words) + at[hit])
        return once // len(self.words), once % len(self.words)

    def margin(self, hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
        row, word = self.rows(hashes, places)
        return self.intercept + np.bincount(row, self.weights[word], len(places) - 1)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Incidence:
    """A 0/1 matrix as the ``(row, word)`` pairs of its ones."""

    n_rows: int
    n_words: int
    row: np.ndarray
    word: np.ndarray

    @classmethod
    def of(cls, matrix: np.ndarray | Incidence) -> Incidence:
        return matrix if isinstance(matrix, Incidence) else cls(*matrix.shape, *np.nonzero(matrix))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.word], self.n_rows)

    def transposed_times(self, slope: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, slope[self.row], self.n_words)


def fit(
    positive: np.ndarray | Incidence, unlabelled: np.ndarray | Incidence, prior: float, steps: int = 400, rate: float = 0.05, shrink: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Weights and intercept for 0/1 feature matrices, by Adam on the non-negative risk; ``shrink`` is a ridge term."""
    known, other = Incidence.of(positive), Incidence.of(unlabelled)
    n_p, n_u = known.n_rows, other.n_rows
    theta = np.zeros(known.n_words + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p, u = known.times(theta[:-1]) + theta[-1], other.times(theta[:-1]) + theta[-1]
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        # d/dg of the risk of each row; the corrected part of the unlabelled risk turns when it is below zero.
        slope_u, slope_p = _sigmoid(u) / n_u, -prior * _sigmoid(p) / n_p
        if negative >= 0:
            slope_p = slope_p - prior * _sigmoid(-p) / n_p
        else:
            slope_u, slope_p = -slope_u, -slope_p
        grad = np.append(known.transposed_times(slope_p) + other.transposed_times(slope_u), slope_p.sum() + slope_u.sum())
        grad += shrink * np.append(theta[:-1], 0)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, a, b)`` from different ``texts(positive, text)``: the positive texts and all texts that hold each word.

    The null word stands for all texts. Tasks add up before the shuffle.
    """

    def added(held):
        words, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        a, b = (np.bincount(at, np.concatenate([h[i] for h in held]), len(words)).astype(np.int64) for i in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(a), pa.array(b)], ["word", "a", "b"])

    def run(batches):
        held, size, n_p, n_u = [], 0, 0, 0
        for batch in batches:
            for a, b in pieces_of(text_buffers(batch.column(1))[1], PIECE_BYTES):
                part = batch.slice(a, b - a)
                positive = part.column(0).to_numpy()
                n_p, n_u = n_p + int(positive.sum()), n_u + len(positive)
                items, places = distinct_by_row(*word_hashes(*text_buffers(part.column(1)), NOT_ALPHANUMERIC))
                words, at = np.unique(items, return_inverse=True)
                mine = np.repeat(positive, np.diff(places))
                held.append((words, np.bincount(at, mine, len(words)), np.bincount(at, minlength=len(words))))
                size += len(words)
                if size > _HELD:
                    yield added(held)
                    held, size = [], 0
        if size:
            yield added(held)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n_p]), pa.array([n_u])], ["word", "a", "b"])

    counted = texts.select("positive", "text").mapInArrow(run, "word BIGINT, a BIGINT, b BIGINT")
    return counted.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _share_of(rows: int, total: int, *salt):
    """Whether a text is among about ``rows`` of ``total``, by a hash."""
    return F.pmod(F.xxhash64("text", *salt), F.lit(2**31)) < int(2**31 * min(1.0, rows / total))


def known_words(texts: DataFrame, model: WordModel) -> DataFrame:
    """``(positive, key, words)`` from ``texts(positive, text)``: the numbers of the words of each text that the model knows."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b in pieces_of(text_buffers(batch.column(2))[1], PIECE_BYTES):
                part = batch.slice(a, b - a)
                row, word = shared.value.rows(*word_hashes(*text_buffers(part.column(2)), NOT_ALPHANUMERIC))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(word, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["positive", "key", "words"])

    keyed = texts.select("positive", F.xxhash64("text").alias("key"), "text")
    return keyed.mapInArrow(run, "positive INT, key BIGINT, words ARRAY<INT>")


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, min_z: float = MIN_Z, min_texts: int = MIN_TEXTS,
) -> WordModel:
    """The model of ``docs(id, text)`` and ``labels(id, label)``, of which only rows with label 1 count as known.

    The prior is the share of toxic documents among the labelled ones.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    known = settle(known.groupBy("id").agg(F.max("label").alias("label")), "labels")
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0))).first()
    prior = min(max(n_toxic / n, 1e-6), 0.999999) if n else 1e-6
    nothing = WordModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not n_toxic:
        return nothing
    toxic = broadcast_if_fits(settle(known.where("label = 1").select("id", F.lit(1).alias("positive")), "positives"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(toxic, "id", "left")
    rows = rows.select(F.coalesce("positive", F.lit(0)).alias("positive"), "text")
    counts = settle(word_counts(rows.groupBy("text").agg(F.max("positive").alias("positive"))), "word-counts")
    total = counts.where("word IS NULL").first()
    n_p, n_u = (total["a"], total["b"]) if total else (0, 0)
    if not n_p or not n_u:
        return nothing
    a, b = F.col("a"), F.col("b")
    pooled = (a + b) / (n_p + n_u)
    z = F.abs(a / n_p - b / n_u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    telling = counts.where(F.col("word").isNotNull() & (pooled < 1) & (a + b >= min_texts)).where(z >= min_z)
    words = np.sort(telling.select("word").toArrow().column("word").to_numpy().astype(np.int64).view(np.uint64))
    if not len(words):
        return nothing
    positive = rows.where("positive = 1").where(_share_of(max_positive, n_p, F.lit(1))).distinct()
    unlabelled = rows.where(_share_of(max_unlabelled, n_u)).select(F.lit(0).alias("positive"), "text").distinct()
    model = WordModel(words, np.zeros(len(words)), nothing.intercept)
    table = known_words(positive.unionByName(unlabelled), model).toArrow()
    kinds, key = table.column("positive").to_numpy(), table.column("key").to_numpy()
    lists = table.column("words").combine_chunks()
    if not kinds.any() or kinds.all():
        return nothing
    order = np.lexsort((key, kinds))  # rows come in any order; sums must not depend on it
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = np.repeat(place, np.diff(lists.offsets.to_numpy()))
    word = lists.values.to_numpy()
    by_row = np.argsort(row, kind="stable")
    row, word = row[by_row], word[by_row]
    n_other = int((kinds == 0).sum())
    cut = np.searchsorted(row, n_other)
    weights, intercept = fit(
        Incidence(len(kinds) - n_other, len(words), row[cut:] - n_other, word[cut:]), Incidence(n_other, len(words), row[:cut], word[:cut]), prior
    )
    return WordModel(words, weights, intercept)


def score_texts(docs: DataFrame, model: WordModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is toxic as column ``name``, which is replaced if it exists."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, fields = docs.columns.index(text_col), [*docs.columns, name]

    def run(batches):
        scorer = shared.value
        for batch in batches:
            for a, b in pieces_of(text_buffers(batch.column(at))[1], PIECE_BYTES):
                part = batch.slice(a, b - a)
                margins = scorer.margin(*word_hashes(*text_buffers(part.column(at)), NOT_ALPHANUMERIC))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_sigmoid(margins), pa.float64())], fields)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5
) -> DataFrame:
    """``(id_col, held_out, score, predicted)``: learned from what is not held out, scored on the text alone."""
    test = held_out(id_col, folds, 0)
    model = train(docs.where(~test), labels.where(~test), id_col, text_col, label_col)
    rows = score_texts(docs.select(id_col, test.alias("held_out"), text_col), model, text_col)
    return rows.select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
