"""The whole evaluation of recorded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievra.functions.text import normalize_answer
from sievra.operators.labels import ScoreExpression, Scorer, compare_runs, evaluate_runs, label_pairs


def label_runs(
    runs: DataFrame, scorer: Scorer | None = None, nan_text: bool = False, expression: ScoreExpression | None = None
) -> DataFrame:
    """``runs(model, mode, answer, text)`` with both texts normalised and a ``label`` each.

    Scores come from ``scorer``, from ``expression(answer, text)``, a column that needs no Python, or from a column ``scores``.
    A pair with a missing answer or text has a null label, unless ``nan_text`` reads it as ``nan``.
    """
    clean = runs.withColumns(
        {c: normalize_answer(F.col(c), nan_text) for c in ("answer", "text")}
    )
    if expression is not None:
        clean = clean.withColumn("scores", expression(F.col("answer"), F.col("text")))
    labelled = label_pairs(clean, scorer)
    present = F.col("answer").isNotNull() & F.col("text").isNotNull()
    return labelled.withColumn("label", F.when(present, F.col("label")))


def evaluate(
    runs: DataFrame, scorer: Scorer | None = None, nan_text: bool = False, expression: ScoreExpression | None = None
) -> DataFrame:
    """``(model, mode, n, supports, neutral, contradiction, acc, precision, recall, f1)``."""
    return evaluate_runs(label_runs(runs, scorer, nan_text, expression), "model", "mode")


def evaluate_and_compare(
    runs: DataFrame, scorer: Scorer | None = None, nan_text: bool = False, expression: ScoreExpression | None = None
) -> DataFrame:
    """One row per model: every metric without and with evidence, and the gain."""
    return compare_runs(evaluate(runs, scorer, nan_text, expression))
