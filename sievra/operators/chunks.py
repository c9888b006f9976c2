"""Word chunks of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievra.functions.text import tokenize
from sievra.session import unnest

# Chunk length and overlap, in words.
CHUNK_WORDS = 256
CHUNK_OVERLAP = 50


def chunk_words(
    df: DataFrame,
    text_col: str = "text",
    size: int = CHUNK_WORDS,
    overlap: int = 0,
    pad: bool = False,
) -> DataFrame:
    """One row per chunk: the other columns, ``chunk_no`` from 0, and ``chunk``.

    A chunk starts every ``size - overlap`` words for as long as words are left, so a last chunk may
    lie wholly inside the one before. ``pad`` adds as many spaces to the last chunk as it has words
    too few. Empty text gives no rows. No shuffle: each row is split where it is.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("need size >= 1 and 0 <= overlap < size")
    step = size - overlap
    keep = [c for c in df.columns if c != text_col]
    words, n = F.col("__words"), F.size("__words")

    def chunk(start):
        body = F.array_join(F.slice(words, start + 1, size), " ")
        if not pad:
            return body
        missing = F.greatest(F.lit(size) - (n - start), F.lit(0))
        return F.when(start + step >= n, F.concat(body, F.repeat(F.lit(" "), missing))).otherwise(body)

    # sequence() counts down when its end lies before its start, hence the guard.
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))
    staged = df.select(*keep, tokenize(F.col(text_col)).alias("__words"))
    return unnest(staged, F.transform(starts, chunk), "chunk_no", "chunk", keep=keep)
