"""Document and query analysis: cleaned text, tokens, stop words, lemmas."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sievra.functions import text as T
from sievra.session import MAX_BROADCAST_ROWS, fits, settle, unnest

# Noun endings and their replacements, as published for WordNet's Morphy, in order.
NOUN_SUFFIXES = (
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
)


def _base_forms(form: Column) -> Column:
    """Every noun rule that fits ``form``, applied, in rule order."""
    options = [
        F.when(form.endswith(old), F.concat(_cut(form, len(old)), F.lit(new)))
        for old, new in NOUN_SUFFIXES
    ]
    return F.filter(F.array(*options), lambda x: x.isNotNull())


def _cut(form: Column, n: int) -> Column:
    return F.left(form, F.length(form) - n)


def lemma_table(
    forms: DataFrame, lexicon: DataFrame | None = None, exceptions: DataFrame | None = None
) -> DataFrame:
    """``(form, lemma)`` for the forms whose lemma differs from them.

    ``forms(term)`` and ``lexicon(term)`` hold distinct terms, the forms being the lexicon where none is
    given; ``exceptions(form, lemma)`` lists irregular forms. Candidates of a form are the form itself
    and its noun rules applied once; only those in the lexicon count, the shortest wins, the earlier
    one on equal length. If none counts, the rules are applied again to the candidates until one does.
    An irregular form has its listed lemmas as the only other candidates. Forms without any candidate
    keep their spelling and are not listed.

    The work is on distinct forms: one join of candidates with the lexicon on the candidate, so no
    key is hot, and one aggregation by form.
    """
    known = lexicon if lexicon is not None else forms
    forms = forms.select(F.col("term").alias("form"))
    regular = forms.where(_regular(F.col("form")))
    if exceptions is not None:
        regular = regular.join(exceptions.select("form").distinct(), "form", "left_anti")

    # Level 1 candidates next to the form; deeper levels only for forms that need them.
    first = regular.select("form", _base_forms(F.col("form")).alias("bases"))
    candidates = unnest(
        first, F.concat(F.array("form"), F.col("bases")), "pos", "term", keep=["form"]
    ).select("form", F.lit(1).alias("level"), "pos", "term")
    if exceptions is not None:
        irregular = forms.join(exceptions, "form").select("form", F.col("lemma").alias("term"))
        itself = irregular.select("form", F.col("form").alias("term")).distinct()
        candidates = candidates.unionByName(
            itself.select("form", F.lit(1).alias("level"), F.lit(0).alias("pos"), "term")
        ).unionByName(irregular.select("form", F.lit(1).alias("level"), F.lit(1).alias("pos"), "term"))

    if lexicon is not None:
        candidates = candidates.unionByName(_deeper_candidates(first, lexicon))

    found = candidates.join(known.select("term"), "term")
    best = found.groupBy("form").agg(
        F.min(F.struct("level", F.length("term").alias("len"), "pos", "term")).alias("best")
    )
    return best.select("form", F.col("best.term").alias("lemma")).where(F.col("form") != F.col("lemma"))


def _deeper_candidates(first: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rules applied again, for forms that are no word themselves: at most once per character."""
    unknown = first.join(lexicon.select(F.col("term").alias("form")), "form", "left_anti")
    deeper = unknown.select(
        "form",
        F.aggregate(
            F.sequence(F.lit(2), F.greatest(F.length("form"), F.lit(2))),
            F.struct(
                F.col("bases").alias("now"),
                F.array().cast("array<struct<level:int,term:string>>").alias("all"),
            ),
            _next_level,
            lambda acc: acc["all"],
        ).alias("all"),
    )
    return unnest(deeper, F.col("all"), "pos", "c", keep=["form"]).select(
        "form", F.col("c.level").alias("level"), "pos", F.col("c.term").alias("term")
    )


def _next_level(acc: Column, level: Column) -> Column:
    now = F.array_distinct(F.flatten(F.transform(acc["now"], _base_forms)))
    return F.struct(
        now.alias("now"),
        F.concat(
            acc["all"], F.transform(now, lambda t: F.struct(level.alias("level"), t.alias("term")))
        ).alias("all"),
    )


def distinct_terms(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``(term)``: each token of the corpus once."""
    return unnest(df, F.col(tokens_col), "term", keep=[]).distinct()


def _replace_in_tasks(lemmas: pa.Table):
    forms, bases = lemmas["form"].combine_chunks(), lemmas["lemma"].combine_chunks()

    @F.arrow_udf("array<string>")
    def replace(tokens: pa.Array) -> pa.Array:
        flat = tokens.flatten()
        lemma = bases.take(pc.index_in(flat, value_set=forms))
        values = pc.coalesce(lemma, flat.cast(lemma.type))
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=tokens.is_null())

    return replace


def lemmatize(
    df: DataFrame,
    lemmas: DataFrame,
    tokens_col: str = "tokens",
    id_col: str = "doc_id",
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Replace every token that ``lemmas(form, lemma)`` lists, keeping the order. ``id_col`` must be unique.

    The ``max_rows`` most frequent forms, or all if the table is checked to be that small, go to every task, which rewrites the token
    arrays in Arrow batches without a shuffle. Only tokens that may be one of the other forms are exploded and joined
    with the table by form, and only those it lists come back to their document. A form that is left has less than one in
    ``max_rows`` of the tokens, so none is hot.
    """
    if fits(lemmas, max_rows):
        return df.withColumn(tokens_col, _replace_in_tasks(lemmas.select("form", "lemma").toArrow())(F.col(tokens_col)))
    sent = settle(_sent_forms(df, lemmas, tokens_col, max_rows), "sent-forms")
    rest = settle(lemmas.select("form", "lemma").join(F.broadcast(sent.select("form")), "form", "left_anti"), "other-forms")
    tokens = unnest(df, F.col(tokens_col), "__pos", "form", keep=[id_col])
    # Where only regular forms are left, other tokens need not be looked up.
    if rest.where(~_regular(F.col("form"))).isEmpty():
        tokens = tokens.where(_regular(F.col("form")))
    tokens = tokens.join(F.broadcast(sent.select("form")), "form", "left_anti")
    found = tokens.join(rest, "form").select(id_col, F.struct("__pos", "lemma").alias("__e"))
    # One document's tokens were one row before, so one group is no larger than one input row.
    by_place = found.groupBy(id_col).agg(F.map_from_entries(F.collect_list("__e")).alias("__lemmas"))
    replaced = F.transform(tokens_col, lambda t, i: F.coalesce(F.try_element_at("__lemmas", i), t))
    rewritten = df.withColumn(tokens_col, _replace_in_tasks(sent.toArrow())(F.col(tokens_col)))
    both = rewritten.join(by_place, id_col, "left")
    return both.withColumn(tokens_col, F.when(F.col("__lemmas").isNull(), F.col(tokens_col)).otherwise(replaced)).drop("__lemmas")


def _regular(form: Column) -> Column:
    """Whether a noun rule may fit: all endings of the rules end so."""
    return form.endswith("s") | form.endswith("men")


def _sent_forms(df: DataFrame, lemmas: DataFrame, tokens_col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows of ``lemmas(form, lemma)``: the irregular forms if they are that few, then the most
    frequent others. Tokens are counted in the tasks; forms share few counts, so the counts tell where the cut is."""
    irregular = lemmas.where(~_regular(F.col("form")))
    few = irregular.count()
    room = max_rows - few
    if room < 0:
        irregular, room = irregular.limit(0), max_rows
    tokens = unnest(df, F.col(tokens_col), "form", keep=[])
    regular = tokens.where(_regular(F.col("form"))) if few <= max_rows else tokens
    counted = settle(regular.groupBy("form").agg(F.count("*").alias("n")).join(lemmas, "form"), "form-counts")
    sizes = counted.groupBy("n").agg(F.count("*").alias("forms"))
    reached = sizes.select("n", F.sum("forms").over(W.orderBy(F.desc("n"))).alias("upto"))
    least = reached.where(F.col("upto") <= room).agg(F.min("n")).scalar()
    return irregular.select("form", "lemma").unionByName(counted.where(F.col("n") >= least).select("form", "lemma"))


def clean_documents(
    df: DataFrame, text_col: str = "text", stopwords: Sequence[str] | None = None
) -> DataFrame:
    """Overwrite ``text_col`` with the cleaned text and add ``tokens`` without stop words."""
    cleaned = df.withColumn(text_col, T.clean_text(F.col(text_col)))
    return cleaned.withColumn("tokens", T.remove_stopwords(F.split(text_col, " "), stopwords))


def analyze_documents(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    stopwords: Sequence[str] | None = None,
    lexicon: DataFrame | None = None,
    exceptions: DataFrame | None = None,
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """Full analysis: cleaned text, tokens, stop words out, lemmas in; other columns stay.

    ``lexicon(term)`` says which words exist. Without one, the distinct tokens of the corpus serve,
    which merges more than a dictionary does (``pass`` becomes ``pas`` if both occur). A ready
    ``lemmas(form, lemma)`` table skips that pass over the corpus.
    """
    staged = clean_documents(df, text_col, stopwords)
    if lemmas is None:
        terms = distinct_terms(staged)
        # Without a lexicon the terms are read twice, as forms and as the words that exist.
        terms = settle(terms, "terms") if lexicon is None else terms
        lemmas = settle(lemma_table(terms, lexicon, exceptions), "lemmas")
    return lemmatize(staged, lemmas, "tokens", id_col)


def analyze_queries(
    df: DataFrame,
    text_col: str = "text",
    mode: str = "word",
    stopwords: Sequence[str] | None = None,
    lemmas: DataFrame | None = None,
    id_col: str = "query_id",
) -> DataFrame:
    """Add ``terms``.

    ``word`` takes the lower-cased words of two or more characters, with stop words and without
    lemmas. An inflected word then misses documents that are indexed under its lemma; ``document``
    analyses queries as documents are analysed.
    """
    if mode == "word":
        return df.withColumn("terms", T.query_terms(F.col(text_col)))
    if mode != "document":
        raise ValueError(f"unknown mode {mode!r}")
    tokens = T.remove_stopwords(F.split(T.clean_text(F.col(text_col)), " "), stopwords)
    analyzed = df.withColumn("terms", tokens)
    return analyzed if lemmas is None else lemmatize(analyzed, lemmas, "terms", id_col)
