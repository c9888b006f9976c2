"""TF-IDF index and cosine search as joins and aggregations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from sievra.operators.analysis import analyze_queries
from sievra.operators.sampling import assign_positions, head_sample
from sievra.session import MAX_BROADCAST_ROWS, broadcast_if_fits, fits, settle, unnest

# Vocabulary limits and sample size by default, and top-k.
MIN_DF = 5
MAX_DF = 0.5
MAX_FEATURES = 100_000
SAMPLE_SIZE = 25_000
TOP_K = 10

# Scores are rounded to this many decimals before ranking. Copies of a document have equal scores,
# but sums of doubles depend on their order; without rounding, a re-run task could reorder ties.
SCORE_DIGITS = 9

# Terms in more than this share of the documents of the most frequent term are few (a document of ``d`` terms adds
# at most ``d`` to all frequencies) and are sent to the tasks where the vocabulary as a whole is not.
HOT_SHARE = 0.001

# Postings of a frequent term that one salt of the join beyond a broadcast takes.
ROWS_PER_SALT = 1_000_000

# As many terms as Parquet's filters compare one by one (spark.sql.parquet.pushdown.inFilterThreshold).
PUSHED_TERMS = 10


@dataclass(frozen=True)
class LexicalIndex:
    """``vocab(term, term_id, df, ctf, idf)``, ``postings(doc_id, term, tf, weight)``, ``docs(doc_id)``.

    ``docs`` has every document, also those without any known term. ``partitions``: in how many the postings are dealt by
    document, where that was chosen by the size of the texts. ``blocks``: of how many blocks each partition holds whole ones,
    where documents were dealt so (:func:`sievra.operators.block_search.deal_blocks`); postings then have ``part``, too.
    """

    vocab: DataFrame
    postings: DataFrame
    docs: DataFrame
    partitions: int | None = None
    blocks: int | None = None


def term_freq(
    df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", colocated: bool = False, by: tuple[str, ...] = ()
) -> DataFrame:
    """``(doc_id, term, tf)``, co-located by document.

    The one shuffle moves whole documents by their id. Counting by (document, term), the norm by
    document and the score by (query, document) later all find that partitioning and need no other.
    ``colocated`` says that ``df`` is already partitioned by the id, which saves that one, too, or by the columns ``by``, which
    depend on the id alone and are kept.
    """
    by_doc = df.select(*by, F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("tokens"))
    by_doc = by_doc if colocated else by_doc.repartition("doc_id")
    exploded = unnest(by_doc, F.col("tokens"), "term", keep=[*by, "doc_id"])
    return exploded.groupBy(*by, "doc_id", "term").agg(F.count("*").alias("tf"))


def doc_freq(tf: DataFrame) -> DataFrame:
    """``(term, df, ctf)``: documents and occurrences of each term; combined before the shuffle."""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))


def build_vocab(
    tf: DataFrame,
    n_docs: DataFrame,
    min_df: int | float = MIN_DF,
    max_df: int | float = MAX_DF,
    max_features: int | None = MAX_FEATURES,
) -> DataFrame:
    """``(term, term_id, df, ctf, idf)`` from the term frequencies of the sampled documents.

    ``n_docs`` is a one-row, one-column DataFrame with their number. Whole numbers are document
    counts, fractions are shares of ``n_docs``. Of the terms within the limits the ``max_features``
    most frequent stay, earlier terms first on ties; ``term_id`` follows term order. The inverse
    document frequency is ``ln((1 + n) / (1 + df)) + 1``.
    """
    n = n_docs.scalar()

    def limit(bound):
        return F.lit(bound) * n if isinstance(bound, float) else F.lit(bound)

    kept = doc_freq(tf).where((F.col("df") >= limit(min_df)) & (F.col("df") <= limit(max_df)))
    if max_features is not None:
        kept = settle(kept, "frequencies")
        if not fits(kept):
            kept = _frequent(kept, max_features)
        kept = kept.orderBy(F.desc("ctf"), "term").limit(max_features)
        numbered = kept.withColumn("term_id", F.row_number().over(W.orderBy("term")) - 1)  # at most max_features rows
    else:
        kept = settle(kept, "frequencies")
        places = assign_positions(kept.select("term"), "term").select("term", F.col("pos").cast("int").alias("term_id"))
        numbered = kept.join(places, "term")
    return numbered.select(
        "term",
        "term_id",
        "df",
        "ctf",
        (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"),
    )


def _frequent(freq: DataFrame, n: int) -> DataFrame:
    """The terms that are at least as frequent as the ``n``-th most frequent one.

    A sort with a limit takes ``n`` terms of every partition to one task. Terms share few frequencies, so
    counting the terms of each frequency tells which of them make the cut.
    """
    sizes = freq.groupBy("ctf").agg(F.count("*").alias("terms"))
    reached = sizes.select("ctf", F.sum("terms").over(W.orderBy(F.desc("ctf"))).alias("upto"))
    lowest = reached.where(F.col("upto") >= n).agg(F.max("ctf")).scalar()
    return freq.where(F.col("ctf") >= F.coalesce(lowest, F.lit(0)))


def tfidf(tf: DataFrame, vocab: DataFrame, max_features: int | None = MAX_FEATURES, by: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, term, tf, weight)`` for known terms; weights of one document have unit length.

    The vocabulary is broadcast where ``max_features`` bounds its size.
    """
    raw = raw_weights(tf, vocab, max_features, by)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(*by, "doc_id")))
    return raw.select(*by, "doc_id", "term", "tf", (F.col("raw") / norm).alias("weight"))


def raw_weights(tf: DataFrame, vocab: DataFrame, max_features: int | None = MAX_FEATURES, by: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, term, tf, raw)`` of the known terms: term frequency times inverse document frequency.

    Without a bound on the vocabulary, its frequent terms still go to the tasks, and only rare ones are joined by
    term, so no term's postings meet in one task.
    """
    words = vocab.select("term", "idf")
    if max_features is not None and max_features <= MAX_BROADCAST_ROWS:
        known = tf.join(F.broadcast(words), "term")
    else:
        hot_df = vocab.agg(F.max("df") * HOT_SHARE).scalar()
        hot = broadcast_if_fits(vocab.where(F.col("df") > hot_df).select("term", "idf"))
        rare = vocab.where(F.col("df") <= hot_df).select("term", "idf")
        known = tf.join(hot, "term").unionByName(tf.join(hot, "term", "left_anti").join(rare, "term"))
    return known.select(*by, "doc_id", "term", "tf", (F.col("tf") * F.col("idf")).alias("raw"))


def row_norms(tf: DataFrame, vocab: DataFrame, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """``(doc_id, norm)``: the length of each document's raw weights."""
    raw = raw_weights(tf, vocab, max_features)
    return raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))


def build_lexical_index(
    df: DataFrame,
    id_col: str = "doc_id",
    tokens_col: str = "tokens",
    min_df: int | float = MIN_DF,
    max_df: int | float = MAX_DF,
    max_features: int | None = MAX_FEATURES,
    sample_size: int | None = SAMPLE_SIZE,
    colocated: bool = False,
    partitions: int | None = None,
    blocks: int | None = None,
) -> LexicalIndex:
    """Fit the vocabulary on the first ``sample_size`` documents by id and weigh all documents.

    ``partitions``: how many ``df`` has, if it is co-located in a number chosen by its size; ``blocks``: of how many blocks these
    hold whole ones, if ``df`` was dealt so and has ``part``.
    """
    by = () if blocks is None else ("part",)
    docs = df.select(*by, F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("tokens"))
    tf = term_freq(docs, colocated=colocated, by=by)
    sample = head_sample(docs, sample_size, "doc_id")
    sample_tf = tf if sample_size is None else term_freq(sample, colocated=colocated, by=by)
    # The fitted vocabulary is small and is read by the weights, by every search and by the statistics.
    vocab = settle(build_vocab(sample_tf, sample.agg(F.count("*")), min_df, max_df, max_features), "vocab")
    return LexicalIndex(vocab, tfidf(tf, vocab, max_features, by), docs.select("doc_id"), partitions, blocks)


def lexical_stats(idx: LexicalIndex) -> DataFrame:
    """One row: documents, terms, non-zeros, non-zeros per document, sparsity in percent."""
    n = F.col("n_docs")
    sizes = idx.postings.agg(F.count("*").alias("nnz")).select(
        idx.docs.agg(F.count("*")).scalar().alias("n_docs"),
        idx.vocab.agg(F.count("*")).scalar().alias("n_terms"),
        "nnz",
    )
    cells = n * F.col("n_terms")
    return sizes.select(
        "n_docs",
        "n_terms",
        "nnz",
        F.try_divide("nnz", n).alias("nnz_per_doc"),
        (F.lit(100.0) - F.try_divide(F.lit(100.0) * F.col("nnz"), cells)).alias("sparsity"),
    )


def query_weights(queries: DataFrame, vocab: DataFrame, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """``(query_id, term, weight)`` of ``queries(query_id, terms)``, unit length per query."""
    tf = term_freq(queries, "query_id", "terms")
    return tfidf(tf, vocab, max_features).select(
        F.col("doc_id").alias("query_id"), "term", F.col("weight").alias("query_weight")
    )


def top_k(scored: DataFrame, k: int | None, score_col: str = "score", descending: bool = True,
          tie_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The best ``k`` rows of each query (all if None) with ``rank`` from 1; ties go to the lower id.

    Spark keeps only the best ``k`` per query in every task before it shuffles by query, so a query
    that matches many documents does not fill one task. It does so for a ``k`` up to a setting; for a
    larger one the rows of a query are ranked in parts by a salt of their id first.
    """
    spark = scored.sparkSession
    order = [F.desc(score_col) if descending else F.asc(score_col), *[F.asc(c) for c in tie_cols]]
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    if k is None:
        return scored.withColumn("rank", rank)
    if k > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        salted = scored.withColumn("__part", F.pmod(F.xxhash64(*tie_cols), F.lit(parts)))
        place = F.row_number().over(W.partitionBy("query_id", "__part").orderBy(*order))
        scored = salted.withColumn("__place", place).where(F.col("__place") <= k).drop("__part", "__place")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def match_terms(weights: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows(term, key, ...)`` joined by term with the weights of a batch of questions, a written table.

    Weights that do not fit in a broadcast are joined by term. A term with more than ``ROWS_PER_SALT`` rows is heavy: it gets a
    salt for each so many, its rows are dealt to them by their key, and its weights are copied to each. All other terms
    have one salt and no copies, and the heavy ones are few: at most one in ``ROWS_PER_SALT`` of all rows.
    """
    size = weights.agg(F.count("*").alias("rows"), F.countDistinct("term").alias("terms")).first()
    if size["terms"] <= PUSHED_TERMS:
        # A short question: the scan of a stored index can skip what does not hold these terms.
        few = weights.select("term").distinct().toArrow()["term"].to_pylist()
        rows = rows.where(F.col("term").isin(few))
    if size["rows"] <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(weights), "term")
    salts = F.ceil(F.count("*") / F.lit(ROWS_PER_SALT)).alias("salts")
    heavy = settle(rows.groupBy("term").agg(salts).where(F.col("salts") > 1), "heavy-terms")
    heavy = broadcast_if_fits(heavy, MAX_BROADCAST_ROWS)
    n = F.coalesce("salts", F.lit(1).cast("bigint"))
    dealt = rows.join(heavy, "term", "left").withColumn("salt", F.pmod(F.xxhash64(key), n)).drop("salts")
    copies = weights.join(heavy, "term", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return dealt.join(copies.drop("salts"), ["term", "salt"]).drop("salt")


def lexical_search(
    queries: DataFrame,
    idx: LexicalIndex,
    k: int = TOP_K,
    pad: bool = False,
    max_features: int | None = MAX_FEATURES,
) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: cosine top-k for all of ``queries(query_id, terms)``.

    Documents that share no term with the query score zero; they fill up to ``k`` rows by id if
    ``pad``, else they are left out.
    """
    weights = settle(query_weights(queries, idx.vocab, max_features), "query-weights")
    scored = (
        match_terms(weights, idx.postings)
        .groupBy("query_id", "doc_id")
        .agg(F.sum(F.col("query_weight") * F.col("weight")).alias("score"))
        .where(F.col("score") > 0)
        .withColumn("score", F.round("score", SCORE_DIGITS))
    )
    hits = top_k(scored, k).select("query_id", "rank", "doc_id", "score")
    return pad_hits(hits, queries, idx.docs, k) if pad else hits


def pad_hits(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Fill queries with fewer than ``k`` hits up with the first documents by id, at score zero.

    A query that is short has fewer than ``k`` hits, so the first ``k`` documents always suffice. The hits are written once, as
    they are read for what is missing and for the result.
    """
    hits = settle(hits, "hits")
    first = docs.orderBy("doc_id").limit(k).agg(F.collect_list("doc_id"))
    fill = queries.select("query_id", F.explode(first.scalar()).alias("doc_id")).join(
        hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"
    )
    both = hits.select("query_id", "doc_id", "score").unionByName(
        fill.select("query_id", "doc_id", F.lit(0.0).alias("score"))
    )
    return top_k(both, k).select("query_id", "rank", "doc_id", "score")


def search_text(
    queries: DataFrame,
    idx: LexicalIndex,
    k: int = TOP_K,
    mode: str = "word",
    lemmas: DataFrame | None = None,
    pad: bool = False,
) -> DataFrame:
    """:func:`lexical_search` for ``queries(query_id, text)``."""
    return lexical_search(analyze_queries(queries, "text", mode, lemmas=lemmas), idx, k, pad)
