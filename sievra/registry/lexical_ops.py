"""Queries and checks: TF-IDF index, lexical search, sampling, offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievra.operators import hits as H
from sievra.operators import lexical as L
from sievra.operators import sampling as P
from sievra.plans import search
from sievra.registry import fragments as S
from sievra.registry import inputs as I
from sievra.session import settle

SAMPLE = 500  # documents the vocabulary is fitted on where a query shows that


def _tf(spark, sf):
    return L.term_freq(I.tokens(spark, sf), colocated=True)


def _vocab(spark, sf):
    idx = I.lexical_index(spark, sf, SAMPLE)
    return idx.vocab.select("term", "term_id", "df", "ctf", F.round("idf", 6).alias("idf"))


def _df_limits(spark, sf):
    n = I.documents(spark, sf).agg(F.count("*"))
    return L.build_vocab(_tf(spark, sf), n, 3, 0.7, None).select("term", "df")


def _postings(spark, sf):
    idx = I.lexical_index(spark, sf)
    return idx.postings.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


def _norms(spark, sf):
    vocab = I.lexical_index(spark, sf).vocab
    norms = L.row_norms(_tf(spark, sf), vocab, I.LIMITS["max_features"])
    return norms.select("doc_id", F.round("norm", 5).alias("norm"))


def _unlimited(spark, sf):
    n = I.table(spark, sf, "documents").agg(F.count("*"))
    return L.build_vocab(_tf(spark, sf), n, 1, 1.0, None).select("term", "term_id", "df", "ctf", F.round("idf", 6).alias("idf"))


def _sampled_weights(spark, sf):
    """All documents weighed with a vocabulary that was fitted on the first of them."""
    postings = I.lexical_index(spark, sf, SAMPLE).postings
    return postings.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


def _sampled_search(spark, sf):
    return search.search_text(I.search_queries(spark, sf), I.lexical_index(spark, sf, SAMPLE))


def _stats(spark, sf):
    return L.lexical_stats(I.lexical_index(spark, sf)).select(
        "n_docs", "n_terms", "nnz", F.round("nnz_per_doc", 6).alias("nnz_per_doc"), F.round("sparsity", 6).alias("sparsity")
    )


def _search(spark, sf, **options):
    return search.search_text(I.search_queries(spark, sf), I.lexical_index(spark, sf), **options)


def _doc_counts(spark, sf):
    return P.doc_counts(spark.read.parquet(f"{sf}/documents.parquet")).select(F.sum("n").alias("n"))


def _offsets(spark, sf):
    counts = I.table(spark, sf, "documents").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("n"))
    return P.file_offsets(counts).select("file", "n", "start", "end")


def _titles(spark, sf):
    return search.search_with_titles(I.search_queries(spark, sf), I.lexical_index(spark, sf), I.titled_articles(spark, sf))


def _hit_ids(spark, sf):
    return settle(search.search_text(I.search_queries(spark, sf), I.lexical_index(spark, sf)), "hits")


def _urls(spark, sf):
    return H.lookup_urls(_hit_ids(spark, sf), I.id_url(spark, sf)).select("query_id", "rank", "doc_id", "url")


_OUT = "query_id, rank::INTEGER AS rank, doc_id, score"

REGISTRY = {
    "a01_term_freq": (_tf, f"WITH {S.TF} SELECT doc_id, term, tf FROM tf"),
    "a02_doc_freq": (
        lambda spark, sf: L.doc_freq(_tf(spark, sf)),
        f"WITH {S.TF} SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM tf GROUP BY term",
    ),
    "a03_build_vocab": (
        _vocab,
        f"WITH {S.lexical(SAMPLE)} SELECT term, term_id, df, ctf, round(idf, 6) AS idf FROM vocab",
    ),
    "a04_idf": (
        lambda spark, sf: I.lexical_index(spark, sf).vocab.select("term", F.round("idf", 6).alias("idf")),
        f"WITH {S.lexical()} SELECT term, round(idf, 6) AS idf FROM vocab",
    ),
    "a05_row_norm": (
        _norms,
        f"WITH {S.lexical()} SELECT doc_id, round(sqrt(sum(raw * raw)), 5) AS norm FROM raw GROUP BY doc_id",
    ),
    "a03_vocab_without_limit": (
        _unlimited,
        f"""WITH {S.TF}, f AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM tf GROUP BY term)
        SELECT term, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_id, df, ctf,
          round(ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0, 6) AS idf FROM f""",
    ),
    "a06_tfidf_sampled_vocab": (
        _sampled_weights,
        f"WITH {S.lexical(SAMPLE)} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM postings",
    ),
    "j01_lexical_search_sampled_vocab": (
        _sampled_search,
        f"WITH {S.lexical_hits(SAMPLE)} SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM hits",
    ),
    "a06_tfidf": (
        _postings,
        f"WITH {S.lexical()} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM postings",
    ),
    "a07_lexical_stats": (
        _stats,
        f"""WITH {S.lexical()}, s AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM vocab) AS n_terms, count(*) AS nnz FROM postings)
        SELECT n_docs, n_terms, nnz, round(nnz / n_docs, 6) AS nnz_per_doc, round(100 - 100 * nnz / (n_docs * n_terms), 6) AS sparsity FROM s""",
    ),
    "a08_doc_counts": (_doc_counts, "SELECT count(*) AS n FROM documents"),
    "f03_df_limits": (
        _df_limits,
        f"WITH {S.TF}, f AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT term, df FROM f WHERE df >= 3 AND df <= 0.7 * (SELECT count(*) FROM documents)",
    ),
    "f01_filter_prefix": (
        lambda spark, sf: P.filter_prefix(I.table(spark, sf, "conversations"), "text", "Th").select("conv_id", "turn", "text"),
        "SELECT conv_id, turn, text FROM conversations WHERE starts_with(text, 'Th')",
    ),
    "j01_lexical_search": (_search, f"WITH {S.lexical_hits()} SELECT {_OUT} FROM hits"),
    "j02_lexical_search_pad": (
        lambda spark, sf: _search(spark, sf, k=400, pad=True),
        f"""WITH {S.lexical_hits()},
        filled AS (SELECT item_id AS query_id, d.doc_id, coalesce(s.score, 0) AS score FROM benchmark AS b CROSS JOIN documents AS d
          LEFT JOIN scored AS s ON s.query_id = b.item_id AND s.doc_id = d.doc_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM filled)
        SELECT {_OUT} FROM r WHERE rank <= 400""",
    ),
    "l01_top_k": (
        lambda spark, sf: _search(spark, sf, k=3),
        f"WITH {S.lexical_hits()} SELECT {_OUT} FROM hits WHERE rank <= 3",
    ),
    "l04_first_n": (
        lambda spark, sf: P.first_n(I.table(spark, sf, "conversations"), 100, "conv_id", "turn").select("conv_id", "turn", "role"),
        "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 100",
    ),
    "l05_head_sample": (
        lambda spark, sf: P.head_sample(I.table(spark, sf, "documents"), SAMPLE, "doc_id").select("doc_id", "text"),
        f"SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT {SAMPLE}",
    ),
    "l06_random_sample": (
        lambda spark, sf: P.random_sample(I.table(spark, sf, "documents"), 100, 7, "doc_id").select("doc_id", "text"),
        "SELECT doc_id, text FROM documents ORDER BY md5(doc_id::VARCHAR || '|7'), doc_id LIMIT 100",
    ),
    "l07_file_offsets": (
        _offsets,
        """WITH c AS (SELECT source AS file, count(*) AS n FROM documents GROUP BY source),
        r AS (SELECT file, n, (sum(n) OVER (ORDER BY file))::BIGINT AS "end" FROM c)
        SELECT file, n, "end" - n AS start, "end" FROM r""",
    ),
    "j03_lookup_urls": (
        _urls,
        f"""WITH {S.lexical_hits()} SELECT query_id, rank::INTEGER AS rank, h.doc_id, CASE WHEN page_id IS NOT NULL THEN 'https://en.wikipedia.org/wiki/P' || page_id END AS url
        FROM hits AS h LEFT JOIN pages ON page_id = h.doc_id""",
    ),
    "j05_hit_texts": (
        lambda spark, sf: H.hit_texts(_hit_ids(spark, sf), I.table(spark, sf, "documents")),
        f"WITH {S.lexical_hits()} SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)",
    ),
    "f02_hit_documents": (
        lambda spark, sf: H.hit_texts(_hit_ids(spark, sf), I.table(spark, sf, "documents")).select("doc_id"),
        f"WITH {S.lexical_hits()} SELECT DISTINCT doc_id FROM hits",
    ),
    "j06_hydrate_hits": (
        lambda spark, sf: H.hydrate_hits(_hit_ids(spark, sf), I.titled_articles(spark, sf)),
        f"""WITH {S.lexical_hits()} SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 4) AS score, coalesce(url, 'Not found') AS title
        FROM hits LEFT JOIN pages ON page_id = doc_id""",
    ),
    "e08_search_with_titles": (
        _titles,
        f"""WITH {S.lexical_hits()} SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 4) AS score, coalesce(url, 'Not found') AS title
        FROM hits LEFT JOIN pages ON page_id = doc_id""",
    ),
}
