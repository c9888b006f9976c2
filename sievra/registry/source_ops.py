"""Queries and checks: every source and sink, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievra.operators.analysis import analyze_queries
from sievra.operators.block_search import block_search, build_block_index
from sievra.operators import lexical as L
from sievra.operators import vectors as V
from sievra.plans import answer_runs as R
from sievra.registry import fragments as S
from sievra.registry import inputs as I
from sievra.session import scratch_path
from sievra.sources import arrow_stream, index_store, tables

DOCUMENT_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def _articles(spark, sf):
    return tables.read_articles(spark, f"{sf}/documents.parquet", DOCUMENT_SCHEMA)


def _arrow(spark, sf):
    folder = scratch_path(spark, "arrow")
    arrow_stream.register(spark)
    I.documents(spark, sf).write.format(arrow_stream.FORMAT_NAME).mode("append").save(f"file://{folder}" if folder.startswith("/") else folder)
    return spark.read.format(arrow_stream.FORMAT_NAME).load(folder)


def _written_tokens(spark, sf):
    path = scratch_path(spark, "tokens")
    tables.write_tokens(I.tokens(spark, sf), path)
    return path


def _tokens(spark, sf, *columns):
    out = tables.read_tokens(spark, _written_tokens(spark, sf), (*columns, "tokens"))
    return out.withColumn("tokens", F.array_join("tokens", " "))


def _questions(spark, sf):
    path = scratch_path(spark, "questions")
    I.all_questions(spark, sf).select(
        F.col("question").alias("question_text"), F.col("url").alias("document_url")
    ).write.json(path)
    return tables.read_questions(spark, path).select("question", "url")


def _runs(spark, sf):
    turns = I.dialogue_runs(spark, sf)
    return turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), "answer", "text", "model", "mode")


def _answers(spark, sf):
    path = scratch_path(spark, "answers")
    _runs(spark, sf).select("answer", "text").write.option("header", True).option("escape", '"').csv(path)
    return tables.read_answers(spark, path)


def _stored_runs(spark, sf):
    path = scratch_path(spark, "runs")
    tables.write_answers(_runs(spark, sf), path)
    return tables.read_runs(spark, path)


def _runs_by_line(spark, sf):
    path = scratch_path(spark, "runs")
    tables.write_answers(_runs(spark, sf), path, one_line=True)
    return tables.read_runs(spark, path, one_line=True)


def _cached(spark, sf):
    path = scratch_path(spark, "cached")
    pick = dict(prefix="Th", order=("conv_id", "turn"))
    R.cached_questions(spark, path, I.all_questions(spark, sf), **pick)
    # The second call finds the table and must not build it again.
    return tables.cached_table(spark, path, lambda: 1 / 0)


def _lexical(spark, sf):
    path = scratch_path(spark, "lexical")
    index_store.write_lexical_index(I.lexical_index(spark, sf), path)
    return index_store.read_lexical_index(spark, path)


def _stored_postings(spark, sf):
    return _lexical(spark, sf).postings.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


def _stored_search(spark, sf):
    return L.search_text(I.search_queries(spark, sf), _lexical(spark, sf))


def _blocks(spark, sf):
    path = scratch_path(spark, "term-blocks")
    index_store.write_block_index(build_block_index(I.dealt_index(spark, sf)), path)
    return index_store.read_block_index(spark, path)


def _stored_blocks(spark, sf):
    """What each term has in all blocks; no document is in two blocks."""
    blocks = _blocks(spark, sf).blocks
    return blocks.groupBy("term").agg(
        F.sum(F.size("entries")).alias("docs"), F.round(F.max("most"), 6).alias("most")
    )


def _block_search(spark, sf):
    asked = analyze_queries(I.search_queries(spark, sf))
    return block_search(asked, _blocks(spark, sf))


def _vector(spark, sf, index):
    path = scratch_path(spark, "vectors")
    index_store.write_vector_index(index(spark, sf), path)
    return index_store.read_vector_index(spark, path)


def _in_batches(spark, sf):
    """Trained on a third of the vectors; the other two thirds are added to what is stored, one after the other."""
    path = scratch_path(spark, "batches")
    vecs = I.vectors(spark, sf).select("vec_id", "embedding")
    first, *others = [vecs.where(F.col("vec_id") % 3 == i) for i in range(3)]
    index_store.write_vector_index(V.build_vector_index(first, ("vec_id",), subvectors=None, nprobe=V.MAX_LISTS, seed=7), path)
    for batch in others:
        index_store.add_vectors(batch, path)
    return path


def _grown_search(spark, sf):
    """All lists of an index of three batches: the hits of exact search."""
    return V.ivf_search(I.vector_queries(spark, sf), index_store.read_vector_index(spark, _in_batches(spark, sf)))


def _grown_positions(spark, sf):
    return index_store.read_id_map(spark, _in_batches(spark, sf)).select("vec_id", "pos", "bucket")


def _stored_lists(spark, sf):
    return _vector(spark, sf, I.code_index).lists.select(
        "vec_id", "list_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes")
    )


def _stored_ivf(spark, sf):
    return V.ivf_search(I.vector_queries(spark, sf), _vector(spark, sf, I.code_index))


def _stored_vectors(spark, sf):
    path = scratch_path(spark, "embedded")
    tables.write_vectors(I.chunk_vectors(spark, sf), path)
    rows = tables.read_vectors(spark, path).select("doc_id", "chunk_no", F.posexplode("embedding").alias("pos", "x"))
    return rows.where(F.col("x") != 0).select("doc_id", "chunk_no", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


def _skipped(spark, sf):
    path = _written_tokens(spark, sf)
    # Spark puts the unreadable file there, so this works on any shared folder.
    I.table(spark, sf, "region").limit(1).select(F.lit("this is no parquet file").alias("value")).write.mode("append").text(path)
    out = tables.read_tokens(spark, path, ("doc_id", "tokens"), skip_corrupt=True, schema="doc_id BIGINT, tokens ARRAY<STRING>")
    return out.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


_RUNS = """
runs AS (SELECT c.conv_id * 100 + c.turn AS question_id, c.text AS answer, d.text AS text, 'm' AS model,
  CASE WHEN (c.turn // 2) % 2 = 0 THEN 'without_rag' ELSE 'with_rag' END AS mode
  FROM conversations AS c LEFT JOIN documents AS d ON d.doc_id = c.conv_id WHERE c.role = 'assistant')"""
_ALL = "SELECT doc_id, text, lang, source, n_chars FROM documents"
_TOKENS = f"WITH {S.TOKENS} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM toks"
_HITS = "query_id, rank::INTEGER AS rank, {id}, score"
_Q = "'https://en.wikipedia.org/wiki/P' || (conv_id * 3)"

REGISTRY = {
    "s01_read_articles": (_articles, _ALL),
    "s02_arrow_stream": (_arrow, _ALL),
    "s03_read_tokens": (
        lambda spark, sf: _tokens(spark, sf, "doc_id"),
        _TOKENS,
    ),
    "s04_read_questions": (
        _questions,
        f"SELECT text AS question, {_Q} AS url FROM conversations WHERE role = 'user'",
    ),
    "s05_read_answers": (_answers, f"WITH {_RUNS} SELECT answer, text FROM runs"),
    "s06_write_tokens": (
        lambda spark, sf: _tokens(spark, sf, "doc_id", "lang", "source", "text"),
        f"WITH {S.TOKENS} SELECT doc_id, lang, source, text, array_to_string(tokens, ' ') AS tokens FROM toks",
    ),
    "s07_write_answers": (_stored_runs, f"WITH {_RUNS} SELECT question_id, answer, text, model, mode FROM runs"),
    "s07_write_answers_by_line": (_runs_by_line, f"WITH {_RUNS} SELECT question_id, answer, text, model, mode FROM runs"),
    "s08_cached_table": (
        _cached,
        f"""WITH q AS (SELECT text AS question, {_Q} AS url, conv_id, turn FROM conversations WHERE role = 'user' AND starts_with(text, 'Th') ORDER BY conv_id, turn LIMIT 1000)
        SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS question_id, question, url FROM q""",
    ),
    "s09_write_lexical_index": (
        _stored_postings,
        f"WITH {S.lexical()} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM postings",
    ),
    "s10_read_lexical_index": (
        _stored_search,
        f"WITH {S.lexical_hits()} SELECT {_HITS.format(id='doc_id')} FROM hits",
    ),
    "s09_write_block_index": (
        _stored_blocks,
        f"WITH {S.lexical()} SELECT term, count(*) AS docs, round(max(weight), 6) AS most FROM postings GROUP BY term",
    ),
    "s10_search_block_index": (
        _block_search,
        f"WITH {S.lexical_hits()} SELECT {_HITS.format(id='doc_id')} FROM hits",
    ),
    "s11_write_vector_index": (_stored_lists, f"WITH {S.CODES} SELECT vec_id, list_id, codes FROM codes"),
    "s11_positions_after_batches": (
        _grown_positions,
        """WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id % 3, vec_id) - 1 AS pos FROM embeddings)
        SELECT vec_id, pos, (pos // 1000000)::INTEGER AS bucket FROM r""",
    ),
    "v08_search_after_batches": (
        _grown_search,
        f"WITH {S.knn(S.l2('q.e', 'v.e'), 'ASC')} SELECT {_HITS.format(id='vec_id')} FROM hits",
    ),
    "s12_read_vector_index": (
        _stored_ivf,
        f"WITH {S.CODES},{S.ivf('codes', 'decoded')} SELECT {_HITS.format(id='vec_id')} FROM hits",
    ),
    "s13_write_vectors": (
        _stored_vectors,
        f"WITH {S.chunks(256, 206)},{S.hashed('chunks', 'doc_id, chunk_no', 'chunk', 'cv')} SELECT doc_id, chunk_no, pos, round(x, 6) AS x FROM cv",
    ),
    "s14_skip_corrupt": (_skipped, _TOKENS),
}
