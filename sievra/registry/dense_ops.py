"""Queries and checks: vectors, neighbours, inverted lists, codes, hits of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievra.functions.vector import choose_nlist, l2_normalize
from sievra.operators import hits as H
from sievra.operators import sampling as P
from sievra.operators import vectors as V
from sievra.operators.neighbours import knn_exact
from sievra.operators.vectors import embed_chunks
from sievra.plans import search
from sievra.registry import fragments as S
from sievra.registry import inputs as I
from sievra.session import scratch_path, settle
from sievra.sources import index_store

# Of the ten nearest by exact search, what a trained index has to find: its codes give candidates, whose exact vectors
# are ranked again. Hashed chunks of one language are almost equally far from a question and need more candidates.
RECALL = 0.9


def _numbers(c):
    """A vector as text, six decimals, for comparison."""
    return F.array_join(F.transform(c, lambda x: F.format_string("%.6f", F.round(x, 6) + F.lit(0.0))), " ")


def _knn(spark, sf, metric="l2"):
    return knn_exact(I.vector_queries(spark, sf), I.vectors(spark, sf), 10, metric, ("vec_id",))


def _normalized(spark, sf):
    return I.vectors(spark, sf).select("vec_id", F.posexplode(l2_normalize(F.col("embedding"))).alias("d", "x")).select(
        "vec_id", "d", F.round("x", 6).alias("x")
    )


def _nlist(spark, sf):
    sizes = I.table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    return sizes.select("source", "n", choose_nlist(F.col("n")).alias("nlist"))


def _lloyd(spark, sf):
    vecs = I.vectors(spark, sf)
    moved = V.lloyd_step(vecs, I.label_means(vecs))
    return moved.select("list_id", F.posexplode("center").alias("d", "x")).select("list_id", "d", F.round("x", 6).alias("x"))


def _trained(spark, sf):
    """One row about a training: vectors placed, lists wanted, and whether the cost falls with more iterations and is
    below that of the means of the given labels."""
    vecs = I.vectors(spark, sf)
    nlist = V.list_count(vecs)
    sample = settle(V.training_sample(vecs, nlist, 7, ("vec_id",)), "sample")
    few, many = (V.train_centroids(sample, nlist, seed=7, max_iter=i) for i in (1, 10))
    n, cost = _cost(vecs, many)
    return spark.range(1).select(
        F.lit(n).cast("bigint").alias("n"),
        F.lit(nlist).alias("nlist"),
        F.lit(cost < _cost(vecs, few)[1]).alias("cost_falls"),
        F.lit(cost < _cost(vecs, I.label_means(vecs))[1]).alias("below_labels"),
    )


def _cost(vecs, centroids):
    """Vectors placed, and their mean squared distance to the centre of their list."""
    gap = F.aggregate(F.zip_with("embedding", "center", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, b: a + b)
    placed = V.assign_lists(vecs, centroids).join(F.broadcast(centroids), "list_id")
    return tuple(placed.agg(F.count("*"), F.avg(gap)).first())


def _assigned(spark, sf):
    return I.flat_index(spark, sf).lists.select("vec_id", "list_id")


def _codes(spark, sf):
    return I.code_index(spark, sf).lists.select("vec_id", "list_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


def _trained_codes(spark, sf):
    """Codes of trained books, and whether the vectors they stand for are closer than with the parts of the label means."""
    vecs = settle(I.vectors(spark, sf).select("vec_id", "label", "embedding"), "vectors")
    books = V.pq_train(vecs, I.SUBVECTORS, 256, seed=7)
    error = _coding_error(vecs, books)
    limit = _coding_error(vecs, I.label_books(I.label_means(vecs)))
    coded = V.pq_encode(vecs.select("vec_id", "embedding"), books)
    return coded.select(
        "vec_id", F.size("codes").alias("n_codes"), (F.array_max("codes") < 256).alias("in_range"),
        F.lit(error < 0.5 * limit).alias("closer_than_labels"),
    )


def _coding_error(vecs, books):
    """Mean squared distance between vectors and what their codes stand for."""
    parts = V.pq_encode(vecs.select("vec_id", "embedding"), books).select("vec_id", F.posexplode("codes").alias("sub", "code"))
    decoded = parts.join(F.broadcast(books), ["sub", "code"])
    width = I.DIM // I.SUBVECTORS
    piece = F.slice("embedding", F.col("sub") * width + 1, F.lit(width))
    gap = F.aggregate(F.zip_with(piece, "center", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, b: a + b)
    return decoded.join(vecs, "vec_id").agg(F.sum(gap) / F.countDistinct("vec_id")).first()[0]


def _ivf(spark, sf, index):
    return V.ivf_search(I.vector_queries(spark, sf), index(spark, sf))


def _all_lists(spark, sf):
    idx = I.flat_index(spark, sf)
    return V.ivf_search(I.vector_queries(spark, sf), idx, nprobe=100)


def _rotated(spark, sf):
    vecs = I.vectors(spark, sf)
    turned = V.rotate(vecs, V.pq_rotation(vecs, I.SUBVECTORS))
    return knn_exact(turned.withColumnRenamed("vec_id", "query_id"), turned, 10, "l2", ("vec_id",))


def _report(spark, sf):
    return V.validate_vectors(I.vectors(spark, sf), I.DIM, ("vec_id",))


def _flat_numbers(df, *ids):
    rows = df.select(*ids, F.posexplode("embedding").alias("pos", "x"))
    return rows.where(F.col("x") != 0).select(*ids, "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


def _chunk_vectors(spark, sf):
    return _flat_numbers(I.chunk_vectors(spark, sf), "doc_id", "chunk_no")


def _query_vectors(spark, sf):
    return _flat_numbers(V.embed_queries(I.search_queries(spark, sf), dim=I.DIM), "query_id")


def _hash_vectors(spark, sf):
    docs = I.documents(spark, sf)
    return _flat_numbers(docs.select("doc_id", V.hash_embedding(F.col("text"), I.DIM).alias("embedding")), "doc_id")


def _chunk_hits(spark, sf):
    return settle(search.search_chunks(I.search_queries(spark, sf), I.chunk_vectors(spark, sf), dim=I.DIM), "hits")


def _dense(spark, sf):
    return _chunk_hits(spark, sf)


def _grouped(spark, sf):
    entry = lambda h: F.concat_ws(":", h["rank"].cast("string"), F.format_string("%.9f", h["score"]))
    return H.group_hits(_chunk_hits(spark, sf)).select(
        "query_id", "doc_id", F.array_join(F.transform("hits", entry), " ").alias("hits")
    )


def _best(spark, sf):
    return H.best_doc_hits(_chunk_hits(spark, sf))


def _label_hits(spark, sf):
    """Neighbours with the label standing for the document they belong to."""
    labels = I.vectors(spark, sf).select("vec_id", F.col("label").alias("doc_id"))
    hits = knn_exact(I.vector_queries(spark, sf), I.vectors(spark, sf), 10, "l2", ("vec_id",))
    return H.best_doc_hits(hits.join(labels, "vec_id"))


def _texts(spark, sf):
    found = search.search_texts(
        I.search_queries(spark, sf), I.chunk_vectors(spark, sf), I.table(spark, sf, "documents"), dim=I.DIM
    )
    return found.select("query_id", "doc_id", F.size("hits").alias("n_hits"), F.get("hits", F.lit(0))["rank"].alias("first"), "text")


def _positions(spark, sf):
    return P.assign_positions(I.chunk_vectors(spark, sf), "doc_id", "chunk_no")


def _mapped(spark, sf):
    """Positions of neighbours, doubled, so that half of them lie beyond the mapping."""
    vecs = I.vectors(spark, sf)
    id_map = P.assign_positions(vecs, "vec_id").select("bucket", "pos", F.concat(F.lit("v"), F.col("vec_id")).alias("doc_id"))
    hits = knn_exact(I.vector_queries(spark, sf), vecs, 10, "l2", ("vec_id",))
    placed = settle(hits.select("query_id", "rank", (F.col("vec_id") * 2).alias("pos")), "hits")
    return H.lookup_doc_ids(placed, id_map).select("query_id", "rank", "pos", "doc_id")


def _valid(spark, sf):
    """More neighbours asked for than the probed lists hold: only real rows come back."""
    found = V.ivf_search(I.vector_queries(spark, sf), I.flat_index(spark, sf), k=1000, nprobe=1)
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last_rank"))


def _ranks(spark, sf):
    return _knn(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last"))


def _recall(spark, sf):
    found = V.ivf_search(I.vector_queries(spark, sf), I.flat_index(spark, sf))
    truth = knn_exact(I.vector_queries(spark, sf), I.vectors(spark, sf), 10, "l2", ("vec_id",))
    return V.recall(found, truth, ("vec_id",)).select(F.round("recall", 6).alias("recall"))


def _built(spark, sf):
    """An index trained on the data, codes and rotation included: every vector is in one list, and with all lists
    searched its hits, ranked again by the exact vectors, are nearly all the true ones."""
    vecs = settle(I.vectors(spark, sf), "vectors")
    idx = V.build_vector_index(vecs, ("vec_id",), subvectors=I.SUBVECTORS, seed=7)
    return _with_recall(spark, idx, vecs, I.vector_queries(spark, sf), ("vec_id",))


def _share_found(stored, vecs, queries, ids):
    """Recall of an index against exact search, over all queries."""
    queries = settle(queries, "queries")
    candidates = V.choose_candidates(queries, stored, vecs)
    found = V.ivf_search(queries, stored, vectors=vecs, candidates=candidates)
    return V.recall(found, knn_exact(queries, vecs, 10, "l2", ids), ids).first()["recall"]


def _with_recall(spark, idx, vecs, queries, ids, least=RECALL):
    """Statistics of an index as it is stored and read again, and whether its hits reach a recall."""
    path = scratch_path(spark, "trained")
    index_store.write_vector_index(idx, path)
    stored = index_store.read_vector_index(spark, path)
    share = _share_found(stored, vecs, queries, ids)
    return V.vector_stats(stored).select("kind", "dim", "nlist", "nprobe", "total").withColumn("enough_recall", F.lit(share >= least))


def _trained_chunks(spark, sf):
    """Chunks embedded with 384 numbers, in an index that is trained, stored, read and searched."""
    vecs = settle(embed_chunks(I.documents(spark, sf)), "chunk-vectors")
    idx = V.build_vector_index(vecs, seed=7)
    return _with_recall(spark, idx, vecs, V.embed_queries(I.search_queries(spark, sf)), ("doc_id", "chunk_no"))


def _trained_hits(spark, sf):
    """Hits of chunks in a trained, stored index with 384 numbers: code tables give candidates, whose vectors stand beside them."""
    vecs = settle(embed_chunks(I.documents(spark, sf)), "chunk-vectors")
    path = scratch_path(spark, "trained")
    index_store.write_vector_index(V.build_vector_index(vecs, seed=7, keep_vectors=True), path)
    return search.search_chunks(I.search_queries(spark, sf), index_store.read_vector_index(spark, path))


_HITS = "query_id, rank::INTEGER AS rank, vec_id, score"
_DENSE = S.dense_hits("queries", "item_id", "text")
_QUERIES = "queries AS (SELECT item_id, text FROM benchmark)"
_NLIST = "pow(2, floor(log2(least(16384, floor(4 * sqrt({n})))) + 0.5))::INTEGER"

REGISTRY = {
    "v01_embed_chunks": (
        _chunk_vectors,
        f"WITH {S.chunks(256, 206)},{S.hashed('chunks', 'doc_id, chunk_no', 'chunk', 'cv')} SELECT doc_id, chunk_no, pos, round(x, 6) AS x FROM cv",
    ),
    "v02_l2_normalize": (
        _normalized,
        f"""WITH {S.VECTORS}, p AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS d FROM v)
        SELECT vec_id, d::INTEGER AS d, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM p""",
    ),
    "v03_choose_nlist": (
        _nlist,
        f"WITH s AS (SELECT source, sum(n_chars)::BIGINT AS n FROM documents GROUP BY source) SELECT source, n, {_NLIST.format(n='n')} AS nlist FROM s",
    ),
    "v04_train_centroids": (
        _trained,
        f"SELECT count(*) AS n, {_NLIST.format(n='count(*)')} AS nlist, true AS cost_falls, true AS below_labels FROM embeddings",
    ),
    "v04_lloyd_step": (
        _lloyd,
        f"""WITH {S.LISTS}, p AS (SELECT list_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS d FROM lists),
        moved AS (SELECT list_id, d, avg(x) AS x FROM p GROUP BY list_id, d),
        old AS (SELECT list_id, unnest(center) AS x, generate_subscripts(center, 1) - 1 AS d FROM centroids)
        SELECT old.list_id, old.d::INTEGER AS d, round(coalesce(moved.x, old.x), 6) AS x FROM old LEFT JOIN moved USING (list_id, d)""",
    ),
    "v05_assign_lists": (_assigned, f"WITH {S.LISTS} SELECT vec_id, list_id FROM lists"),
    "v06_pq_encode": (_codes, f"WITH {S.CODES} SELECT vec_id, list_id, codes FROM codes"),
    "v06_pq_train": (
        _trained_codes,
        f"SELECT vec_id, {I.SUBVECTORS}::INTEGER AS n_codes, true AS in_range, true AS closer_than_labels FROM embeddings",
    ),
    "v07_knn_exact": (_knn, f"WITH {S.knn(S.l2('q.e', 'v.e'), 'ASC')} SELECT {_HITS} FROM hits"),
    "v07_knn_exact_ip": (
        lambda spark, sf: _knn(spark, sf, "ip"),
        f"WITH {S.knn(S.dot('q.e', 'v.e'), 'DESC')} SELECT {_HITS} FROM hits",
    ),
    "v07_knn_exact_cosine": (
        lambda spark, sf: _knn(spark, sf, "cosine"),
        f"WITH {S.knn('list_cosine_similarity(q.e, v.e)', 'DESC')} SELECT {_HITS} FROM hits",
    ),
    "v08_ivf_search": (
        lambda spark, sf: _ivf(spark, sf, I.flat_index),
        f"WITH {S.LISTS},{S.ivf('lists', 'e')} SELECT {_HITS} FROM hits",
    ),
    "v08_ivf_search_codes": (
        lambda spark, sf: _ivf(spark, sf, I.code_index),
        f"WITH {S.CODES},{S.ivf('codes', 'decoded')} SELECT {_HITS} FROM hits",
    ),
    "v08_ivf_search_all_lists": (
        _all_lists,
        f"WITH {S.knn(S.l2('q.e', 'v.e'), 'ASC')} SELECT {_HITS} FROM hits",
    ),
    "v08_recall": (
        _recall,
        f"""WITH {S.LISTS},{S.ivf('lists', 'e')},
        truth AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({S.l2('q.e', 'v.e')}, 9), v.vec_id) AS rank FROM v AS q, v) WHERE rank <= 10)
        SELECT round(count(h.vec_id) / count(*), 6) AS recall FROM truth LEFT JOIN hits AS h USING (query_id, vec_id)""",
    ),
    "v08_build_vector_index": (
        _built,
        f"SELECT 'IVFPQ' AS kind, {I.DIM}::INTEGER AS dim, {_NLIST.format(n='count(*)')}::BIGINT AS nlist, 512::INTEGER AS nprobe, count(*) AS total, true AS enough_recall FROM embeddings",
    ),
    "v09_rotation": (_rotated, f"WITH {S.knn(S.l2('q.e', 'v.e'), 'ASC')} SELECT {_HITS} FROM hits"),
    "v10_validate_vectors": (
        _report,
        f"""SELECT count(*) AS n, count(*) FILTER (embedding IS NULL OR len(embedding) = 0) AS n_empty,
        min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim,
        count(*) FILTER (embedding IS NULL OR len(embedding) <> {I.DIM}) = 0 AS as_expected FROM embeddings""",
    ),
    "v11_hash_embedding": (
        _hash_vectors,
        f"WITH {S.hashed('documents', 'doc_id', 'text', 'hv')} SELECT doc_id, pos, round(x, 6) AS x FROM hv",
    ),
    "v12_embed_queries": (
        _query_vectors,
        f"WITH {_QUERIES},{S.hashed('queries', 'item_id', 'text', 'qv')} SELECT item_id AS query_id, pos, round(x, 6) AS x FROM qv",
    ),
    "a09_group_hits": (
        _grouped,
        f"""WITH {_QUERIES},{_DENSE} SELECT query_id, doc_id, string_agg(rank || ':' || format('{{:.9f}}', score), ' ' ORDER BY rank) AS hits FROM hits GROUP BY query_id, doc_id""",
    ),
    "a10_best_doc_hits": (
        _best,
        f"""WITH {_QUERIES},{_DENSE}, b AS (SELECT query_id, doc_id, min(score) AS score FROM hits GROUP BY query_id, doc_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id))::INTEGER AS rank, doc_id, score FROM b""",
    ),
    "l03_rerank_documents": (
        _label_hits,
        f"""WITH {S.knn(S.l2('q.e', 'v.e'), 'ASC')}, b AS (SELECT query_id, label AS doc_id, min(score) AS score FROM hits JOIN v USING (vec_id) GROUP BY query_id, label)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id))::INTEGER AS rank, doc_id, score FROM b""",
    ),
    "l02_rank_numbers": (
        _ranks,
        "SELECT vec_id AS query_id, least(10, (SELECT count(*) FROM embeddings)) AS n, 1::INTEGER AS first, least(10, (SELECT count(*) FROM embeddings))::INTEGER AS last FROM embeddings",
    ),
    "f04_valid_hits": (
        _valid,
        f"""WITH {S.LISTS}, own AS (SELECT list_id, count(*) AS n FROM lists GROUP BY list_id)
        SELECT vec_id AS query_id, least(n, 1000) AS n, least(n, 1000)::INTEGER AS last_rank FROM lists JOIN own USING (list_id)""",
    ),
    "a11_vector_stats": (
        lambda spark, sf: V.vector_stats(I.flat_index(spark, sf)),
        f"""WITH {S.LISTS}, s AS (SELECT list_id, count(*) AS n FROM lists GROUP BY list_id)
        SELECT 'IVFFlat' AS kind, {I.DIM}::INTEGER AS dim, (SELECT count(*) FROM centroids) AS nlist, {I.NPROBE}::INTEGER AS nprobe,
        sum(n)::BIGINT AS total, count(*) AS filled_lists, max(n) AS largest_list FROM s""",
    ),
    "a12_assign_positions": (
        _positions,
        f"""WITH {S.chunks(256, 206)}, r AS (SELECT doc_id, chunk_no, row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS pos FROM chunks)
        SELECT doc_id, chunk_no, pos, (pos // 1000000)::INTEGER AS bucket FROM r""",
    ),
    "j04_lookup_doc_ids": (
        _mapped,
        f"""WITH {S.knn(S.l2('q.e', 'v.e'), 'ASC')}, m AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, 'v' || vec_id AS doc_id FROM embeddings)
        SELECT query_id, rank::INTEGER AS rank, vec_id * 2 AS pos, coalesce(m.doc_id, 'Unknown_' || (vec_id * 2)) AS doc_id FROM hits LEFT JOIN m ON m.pos = vec_id * 2""",
    ),
    "e09_search_trained_index": (
        _trained_chunks,
        f"""WITH {S.chunks(256, 206)} SELECT 'IVFPQ' AS kind, 384::INTEGER AS dim, {_NLIST.format(n='count(*)')}::BIGINT AS nlist, 512::INTEGER AS nprobe,
        count(*) AS total, true AS enough_recall FROM chunks""",
    ),
    # Approximate, so no SQL; tests hold it against exact search.
    "e09_trained_hits": (_trained_hits, None),
    "e09_search_chunks": (
        _dense,
        f"WITH {_QUERIES},{_DENSE} SELECT query_id, rank::INTEGER AS rank, doc_id, chunk_no, score FROM hits",
    ),
    "e09_search_texts": (
        _texts,
        f"""WITH {_QUERIES},{_DENSE} SELECT query_id, doc_id, count(*)::INTEGER AS n_hits, min(rank)::INTEGER AS first, any_value(d.text) AS text
        FROM hits JOIN documents AS d USING (doc_id) GROUP BY query_id, doc_id""",
    ),
}
