import numpy as np

from sievra.operators import vectors as V
from sievra.operators.neighbours import knn_exact
from sievra.registry import dense_ops


def test_exact_ranking_of_candidates_finds_what_codes_confuse(spark):
    rng = np.random.default_rng(3)
    rows = [(i // 3, i % 3, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 8)))]
    vecs = spark.createDataFrame(rows, "doc_id INT, chunk_no INT, embedding ARRAY<FLOAT>").repartition(4)
    asked = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 8)))]
    queries = spark.createDataFrame(asked, "query_id INT, embedding ARRAY<DOUBLE>")
    idx = V.build_vector_index(vecs, nlist=4, subvectors=2, codes=8, seed=1)
    truth = knn_exact(queries, vecs).orderBy("query_id", "rank")
    share = lambda found: V.recall(found, truth).first()["recall"]
    assert share(V.ivf_search(queries, idx)) < 0.9
    n = V.choose_candidates(queries, idx, vecs)
    assert 100 <= n <= 600
    assert share(V.ivf_search(queries, idx, vectors=vecs, candidates=n)) >= 0.9
    every = V.ivf_search(queries, idx, vectors=vecs, candidates=600).orderBy("query_id", "rank")
    assert every.collect() == truth.collect()
    joined = V.rerank(queries, truth.select("query_id", *V.IDS), vecs, max_query_numbers=0).orderBy("query_id", "rank")
    assert joined.collect() == truth.collect()


def test_registered_indexes_are_held_to_a_recall_of_nine_tenths():
    assert dense_ops.RECALL >= 0.9 and dense_ops._with_recall.__defaults__ == (dense_ops.RECALL,)
