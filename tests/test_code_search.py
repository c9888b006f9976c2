import numpy as np
import pyarrow as pa
import pytest

from sievra.operators import code_search as C, neighbours as N, vectors as V
from sievra.operators.neighbours import knn_exact
from sievra.sources import index_store


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 12))[rng.integers(0, 40, 1500)] + 0.4 * rng.normal(size=(1500, 12))
    x[900:960] = x[3]
    return x


@pytest.fixture(scope="module")
def vecs(spark, rows):
    data = [(i // 3, i % 3, [float(v) for v in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id INT, chunk_no INT, embedding ARRAY<DOUBLE>").repartition(5, "doc_id")


def asked(spark, rows, n=30):
    data = [(f"q{i}", [float(v) + 0.05 for v in rows[i * 7]]) for i in range(n)]
    return spark.createDataFrame(data, "query_id STRING, embedding ARRAY<DOUBLE>")


def test_tables_give_the_distances_of_decoded_vectors():
    rng = np.random.default_rng(2)
    books, centers = rng.normal(size=(3, 5, 4)), rng.normal(size=(20, 12))
    codes, turned = rng.integers(0, 5, (20, 3)), rng.normal(size=(6, 12))
    for own in (None, centers):
        decoded = np.concatenate([books[j, codes[:, j]] for j in range(3)], axis=1) + (0 if own is None else own)
        found = C.rough_costs(C.query_tables(turned, books), turned, codes, C.row_numbers(codes, own, books), own)
        want = ((turned[:, None] - decoded[None]) ** 2).sum(axis=2) - (turned**2).sum(axis=1)[:, None]
        assert np.allclose(found, want)


@pytest.mark.parametrize("rotated, residual", [(False, False), (True, True)])
def test_search_is_exact_with_all_and_close_with_some_candidates(spark, rows, vecs, tmp_path, rotated, residual):
    path = str(tmp_path / "idx")
    idx = V.build_vector_index(vecs, nlist=16, subvectors=4, codes=16, rotated=rotated, residual=residual, nprobe=16, seed=1, max_iter=4, keep_vectors=True)
    index_store.write_vector_index(idx, path)
    stored = index_store.read_vector_index(spark, path)
    queries = asked(spark, rows)
    truth = knn_exact(queries, vecs, 10)
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.chunk_no, round(r.score, 6)) for r in df.collect())
    assert key(V.ivf_search(queries, stored, share=1.0)) == key(truth)
    assert V.recall(V.ivf_search(queries, stored), truth).first()["recall"] >= 0.9
    # Rows stand beside their codes: nothing is joined, and blocks of queries change nothing.
    found = V.ivf_search(queries, stored, nprobe=4, share=1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    turned = V.probe_lists(V.rotate(queries, stored.rotation) if rotated else queries, stored.centroids, 4)
    given = turned.withColumnRenamed("embedding", "turned").join(queries, "query_id")
    books = np.stack(V._books(stored.codebooks))
    blocks = C.search_codes(given, stored.lists, ["doc_id", "chunk_no"], 10, books, *V._center_matrix(stored.centroids), residual, 1.0, max_query_numbers=600)
    assert key(blocks) == key(found)


def test_no_queries(spark, vecs):
    idx = V.build_vector_index(vecs, nlist=4, subvectors=4, codes=8, seed=1, max_iter=2, keep_vectors=True)
    none = spark.createDataFrame([], "query_id STRING, embedding ARRAY<DOUBLE>")
    assert V.ivf_search(none, idx).collect() == []


def test_trained_hits_of_the_given_tables(spark):
    """The registered query against exact search over the same chunks."""
    import __spark_entry__ as entry
    from sievra.registry import inputs as I

    sf = "/root/testdata/sf0.001"
    found = entry.queries()["e09_trained_hits"](spark, sf)
    truth = knn_exact(V.embed_queries(I.search_queries(spark, sf)), V.embed_chunks(I.documents(spark, sf)))
    assert found.columns == ["query_id", "rank", "doc_id", "chunk_no", "score"]
    assert V.recall(found, truth).first()["recall"] >= 0.9


def test_few_of_the_rows_near_by_code_are_summed_exactly(monkeypatch):
    """Of the share of a batch, a product tells which may be among the best; what is found is as if all were summed."""
    rng = np.random.default_rng(1)
    rows, asked = rng.normal(size=(2000, 16)), rng.normal(size=(20, 16))
    rows[500:520] = rows[7]
    near = rng.random((20, 2000)) < 0.15
    table, summed, exact = pa.table({"i": np.arange(2000)}), [], N._exact
    monkeypatch.setattr(N, "_exact", lambda q, r, a, b, metric: summed.append(len(a)) or exact(q, r, a, b, metric))
    best = N.RunningBest(20, 10, ["i"])
    for at in (0, 1000):
        N.add_best(best, asked, rows[at : at + 1000], near[:, at : at + 1000], table.slice(at, 1000), 0, "l2")
    hits = next(best.hits(pa.array(range(20)), "l2"))
    gaps = np.round(((asked[:, None] - rows[None]) ** 2).sum(axis=2), 9)
    gaps[~near] = np.inf
    assert hits.column("i").to_pylist() == np.argsort(gaps, axis=1, kind="stable")[:, :10].ravel().tolist()
    assert sum(summed) < 0.2 * near.sum()


def test_a_batch_is_compared_with_the_queries_that_ask_for_its_lists(monkeypatch):
    rng = np.random.default_rng(2)
    rows, asked, centers = rng.normal(size=(60, 4)), rng.normal(size=(9, 4)), rng.normal(size=(3, 4))
    lists, compared, add = np.repeat([2, 5, 7], 20), [], C.add_best
    monkeypatch.setattr(C, "add_best", lambda best, q, *a: (compared.append(len(q)), add(best, q, *a))[1])
    sent = type("Sent", (), {"value": {
        "query_ids": pa.array(range(9)), "asked": asked, "turned": asked, "books": rng.normal(size=(2, 3, 2)), "query": np.arange(9), "place": np.arange(9) % 3,
        "list_ids": np.array([2, 5, 7]), "centers": centers, "residual": True,
    }})
    table = pa.table({"list_id": lists, "i": np.arange(60), "codes": rng.integers(0, 3, (60, 2)).tolist(), "embedding": rows.tolist()})
    found = pa.Table.from_batches(C._scan(sent, ["i"], 4, 1.0)(iter(table.to_batches(max_chunksize=20))))
    gaps = ((asked[:, None] - rows[None]) ** 2).sum(axis=2)
    gaps[(np.arange(9) % 3)[:, None] != (np.arange(60) // 20)[None]] = np.inf
    assert found["i"].to_pylist() == np.argsort(gaps, axis=1)[:, :4].ravel().tolist() and compared == [3, 3, 3]
