import numpy as np
import pyarrow as pa
import pytest

from sievra.operators import neighbours as N


def by_hand(queries, vectors, k, metric, allowed=None):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    q, v = (unit(queries), unit(vectors)) if metric == "cosine" else (queries, vectors)
    rows = []
    for i in range(len(q)):
        score = ((q[i] - v) ** 2).sum(axis=1) if metric == "l2" else v @ q[i]
        cost = np.round(score if metric == "l2" else -score, 9)
        ids = np.arange(len(v)) if allowed is None else np.flatnonzero(allowed[i])
        best = sorted(ids, key=lambda j: (cost[j], j))[:k]
        rows += [(i, n, int(j), round(float(score[j]), 6) + 0.0) for n, j in enumerate(best, 1)]
    return rows


def frames(spark, queries, vectors, **extra):
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id INT, embedding ARRAY<DOUBLE>")
    rows = [(i // 4, i % 4, v.tolist()) for i, v in enumerate(vectors)]
    v = spark.createDataFrame(rows, "doc_id STRING, chunk_no INT, embedding ARRAY<DOUBLE>")
    return q, v.selectExpr("lpad(doc_id, 6, '0') AS doc_id", "chunk_no", "embedding").repartition(5)


def listed(hits):
    rows = hits.orderBy("query_id", "rank").collect()
    return [(r.query_id, r["rank"], int(r.doc_id) * 4 + r.chunk_no, round(r.score, 6) + 0.0) for r in rows]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 12))
    vectors[::3] = vectors[0]  # a third of all vectors are copies of one
    vectors[7] = 0
    queries = np.concatenate([rng.normal(size=(20, 12)), vectors[:3], np.zeros((1, 12))])
    return queries, vectors


@pytest.mark.parametrize("metric", N.METRICS)
def test_broadcast_and_blocks_agree_with_brute_force(spark, data, metric):
    q, v = frames(spark, *data)
    expected = by_hand(*data, 7, metric)
    assert listed(N.knn_exact(q, v, 7, metric)) == expected
    blocks = N.knn_exact(q, v, 7, metric, max_query_numbers=60, block_numbers=500)
    assert listed(blocks) == expected


def test_more_neighbours_than_vectors(spark, data):
    q, v = frames(spark, data[0][:2], data[1][:5])
    assert listed(N.knn_exact(q, v, 50)) == by_hand(data[0][:2], data[1][:5], 50, "l2")


def test_large_k_is_ranked_in_parts(spark, data):
    q, v = frames(spark, *data)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", 5)
    try:
        assert listed(N.knn_exact(q, v, 9)) == by_hand(*data, 9, "l2")
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_no_queries_and_unknown_metric(spark, data):
    q, v = frames(spark, *data)
    assert N.knn_exact(q.where("query_id < 0"), v, 3).count() == 0
    with pytest.raises(ValueError):
        N.knn_exact(q, v, 3, "manhattan")


def test_lists_limit_what_is_compared_and_may_be_hot(spark, data):
    queries, vectors = data
    lists = np.where(np.arange(len(vectors)) % 2 == 0, 0, np.arange(len(vectors)) % 7)
    q, v = frames(spark, queries, vectors)
    v = v.selectExpr("*", "int(doc_id) * 4 + chunk_no AS n").selectExpr(
        "doc_id", "chunk_no", "embedding", "if(n % 2 = 0, 0, int(n % 7)) AS list_id"
    )
    probes = [[0, 3] if i % 2 else [int(i % 7), 5, 99] for i in range(len(queries))]
    q = q.join(spark.createDataFrame(list(enumerate(probes)), "query_id INT, lists ARRAY<INT>"), "query_id")
    allowed = [np.isin(lists, p) for p in probes]
    expected = by_hand(queries, vectors, 6, "l2", allowed)
    ids = ["doc_id", "chunk_no"]
    assert listed(N.nearest(q, v, ids, 6, "l2")) == expected
    assert listed(N.nearest(q, v, ids, 6, "l2", max_query_numbers=40, block_numbers=300)) == expected


def test_plan_ranks_in_tasks_first(spark, data):
    q, v = frames(spark, *data)
    plan = N.knn_exact(q, v, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_task_hands_over_k_rows_a_query(spark):
    """Fifty batches, with copies and ties across them: at most k rows a query leave, and they are the best."""
    import pyarrow as pa

    from sievra.operators import neighbours as N

    rng = np.random.default_rng(3)
    rows = np.round(rng.normal(size=(2500, 4)), 1)
    rows[1200:1300] = rows[7]
    asked = np.concatenate([rows[[7, 900]], rng.normal(size=(3, 4))])
    batches = []
    for at in range(0, 2500, 50):
        part = [r.tolist() for r in rows[at : at + 50]]
        names = [f"n{i % 97:02d}" for i in range(at, at + 50)]
        batches.append(pa.RecordBatch.from_pydict({"doc_id": names, "chunk_no": list(range(at, at + 50)), "embedding": part}))
    scan = N._scan(pa.array(range(5)), asked, None, ["doc_id", "chunk_no"], 10, "l2", N.embedding_matrix)
    out = pa.Table.from_batches(list(scan(iter(batches))))
    assert out.num_rows == 50
    cost = np.round(((asked[:, None] - rows[None]) ** 2).sum(axis=2), 9)
    for q in range(5):
        best = sorted(range(2500), key=lambda i: (cost[q, i], f"n{i % 97:02d}", i))[:10]
        mine = [(r["chunk_no"], r["score"]) for r in out.to_pylist() if r["query_id"] == q]
        assert mine == [(i, cost[q, i]) for i in best]


def test_waiting_rows_are_sorted_in_between(monkeypatch):
    import pyarrow as pa

    from sievra.operators import neighbours as N

    monkeypatch.setattr(N.RunningBest, "WAITING", 20)
    rng, best, seen = np.random.default_rng(1), N.RunningBest(2, 3, ["i"]), []
    for at in range(0, 400, 8):
        cost, q = np.round(rng.random(8), 1), rng.integers(0, 2, 8)
        best.add(q, pa.table({"i": list(range(at, at + 8))}), np.arange(8), cost)
        seen += zip(q.tolist(), cost.tolist(), range(at, at + 8))
    found = pa.Table.from_batches(list(best.hits(pa.array(["a", "b"]), "l2"))).to_pylist()
    want = [("ab"[k], i, c) for k in (0, 1) for c, i in sorted((c, i) for q, c, i in seen if q == k)[:3]]
    assert [(r["query_id"], r["i"], r["score"]) for r in found] == want


def test_a_query_goes_once_to_a_block_of_many_lists(spark, data):
    """Lists share blocks, a large one has several; a query's lists of a block are bits of one row."""
    import pyarrow as pa

    first, cuts = N._cut_lists(np.array([3, 4, 3, 25, 1, 9, 10]), 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 4, 5] and cuts.tolist() == [1, 1, 1, 3, 1, 1, 1]
    lists = np.arange(50, dtype=np.int32)
    batch = pa.RecordBatch.from_pydict({"query_id": [7, 8, 9], "lists": pa.array([list(range(50)), [0, 99], None], pa.list_(pa.int32()))})
    rows = pa.Table.from_batches(N._to_blocks(lists, [lists[:30], lists[30:]])(iter([batch]))).to_pylist()
    assert [(r["query_id"], r["__vb"]) for r in rows] == [(7, 0), (8, 0), (7, 1)]
    assert [int.from_bytes(r["__bits"], "big").bit_count() for r in rows] == [30, 1, 20]


def test_ties_beyond_k_do_not_wait_for_other_queries(monkeypatch):
    """Rows that are all alike tie for every query; of each portion of queries only k rows a query are kept."""
    monkeypatch.setattr(N, "MAX_CELLS", 1000)
    kept, add = [], np.concatenate
    monkeypatch.setattr(N.np, "concatenate", lambda parts, *a, **b: (kept.append(sum(len(p) for p in parts)), add(parts, *a, **b))[1])
    rows = np.ones((500, 4))
    q, r, cost = N._nearest(np.zeros((40, 4)), rows, np.arange(500), 3, "l2", np.full(40, np.inf))
    assert r.tolist() == [0, 1, 2] * 40 and max(kept) == 120 and (cost == 4).all()


def test_hits_of_queries_in_one_block_are_ranked_where_they_are_found(spark, monkeypatch):
    """Lists of several blocks, repeated and null ids among queries and vectors, in portions of few queries: as by one broadcast."""
    rng = np.random.default_rng(11)
    rows = np.round(rng.normal(size=(300, 3)), 1)
    rows[40:60] = rows[3]
    data = [(i // 2 if i % 30 else None, int(i % 4 if i < 200 else 4), [float(x) for x in r]) for i, r in enumerate(rows)]
    vecs = spark.createDataFrame(data, "vec_id INT, list_id INT, embedding ARRAY<DOUBLE>").repartition(3)
    asked = [(i if i not in (7, 8) else 6 if i == 7 else None, [i % 5] if i % 9 else [i % 5, 2], [float(x) for x in rows[i]]) for i in range(60)]
    queries = spark.createDataFrame(asked, "query_id INT, lists ARRAY<INT>, embedding ARRAY<DOUBLE>")
    key = lambda df: sorted((str(r.query_id), r["rank"], str(r.vec_id), r.score) for r in df.collect())
    want = key(N.nearest(queries, vecs, ["vec_id"], 20, "l2"))
    ranked, search = [], N._ranked_blocks
    monkeypatch.setattr(N, "_ranked_blocks", lambda *a: (ranked.append(a), search(*a))[1])
    monkeypatch.setattr(N, "MAX_HITS", 100)
    found = N.nearest(queries, vecs, ["vec_id"], 20, "l2", max_query_numbers=60, block_numbers=3 * 80)
    assert key(found) == want and len(ranked) == 1
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert [x.tolist() for x in N._cut_lists(np.array([5, 30, 7, 90]), 10, 40)] == [[0, 1, 2, 3], [1, 1, 1, 9]]


def test_few_cells_are_ranked_and_few_pairs_summed(monkeypatch):
    """A limit from some rows, or one from before, leaves what is found as it is, copies among the best included."""
    rng = np.random.default_rng(3)
    queries, rows, ranks, cells, pairs = rng.normal(size=(8, 4)), rng.normal(size=(20_000, 4)), np.arange(20_000), [], []
    rows[7000:7003] = rows[5]
    partition, exact = np.partition, N._exact
    monkeypatch.setattr(N.np, "partition", lambda x, *a, **b: (cells.append(x.size), partition(x, *a, **b))[1])
    monkeypatch.setattr(N, "_exact", lambda a, b, q, r, metric: (pairs.append(len(q)), exact(a, b, q, r, metric))[1])
    for metric, gaps in (("l2", ((queries[:, None] - rows[None]) ** 2).sum(axis=2)), ("ip", -queries @ rows.T)):
        want = np.argsort(np.round(gaps, 9), axis=1, kind="stable")[:, :5]
        bound = np.full(8, np.inf)
        for n in (8 * 20_000 // 4, 0):
            cells.clear(), pairs.clear()
            q, r, cost = N._nearest(queries, rows, ranks, 5, metric, bound)
            assert r.reshape(8, 5).tolist() == want.tolist() and sum(cells) <= n and sum(pairs) < 8 * 20_000 // 100
            bound = cost.reshape(8, 5)[:, -1].copy()


def test_few_near_rows_need_no_product(monkeypatch):
    rng = np.random.default_rng(4)
    asked, rows = rng.normal(size=(5, 4)), rng.normal(size=(1000, 4))
    near = rng.random((5, 1000)) < 0.01
    near[:, :3] = True
    monkeypatch.setattr(N, "rough_costs", lambda *a: 1 / 0)
    best = N.RunningBest(5, 3, ["i"])
    N.add_best(best, asked, rows, near, pa.table({"i": np.arange(1000)}), 0, "l2")
    gaps = np.where(near, ((asked[:, None] - rows[None]) ** 2).sum(axis=2), np.inf)
    assert next(best.hits(pa.array(range(5)), "l2")).column("i").to_pylist() == np.argsort(gaps, axis=1)[:, :3].ravel().tolist()
