import numpy as np
import pytest

from sievra.operators import vectors as V
from sievra.operators.neighbours import knn_exact
from sievra.sources import index_store


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    return rng.normal(size=(12, 8))[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 8))


def table(spark, rows, at):
    data = [(i // 3, i % 3, [float(x) for x in rows[i]]) for i in at]
    return spark.createDataFrame(data, "doc_id INT, chunk_no INT, embedding ARRAY<DOUBLE>").repartition(3)


def listed(hits):
    return sorted((r.query_id, r["rank"], r.doc_id, r.chunk_no, round(r.score, 6)) for r in hits.collect())


def positions(spark, path):
    return {r.pos: (r.doc_id, r.chunk_no) for r in index_store.read_id_map(spark, path).collect()}


@pytest.mark.parametrize("options", [dict(subvectors=None), dict(subvectors=4, codes=16, keep_vectors=True)])
def test_batches_make_the_index_of_all(spark, rows, tmp_path, options):
    path = str(tmp_path / "idx")
    queries = spark.createDataFrame([(i, [float(x) for x in rows[i * 11] + 0.02]) for i in range(20)], "query_id INT, embedding ARRAY<DOUBLE>")
    idx = V.build_vector_index(table(spark, rows, range(0, 600, 2)), nlist=8, nprobe=8, seed=1, max_iter=4, **options)
    index_store.write_vector_index(idx, path)
    before, placed = index_store.read_vector_index(spark, path), positions(spark, path)
    search = dict(share=1.0) if "codes" in options else {}
    old_hits = listed(V.ivf_search(queries, before, k=5, **search))
    assert index_store.add_vectors(table(spark, rows, range(1, 300, 2)), path) == 150
    # The second batch holds one that is stored already, and the first batch comes again.
    assert index_store.add_vectors(table(spark, rows, [1, *range(301, 600, 2)]), path) == 150
    assert index_store.add_vectors(table(spark, rows, range(1, 300, 2)), path) == 0
    grown = index_store.read_vector_index(spark, path)
    every = table(spark, rows, range(600))
    assert listed(V.ivf_search(queries, grown, k=5, **search)) == listed(knn_exact(queries, every, 5))
    assert grown.lists.count() == 600 and before.lists.count() == 300
    assert listed(V.ivf_search(queries, before, k=5, **search)) == old_hits  # what was loaded keeps its rows
    now = positions(spark, path)
    assert sorted(now) == list(range(600)) and all(now[p] == i for p, i in placed.items())
    index_store.merge_segments(spark, path)
    merged = index_store.read_vector_index(spark, path)
    index_store.drop_old_builds(spark, path)
    assert positions(spark, path) == now and merged.lists.count() == 600
    assert listed(V.ivf_search(queries, merged, k=5, **search)) == listed(knn_exact(queries, every, 5))
    left = [f.name for f in next((tmp_path / "idx" / "builds").iterdir()).joinpath("lists").iterdir() if f.is_dir()]
    assert len(left) == 1


def test_a_batch_that_broke_off_and_one_of_another_writer(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "idx")
    index_store.write_vector_index(V.build_vector_index(table(spark, rows, range(300)), nlist=4, subvectors=None, seed=1, max_iter=2), path)
    write = index_store._write_segment

    def broken(*args):
        write(*args)
        raise OSError("lost")

    monkeypatch.setattr(index_store, "_write_segment", broken)
    with pytest.raises(OSError):
        index_store.add_vectors(table(spark, rows, range(300, 400)), path)
    assert index_store.read_vector_index(spark, path).lists.count() == 300

    def overtaken(*args):
        made = write(*args)
        last = index_store._latest(spark, path)
        index_store._publish(spark, path, last["build"], last["segments"], last["vectors"])
        return made

    monkeypatch.setattr(index_store, "_write_segment", overtaken)
    with pytest.raises(RuntimeError):
        index_store.add_vectors(table(spark, rows, range(300, 400)), path)
    monkeypatch.setattr(index_store, "_write_segment", write)
    assert index_store.add_vectors(table(spark, rows, range(300, 400)), path) == 100
    assert sorted(positions(spark, path)) == list(range(400))
