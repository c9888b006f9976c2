import numpy as np
import pytest
from pyspark.sql import functions as F

from sievra.operators import clustering, vectors as V

SCHEMA = "doc_id INT, chunk_no INT, embedding ARRAY<DOUBLE>"


def table(spark, rows, partitions):
    data = [(i, 0, [float(x) for x in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(partitions, "doc_id")


def bundles(seed, n, dim, k, copies=0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(k, dim)) * 3)[rng.integers(0, k, n)] + rng.normal(size=(n, dim)) * 0.2
    return np.concatenate([x, np.repeat(x[:1], copies, axis=0)])


def test_nearest_centers_as_by_all_distances():
    rng = np.random.default_rng(1)
    rows, centers = rng.normal(size=(300, 5)), np.round(rng.normal(size=(40, 5)), 1)
    centers[7] = centers[3]
    apart = np.round(((rows[:, None] - centers[None]) ** 2).sum(axis=2), 9)
    want = np.lexsort((np.broadcast_to(np.arange(40), apart.shape), apart), axis=1)[:, :6]
    found, gaps = clustering.nearest_centers(rows, centers, 6)
    assert (found == want).all() and np.allclose(gaps, np.take_along_axis(apart, want, 1))
    assert clustering.nearest_centers(rows[:0], centers)[0].shape == (0, 1)


@pytest.mark.parametrize("copies", [0, 900])
def test_same_centres_for_any_partitioning(spark, copies):
    """Also with a vector that most rows repeat, which random seeds would take several times."""
    rows = bundles(2, 600, 8, 12, copies)
    trained = [clustering.train(table(spark, rows, p), 32, 2, seed=3, max_iter=4) for p in (1, 8, 40)]
    assert trained[0].shape == (2, 32, 4)
    assert all(np.array_equal(trained[0], t) for t in trained[1:])
    assert all(len(np.unique(part, axis=0)) == 32 for part in trained[0])


def test_lists_and_assignment_do_not_depend_on_partitions(spark):
    rows = bundles(4, 900, 12, 5, 500)
    placed = []
    for partitions in (1, 8, 200):
        vecs = table(spark, rows, partitions)
        idx = V.build_vector_index(vecs, nlist=64, subvectors=3, codes=16, seed=1, max_iter=3)
        assert idx.centroids.count() == 64 and idx.codebooks.count() == 48
        placed.append({r.doc_id: (r.list_id, tuple(r.codes)) for r in idx.lists.collect()})
    assert placed[0] == placed[1] == placed[2]


def test_every_list_is_filled_and_the_cost_is_low(spark):
    rows = bundles(5, 2000, 6, 20)
    vecs = table(spark, rows, 4)
    centers = clustering.train(vecs, 20, seed=1)[0]
    code, gap = (x[:, 0] for x in clustering.nearest_centers(rows, centers))
    assert set(code) == set(range(20)) and gap.mean() < 0.05 * rows.var(axis=0).sum()


def test_fewer_different_vectors_than_centres(spark):
    rows = np.repeat(np.eye(3), 50, axis=0)
    centers = V.train_centroids(table(spark, rows, 3), 8)
    assert centers.count() == 8 and centers.select("center").distinct().count() == 3
    assert {r.list_id for r in V.assign_lists(table(spark, rows, 3), centers).collect()} == {0, 1, 2}


def test_empty_centres_split_the_largest_list(spark):
    rows = np.array([[0.0, 0.0], [1.0, 0.0], [9.0, 0.0], [100.0, 100.0]])
    sample = table(spark, rows, 2).select(F.col("embedding").alias("v"))
    centers = [np.array([[1.0, 0.0], [100.0, 100.0], [500.0, 500.0], [500.0, 500.0]])]
    moved = clustering._step(sample, centers, 2.0**20)[0]
    assert moved[1].tolist() == [100.0, 100.0] and np.allclose(moved[0], [10 / 3, 0])
    assert moved[2].tolist() == [9.0, 0.0] and moved[3].tolist() == [500.0, 500.0]


def test_scatter_is_the_covariance(spark):
    rows = bundles(6, 300, 5, 3)
    found = clustering.scatter(table(spark, rows, 3))
    want = np.cov(rows.T)
    assert np.allclose(found / found[0, 0], want / want[0, 0], atol=1e-3)
    assert np.array_equal(found, clustering.scatter(table(spark, rows, 11)))


def test_no_vectors(spark):
    with pytest.raises(ValueError):
        clustering.train(table(spark, np.zeros((0, 2)), 1), 4)


def test_nearest_centres_that_single_precision_cannot_tell_apart():
    """Vectors far from zero, copies of centres, very small and very large numbers: as sums in double precision say."""
    rng = np.random.default_rng(2)
    for scale, offset in ((1.0, 0.0), (1e-3, 100.0), (1e-12, 0.0), (1e14, 0.0), (1e17, 0.0)):
        centers = rng.normal(size=(40, 6)) * scale + offset
        centers[30:] = centers[:10]
        rows = np.concatenate([centers[5:25], rng.normal(size=(80, 6)) * scale + offset])
        gaps = np.round(((rows[:, None] - centers[None]) ** 2).sum(axis=2), 9)
        order = np.argsort(gaps, axis=1, kind="stable")
        for n in (1, 7, 40):
            found, apart = clustering.nearest_centers(rows, centers, n)
            assert np.array_equal(found, order[:, :n]) and np.array_equal(apart, np.take_along_axis(gaps, order, 1)[:, :n])


def test_distance_matrix_is_made_in_single_precision(monkeypatch):
    """Half the bytes and time of doubles, for a training's work is in these products."""
    kinds, whole = [], clustering._nearest_of_block
    monkeypatch.setattr(clustering, "_nearest_of_block", lambda r, c, sides, *a: kinds.append(sides.dtype) or whole(r, c, sides, *a))
    clustering.nearest_centers(np.ones((3, 4)), np.eye(4))
    clustering.nearest_centers(np.ones((3, 4)) * 1e16, np.eye(4))
    assert kinds == [np.float32, np.float64]


def test_rows_with_one_centre_in_reach_are_not_looked_through_again(monkeypatch):
    """Of rows that lie at a centre, only those that lie between two are compared with their limit cell by cell."""
    centers = np.eye(64) * 4.0
    rows = np.concatenate([centers, (centers[:1] + centers[1:2]) / 2])
    looked, nonzero = [], np.nonzero
    monkeypatch.setattr(clustering.np, "nonzero", lambda x: (looked.append(x.size), nonzero(x))[1])
    found, gaps = clustering.nearest_centers(rows, centers)
    assert found[:, 0].tolist() == [*range(64), 0] and gaps[-1, 0] == 8.0 and sum(looked) < len(rows) * 64 // 10


def test_a_training_reads_vectors_as_bytes(spark, monkeypatch):
    rows, kinds, parts = np.arange(60.0).reshape(10, 6) - 20, [], clustering._step
    monkeypatch.setattr(clustering, "_step", lambda sample, *a: (kinds.append(sample.dtypes), parts(sample, *a))[1])
    clustering.train(table(spark, rows, 3), 2, 2, max_iter=1)
    assert kinds == [[("v", "binary")]]
    packed = table(spark, rows, 1).select(clustering._packed(F.col("embedding").cast("array<double>")).alias("v")).toArrow()["v"].combine_chunks()
    assert np.array_equal(clustering._unpacked(packed), rows) and np.array_equal(clustering._unpacked(packed[4:7]), rows[4:7])
