import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievra.llm import hard_negatives as hn
from tests.llm.helpers import rows

SCHEMA = "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, id STRING, score STRING, rank INT"


def plain(table, positives=5, negatives=10):
    """All pairs, one after the other."""
    held = []
    for i, e, label in table:
        if label is None or e is None or any(v is None or not np.isfinite(v) for v in e):
            continue
        held.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * v)) for v in e]))
    late = lambda i: (i is None, i)
    out = []
    for a, label, x in {(i, label, tuple(x)) for i, label, x in held if i is not None and i % 100 == 0}:
        scored = sorted(((-sum(p * q for p, q in zip(x, y)), late(i), i, other) for i, other, y in held), key=lambda s: s[:2])
        for p in [s for s in scored if s[3] == label and s[2] != a][:positives]:
            some = [s for s in scored if s[3] != label and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:negatives]
            out += [(a, p[2], r, s[2], -p[0], -s[0]) for r, s in enumerate(some, 1)]
    return sorted(out, key=repr)


def table(spark, data):
    return spark.createDataFrame([(*row, "x", "y", 3) for row in data], SCHEMA).repartition(3)


def vectors(seed, n, dim, labels, spread=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(labels, dim))
    label = rng.integers(0, labels, n)
    x = centers[label] + spread * rng.normal(size=(n, dim))
    x = np.where(rng.random((n, 1)) < 0.2, np.round(x), x / np.linalg.norm(x, axis=1, keepdims=True))
    return [(int(i), [float(v) for v in e], int(c)) for i, e, c in zip(rng.permutation(n * 2)[:n], x, label)]


@pytest.mark.parametrize("seed, dim, labels, spread", [(1, 8, 10, 0.3), (2, 3, 2, 2.0), (3, 20, 10, 1.0)])
def test_as_by_all_pairs(spark, seed, dim, labels, spread):
    data = vectors(seed, 700, dim, labels, spread)
    assert rows(hn.mined_embeddings(table(spark, data))) == plain(data)


def test_blocks_and_parts_change_nothing(spark):
    data = vectors(5, 500, 6, 4)
    df = table(spark, data)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hn.hard_negatives(df, F.col("id") % 100 == 0, moved, anchor_numbers=50, part_numbers=1000)
    assert rows(found) == plain(data)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = vectors(7, 150, 4, 3) + [
        (200, None, 1), (300, [0.1, None, 0.2, 0.3], 1), (400, [nan, 0.0, 0.0, 0.0], 1), (500, [0.0, inf, 0.0, 0.0], 2),
        (600, [0.5, 0.5, 0.5, 0.5], None), (None, [0.4, 0.2, -0.1, 0.3], 1), (None, [0.4, 0.2, -0.1, 0.3], 2), (700, [], 1),
        (800, [0.0, 0.0, 0.0, 0.0], 2), (901, [3.0, -2.0], 0), (901, [3.0, -2.0], 0), (1000, [1e6, 2.0, -1e7, 4.5], 1), (1001, [1e6, 1.0, -1e7, 4.5], 1),
        (1002, [7e5, 0.0, -6e6, 4.5], 2), (1100, [0.3, 0.1, 0.1, 0.0], 1), (1100, [0.3, 0.1, 0.1, 0.0], 1),
    ]
    padded = [(i, e if e is None else e + [0.0] * (4 - len(e)), c) for i, e, c in data]
    assert rows(hn.mined_embeddings(table(spark, data))) == plain(padded)


def test_equal_scores_go_by_id(spark):
    data = [(100, [1.0, 0.0], 1)] + [(i, [0.9, 0.0], 1) for i in range(1, 9)] + [(i, [0.5, 0.1], 2) for i in range(20, 60)]
    found = rows(hn.mined_embeddings(table(spark, data)))
    assert found == plain(data) and {r[1] for r in found} == {1, 2, 3, 4, 5}


def test_empty_tables_and_no_anchors(spark):
    assert hn.mined_embeddings(table(spark, vectors(1, 9, 2, 2)).limit(0)).collect() == []
    assert hn.mined_embeddings(table(spark, [(1, [1.0], 1), (2, [1.0], 2)])).collect() == []
    assert hn.mined_embeddings(table(spark, [(100, [1.0], 1)])).collect() == []


def test_numbers_beyond_doubles_are_exact():
    a, x = np.array([[2.0**40, 3.0]]), np.array([[2.0**20 + 1, 1.0], [2.0**60, 0.0]])
    found = hn.integer_scores(a, x, 2.0**100)
    assert found.tolist() == [[2**60 + 2**40 + 3, 2**63 - 1]]


def test_bounds_hold_every_score():
    rng = np.random.default_rng(4)
    for _ in range(200):
        dim = int(rng.integers(1, 6))
        a, x = (np.floor(256 * rng.normal(size=(n, dim)) * rng.choice([0.0, 0.01, 1.0, 50.0], (n, 1))) for n in (20, 30))
        refs = hn.fit_references(x, 4)
        (na, ta), (nx, tx) = hn.lengths_and_angles(a, refs), hn.lengths_and_angles(x, refs)
        lower, upper = hn.score_bounds(na, ta, (nx.min(), nx.max()), tx.min(axis=0), tx.max(axis=0))
        score = a @ x.T
        assert (score >= lower[:, None]).all() and (score <= upper[:, None]).all()


def test_far_windows_are_not_scored(monkeypatch):
    """Two bundles of directions at a right angle: once the best are known, the other bundle's windows are left out."""
    rng = np.random.default_rng(8)
    x = np.floor(256 * np.concatenate([np.eye(2)[[0] * 2000], np.eye(2)[[1] * 2000]]) @ np.eye(2, 6) + rng.normal(size=(4000, 6)))
    norm, angles = hn.lengths_and_angles(x, np.eye(2, 6))
    asked = []
    scores = hn.integer_scores
    monkeypatch.setattr(hn, "integer_scores", lambda a, w, b: asked.append(len(w)) or scores(a, w, b))

    class Sent:
        value = {
            "id": np.array([-1]), "label": np.array([0]), "x": x[:1], "norm": norm[:1], "angles": angles[:1],
            "least": np.full((1, 1), hn._LOW), "most": np.full((1, 1), hn._HIGH), "floor": np.full((1, 1), hn._LOW),
        }

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({
        "id": np.arange(4000), "label": np.zeros(4000, np.int64), "x": hn._lists(x), "norm": norm, "angles": hn._lists(angles),
    })
    hits = list(hn._search(Sent, 1, 5, True)(iter([batch])))[0]
    best = np.lexsort((np.arange(4000), -(x @ x[0])))[:5]
    assert sorted(hits["id"].to_pylist()) == sorted(best.tolist()) and sum(asked) <= 2048


def test_a_running_best_keeps_the_first_by_score_and_id():
    rng = random.Random(2)
    best = hn.Best(np.full(3, hn._LOW), 4)
    seen = [(rng.randrange(3), rng.randrange(6), i) for i in range(300)]
    for at in range(0, 300, 37):
        part = np.array(seen[at : at + 37])
        best.add(part[:, 0], part[:, 1], part[:, 2])
    key, score, ident = best.rows()
    want = [(k, -s, i) for k in range(3) for s, i in sorted((-s, i) for kk, s, i in seen if kk == k)[:4]]
    assert list(zip(key.tolist(), score.tolist(), ident.tolist())) == want
