import itertools
import random

import numpy as np
import pytest

from sievra.llm import links, near_dedup
from sievra.llm.fingerprints import similar_documents
from tests.llm.helpers import SCHEMA, messy, rows, sentence, shingles

VOCABULARY = [f"w{i}" for i in range(400)]


def groups(docs, k, percent):
    """Components by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in docs}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def copies(seed, base_words, edits, n):
    """Near copies of one text whose similarity lies around 0.8, so links between them are not all to one."""
    rng = random.Random(seed)
    base = [rng.choice(VOCABULARY) for _ in range(base_words)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block_items", [1 << 18, 900])
def test_near_duplicates_as_by_all_pairs(spark, block_items):
    texts = copies(1, 60, 9, 120) + copies(2, 30, 4, 60) + copies(3, 9, 2, 60) + [sentence(n) for n in range(20)]
    docs = list(enumerate(texts, 100))
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(5)
    parts, sizes = groups(docs, 2, 80)
    found = {r.doc_id: r for r in near_dedup.near_duplicates(df, block_items=block_items).collect()}
    assert {i: r.component_id for i, r in found.items()} == parts
    assert {i: r.n_shingles for i, r in found.items()} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_link_rows_lose_no_component():
    rng = np.random.default_rng(3)
    for trial in range(30):
        items = [np.unique(rng.choice(30, 20)) for _ in range(25)]
        ask = np.r_[1, np.full(24, 2)]
        found = links.link_rows(np.arange(25), items, ask, np.arange(25), 65)
        up = list(range(25))
        find = lambda i: i if up[i] == i else find(up[i])
        for a, b in found:
            up[find(a)] = find(b)
        for a, b in itertools.combinations(range(25), 2):
            shared = len(np.intersect1d(items[a], items[b]))
            if 100 * shared >= 65 * (len(items[a]) + len(items[b]) - shared):
                assert find(a) == find(b)


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    df = spark.createDataFrame(chain + star + [(5000, 5000), (7002, 7001), (7001, 7002)], "a BIGINT, b BIGINT")
    found = dict(rows(links.components(df)))
    assert {found[i] for i in range(41)} == {0} and {found[1000 + i] for i in range(200)} == {1000}
    assert found[7002] == found[7001] == 7001 and 5000 not in found
    assert links.components(df.limit(0)).count() == 0


def test_near_duplicates_of_messy_rows(spark):
    found = near_dedup.near_duplicates(messy(spark)).collect()
    assert len(found) == 11
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[2].component_id == 1 and not by_id[2].kept and by_id[1].kept
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (3, 4, 5))
    assert by_id[6].n_shingles == 1 and by_id[6].kept
    assert by_id[7].component_id == 7
    assert near_dedup.near_duplicates(messy(spark).limit(0)).count() == 0


def test_a_row_without_id_follows_its_text(spark):
    df = spark.createDataFrame([(4, sentence(9)), (None, sentence(9)), (None, "a b c d")], "doc_id BIGINT, text STRING")
    assert rows(near_dedup.near_duplicates(df)) == [(4, 8, 4, True), (None, 3, None, True), (None, 8, 4, False)]


def test_keep_one_of_each_keeps_columns_and_clean_rows(spark):
    df = messy(spark)
    kept = near_dedup.keep_one_of_each(df)
    assert kept.schema == df.schema
    # Of the two equal rows of id 6 one stays.
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8]


def test_similar_documents_by_bands_of_minhash(spark):
    texts = copies(5, 80, 3, 40) + [sentence(n, n) for n in range(12)] + ["", None]
    docs = list(enumerate(texts))
    parts, _ = groups([(i, t) for i, t in docs if t], 5, 80)
    sizes = {}
    for i, p in parts.items():
        sizes[p] = sizes.get(p, 0) + 1
    want = sorted((i, p) for i, p in parts.items() if sizes[p] > 1)
    assert sorted(rows(similar_documents(spark.createDataFrame(docs, "doc_id BIGINT, text STRING")))) == want


def test_minmax_bands_meet_at_the_threshold():
    """Sets of similarity 0.8 share a band as often as the method promises."""
    rng = np.random.default_rng(9)
    missed = 0
    for _ in range(200):
        items = rng.integers(0, 2**63, 45, dtype=np.uint64)
        both = np.concatenate([items[:40], items[5:]])  # 35 of 45
        bands = near_dedup.band_values(near_dedup.minmax_signature(both, np.array([0, 40, 80])))
        missed += not (bands[0] == bands[1]).any()
    assert missed <= 1


def test_schema_is_not_needed_beyond_id_and_text(spark):
    assert "bands" in SCHEMA and near_dedup.near_duplicates(messy(spark)).columns == ["doc_id", "n_shingles", "component_id", "kept"]
