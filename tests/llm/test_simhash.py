import re

import numpy as np
import pytest
import xxhash

from sievra.llm import simhash
from tests.llm.helpers import LOWER, messy, rows, sentence


def code(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts(codes, radius=3):
    """Smallest place reachable, by all pairs."""
    up = list(range(len(codes)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, c in enumerate(codes):
        for j in range(i):
            if (c ^ codes[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def joined(links, n):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def flipped(seed, centers, n, bits):
    """Random codes, and codes around them and around one another, so that there are chains and crowds."""
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 2**63, centers, dtype=np.uint64)
    for _ in range(3):
        some = codes[rng.integers(0, len(codes), n)]
        for _ in range(bits):
            some = some ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        codes = np.unique(np.concatenate([codes, some]))
    return codes


def test_fingerprints_as_by_hand(spark):
    texts = [sentence(n, n) for n in range(25)] + ["A b  C\n\tD", "a B c d", "x " * 50, "über ALLES ÜBER", "", None, " \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(3)
    found = dict(rows(df.sparkSession.createDataFrame(simhash.fingerprints(df).toPandas())))
    assert {i: c % 2**64 for i, c in found.items()} == {i: code(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("stretch", [3, 7, 100])
def test_long_texts_in_stretches(monkeypatch, stretch):
    monkeypatch.setattr(simhash, "HASHES", stretch)
    for n in (0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 99, 100, 101, 103, 206, 500):
        assert simhash.fingerprint(sentence(n, 1, 3).encode()) == code(sentence(n, 1, 3)), n


@pytest.mark.parametrize("seed, centers, n, bits, radius", [(1, 200, 300, 2, 3), (2, 3, 500, 1, 3), (3, 50, 100, 3, 0), (4, 10, 150, 4, 5), (5, 1, 0, 1, 3)])
def test_tree_links_all_within_the_radius(seed, centers, n, bits, radius):
    codes = flipped(seed, centers, n, bits) if n else np.array([7], np.uint64)
    links = simhash.joined_codes(codes, radius)
    want = parts([int(c) for c in codes], radius)
    assert joined(links, len(codes)) == want and len(links) == len(codes) - len(set(want))


def test_tree_keeps_children_by_distance():
    codes = flipped(6, 100, 400, 2)
    tree = simhash.BKTree(codes)
    assert sorted(tree.codes) == sorted(codes)
    seen = [0]
    for node in range(len(codes)):
        for d in range(65):
            children = range(tree.first[node, d], tree.first[node, d + 1])
            assert len(children) <= 1  # one child of each distance
            for child in children:
                seen.append(child)
                assert (int(tree.codes[node]) ^ int(tree.codes[child])).bit_count() == d == tree.edge[child]
    assert sorted(seen) == list(range(len(codes)))


def test_tree_search_leaves_edges_out(monkeypatch):
    codes = np.unique(np.random.default_rng(1).integers(0, 2**63, 4000, dtype=np.uint64))
    tree, visits = simhash.BKTree(codes), []
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: visits.append(len(x)) or count(x))
    found = [p for p in tree.within(codes[:200], 3)]
    assert sum(len(a) for a, _ in found) == 200 and sum(visits) < 0.5 * 200 * len(codes)


@pytest.mark.parametrize("goal, limit", [(8, 40), (64, 200), (1 << 20, 60)])
def test_shards_lose_no_link(spark, goal, limit):
    """A crowd around one code fills its shards, which are dealt again."""
    codes = np.unique(np.concatenate([flipped(7, 120, 200, 2), flipped(8, 1, 300, 1)]))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code BIGINT").repartition(3)
    place = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    links = [(place[r.a], place[r.b]) for r in simhash.code_links(df, 3, goal, limit).collect()]
    assert joined(links, len(codes)) == parts([int(c) for c in codes])


def test_components_of_messy_rows(spark):
    base = sentence(400, 2, 5)
    df = messy(spark, [(90, base, "en"), (91, base, "en"), (92, base.upper(), None), (93, base + " one", "en"), (None, base + " one", "en")])
    found = simhash.near_duplicates(df).collect()
    table = df.collect()
    assert len(found) == len(table)
    codes = [code(r.text) for r in table]
    least = {}
    for r, p in zip(table, parts(codes)):
        least[p] = min([i for i in (least.get(p), r.doc_id) if i is not None], default=None)
    want = [(r.doc_id, f"{c:016x}", least[p]) for r, c, p in zip(table, codes, parts(codes))]
    assert rows(simhash.near_duplicates(df)) == sorted(want, key=repr)
    assert {r.component_id for r in found if r.doc_id in (90, 91, 92)} == {90}
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_a_row_without_id_links_others(spark):
    near, between = sentence(600, 1, 3), None
    base = code(near)
    for n in range(1, 60):  # edits that move the fingerprint by a few bits
        between = near + " " + sentence(n, 9, 7)
        if 0 < (code(between) ^ base).bit_count() <= 3:
            break
    df = spark.createDataFrame([(5, near), (None, between), (None, "alone here now")], "doc_id BIGINT, text STRING")
    found = {r.fingerprint: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert found == {f"{base:016x}": 5, f"{code(between):016x}": 5, f"{code('alone here now'):016x}": None}


def test_query_against_all_pairs(spark):
    from sievra.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    codes = [code(r.text) for r in docs]
    want = [(r.doc_id, f"{c:016x}", docs[p].doc_id) for r, c, p in zip(docs, codes, parts(codes))]
    assert rows(queries.simhash_query(spark, sf)) == sorted(want, key=repr)
