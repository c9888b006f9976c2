import hashlib
import zlib

import pytest

from sievra.llm import merkle
from tests.llm.helpers import messy, rows


def digest(*nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    values = dict(row, n_chars=None if row["n_chars"] is None else row["n_chars"] + more)
    return digest(*[framed(values[f]) for f in merkle.FIELDS])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, i):
    for level in levels[:-1]:
        yield (level[i ^ 1], i & 1) if i ^ 1 < len(level) else None
        i >>= 1


def plain(table):
    """Manifest, proofs and folds by hand."""
    groups = {}
    for r in table:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    trees = [tree([leaf_of(r) for r in groups[g]]) for g in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = [*way(trees[k], i), *way(top, k)]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf_of(r, int(hit))
            for s in steps:
                node = digest(node) if s is None else digest(s[0], node) if s[1] else digest(node, s[0])
            proof = digest(*[s[0] for s in steps if s])
            out.append((r["doc_id"], leaf_of(r), trees[k][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT, text STRING, leaf STRING, pos INT, tree STRING"


def documents(spark, n, langs):
    data = [(i * 3, f"s{i % 4}", langs[i % len(langs)], i, f"text ü {i}", "x", 1, "y") for i in range(n)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.mark.parametrize("n, langs, height", [(70, ["en", None, "de", "", "Z"], 2), (33, ["en"], 1), (130, ["en", "en", "en", "fr"], 9), (1, [None], 3)])
def test_manifest_as_by_hand(spark, n, langs, height):
    df = documents(spark, n, langs)
    assert rows(merkle.manifest_digests(df, height)) == plain([r.asDict() for r in df.collect()])


def test_messy_rows(spark):
    df = messy(spark)
    assert rows(merkle.manifest_digests(df, 2)) == plain([r.asDict() for r in df.collect()])
    assert merkle.manifest_digests(df.limit(0)).collect() == []


def test_only_damaged_rows_fail(spark):
    for r in merkle.manifest_digests(documents(spark, 60, ["a", "b"]), 3).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) == (r.folded_root == r.root)


@pytest.mark.parametrize("levels", range(1, 12))
def test_addresses_are_each_place_once(levels):
    places = merkle.addresses(levels)
    assert [len(p) for p in places] == [1 << d for d in range(levels)]
    assert sorted(x for p in places for x in p) == list(range((1 << levels) - 1))


def test_addresses_keep_lower_trees_together():
    """Of 16 levels the upper 8 come first, and each tree of the lower 8 is one stretch, laid out alike."""
    places = merkle.addresses(16)
    assert max(p.max() for p in places[:8]) == 254
    for number in (0, 1, 255):
        below = [places[8 + d][number << d : (number + 1) << d] - (255 + number * 255) for d in range(8)]
        assert all((a == b).all() for a, b in zip(below, merkle.addresses(8)))


def test_stored_manifest_proves_the_same(spark, tmp_path):
    manifest = merkle.build_manifest(merkle.leaf_table(documents(spark, 50, ["a", "b", "c"])), 2)
    merkle.write_manifest(manifest, str(tmp_path / "m"))
    again = merkle.read_manifest(spark, str(tmp_path / "m"))
    checked = merkle.verify(merkle.proofs(again))
    assert rows(checked) == rows(merkle.verify(merkle.proofs(manifest)))
    assert checked.where("NOT verified").count() == 0 and again.root().count() == 1


def test_blocks_of_one_group_are_bounded(spark):
    manifest = merkle.build_manifest(merkle.leaf_table(documents(spark, 200, ["a"])), 3)
    assert [b.agg({"count": "max"}).first()[0] for b in (manifest.leaves, *manifest.levels)] == [8, 8, 4]
    assert [b.count() for b in (manifest.leaves, *manifest.levels)] == [25, 4, 1]
