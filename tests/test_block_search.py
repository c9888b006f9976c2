import random

import pytest
from pyspark.sql import functions as F

from sievra.operators import block_search as B, lexical as L
from sievra.session import settle
from sievra.sources import index_store


@pytest.fixture(scope="module")
def idx(spark):
    """Documents of rare and frequent terms, copies and an empty one among them; ``w0`` is in most."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, [words[int(300 * rng.random() ** 4)] for _ in range(rng.randrange(1, 40))]) for i in range(1500)]
    rows += [(1500 + i, rows[7][1]) for i in range(30)] + [(1600, [])]
    docs = spark.createDataFrame(rows, "doc_id INT, tokens ARRAY<STRING>").repartition(5)
    made = L.build_lexical_index(docs, min_df=1, max_df=1.0, sample_size=None)
    return L.LexicalIndex(made.vocab, settle(made.postings, "postings"), made.docs)


@pytest.fixture(scope="module")
def queries(spark, idx):
    rng = random.Random(4)
    rows = [(i, [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 6))]) for i in range(40)]
    rows += [(100, ["w0"]), (101, ["unknown"]), (102, []), (103, ["w0", "w299", "w299"])]
    return spark.createDataFrame(rows, "query_id INT, terms ARRAY<STRING>")


def listed(hits):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 8)) for r in hits.collect())


@pytest.mark.parametrize("k, size, pad", [(10, 16, False), (1, 8, False), (3, 5000, True), (200, 1, False)])
def test_hits_are_those_of_all_postings(idx, queries, tmp_path, k, size, pad):
    spark = queries.sparkSession
    index_store.write_block_index(B.build_block_index(idx, shards=7, docs_per_block=size), str(tmp_path / "b"))
    stored = index_store.read_block_index(spark, str(tmp_path / "b"))
    assert listed(B.block_search(queries, stored, k, pad)) == listed(L.lexical_search(queries, idx, k, pad))


def test_joins_beyond_a_broadcast_give_the_same(idx, queries, monkeypatch):
    blocks = B.build_block_index(idx, shards=7, docs_per_block=8)
    expected = listed(L.lexical_search(queries, idx))
    for limit in ("MAX_BROADCAST_ROWS", "PUSHED_TERMS"):
        monkeypatch.setattr(L, limit, 0)
        monkeypatch.setattr(B, limit, 0)
    monkeypatch.setattr(L, "ROWS_PER_SALT", 50)
    assert listed(L.lexical_search(queries, idx)) == expected
    assert listed(B.block_search(queries, blocks)) == expected


def test_heavy_terms_are_dealt_and_light_ones_not_copied(spark, monkeypatch):
    """One term holds a third of all rows: no salt of a term holds much more than the others, and light terms have one."""
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 500).cast("string"))).alias("term"),
        F.col("id").alias("doc_id"), F.lit(1.0).alias("weight"),
    )
    weights = settle(rows.select("term").distinct().withColumn("query_id", F.lit(1)).withColumn("query_weight", F.lit(1.0)), "w")
    for name, value in (("MAX_BROADCAST_ROWS", 0), ("PUSHED_TERMS", 0), ("ROWS_PER_SALT", 100)):
        monkeypatch.setattr(L, name, value)
    kept = {}
    settled = lambda df, label: kept.setdefault(label, settle(df, label))
    monkeypatch.setattr(L, "settle", settled)
    joined = L.match_terms(weights, rows)
    assert joined.count() == 9000 and joined.select("doc_id").distinct().count() == 9000
    assert [tuple(r) for r in kept["heavy-terms"].collect()] == [("hot", 30)]
    parts = rows.where("term = 'hot'").groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(30))).count().agg(F.max("count")).first()[0]
    assert parts <= 150


def test_a_batch_reads_only_its_shards_and_few_blocks(spark, idx, tmp_path):
    index_store.write_block_index(B.build_block_index(idx, shards=50, docs_per_block=4), str(tmp_path / "b"))
    stored = index_store.read_block_index(spark, str(tmp_path / "b"))
    rows = [(i, [f"w{200 + i % 20}", f"w{230 + i % 15}"]) for i in range(200)]
    queries = spark.createDataFrame(rows, "query_id INT, terms ARRAY<STRING>")
    weights = settle(L.query_weights(queries, stored.vocab), "weights")
    plan = B.block_bounds(weights, stored)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "PartitionFilters" in line and "most" in line][0]
    assert "shard" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "entries" not in scan.split("ReadSchema")[1]
    asked, total = B._asked(weights, stored), stored.blocks
    files = lambda df: df.select("_metadata.file_path").distinct().count()
    assert files(asked) < 0.7 * files(total)
    assert asked.select(F.sum(F.size("entries"))).first()[0] < 0.7 * total.select(F.sum(F.size("entries"))).first()[0]


def test_blocks_below_the_limit_are_not_scored(idx, queries):
    blocks = B.build_block_index(idx, shards=7, docs_per_block=8)
    weights = settle(L.query_weights(queries, blocks.vocab), "weights")
    bounds, first, hits = B.search_rounds(weights, blocks, 10)
    scored = first.count() + B.blocks_left(bounds, first, hits, 10).count()
    assert scored < 0.6 * bounds.count()
    scores = L.match_terms(weights, idx.postings).groupBy("query_id", "doc_id").agg(F.sum(F.col("query_weight") * F.col("weight")).alias("s"))
    n = -(-idx.docs.count() // 8)
    placed = scores.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    assert placed.join(bounds, ["query_id", "block"]).where("s > bound + 1e-12").count() == 0


def test_an_index_without_documents(spark, idx, queries, tmp_path):
    empty = L.LexicalIndex(idx.vocab, idx.postings.limit(0), idx.docs.limit(0))
    index_store.write_block_index(B.build_block_index(empty), str(tmp_path / "b"))
    assert B.block_search(queries, index_store.read_block_index(spark, str(tmp_path / "b"))).count() == 0


def test_dealt_documents_gather_their_postings_without_a_shuffle(spark, tmp_path):
    """Ids that come twice or are null included: the blocks of an index that was not dealt, stored alike."""
    rng = random.Random(5)
    rows = [(i % 290 if i % 50 else None, [f"w{int(60 * rng.random() ** 3)}" for _ in range(rng.randrange(12))]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id INT, tokens ARRAY<STRING>").repartition(5)
    limits = dict(min_df=1, max_df=1.0, sample_size=None)
    dealt, n = B.deal_blocks(docs, 6, 16)
    made = B.build_block_index(L.build_lexical_index(dealt, colocated=True, partitions=6, blocks=n, **limits), shards=3)
    plain = B.build_block_index(L.build_lexical_index(docs, **limits), shards=3, docs_per_block=16)
    plan = made.blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange shufflepartitionidpassthrough") == 1 and "Exchange hashpartitioning" not in plan
    entry = lambda e: (e.doc_id is None, e.doc_id or 0, round(e.weight, 9))
    key = lambda r: (r.shard, r.term, r.block, round(r.most, 9), sorted(map(entry, r.entries)))
    index_store.write_block_index(made, str(tmp_path / "b"))
    stored = index_store.read_block_index(spark, str(tmp_path / "b")).blocks
    want = sorted(map(key, plain.blocks.collect()))
    assert n == 19 and sorted(map(key, made.blocks.collect())) == want and sorted(map(key, stored.collect())) == want


def test_entries_are_moved_as_two_lists(spark, idx, tmp_path, monkeypatch):
    moved, hint = [], type(idx.postings).hint
    monkeypatch.setattr(type(idx.postings), "hint", lambda df, *a: (moved.append(dict(df.dtypes)), hint(df, *a))[1])
    index_store.write_block_index(B.build_block_index(idx, shards=3), str(tmp_path / "b"))
    assert [(m["doc_id"], m["weight"]) for m in moved] == [("array<int>", "array<double>")]
