import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievra.operators import lexical as L
from sievra.sources import index_store

DOCS = {
    1: "apple apple pear fig", 2: "apple pear", 3: "pear fig fig plum", 4: "plum", 5: "apple apple pear fig",
    6: "kiwi", 7: "", 8: "fig plum apple", 9: "pear plum kiwi fig apple",
}
QUERIES = {10: "apple fig", 11: "kiwi", 12: "nothing", 13: "pear pear plum"}


def by_hand(min_df, max_df, max_features, sample=None, k=10, pad=False):
    docs = {d: t.split() for d, t in DOCS.items()}
    fit = sorted(docs)[:sample]
    df, ctf = Counter(), Counter()
    for d in fit:
        df.update(set(docs[d]))
        ctf.update(docs[d])
    most = max_df * len(fit) if isinstance(max_df, float) else max_df
    allowed = [t for t in df if min_df <= df[t] <= most]
    vocab = sorted(sorted(allowed, key=lambda t: (-ctf[t], t))[:max_features])
    idf = {t: math.log((1 + len(fit)) / (1 + df[t])) + 1 for t in vocab}

    def weigh(tokens):
        raw = {t: n * idf[t] for t, n in Counter(tokens).items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    weights = {d: weigh(t) for d, t in docs.items()}
    hits = []
    for q, text in QUERIES.items():
        wanted = weigh(text.split())
        scores = {d: round(sum(w.get(t, 0) * x for t, x in wanted.items()), 9) for d, w in weights.items()}
        ranked = sorted(((-s, d) for d, s in scores.items() if s > 0 or pad))[:k]
        hits += [(q, i, d, round(-s, 6) + 0.0) for i, (s, d) in enumerate(ranked, 1)]
    return vocab, idf, weights, hits


def tokens(spark):
    rows = [(d, t.split()) for d, t in DOCS.items()]
    return spark.createDataFrame(rows, "doc_id INT, tokens ARRAY<STRING>").repartition(3)


def queries(spark):
    return spark.createDataFrame([(q, t.split()) for q, t in QUERIES.items()], "query_id INT, terms ARRAY<STRING>")


def listed(hits):
    return [(r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in hits.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("limits", [(1, 1.0, 100, None), (2, 0.5, 3, None), (2, 6, 2, 5), (1, 0.9, 3, 6)])
def test_search_by_hand(spark, limits):
    min_df, max_df, max_features, sample = limits
    vocab, idf, weights, _ = by_hand(min_df, max_df, max_features, sample)
    idx = L.build_lexical_index(tokens(spark), min_df=min_df, max_df=max_df, max_features=max_features, sample_size=sample)
    got = idx.vocab.orderBy("term_id").collect()
    assert [(r.term, r.term_id) for r in got] == [(t, i) for i, t in enumerate(vocab)]
    assert all(abs(r.idf - idf[r.term]) < 1e-12 for r in got)
    postings = {(r.doc_id, r.term): r.weight for r in idx.postings.collect()}
    assert postings == pytest.approx({(d, t): w for d, ws in weights.items() for t, w in ws.items()})
    k, pad = {1: (2, False), 2: (50, True)}[min_df] if sample is None else (3, True)
    hits = by_hand(min_df, max_df, max_features, sample, k, pad)[3]
    assert listed(L.lexical_search(queries(spark), idx, k, pad)) == hits


def test_many_queries_take_the_salted_join(spark, monkeypatch):
    idx = L.build_lexical_index(tokens(spark), min_df=1, max_df=1.0, sample_size=None)
    expected = listed(L.lexical_search(queries(spark), idx))
    monkeypatch.setattr(L, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(L, "PUSHED_TERMS", 0)
    assert listed(L.lexical_search(queries(spark), idx)) == expected


def test_many_terms_are_cut_by_frequency_first(spark, monkeypatch):
    monkeypatch.setattr(L, "fits", lambda df: False)
    for n in (1, 2, 3, 5, 50):
        idx = L.build_lexical_index(tokens(spark), min_df=1, max_df=1.0, max_features=n, sample_size=None)
        assert [r.term for r in idx.vocab.orderBy("term").collect()] == by_hand(1, 1.0, n)[0]


def test_stats_count_empty_documents(spark):
    idx = L.build_lexical_index(tokens(spark), min_df=1, max_df=1.0, sample_size=None)
    row = L.lexical_stats(idx).first()
    nnz = sum(len(set(t.split())) for t in DOCS.values())
    assert (row.n_docs, row.n_terms, row.nnz) == (9, 5, nnz)
    assert row.sparsity == pytest.approx(100 - 100 * nnz / 45) and row.nnz_per_doc == pytest.approx(nnz / 9)


def test_stored_index(spark, tmp_path):
    idx = L.build_lexical_index(tokens(spark), min_df=1, max_df=1.0, sample_size=None)
    index_store.write_lexical_index(idx, str(tmp_path / "idx"), buckets=4)
    stored = index_store.read_lexical_index(spark, str(tmp_path / "idx"))
    assert listed(L.lexical_search(queries(spark), stored, pad=True)) == listed(L.lexical_search(queries(spark), idx, pad=True))
    plan = L.lexical_search(queries(spark), stored)._jdf.queryExecution().executedPlan().toString()
    # The scan is bucketed by document: the only shuffle is that of the best rows by query.
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    assert plan.count("WindowGroupLimit") == 2 and "In(term" in plan


def test_an_index_is_rebuilt_at_its_path(spark, tmp_path):
    """Other buckets, other rows: what was loaded before keeps its rows, what is loaded after has the new ones, whole."""
    path = str(tmp_path / "idx")
    many = spark.createDataFrame([(i, [f"t{i % 50}", f"t{i % 7}", "x"]) for i in range(400)], "doc_id INT, tokens ARRAY<STRING>")
    few = many.where("doc_id < 90")

    def build(docs, buckets):
        index_store.write_lexical_index(L.build_lexical_index(docs, min_df=1, max_df=1.0, sample_size=None), path, buckets)
        return index_store.read_lexical_index(spark, path)

    first = build(many, 4)
    wanted = spark.createDataFrame([(1, ["t3", "x"])], "query_id INT, terms ARRAY<STRING>")
    planned = L.lexical_search(wanted, first, k=500)
    second = build(few, 16)
    third = build(many, 7)
    for idx, docs in ((first, 400), (second, 90), (third, 400)):
        by_doc = idx.postings.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("norm"))
        assert by_doc.count() == docs == idx.docs.count()
        assert by_doc.where("abs(norm - 1) > 1e-9").count() == 0
    assert planned.count() == 400 and L.lexical_search(wanted, second, k=500).count() == 90
    assert [r.version for r in index_store.published_builds(spark, path).orderBy("version").collect()] == [1, 2, 3]
    index_store.drop_old_builds(spark, path)
    assert index_store.read_lexical_index(spark, path).postings.count() == third.postings.count()
    assert len([f for f in (tmp_path / "idx" / "builds").iterdir() if f.is_dir()]) == 1


def test_a_build_that_broke_off_is_not_read(spark, tmp_path):
    path = str(tmp_path / "idx")
    with pytest.raises(FileNotFoundError):
        index_store.read_lexical_index(spark, path)
    idx = L.build_lexical_index(tokens(spark), min_df=1, max_df=1.0, sample_size=None)
    index_store.write_lexical_index(idx, path, 3)
    idx.vocab.limit(0).write.parquet(f"{path}/builds/broken/vocab")
    assert index_store.read_lexical_index(spark, path).vocab.count() == idx.vocab.count()


def test_one_shuffle_from_tokens_to_scores(spark):
    idx = L.build_lexical_index(tokens(spark), min_df=1, max_df=1.0, sample_size=None)
    plan = idx.postings.groupBy("doc_id").agg(F.sum("weight"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan


def test_an_input_that_is_not_partitioned_is_shuffled_once(spark, tmp_path):
    """From tokens as they are scanned to weights: documents move once, exploded rows never."""
    tokens(spark).write.parquet(str(tmp_path / "tokens"))
    scanned = spark.read.parquet(str(tmp_path / "tokens"))
    idx = L.build_lexical_index(scanned, min_df=1, max_df=1.0, sample_size=None)
    plan = idx.postings.groupBy("doc_id").agg(F.sum("weight"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan


def test_vocabulary_without_a_limit(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_SHARE", 0.5)  # some terms are hot, some rare
    vocab, idf, weights, _ = by_hand(1, 1.0, None)
    idx = L.build_lexical_index(tokens(spark), min_df=1, max_df=1.0, max_features=None, sample_size=None)
    assert [(r.term, r.term_id) for r in idx.vocab.orderBy("term_id").collect()] == [(t, i) for i, t in enumerate(vocab)]
    postings = {(r.doc_id, r.term): r.weight for r in idx.postings.collect()}
    assert postings == pytest.approx({(d, t): w for d, ws in weights.items() for t, w in ws.items()})
    plan = idx.postings._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Subquery")[0]


def test_row_norms_are_those_of_the_raw_weights(spark):
    _, idf, _, _ = by_hand(1, 1.0, 100)
    tf = L.term_freq(tokens(spark))
    idx = L.build_lexical_index(tokens(spark), min_df=1, max_df=1.0, sample_size=None)
    norms = {r.doc_id: r.norm for r in L.row_norms(tf, idx.vocab).collect()}
    want = {d: math.sqrt(sum((n * idf[t]) ** 2 for t, n in Counter(text.split()).items())) for d, text in DOCS.items() if text}
    assert norms == pytest.approx(want) and min(want.values()) > 1.5


def test_tiny_scores_are_hits(spark):
    docs = spark.createDataFrame([(1, ["a"] * 30_000 + ["b"]), (2, ["c"])], "doc_id INT, tokens ARRAY<STRING>")
    idx = L.build_lexical_index(docs, min_df=1, max_df=1.0, sample_size=None)
    wide = spark.createDataFrame([(1, ["b"] + ["c"] * 1_000_000)], "query_id INT, terms ARRAY<STRING>")
    assert [r.doc_id for r in L.lexical_search(wide, idx).orderBy("rank").collect()] == [2, 1]


def test_partitions_of_words_follow_the_size_of_the_texts(spark, monkeypatch, tmp_path):
    """More text makes more partitions, and a stored index as many buckets; without text the shuffle partitions stay."""
    from sievra.registry import inputs as I
    from sievra.sources import tables as T

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = spark.range(600).selectExpr("id AS doc_id", "concat('alpha beta w', id % 7, ' ', repeat('gamma ', 20)) AS text")
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    assert T.text_partitions(texts) == least and T.text_partitions(texts.where("doc_id < 0")) == least
    monkeypatch.setattr(T, "TEXT_PER_PARTITION", 2000)
    n = T.text_partitions(texts)
    assert n > 2 * least and I.tokens(spark, str(tmp_path)).rdd.getNumPartitions() == n
    idx = I.lexical_index(spark, str(tmp_path))
    index_store.write_lexical_index(idx, str(tmp_path / "idx"))
    assert index_store.read_meta(spark, str(tmp_path / "idx"))["buckets"] == str(n)
    assert index_store.read_lexical_index(spark, str(tmp_path / "idx")).postings.count() == idx.postings.count()


def test_a_padded_search_is_done_once(spark, tmp_path):
    """Its hits are read twice, but the postings are not: the result no longer depends on them."""
    docs = spark.createDataFrame([(i, t.split()) for i, t in DOCS.items()], "doc_id INT, tokens ARRAY<STRING>")
    index_store.write_lexical_index(L.build_lexical_index(docs, min_df=1, max_df=1.0, sample_size=None), str(tmp_path / "idx"))
    hits = L.lexical_search(queries(spark), index_store.read_lexical_index(spark, str(tmp_path / "idx")), 5, pad=True)
    assert not [f for f in hits.inputFiles() if "/postings/" in f]
    assert hits.groupBy("query_id").count().where("count <> 5").count() == 0
