import hashlib

from pyspark.sql import functions as F

from sievra.operators import sampling as P


def ids(df):
    return [r.i for r in df.select("i").orderBy("i").collect()]


def test_first_and_prefix(spark):
    df = spark.createDataFrame([(3, "what a"), (1, "What b"), (2, "whatever"), (4, None)], "i INT, q STRING").repartition(3)
    assert ids(P.filter_prefix(df, "q", "what")) == [2, 3]
    assert [r.i for r in P.first_n(df, 2, "i").collect()] == [1, 2]


def test_head_sample_with_and_without_rough_cut(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") * 7 % 5003).alias("i"), F.lit("text").alias("t")).repartition(9)
    expected = sorted(x * 7 % 5003 for x in range(5000))
    assert ids(P.head_sample(df, 300, "i")) == expected[:300]
    assert ids(P.head_sample(df, None, "i")) == expected
    assert ids(P.head_sample(df, 9000, "i")) == expected
    monkeypatch.setattr(P, "SAMPLED_KEYS", 400)
    for sort_limit in (1_000_000, 10):
        monkeypatch.setattr(P, "SORT_LIMIT", sort_limit)
        for n in (0, 1, 11, 300, 4900, 9000):
            assert ids(P.head_sample(df, n, "i")) == expected[:n]
            assert [r.i for r in P.first_n(df, n, "i").collect()] == expected[:n]
    words = df.select(F.concat(F.lit("k"), F.lpad(F.col("i").cast("string"), 5, "0")).alias("k"), "i")
    assert ids(P.head_sample(words, 300, "k")) == expected[:300]


def test_first_rows_do_not_pile_up_with_partitions(spark):
    df = spark.range(0, 200_000, 1, 400).select(((F.col("id") * 7919) % 200_003).alias("i"))
    expected = sorted(x * 7919 % 200_003 for x in range(200_000))
    for n in (10, 1_000, 25_000):
        near = P._roughly_first(df, n, [F.col("i")])
        assert n <= near.count() <= 2 * n + 2000
        assert ids(P.head_sample(df, n, "i")) == expected[:n]


def test_first_rows_by_struct_keys_with_nulls_and_equal_keys(spark, monkeypatch):
    """Keys that are structs, with nulls in them, and a key that a third of the rows share."""
    df = spark.range(0, 60_000, 1, 30).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 != 1, F.concat(F.lit("f"), F.col("id") % 700)).alias("file"),
        ((F.col("id") * 7919) % 60_013).alias("i"),
    ).select(F.struct("file", F.struct("i")).alias("position"), "i")
    rows = sorted(df.collect(), key=lambda r: (r.position.file is not None, r.position.file or "", r.i))
    monkeypatch.setattr(P, "SAMPLED_KEYS", 2_000)
    for n in (0, 1, 10, 1_000, 25_000, 59_999):
        first = [r.i for r in P.first_n(df, n, "position").collect()]
        assert first == [r.i for r in rows[:n]]
        near = P._roughly_first(df, n, [F.col("position")]) if n else df
        assert not n or n <= near.count() <= n + P.BEYOND
    same = df.select(F.col("position.file").alias("file"))
    assert P._roughly_first(same, 21_000, [F.col("file")]).count() >= 21_000


def test_random_sample_is_exact_and_repeatable(spark):
    df = spark.range(3000).select(F.col("id").alias("i"), (F.col("id") % 2).alias("part")).repartition(7)
    digest = lambda i, part, seed: hashlib.md5(f"{i}|{part}|{seed}".encode()).hexdigest()
    for n, seed in ((1, 0), (500, 0), (500, 1), (3000, 0), (5000, 0)):
        expected = sorted(range(3000), key=lambda i: (digest(i, i % 2, seed), i))[:n]
        assert ids(P.random_sample(df, n, seed, "i", "part")) == sorted(expected)


def test_positions_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "MAPPING_BUCKET", 100)
    # One document holds a third of all rows.
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), F.col("id"))).alias("doc_id"),
        F.col("id").alias("chunk_no"),
        F.lit("x").alias("rest"),
    )
    for partitions in (1, 5, 40):
        rows = P.assign_positions(df, "doc_id", "chunk_no", partitions=partitions).orderBy("pos").collect()
        assert [r.pos for r in rows] == list(range(900))
        keys = [(r.doc_id, r.chunk_no) for r in rows]
        assert keys == sorted(keys) and [r.bucket for r in rows] == [i // 100 for i in range(900)]


def test_offsets(spark):
    counts = spark.createDataFrame([("b", 5), ("a", 2), ("c", 0)], "file STRING, n LONG")
    rows = P.file_offsets(counts).orderBy("file").collect()
    assert [(r.file, r.start, r.end) for r in rows] == [("a", 0, 2), ("b", 2, 7), ("c", 7, 7)]


def test_counts_per_file(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "t"))
    rows = P.doc_counts(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert len(rows) == 2 and sum(r.n for r in rows) == 10
