import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievra.plans import search
from sievra.operators import lexical as L
from sievra.sources import arrow_stream, tables


def write_stream(path, batches):
    with pa.OSFile(str(path), "wb") as sink, pa.ipc.new_stream(sink, batches[0].schema) as stream:
        for batch in batches:
            stream.write_batch(batch)


def batch(start, n):
    return pa.record_batch({"id": [str(i) for i in range(start, start + n)], "text": ["t" * 50] * n})


def test_arrow_streams(spark, tmp_path):
    write_stream(tmp_path / "a.arrow", [batch(0, 5), batch(5, 5)])
    write_stream(tmp_path / "b.arrow", [batch(10 + 10 * i, 10) for i in range(20)])
    (tmp_path / "note.txt").write_text("not an arrow file")
    arrow_stream.register(spark)
    plain = spark.read.format("arrow_stream").load(str(tmp_path))
    assert plain.columns == ["id", "text"] and plain.rdd.getNumPartitions() == 2
    # A long file is cut, and every batch is read by exactly one partition.
    cut = spark.read.format("arrow_stream").option("splitBytes", 2000).load(str(tmp_path))
    assert cut.rdd.getNumPartitions() > 4
    for df in (plain, cut):
        assert sorted(int(r.id) for r in df.collect()) == list(range(210))


def test_unreadable_arrow_file(spark, tmp_path):
    write_stream(tmp_path / "a.arrow", [batch(0, 5)])
    (tmp_path / "b.arrow").write_bytes(b"garbage, not a stream")
    arrow_stream.register(spark)
    with pytest.raises(Exception):
        spark.read.format("arrow_stream").load(str(tmp_path)).collect()
    skipped = spark.read.format("arrow_stream").option("ignoreCorruptFiles", "true").load(str(tmp_path))
    assert skipped.count() == 5


def test_questions_in_file_order(spark, tmp_path):
    lines = [json.dumps({"question_text": f"what {i}", "document_url": f"u{i}", "extra": [1]}) for i in range(2000)]
    (tmp_path / "q.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = tables.read_questions(spark, str(tmp_path / "q.jsonl"))
        assert df.rdd.getNumPartitions() > 2
        got = [r.question for r in df.orderBy("position").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"what {i}" for i in range(2000)]


def test_answers_with_quotes_and_line_breaks(spark, tmp_path):
    rows = [("he said \"no\",\nthen left", "a,b"), (None, "x"), ("plain \\ slash", "“y”")]
    import pandas as pd

    pd.DataFrame(rows, columns=["answer", "text"]).to_csv(tmp_path / "m.csv", index=False)
    got = tables.read_answers(spark, str(tmp_path / "m.csv")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
    runs = spark.createDataFrame([(i, a, t, "m", mode) for i, (a, t) in enumerate(rows) for mode in ("with_rag", "without_rag")],
                                 "question_id LONG, answer STRING, text STRING, model STRING, mode STRING")
    tables.write_answers(runs, str(tmp_path / "runs"))
    back = tables.read_runs(spark, str(tmp_path / "runs"))
    assert sorted(map(str, back.collect())) == sorted(map(str, runs.collect()))


def test_scans_of_few_partitions_are_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert "RepartitionByExpression" in tables.spread(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    many = spark.range(0, 1000, 1, 64)
    assert tables.spread(many, "id") is many


def test_a_table_left_by_an_aborted_build_is_built_again(spark, tmp_path):
    path = str(tmp_path / "t")
    (tmp_path / "t" / "_temporary").mkdir(parents=True)
    assert tables.cached_table(spark, path, lambda: spark.range(5)).count() == 5
    assert tables.cached_table(spark, path, lambda: 1 / 0).count() == 5
    (tmp_path / "t" / "_SUCCESS").unlink()  # data without the mark of a finished write
    assert tables.cached_table(spark, path, lambda: spark.range(3)).count() == 3


def test_search_with_titles(spark):
    docs = spark.createDataFrame([(1, ["apple", "fig"]), (2, ["fig"])], "doc_id INT, tokens ARRAY<STRING>")
    idx = L.build_lexical_index(docs, min_df=1, max_df=1.0, sample_size=None)
    articles = spark.createDataFrame([(2, "Fig")], "doc_id INT, title STRING")
    queries = spark.createDataFrame([(1, "Fig?")], "query_id INT, text STRING")
    rows = search.search_with_titles(queries, idx, articles).orderBy("rank").collect()
    assert [(r.doc_id, r.title, r.score) for r in rows] == [(2, "Fig", 1.0), (1, "Not found", 0.5797)]


def test_arrow_writer_leaves_no_rows_of_failed_tasks(spark, tmp_path):
    """Through a URI; appended, replaced, without rows, and after a job that failed when some tasks had ended."""
    arrow_stream.register(spark)
    folder = f"file://{tmp_path}/out"
    df = spark.range(1000).select("id", F.concat(F.lit("ä"), F.col("id").cast("string")).alias("t")).repartition(5)
    save = lambda rows, mode: rows.write.format("arrow_stream").mode(mode).save(folder)
    back = lambda: spark.read.format("arrow_stream").load(folder)
    save(df, "append")
    assert sorted(map(tuple, back().collect())) == sorted(map(tuple, df.collect()))
    bad = df.withColumn("t", F.when(F.col("id") == 999, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        save(bad, "append")
    assert back().count() == 1000 and not [f for f in (tmp_path / "out").iterdir() if f.is_dir()]
    save(df.where("id < 10"), "append")
    assert back().count() == 1010
    save(df.where("id < 7"), "overwrite")
    assert back().count() == 7
    save(df.where("id < 0"), "overwrite")
    assert back().count() == 0 and back().columns == ["id", "t"]


def test_answers_of_one_line_each_are_read_in_splits(spark, tmp_path):
    texts = ["a\nb", "100%", "%0A", "%250A\r\n", 'say "x",\ny', "\\n", "plain", None, "%%25\n%"] * 40
    rows = [(i, t, f"e{i}\n", "m", "with_rag") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "question_id BIGINT, answer STRING, text STRING, model STRING, mode STRING").coalesce(1)
    tables.write_answers(df, str(tmp_path / "runs"), one_line=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        back = tables.read_runs(spark, str(tmp_path / "runs"), one_line=True)
        assert back.select(F.spark_partition_id()).distinct().count() > 2
        assert sorted((tuple(r) for r in back.collect()), key=lambda r: r[0]) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
