"""Stages of the pipeline decide about rows, whatever their ids, and leave names of columns alone."""

import pytest
from pyspark.sql import functions as F

from sievra.llm import decontamination, language_id, links, near_dedup
from tests.llm.helpers import rows, sentence

SCHEMA = "doc_id BIGINT, text STRING, row_number INT, lang_pred STRING, has_letter INT, __group INT, __id INT"


def table(spark, data):
    return spark.createDataFrame([(i, t, n, "l", 1, 2, 3) for n, (i, t) in enumerate(data)], SCHEMA).repartition(3)


def test_of_equal_rows_one_stays(spark):
    text, other = sentence(60), sentence(50, 3, 5)
    data = [(1, text), (1, text), (None, text), (2, text + " indeed"), (None, text), (None, other), (None, other), (9, None), (9, None), (None, "")]
    df = table(spark, data)
    kept = near_dedup.keep_one_of_each(df)
    assert kept.schema == df.schema
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert found == sorted([(1, text), (None, other), (9, None), (9, None), (None, "")], key=repr)
    assert near_dedup.keep_one_of_each(df.limit(0)).collect() == []


def test_of_a_shared_id_each_text_counts(spark):
    data = [(5, sentence(60)), (5, sentence(60, 4, 7)), (4, sentence(60) + " so"), (None, sentence(60, 4, 7) + " so")]
    found = [(r.doc_id, len(r.text)) for r in near_dedup.keep_one_of_each(table(spark, data)).collect()]
    assert sorted(found) == sorted([(4, len(data[2][1])), (5, len(data[1][1]))])


def test_leaks_go_without_an_id_and_alone(spark):
    item = sentence(30, 2, 5)
    items = spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")
    df = table(spark, [(None, "so " + item), (7, "so " + item + " end"), (7, sentence(40)), (None, sentence(40)), (None, None)])
    kept = decontamination.without_leaks(df, items)
    assert kept.schema == df.schema
    assert rows(kept) == rows(df.where(F.coalesce(~F.col("text").contains(item), F.lit(True))))


def test_no_stage_that_drops_rows_writes_the_texts_again(spark, monkeypatch):
    """What a stage writes to find its rows again stays small beside the table."""
    written = []
    for module in (near_dedup, decontamination, links):

        def settle(df, label, settle=module.settle):
            written.append((label, df.schema))
            return settle(df, label)

        monkeypatch.setattr(module, "settle", settle)
    item = sentence(30, 2, 5)
    df = table(spark, [(1, sentence(60)), (2, sentence(60) + " so"), (2, sentence(60)), (3, "so " + item), (None, None)])
    kept = near_dedup.keep_one_of_each(df)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]
    kept = decontamination.without_leaks(df, spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING"))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 2]
    assert written and not [label for label, schema in written if {"text", "row_number"} & set(schema.names)]


def test_equal_rows_give_one_set(spark):
    text, other = sentence(60), sentence(60, 4, 7)
    df = table(spark, [(5, text), (5, text), (5, other), (6, text), (7, text)])
    sets = links.sets_by_scan(df, "doc_id", "text", 5)(spark.createDataFrame([(5,), (6,)], "id BIGINT"))
    assert sorted(r.id for r in sets.collect()) == [5, 5, 6]


def test_of_many_equal_rows_one_stays(spark):
    """Copies with the same id, the row kept among them, are counted and one of them is taken."""
    data = [(1, sentence(60))] * 40 + [(2, sentence(60) + " so")] * 40 + [(3, "")] * 4 + [(4, sentence(60, 4, 7))]
    found = sorted((r.doc_id, len(r.text)) for r in near_dedup.keep_one_of_each(table(spark, data)).collect())
    assert found == sorted([(1, len(data[0][1]))] + [(3, 0)] * 4 + [(4, len(data[-1][1]))])


def test_columns_with_the_names_of_the_stage_stay(spark):
    df = table(spark, [(i, sentence(40, i)) for i in range(20)]).withColumn("lang", F.lit("en"))
    assert rows(language_id.keep_identified(df)) == rows(df)


@pytest.mark.parametrize("left_out", ["fr"])
def test_a_language_that_was_not_learned_goes(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(8, "doc_id")
    docs = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.when(F.col("lang") != left_out, F.col("lang")))
    kept = {r.truth: r["count"] for r in language_id.keep_identified(docs).groupBy("truth").count().collect()}
    was = {r.truth: r["count"] for r in docs.groupBy("truth").count().collect()}
    learned = [lang for lang in was if lang != left_out]
    assert kept.get(left_out, 0) <= 0.1 * was[left_out]
    assert sum(kept[lang] for lang in learned) >= 0.99 * sum(was[lang] for lang in learned)
