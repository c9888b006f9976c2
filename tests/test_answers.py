import numpy as np
import pytest
from pyspark.sql import functions as F

from sievra.functions import text as T
from sievra.operators import hits as H
from sievra.operators import labels as B
from sievra.plans import answer_runs as R
from sievra.plans import evaluation
from sievra.sources import tables


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(1, 1, 30, 0.1), (1, 2, 10, 0.2), (1, 3, 30, 0.3), (2, 1, 20, 0.4), (2, 2, 99, 0.4)]
    return spark.createDataFrame(rows, "query_id INT, rank INT, doc_id INT, score DOUBLE")


def test_hits_are_grouped_and_merged(spark, hits):
    grouped = {(r.query_id, r.doc_id): [tuple(h) for h in r.hits] for r in H.group_hits(hits).collect()}
    assert grouped[1, 30] == [(1, 0.1), (3, 0.3)] and len(grouped) == 4
    best = [tuple(r) for r in H.best_doc_hits(hits).orderBy("query_id", "rank").collect()]
    assert best == [(1, 1, 30, 0.1), (1, 2, 10, 0.2), (2, 1, 20, 0.4), (2, 2, 99, 0.4)]
    products = [tuple(r) for r in H.best_doc_hits(hits, "ip", k=1).orderBy("query_id").collect()]
    assert products == [(1, 1, 30, 0.3), (2, 1, 20, 0.4)]


def test_lookups_keep_every_hit(spark, hits):
    articles = spark.createDataFrame([(30, "t30", "text 30"), (20, None, "text 20"), (10, "t10", "text 10")], "doc_id INT, title STRING, text STRING")
    titles = {(r.query_id, r["rank"]): r.title for r in H.hydrate_hits(hits, articles).collect()}
    assert titles == {(1, 1): "t30", (1, 2): "t10", (1, 3): "t30", (2, 1): "Not found", (2, 2): "Not found"}
    assert [r.doc_id for r in H.hit_texts(hits, articles).collect()] == [10, 20, 30]
    urls = H.lookup_urls(hits, spark.createDataFrame([(30, "u30")], "doc_id INT, url STRING")).orderBy("query_id", "rank")
    assert [r.url for r in urls.collect()] == ["u30", None, "u30", None, None]


def test_unknown_positions(spark):
    id_map = spark.createDataFrame([(0, 5, "a"), (1, 1_000_001, "b")], "bucket INT, pos LONG, doc_id STRING")
    asked = spark.createDataFrame([(1, 5), (1, 6), (1, 1_000_001), (1, 9_000_000)], "query_id INT, pos LONG")
    got = {r.pos: r.doc_id for r in H.lookup_doc_ids(asked, id_map).collect()}
    assert got == {5: "a", 6: "Unknown_6", 1_000_001: "b", 9_000_000: "Unknown_9000000"}


def test_lookups_without_broadcast(spark, hits, monkeypatch):
    monkeypatch.setattr(H, "broadcast_if_fits", lambda df: df)
    monkeypatch.setattr(H, "fits", lambda df: False)
    test_lookups_keep_every_hit(spark, hits)
    test_unknown_positions(spark)


URL = "https://en.wikipedia.org/wiki/"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([("A", "text\nA"), ("B", "text B"), ("C", None)], "title STRING, extract STRING")


def test_questions(spark, tmp_path):
    rows = [("what is a", "u1", 3), ("What is b", "u2", 1), ("whatever", "u3", 2), ("who", "u4", 0), ("what c", "u5", 9)]
    df = spark.createDataFrame(rows, "question STRING, url STRING, position INT")
    got = [tuple(r) for r in R.select_questions(df, n=2).orderBy("question_id").collect()]
    assert got == [(0, "whatever", "u3"), (1, "what is a", "u1")]
    first = R.cached_questions(spark, str(tmp_path / "q"), df, n=2)
    again = R.cached_questions(spark, str(tmp_path / "q"), df.limit(0), n=1)
    assert first.count() == again.count() == 2


@pytest.mark.parametrize("n", [10, 1_000, 25_000])
def test_questions_in_file_order(spark, tmp_path, n):
    """The default order: files by name, lines as they stand, over more lines than a sample holds."""
    path = str(tmp_path / "lines")
    lines = spark.range(0, 120_000, 1, 6).select(
        F.concat(F.when(F.col("id") % 4 == 0, F.lit("who")).otherwise(F.lit("what")), F.lit(" "), F.col("id")).alias("question_text"),
        F.when(F.col("id") % 9 != 0, F.concat(F.lit("u"), F.col("id"))).alias("document_url"),
    )
    lines.write.json(path)
    got = R.select_questions(tables.read_questions(spark, path), n=n).orderBy("question_id").collect()
    want = [i for i in range(120_000) if i % 4][:n]
    assert [(r.question_id, r.question, r.url) for r in got] == [(k, f"what {i}", f"u{i}" if i % 9 else None) for k, i in enumerate(want)]


def test_evidence_in_rank_order(spark, pages):
    hits = spark.createDataFrame([(1, 2, 10), (1, 1, 20), (1, 3, 99), (2, 1, 30)], "query_id INT, rank INT, doc_id INT")
    id_url = spark.createDataFrame([(10, URL + "A"), (20, URL + "B"), (30, URL + "C")], "doc_id INT, url STRING")
    got = {r.query_id: r.evidence for r in R.assemble_evidence(hits, id_url, pages).collect()}
    assert got == {1: "text B" + "text A" + T.NO_EVIDENCE_TEXT, 2: T.NO_EVIDENCE_TEXT}


def test_runs_keep_every_question(spark, pages):
    questions = spark.createDataFrame(
        [(0, "q0", URL + "A"), (1, "q1", URL + "C"), (2, "q2", None), (3, "", URL + "B")],
        "question_id LONG, question STRING, url STRING",
    )
    evidence = spark.createDataFrame([(0, "ev"), (1, "")], "query_id LONG, evidence STRING")
    answers = spark.createDataFrame([(0, "a0"), (1, "a1"), (3, "a3")], "question_id LONG, answer STRING")
    rows = R.build_run(questions, answers, pages, "m", "with_rag", evidence).orderBy("question_id").collect()
    assert [(r.answer, r.text) for r in rows] == [
        ("a0", "text\nA"), ("a1", T.NO_EVIDENCE_TEXT), (T.FAILED_ANSWER, T.FAILED_TEXT), (T.FAILED_ANSWER, T.FAILED_TEXT)
    ]
    assert "with evidence from" in rows[0].prompt and "with evidence" not in rows[1].prompt and rows[3].prompt is None
    plain = R.build_run(questions, answers, pages, "m", "without_rag").orderBy("question_id").first()
    assert plain.mode == "without_rag" and "with evidence" not in plain.prompt
    with pytest.raises(ValueError):
        R.build_run(questions, answers, pages, "m", "other")
    with pytest.raises(ValueError):
        R.build_run(questions, answers, pages, "m", "with_rag")
    filled = R.with_placeholders(questions, answers.withColumn("text", F.lit("t"))).orderBy("question_id").collect()
    assert [(r.answer, r.text) for r in filled][2] == (T.FAILED_ANSWER, T.FAILED_TEXT) and len(filled) == 4


def test_labels(spark):
    scores = [[0.1, 2.0, 2.0], [5.0, 1.0, 1.0], [0.0, 0.0, 0.5], [1000.0, -1000.0, 999.0], [1.0, 1.0, 1.0]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i INT, scores ARRAY<DOUBLE>")
    got = [r.label for r in B.label_pairs(df).orderBy("i").collect()]
    assert got == ["neutral", "supports", "contradiction", "supports", "supports"]
    p = df.select(B.softmax(F.col("scores")).alias("p")).first().p
    e = np.exp(np.array(scores[0]) - 2)
    assert np.allclose(p, e / e.sum())


def test_metrics_and_zero_denominators(spark):
    rows = [("a", "supports")] * 3 + [("a", "neutral")] + [("a", "contradiction")] * 4
    rows += [("bad", "contradiction")] * 2 + [("good", "supports")] * 2 + [("none", None)]
    got = {r.run: r for r in B.evaluate_runs(spark.createDataFrame(rows, "run STRING, label STRING")).collect()}
    a = got["a"]
    assert (a.n, a.acc, a.precision, a.recall) == (8, 3 / 8, 3 / 4, 3 / 8) and a.f1 == pytest.approx(0.5)
    assert (got["bad"].acc, got["bad"].precision, got["bad"].f1) == (0.0, None, None)
    assert (got["good"].precision, got["good"].f1) == (1.0, 1.0)
    assert (got["none"].n, got["none"].supports, got["none"].acc) == (1, 0, 0.0)


def test_evaluation_end_to_end(spark):
    runs = spark.createDataFrame(
        [
            ("m", "without_rag", "yes", "yes"), ("m", "without_rag", "no", "yes"), ("m", "without_rag", None, "yes"),
            ("m", "with_rag", "“yes”", "\"yes\""), ("m", "with_rag", "ﬁ", "fi"), ("m", "with_rag", "no", "yes"),
        ],
        "model STRING, mode STRING, answer STRING, text STRING",
    )

    def equal(answers, texts):
        return np.array([[1.0, 0.5, 0.0] if a == t else [0.0, 0.5, 1.0] for a, t in zip(answers, texts)])

    got = {r.mode: r for r in evaluation.evaluate(runs, equal).collect()}
    assert (got["without_rag"].n, got["without_rag"].supports, got["without_rag"].contradiction) == (3, 1, 1)
    assert (got["with_rag"].supports, got["with_rag"].contradiction) == (2, 1)
    side = evaluation.evaluate_and_compare(runs, equal).first()
    assert side.acc_gain == pytest.approx(1 / 3) and side.precision_with_rag == 1.0
    strict = {r.mode: r for r in evaluation.evaluate(runs, equal, nan_text=True).collect()}
    assert strict["without_rag"].contradiction == 2


def test_pairs_by_question(spark):
    a = spark.createDataFrame([(1, "a1", "t1"), (2, "a2", "t2")], "question_id INT, answer STRING, text STRING")
    b = spark.createDataFrame([(2, "b2", "s2"), (1, "b1", "s1")], "question_id INT, answer STRING, text STRING")
    rows = B.pair_runs(a, b).orderBy("question_id").collect()
    assert [(r.answer_without_rag, r.answer_with_rag) for r in rows] == [("a1", "b1"), ("a2", "b2")]
