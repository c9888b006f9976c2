"""Queries and checks: questions, evidence, runs, labels, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievra.operators import hits as H
from sievra.operators import labels as B
from sievra.operators import vectors as V
from sievra.plans import answer_runs as R
from sievra.plans import evaluation, search
from sievra.registry import fragments as S
from sievra.registry import inputs as I
from sievra.registry.text_ops import _PROMPT
from sievra.session import scratch_path, settle
from sievra.sources import index_store, tables

PREFIX = "Th"


def _questions(spark, sf):
    picked = R.select_questions(I.all_questions(spark, sf), PREFIX, order=("conv_id", "turn"), keep=("conv_id", "turn"))
    return settle(picked, "questions")


def _questions_in_file_order(spark, sf):
    """Questions as a run takes them: the first lines of JSON files that start with the prefix, in the order of the files."""
    path = scratch_path(spark, "question-lines")
    lines = I.all_questions(spark, sf).repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    lines.select(F.col("question").alias("question_text"), F.col("url").alias("document_url")).write.json(path)
    return R.select_questions(tables.read_questions(spark, path), PREFIX)


def _retrieved(spark, sf, questions):
    return search.retrieve_docs(questions, I.chunk_vectors(spark, sf), dim=I.DIM)


def _evidence(spark, sf, questions):
    hits = _retrieved(spark, sf, questions)
    return R.assemble_evidence(hits, I.id_url(spark, sf), I.page_texts(spark, sf))


def _run(spark, sf, mode):
    questions = _questions(spark, sf)
    evidence = _evidence(spark, sf, questions) if mode == "with_rag" else None
    answers = I.answers(spark, sf, questions)
    return R.build_run(questions, answers, I.page_texts(spark, sf), "m", mode, evidence)


def _run_from(spark, sf, vecs, dim, **options):
    """A run whose evidence comes from a vector index that is trained on ``vecs``, stored and read again."""
    questions = _questions(spark, sf)
    hits = search.retrieve_docs(questions, stored_index(spark, vecs, **options), dim=dim)
    evidence = R.assemble_evidence(hits, I.id_url(spark, sf), I.page_texts(spark, sf))
    return R.build_run(questions, I.answers(spark, sf, questions), I.page_texts(spark, sf), "m", "with_rag", evidence)


def stored_index(spark, vecs, **options):
    path = scratch_path(spark, "run-index")
    index_store.write_vector_index(V.build_vector_index(settle(vecs, "chunk-vectors"), seed=7, **options), path)
    return index_store.read_vector_index(spark, path)


def _run_flat(spark, sf):
    """All lists of vectors as they are: the evidence of exact search."""
    return _run_from(spark, sf, I.chunk_vectors(spark, sf), I.DIM, subvectors=None, nprobe=V.MAX_LISTS)


def _run_trained(spark, sf):
    """Chunks of 384 numbers, rotated, in lists with codes and the vectors beside them, 512 lists searched."""
    return _run_from(spark, sf, V.embed_chunks(I.documents(spark, sf)), V.DIM, keep_vectors=True)


def _placeholders(spark, sf):
    questions = _questions(spark, sf)
    answered = I.answers(spark, sf, questions).withColumn("text", F.lit("found"))
    return R.with_placeholders(questions, answered)


def _page_text(spark, sf):
    questions = I.all_questions(spark, sf)
    return H.attach_page_text(questions, I.page_texts(spark, sf)).select("conv_id", "turn", "url", "text")


def _scored(spark, sf):
    pairs = I.table(spark, sf, "labels")
    scores = F.array(*[c.cast("double") for c in (F.col("quality"), 1 - F.col("toxic"), F.col("toxic"))])
    return B.label_pairs(pairs.withColumn("scores", scores)).select("doc_id", "label")


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


def _metrics(spark, sf):
    return _rounded(B.evaluate_runs(I.doc_labels(spark, sf), "model", "mode"), *B.METRICS)


def _compared(spark, sf):
    side = B.compare_runs(B.evaluate_runs(I.doc_labels(spark, sf), "model", "mode"))
    return _rounded(side, *[c for c in side.columns if c != "model"])


def _paired(spark, sf):
    turns = I.dialogue_runs(spark, sf).withColumn("question_id", F.col("conv_id") * 100 + F.floor(F.col("turn") / 4))
    by_mode = {m: turns.where(F.col("mode") == m) for m in B.MODES}
    return B.pair_runs(by_mode["without_rag"], by_mode["with_rag"])


def _evaluated(spark, sf):
    return _rounded(evaluation.evaluate(I.dialogue_runs(spark, sf), expression=I.overlap_scores), *B.METRICS)


def _evaluated_side(spark, sf):
    side = evaluation.evaluate_and_compare(I.dialogue_runs(spark, sf), expression=I.overlap_scores)
    return _rounded(side, *[c for c in side.columns if c != "model"])


_QUESTIONS = f"""
allq AS (SELECT text AS question, 'https://en.wikipedia.org/wiki/P' || (conv_id * 3) AS url, conv_id * 3 AS page, conv_id, turn FROM conversations WHERE role = 'user'),
firstq AS (SELECT * FROM allq WHERE starts_with(question, '{PREFIX}') ORDER BY conv_id, turn LIMIT 1000),
questions AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS question_id, * FROM firstq)"""

_HITS = f"""{_QUESTIONS},{S.dense_hits('questions', 'question_id', 'question')},
best AS (SELECT query_id, doc_id, min(score) AS score FROM hits GROUP BY query_id, doc_id),
dochits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank, doc_id, score FROM best)"""

_DEFAULT = "'I didn''t find evidence for this question'"
_CONTROL = "translate({c}, chr(10)||chr(13)||chr(9)||chr(12)||chr(11)||chr(8)||chr(7), '       ')"
_EVIDENCE = f"""{_HITS},
evidence AS (SELECT query_id AS question_id, {_CONTROL.format(c=f"string_agg(coalesce(p.html, {_DEFAULT}), '' ORDER BY rank)")} AS evidence
  FROM dochits LEFT JOIN pages AS p ON p.page_id = doc_id GROUP BY query_id)"""
_ANSWERS = """
answers AS (SELECT question_id, r.text AS answer FROM questions AS q JOIN conversations AS r ON r.role = 'assistant' AND r.conv_id = q.conv_id AND r.turn = q.turn + 1)"""


def _run_sql(mode: str) -> str:
    evidence = "evidence" if mode == "with_rag" else "(SELECT NULL::BIGINT AS question_id, NULL::VARCHAR AS evidence)"
    ctes = _EVIDENCE if mode == "with_rag" else _QUESTIONS
    return f"""WITH {ctes},{_ANSWERS},
    j AS (SELECT q.question_id, q.question, e.evidence, a.answer, coalesce(p.html, {_DEFAULT}) AS text FROM questions AS q
      LEFT JOIN {evidence} AS e USING (question_id) LEFT JOIN answers AS a USING (question_id) LEFT JOIN pages AS p ON p.page_id = q.page)
    SELECT question_id, 'm' AS model, '{mode}' AS mode, question, {_PROMPT} AS prompt,
      coalesce(answer, 'Error occurred during processing') AS answer, CASE WHEN answer IS NULL THEN 'No content' ELSE text END AS text FROM j"""


_LABELS = """
labelled AS (SELECT doc_id, 'm' AS model, CASE WHEN doc_id % 2 = 0 THEN 'without_rag' ELSE 'with_rag' END AS mode,
  CASE WHEN quality = 1 THEN 'supports' WHEN toxic = 0 THEN 'neutral' ELSE 'contradiction' END AS label FROM labels)"""


def _counts(source: str) -> str:
    names = ", ".join(f"count(*) FILTER (label = '{name}') AS {name}" for name in B.LABELS)
    return f"""
counts AS (SELECT model, mode, count(*) AS n, {names} FROM {source} GROUP BY model, mode),
basic AS (SELECT *, supports / n AS acc, supports / nullif(supports + neutral, 0) AS precision, supports / n AS recall FROM counts),
metrics AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM basic)"""


_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in B.METRICS)
_SIDE = ", ".join(
    f"""round(max({m}) FILTER (mode = 'without_rag'), 6) AS {m}_without_rag, round(max({m}) FILTER (mode = 'with_rag'), 6) AS {m}_with_rag,
    round(max({m}) FILTER (mode = 'with_rag') - max({m}) FILTER (mode = 'without_rag'), 6) AS {m}_gain"""
    for m in B.METRICS
)
_DIALOGUES = """
runs AS (SELECT c.conv_id, c.turn, 'm' AS model, CASE WHEN (c.turn // 2) % 2 = 0 THEN 'without_rag' ELSE 'with_rag' END AS mode, c.text AS answer, d.text AS text
  FROM conversations AS c LEFT JOIN documents AS d ON d.doc_id = c.conv_id WHERE c.role = 'assistant')"""
_JUDGED = f"""{_DIALOGUES},
sets AS (SELECT *, list_distinct(string_split(lower({S.spaces('answer')}), ' ')) AS said, list_distinct(string_split(lower({S.spaces('text')}), ' ')) AS known FROM runs),
shared AS (SELECT *, 3 * len(list_intersect(said, known)) AS s, len(said) AS m, len(said) - len(list_intersect(said, known)) AS c FROM sets),
judged AS (SELECT model, mode, CASE WHEN answer IS NULL OR text IS NULL THEN NULL WHEN s >= m AND s >= c THEN 'supports' WHEN m >= c THEN 'neutral' ELSE 'contradiction' END AS label FROM shared)"""

REGISTRY = {
    "e01_select_questions": (
        lambda spark, sf: _questions(spark, sf).select("question_id", "question", "url"),
        f"WITH {_QUESTIONS} SELECT question_id, question, url FROM questions",
    ),
    "e01_questions_in_file_order": (
        _questions_in_file_order,
        f"WITH {_QUESTIONS} SELECT question_id, question, url FROM questions",
    ),
    "e02_retrieve_docs": (
        lambda spark, sf: _retrieved(spark, sf, _questions(spark, sf)),
        f"WITH {_HITS} SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM dochits",
    ),
    "e03_assemble_evidence": (
        lambda spark, sf: _evidence(spark, sf, _questions(spark, sf)),
        f"WITH {_EVIDENCE} SELECT question_id AS query_id, evidence FROM evidence",
    ),
    "e04_with_placeholders": (
        _placeholders,
        f"""WITH {_QUESTIONS},{_ANSWERS} SELECT question_id, coalesce(answer, 'Error occurred during processing') AS answer,
        CASE WHEN answer IS NULL THEN 'No content' ELSE 'found' END AS text FROM questions LEFT JOIN answers USING (question_id)""",
    ),
    "e05_build_run": (lambda spark, sf: _run(spark, sf, "with_rag"), _run_sql("with_rag")),
    "e05_build_run_stored_index": (_run_flat, _run_sql("with_rag")),
    # Approximate, so no SQL; tests hold its hits against exact search.
    "e05_build_run_trained_index": (_run_trained, None),
    "e05_build_run_without_evidence": (lambda spark, sf: _run(spark, sf, "without_rag"), _run_sql("without_rag")),
    "j07_attach_page_text": (
        _page_text,
        f"WITH {_QUESTIONS} SELECT conv_id, turn, allq.url, coalesce(p.html, {_DEFAULT}) AS text FROM allq LEFT JOIN pages AS p ON p.page_id = page",
    ),
    "e06_label_pairs": (
        _scored,
        """SELECT doc_id, CASE WHEN quality >= 1 - toxic AND quality >= toxic THEN 'supports' WHEN 1 - toxic >= toxic THEN 'neutral' ELSE 'contradiction' END AS label FROM labels""",
    ),
    "a13_label_counts": (
        lambda spark, sf: B.label_counts(I.doc_labels(spark, sf), "model", "mode"),
        f"WITH {_LABELS},{_counts('labelled')} SELECT model, mode, n, supports, neutral, contradiction FROM counts",
    ),
    "a14_evaluate_runs": (
        _metrics,
        f"WITH {_LABELS},{_counts('labelled')} SELECT model, mode, n, supports, neutral, contradiction, {_METRICS} FROM metrics",
    ),
    "a15_compare_runs": (_compared, f"WITH {_LABELS},{_counts('labelled')} SELECT model, {_SIDE} FROM metrics GROUP BY model"),
    "j08_pair_runs": (
        _paired,
        f"""WITH {_DIALOGUES}, k AS (SELECT conv_id * 100 + turn // 4 AS question_id, * FROM runs)
        SELECT question_id, a.answer AS answer_without_rag, a.text AS text_without_rag, b.answer AS answer_with_rag, b.text AS text_with_rag
        FROM (SELECT * FROM k WHERE mode = 'without_rag') AS a JOIN (SELECT * FROM k WHERE mode = 'with_rag') AS b USING (question_id)""",
    ),
    "e07_evaluate": (
        _evaluated,
        f"WITH {_JUDGED},{_counts('judged')} SELECT model, mode, n, supports, neutral, contradiction, {_METRICS} FROM metrics",
    ),
    "e07_evaluate_and_compare": (
        _evaluated_side,
        f"WITH {_JUDGED},{_counts('judged')} SELECT model, {_SIDE} FROM metrics GROUP BY model",
    ),
}
