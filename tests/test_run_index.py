import os

import pytest

from sievra.operators import vectors as V
from sievra.plans import search
from sievra.registry import answer_ops, inputs as I
from sievra.session import settle

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the given tables")
def test_a_run_finds_what_exact_search_finds(spark):
    vecs = settle(V.embed_chunks(I.documents(spark, SF)), "vecs")
    questions = answer_ops._questions(spark, SF)
    idx = answer_ops.stored_index(spark, vecs, keep_vectors=True)
    truth = settle(search.retrieve_docs(questions, vecs), "truth")
    found = settle(search.retrieve_docs(questions, idx), "found")
    shared = truth.join(found, ["query_id", "doc_id"], "left_semi").count()
    assert truth.count() > 0 and shared >= 0.9 * truth.count()
    run = answer_ops.REGISTRY["e05_build_run_trained_index"][0](spark, SF)
    assert run.count() == questions.count() and run.where("prompt IS NOT NULL").count() > 0
