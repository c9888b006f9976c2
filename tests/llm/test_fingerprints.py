import hashlib

import pyarrow as pa

from sievra.llm import fingerprints as P
from tests.llm.helpers import messy, sentence, shingles


def by_hand(docs):
    out = {}
    for i, (doc, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        out[doc] = (len(text), hashlib.sha256(edit.encode()).hexdigest(), edit, after)
    return out


def jaccard(a, b):
    a, b = shingles(a, 5), shingles(b, 5)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_neighbours_edits_and_likeness(spark):
    texts = [sentence(7 + 11 * i % 90, i, 1 + i % 5) + "é" * (i % 3) for i in range(150)] + ["", "x", "éé", ""]
    docs = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(6)
    want = by_hand(sorted(docs))
    found = P.fingerprints_with_neighbours(df).collect()
    assert len(found) == len(docs)
    for r in found:
        n, sha, edit, after = want[r.doc_id]
        text = dict(docs)[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - jaccard(text, edit)) < 0.25 and abs(r.near_next - jaccard(text, after)) < 0.25
        assert r.fingerprint == bytes(P.text_fingerprints(pa.array([text]))[0].as_py()).hex()
        assert r.edited_fingerprint == bytes(P.text_fingerprints(pa.array([edit]))[0].as_py()).hex()


def test_messy_rows(spark):
    found = P.fingerprints_with_neighbours(messy(spark)).collect()
    assert len(found) == 11
    none = "f" * 4 * P.PERMUTATIONS
    by_id = {r.doc_id: r for r in found}
    assert by_id[3].fingerprint == by_id[4].fingerprint == by_id[5].fingerprint == none
    assert by_id[3].near_next == by_id[3].near_edited == 1.0 and by_id[6].fingerprint != none
    assert P.fingerprints_with_neighbours(messy(spark).limit(0)).count() == 0
    one = P.fingerprints_with_neighbours(messy(spark).where("doc_id = 2")).first()
    assert one.near_next == 1.0


def test_error_of_the_estimate():
    texts, errors = [sentence(60, i, 1 + i % 7) for i in range(40)], []
    prints = [x.as_py() for x in P.text_fingerprints(pa.array(texts))]
    for i in range(39):
        same = sum(prints[i][2 * j : 2 * j + 2] == prints[i + 1][2 * j : 2 * j + 2] for j in range(P.PERMUTATIONS)) / P.PERMUTATIONS
        errors.append(abs(same - jaccard(texts[i], texts[i + 1])))
    assert sum(errors) / len(errors) < 0.05
