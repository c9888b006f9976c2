import numpy as np

from sievra.llm import toxicity as X
from tests.llm.helpers import messy, sentence


def corpus(n=600):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        body = [words[int(j)] for j in rng.integers(0, 300, 60)]
        bad = i % 6 == 0
        for _ in range(3 * bad):
            body[int(rng.integers(0, 60))] = ("blorb", "Zark", "GRUMF")[int(rng.integers(0, 3))]
        docs.append((i, " ".join(body)))
        if i % 5 < 3:
            labels.append((i, int(bad)))
    return docs, labels


def test_toxic_texts_are_found_and_clean_ones_left(spark):
    docs, labels = corpus()
    left = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    right = spark.createDataFrame(labels, "doc_id BIGINT, toxic INT")
    found = X.score_documents(left, right).collect()
    assert len(found) == 600 and all(r.predicted == (r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out]
    assert 80 < len(held) < 160
    toxic = [r.predicted for r in held if r.doc_id % 6 == 0]
    assert sum(toxic) >= 0.8 * len(toxic) and not any(r.predicted for r in held if r.doc_id % 6)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = corpus(300)
    left = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    right = spark.createDataFrame(labels, "doc_id BIGINT, toxic INT")
    held = {r.doc_id for r in X.score_documents(left, right).collect() if r.held_out}
    other = spark.createDataFrame([(i, 1 - t if i in held else t) for i, t in labels], "doc_id BIGINT, toxic INT")
    scores = [{r.doc_id: r.score for r in X.score_documents(left, t).collect()} for t in (right, other)]
    assert scores[0] == scores[1]


def test_the_risk_on_negatives_does_not_go_below_zero():
    """Without the correction, a flexible model drives the estimate far below zero; with it, clean texts stay unknown."""
    rng = np.random.default_rng(1)
    positive = np.hstack([np.ones((200, 1)), rng.integers(0, 2, (200, 10))]).astype(np.float32)
    hidden = np.hstack([np.ones((60, 1)), rng.integers(0, 2, (60, 10))]).astype(np.float32)
    clean = np.hstack([np.zeros((540, 1)), rng.integers(0, 2, (540, 10))]).astype(np.float32)
    weights, intercept = X.fit(positive, np.vstack([hidden, clean]), 0.1)
    g = lambda m: m @ weights + intercept
    assert np.logaddexp(0, g(np.vstack([hidden, clean]))).mean() - 0.1 * np.logaddexp(0, g(positive)).mean() > -0.05
    assert (g(hidden) > 0).mean() > 0.8 and (g(clean) > 0).mean() < 0.05


def test_messy_rows(spark):
    labels = [(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (8, 0), (77, 1)]
    right = spark.createDataFrame([(i, t, 5) for i, t in labels], "doc_id BIGINT, toxic INT, quality INT")
    found = X.score_documents(messy(spark), right).collect()
    assert len(found) == 11 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (3, 4, 5)}) == 1
    for left, other in ((messy(spark).limit(0), right), (messy(spark), right.limit(0))):
        assert X.score_documents(left, other).count() == left.count()


def test_every_word_of_a_long_text_counts():
    model = X.WordModel(*_known("blorb"))
    import pyarrow as pa
    from sievra.llm.words import NOT_ALPHANUMERIC, text_buffers, word_hashes

    texts = [sentence(50_000) + " Blorb!", sentence(50_000), "blorb blorb"]
    assert model.margin(*word_hashes(*text_buffers(pa.array(texts)), NOT_ALPHANUMERIC)).tolist() == [2.0, -1.0, 2.0]


def _known(word):
    import pyarrow as pa
    from sievra.llm.words import NOT_ALPHANUMERIC, text_buffers, word_hashes

    hashes, _ = word_hashes(*text_buffers(pa.array([word])), NOT_ALPHANUMERIC)
    return hashes, np.array([3.0]), -1.0


def test_every_telling_word_gets_a_weight_from_all_texts(spark):
    """600 words are toxic, each in ten texts of 6,000; texts are learned from by a sample of rows, words are not cut."""
    docs = [(i, f"u{i} " + " ".join(f"c{(i * 7 + j * 13) % 500}" for j in range(20))) for i in range(6000)]
    docs = [(i, f"{t} " + " ".join(f"bad{(i // 6 + j * 100) % 600}" for j in range(6)) if i % 6 == 0 else t) for i, t in docs]
    left = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    right = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(6000)], "doc_id BIGINT, toxic INT")
    model = X.train(left, right, max_positive=700, max_unlabelled=1500)
    asked = [f"bad{i}" for i in range(600)]
    import pyarrow as pa
    from sievra.llm.words import NOT_ALPHANUMERIC, text_buffers, word_hashes

    hashes, _ = word_hashes(*text_buffers(pa.array(asked)), NOT_ALPHANUMERIC)
    assert np.isin(hashes, model.words).all()
    margins = model.margin(*word_hashes(*text_buffers(pa.array(asked)), NOT_ALPHANUMERIC))
    assert (margins > model.intercept).sum() >= 570
