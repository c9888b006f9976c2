import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievra.llm import token_counts as T
from tests.llm.helpers import messy, sentence

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", " ", "  ", "\n", "\n\n", "'s", "'ll", "'re", "'", "é", "né", "<|endoftext|>", "9", "12", "...", "\t", "日本", " ", "don't", "ing", "<|", "|>", "　", "!", "'v", "e", "\U0001d6a6", "Rez.\nNew"]


@pytest.fixture(scope="module")
def both():
    return T.PrefixCounter(PATH), Tokenizer.from_file(PATH)


def test_every_prefix_of_odd_texts(both):
    mine, library = both
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert mine.count(text) == want[-1] and mine.prefixes(text) == want, text


def test_words_together_as_one_by_one(both, monkeypatch):
    mine, library = both
    rng = random.Random(2)
    made = ["".join(rng.choice(["ing", "th", "qu", "é", "ß", "x", "Ion", "est"]) for _ in range(rng.randint(1, 9))) for _ in range(900)]
    table = mine.tables([w.encode() for w in made])
    for word, row in zip(made, table):
        assert row[: len(word.encode()) + 1].tolist() == mine.table(word.encode())
    texts = [" ".join(rng.choice(made) for _ in range(200)) + rng.choice(["", ".\n", "  "]) for _ in range(20)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(T, "_PART", 300)  # many groups, texts in several parts
    assert T.PrefixCounter(PATH).count_all(texts) == want
    monkeypatch.setattr(T, "MOST_REMEMBERED", 50)
    assert T.PrefixCounter(PATH).count_all(texts) == want


def test_counts_of_messy_rows(spark, both):
    df = messy(spark, [(30, "<|endoftext|>" + sentence(600), "en")])
    found = T.count_tokens(df, PATH).collect()
    texts = [r.text or "" for r in df.collect()]
    want = sorted((len(t.encode()), len(e.ids), len(e.ids) > 512) for t, e in zip(texts, both[1].encode_batch(texts, add_special_tokens=False)))
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in found) == want
    assert T.count_tokens(df.limit(0), PATH).count() == 0


def test_stored_counts_answer_budgets(spark, both):
    texts = [sentence(50) + " <|endoftext|> don't  stop", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    stored = df.select("doc_id", "text", T.prefix_counts(F.col("text"), PATH).alias("counts"))
    asked = stored.select("text", T.tokens_before(F.col("counts"), 11).alias("at_11"), T.longest_within(F.col("counts"), 9).alias("fit")).collect()
    for r in asked:
        text = r.text or ""
        counts = [len(both[1].encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert r.fit == max(i for i, n in enumerate(counts) if n <= 9)
        assert r.at_11 == (counts[11] if len(text) >= 11 else None)


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        T.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
