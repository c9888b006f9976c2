"""Inputs and plain versions that the tests of this folder share."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the cat sat on a mat and then it ran off to see how far the road would go before night fell on us all".split()

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, id BIGINT, score STRING, bands INT, pivot STRING"


def sentence(n, start=0, step=1):
    return " ".join(WORDS[(start + i * step) % len(WORDS)] for i in range(n))


def messy(spark, extra=()):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named as the operators name theirs."""
    rows = [
        (1, sentence(60), "en"), (2, sentence(60) + " indeed", "en"), (3, None, "en"), (4, "", None), (5, "   \n ", "en"),
        (6, "one", "en"), (6, "one", "en"), (None, sentence(40, 3), "en"), (None, None, None),
        (7, "x" * 300_000 + " " + sentence(30_000, 1, 3), "en"), (8, "Was ist das für ein schöner Tag " * 20, "de"), *extra,
    ]
    return spark.createDataFrame([(i, t, lang, None, None, 9, "s", 1, "p") for i, t, lang in rows], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shingles(text, k, word=r"[^\x20\x09-\x0D]+"):
    words = re.findall(word, (text or "").translate(LOWER))
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else ({tuple(words)} if words else set())
