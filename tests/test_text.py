import unicodedata
import urllib.parse

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievra.functions import text as T


def column(spark, values, fn):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i INT, c STRING")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("c")).alias("x")).collect()]


def test_spaces_and_punctuation(spark):
    texts = ["caf\u00e9_x don't  stop", "a\u00a0b", " ...!? ", "", None, "x\u3000y\n\tz", "\u0663 \u2462 \u00bd"]
    assert column(spark, texts, T.normalize_spaces) == [
        "caf\u00e9_x don't stop", "a b", "...!?", "", None, "x y z", "\u0663 \u2462 \u00bd"
    ]
    assert column(spark, texts, T.strip_punct) == [
        "caf\u00e9_x don t  stop", "a\u00a0b", " " * 7, "", None, "x\u3000y\n\tz", "\u0663 \u2462 \u00bd"
    ]


def test_clean_text_equals_its_steps(spark):
    texts = ["Café_X, don't STOP!", "(A) -- [b]\n c", "...", "", "ÀÉ9_ß", "a b\x0bc"]
    steps = lambda c: T.normalize_spaces(T.strip_punct(F.lower(T.normalize_spaces(c))))
    assert column(spark, texts, T.clean_text) == column(spark, texts, steps)


def test_tokens_match_python_split(spark):
    texts = [" a  b ", "", "   ", "one", "x y　z\x1cw\x85v", "l1\nl2\r\nl3"]
    assert column(spark, texts, T.tokenize) == [t.split() for t in texts]


def test_stopwords(spark):
    def run(c):
        return T.remove_stopwords(T.tokenize(c))

    assert column(spark, ["the cat a I", "the a", "", "don t stop x"], run) == [["cat"], [], [], ["stop"]]
    assert column(spark, ["the cat"], lambda c: T.remove_stopwords(T.tokenize(c), [])) == [["the", "cat"]]


def test_query_terms(spark):
    assert column(spark, ["What is the capital of X?", "a b", "ÉTÉ_1 c3"], T.query_terms) == [
        ["what", "is", "the", "capital", "of"], [], ["été_1", "c3"]
    ]


def test_tokens_to_text(spark):
    df = spark.createDataFrame([(["a", "b"], 5)], "t ARRAY<STRING>, n INT")
    row = df.select(T.tokens_to_text(df, "t").alias("t"), T.tokens_to_text(df, "n").alias("n")).first()
    assert (row.t, row.n) == ("a b", "5")


def test_normalize_answer(spark):
    texts = ["ﬁ①Ａ", "“a” ‘b’ – —", " x \n y ", None, "plain", "a b"]
    assert column(spark, texts, T.normalize_answer) == ["fi1A", "\"a\" 'b' - -", "x y", None, "plain", "a b"]
    assert column(spark, [None], lambda c: T.normalize_answer(c, nan_text=True)) == ["nan"]


def test_normalize_answer_composes_like_python(spark):
    texts = ["\u00e9t\u00e9", "e\u0301te\u0301", "\u00ea \uac00", "\u1100\u1161", "\u00bd \u2460 \ufb01", "A\u030a"]
    assert column(spark, texts, T.normalize_answer) == [unicodedata.normalize("NFKC", t) for t in texts]


def test_strip_control(spark):
    assert column(spark, ["a\n\r\t\f\v\b\ab"], T.strip_control) == ["a" + " " * 7 + "b"]


def python_title(url):
    """The rules in plain Python: URL library, first non-empty title."""
    if url is None:
        return None
    parsed = urllib.parse.urlparse(url)
    parts = parsed.path.strip("/").split("/")
    if "wikipedia.org" not in parsed.netloc:
        return None
    if parts[0] == "wiki" and len(parts) > 1:
        return parts[1] or None
    return urllib.parse.parse_qs(parsed.query).get("title", [None])[0] if parts[0] == "w" else None


def test_title_from_url(spark):
    urls = [
        "https://en.wikipedia.org/wiki/AC/DC",
        "https://en.wikipedia.org//w/index.php?title=A%20B+c&amp;oldid=1",
        "en.wikipedia.org/wiki/X",
        "https://example.org/wiki/X",
        "https://en.wikipedia.org/wiki/",
        "https://en.wikipedia.org/w/?title=",
        "https://en.wikipedia.org/w/?title=&title=B",
        "https://en.wikipedia.org/w/?x=1&title=%C3%89t%C3%A9#t",
        "https://en.wikipedia.org/w/?title=100%&oldid=2",
        "https://en.wikipedia.org/wiki/A;b?c#d",
        "https://en.wikipedia.org/wiki/A b|c",
        "//de.wikipedia.org/wiki/Ü",
        "https://en.wikipedia.org/",
        "https://en.wikipedia.org/other/X",
        "https://en.wikipedia.org:80/wiki/C%2B%2B",
        "no url at all",
        "",
        None,
    ]
    assert column(spark, urls, T.title_from_url) == [python_title(u) for u in urls]


def test_summary_url_and_default(spark):
    assert column(spark, ["X", None], T.summary_url) == ["https://en.wikipedia.org/api/rest_v1/page/summary/X", None]
    assert column(spark, ["X", None, ""], T.text_or_default) == ["X", T.NO_EVIDENCE_TEXT, ""]


def test_prompts(spark):
    df = spark.createDataFrame([("q", "ev"), ("q", ""), ("q", None)], "question STRING, evidence STRING")
    plain = "Answer this question: q.  Only answer this question, don't add any other information."
    assert [r.prompt for r in T.build_prompts(df).collect()] == [
        "Answer this question: q with evidence from Wikipedia: ev. Only answer this question, don't add any other information. ",
        plain,
        plain,
    ]


def test_empty_question(spark):
    df = spark.createDataFrame([("", "ev"), (None, "ev")], "question STRING, evidence STRING")
    with pytest.raises(PySparkException):
        T.build_prompts(df).collect()
    assert [r.prompt for r in T.build_prompts(df, strict=False).collect()] == [None, None]
