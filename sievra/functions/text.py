"""Text column functions: column in, column out, all on the JVM except the NFKC step."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Fixed values ---------------------------------------------------------------------------------
# Whitespace as Python's str.split() and re see it in text (Java's \s is ASCII only).
SPACE_CHARS = r"\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# A word character: any letter, any number, the underscore.
WORD_CHARS = r"\p{L}\p{N}_"

# English stop words of the public NLTK corpus.
ENGLISH_STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
    yourselves he him his himself she she's her hers herself it it's its itself they them their
    theirs themselves what which who whom this that that'll these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at
    by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don
    don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
    doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
    needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)

CURLY_CHARS = "“”‘’–—"
PLAIN_CHARS = "\"\"''--"
CONTROL_CHARS = "\n\r\t\f\v\b\a"

ARTICLE_DOMAIN = "wikipedia.org"
SUMMARY_ENDPOINT = "https://en.wikipedia.org/api/rest_v1/page/summary/"

NO_EVIDENCE_TEXT = "I didn't find evidence for this question"
FAILED_ANSWER = "Error occurred during processing"
FAILED_TEXT = "No content"

PROMPT_WITH_EVIDENCE = (
    "Answer this question: {question} with evidence from Wikipedia: {evidence}. "
    "Only answer this question, don't add any other information. "
)
PROMPT_WITHOUT_EVIDENCE = (
    "Answer this question: {question}.  Only answer this question, don't add any other information."
)
# ----------------------------------------------------------------------------------------------


def normalize_spaces(c: Column) -> Column:
    """Collapse every whitespace run to one space and trim both ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE_CHARS}]+", " "))


def strip_punct(c: Column) -> Column:
    """Put a space in place of every character that is neither a word character nor whitespace."""
    return F.regexp_replace(c, f"[^{WORD_CHARS}{SPACE_CHARS}]", " ")


def clean_text(c: Column) -> Column:
    """Collapse spaces, lower-case, strip punctuation, collapse again.

    Written as one regular expression: after those steps every run of characters that are not word
    characters has become a single space, so replacing such runs directly gives the same text with
    one pass instead of three.
    """
    return F.trim(F.regexp_replace(F.lower(c), f"[^{WORD_CHARS}]+", " "))


def tokenize(c: Column) -> Column:
    """Split on whitespace; never yields an empty token."""
    return F.filter(F.split(c, f"[{SPACE_CHARS}]+"), lambda w: w != "")


def remove_stopwords(
    tokens: Column, stopwords: Sequence[str] | None = None, min_len: int = 2
) -> Column:
    """Drop stop words and tokens shorter than ``min_len``; tests the surface form.

    With ``min_len`` of at least one, empty tokens go as well.

    ``isin`` over a literal list becomes a hash-set lookup, not a scan of the list per token.
    """
    words = list(ENGLISH_STOPWORDS if stopwords is None else stopwords)

    def keep(w: Column) -> Column:
        long_enough = F.length(w) >= min_len
        return long_enough & ~w.isin(words) if words else long_enough

    return F.filter(tokens, keep)


def tokens_to_text(df: DataFrame, col: str) -> Column:
    """Tokens joined by one space; a column that is not an array is cast to string."""
    if df.schema[col].dataType.typeName() == "array":
        return F.array_join(F.col(col), " ")
    return F.col(col).cast("string")


def query_terms(c: Column) -> Column:
    """Lower-cased words of two or more word characters; keeps stop words, does not lemmatise."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"([{WORD_CHARS}]{{2,}})"), F.lit(1))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize_answer(c: Column, nan_text: bool = False) -> Column:
    """NFKC, trimmed, single spaces, curly quotes and dashes as ASCII.

    Spark has no NFKC function. ASCII text is its own NFKC form, so only the other rows are handed
    to Python. ``nan_text`` reads a missing answer as the text ``nan``; by default it stays null.
    """
    c = F.coalesce(c, F.lit("nan")) if nan_text else c
    folded = F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)
    return F.translate(normalize_spaces(folded), CURLY_CHARS, PLAIN_CHARS)


def strip_control(c: Column) -> Column:
    """Each control character of the fixed list becomes one space; nothing is collapsed."""
    return F.translate(c, CONTROL_CHARS, " " * len(CONTROL_CHARS))


def _decode_query_value(c: Column) -> Column:
    # A percent sign that starts no valid escape stays as it is, so it is escaped before decoding.
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def title_from_url(c: Column, domain: str = ARTICLE_DOMAIN) -> Column:
    """Page title in an article URL, else null.

    The host must contain ``domain``. ``/wiki/X/...`` gives ``X`` as written; ``/w/...?title=X``
    gives the first non-empty ``title``, decoded. The URL is taken apart by the generic pattern of
    RFC 3986 instead of a URL parser, so that spaces or stray characters in it do not lose the row.
    Any other path has no title: null.
    """
    url = F.translate(c, "\t\r\n", "")
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    # Parameters after a semicolon belong to the last part of the path and are not part of it.
    path = F.trim(F.regexp_replace(path, ";[^/]*$", ""), F.lit("/"))
    parts = F.split(path, "/")
    first = F.get(parts, F.lit(0))
    titles = F.filter(F.split(query, "&"), lambda p: p.startswith("title=") & (F.length(p) > 6))
    from_query = _decode_query_value(F.substring(F.get(titles, F.lit(0)), 7, 2147483647))
    title = F.when(first == "wiki", F.get(parts, F.lit(1))).when(first == "w", from_query)
    return F.when(F.contains(host, F.lit(domain)), F.nullif(title, F.lit("")))


def summary_url(title: Column) -> Column:
    """URL of the summary endpoint for a title."""
    return F.concat(F.lit(SUMMARY_ENDPOINT), title)


def text_or_default(c: Column, default: str = NO_EVIDENCE_TEXT) -> Column:
    """The text, or the default sentence when title, page or extract is missing."""
    return F.coalesce(c, F.lit(default))


def _fill(template: str, **columns: Column) -> Column:
    # Literal pieces and columns of a template, in order.
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        pieces += [F.lit(before), columns[name]]
    return F.concat(*pieces, F.lit(rest))


def prompt_text(question: Column, evidence: Column | None = None, strict: bool = True) -> Column:
    """Prompt with or without evidence; empty or null evidence takes the template without.

    An empty or null question is an error when ``strict``, otherwise the prompt is null.
    """
    plain = _fill(PROMPT_WITHOUT_EVIDENCE, question=question)
    prompt = plain
    if evidence is not None:
        backed = _fill(PROMPT_WITH_EVIDENCE, question=question, evidence=evidence)
        prompt = F.when(F.length(evidence) > 0, backed).otherwise(plain)
    empty = question.isNull() | (F.length(question) == 0)
    on_empty = F.raise_error(F.lit("question must not be empty")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(empty, on_empty).otherwise(prompt)


def build_prompts(
    df: DataFrame,
    question_col: str = "question",
    evidence_col: str | None = "evidence",
    strict: bool = True,
) -> DataFrame:
    """Add the column ``prompt``."""
    evidence = F.col(evidence_col) if evidence_col else None
    return df.withColumn("prompt", prompt_text(F.col(question_col), evidence, strict))
