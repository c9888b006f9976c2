"""Queries and checks: text functions and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievra.functions import text as T
from sievra.operators import analysis as A
from sievra.operators.chunks import chunk_words
from sievra.registry import fragments as S
from sievra.registry import inputs as I


def _docs(fn):
    return lambda spark, sf: I.documents(spark, sf).select("doc_id", fn(F.col("text")).alias("text"))


def _joined(c):
    return F.array_join(c, " ")


def _lemmas(spark, sf):
    out = A.analyze_documents(I.documents(spark, sf))
    return out.select("doc_id", _joined("tokens").alias("tokens"))


def _analyzed(spark, sf):
    out = A.analyze_documents(I.documents(spark, sf))
    return out.select("doc_id", "lang", "source", "n_chars", "text", _joined("tokens").alias("tokens"))


def _tokens_text(spark, sf):
    tokens = I.tokens(spark, sf)
    return tokens.select(
        "doc_id", T.tokens_to_text(tokens, "tokens").alias("tokens"), T.tokens_to_text(tokens, "n_chars").alias("n")
    )


def _turns(spark, sf):
    return I.table(spark, sf, "conversations")


def _chunks(spark, sf, **options):
    return chunk_words(I.documents(spark, sf).select("doc_id", "text"), **options)


def _prompts(spark, sf):
    turns = _turns(spark, sf)
    evidence = F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, F.col("role"))
    return T.build_prompts(turns.select("conv_id", "turn", F.col("text").alias("question"), evidence.alias("evidence")))


_LEMMA_TOKENS = f"""{S.TOKENS},{S.lemma_sql('toks')},
pos AS (SELECT doc_id, unnest(tokens) AS form, generate_subscripts(tokens, 1) AS i FROM toks),
lem AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY i) AS tokens FROM pos JOIN lemmas USING (form) GROUP BY doc_id)"""

_URL = """
tails AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) AS tail FROM pages),
urls AS (SELECT page_id, unnest([url, 'https://en.wikipedia.org/wiki/' || tail,
  'https://en.wikipedia.org//w/index.php?title=Page%20' || tail || '+x&oldid=1',
  '//de.wikipedia.org/w/?title=&oldid=1' || tail]) AS url FROM tails),
cut AS (SELECT page_id, url, regexp_extract(url, '^(?:[a-z]+:)?//([^/?#]*)', 1) AS host,
  string_split(trim(regexp_extract(url, '^(?:[a-z]+:)?//[^/?#]*([^?#]*)', 1), '/'), '/') AS parts,
  string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&') AS args FROM urls),
titles AS (SELECT page_id, url, CASE WHEN NOT contains(host, 'wikipedia.org') THEN NULL
  WHEN parts[1] = 'wiki' THEN nullif(parts[2], '')
  WHEN parts[1] = 'w' THEN url_decode(replace(substr(list_filter(args, lambda a: starts_with(a, 'title=') AND length(a) > 6)[1], 7), '+', ' ')) END AS title FROM cut)"""

_PROMPT = """
CASE WHEN length(evidence) > 0
  THEN 'Answer this question: ' || question || ' with evidence from Wikipedia: ' || evidence || '. Only answer this question, don''t add any other information. '
  ELSE 'Answer this question: ' || question || '.  Only answer this question, don''t add any other information.' END"""

REGISTRY = {
    "t01_normalize_spaces": (_docs(T.normalize_spaces), f"SELECT doc_id, {S.spaces('text')} AS text FROM documents"),
    "t02_lower": (_docs(F.lower), "SELECT doc_id, lower(text) AS text FROM documents"),
    "t03_strip_punct": (_docs(T.strip_punct), f"SELECT doc_id, {S.punct('text')} AS text FROM documents"),
    "t04_tokenize": (
        _docs(lambda c: F.array_join(T.tokenize(c), "|")),
        f"SELECT doc_id, array_to_string({S.words('text')}, '|') AS text FROM documents",
    ),
    "t05_remove_stopwords": (
        _docs(lambda c: _joined(T.remove_stopwords(T.tokenize(c)))),
        f"SELECT doc_id, array_to_string({S.kept(S.words('text'))}, ' ') AS text FROM documents",
    ),
    "t06_lemmatize": (
        _lemmas,
        f"WITH {_LEMMA_TOKENS} SELECT doc_id, coalesce(lem.tokens, '') AS tokens FROM toks LEFT JOIN lem USING (doc_id)",
    ),
    "t07_analyze_documents": (
        _analyzed,
        f"""WITH {_LEMMA_TOKENS} SELECT doc_id, toks.lang, toks.source, d.n_chars, toks.text, coalesce(lem.tokens, '') AS tokens
        FROM toks JOIN documents AS d USING (doc_id) LEFT JOIN lem USING (doc_id)""",
    ),
    "t08_tokens_to_text": (
        _tokens_text,
        f"""WITH {S.TOKENS} SELECT doc_id, array_to_string(tokens, ' ') AS tokens, d.n_chars::VARCHAR AS n
        FROM toks JOIN documents AS d USING (doc_id)""",
    ),
    "t09_analyze_queries": (
        lambda spark, sf: A.analyze_queries(I.search_queries(spark, sf)).select("query_id", _joined("terms").alias("terms")),
        f"SELECT item_id AS query_id, array_to_string({S.terms('text')}, ' ') AS terms FROM benchmark",
    ),
    "t09_analyze_queries_as_documents": (
        lambda spark, sf: A.analyze_queries(I.search_queries(spark, sf), mode="document").select(
            "query_id", _joined("terms").alias("terms")
        ),
        f"SELECT item_id AS query_id, array_to_string({S.kept(S.words(S.clean('text')))}, ' ') AS terms FROM benchmark",
    ),
    "t10_normalize_answer": (
        lambda spark, sf: _turns(spark, sf).select("conv_id", "turn", T.normalize_answer(F.col("text")).alias("text")),
        f"SELECT conv_id, turn, translate({S.spaces('text')}, '“”‘’–—', '\"\"''''--') AS text FROM conversations",
    ),
    "t11_strip_control": (
        _docs(T.strip_control),
        "SELECT doc_id, translate(text, chr(10)||chr(13)||chr(9)||chr(12)||chr(11)||chr(8)||chr(7), '       ') AS text FROM documents",
    ),
    "t12_title_from_url": (
        lambda spark, sf: I.article_urls(spark, sf).withColumn("title", T.title_from_url(F.col("url"))),
        f"WITH {_URL} SELECT page_id, url, title FROM titles",
    ),
    "t13_summary_url": (
        lambda spark, sf: I.article_urls(spark, sf).select(
            "page_id", "url", T.summary_url(T.title_from_url(F.col("url"))).alias("summary")
        ),
        f"WITH {_URL} SELECT page_id, url, 'https://en.wikipedia.org/api/rest_v1/page/summary/' || title AS summary FROM titles",
    ),
    "t14_text_or_default": (
        lambda spark, sf: I.article_urls(spark, sf).select(
            "page_id", "url", T.text_or_default(T.title_from_url(F.col("url"))).alias("text")
        ),
        f"WITH {_URL} SELECT page_id, url, coalesce(title, 'I didn''t find evidence for this question') AS text FROM titles",
    ),
    "t15_build_prompts": (
        _prompts,
        f"""WITH q AS (SELECT conv_id, turn, text AS question,
          CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN role END AS evidence FROM conversations)
        SELECT conv_id, turn, question, evidence, {_PROMPT} AS prompt FROM q""",
    ),
    "g01_chunk_words": (
        lambda spark, sf: _chunks(spark, sf, size=100),
        f"WITH {S.chunks(100, 100)} SELECT doc_id, chunk_no, chunk FROM chunks",
    ),
    "g02_chunk_words_overlap": (
        lambda spark, sf: _chunks(spark, sf, size=256, overlap=50),
        f"WITH {S.chunks(256, 206)} SELECT doc_id, chunk_no, chunk FROM chunks",
    ),
    "g03_chunk_words_pad": (
        lambda spark, sf: _chunks(spark, sf, size=256, overlap=50, pad=True),
        f"""WITH {S.chunks(256, 206)} SELECT doc_id, chunk_no,
        CASE WHEN start + 206 >= n THEN chunk || repeat(' ', greatest(256 - (n - start), 0)) ELSE chunk END AS chunk FROM chunks""",
    ),
    "g04_chunk_rows": (
        lambda spark, sf: _chunks(spark, sf, size=256, overlap=50).groupBy("doc_id").agg(F.count("*").alias("n_chunks")),
        f"WITH {S.chunks(256, 206)} SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id",
    ),
}
