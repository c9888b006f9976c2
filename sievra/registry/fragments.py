"""Pieces of SQL that the checks share. Each mirrors the definition of an operator, step by step."""

from __future__ import annotations

from sievra.functions.text import ENGLISH_STOPWORDS
from sievra.operators.analysis import NOUN_SUFFIXES
from sievra.registry.inputs import DIM, LIMITS, NPROBE, SUBVECTORS, sql_list

STOPWORDS = sql_list(ENGLISH_STOPWORDS)


def spaces(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def punct(c: str) -> str:
    return rf"regexp_replace({c}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"


def words(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


def clean(c: str) -> str:
    return spaces(punct(f"lower({spaces(c)})"))


def kept(tokens: str) -> str:
    return f"list_filter({tokens}, lambda x: length(x) > 1 AND NOT list_contains({STOPWORDS}, x))"


def terms(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}')"


TOKENS = f"""
clean AS (SELECT doc_id, lang, source, {clean('text')} AS text FROM documents),
toks AS (SELECT doc_id, lang, source, text, {kept(words('text'))} AS tokens FROM clean)"""

TF = f"""{TOKENS},
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM toks) GROUP BY doc_id, term)"""


def lexical(sample: int | None = None) -> str:
    """CTEs up to ``vocab``, ``raw`` and ``postings``."""
    docs = f"(SELECT doc_id FROM documents ORDER BY doc_id LIMIT {sample})" if sample else "(SELECT doc_id FROM documents)"
    return f"""{TF},
fit AS {docs},
n AS (SELECT count(*) AS n FROM fit),
freq AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM tf WHERE doc_id IN (SELECT doc_id FROM fit) GROUP BY term),
allowed AS (SELECT * FROM freq WHERE df >= {LIMITS['min_df']} AND df <= {LIMITS['max_df']} * (SELECT n FROM n)),
top AS (SELECT * FROM allowed ORDER BY ctf DESC, term LIMIT {LIMITS['max_features']}),
vocab AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_id, df, ctf,
  ln((1.0 + (SELECT n FROM n)) / (1.0 + df)) + 1.0 AS idf FROM top),
raw AS (SELECT doc_id, term, tf, tf * idf AS raw FROM tf JOIN vocab USING (term)),
postings AS (SELECT doc_id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


QUERY_WEIGHTS = f"""
qtf AS (SELECT item_id AS query_id, term, count(*) AS tf FROM (SELECT item_id, unnest({terms('text')}) AS term FROM benchmark) GROUP BY item_id, term),
qraw AS (SELECT query_id, term, tf * idf AS raw FROM qtf JOIN vocab USING (term)),
qw AS (SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS qweight FROM qraw)"""

SCORES = f"""{QUERY_WEIGHTS},
scored AS (SELECT query_id, doc_id, round(sum(qweight * weight), 9) AS score FROM qw JOIN postings USING (term) GROUP BY query_id, doc_id
  HAVING sum(qweight * weight) > 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored),
hits AS (SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10)"""


def lexical_hits(sample: int | None = None) -> str:
    return f"{lexical(sample)},{SCORES}"


# Vectors --------------------------------------------------------------------------------------


def l2(a: str, b: str, dim: int = DIM) -> str:
    return f"list_sum(list_transform(range(1, {dim + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def dot(a: str, b: str, dim: int = DIM) -> str:
    return f"list_sum(list_transform(range(1, {dim + 1}), lambda i: {a}[i] * {b}[i]))"


VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"

CENTROIDS = f"""{VECTORS},
parts AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v),
means AS (SELECT label, d, avg(x) AS m FROM parts GROUP BY label, d),
centroids AS (SELECT label AS list_id, list(m ORDER BY d) AS center FROM means GROUP BY label)"""

LISTS = f"""{CENTROIDS},
near AS (SELECT vec_id, list_id, row_number() OVER (PARTITION BY vec_id ORDER BY round({l2('e', 'center')}, 9), list_id) AS place
  FROM v, centroids),
lists AS (SELECT vec_id, list_id, e FROM near JOIN v USING (vec_id) WHERE place = 1)"""

_WIDTH = DIM // SUBVECTORS
CODES = f"""{LISTS},
books AS (SELECT sub, list_id AS code, center[sub * {_WIDTH} + 1 : (sub + 1) * {_WIDTH}] AS center
  FROM centroids, (SELECT unnest(range(0, {SUBVECTORS})) AS sub)),
pieces AS (SELECT vec_id, list_id, sub, e[sub * {_WIDTH} + 1 : (sub + 1) * {_WIDTH}] AS piece
  FROM lists, (SELECT unnest(range(0, {SUBVECTORS})) AS sub)),
coded AS (SELECT vec_id, list_id, sub, code, center,
  row_number() OVER (PARTITION BY vec_id, sub ORDER BY round({l2('piece', 'center', _WIDTH)}, 9), code) AS place
  FROM pieces JOIN books USING (sub)),
codes AS (SELECT vec_id, list_id, string_agg(code::VARCHAR, ',' ORDER BY sub) AS codes,
  flatten(list(center ORDER BY sub)) AS decoded FROM coded WHERE place = 1 GROUP BY vec_id, list_id)"""


def knn(score: str, order: str, k: int = 10) -> str:
    """CTE ``hits`` over all pairs of the given vectors."""
    return f"""{VECTORS},
pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round({score}, 9) AS score FROM v AS q, v),
hits AS (SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank FROM pairs) WHERE rank <= {k})"""


def ivf(source: str, column: str, k: int = 10) -> str:
    """CTE ``hits`` over the nearest lists, from ``lists`` or ``codes``."""
    return f"""
probes AS (SELECT vec_id AS query_id, list_id FROM near WHERE place <= {NPROBE}),
pairs AS (SELECT p.query_id, s.vec_id, round({l2('q.e', f's.{column}')}, 9) AS score
  FROM probes AS p JOIN v AS q ON q.vec_id = p.query_id JOIN {source} AS s USING (list_id)),
hits AS (SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= {k})"""


# Chunks and hashed vectors --------------------------------------------------------------------


def chunks(size: int, step: int, table: str = "documents", id_col: str = "doc_id") -> str:
    """CTE ``chunks(doc_id, chunk_no, n, start, chunk)``."""
    return f"""
w AS (SELECT {id_col} AS doc_id, {words('text')} AS w FROM {table}),
starts AS (SELECT doc_id, w, len(w) AS n, unnest(range(0, len(w), {step})) AS start FROM w),
chunks AS (SELECT doc_id, (start / {step})::INTEGER AS chunk_no, n, start,
  array_to_string(w[start + 1 : start + {size}], ' ') AS chunk FROM starts)"""


def hashed(source: str, keys: str, text: str, name: str) -> str:
    """CTEs ending in ``name(keys, pos, x)``: the non-zero numbers of hashed unit vectors."""
    return f"""
{name}_terms AS (SELECT {keys}, unnest({terms(text)}) AS t FROM {source}),
{name}_places AS (SELECT {keys}, cast('0x' || substr(md5(t), 1, 8) AS BIGINT) % {DIM} AS pos,
  CASE WHEN substr(md5(t), 9, 1) < '8' THEN -1.0 ELSE 1.0 END AS sign FROM {name}_terms),
{name}_sums AS (SELECT {keys}, pos, sum(sign)::DOUBLE AS x FROM {name}_places GROUP BY {keys}, pos),
{name} AS (SELECT {keys}, pos::INTEGER AS pos, (x / sqrt(sum(x * x) OVER (PARTITION BY {keys})))::FLOAT::DOUBLE AS x
  FROM {name}_sums WHERE x <> 0)"""


def dense_hits(questions: str, id_col: str, text_col: str, k: int = 10) -> str:
    """CTE ``hits(query_id, rank, doc_id, chunk_no, score)``: exact search over the chunks of documents."""
    return f"""{chunks(256, 206)},
{hashed('chunks', 'doc_id, chunk_no', 'chunk', 'cv')},
{hashed(questions, id_col, text_col, 'qv')},
cnorm AS (SELECT c.doc_id, c.chunk_no, coalesce(sum(x * x), 0) AS sq FROM chunks AS c LEFT JOIN cv USING (doc_id, chunk_no) GROUP BY c.doc_id, c.chunk_no),
qnorm AS (SELECT q.{id_col} AS query_id, coalesce(sum(x * x), 0) AS sq FROM {questions} AS q LEFT JOIN qv USING ({id_col}) GROUP BY q.{id_col}),
dots AS (SELECT qv.{id_col} AS query_id, cv.doc_id, cv.chunk_no, sum(qv.x * cv.x) AS dot FROM qv JOIN cv USING (pos) GROUP BY ALL),
pairs AS (SELECT q.query_id, c.doc_id, c.chunk_no, round(abs(q.sq + c.sq - 2 * coalesce(dot, 0)), 9) AS score
  FROM qnorm AS q CROSS JOIN cnorm AS c LEFT JOIN dots USING (query_id, doc_id, chunk_no)),
hits AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id, chunk_no) AS rank, doc_id, chunk_no, score FROM pairs) WHERE rank <= {k})"""


def lemma_sql(tokens_cte: str) -> str:
    """CTE ``lemmas(form, lemma)`` over the distinct tokens of ``tokens_cte``, which are the lexicon, too."""
    rules = "\nUNION ALL ".join(
        f"SELECT term AS form, {i} AS pos, left(term, length(term) - {len(old)}) || '{new}' AS cand FROM forms WHERE ends_with(term, '{old}')"
        for i, (old, new) in enumerate(NOUN_SUFFIXES, 1)
    )
    return f"""
forms AS (SELECT DISTINCT unnest(tokens) AS term FROM {tokens_cte}),
cands AS (SELECT term AS form, 0 AS pos, term AS cand FROM forms
UNION ALL {rules}),
lemmas AS (SELECT form, first(cand ORDER BY length(cand), pos) AS lemma FROM cands WHERE cand IN (SELECT term FROM forms) GROUP BY form)"""
