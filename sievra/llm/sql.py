"""SQL of the registered queries, over the tables of the folder."""

from __future__ import annotations

from sievra.llm.licenses import TEMPLATES

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""
WITH RECURSIVE
ws AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                               ELSE w END) AS s FROM ws),
items AS (SELECT doc_id, unnest(s) AS item FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

CONTAINED_ITEMS = r"""
WITH
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[0-9a-z]|[^\x00-\x7F])+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[0-9a-z]|[^\x00-\x7F])+') AS w FROM benchmark),
ds AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM dw),
si AS (
  SELECT item_id, list_distinct(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS l FROM iw),
one AS (SELECT item_id, len(l) AS n_item, unnest(l) AS s FROM si)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, n_item::BIGINT AS n_item, count(*) / n_item AS containment
FROM one JOIN ds USING (s) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""

_BODY = r"(/?SYS\]|/?INST\]|OUT\]|NEXT\]|/?ROLE\]|TEXT\]|/?s>)"

CHAT_FORMAT = rf"""
WITH
rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)),
marked AS (
  SELECT *, regexp_replace(text, '([\[<])(~*{_BODY})', '\1~\2', 'g') AS e,
    regexp_replace(role, '([\[<])(~*{_BODY})', '\1~\2', 'g') AS r,
    role IS DISTINCT FROM lag(role) OVER w AS opens FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
sized AS (
  SELECT *, length(e) + CASE WHEN NOT opens THEN 6
    WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 9 ELSE 19 + length(r) END AS n FROM marked)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_PAIRS = """list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)"""


def licenses() -> str:
    """Every line, paragraph of several lines, and text of several paragraphs against every template; the most alike counts."""
    rows = ", ".join("({}, {})".format(i, ", ".join("'" + x.replace("'", "''") + "'" for x in t)) for i, t in enumerate(TEMPLATES))
    word = "'(?:[0-9a-z]|[^\\x00-\\x7F])+'"
    return rf"""
WITH
templates AS (SELECT * FROM (VALUES {rows}) AS t(t_id, license, body)),
tw AS (SELECT t_id, license, regexp_extract_all(lower(body), {word}) AS w FROM templates),
ts AS (SELECT t_id, license, {_PAIRS} AS s FROM tw),
ti AS (SELECT t_id, license, len(s) AS size, unnest(s) AS pair FROM ts),
lines AS (
  SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(lower(text), chr(10)), 1) AS i FROM documents),
inked AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS ink FROM lines),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM inked WHERE ink),
paragraphs AS (SELECT doc_id, run, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n FROM runs GROUP BY doc_id, run),
parts AS (
  SELECT doc_id, line AS body FROM inked WHERE ink
  UNION ALL SELECT doc_id, body FROM paragraphs WHERE n > 1
  UNION ALL SELECT doc_id, lower(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM paragraphs GROUP BY doc_id HAVING count(*) > 1)),
numbered AS (SELECT row_number() OVER () AS part, doc_id, regexp_extract_all(body, {word}) AS w FROM parts),
pw AS (SELECT part, doc_id, {_PAIRS} AS s FROM numbered WHERE len(w) > 0),
pi AS (SELECT part, doc_id, len(s) AS size, unnest(s) AS pair FROM pw),
hits AS (
  SELECT part, doc_id, license, t_id, 2 * count(*) / (pi.size + ti.size) AS dice, count(*) AS shared, pi.size + ti.size AS sizes
  FROM pi JOIN ti USING (pair) GROUP BY part, doc_id, license, t_id, pi.size, ti.size HAVING 200 * count(*) >= 80 * (pi.size + ti.size)),
most AS (SELECT *, max(dice) OVER (PARTITION BY part) AS top FROM hits)
SELECT doc_id, license, count(DISTINCT part)::BIGINT AS n_parts, max(dice) AS dice FROM most WHERE dice = top GROUP BY doc_id, license
"""


_FRAMED = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_UP = "SELECT {g}, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {t} WHERE n > 1 GROUP BY {g}, lvl, pos // 2"

MERKLE = rf"""
WITH RECURSIVE
bytes AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (
  SELECT documents.*, {_leaf("n_chars")} AS leaf, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    CASE WHEN xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS shown
  FROM documents, bytes),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM docs),
nodes AS (SELECT g, 0 AS lvl, pos, leaf AS h, n FROM leaves UNION ALL {_UP.format(g="g", t="nodes")}),
tops AS (SELECT 0 AS z, 0 AS lvl, g AS pos, h, (SELECT count(DISTINCT g) FROM docs) AS n FROM nodes WHERE n = 1 UNION ALL {_UP.format(g="z", t="tops")}),
steps AS (
  SELECT l.g, l.pos, a.lvl, b.h, b.pos < a.pos AS is_left FROM leaves l JOIN nodes a ON a.g = l.g AND a.pos = l.pos >> a.lvl AND a.n > 1
  LEFT JOIN nodes b ON b.g = a.g AND b.lvl = a.lvl AND b.pos = xor(a.pos, 1)
  UNION ALL
  SELECT l.g, l.pos, 1000 + a.lvl, b.h, b.pos < a.pos FROM leaves l JOIN tops a ON a.pos = l.g >> a.lvl AND a.n > 1
  LEFT JOIN tops b ON b.lvl = a.lvl AND b.pos = xor(a.pos, 1)),
ways AS (
  SELECT g, pos, sha256(coalesce(string_agg(h, '' ORDER BY lvl), '')) AS proof_sha256,
    list(CASE WHEN h IS NULL THEN '=' WHEN is_left THEN '<' || h ELSE '>' || h END ORDER BY lvl) AS way FROM steps GROUP BY g, pos),
folded AS (
  SELECT l.*, coalesce(proof_sha256, sha256('')) AS proof_sha256,
    list_reduce([coalesce(shown, leaf)] || coalesce(way, []), lambda x, s:
      CASE s[1] WHEN '<' THEN sha256(s[2:] || x) WHEN '>' THEN sha256(x || s[2:]) ELSE sha256(x) END) AS folded_root
  FROM leaves l LEFT JOIN ways USING (g, pos))
SELECT f.doc_id, f.leaf, s.h AS subroot, r.h AS root, proof_sha256, folded_root, folded_root = r.h AS verified
FROM folded f JOIN nodes s ON s.g = f.g AND s.n = 1 JOIN tops r ON r.n = 1
"""

HARD_NEGATIVES = """
WITH
v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, list_inner_product(a.e, v.e)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
    FROM scored WHERE alike AND vec_id <> anchor_id) WHERE place <= 5),
negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM negatives WHERE rank <= 10
"""
