"""For each named query the SQL that DuckDB runs on the same tables."""

import re

from ..functions import vocab
from .fixtures import REFUSAL, SQL as FIXTURES, closure, render

SPACE = r"'^\s+|\s+$', '', 'g'"


def strip(x):
    return f"regexp_replace({x}, {SPACE})"


def words(x):
    return rf"len(regexp_extract_all({x}, '\S+'))"


def asks(x):
    return rf"regexp_matches({x}, '\?\s*$')"


def tokens(x):
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def slug(x):
    return (f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_'), ''), "
            "'untitled')")


def stem(x):
    return rf"regexp_replace({x}, '^(.+)\.[^.]+$', '\1')"


def texts(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def cut(x, n):
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE substr({x}, 1, {n - 1}) || '…' END"


def overlap(q, c):
    """Of two rows of ``o_bags``."""
    def jaccard(a, b):
        return (f"coalesce(len(list_intersect({a}, {b})) / CAST(nullif(len(list_distinct("
                f"list_concat({a}, {b}))), 0) AS DOUBLE), 0.0)")
    return f"({jaccard(q + '.s', c + '.s')} + 0.5 * {jaccard(q + '.b', c + '.b')})"


def mentions(x):
    return (f"coalesce((SELECT string_agg(c.client, ',' ORDER BY c.client) FROM o_clients c "
            rf"WHERE regexp_matches({x}, '(?i)\b' || c.client || '\b')), '')")


def py_int(j):
    """A JSON scalar as an integer under the lenient rules."""
    s = f"({j} ->> '$')"
    return (f"CASE WHEN json_type({j}) IN ('BIGINT', 'UBIGINT') THEN CAST({s} AS BIGINT) "
            f"WHEN json_type({j}) = 'DOUBLE' THEN CAST(trunc(CAST({s} AS DOUBLE)) AS BIGINT) "
            rf"WHEN json_type({j}) = 'VARCHAR' AND regexp_matches({s}, '^\s*[+-]?[0-9]+\s*$') "
            f"THEN CAST(trim({s}) AS BIGINT) END")


def bm25(corpus, queries, n=20):
    """Query parts; names are prefixed so that several searches fit in one statement."""
    return f"""
SELECT query_id, id, rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
  FROM (WITH d AS (SELECT id, {tokens('text')} AS t FROM {corpus}),
    n AS (SELECT count(*) AS n, avg(len(t)) AS l FROM d),
    p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM d) GROUP BY 1, 2),
    f AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw
          FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), n),
    i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM f) ELSE raw END AS idf FROM f),
    q AS (SELECT query_id, term, count(*) AS k FROM
          (SELECT query_id, unnest({tokens('text')}) AS term FROM {queries}) GROUP BY 1, 2)
    SELECT q.query_id, p.id, sum(q.k * i.idf * p.tf * 2.5
        / (p.tf + 1.5 * (0.25 + 0.75 * len(d.t) / n.l))) AS score
    FROM q JOIN i USING (term) JOIN p USING (term) JOIN d ON d.id = p.id, n GROUP BY 1, 2)
  WHERE score > 0) WHERE rank <= {n}"""


def knn(corpus, queries, metric, n=20):
    d = ("1 - coalesce(list_cosine_similarity(c.v, q.v), 0)" if metric == "cosine"
         else "list_distance(c.v, q.v)")
    return f"""
SELECT * FROM (
  SELECT query_id, id, score, row_number() OVER (
    PARTITION BY query_id ORDER BY round(score, 9), id) AS rank
  FROM (SELECT q.query_id, c.id, {d} AS score FROM {corpus} c, {queries} q)) WHERE rank <= {n}"""


def hashed(source, key):
    return f"""
WITH w AS (SELECT {key}, unnest({tokens('text')}) AS w FROM {source}),
  c AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % 64 AS slot, count(*) AS n
        FROM w GROUP BY 1, 2),
  s AS (SELECT {key}, sqrt(sum(n * n)) AS size FROM c GROUP BY 1)
SELECT k.{key}, list(CAST(coalesce(CAST(c.n / s.size AS FLOAT), 0) AS DOUBLE) ORDER BY k.slot) AS v
FROM (SELECT {key}, unnest(range(64)) AS slot FROM {source}) k
LEFT JOIN c ON c.{key} = k.{key} AND c.slot = k.slot LEFT JOIN s ON s.{key} = k.{key}
GROUP BY 1"""


def rrf(a, b, keys="query_id", n=20):
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY {keys} ORDER BY round(score, 9) DESC, id) AS rank
  FROM (SELECT {keys}, id, sum(1.0 / (60 + CAST(rank AS DOUBLE))) AS score
        FROM (SELECT {keys}, id, rank FROM {a} UNION ALL SELECT {keys}, id, rank FROM {b})
        GROUP BY {keys}, id)) WHERE rank <= {n}"""


_MARKER = (f"question <> '' AND answer = '' AND context = '' AND ref = '' AND category = '' "
           f"AND NOT {asks('question')} AND {words('question')} BETWEEN 1 AND 4")

_LETTERS = "ABCDEFGH"

_META_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.METADATA_HEADERS.items())
_HEAD_LABELS = texts(sorted(set(vocab.QUESTION_HEADERS + vocab.ANSWER_HEADERS) - {"a", "q"}))


def pct(x):
    return f"CAST(CAST(round_even({x} * 100, 0) AS BIGINT) AS VARCHAR) || '%'"


LIBRARY = {
    "o_cells": " UNION ALL ".join(
        f"SELECT source_file, sheet, sheet_no, row_no, '{c}' AS col_letter, "
        f"coalesce({strip(c)}, '') AS value, CAST({i} AS BIGINT) AS col_no FROM fx_wide"
        for i, c in enumerate(_LETTERS, 1)),
    "o_role_rows": f"""
SELECT s.file_no, s.source_file, s.row_no, {strip('s.question')} AS question, {strip('s.answer')} AS answer,
  {strip('s.context')} AS context, s.category,
  CASE WHEN s.role = 'system' THEN '' ELSE CAST(s.row_no AS VARCHAR) END AS ref,
  f.client, f.date, {slug(stem('s.source_file'))} || '_row_' || s.row_no AS pair_id
FROM fx_sheet s JOIN fx_files f USING (source_file) WHERE {strip('s.question')} <> ''""",
    "o_marked": f"""
SELECT *, last_value(CASE WHEN m THEN question END IGNORE NULLS) OVER (
  PARTITION BY source_file ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS section
FROM (SELECT *, {_MARKER} AS m FROM o_role_rows)""",
    "o_rows": """
SELECT * EXCLUDE (m), row_number() OVER (PARTITION BY source_file ORDER BY row_no) - 1 AS i
FROM o_marked WHERE NOT m""",
    "o_chunks": """
SELECT pair_id AS chunk_id, 'Q: ' || question || chr(10) || 'A: ' || answer
    || CASE WHEN context <> '' THEN chr(10) || 'C: ' || context ELSE '' END AS text,
  pair_id, source_file, NULL AS role, 'combined' AS strategy, i AS chunk_index, section FROM o_rows
UNION ALL SELECT pair_id || '__question', question, pair_id, source_file, 'question', 'separated',
  2 * i, section FROM o_rows
UNION ALL SELECT pair_id || '__answer', answer, pair_id, source_file, 'answer', 'separated',
  2 * i + 1, section FROM o_rows""",
    "o_kept": f"SELECT * FROM o_chunks WHERE {strip('text')} <> ''",
    "o_collections": """
SELECT * FROM (VALUES ('combined_cosine', 'combined'), ('combined_l2', 'combined'),
  ('separated_cosine', 'separated'), ('separated_l2', 'separated')) t(collection, strategy)""",
    "o_sheets": f"""
SELECT source_file, sheet, sheet_no, CAST(count(*) FILTER (row_no <= 200 AND {asks('value')}) AS BIGINT)
  AS q_marks, max(row_no) AS max_row FROM o_cells GROUP BY 1, 2, 3""",
    "o_headers": f"""
WITH l AS (SELECT source_file, sheet, min((row_no, col_no, value, col_letter)) AS x FROM o_cells
    WHERE row_no <= 50 AND {strip(f"regexp_replace({strip('lower(value)')}, ':+$', '')")} IN ({_HEAD_LABELS})
    GROUP BY 1, 2),
  q AS (SELECT source_file, sheet, min((row_no, col_no, CAST({words('value')} AS VARCHAR), col_letter)) AS x
    FROM o_cells WHERE row_no <= 50 AND {asks('value')} AND {words('value')} >= 5 GROUP BY 1, 2)
SELECT s.source_file, s.sheet,
  CAST(coalesce(l.x[1], greatest(q.x[1] - 1, 1), 1) AS BIGINT) AS header_row,
  CASE WHEN l.x IS NOT NULL THEN 'label: ' || l.x[4] || l.x[1] || ' ' || l.x[3]
    WHEN q.x IS NOT NULL THEN 'above question: ' || q.x[4] || q.x[1] || ' of ' || q.x[3] || ' words'
    ELSE 'first row' END AS reason
FROM o_sheets s LEFT JOIN l USING (source_file, sheet) LEFT JOIN q USING (source_file, sheet)""",
    "o_profile": f"""
SELECT c.source_file, c.sheet, c.col_no, c.col_letter,
  coalesce(max(CASE WHEN row_no = header_row THEN value END), '') AS header,
  count(CASE WHEN d THEN 1 END) AS non_empty,
  CASE WHEN any_value(n) > 0 THEN count(CASE WHEN d THEN 1 END) / CAST(least(any_value(n), 200) AS DOUBLE)
    ELSE 0.0 END AS pct_non_empty,
  coalesce(avg(CASE WHEN d THEN {words('value')} END), 0.0) AS avg_words,
  coalesce(count(CASE WHEN d AND {asks('value')} THEN 1 END)
    / CAST(nullif(count(CASE WHEN d THEN 1 END), 0) AS DOUBLE), 0.0) AS q_rate,
  count(DISTINCT CASE WHEN d THEN value END) AS cardinality,
  any_value(n) AS n_data_rows, CAST(8 AS BIGINT) AS n_cols
FROM (SELECT c.*, h.header_row, greatest(s.max_row - h.header_row, 0) AS n,
        row_no > header_row AND value <> '' AS d
      FROM o_cells c JOIN o_headers h USING (source_file, sheet) JOIN o_sheets s USING (source_file, sheet)
      WHERE row_no BETWEEN header_row AND header_row + 200) c
GROUP BY 1, 2, 3, 4""",
    "o_roles": f"""
SELECT *, CASE WHEN h IN ({texts(vocab.QUESTION_HEADERS)}) THEN 'question'
    WHEN h IN ({texts(vocab.ANSWER_HEADERS)}) THEN 'answer'
    WHEN h IN ({texts(vocab.CONTEXT_HEADERS)}) THEN 'context' WHEN m IS NOT NULL THEN m
    WHEN pct_non_empty < 0.1 THEN 'ignore'
    WHEN avg_words <= 3 AND share < 0.3 THEN 'metadata'
    WHEN q_rate > 0.5 THEN 'question' WHEN avg_words >= 30 THEN 'answer' ELSE 'context' END AS role,
  CASE WHEN h IN ({texts(vocab.QUESTION_HEADERS + vocab.ANSWER_HEADERS + vocab.CONTEXT_HEADERS)}) OR m IS NOT NULL
      THEN 'header: ' || header
    WHEN pct_non_empty < 0.1 THEN 'sparse: ' || {pct('pct_non_empty')}
    WHEN avg_words <= 3 AND share < 0.3 THEN 'few values: ' || cardinality || ' in ' || non_empty || ' by ' || w
    WHEN q_rate > 0.5 THEN 'asks: ' || {pct('q_rate')}
    WHEN avg_words >= 30 THEN 'long: ' || w ELSE 'open: ' || w END AS reason
FROM (SELECT *, {strip('lower(header)')} AS h, CASE {strip('lower(header)')} {_META_LABELS} END AS m,
  cardinality / CAST(nullif(non_empty, 0) AS DOUBLE) AS share,
  CAST(round_even(avg_words, 1) AS VARCHAR) AS w FROM o_profile)""",
    "o_question_columns": """
SELECT r.source_file, r.sheet,
  coalesce(first(col_letter ORDER BY q_rate DESC, col_no) FILTER (role = 'question'),
    CASE WHEN bool_or(col_letter = 'B') THEN 'B' END) AS col_letter,
  CASE count(*) FILTER (role = 'question') WHEN 1 THEN 'heuristic'
    WHEN 0 THEN 'mapping' ELSE 'heuristic, most asked' END AS method
FROM o_roles r GROUP BY 1, 2""",
    "o_bad_mapping": "SELECT source_file, upper(trim(col_letter)) AS col_letter, lower(trim(role)) AS role FROM fx_mapping_bad",
    "o_bench": "SELECT 'b' || item_id AS query_id, text FROM benchmark",
    "o_docs": "SELECT doc_id AS id, text FROM documents",
    "o_doc_hits": bm25("o_docs", "o_bench"),
    "o_centroids": """
SELECT 'label-' || label AS query_id, list(m ORDER BY pos) AS v FROM (
  SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS m
  FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2)
GROUP BY 1""",
    "o_vectors": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "o_clients": f"SELECT DISTINCT {strip('client')} AS client FROM fx_files WHERE coalesce({strip('client')}, '') <> ''",
    "o_asked": "SELECT chunk_id AS id, text FROM o_kept WHERE role = 'question'",
    "o_whole": "SELECT chunk_id AS id, text FROM o_kept WHERE strategy = 'combined'",
    "o_question_vectors": hashed("fx_questions", "query_id"),
    "o_asked_vectors": hashed("o_asked", "id"),
    "o_whole_vectors": hashed("o_whole", "id"),
    "o_sem": knn("o_asked_vectors", "o_question_vectors", "cosine"),
    "o_bm": bm25("o_asked", "fx_questions"),
    "o_hybrid": rrf("o_sem", "o_bm"),
    "o_bags": f"""
SELECT key, list_distinct(t) AS s, list_distinct(list_transform(range(1, greatest(len(t), 1)),
  lambda i: list_extract(t, i) || ' ' || list_extract(t, i + 1))) AS b
FROM (SELECT key, {tokens('text')} AS t FROM (SELECT query_id AS key, text FROM fx_questions
  UNION ALL SELECT chunk_id, text FROM o_kept))""",
    "o_pairs": f"""
SELECT b.*, c.text, {overlap('x', 'y')} AS overlap
FROM o_bm b JOIN o_asked c ON c.id = b.id JOIN o_bags x ON x.key = b.query_id JOIN o_bags y ON y.key = b.id""",
    "o_top": """
SELECT t.query_id, t.id AS chunk_id, t.rank, t.overlap AS score, t.text,
  replace(t.id, '__question', '__answer') AS answer_id,
  coalesce(a.text, '(answer not found)') AS answer_text, q.pair_id, q.source_file, q.section
FROM (SELECT * EXCLUDE (rank), row_number() OVER (
    PARTITION BY query_id ORDER BY round(overlap, 9) DESC, id) AS rank FROM o_pairs) t
JOIN o_kept q ON q.chunk_id = t.id
LEFT JOIN o_kept a ON a.chunk_id = replace(t.id, '__question', '__answer') WHERE t.rank <= 3""",
    "o_drafts": f"""
SELECT q.query_id, CASE WHEN t.score >= 0.2 AND t.answer_text <> '(answer not found)'
  AND {strip('t.answer_text')} <> '' THEN t.answer_text ELSE '{REFUSAL}' END AS answer
FROM fx_questions q LEFT JOIN o_top t ON t.query_id = q.query_id AND t.rank = 1""",
    "o_sem_pairs": f"""
SELECT b.*, {overlap('x', 'y')} AS overlap, c.text
FROM o_sem b JOIN o_asked c ON c.id = b.id JOIN o_bags x ON x.key = b.query_id JOIN o_bags y ON y.key = b.id""",
    "o_sem_top": """
SELECT t.query_id, t.id AS chunk_id, t.rank, t.overlap AS score, t.text,
  coalesce(a.text, '(answer not found)') AS answer_text, q.pair_id, q.source_file, q.section
FROM (SELECT * EXCLUDE (rank), row_number() OVER (
    PARTITION BY query_id ORDER BY round(overlap, 9) DESC, id) AS rank FROM o_sem_pairs) t
JOIN o_kept q ON q.chunk_id = t.id
LEFT JOIN o_kept a ON a.chunk_id = replace(t.id, '__question', '__answer') WHERE t.rank <= 3""",
    "o_sem_drafts": f"""
SELECT q.query_id, CASE WHEN t.score >= 0.2 AND t.answer_text <> '(answer not found)'
  AND {strip('t.answer_text')} <> '' THEN t.answer_text ELSE '{REFUSAL}' END AS answer
FROM fx_questions q LEFT JOIN o_sem_top t ON t.query_id = q.query_id AND t.rank = 1""",
    "o_rankings": f"""
SELECT query_id, CASE WHEN json_valid(ranking_json) AND json_type(ranking_json) = 'OBJECT' THEN
  CASE WHEN len(items) = len(list_filter(nums, lambda x: x IS NOT NULL)) THEN nums END END AS ranking
FROM (SELECT *, list_transform(items, lambda x: {py_int('x')}) AS nums FROM (
  SELECT query_id, ranking_json, CASE WHEN json_valid(ranking_json) THEN
    coalesce(CAST(json_extract(ranking_json, '$.ranking') AS JSON[]), []) ELSE [] END AS items
  FROM fx_rankings))""",
    "o_configs": f"""
SELECT CAST(row_number() OVER (ORDER BY c, r, k) AS BIGINT) AS config_no, collection, retrieval, rerank,
  concat_ws('|', collection, retrieval, rerank) AS config_key
FROM (SELECT unnest([1, 2, 3, 4]) AS c, unnest([{texts(vocab.COLLECTIONS)}]) AS collection),
  (SELECT unnest([1, 2, 3]) AS r, unnest([{texts(vocab.RETRIEVAL_MODES)}]) AS retrieval),
  (SELECT unnest([1, 2, 3]) AS k, unnest([{texts(vocab.RERANK_MODES)}]) AS rerank)""",
    "o_eval_rows": """
SELECT *, CASE WHEN hit_rank IS NULL THEN 0 ELSE 1 END AS recall, coalesce(1.0 / hit_rank, 0.0) AS mrr,
  n % 5 = 0 AS refused, CASE WHEN j THEN 5 END AS faithfulness, CASE WHEN j THEN n % 3 + 3 END AS relevance,
  CASE WHEN j THEN n % 5 + 1 END AS completeness
FROM (SELECT c.*, q.scope, length(q.text) + config_no AS n,
    scope = 'in' AND (length(q.text) + config_no) % 5 <> 0 AND (length(q.text) + config_no) % 7 <> 0 AS j,
    CASE WHEN scope <> 'in' THEN NULL WHEN config_no % 6 = 0 THEN (length(q.text) + config_no) % 3 + 1
      WHEN (length(q.text) + config_no) % 4 < 3 THEN (length(q.text) + config_no) % 4 + 1 END AS hit_rank
  FROM o_configs c, fx_questions q WHERE scope = 'in' OR config_no <> 36)""",
    "o_aggregates": """
SELECT collection, retrieval, rerank, count(*) FILTER (scope = 'in') AS n_in_scope,
  count(*) FILTER (scope = 'out') AS n_out_scope,
  coalesce(avg(recall) FILTER (scope = 'in'), 0.0) AS recall_at_3,
  coalesce(avg(mrr) FILTER (scope = 'in'), 0.0) AS mrr,
  coalesce(avg(CAST(refused AS INT)) FILTER (scope = 'in'), 0.0) AS retrieval_gap_rate,
  coalesce(avg(CAST(refused AS INT)) FILTER (scope = 'out'), 0.0) AS hallucination_refusal_rate,
  coalesce(avg(faithfulness) FILTER (scope = 'in'), 0.0) AS faithfulness,
  coalesce(avg(relevance) FILTER (scope = 'in'), 0.0) AS relevance,
  coalesce(avg(completeness) FILTER (scope = 'in'), 0.0) AS completeness,
  count(faithfulness) FILTER (scope = 'in') AS n_judged
FROM o_eval_rows GROUP BY 1, 2, 3""",
    "o_words": """
SELECT doc_id, line // 50 + 1 AS page, line * 1000000 + w AS word_no, text, CAST(w * 10 AS DOUBLE) AS x0,
  CAST((line % 50) * 14 + ((line % 50) // 5) * 20 + w % 3 AS DOUBLE) AS top,
  CAST(w * 10 + 8 AS DOUBLE) AS x1,
  (line % 50) * 14 + ((line % 50) // 5) * 20 + w % 3 + CASE WHEN line % 7 = 0 THEN 14.0 ELSE 11.0 END AS bottom,
  CASE WHEN line % 7 = 0 THEN 'Serif-Bold' ELSE 'Serif' END AS fontname,
  CAST(CASE WHEN line % 7 = 0 THEN 14 ELSE 11 END AS DOUBLE) AS size
FROM (SELECT doc_id, line, unnest(parts) AS text, unnest(range(len(parts))) AS w FROM (
  SELECT doc_id, line, string_split(CASE WHEN line % 4 = 0 THEN '- ' || body ELSE body END, ' ') AS parts
  FROM (SELECT doc_id, unnest(ls) AS body, unnest(range(len(ls))) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))))
WHERE text <> ''""",
    "o_tops": "SELECT DISTINCT doc_id, page, top FROM o_words",
    "o_lined": """
SELECT w.*, a.line_top FROM o_words w ASOF JOIN o_anchors a
  ON w.doc_id = a.doc_id AND w.page = a.page AND w.top >= a.line_top""",
    "o_lines": """
SELECT doc_id, page, line_top, min(top) AS top, max(bottom) AS bottom, max(h) AS line_height,
  arg_max(fontname, (n, -seen)) AS font, sum(n) FILTER (fontname = 'Serif-Bold') * 2 > sum(n) AS is_bold,
  arg_max(size, (n, size)) AS modal_size, arg_min(first, seen) AS first
FROM (SELECT doc_id, page, line_top, fontname, size, sum(length(text)) AS n, min(x0) AS seen,
        min(top) AS top, max(bottom) AS bottom, max(bottom - top) AS h, arg_min(text, (x0, top)) AS first
      FROM o_lined GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3""",
    "o_para_lines": r"""
SELECT *, CAST(sum(CASE WHEN r = 1 OR item OR gap OR coalesce(bold, false) OR coalesce(big, false)
    OR coalesce(other, false) THEN 1 ELSE 0 END) OVER (
  PARTITION BY doc_id, page ORDER BY line_top ROWS UNBOUNDED PRECEDING) AS BIGINT) AS para_no
FROM (SELECT *, row_number() OVER w AS r, regexp_matches(first, '^([•●▪◦‣■□◆]|[0-9]+[.)]|-|\*)$') AS item,
    coalesce(top - lag(bottom) OVER w > line_height * 1.4, false) AS gap,
    coalesce(is_bold, false) <> lag(coalesce(is_bold, false)) OVER w AS bold,
    abs(modal_size - lag(modal_size) OVER w) >= 1 AS big, font <> lag(font) OVER w AS other
  FROM o_lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_top))""",
    "o_paras": f"""
SELECT doc_id, page, para_no, {strip("string_agg(text, ' ' ORDER BY line_top, x0, top, word_no)")} AS text,
  count(*) FILTER (fontname = 'Serif-Bold') * 2 > count(*) AS is_bold, arg_min(item, line_top) AS has_num_pr,
  min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom,
  CASE WHEN count(*) FILTER (size = 14) >= count(*) FILTER (size = 11) THEN 14.0 ELSE 11.0 END AS rendered_size
FROM o_lined JOIN (SELECT doc_id, page, line_top, para_no, item FROM o_para_lines) USING (doc_id, page, line_top)
GROUP BY 1, 2, 3""",
    "o_cited": """
SELECT *, CASE WHEN answer_no % 11 = 0 THEN '' WHEN answer_no % 2 = 0
    THEN 'Client File-' || file_no || '.xlsx row ' || p || ' | Client File-' || (file_no + 1) % 25 || '.xlsx row ' || p
    ELSE 'Client File-' || (file_no + 2) % 25 || '.xlsx row ' || p END AS source_list
FROM (SELECT *, CASE answer_no % 3 WHEN 0 THEN 'untracked' WHEN 1 THEN '?' ELSE CAST(row_no AS VARCHAR) END AS p
  FROM fx_answers)""",
    "o_edited": """
SELECT a.* EXCLUDE (answer, refused, status), CASE WHEN e.new_text IS NOT NULL AND NOT e.skipped
    THEN e.new_text ELSE a.answer END AS answer,
  CASE WHEN e.new_text IS NOT NULL AND NOT e.skipped THEN false ELSE a.refused END AS refused,
  CASE WHEN e.skipped THEN 'skipped' WHEN e.new_text IS NOT NULL THEN 'edited'
    ELSE coalesce(a.status, 'accepted') END AS status, e.answer_no IS NOT NULL AS modified
FROM o_cited a LEFT JOIN fx_edits e USING (answer_no)""",
}


def _matrix_library():
    """Pools of all collections and modes, reranked three ways."""
    parts = []
    for name, (strategy, metric) in vocab.COLLECTIONS.items():
        side = "o_asked" if strategy == "separated" else "o_whole"
        LIBRARY[f"o_sem_{name}"] = knn(f"{side}_vectors", "o_question_vectors", metric)
        LIBRARY[f"o_bm_{strategy}"] = bm25(side, "fx_questions")
        LIBRARY[f"o_hyb_{name}"] = rrf(f"o_sem_{name}", f"o_bm_{strategy}")
        for mode, source in (("semantic", f"o_sem_{name}"), ("bm25", f"o_bm_{strategy}"),
                             ("hybrid", f"o_hyb_{name}")):
            parts.append(f"SELECT '{name}' AS collection, '{mode}' AS retrieval, query_id, id, rank FROM {source}")
    LIBRARY["o_pools"] = " UNION ALL ".join(parts)
    LIBRARY["o_pool_pairs"] = f"""
SELECT p.*, c.text, c.pair_id, {overlap('x', 'y')} AS overlap, g.ranking,
  count(*) OVER (PARTITION BY p.collection, p.retrieval, p.query_id) AS size
FROM o_pools p JOIN o_kept c ON c.chunk_id = p.id JOIN o_bags x ON x.key = p.query_id JOIN o_bags y ON y.key = p.id
LEFT JOIN o_rankings g USING (query_id)"""
    LIBRARY["o_reranked"] = """
SELECT collection, retrieval, 'none' AS rerank, query_id, id, pair_id, text, overlap, rank FROM o_pool_pairs
UNION ALL SELECT collection, retrieval, 'crossencoder', query_id, id, pair_id, text, overlap, row_number() OVER (
  PARTITION BY collection, retrieval, query_id ORDER BY round(overlap, 9) DESC, id) FROM o_pool_pairs
UNION ALL SELECT collection, retrieval, 'llm', query_id, id, pair_id, text, overlap, row_number() OVER (
  PARTITION BY collection, retrieval, query_id ORDER BY nullif(list_position(list_filter(
    ranking, lambda x: x >= 0 AND x < size), rank - 1), 0) NULLS LAST, rank) FROM o_pool_pairs"""
    LIBRARY["o_matrix_rows"] = f"""
SELECT g.collection, g.retrieval, g.rerank, g.query_id, g.scope, r.hit_rank,
  CASE WHEN r.hit_rank IS NULL THEN 0 ELSE 1 END AS recall, coalesce(1.0 / r.hit_rank, 0.0) AS mrr,
  NOT coalesce(t.overlap >= 0.2 AND t.answer <> '(answer not found)', false) AS refused
FROM (SELECT c.collection, c.retrieval, c.rerank, q.* FROM o_configs c, fx_questions q) g
LEFT JOIN (SELECT h.*, CASE WHEN h.collection LIKE 'combined%' THEN h.text
      ELSE coalesce(a.text, '(answer not found)') END AS answer
    FROM o_reranked h LEFT JOIN o_kept a ON a.chunk_id = replace(h.id, '__question', '__answer')
      AND a.role = 'answer' WHERE h.rank = 1) t USING (collection, retrieval, rerank, query_id)
LEFT JOIN (SELECT h.collection, h.retrieval, h.rerank, h.query_id, min(h.rank) AS hit_rank
    FROM o_reranked h JOIN fx_questions q USING (query_id)
    WHERE h.rank <= 3 AND q.scope = 'in' AND h.pair_id = q.expected_pair_id GROUP BY 1, 2, 3, 4) r
  USING (collection, retrieval, rerank, query_id)"""


_matrix_library()

_ANCHORS = """o_anchors(doc_id, page, line_top) AS (
  SELECT doc_id, page, min(top) FROM o_tops GROUP BY 1, 2
  UNION ALL
  SELECT a.doc_id, a.page, min(t.top) FROM o_anchors a JOIN o_tops t
    ON t.doc_id = a.doc_id AND t.page = a.page AND t.top > a.line_top + 2.5 GROUP BY a.doc_id, a.page, a.line_top)"""

_ALL = {**{k: render(v, "duckdb") for k, v in FIXTURES.items()}, **LIBRARY}


def statement(sql: str) -> str:
    names = closure(sql, _ALL)
    parts = []
    for name in names:
        if name == "o_lined":
            if "o_tops" not in names:
                deps = [d for d in closure("o_tops", _ALL)]
                parts += [f"{d} AS MATERIALIZED ({_ALL[d]})" for d in deps
                          if not any(p.startswith(d + " ") for p in parts)]
            parts.append(_ANCHORS)
        parts.append(f"{name} AS MATERIALIZED ({_ALL[name]})")
    if not parts:
        return sql
    body = sql.strip()
    joined = f", {body[5:]}" if body.startswith("WITH ") else f" {body}"
    return f"WITH RECURSIVE {', '.join(parts)}{joined}"


_RATES = ", ".join(f"round({c}, 6) AS {c}" for c in (
    "recall_at_3", "mrr", "retrieval_gap_rate", "hallucination_refusal_rate", "faithfulness",
    "relevance", "completeness"))


def _payload(drafts, top):
    return f"""
SELECT d.query_id, d.answer, {strip('d.answer')} = '{REFUSAL}' AS refused,
  coalesce(round(t.confidence, 4), 0.0) AS confidence, coalesce(t.pair_ids, '') AS pair_ids,
  {mentions('d.answer')} AS mentioned_clients, coalesce(t.source_list, '') AS source_list,
  coalesce(t.sections, '') AS sections
FROM {drafts} d LEFT JOIN (
  SELECT query_id, max(score) FILTER (rank = 1) AS confidence, string_agg(pair_id, ',' ORDER BY rank) AS pair_ids,
    string_agg(source_file || ' row ' || regexp_extract(pair_id, '_row_([0-9]+)$', 1), ' | ' ORDER BY rank) AS source_list,
    string_agg(coalesce(section, '-'), ',' ORDER BY rank) AS sections FROM {top} GROUP BY 1) t USING (query_id)"""


_META = ("nullif(ref, '') AS ref, nullif(category, '') AS category, section, client, date")
_HITS = "query_id, id AS {0}, rank, round(score, 6) AS score"
_CHUNK = "chunk_id, text, pair_id, source_file, role, strategy, chunk_index, section"
_DOC_LETTER = ("CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) "
               "WHEN n <= 702 THEN chr(CAST(65 + (n - 27) // 26 AS INT)) || chr(CAST(65 + (n - 27) % 26 AS INT)) "
               "ELSE chr(CAST(65 + (n - 703) // 676 AS INT)) || chr(CAST(65 + (n - 703) // 26 % 26 AS INT)) "
               "|| chr(CAST(65 + (n - 703) % 26 AS INT)) END")

_STATEMENTS = {
    "cells_unpivot": "SELECT source_file, sheet, row_no, col_letter, col_no, value FROM o_cells",
    "load_rows": f"""SELECT source_file, row_no, pair_id, question, answer, nullif(context, '') AS context,
  'excel' AS source_format, {_META} FROM o_rows""",
    "load_rows_from_cells": f"""SELECT source_file, row_no, pair_id, question, answer,
  nullif(context, '') AS context, {_META} FROM o_rows""",
    "config_scan": """SELECT source_file, sheet, header_row, 'B' AS question, 'C' AS answer, 'F,G,H' AS ignored,
  'ref,category' AS metadata_fields, client, date FROM fx_files""",
    "config_validate": """
SELECT f.source_file, concat_ws('; ', CASE WHEN file_no = 7 THEN 'missing field sheet' END,
  CASE WHEN NOT bool_or(role = 'question') THEN 'missing role question' END,
  CASE WHEN NOT bool_or(role = 'answer') THEN 'missing role answer' END) AS problems
FROM fx_files f JOIN o_bad_mapping m USING (source_file) GROUP BY f.source_file, file_no""",
    "config_build": """
SELECT f.source_file, f.sheet, f.header_row, m.role, m.col_letter, 'ref,category' AS metadata_fields,
  f.client, f.date FROM fx_files f JOIN fx_mapping m USING (source_file)""",
    "route_ext": r"""
SELECT path, ext, CASE WHEN ext IN ('.xlsx', '.xlsm') THEN 'sheet' WHEN ext IN ('.docx', '.pdf') THEN 'prose'
    ELSE 'rejected' END AS route,
  CASE WHEN ext NOT IN ('.xlsx', '.xlsm', '.docx', '.pdf') THEN 'Unsupported file extension ''' || ext
    || '''. Supported: .docx, .pdf, .xlsm, .xlsx' END AS error
FROM (SELECT path, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS ext FROM fx_filenames)""",
    "proposal_normalize": "SELECT * FROM o_bad_mapping",
    "apply_client_edit": """SELECT source_file, CASE file_no % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Edited Client'
  ELSE client END AS client, date FROM fx_files""",
    "known_clients": "SELECT client FROM o_clients",
    "header_row_valid": """
SELECT source_file, sheet, h AS header_row, max_row, h >= 1 AND h <= max_row AS valid,
  greatest(max_row - h, 0) AS n_data_rows
FROM (SELECT f.source_file, f.sheet, coalesce(s.max_row, 0) AS max_row, CASE file_no WHEN 2 THEN 0 WHEN 4 THEN 100000000000000
  ELSE header_row END AS h FROM fx_files f LEFT JOIN o_sheets s USING (source_file, sheet))""",
    "sheet_scores": """SELECT source_file, sheet, q_marks, max_row,
  max(max_row) OVER (PARTITION BY source_file) AS detected_rows FROM o_sheets""",
    "sheet_pick": """
SELECT source_file, sheet, q_marks, max_row, CASE WHEN q_marks > 0 THEN 'asks: ' || q_marks ELSE 'most rows' END AS reason
FROM o_sheets QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY q_marks DESC, max_row DESC, sheet_no) = 1""",
    "header_row": "SELECT * FROM o_headers",
    "column_profile": """SELECT source_file, sheet, col_no, col_letter, header, non_empty, cardinality, n_data_rows,
  n_cols, round(pct_non_empty, 6) AS pct_non_empty, round(avg_words, 6) AS avg_words, round(q_rate, 6) AS q_rate
FROM o_profile""",
    "column_samples": f"""
SELECT source_file, sheet, col_letter, sample_no, {cut('v', 80)} AS sample FROM (
  SELECT c.source_file, c.sheet, col_letter, {strip("replace(replace(value, chr(10), ' '), chr(13), ' ')")} AS v,
    row_number() OVER (PARTITION BY c.source_file, c.sheet, col_no ORDER BY row_no) AS sample_no
  FROM o_cells c JOIN o_headers USING (source_file, sheet)
  WHERE row_no > header_row AND row_no <= header_row + 200 AND value <> '') WHERE sample_no <= 3""",
    "heuristic_roles": "SELECT source_file, sheet, col_letter, header, role, reason FROM o_roles",
    "question_column": "SELECT * FROM o_question_columns",
    "question_list": """
SELECT c.source_file, c.sheet, c.row_no, c.value AS text FROM o_cells c
JOIN o_question_columns q USING (source_file, sheet, col_letter) JOIN o_headers h USING (source_file, sheet)
WHERE c.row_no > h.header_row AND c.value <> ''""",
    "question_preview": """
SELECT source_file, sheet, string_agg(c.value, ' | ' ORDER BY c.row_no) AS preview FROM (
  SELECT c.*, row_number() OVER (PARTITION BY source_file, sheet ORDER BY c.row_no) AS k FROM o_cells c
  JOIN o_question_columns q USING (source_file, sheet, col_letter) JOIN o_headers h USING (source_file, sheet)
  WHERE c.row_no > h.header_row AND c.value <> '') c WHERE k <= 3 GROUP BY 1, 2""",
    "mapping_except": """
SELECT source_file, col_letter, 'missing' AS problem FROM (SELECT source_file, col_letter FROM fx_mapping
  EXCEPT ALL SELECT source_file, col_letter FROM o_bad_mapping)
UNION ALL SELECT source_file, col_letter, 'unknown' FROM (SELECT source_file, col_letter FROM o_bad_mapping
  EXCEPT ALL SELECT source_file, col_letter FROM fx_mapping)""",
    "proposal_issues": """
WITH roles AS (SELECT source_file, role, count(*) AS n FROM o_bad_mapping GROUP BY 1, 2),
  wanted AS (SELECT f.source_file, f.role, coalesce(r.n, 0) AS n FROM (SELECT * FROM fx_files,
    (VALUES ('question'), ('answer'), ('context')) v(role)) f LEFT JOIN roles r
    ON r.source_file = f.source_file AND r.role = f.role)
SELECT source_file, 'no role: ' || string_agg(col_letter, ' ' ORDER BY col_letter) AS issue
FROM (SELECT source_file, col_letter FROM fx_mapping EXCEPT SELECT source_file, col_letter FROM o_bad_mapping) GROUP BY 1
UNION ALL SELECT source_file, 'no such column: ' || string_agg(col_letter, ' ' ORDER BY col_letter)
FROM (SELECT source_file, col_letter FROM o_bad_mapping EXCEPT SELECT source_file, col_letter FROM fx_mapping) GROUP BY 1
UNION ALL SELECT source_file, 'role name: ' || col_letter || ' ' || role FROM o_bad_mapping
  WHERE NOT regexp_matches(role, '^[a-z][a-z0-9_]*$')
UNION ALL SELECT source_file, role || ' columns: ' || n || ' not 1' FROM wanted WHERE role <> 'context' AND n <> 1
UNION ALL SELECT source_file, 'context columns: ' || n || ' not 0-1' FROM wanted WHERE role = 'context' AND n > 1
UNION ALL SELECT source_file, 'repeated role: ' || role || ' ' || n FROM roles
  WHERE n > 1 AND role NOT IN ('question', 'answer', 'context', 'ignore')""",
    "mapping_rows": """
SELECT m.source_file, 'single' AS kind, col_letter AS start_letter, col_letter AS end_letter,
  CAST(1 AS BIGINT) AS n_cols, role, coalesce(h.header, '') AS header
FROM fx_mapping m LEFT JOIN fx_headers h USING (source_file, col_letter) WHERE role <> 'ignore'
UNION ALL SELECT source_file, 'ignored_range', min(col_letter), max(col_letter), count(*), role, ''
FROM fx_mapping WHERE role = 'ignore' GROUP BY source_file, role""",
    "section_markers": "SELECT source_file, row_no, question, m AS is_marker FROM o_marked",
    "section_ffill": "SELECT source_file, row_no, section FROM o_rows",
    "row_metadata": " UNION ALL ".join(
        f"SELECT pair_id, '{k}' AS key, {k} AS value FROM o_rows WHERE coalesce({k}, '') <> ''"
        for k in ("ref", "category", "section", "client", "date")),
    "file_summary_rollup": """
SELECT coalesce(source_file, 'TOTAL') AS source_file, count(*) AS n_rows,
  count(*) FILTER (answer = '') AS empty_answers, count(*) FILTER (context <> '') AS with_context,
  count(section) AS with_section FROM o_rows GROUP BY ROLLUP (source_file)""",
    "chunks_combined": f"SELECT {_CHUNK} FROM o_chunks WHERE strategy = 'combined'",
    "chunks_separated": f"SELECT {_CHUNK} FROM o_chunks WHERE strategy = 'separated'",
    "chunks_nonempty": "SELECT chunk_id, chunk_index FROM o_kept WHERE strategy = 'separated'",
    "metadata_sanitize": """
SELECT source_file, row_no, 'context' AS key, context AS value FROM fx_sheet WHERE context <> ''
UNION ALL SELECT source_file, row_no, 'category', category FROM fx_sheet WHERE category <> ''
UNION ALL SELECT source_file, row_no, 'role', role FROM fx_sheet WHERE role <> 'system'""",
    "chunk_stats": f"""SELECT strategy, count(*) AS n_chunks, round(avg({words('text')}), 6) AS avg_words,
  min({words('text')}) AS min_words, max({words('text')}) AS max_words FROM o_kept GROUP BY 1""",
    "chunk_samples": f"""
WITH e AS (SELECT 'first' AS edge, (SELECT pair_id FROM o_rows ORDER BY source_file, row_no LIMIT 1) AS pair_id
  UNION ALL SELECT 'last', (SELECT pair_id FROM o_rows ORDER BY source_file DESC, row_no DESC LIMIT 1))
SELECT edge, strategy, chunk_id, {cut('v', 240)} AS preview FROM (SELECT edge, strategy, chunk_id,
  {strip("replace(text, chr(10), ' | ')")} AS v FROM o_chunks JOIN e USING (pair_id))""",
    "batch_plan": """
SELECT strategy, source_file, chunk_id, i // 16 + 1 AS batch, i % 16 AS slot,
  CAST(ceil(n / 16.0) AS BIGINT) AS n_batches
FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY chunk_index) - 1 AS i,
  count(*) OVER (PARTITION BY source_file) AS n FROM o_kept WHERE strategy = 'separated')""",
    "dup_chunk_ids": f"""
SELECT chunk_id, count(*) AS n FROM (SELECT {slug("source || CASE WHEN doc_id % 2 = 0 THEN '-' ELSE ' ' END || lang")}
  || '_row_' || doc_id // 40 AS chunk_id FROM documents) GROUP BY 1 HAVING count(*) > 1""",
    "corpus_write_read": f"SELECT {_CHUNK} FROM o_kept",
    "corpus_scan_role": "SELECT chunk_id, text FROM o_kept WHERE role = 'question'",
    "corpus_stats": """
SELECT coalesce(source_file, 'TOTAL') AS source_file, CAST(count(*) AS BIGINT) AS n_pairs,
  count(DISTINCT source_file) AS n_files FROM o_rows GROUP BY ROLLUP (source_file)""",
    "collection_counts": "SELECT collection, count(*) AS n_chunks FROM o_collections JOIN o_kept USING (strategy) GROUP BY 1",
    "corpus_delete_counts": """
SELECT collection, count(*) AS n_before, count(*) FILTER (source_file <> 'Client File-2.xlsx') AS n_after,
  count(*) FILTER (source_file = 'Client File-2.xlsx') AS n_removed
FROM o_collections JOIN o_kept USING (strategy) GROUP BY 1""",
    "corpus_after_delete": "SELECT chunk_id, strategy, source_file FROM o_kept WHERE source_file <> 'Client File-2.xlsx'",
    "pending_work": """SELECT c.collection, f.source_file, c.strategy FROM fx_files f, o_collections c
WHERE NOT EXISTS (SELECT 1 FROM fx_checkpoint d WHERE d.collection = c.collection AND d.source_file = f.source_file)""",
    "checkpoint_rows": """
SELECT c.collection, r.source_file, r.n AS rows, coalesce(k.n, 0) AS chunks_embedded
FROM (SELECT source_file, count(*) AS n FROM o_rows GROUP BY 1) r, o_collections c
LEFT JOIN (SELECT strategy, source_file, count(*) AS n FROM o_kept GROUP BY 1, 2) k
  ON k.strategy = c.strategy AND k.source_file = r.source_file""",
    "embed_chunks": f"""
WITH v AS ({hashed("(SELECT chunk_id, text FROM o_kept WHERE strategy = 'separated')", "chunk_id")})
SELECT * FROM (SELECT chunk_id, unnest(range(64)) AS slot, round(unnest(v), 6) AS value FROM v) WHERE value <> 0""",
    "knn_cosine": f"SELECT {_HITS.format('vec_id')} FROM ({knn('o_vectors', 'o_centroids', 'cosine')})",
    "knn_l2": f"SELECT {_HITS.format('vec_id')} FROM ({knn('o_vectors', 'o_centroids', 'l2')})",
    "bm25_topk": f"SELECT {_HITS.format('doc_id')} FROM o_doc_hits",
    "bm25_term_stats": f"""
WITH t AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents),
  f AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf_total FROM t GROUP BY 1),
  r AS (SELECT *, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS raw FROM f)
SELECT term, df, tf_total, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END, 6) AS idf FROM r""",
    "tfidf_cosine": f"""
WITH d AS (SELECT id, term, 1 + ln(count(*)) AS w FROM (SELECT id, unnest({tokens('text')}) AS term FROM o_docs) GROUP BY 1, 2),
  s AS (SELECT id, sqrt(sum(w * w)) AS size FROM d GROUP BY 1),
  f AS (SELECT term, count(*) AS df FROM d GROUP BY 1),
  q AS (SELECT query_id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM (
      SELECT query_id, term, ln((SELECT count(*) FROM documents) / CAST(df AS DOUBLE)) AS idf
      FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM o_bench) JOIN f USING (term)) GROUP BY 1, 2),
  z AS (SELECT query_id, sqrt(sum(w * w)) AS size FROM q GROUP BY 1),
  h AS (SELECT q.query_id, d.id, sum(q.w / z.size * d.w / s.size) AS score FROM q JOIN d USING (term)
    JOIN s ON s.id = d.id JOIN z ON z.query_id = q.query_id GROUP BY 1, 2)
SELECT query_id, id AS doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM h WHERE score > 0) WHERE rank <= 20""",
    "rrf_hybrid": f"SELECT {_HITS.format('chunk_id')} FROM o_hybrid",
    "rerank_none": f"SELECT {_HITS.format('doc_id')} FROM o_doc_hits WHERE rank <= 3",
    "rerank_pairs": "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM o_top",
    "rerank_permutation": """
SELECT query_id, id AS chunk_id, new_rank AS rank, CASE WHEN ranking IS NULL THEN round(score, 6)
    ELSE CAST(size - new_rank + 1 AS DOUBLE) END AS score,
  CASE WHEN ranking IS NULL THEN 'bm25' ELSE 'llm_rerank' END AS score_type
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY nullif(list_position(list_filter(
    ranking, lambda x: x >= 0 AND x < size), rank - 1), 0) NULLS LAST, rank) AS new_rank
  FROM (SELECT p.*, g.ranking, count(*) OVER (PARTITION BY p.query_id) AS size
        FROM o_pairs p LEFT JOIN o_rankings g USING (query_id)))""",
    "score_gap": """
SELECT query_id, round(a, 6) AS top_score, round(b, 6) AS second_score, round(a - b, 6) AS gap
FROM (SELECT query_id, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b FROM o_doc_hits GROUP BY 1)""",
    "pair_link": "SELECT query_id, rank, chunk_id, answer_id, answer_text FROM o_top",
    "context_blocks": """
SELECT query_id, string_agg('[past Q&A ' || rank || ', source=' || source_file || ']' || chr(10) || 'Q: ' || text
  || chr(10) || 'A: ' || answer_text, chr(10) || chr(10) ORDER BY rank) AS context FROM o_top GROUP BY 1""",
    "draft_or_refuse": "SELECT query_id, answer FROM o_drafts",
    "answer_payload": _payload("o_drafts", "o_top"),
    "answer_questions": _payload("o_sem_drafts", "o_sem_top"),
    "stream_answer": f"SELECT * FROM ({_payload('o_sem_drafts', 'o_sem_top')}) WHERE query_id LIKE 'out-%'",
    "client_mentions": f"SELECT answer_no, {mentions('a.answer')} AS clients FROM fx_answers a",
    "refusal_flags": f"""
SELECT answer_no, lower(answer) LIKE '%cannot find this in our corpus%' AS says_refusal,
  {strip('answer')} = '{REFUSAL}' AS is_refusal FROM fx_answers""",
    "config_matrix": """
SELECT f.*, n.n_chunks FROM o_configs f JOIN (
  SELECT collection, count(*) AS n_chunks FROM o_collections JOIN o_kept USING (strategy) GROUP BY 1) n USING (collection)""",
    "config_pending": f"""
SELECT config_no, collection, retrieval, rerank, config_key FROM o_configs
WHERE collection IN (SELECT list_extract([{texts(list(vocab.COLLECTIONS)[:3])}], doc_id % 3 + 1) FROM documents)
  AND config_no NOT IN (SELECT config_no FROM labels JOIN o_configs ON config_no = doc_id % 36 + 1
                        WHERE config_key NOT LIKE '%|none') ORDER BY config_no LIMIT 5""",
    "eval_questions": "SELECT query_id, text, scope, expected_pair_id FROM fx_questions",
    "eval_rank": """
SELECT q.query_id, min(h.rank) AS hit_rank, CASE WHEN min(h.rank) IS NULL THEN 0 ELSE 1 END AS recall,
  round(coalesce(1.0 / min(h.rank), 0), 6) AS mrr
FROM fx_questions q LEFT JOIN (SELECT o.*, k.pair_id FROM o_hybrid o JOIN o_kept k ON k.chunk_id = o.id) h
  ON h.query_id = q.query_id AND h.pair_id = q.expected_pair_id AND h.rank <= 3
WHERE q.scope = 'in' GROUP BY 1""",
    "eval_aggregate": f"""SELECT collection, retrieval, rerank, n_in_scope, n_out_scope, n_judged, {_RATES}
FROM o_aggregates""",
    "eval_axis_means": """
WITH a AS (SELECT *, split_part(collection, '_', 1) AS strategy, split_part(collection, '_', 2) AS distance FROM o_aggregates)
SELECT axis, value, round(avg(recall_at_3), 6) AS recall_at_3, round(avg(mrr), 6) AS mrr,
  round(avg(retrieval_gap_rate), 6) AS retrieval_gap_rate, count(*) AS n_configs
FROM (SELECT 'retrieval' AS axis, retrieval AS value, * FROM a UNION ALL SELECT 'rerank', rerank, * FROM a
  UNION ALL SELECT 'strategy', strategy, * FROM a UNION ALL SELECT 'distance', distance, * FROM a) GROUP BY 1, 2""",
    "comparison_table": """
SELECT rank, '| ' || concat_ws(' | ', rank, collection, retrieval, rerank, printf('%.3f', round(round(recall_at_3, 9), 3)),
  printf('%.3f', round(round(mrr, 9), 3)), printf('%.3f', round(round(retrieval_gap_rate, 9), 3)), printf('%.3f', round(round(hallucination_refusal_rate, 9), 3)),
  printf('%.2f', round(round(faithfulness, 9), 2)), printf('%.2f', round(round(relevance, 9), 2)), printf('%.2f', round(round(completeness, 9), 2)), n_judged) || ' |' AS line
FROM (SELECT *, row_number() OVER (ORDER BY round(recall_at_3 + mrr, 9) DESC,
  concat_ws('|', collection, retrieval, rerank)) AS rank FROM o_aggregates)""",
    "leaderboard_gap": """
SELECT config_key, round(retrieval_gap_rate, 6) AS retrieval_gap_rate, round(mrr, 6) AS mrr FROM (
  SELECT *, concat_ws('|', collection, retrieval, rerank) AS config_key FROM o_aggregates
  WHERE round(recall_at_3, 9) = 1 ORDER BY round(retrieval_gap_rate, 9), 2 LIMIT 5)""".replace(", 2 LIMIT", ", config_key LIMIT"),
    "judge_parse": f"""
SELECT query_id, coalesce(ok, false) AS judged, CASE WHEN ok THEN f END AS faithfulness,
  CASE WHEN ok THEN r END AS relevance, CASE WHEN ok THEN c END AS completeness,
  CASE WHEN ok THEN {strip("coalesce(j ->> '$.reasoning', '')")} END AS reasoning
FROM (SELECT *, f IS NOT NULL AND r IS NOT NULL AND c IS NOT NULL AS ok FROM (
  SELECT query_id, j, {py_int("(j -> '$.faithfulness')")} AS f, {py_int("(j -> '$.relevance')")} AS r,
    {py_int("(j -> '$.completeness')")} AS c
  FROM (SELECT query_id, CASE WHEN json_valid(payload_json) THEN CAST(payload_json AS JSON) END AS j FROM fx_judge)))""",
    "eval_matrix": f"""
WITH a AS (SELECT m.collection, m.retrieval, m.rerank, count(*) FILTER (m.scope = 'in') AS n_in_scope,
  count(*) FILTER (m.scope = 'out') AS n_out_scope, coalesce(avg(recall) FILTER (m.scope = 'in'), 0.0) AS recall_at_3,
  coalesce(avg(mrr) FILTER (m.scope = 'in'), 0.0) AS mrr,
  coalesce(avg(CAST(refused AS INT)) FILTER (m.scope = 'in'), 0.0) AS retrieval_gap_rate,
  coalesce(avg(CAST(refused AS INT)) FILTER (m.scope = 'out'), 0.0) AS hallucination_refusal_rate,
  coalesce(avg(5) FILTER (j), 0.0) AS faithfulness, coalesce(avg(3 + length(q.text) % 3) FILTER (j), 0.0) AS relevance,
  coalesce(avg(1 + length(q.text) % 5) FILTER (j), 0.0) AS completeness, count(*) FILTER (j) AS n_judged
FROM (SELECT *, scope = 'in' AND NOT refused AND query_id IN (
    SELECT query_id FROM fx_questions WHERE length(text) % 4 <> 0) AS j FROM o_matrix_rows) m
JOIN fx_questions q USING (query_id) GROUP BY 1, 2, 3)
SELECT collection, retrieval, rerank, n_in_scope, n_out_scope, n_judged, {_RATES} FROM a""",
    "apply_edits": """SELECT answer_no, answer, refused, status, modified,
  (SELECT count(*) FROM o_edited WHERE modified) AS n_modified FROM o_edited""",
    "export_filled": """
SELECT w.source_file, w.row_no, w.B AS question, CASE WHEN e.status <> 'skipped' THEN e.answer END AS suggested_answer,
  CASE WHEN e.status <> 'skipped' THEN e.source_list END AS answer_sources,
  CASE WHEN e.status <> 'skipped' THEN round(e.confidence, 2) END AS answer_confidence,
  replace(w.source_file, '.xlsx', '_answered.xlsx') AS download_name
FROM fx_wide w LEFT JOIN o_edited e USING (source_file, row_no) WHERE w.sheet = 'Main'""",
    "format_sources": "SELECT answer_no, source_list FROM o_cited",
    "run_totals": """SELECT source_file, count(*) FILTER (NOT refused) AS answered, count(*) FILTER (refused) AS refused,
  count(*) AS total FROM fx_answers GROUP BY 1""",
    "review_summary": """SELECT source_file, count(*) AS total, count(*) FILTER (status = 'accepted') AS accepted,
  count(*) FILTER (status = 'edited') AS edited, count(*) FILTER (status = 'skipped') AS skipped,
  count(*) FILTER (status IS NULL) AS pending FROM fx_answers GROUP BY 1""",
    "run_state": """
SELECT *, CASE WHEN total > 0 THEN round(100.0 * batch / total, 0) ELSE 0.0 END AS percent FROM (
  SELECT run_id, collection, coalesce(arg_max(batch, seq) FILTER (type = 'progress'), 0) AS batch,
    coalesce(arg_max(total, seq) FILTER (type = 'progress'), 0) AS total, bool_or(type = 'complete') AS complete,
    coalesce(arg_max(chunks, seq) FILTER (type = 'complete'), 0) AS chunks FROM fx_run_events GROUP BY 1, 2)""",
    "tokens": f"""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS token_hash, array_to_string(t, ' ') AS line
FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)""",
    "slugs": f"""
SELECT path, {slug(stem("regexp_extract(path, '[^/]*$', 0)"))} AS slug, {slug('path')} AS path_slug FROM fx_filenames
UNION ALL SELECT source_file, {slug(stem('source_file'))}, 'untitled' FROM fx_files""",
    "text_features": f"""SELECT source_file, row_no, {words('question')} AS question_words,
  {words('answer')} AS answer_words, {asks('question')} AS asks FROM fx_sheet""",
    "truncate_forms": f"""
SELECT doc_id, {cut('a', 80)} AS cell, {cut('b', 240)} AS chunk, {cut('c', 160)} AS hit,
  CASE WHEN length(t) <= 400 THEN t ELSE substr(t, 1, 400) || '…' END AS candidate
FROM (SELECT doc_id, t, {strip("replace(replace(t, chr(10), ' '), chr(13), ' ')")} AS a,
    {strip("replace(t, chr(10), ' | ')")} AS b, replace(t, chr(10), ' | ') AS c
  FROM (SELECT doc_id, ' ' || chr(10) || text AS t FROM documents))""",
    "column_letters": f"""
SELECT doc_id, {_DOC_LETTER} AS letter, n AS col_no FROM (SELECT doc_id, doc_id % 16384 + 1 AS n FROM documents)""",
    "pair_row": r"""
SELECT pair_id, CASE WHEN pair_id = '' THEN '?' ELSE coalesce(nullif(regexp_extract(pair_id, '_row_([0-9]+)$', 1), ''),
  pair_id) END AS row_label
FROM (SELECT unnest([pair_id, pair_id || 'x', '']) AS pair_id FROM fx_user_rows)""",
    "list_markers": r"""
SELECT doc_id, word, regexp_matches(word, '^([•●▪◦‣■□◆]|[0-9]+[.)]|-|\*)$') AS is_marker, doc_id % 3 = 0 AS is_bold
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '•' WHEN 1 THEN doc_id || '.' WHEN 2 THEN '·' WHEN 3 THEN '-'
  ELSE regexp_extract(text, '^\S+', 0) END AS word FROM documents)""",
    "modal_size": """
SELECT doc_id, page, arg_max(size, (n, size)) AS modal_size FROM (
  SELECT doc_id, page, size, count(*) AS n FROM o_words GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "layout_lines": """SELECT doc_id, page, line_top, count(*) AS n_words, min(word_no) AS first_word_no,
  max(word_no) AS last_word_no FROM o_lined GROUP BY 1, 2, 3""",
    "line_signature": r"""
SELECT doc_id, page, line_top, top, bottom, line_height, font, coalesce(is_bold, false) AS is_bold, modal_size,
  regexp_matches(first, '^([•●▪◦‣■□◆]|[0-9]+[.)]|-|\*)$') AS starts_item FROM o_lines""",
    "layout_paragraphs": "SELECT doc_id, page, line_top, para_no FROM o_para_lines",
    "paragraph_text": """SELECT doc_id, page, para_no, text, is_bold, has_num_pr, rendered_size
FROM o_paras WHERE text <> ''""",
    "bbox_in_table": """
SELECT p.doc_id, p.page, p.para_no, EXISTS (SELECT 1 FROM fx_boxes b WHERE b.doc_id = p.doc_id AND b.page = p.page
  AND p.x0 >= b.x0 - 2 AND p.top >= b.top - 2 AND p.x1 <= b.x1 + 2 AND p.bottom <= b.bottom + 2) AS in_table
FROM o_paras p WHERE p.text <> ''""",
    "zip_pair_dates": f"""
WITH l AS (SELECT doc_id, unnest(ls) AS text, unnest(range(len(ls))) AS n
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  p AS (SELECT *, n // 5 AS table_row, n % 4 = 0 AS item FROM l WHERE {strip('text')} <> '' OR n % 4 = 0),
  b AS (SELECT *, CASE WHEN NOT item THEN row_number() OVER (
    PARTITION BY doc_id, table_row, item ORDER BY n) END AS i FROM p),
  d AS (SELECT doc_id, n // 5 AS table_row, CAST(2000 + n % 25 AS VARCHAR) AS date,
    row_number() OVER (PARTITION BY doc_id, n // 5 ORDER BY n) AS i FROM l WHERE n % 5 < 2)
SELECT b.doc_id, b.table_row, b.n AS para_no, coalesce(d.date, '') AS date
FROM b LEFT JOIN d ON d.doc_id = b.doc_id AND d.table_row = b.table_row AND d.i = b.i""",
    "stream_ingest": f"""SELECT 'conv_' || conv_id || '_row_' || turn || '__' || role AS chunk_id, text, role
FROM conversations WHERE role <> 'system' AND {strip('text')} <> ''""",
    "stream_ingest_chunks": f"SELECT {_CHUNK} FROM o_kept",
    "stream_ingest_checkpoint": """
SELECT c.collection, r.source_file, r.n AS rows, coalesce(k.n, 0) AS chunks_embedded
FROM (SELECT source_file, count(*) AS n FROM o_rows GROUP BY 1) r, o_collections c
LEFT JOIN (SELECT strategy, source_file, count(*) AS n FROM o_kept GROUP BY 1, 2) k
  ON k.strategy = c.strategy AND k.source_file = r.source_file""",
    "stream_sessions": """
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
  s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 21600000000 THEN 0 ELSE 1 END AS begins FROM e),
  g AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM s),
  w AS (SELECT user_id AS session_id, min(t) AS started, max(t) + 21600000000 AS ended, count(*) AS n_events FROM g GROUP BY user_id, k)
SELECT * FROM w WHERE ended <= (SELECT max(t) FROM e)""",
    "stream_progress": """
SELECT user_id AS run_id, event_id % 4 AS collection, arg_max(event_type, event_id) AS type,
  arg_max(event_id % 40 + 1, event_id) AS batch, max(event_id) AS seq, count(*) AS n_events FROM events GROUP BY 1, 2""",
    "stream_dedup": "SELECT event_type, count(*) AS n_events, count(*) AS n_ids FROM events GROUP BY 1",
    "session_retention": """
SELECT user_id AS session_id, round(idle, 3) AS idle_seconds FROM (SELECT user_id,
  (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 1000000.0 AS idle FROM events GROUP BY 1) WHERE idle > 21600""",
}

# The questions of the sheets go the way of fx_questions, under names of their own.
_ALL["o_listed"] = (
    "SELECT source_file, sheet, row_no, text, source_file || '/' || sheet || '/' || row_no AS query_id "
    f"FROM ({_STATEMENTS['question_list']})")
_WAY = {"fx_questions": "o_listed", "o_question_vectors": "o_listed_vectors", "o_bags": "o_listed_bags",
        "o_sem": "o_listed_sem", "o_sem_pairs": "o_listed_pairs", "o_sem_top": "o_listed_top",
        "o_sem_drafts": "o_listed_drafts"}
for _old, _new in list(_WAY.items())[1:]:
    _ALL[_new] = re.sub(r"\b(?:fx|o)_\w+", lambda m: _WAY.get(m[0], m[0]), _ALL[_old])
_STATEMENTS["answer_sheet"] = f"""
WITH p AS ({_payload('o_listed_drafts', 'o_listed_top')}),
  e AS (SELECT l.*, p.*, l.row_no % 5 = 0 AS picked, l.row_no % 5 = 0 AND l.row_no % 3 = 0 AS skipped
        FROM o_listed l JOIN p USING (query_id))
SELECT w.source_file, w.sheet, w.row_no, w.B AS question,
  CASE WHEN e.picked AND NOT e.skipped AND e.row_no % 2 = 0 THEN 'Edited: ' || e.text
    WHEN NOT e.skipped THEN e.answer END AS suggested_answer,
  CASE WHEN NOT e.skipped THEN e.source_list END AS answer_sources,
  CASE WHEN NOT e.skipped THEN CAST(round(CAST(e.confidence AS DECIMAL(18, 4)), 2) AS DOUBLE) END AS answer_confidence
FROM fx_wide w LEFT JOIN e ON (w.source_file, w.sheet, w.row_no) = (e.source_file, e.sheet, e.row_no)"""
_STATEMENTS["eval_resumed"] = _STATEMENTS["eval_matrix"]
ORACLES = {name: statement(sql) for name, sql in _STATEMENTS.items()}
