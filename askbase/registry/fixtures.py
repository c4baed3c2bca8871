"""Questionnaire-shaped inputs derived from the given tables.

Each entry is SQL that Spark and DuckDB read alike, but for small constant
tables, which each dialect spells its own way. Every nation is a client
with one workbook, every conversation part of one workbook. Row numbers of a
sheet come from arithmetic on ids, so no window over a whole file is needed;
sheets may have empty rows in between.
"""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F


BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Characters of documents that a task sets as pages.
PAGE_CHARS = 4_000_000

REFUSAL = "I cannot find this in our corpus."

# Small constant tables; each row of a query is repeated for every entry.
CONSTANTS = {
    "preamble": (("n",), ("1", "2", "3")),
    "mapping": (("col_letter", "role"), (
        "A ref", "B question", "C answer", "D context", "E category", "F ignore", "G ignore",
        "H ignore")),
    "headers": (("col_letter", "header"), ("A Ref", "B Question", "C Answer", "F Spare")),
    "done": (("collection",), ("combined_cosine", "combined_l2", "separated_cosine")),
}

SQL = {
    "fx_turns": """
SELECT t.conv_id, t.turn, t.role, t.text, n.role AS next_role, n.text AS next_text
FROM conversations t LEFT JOIN conversations n
  ON n.conv_id = t.conv_id AND n.turn = t.turn + 1""",
    "fx_files": """
SELECT CAST(n_nationkey AS BIGINT) AS file_no,
  'Client File-' || CAST(n_nationkey AS STRING) || '.xlsx' AS source_file, 'Main' AS sheet,
  CAST(CASE WHEN n_nationkey % 8 IN (3, 5) THEN 4 ELSE 1 END AS BIGINT) AS header_row,
  CASE WHEN n_nationkey % 8 = 6 THEN NULL ELSE n_name END AS client,
  CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE '2024' END AS date
FROM nation""",
    "fx_slots": """
SELECT conv_id % 25 AS file_no, 'Client File-' || CAST(conv_id % 25 AS STRING) || '.xlsx' AS source_file,
  conv_id, turn, role, text, next_role, next_text,
  CAST(floor(turn / 16) AS BIGINT) * 1099511627776 + CAST(floor(conv_id / 25) AS BIGINT) * 16
    + turn % 16 AS slot
FROM fx_turns""",
    "fx_sheet": """
SELECT file_no, source_file, role,
  slot + CASE WHEN file_no % 8 IN (3, 5) THEN 5 ELSE 2 END AS row_no,
  CASE WHEN conv_id % 11 = 0 AND turn = 2 THEN ''
       WHEN role = 'system'
         THEN coalesce(nullif(regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+', 0), ''), 'Section')
       WHEN conv_id % 3 <> 0 THEN substr(text, 1, length(text) - 1) || '?'
       ELSE text END AS question,
  CASE WHEN role = 'user' AND next_role = 'assistant' THEN next_text ELSE '' END AS answer,
  CASE WHEN role = 'user' AND turn % 3 = 0
       THEN 'Background of topic ' || CAST(conv_id % 5 AS STRING) ELSE '' END AS context,
  CASE WHEN role = 'user' AND conv_id % 7 <> 0
       THEN 'cat' || CAST(conv_id % 5 AS STRING) ELSE '' END AS category
FROM fx_slots WHERE role IN ('user', 'system')""",
    "fx_preamble": """
SELECT source_file, sheet, $preamble$ FROM fx_files WHERE file_no % 8 IN (3, 5)""",
    "fx_wide": """
SELECT source_file, 'Main' AS sheet, 1 AS sheet_no, row_no,
  CASE WHEN role = 'system' THEN '' ELSE CAST(row_no AS STRING) END AS A, question AS B,
  answer AS C, context AS D, category AS E, CAST(NULL AS STRING) AS F, '' AS G, ' fixed ' AS H
FROM fx_sheet
UNION ALL
SELECT source_file, sheet, 1, header_row, 'Ref', 'Question:', ' Answer', 'Context', 'Category',
  NULL, '', '' FROM fx_files WHERE file_no % 2 = 0
UNION ALL
SELECT source_file, sheet, 1, CAST(n AS BIGINT), 'Company: Example', 'Ready?', '', '', '',
  NULL, '', '' FROM fx_preamble
UNION ALL
SELECT source_file, 'Plan', 2, slot + 1, role, text, '', '', '', NULL, '', ''
FROM fx_slots WHERE file_no % 8 = 4""",
    "fx_mapping": """
SELECT source_file, $mapping$ FROM fx_files""",
    "fx_mapping_bad": """
SELECT m.source_file,
  CASE WHEN f.file_no = 1 AND m.col_letter = 'H' THEN 'J'
       WHEN f.file_no = 5 THEN ' ' || lower(m.col_letter) ELSE m.col_letter END AS col_letter,
  CASE WHEN f.file_no = 0 AND m.col_letter = 'D' THEN 'question'
       WHEN f.file_no = 2 AND m.col_letter = 'E' THEN 'Bad Role'
       WHEN f.file_no = 3 AND m.col_letter IN ('G', 'H') THEN 'category'
       WHEN f.file_no = 4 AND m.col_letter IN ('C', 'G') THEN 'context'
       WHEN f.file_no = 5 THEN ' ' || upper(m.role) || ' '
       ELSE m.role END AS role
FROM fx_mapping m JOIN fx_files f ON f.source_file = m.source_file
WHERE NOT (f.file_no = 6 AND m.col_letter IN ('B', 'G'))""",
    "fx_user_rows": """
SELECT file_no, source_file, row_no, row_no * 25 + file_no AS answer_no, category, question, answer,
  'client_file_' || CAST(file_no AS STRING) || '_row_' || CAST(row_no AS STRING) AS pair_id
FROM fx_sheet WHERE role = 'user' AND question <> ''""",
    "fx_questions": """
SELECT 'in-' || pair_id AS query_id, regexp_replace(question, '[ ]+[^ ]+$', '') AS text, 'in' AS scope,
  pair_id AS expected_pair_id
FROM fx_user_rows
UNION ALL
SELECT 'out-' || CAST(item_id AS STRING), text, 'out', NULL FROM benchmark""",
    "fx_rankings": """
SELECT query_id, CASE length(text) % 9
  WHEN 0 THEN '{"ranking": [2, 0, 1]}' WHEN 1 THEN '{"ranking": [1, 1, 0, 3]}'
  WHEN 2 THEN '{"ranking": [99, -1, 4, 0]}' WHEN 3 THEN '{"ranking": ["3", 1.5, "0"]}'
  WHEN 4 THEN '{"ranking": [19, 5]}' WHEN 5 THEN 'no ranking' WHEN 6 THEN '{"ranking": []}'
  WHEN 7 THEN '{"ranking": ["1.5", 0]}' ELSE '[1, 0]' END AS ranking_json
FROM fx_questions""",
    "fx_judge": """
SELECT CAST(doc_id AS STRING) AS query_id, CASE doc_id % 6
  WHEN 0 THEN '{"faithfulness": 5, "relevance": 4, "completeness": '
    || CAST(1 + quality * 3 + toxic AS STRING) || ', "reasoning": " fine "}'
  WHEN 1 THEN '{"faithfulness": 5, "relevance": 4}'
  WHEN 2 THEN '{"faithfulness": "3", "relevance": 4.7, "completeness": 9}'
  WHEN 3 THEN 'not json'
  WHEN 4 THEN '{"faithfulness": null, "relevance": 4, "completeness": 2}'
  ELSE '{"faithfulness": "3.5", "relevance": 4, "completeness": 2}' END AS payload_json
FROM labels""",
    "fx_question_judge": """
SELECT query_id, CASE WHEN length(text) % 4 = 0 THEN 'not json' ELSE
  '{"faithfulness": 5, "relevance": ' || CAST(3 + length(text) % 3 AS STRING)
  || ', "completeness": ' || CAST(1 + length(text) % 5 AS STRING) || '}' END AS payload_json
FROM fx_questions""",
    "fx_answers": f"""
SELECT answer_no, row_no, source_file, question, pair_id, file_no,
  CASE WHEN answer_no % 6 = 0 THEN '{REFUSAL}'
       WHEN answer_no % 9 = 0 THEN 'Sorry, I CANNOT FIND this in our corpus. Ask us.'
       WHEN answer_no % 4 = 1 THEN answer || ' As with nation_'
         || CAST((file_no + 1) % 25 AS STRING) || '.'
       WHEN answer_no % 4 = 3 THEN answer || ' xNATION_1x'
       ELSE answer END AS answer,
  answer_no % 6 = 0 AS refused, CAST(answer_no % 97 AS DOUBLE) / 97 AS confidence,
  CASE answer_no % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'edited' WHEN 2 THEN 'skipped' END AS status
FROM fx_user_rows""",
    "fx_edits": """
SELECT answer_no, CASE WHEN answer_no % 5 = 0 THEN 'Edited ' || CAST(answer_no AS STRING) END
  AS new_text, answer_no % 7 = 0 AS skipped
FROM fx_answers WHERE answer_no % 5 = 0 OR answer_no % 7 = 0""",
    "fx_checkpoint": """
SELECT source_file, CAST(10 AS BIGINT) AS rows, CAST(20 AS BIGINT) AS chunks_embedded, $done$
FROM fx_files WHERE file_no IN (0, 1)""",
    "fx_run_events": """
SELECT user_id AS run_id, event_id AS seq, ts,
  CASE event_type WHEN 'view' THEN 'collection' WHEN 'click' THEN 'progress'
    WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'answer' ELSE 'error' END AS type,
  CASE event_id % 4 WHEN 0 THEN 'combined_cosine' WHEN 1 THEN 'combined_l2'
    WHEN 2 THEN 'separated_cosine' ELSE 'separated_l2' END AS collection,
  event_id % 40 + 1 AS batch, CAST(40 AS BIGINT) AS total, event_id % 100 AS chunks
FROM events""",
    "fx_filenames": """
SELECT 'in/' || source || '_' || CAST(doc_id AS STRING) || CASE doc_id % 6
  WHEN 0 THEN '.xlsx' WHEN 1 THEN '.XLSM' WHEN 2 THEN '.pdf' WHEN 3 THEN '.docx'
  WHEN 4 THEN '.txt' ELSE '' END AS path
FROM documents""",
    "fx_boxes": """
SELECT doc_id, CAST(1 AS BIGINT) AS page, CAST(0 AS DOUBLE) AS x0, CAST(42 AS DOUBLE) AS top,
  CAST(400 AS DOUBLE) AS x1, CAST(120 AS DOUBLE) AS bottom FROM documents""",
    "fx_headers": """
SELECT source_file, $headers$ FROM fx_files""",
}


def render(sql: str, dialect: str) -> str:
    """Fill in the constant tables: ``inline`` in Spark, ``unnest`` in DuckDB."""
    for name, (columns, entries) in CONSTANTS.items():
        rows = [dict(zip(columns, e.split())) for e in entries]
        if dialect == "spark":
            items = ", ".join("struct(" + ", ".join(f"'{v}' AS {c}" for c, v in r.items()) + ")"
                              for r in rows)
            text = f"inline(array({items}))"
        else:
            items = ", ".join("{" + ", ".join(f"'{c}': '{v}'" for c, v in r.items()) + "}" for r in rows)
            text = f"unnest([{items}], recursive := true)"
        sql = sql.replace(f"${name}$", text)
    return sql


def closure(sql: str, library: dict[str, str]) -> list[str]:
    """Names from ``library`` that ``sql`` needs, each after what it needs itself."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b(?:fx|o)_\w+", text)):
            if name in library and name not in ordered:
                visit(library[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    return ordered


_PLANS: dict[tuple, DataFrame] = {}


def _planned(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """Keep the (lazy) plan, so that files are listed and schemas read only once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PLANS:
        _PLANS[key] = make()
    return _PLANS[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _planned(spark, sf_dir, name, lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a Spark plan over the Parquet files."""
    def make() -> DataFrame:
        names = closure(name, SQL)
        body = " ".join(SQL[n] for n in names)
        base = [b for b in BASE if re.search(rf"\b(?:FROM|JOIN) {b}\b", body)]
        views = [f"{b} AS (SELECT * FROM parquet.`{sf_dir}/{b}.parquet`)" for b in base]
        views += [f"{n} AS ({render(SQL[n], 'spark')})" for n in names]
        return spark.sql(f"WITH {', '.join(views)} SELECT * FROM {name}")

    return _planned(spark, sf_dir, name, make)


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set as pages of 50 lines: headings, list items and wide gaps."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    chars = documents.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    # a word takes many times its letters: a task gets a bounded number of them
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PAGE_CHARS))
    lines = documents.repartition(parts, "doc_id").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    marked = F.when(F.col("line") % 4 == 0, F.concat(F.lit("- "), "body")).otherwise(F.col("body"))
    words = lines.select("doc_id", "line", F.posexplode(F.split(marked, " ")).alias("w", "text"))
    row = F.col("line") % 50
    heading = F.col("line") % 7 == 0
    top = (row * 14 + F.floor(row / 5) * 20 + F.col("w") % 3).cast("double")
    size = F.when(heading, 14.0).otherwise(11.0)
    return words.filter(F.col("text") != "").select(
        "doc_id", (F.floor(F.col("line") / 50) + 1).alias("page"),
        (F.col("line").cast("bigint") * 1_000_000 + F.col("w")).alias("word_no"), "text",
        (F.col("w") * 10).cast("double").alias("x0"), top.alias("top"),
        (F.col("w") * 10 + 8).cast("double").alias("x1"), (top + size).alias("bottom"),
        F.when(heading, "Serif-Bold").otherwise("Serif").alias("fontname"), size.alias("size"))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    parts = table(spark, sf_dir, "embeddings").select(
        "label", F.posexplode("embedding").alias("at", "value"))
    means = parts.groupBy("label", "at").agg(F.avg("value").alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "mean")))
    return means.groupBy("label").agg(
        F.transform(ordered, lambda p: p["mean"]).alias("embedding")).select(
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("query_id"), "embedding")


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up outcomes of every configuration for every question."""
    from ..operators.evaluation import AXES, config_matrix
    configs = config_matrix(spark).collect()
    listed = F.array(*[F.struct(F.lit(c.config_no).alias("config_no"), *[
        F.lit(c[a]).alias(a) for a in AXES]) for c in configs])
    n = (F.length("text") + F.col("config_no")).cast("bigint")
    rows = fixture(spark, sf_dir, "fx_questions").select(
        "query_id", "text", "scope", F.inline(listed)).withColumn("n", n)
    inside, full = F.col("scope") == "in", F.col("config_no") % 6 == 0
    hit = F.when(inside & full, n % 3 + 1).when(inside & (n % 4 < 3), n % 4 + 1)
    refused = n % 5 == 0
    judged = inside & ~refused & (n % 7 != 0)
    return rows.filter(inside | (F.col("config_no") != 36)).select(
        "config_no", *AXES, "query_id", "scope", hit.alias("hit_rank"),
        F.when(hit.isNotNull(), 1).otherwise(0).cast("bigint").alias("recall"),
        F.coalesce(1.0 / hit, F.lit(0.0)).alias("mrr"), refused.alias("refused"),
        F.when(judged, F.lit(5)).cast("bigint").alias("faithfulness"),
        F.when(judged, n % 3 + 3).alias("relevance"),
        F.when(judged, n % 5 + 1).alias("completeness"))
