"""Reviewer edits, export and the state of runs."""

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from .answers import format_sources

# Headers of the three columns an export adds.
EXPORT_HEADERS = ("Suggested Answer", "Source RFIs", "Confidence")


def apply_edits(answers: DataFrame, edits: DataFrame) -> DataFrame:
    """Merge reviewer decisions; skipping beats a new text.

    ``edits`` has ``answer_no``, ``new_text`` (null: none) and ``skipped``.
    """
    merged = answers.join(edits, "answer_no", "left")
    skipped = F.coalesce("skipped", F.lit(False))
    edited = ~skipped & F.col("new_text").isNotNull()
    keep = [c for c in answers.columns if c not in ("answer", "refused", "status")]
    old = F.col("status") if "status" in answers.columns else F.lit(None).cast("string")
    return merged.select(
        *keep, F.when(edited, F.col("new_text")).otherwise(F.col("answer")).alias("answer"),
        F.when(edited, False).otherwise(F.col("refused")).alias("refused"),
        F.when(skipped, "skipped").when(edited, "edited")
        .otherwise(F.coalesce(old, F.lit("accepted"))).alias("status"),
        (skipped | edited).alias("modified"))


def edit_count(edited: DataFrame) -> DataFrame:
    return edited.agg(F.count_if("modified").alias("n_modified"))


def export_answers(rows: DataFrame, answers: DataFrame, keys=("source_file", "row_no")) -> DataFrame:
    """Source rows with answer, sources and confidence; nothing for skipped ones.

    Of several answers for a row the one of highest ``answer_no`` counts, also if it was skipped, so each
    source row comes out once.
    """
    shown = F.coalesce("status", F.lit("accepted")) != "skipped"
    cells = F.struct(F.when(shown, F.coalesce("answer", F.lit(""))).alias("suggested_answer"),
                     F.when(shown, format_sources("sources")).alias("answer_sources"),
                     F.when(shown, F.round("confidence", 2)).alias("answer_confidence"))
    filled = answers.filter(F.col("row_no").isNotNull()).groupBy(*keys).agg(
        F.max_by(cells, "answer_no").alias("_cells")).select(*keys, "_cells.*")
    return rows.join(filled, list(keys), "left")


def write_export(exported: DataFrame, path: str) -> None:
    named = exported.withColumnsRenamed(dict(zip(
        ("suggested_answer", "answer_sources", "answer_confidence"), EXPORT_HEADERS)))
    named.write.mode("overwrite").option("header", True).csv(path)


def download_name(source_file):
    """'<stem>_answered.xlsx', or a default without an original name."""
    name = text.strip(F.coalesce(text.col(source_file), F.lit("")))
    return F.when(name == "", "output.xlsx").otherwise(
        F.concat(text.stem(name), F.lit("_answered.xlsx")))


def run_totals(answers: DataFrame, *by: str) -> DataFrame:
    refused = F.count_if("refused")
    return answers.groupBy(*by).agg(
        (F.count("*") - refused).alias("answered"), refused.alias("refused"),
        F.count("*").alias("total"))


def review_summary(answers: DataFrame, *by: str) -> DataFrame:
    """Answers per review status; no decision yet counts as pending."""
    status = F.coalesce("status", F.lit("pending"))
    known = ("accepted", "edited", "skipped")
    return answers.groupBy(*by).agg(
        F.count("*").alias("total"), *[F.count_if(status == s).alias(s) for s in known],
        F.count_if(~status.isin(*known)).alias("pending"))


def run_state(events: DataFrame) -> DataFrame:
    """Latest progress of each (run, collection) from its events."""
    progress = F.when(F.col("type") == "progress", F.col("seq"))
    complete = F.when(F.col("type") == "complete", F.col("seq"))
    zero = F.lit(0).cast("bigint")
    folded = events.groupBy("run_id", "collection").agg(
        F.coalesce(F.max_by("batch", progress), zero).alias("batch"),
        F.coalesce(F.max_by("total", progress), zero).alias("total"),
        F.max(F.col("type") == "complete").alias("complete"),
        F.coalesce(F.max_by("chunks", complete), zero).alias("chunks"))
    return folded.withColumn("percent", F.when(F.col("total") > 0, F.round(
        F.lit(100.0) * F.col("batch") / F.col("total"), 0)).otherwise(0.0))
