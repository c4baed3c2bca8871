"""Question/answer rows out of sheets: roles, section markers, metadata."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..sources.cells import cell_at
from .ordered import BLOCK, block_scan


def is_section_marker(question, answer, context, metadata) -> Column:
    """A short label standing alone in the question column."""
    q = text.col(question)
    return ((q != "") & (text.col(answer) == "") & (text.col(context) == "")
            & (F.size(text.drop_empty(metadata)) == 0)
            & ~text.ends_with_question_mark(q) & text.word_count(q).between(1, 4))


def role_rows(grid: DataFrame, configs: DataFrame) -> DataFrame:
    """Cells picked by role below the header; rows without a question are left out."""
    def role(name):
        return cell_at("cells", F.try_element_at(F.col("columns"), F.lit(name)))

    def field(name):
        return cell_at("cells", F.try_element_at(F.col("columns"), name))

    metadata = F.map_from_arrays("metadata_fields", F.transform("metadata_fields", field))
    joined = grid.join(configs.drop("ignore"), ["source_file", "sheet"]).filter(
        F.col("row_no") > F.col("header_row"))
    return joined.select(
        "source_file", "sheet", "row_no", role("question").alias("question"),
        role("answer").alias("answer"), role("context").alias("context"),
        text.drop_empty(metadata).alias("metadata"), "client", "date",
    ).filter(F.col("question") != "")


def fill_sections(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Give each row the label of the last marker row above it, then drop markers.

    ``row_index`` numbers the remaining rows of each file from 0.
    """
    marked = rows.withColumn(
        "is_marker", is_section_marker("question", "answer", "context", "metadata"))
    label = F.when(F.col("is_marker"), F.col("question"))
    filled = block_scan(marked, ["source_file", "sheet"], "row_no", {"section": label},
                        {"row_index": ~F.col("is_marker")}, block)
    return filled.filter(~F.col("is_marker")).drop("is_marker")


def row_metadata(metadata, section, client, date) -> Column:
    """Column values, then an inferred section if none is given, then client and date."""
    own = text.col(metadata)
    inferred = F.when(~F.map_contains_key(own, F.lit("section")), text.col(section))
    added = text.drop_empty(F.create_map(
        F.lit("section"), inferred, F.lit("client"), text.col(client),
        F.lit("date"), text.col(date)))
    kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(added, k))
    return F.map_concat(kept, added)


def load_rows(grid: DataFrame, configs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Q&A rows of every configured file."""
    rows = fill_sections(role_rows(grid, configs), block)
    return rows.select(
        "question", "answer", F.nullif("context", F.lit("")).alias("context"),
        row_metadata("metadata", "section", "client", "date").alias("metadata"),
        F.lit("excel").alias("source_format"), "source_file",
        text.pair_id("source_file", "row_no").alias("pair_id"), "row_no", "row_index")


def file_summary(rows: DataFrame) -> DataFrame:
    """Rows, empty answers, rows with context and with section, per file and in total."""
    return rows.rollup("source_file").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("answer") == "").alias("empty_answers"),
        F.count_if(F.coalesce("context", F.lit("")) != "").alias("with_context"),
        F.count_if(F.coalesce(F.try_element_at("metadata", F.lit("section")), F.lit("")) != "")
        .alias("with_section"),
    ).withColumn("source_file", F.coalesce("source_file", F.lit("TOTAL")))
