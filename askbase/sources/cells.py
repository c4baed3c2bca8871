"""Sheets as tables: one row per cell, or one row per sheet row with a cell map."""

from pyspark.sql import DataFrame, functions as F

from ..functions import text

SHEET_KEYS = ("source_file", "sheet", "row_no")


def _letters(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c.isalpha() and c.isupper()]


def cells_from_wide(wide: DataFrame) -> DataFrame:
    """Columns named by spreadsheet letter to one row per cell."""
    letters = _letters(wide)
    keys = [c for c in wide.columns if c not in letters]
    clean = wide.select(*keys, *[text.cell_text(c).alias(c) for c in letters])
    return (clean.unpivot(keys, letters, "col_letter", "value")
            .withColumn("col_no", text.column_index("col_letter")))


def grid_from_wide(wide: DataFrame) -> DataFrame:
    """One row per sheet row with ``cells`` letter -> text; no shuffle."""
    pairs = [x for c in _letters(wide) for x in (F.lit(c), text.cell_text(c))]
    return wide.select(*SHEET_KEYS, F.create_map(*pairs).alias("cells"))


def grid_from_cells(cells: DataFrame) -> DataFrame:
    """The same from long cells; one shuffle on (file, sheet, row)."""
    entries = F.collect_list(F.struct("col_letter", text.cell_text("value").alias("value")))
    return cells.groupBy(*SHEET_KEYS).agg(F.map_from_entries(entries).alias("cells"))


def cell_at(cells, letter):
    """Cell text by letter; '' when the letter is outside the row."""
    return F.coalesce(F.try_element_at(text.col(cells), text.col(letter)), F.lit(""))


def header_row_check(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Is 1 <= header_row <= last row, and how many data rows follow?"""
    last = cells.groupBy("source_file", "sheet").agg(F.max("row_no").alias("max_row"))
    joined = headers.join(last, ["source_file", "sheet"], "left")
    max_row = F.coalesce("max_row", F.lit(0))
    return joined.select(
        "source_file", "sheet", "header_row", max_row.alias("max_row"),
        ((F.col("header_row") >= 1) & (F.col("header_row") <= max_row)).alias("valid"),
        F.greatest(max_row - F.col("header_row"), F.lit(0)).alias("n_data_rows"))


def require_valid_headers(cells: DataFrame, headers: DataFrame) -> None:
    bad = header_row_check(cells, headers).filter(~F.col("valid")).take(5)
    if bad:
        raise ValueError("header_row out of range: " + ", ".join(
            f"{r.source_file}/{r.sheet}={r.header_row} (1..{r.max_row})" for r in bad))
