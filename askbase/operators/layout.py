"""Lines and paragraphs from positioned words of pages."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from .ordered import running_index

# Distances in points.
LINE_TOLERANCE = 2.5
PARAGRAPH_GAP = 1.4
SIZE_STEP = 1.0
BOX_PADDING = 2.0
DEFAULT_LINE_HEIGHT = 12.0

PAGE = ["doc_id", "page"]
LINE = [*PAGE, "line_top"]


def assign_lines(words: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Add ``line_top``: the anchor of the line each word belongs to.

    A word joins the current line while it is within ``tolerance`` of the
    line's first top. Only the distinct tops of a page decide, so words are
    gathered by top, and a page is cut wherever two tops are further apart than
    the tolerance, since a line always starts there. The anchors are then found
    by a fold over each short stretch, beside the words. There is no join: every step groups
    by page and more, so words that come dealt by document or page are not shuffled at all.
    """
    rest = [c for c in words.columns if c not in PAGE]
    found = words.where(F.col("doc_id").isNotNull() & F.col("page").isNotNull() & F.col("top").isNotNull())
    tops = found.groupBy(*PAGE, F.col("top").alias("_top")).agg(F.collect_list(F.struct(*rest)).alias("_words"))
    down = Window.partitionBy(*PAGE).orderBy("_top")
    starts = F.coalesce(F.col("_top") - F.lag("_top").over(down) > tolerance, F.lit(True))
    stretch = tops.withColumn("_new", starts.cast("int")).withColumn(
        "_stretch", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = stretch.groupBy(*PAGE, "_stretch").agg(
        F.array_sort(F.collect_list(F.struct("_top", "_words")), lambda a, b: F.when(a["_top"] < b["_top"], -1)
                     .when(a["_top"] > b["_top"], 1).otherwise(0)).alias("tops"))

    def step(done, top):
        last = F.try_element_at(done, F.lit(-1))
        line = F.when(top - last <= tolerance, last).otherwise(top)
        return F.concat(done, F.array(line))

    anchors = F.aggregate(F.transform("tops", lambda t: t["_top"]), F.array().cast("array<double>"), step)
    lines = ordered.select(*PAGE, F.explode(F.arrays_zip(F.col("tops"), anchors.alias("anchors"))).alias("t"))
    each = lines.select(*PAGE, F.col("t.anchors").alias("line_top"), F.explode("t.tops._words").alias("w"))
    return each.select(*[F.col(c) if c in PAGE else F.col(f"w.{c}") for c in words.columns], "line_top")


def _modal(words: DataFrame, keys: list[str], weight) -> DataFrame:
    """Most frequent rounded size; of equals the larger."""
    sizes = words.filter(F.col("size").isNotNull()).groupBy(
        *keys, F.round("size", 1).alias("size")).agg(F.sum(weight).alias("n"))
    return sizes.filter(F.col("n") > 0).groupBy(*keys).agg(
        F.max_by("size", F.struct("n", "size")).alias("modal_size"))


def modal_size(words: DataFrame, *keys: str) -> DataFrame:
    return _modal(words, list(keys), F.lit(1))


def _heaviest(groups, name: str, weight: str, *ties):
    """Value of ``name`` with the largest summed weight in an array of groups.

    The array holds one struct per font and size of a line, so it is short.
    """
    def total(value):
        same = F.filter(groups, lambda g: g[name] == value)
        return F.aggregate(same, F.lit(0).cast("bigint"), lambda n, g: n + g[weight])

    def first(value):
        seen = F.array_min(F.transform(F.filter(groups, lambda g: (g[name] == value) & (g.n > 0)),
                                       lambda g: g.seen))
        return [-seen.x0, -seen.top, -seen.word_no]

    values = F.array_distinct(F.transform(F.filter(
        groups, lambda g: g[name].isNotNull() & (g[weight] > 0)), lambda g: g[name]))
    ranked = F.transform(values, lambda v: F.struct(
        total(v).alias("n"), *([x.alias(f"t{i}") for i, x in enumerate(first(v))] if ties else []),
        v.alias("v")))
    return F.array_max(ranked).v


def line_table(lined: DataFrame) -> DataFrame:
    """Signature of each line plus its word counts per size, in one pass over the words."""
    chars = F.length("text")
    left = F.struct("x0", "top", "word_no")
    font = F.coalesce("fontname", F.lit(""))
    groups = lined.groupBy(*LINE, font.alias("font"), F.round("size", 1).alias("size")).agg(
        F.sum(chars).alias("n"), F.count("*").alias("words"),
        F.min(F.when(chars > 0, left)).alias("seen"), F.min("x0").alias("x0"),
        F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
        F.max(F.col("bottom") - F.col("top")).alias("height"),
        F.min_by(F.struct(left.alias("at"), "text"), left).alias("first"),
        F.collect_list(F.struct("x0", "top", "word_no", "text")).alias("placed"))
    lines = groups.groupBy(*LINE).agg(
        F.collect_list(F.struct("font", "size", "n", "words", "seen")).alias("groups"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"),
        F.max("bottom").alias("bottom"), F.max("height").alias("line_height"),
        (F.sum(F.when(text.is_bold_font("font"), F.col("n")).otherwise(0)) * 2
         > F.sum("n")).alias("is_bold"),
        F.sum(F.when(text.is_bold_font("font"), F.col("words")).otherwise(0)).alias("bold_words"),
        F.sum("words").alias("words"), F.flatten(F.collect_list("placed")).alias("placed"),
        F.min_by("first.text", F.col("first.at")).alias("first_word"))
    return lines.select(
        *LINE, "x0", "x1", "top", "bottom", "line_height", "is_bold", "bold_words", "words",
        _heaviest(F.col("groups"), "font", "n", "seen").alias("font"),
        _heaviest(F.col("groups"), "size", "n").alias("modal_size"),
        F.transform("groups", lambda g: F.struct(g["size"].alias("size"), g["words"].alias("words"),
                                                 g["n"].alias("n"), g["seen"].alias("seen")))
        .alias("sizes"), F.sort_array("placed")["text"].alias("texts"), text.is_list_marker("first_word").alias("starts_item"))


def line_signature(lined: DataFrame) -> DataFrame:
    """Extent, modal size, majority font and boldness of each line.

    Size, font and bold are weighed by characters; of fonts with equal weight
    the one seen first wins, of sizes the larger.
    """
    return line_table(lined).select(*LINE, "top", "bottom", "line_height", "font", "is_bold",
                                    "modal_size", "starts_item")


def paragraph_breaks(lines: DataFrame) -> DataFrame:
    """Number the paragraph of every line of a page, from 1.

    A page holds few lines: anchors are more than the tolerance apart.
    """
    down = Window.partitionBy(*PAGE).orderBy("line_top")

    def prev(c):
        return F.lag(c).over(down)

    height = F.when(F.coalesce("line_height", F.lit(0.0)) == 0, DEFAULT_LINE_HEIGHT).otherwise(
        F.col("line_height"))
    gap = F.col("top") - prev("bottom") > height * PARAGRAPH_GAP
    bold = F.col("is_bold") != prev("is_bold")
    size = F.abs(F.col("modal_size") - prev("modal_size")) >= SIZE_STEP
    font = (F.col("font") != "") & (prev("font") != "") & (F.col("font") != prev("font"))
    starts = F.col("starts_item")
    for signal in (gap, bold, size, font):
        starts = starts | F.coalesce(signal, F.lit(False))
    first = F.row_number().over(down) == 1
    return lines.withColumn("_new", (first | starts).cast("bigint")).withColumn(
        "para_no", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def paragraphs(lined: DataFrame) -> DataFrame:
    """Text and features of each paragraph; white-space-only ones are dropped.

    Both come from the lines, which hold their words' texts in order; the words are read once.
    """
    keys = [*PAGE, "para_no"]
    lines = paragraph_breaks(line_table(lined))
    ordered = F.sort_array(F.collect_list(F.struct("line_top", "texts")))
    found = lines.groupBy(*keys).agg(
        F.flatten(ordered["texts"]).alias("texts"), F.flatten(F.collect_list("sizes")).alias("sizes"),
        (F.sum("bold_words") * 2 > F.sum("words")).alias("is_bold"),
        F.min_by("starts_item", "line_top").alias("has_num_pr"), F.min("x0").alias("x0"),
        F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    return found.withColumn("text", text.strip(F.array_join("texts", " "))).filter(F.col("text") != "").select(
        *keys, "text", "is_bold", "has_num_pr", "x0", "top", "x1", "bottom",
        _heaviest(F.col("sizes"), "size", "words").alias("rendered_size"))


def boxed(paras: DataFrame, boxes: DataFrame, padding: float = BOX_PADDING) -> DataFrame:
    """Add ``in_table``: the paragraph lies inside a box of its page. A page's few boxes are joined as a list."""
    listed = boxes.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "top", "x1", "bottom")).alias("_boxes"))

    def inside(b):
        return ((F.col("x0") >= b["x0"] - padding) & (F.col("top") >= b["top"] - padding)
                & (F.col("x1") <= b["x1"] + padding) & (F.col("bottom") <= b["bottom"] + padding))

    return paras.join(listed, PAGE, "left").withColumn(
        "in_table", F.coalesce(F.exists("_boxes", inside), F.lit(False))).drop("_boxes")


def pair_dates(paras: DataFrame, dates: DataFrame, keys=("doc_id", "table_row")) -> DataFrame:
    """Give the i-th paragraph that is no list item the i-th date of its row."""
    keys = list(keys)
    body = running_index(paras.filter(~F.col("has_num_pr")), keys, "para_no", "_i")
    dated = running_index(dates, keys, "date_no", "_i").select(*keys, "_i", "date")
    with_date = body.join(dated, [*keys, "_i"], "left").drop("_i")
    items = paras.filter(F.col("has_num_pr")).withColumn("date", F.lit(None).cast("string"))
    return with_date.unionByName(items).withColumn("date", F.coalesce("date", F.lit("")))


def drop_spacers(paras: DataFrame) -> DataFrame:
    """Blank paragraphs go, unless they are list items."""
    return paras.filter((text.strip("text") != "") | F.col("has_num_pr"))
