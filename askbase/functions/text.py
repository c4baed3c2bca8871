"""Text rules as built-in column expressions (no Python per row)."""

from pyspark.sql import Column, functions as F

from . import vocab

# White space as a full-Unicode class, so that no-break spaces count too.
_SPACE = r"[\s\x1c-\x1f]"
_NOT_SPACE = r"[^\s\x1c-\x1f]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove all leading and trailing white space (``trim`` knows spaces only)."""
    return F.regexp_replace(col(c), f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def cell_text(c) -> Column:
    """A cell as a clean string; an empty cell is ''."""
    return F.coalesce(strip(col(c).cast("string")), F.lit(""))


def words(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(f"(?U){_NOT_SPACE}+"), F.lit(0))


def word_count(c) -> Column:
    return F.size(words(c)).cast("bigint")


def ends_with_question_mark(c) -> Column:
    return col(c).rlike(rf"(?U)\?{_SPACE}*\z")


def tokens(c) -> Column:
    """Lower-case ASCII letter/digit runs."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def token_line(c) -> Column:
    """The tokens joined by single spaces; cheap to send through Arrow."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def basename(c) -> Column:
    return F.regexp_extract(col(c), r"[^/\\]*\z", 0)


def stem(c) -> Column:
    return F.regexp_replace(col(c), r"^(.+)\.[^.]+\z", "$1")


def extension(c) -> Column:
    return F.lower(F.regexp_extract(col(c), r"[^/\\](\.[^./\\]+)\z", 1))


def slug(c) -> Column:
    """File-safe name of a stem; 'untitled' when nothing is left."""
    body = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_")
    body = F.regexp_replace(body, "^_+|_+$", "")
    return F.when(body == "", "untitled").otherwise(body)


def pair_id(source_file, row_no) -> Column:
    return F.concat(slug(stem(source_file)), F.lit("_row_"), col(row_no).cast("string"))


def pair_row(c) -> Column:
    """The sheet row inside a pair id; the whole id if it has none."""
    row = F.regexp_extract(col(c), r"_row_(\d+)$", 1)
    return (F.when(F.coalesce(col(c), F.lit("")) == "", "?")
            .when(row == "", col(c)).otherwise(row))


def _cut(flat: Column, n: int) -> Column:
    return F.when(F.length(flat) <= n, flat).otherwise(
        F.concat(F.substring(flat, 1, n - 1), F.lit("…")))


def shorten_cell(c, n: int = 80) -> Column:
    return _cut(strip(F.translate(col(c), "\n\r", "  ")), n)


def shorten_chunk(c, n: int = 240) -> Column:
    return _cut(strip(F.replace(col(c), F.lit("\n"), F.lit(" | "))), n)


def shorten_hit(c, n: int = 160) -> Column:
    return _cut(F.replace(col(c), F.lit("\n"), F.lit(" | ")), n)


def shorten_candidate(c, n: int = 400) -> Column:
    return F.when(F.length(col(c)) <= n, col(c)).otherwise(
        F.concat(F.substring(col(c), 1, n), F.lit("…")))


def column_index(c) -> Column:
    """Spreadsheet letters to a 1-based index: A=1, Z=26, AA=27."""
    letters = F.regexp_extract_all(F.upper(col(c)), F.lit("[A-Z]"), F.lit(0))
    return F.aggregate(letters, F.lit(0).cast("bigint"),
                       lambda acc, x: acc * 26 + F.ascii(x) - 64)


def column_letter(c) -> Column:
    """1-based index to spreadsheet letters, up to three of them (18,278); more is an error."""
    def letter(n):
        return F.chr((n + 65).cast("int"))

    def div(n, by):
        return F.floor(n / by).cast("bigint")

    one, two, three = col(c) - 1, col(c) - 27, col(c) - 703
    return (F.when(col(c) <= 26, letter(one))
            .when(col(c) <= 702, F.concat(letter(div(two, 26)), letter(two % 26)))
            .when(col(c) <= 18_278, F.concat(letter(div(three, 676)), letter(div(three, 26) % 26),
                                             letter(three % 26)))
            .when(col(c).isNotNull(), F.raise_error("no column beyond ZZZ").cast("string")))


def header_label(c) -> Column:
    """Header form used to look a label up: lower, stripped, no trailing colons."""
    return strip(F.regexp_replace(strip(F.lower(col(c))), ":+$", ""))


def is_list_marker(c) -> Column:
    return F.coalesce(col(c).rlike(vocab.LIST_MARKER), F.lit(False))


def is_bold_font(c) -> Column:
    return F.coalesce(col(c).rlike(vocab.BOLD_FONT), F.lit(False))


def says_refusal(c) -> Column:
    """The answer contains the refusal phrase, in any case."""
    return F.coalesce(F.lower(col(c)).contains(vocab.REFUSAL_PHRASE), F.lit(False))


def is_refusal(c) -> Column:
    """The answer is the refusal sentence and nothing else."""
    return F.coalesce(strip(c) == vocab.REFUSAL_TEXT, F.lit(False))


def drop_empty(c) -> Column:
    """A metadata map without null or '' values."""
    return F.map_filter(col(c), lambda k, v: v.isNotNull() & (v != ""))


def valid_role(c) -> Column:
    return col(c).isin(*vocab.RESERVED_ROLES) | col(c).rlike(vocab.ROLE_NAME)


def safe_file_name(c) -> Column:
    return (F.coalesce(col(c), F.lit("")) != "") & ~col(c).rlike(r"[/\\]")
