"""File configs: which column plays which role, and who the file came from."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text

CONFIG_SCHEMA = ("source_file string, sheet string, header_row bigint, "
                 "columns map<string,string>, ignore array<string>, "
                 "metadata_fields array<string>, client string, date string")


def by_column_order(items: Column) -> Column:
    """Sort structs that have a ``col_letter`` in spreadsheet order: A..Z, AA.."""
    def before(a, b):
        x = F.struct(F.length(a.col_letter), a.col_letter)
        y = F.struct(F.length(b.col_letter), b.col_letter)
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.array_sort(items, before)


def normalize_mapping(mapping: DataFrame) -> DataFrame:
    """Letters upper-case, roles lower-case, both stripped."""
    return (mapping.withColumn("col_letter", F.upper(text.strip("col_letter")))
            .withColumn("role", F.lower(text.strip("role"))))


def normalize_files(files: DataFrame) -> DataFrame:
    """'' as client or date means unknown."""
    return (files.withColumn("client", F.nullif("client", F.lit("")))
            .withColumn("date", F.nullif("date", F.lit(""))))


def edited(old, edit) -> Column:
    """Null edit keeps the value, '' clears it, anything else replaces it."""
    return F.when(text.col(edit).isNull(), text.col(old)).otherwise(
        F.nullif(text.col(edit), F.lit("")))


def build_configs(mapping: DataFrame, files: DataFrame) -> DataFrame:
    """One config row per file from an approved column mapping."""
    roles = by_column_order(F.collect_list(F.struct("col_letter", "role")))
    named = F.filter("_roles", lambda r: r.role != "ignore")
    special = ("question", "answer", "context")
    packed = mapping.groupBy("source_file").agg(roles.alias("_roles")).select(
        "source_file",
        F.map_from_entries(F.transform(named, lambda r: F.struct(r.role, r.col_letter)))
        .alias("columns"),
        F.transform(F.filter("_roles", lambda r: r.role == "ignore"),
                    lambda r: r.col_letter).alias("ignore"),
        F.transform(F.filter(named, lambda r: ~r.role.isin(*special)),
                    lambda r: r.role).alias("metadata_fields"))
    return files.join(packed, "source_file").select(
        "source_file", "sheet", "header_row", "columns", "ignore", "metadata_fields",
        "client", "date")


def write_configs(configs: DataFrame, path: str) -> None:
    """One JSON document for each config; ignored columns are a list inside ``columns``."""
    roles = F.expr("left(to_json(columns), length(to_json(columns)) - 1)")
    ignored = F.to_json(F.coalesce("ignore", F.array().cast("array<string>")))
    columns = F.when(F.col("columns").isNull(), F.lit("null")).otherwise(F.concat(
        roles, F.when(F.size(F.map_keys("columns")) > 0, F.lit(",")).otherwise(F.lit("")),
        F.lit('"ignore":'), ignored, F.lit("}")))
    rest = F.to_json(F.struct("source_file", "sheet", "header_row", "metadata_fields", "client", "date"))
    body = F.concat(F.expr("left(rest, length(rest) - 1)"), F.lit(',"columns":'), F.col("cols"), F.lit("}"))
    ready = configs.select(F.base64(F.encode("source_file", "utf-8")).alias("name"), rest.alias("rest"),
                           columns.alias("cols"))
    named = F.translate("name", "/+=\n\r", "_-")
    (ready.select(named.alias("config"), body.alias("value"))
     .write.mode("overwrite").partitionBy("config").text(path))


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Configs from JSON documents, one for each file of a folder and its subfolders.

    The list of ignored columns is taken out of ``columns``. A file that is not
    such a document stops the read.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    parsed = files.select(F.from_json("value", CONFIG_SCHEMA, {"mode": "FAILFAST"}).alias("c"),
                          "value").select("c.*", "value")
    inside = F.from_json(F.try_element_at("columns", F.lit("ignore")), "array<string>")
    broken = F.col("source_file").isNull() & F.col("columns").isNull()
    checked = F.when(broken, F.raise_error(F.concat(F.lit("not a config: "), F.left("value", F.lit(80))))
                     .cast("string")).otherwise(F.col("source_file"))
    return parsed.select(
        checked.alias("source_file"), "sheet", "header_row",
        F.map_filter("columns", lambda k, _: k != "ignore").alias("columns"),
        F.coalesce(inside, F.col("ignore")).alias("ignore"), "metadata_fields", "client", "date")


def config_problems(configs: DataFrame, basename: str | None = None) -> DataFrame:
    """One row per config with the list of what makes it unusable."""
    required = [F.when(F.col(c).isNull(), F.lit(c))
                for c in ("columns", "header_row", "sheet", "source_file")]
    missing = F.array_compact(F.array(*required))
    has = F.coalesce(F.map_keys("columns"), F.array().cast("array<string>"))
    roles = F.array_except(F.array(F.lit("question"), F.lit("answer")), has)
    wrong_file = F.lit(False)
    if basename:
        wrong_file = F.coalesce(F.col(basename) != F.col("source_file"), F.lit(False))
    problems = F.concat(
        F.transform(missing, lambda m: F.concat(F.lit("missing field "), m)),
        F.when(F.col("columns").isNull(), F.array().cast("array<string>")).otherwise(
            F.transform(roles, lambda r: F.concat(F.lit("missing role "), r))),
        F.when(wrong_file, F.array(F.lit("file name does not match")))
        .otherwise(F.array().cast("array<string>")))
    return configs.withColumn("problems", problems)


def require_valid_configs(configs: DataFrame) -> None:
    bad = config_problems(configs).filter(F.size("problems") > 0).take(5)
    if bad:
        raise ValueError("unusable configs: " + "; ".join(
            f"{r.source_file}: {', '.join(r.problems)}" for r in bad))


def known_clients(files: DataFrame) -> DataFrame:
    """Distinct client names that are not blank."""
    name = text.strip("client")
    return files.select(name.alias("client")).filter(
        F.coalesce("client", F.lit("")) != "").distinct()
