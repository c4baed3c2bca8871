"""Routing of incoming files to a loader by extension."""

from pyspark.sql import DataFrame, functions as F

from ..functions import text

ROUTES = {".xlsx": "sheet", ".xlsm": "sheet", ".docx": "prose", ".pdf": "prose"}


def route_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """Extension, route and, for unsupported files, the error to report."""
    ext = text.extension(path)
    table = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])
    route = F.coalesce(F.try_element_at(table, ext), F.lit("rejected"))
    error = F.when(route == "rejected", F.concat(
        F.lit("Unsupported file extension '"), ext, F.lit("'. Supported: "),
        F.lit(", ".join(sorted(ROUTES)))))
    return paths.select("*", ext.alias("ext"), route.alias("route"), error.alias("error"))
