"""What several operators share: tables, carried rows, bounded broadcasts."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askbase.functions.sizing import shared_dir, stored  # noqa: F401

#: ASCII white space, the only characters that end a word or are stripped from a line.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id where rows are keyed by id: smaller than any other.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))


def raw(text_col: str) -> Column:
    """The text's UTF-8 bytes, null as empty: bytes.lower() and .split() know ASCII only."""
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def with_columns(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """Columns of ``df`` and then ``added``; a column of ``df`` with such a name is replaced."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added],
                     *[c.alias(n) for n, c in added.items()])


def slices(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about ``size`` bytes: what a task holds as Python objects."""
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def map_columns(df: DataFrame, inputs: dict[str, Column], outputs: str,
                fn: Callable[[list[pa.Array]], list[pa.Array]], size: int = 2 << 20) -> DataFrame:
    """Add columns made by ``fn`` from batches of ``inputs``; the other columns pass through.

    ``fn`` is called for one slice of rows, of about ``size`` bytes, after another. Names in ``outputs`` replace columns of ``df`` with these names.
    """
    names = [part.strip().split(" ")[0] for part in _split(outputs)]
    keep = [c for c in df.columns if c not in names]
    held = [f"_in_{i}" for i in range(len(inputs))]
    while set(held) & set(keep):
        held = [f"_{h}" for h in held]
    source = df.select(*[F.col(f"`{c}`") for c in keep],
                       *[c.alias(h) for h, c in zip(held, inputs.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size):
            made = fn([batch.column(len(keep) + i) for i in range(len(held))])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made,
                                             names=keep + names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}"
                        for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields] + [outputs])
    return source.mapInArrow(run, schema)


def skew_join(left: DataFrame, right: DataFrame, key: str, rows: str, heavy: int = 1000) -> DataFrame:
    """Inner join on ``key``; ``right`` has each key once, with the count of its rows in ``left`` in column ``rows``.

    Keys with over 1 / ``heavy`` of all rows of ``left``, fewer than ``heavy`` keys whatever the data, are
    broadcast, so that no task has to take all rows of one key; the others are joined by shuffle.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    often = F.col(rows) * heavy > F.lit(total)
    side = right.drop(rows)
    hot = F.broadcast(right.where(often).drop(rows))
    rest = left.join(F.broadcast(right.where(often).select(key)), key, "left_anti").join(
        right.where(~often).drop(rows), key)
    columns = [key] + [c for c in left.columns if c != key] + [c for c in side.columns if c != key]
    return left.join(hot, key).select(*columns).unionByName(rest.select(*columns))


def _split(outputs: str) -> list[str]:
    """The parts of a schema string at commas outside brackets."""
    parts, depth = [""], 0
    for ch in outputs:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return parts
