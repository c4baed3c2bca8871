"""Ordered operators that stay parallel inside one very large group.

A window over a whole group sorts that group in one task. Here the order
column is cut into blocks: the window runs inside a block, one summary row per
block carries state across blocks, and a join brings it back. Only summaries
(rows / ``block``) meet in one task.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 65_536


def block_scan(df: DataFrame, keys: list[str], order: str, carried: dict[str, Column],
               counted: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Add running columns per ``keys`` in ``order``.

    ``carried``: last non-null value at or before the row.
    ``counted``: number of earlier rows for which the condition holds.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    rows = rows.withColumns({f"_v_{n}": v for n, v in carried.items()}
                            | {f"_c_{n}": c.cast("bigint") for n, c in counted.items()})
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (Window.partitionBy(*keys).orderBy("_block")
              .rowsBetween(Window.unboundedPreceding, -1))

    tails = [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order)))
             .alias(f"_t_{n}") for n in carried]
    sums = [F.sum(f"_c_{n}").alias(f"_t_{n}") for n in counted]
    before = rows.groupBy(*keys, "_block").agg(*tails, *sums).select(
        *keys, "_block",
        *[F.last(f"_t_{n}", ignorenulls=True).over(blocks).alias(f"_b_{n}") for n in carried],
        *[F.coalesce(F.sum(f"_t_{n}").over(blocks), F.lit(0)).alias(f"_b_{n}") for n in counted])

    here = {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in carried}
    here |= {f"_l_{n}": F.coalesce(F.sum(f"_c_{n}").over(earlier), F.lit(0)) for n in counted}
    joined = rows.withColumns(here).join(before, [*keys, "_block"])
    return joined.select(
        *df.columns, *[F.coalesce(f"_l_{n}", f"_b_{n}").alias(n) for n in carried],
        *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in counted])


def carry_forward(df: DataFrame, keys: list[str], order: str, value: Column,
                  out: str, block: int = BLOCK) -> DataFrame:
    """Last non-null ``value`` at or before each row, per ``keys``."""
    return block_scan(df, keys, order, {out: value}, {}, block)


def running_index(df: DataFrame, keys: list[str], order: str, out: str,
                  block: int = BLOCK) -> DataFrame:
    """Dense 0-based position of each row in ``order``, per ``keys``."""
    return block_scan(df, keys, order, {}, {out: F.lit(True)}, block)
