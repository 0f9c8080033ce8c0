"""Window functions over keys that may hold a large share of all rows.

A plain window sends every row of a key to one task. Here each key is cut into
blocks of an ordered number (time, duration). One extra row per block carries
the result of the blocks before it; it sorts first in its block, so the window
inside the block starts from the right value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def block_of(value: Column, width: int) -> Column:
    """Number of the block a value falls into; orders like the value itself."""
    return F.floor(value / F.lit(width)).cast("bigint")


def _in_blocks(
    blocked: DataFrame, carried: DataFrame, keys: list[str], order: list[str]
) -> tuple[DataFrame, WindowSpec]:
    """Rows together with the carried row of each block, and the window inside blocks."""
    rows = blocked.withColumn("_row", F.lit(1)).unionByName(
        carried.withColumn("_row", F.lit(0)), allowMissingColumns=True
    )
    return rows, Window.partitionBy(*keys, "_block").orderBy("_row", *order)


def _rows_only(df: DataFrame, *helpers: str) -> DataFrame:
    return df.where(F.col("_row") == 1).drop("_row", "_block", *helpers)


def _before(keys: list[str]) -> WindowSpec:
    """All blocks of a key before this one."""
    return Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _rank(df: DataFrame, order: list[str], width: int) -> Column:
    """The order inside a block as one value.

    Of two whole numbers it is a decimal (the first counts from the block's begin, so it
    always fits), which aggregates by hash; a struct would be sorted.
    """
    whole = {"tinyint", "smallint", "int", "bigint"}
    kinds = dict(df.dtypes)
    if len(order) != 2 or not {kinds[c] for c in order} <= whole:
        return F.struct(*order)
    past = F.col(order[0]) - F.col("_block") * F.lit(width)
    # A missing second number sorts before all others, as in the window.
    second = F.coalesce(
        F.col(order[1]).cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")
    )
    return past.cast("decimal(18,0)") * F.lit(str(1 << 65)).cast("decimal(20,0)") + second


def lag_by_blocks(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, width: int
) -> DataFrame:
    """`lag(value)` per key in the given order; the first order column sets the block."""
    blocked = df.withColumn("_block", block_of(F.col(order[0]), width))
    across = Window.partitionBy(*keys).orderBy("_block")
    carried = (
        blocked.groupBy(*keys, "_block")
        .agg(F.max_by(value, _rank(df, order, width)).alias("_tail"))
        .select(*keys, "_block", F.lag("_tail").over(across).alias(value))
    )
    rows, inside = _in_blocks(blocked, carried, keys, order)
    return _rows_only(rows.withColumn(out, F.lag(value).over(inside)))


def running_sum_by_blocks(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int
) -> DataFrame:
    """Sum of `value` over the rows of a key up to this one, plus the key total as `<out>_total`.

    `order` holds each number once per key.
    """
    total = f"{out}_total"
    blocked = df.withColumn("_block", block_of(F.col(order), width))
    carried = (
        blocked.groupBy(*keys, "_block")
        .agg(F.sum(value).alias("_sum"))
        .select(
            *keys,
            "_block",
            F.coalesce(F.sum("_sum").over(_before(keys)), F.lit(0)).alias(value),
            F.sum("_sum").over(Window.partitionBy(*keys)).alias(total),
        )
    )
    rows, inside = _in_blocks(blocked, carried, keys, [order])
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn(out, F.sum(value).over(upto)).withColumn(
        total, F.first_value(total).over(upto)
    )
    return _rows_only(summed)
