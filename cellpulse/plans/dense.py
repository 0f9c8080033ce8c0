"""Zero-filled (station, bucket) grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.functions.timegrid import Grid


def all_buckets(keys: DataFrame, grid: Grid) -> DataFrame:
    """One row per key row and bucket of the grid."""
    return keys.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(grid.n))))


def zero_filled(
    values: DataFrame, keys: DataFrame, grid: Grid, columns: list[str], by: str = "bs"
) -> DataFrame:
    """`values` per (key, t) on the whole grid, 0 where there is no row."""
    base = all_buckets(keys.select(by).distinct(), grid)
    return base.join(values.select(by, "t", *columns), [by, "t"], "left").select(
        by, "t", *(F.coalesce(c, F.lit(0)).alias(c) for c in columns)
    )


def zero_filled_times(values: DataFrame, grid: Grid, columns: list[str]) -> DataFrame:
    """`values` per t on the whole grid, 0 where there is no row."""
    spark = values.sparkSession
    base = spark.range(1, grid.n + 1).select(F.col("id").cast("int").alias("t"))
    return base.join(values.select("t", *columns), "t", "left").select(
        "t", *(F.coalesce(c, F.lit(0)).alias(c) for c in columns)
    )
