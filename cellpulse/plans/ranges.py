"""Orders over keys of any size, cut at sampled places.

The rows are written once and a sample of their full order (keys, order, row number) gives
splitters, so a key with a third of all rows lies in many ranges and a range holds about as many
rows as any other, however the times of a key lie. One shuffle brings a range together;
what earlier ranges hold of a key is needed only for the keys that a splitter cuts, at most
one per splitter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.plans.bounded import landed

SAMPLE_PER_RANGE = 32


def _splitters(rows: DataFrame, full: list[str], ranges: int) -> list:
    """Quantiles of a sample of about SAMPLE_PER_RANGE rows a range, in Spark's own order."""
    fraction = min(1.0, ranges * SAMPLE_PER_RANGE / max(1, rows.count()))
    low = F.xxhash64("_row").bitwiseAND(F.lit((1 << 32) - 1))
    drawn = rows.where(low <= int(fraction * 2**32)).select(*full).orderBy(*full).collect()
    at = sorted({len(drawn) * k // ranges for k in range(1, ranges)})
    return [drawn[i] for i in at if i < len(drawn)]


def _reached(place: Column, splitters: Column, size: int) -> Column:
    """How many of the ascending splitters are not behind a place, by binary search."""
    steps = [1 << k for k in reversed(range(size.bit_length()))]

    def step(at: Column, width: Column) -> Column:
        behind = F.get(splitters, at + width - 1) <= place
        return F.when((at + width <= size) & behind, at + width).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step) if size else F.lit(0)


def position_by_ranges(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """`row_number()` per key in the given order; rows that tie are numbered as they lie in `df`.

    `df` is computed once, into the shared folder.
    """
    spark = df.sparkSession
    rows = landed(df.withColumn("_row", F.monotonically_increasing_id()), "ordered-rows")
    full = [*keys, *order, "_row"]
    splitters = _splitters(rows, full, int(spark.conf.get("spark.sql.shuffle.partitions")))
    inside = Window.partitionBy("_range", *keys).orderBy(*order, "_row")
    if not splitters:
        numbered = rows.withColumn("_range", F.lit(0)).withColumn(out, F.row_number().over(inside))
        return numbered.drop("_range", "_row").withColumn(out, F.col(out).cast("bigint"))
    schema = rows.select(*full).schema
    cuts = spark.createDataFrame(splitters, schema)
    # One row, as long as there are shuffle partitions.
    table = cuts.agg(F.sort_array(F.collect_list(F.struct(*full))).alias("_splitters"))
    place = F.struct(*full)
    cut = rows.crossJoin(F.broadcast(table)).withColumn(
        "_range", _reached(place, F.col("_splitters"), len(splitters))
    ).drop("_splitters")
    # Only keys that a splitter cuts lie in more than one range: at most two rows per splitter.
    split = cuts.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys))).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    held = (
        cut.select("_range", *keys).join(F.broadcast(split), same, "left_semi")
        .groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(
        F.col("_range").alias("_at"), *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)),
        F.sum("_n").over(earlier).alias("_before"),
    ).where(F.col("_before") > 0)
    numbered = cut.withColumn("_place", F.row_number().over(inside))
    return (
        numbered.join(F.broadcast(before), [F.col("_range") == F.col("_at"), *same], "left")
        .withColumn(out, F.col("_place") + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, out)
    )
