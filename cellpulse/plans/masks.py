"""Activity of a device at a station as bit masks over runs of buckets.

A run is `RUN` consecutive buckets; bit i of a mask stands for bucket
run*RUN + i + 1. Comparing two stations bucket by bucket then is one bitwise
AND, and a row stands for a whole run instead of one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = 16


def run_of(t: Column) -> Column:
    return F.call_function("div", t - 1, F.lit(RUN)).cast("int")


def _range_mask(first: Column, last: Column, run: Column) -> Column:
    """Bits of the run that lie in [first, last]."""
    base = run * RUN + 1
    low = F.greatest(first, base) - base
    length = F.least(last, base + (RUN - 1)) - base - low + 1
    ones = F.call_function("shiftleft", F.lit(1).cast("bigint"), length) - 1
    return F.when(length > 0, F.call_function("shiftleft", ones, low)).otherwise(
        F.lit(0).cast("bigint")
    )


def masks_of_ranges(ranges: DataFrame) -> DataFrame:
    """Masks from active ranges `bs, imsi, t0, t1`: `bs, imsi, run, now, prev`.

    `now` marks the buckets in a range, `prev` those whose bucket before is in one.
    """
    runs = ranges.withColumn(
        "run", F.explode(F.sequence(run_of(F.col("t0")), run_of(F.col("t1") + 1)))
    )
    t0, t1, run = F.col("t0"), F.col("t1"), F.col("run")
    return runs.groupBy("bs", "imsi", "run").agg(
        F.bit_or(_range_mask(t0, t1, run)).alias("now"),
        F.bit_or(_range_mask(t0 + 1, t1 + 1, run)).alias("prev"),
    )


def masks_of_buckets(buckets: DataFrame) -> DataFrame:
    """Masks from rows `bs, imsi, t`; repeated rows count once."""
    ranges = buckets.select("bs", "imsi", F.col("t").alias("t0"), F.col("t").alias("t1"))
    return masks_of_ranges(ranges)


def moving_only(masks: DataFrame) -> DataFrame:
    """Drop devices seen at a single station in a run; they cannot flow between two."""
    together = Window.partitionBy("imsi", "run")
    seen = masks.withColumn("_lo", F.min("bs").over(together)).withColumn(
        "_hi", F.max("bs").over(together)
    )
    return seen.where(F.col("_lo") != F.col("_hi")).drop("_lo", "_hi")


def bit_sums(columns: list[str]) -> list[Column]:
    """One sum per bit of each mask column, named `<column>_<bit>`."""
    return [
        F.expr(f"sum((shiftright({c}, {i}) & 1)) AS {c}_{i}") for c in columns for i in range(RUN)
    ]


def sums_of_bit_sums(columns: list[str]) -> list[Column]:
    return [F.expr(f"sum({c}_{i}) AS {c}_{i}") for c in columns for i in range(RUN)]


def per_bucket(sums: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows `<keys>, t, <columns>` from bit sums per run."""
    buckets = ", ".join(
        f"named_struct('t', run * {RUN} + {i + 1}"
        + "".join(f", '{c}', {c}_{i}" for c in columns)
        + ")"
        for i in range(RUN)
    )
    return sums.select(*keys, F.expr(f"inline(array({buckets}))"))


def bit_counts(masks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For every key and bucket, how many rows have its bit set: `<keys>, t, <columns>`.

    Each bit is its own sum, so rows combine before the shuffle.
    """
    counted = masks.groupBy(*keys, "run").agg(*bit_sums(columns))
    return per_bucket(counted, keys, columns)
