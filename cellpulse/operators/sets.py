"""Sets of devices per station and bucket: exact ones as bitmaps, approximate ones as sketches.

A set is kept as bitmaps of 32,768 devices each, so sets of a station are united, and
their common and different devices counted, without the devices themselves; sketches have a
fixed size and an error, and unite in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions.timegrid import Grid
from cellpulse.operators.load import placed
from cellpulse.plans.bounded import landed

# Sketches of 2^12 registers have a standard error of 1.04 / 2^6 = 1.6 %.
SKETCH_BITS = 12
STANDARD_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def numbered_devices(records: DataFrame) -> DataFrame:
    """Devices with numbers that lie close together: `imsi, device`; a missing id is one device.

    Written once. Numbers run on inside a partition, so a bitmap is filled before the next begins.
    """
    devices = records.select("imsi").distinct()
    return landed(devices.withColumn("device", F.monotonically_increasing_id()), "device-numbers")


def device_sets(records: DataFrame, grid: Grid, devices: DataFrame) -> DataFrame:
    """Bitmaps of the devices of every station and bucket: `bs, t, part, devices`.

    Records become one row per device and bucket before they meet the numbers; the
    bitmaps are filled before the shuffle.
    """
    rows = placed(records, grid).select("bs", "t", "imsi").distinct()
    known = devices.select(F.col("imsi").alias("_imsi"), "device")
    numbered = rows.join(known, F.col("imsi").eqNullSafe(F.col("_imsi")))
    return numbered.groupBy("bs", "t", F.bitmap_bucket_number("device").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("device")).alias("devices")
    )


def united_sets(sets: DataFrame, keys: list) -> DataFrame:
    """Sets united over everything but `keys` (columns or names): `<keys>, part, devices`."""
    return sets.groupBy(*keys, "part").agg(F.bitmap_or_agg("devices").alias("devices"))


def set_sizes(sets: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Devices of each set: `<keys>, <out>`."""
    return sets.groupBy(*keys).agg(F.sum(F.bitmap_count("devices")).cast("bigint").alias(out))


def set_steps(sets: DataFrame) -> DataFrame:
    """Each set against the station's set before: `bs, t, devices, before, both, either, arrived, left`.

    `both` counts the devices of the two sets' intersection, `either` those of their union,
    `arrived` and `left` their differences. The set before is that of the last bucket with a
    record; a station's first bucket has none before it, and its devices count as arrived. Give `sets` as a computed
    table. A bitmap goes to its own bucket and to the next one; the pairs unite before the shuffle.
    """
    steps = sets.select("bs", "t").distinct()
    follows = F.lead("t").over(Window.partitionBy("bs").orderBy("t"))
    # One row per station and bucket.
    at = sets.join(steps.withColumn("_next", follows), ["bs", "t"])
    ways = F.array(
        F.struct(F.col("t").alias("at"), F.lit(1).alias("own")), F.struct(F.col("_next").alias("at"), F.lit(0).alias("own"))
    )
    pairs = at.select("bs", "part", "devices", F.inline(ways)).where(F.col("at").isNotNull())
    own: Column = F.col("own") == 1
    counted = pairs.groupBy("bs", "at", "part").agg(
        F.bitmap_count(F.bitmap_or_agg("devices")).alias("either"),
        F.sum(F.when(own, F.bitmap_count("devices")).otherwise(0)).alias("devices"),
        F.sum(F.when(~own, F.bitmap_count("devices")).otherwise(0)).alias("before"),
    )
    sums = counted.groupBy("bs", F.col("at").alias("t")).agg(
        *(F.sum(c).cast("bigint").alias(c) for c in ("devices", "before", "either"))
    )
    return sums.select(
        "bs", "t", "devices", "before",
        (F.col("devices") + F.col("before") - F.col("either")).alias("both"), "either",
        (F.col("either") - F.col("before")).alias("arrived"), (F.col("either") - F.col("devices")).alias("left"),
    )


def device_sketches(records: DataFrame, grid: Grid) -> DataFrame:
    """Sketches of the devices of every station and bucket: `bs, t, sketch`; land them to unite them later.

    A record is read once and goes into its sketch before the shuffle; nothing is kept per device.
    A missing id is one device.
    """
    rows = placed(records, grid)
    device = F.coalesce(F.col("imsi").cast("string"), F.lit(""))
    return rows.groupBy("bs", "t").agg(F.hll_sketch_agg(device, SKETCH_BITS).alias("sketch"))


def estimated_devices(sketches: DataFrame, keys: list) -> DataFrame:
    """Estimated distinct devices over everything but `keys`: `<keys>, devices`."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("devices"))
