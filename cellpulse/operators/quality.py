"""Failure rates and uplink block error rates (BLER) over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions.measures import (
    bler_count,
    bler_sum,
    count_where,
    is_attempt,
    is_failure,
    is_release,
    ratio,
)
from cellpulse.functions.timegrid import Grid
from cellpulse.operators.load import mean_over_stations, placed
from cellpulse.plans.dense import zero_filled

SAMPLES = ("ul_init_bler", "ul_res_bler")


def failure_rate(records: DataFrame, grid: Grid, group: DataFrame | None = None) -> DataFrame:
    """Attempts, failed attempts and their ratio: `bs, t, attempts, failures, rate`."""
    attempt = is_attempt(F.col("proc_id"))
    counts = placed(records, grid, group).groupBy("bs", "t").agg(
        count_where(attempt).alias("attempts"),
        count_where(attempt & is_failure(F.col("cfc"))).alias("failures"),
    )
    return counts.withColumn("rate", ratio(F.col("failures"), F.col("attempts")))


def failure_trace(
    records: DataFrame, grid: Grid, group: DataFrame | None = None
) -> DataFrame:
    """Bearer load beside attempts and failures: `bs, t, bearer, attempts, failures, rate`."""
    attempt = is_attempt(F.col("proc_id"))
    per_device = placed(records, grid, group).groupBy("bs", "t", "imsi").agg(
        count_where(is_release(F.col("proc_id"))).alias("releases"),
        count_where(attempt).alias("attempts"),
        count_where(attempt & is_failure(F.col("cfc"))).alias("failures"),
    )
    counts = per_device.groupBy("bs", "t").agg(
        (F.count(F.lit(1)) + F.sum("releases")).alias("bearer"),
        F.sum("attempts").alias("attempts"),
        F.sum("failures").alias("failures"),
    )
    return counts.withColumn("rate", ratio(F.col("failures"), F.col("attempts")))


def rolling_mean(column: str, keys: list[str], samples: int, order: str = "t") -> Column:
    """Mean of the last `samples` rows of a key, null until there are that many."""
    last = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(samples - 1), 0)
    return F.when(F.count(F.lit(1)).over(last) == samples, F.avg(column).over(last))


def failure_rate_rolling(
    rates: DataFrame, stations: DataFrame, grid: Grid, samples: tuple[int, ...] = (3, 5)
) -> DataFrame:
    """Rolling means of the failure rate on the dense grid, 0.0 until there are enough samples."""
    dense = zero_filled(rates, stations, grid, ["rate"])
    return dense.select(
        "bs",
        "t",
        *(
            F.coalesce(rolling_mean("rate", ["bs"], k), F.lit(0.0)).alias(f"rate{k}")
            for k in samples
        ),
    )


def with_bler_sample(records: DataFrame) -> DataFrame:
    """Records with at least one of the two uplink samples."""
    first, second = SAMPLES
    return records.where(F.col(first).isNotNull() | F.col(second).isNotNull())


def bler_mean(records: DataFrame, grid: Grid) -> DataFrame:
    """Mean over stations of the mean over devices of the BLER, as a fraction: `t, bler`.

    Three levels: per device and bucket, per station, per bucket. A station or
    bucket with no samples counts as 0.
    """
    sampled = placed(with_bler_sample(records), grid)
    samples = [F.col(c) for c in SAMPLES]
    per_device = sampled.groupBy("bs", "t", "imsi").agg(
        (F.sum(bler_sum(*samples)) / (100 * F.sum(bler_count(*samples)))).alias("device_bler")
    )
    per_station = per_device.groupBy("bs", "t").agg(F.avg("device_bler").alias("station_bler"))
    return mean_over_stations(per_station, "station_bler", "bler", grid)


def bler_by_bs(records: DataFrame, grid: Grid, group: DataFrame | None = None) -> DataFrame:
    """Bearer load and BLER in percent per station and bucket: `bs, t, bearer, bler`."""
    samples = [F.col(c) for c in SAMPLES]
    per_device = placed(records, grid, group).groupBy("bs", "t", "imsi").agg(
        count_where(is_release(F.col("proc_id"))).alias("releases"),
        F.sum(bler_sum(*samples)).alias("total"),
        F.sum(bler_count(*samples)).alias("samples"),
    )
    per_station = per_device.groupBy("bs", "t").agg(
        (F.count(F.lit(1)) + F.sum("releases")).alias("bearer"),
        F.sum("total").alias("total"),
        F.sum("samples").alias("samples"),
    )
    return per_station.select(
        "bs", "t", "bearer", ratio(F.col("total"), F.col("samples")).alias("bler")
    )
