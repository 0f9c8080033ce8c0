"""Station load: devices and bearers per station and time bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions.geo import distance_km
from cellpulse.functions.measures import count_where, is_release
from cellpulse.functions.timegrid import Grid
from cellpulse.operators.groups import in_group
from cellpulse.plans.bounded import broadcast_if_small, checkpointed
from cellpulse.plans.dense import zero_filled, zero_filled_times

# Points (latitude, longitude) the station distances are measured from.
ORIGIN = (40.70200, -74.06500)
ORIGIN_EAST = (40.756, -73.846)
ORIGIN_NORTH = (40.829, -73.926)


def placed(records: DataFrame, grid: Grid, group: DataFrame | None = None) -> DataFrame:
    """Records with a station and a bucket `t`, optionally only those of a station group."""
    rows = grid.assign(records.where(F.col("bs").isNotNull()))
    return rows if group is None else in_group(rows, group)


def bearer_load(records: DataFrame, grid: Grid, group: DataFrame | None = None) -> DataFrame:
    """Devices, and devices plus release records, per station and bucket: `bs, t, ue, bearer`.

    Records first shrink to one row per device, which keeps a busy station or
    bucket spread over all tasks.
    """
    per_device = (
        placed(records, grid, group)
        .groupBy("bs", "t", "imsi")
        .agg(count_where(is_release(F.col("proc_id"))).alias("releases"))
    )
    return per_device.groupBy("bs", "t").agg(
        F.count(F.lit(1)).alias("ue"),
        (F.count(F.lit(1)) + F.sum("releases")).alias("bearer"),
    )


def ue_load(records: DataFrame, grid: Grid, group: DataFrame | None = None) -> DataFrame:
    """Distinct devices per station and bucket: `bs, t, ue`."""
    devices = placed(records, grid, group).select("bs", "t", "imsi").distinct()
    return devices.groupBy("bs", "t").agg(F.count(F.lit(1)).alias("ue"))


def site_distances(sites: DataFrame, origin=ORIGIN, legacy_distance: bool = False) -> DataFrame:
    """Add the distance in km of every station from a point: `dist_km`."""
    return sites.withColumn(
        "dist_km",
        distance_km(F.col("lat"), F.col("lon"), origin[0], origin[1], legacy_distance),
    )


def load_with_site(load: DataFrame, sites: DataFrame) -> DataFrame:
    """Load rows with the description and distance of their station."""
    side = site_distances(sites).select("bs", "descr", "dist_km")
    return load.join(broadcast_if_small(side), "bs")


def dense_load(load: DataFrame, stations: DataFrame, grid: Grid) -> DataFrame:
    """Load on every bucket of every station, 0 where nothing happened: `bs, t, ue, bearer`."""
    return zero_filled(load, stations, grid, ["ue", "bearer"])


def load_trace(load: DataFrame, stations: DataFrame, grid: Grid) -> DataFrame:
    """Dense load with the minutes since the grid start: `bs, minutes, ue, bearer`."""
    return dense_load(load, stations, grid).select(
        "bs", grid.minutes(F.col("t")).alias("minutes"), "ue", "bearer"
    )


def mean_over_stations(station_values: DataFrame, value: str, out: str, grid: Grid) -> DataFrame:
    """Sum over stations divided by the number of stations, for every bucket: `t, <out>`.

    Stations are those with a row anywhere in the grid. Each is counted in its
    first bucket, so that sums and number come from one pass over the records.
    """
    series = Window.partitionBy("bs").orderBy("t")
    first = F.when(F.row_number().over(series) == 1, F.lit(1)).otherwise(F.lit(0))
    sums = (
        station_values.select("bs", "t", value, first.alias("_new"))
        .groupBy("t")
        .agg(F.sum(value).cast("double").alias(out), F.sum("_new").alias("_new"))
    )
    # One row per bucket of the grid from here on.
    whole = Window.partitionBy(F.lit(0))
    return zero_filled_times(sums, grid, [out, "_new"]).select(
        "t", (F.col(out) / F.sum("_new").over(whole)).alias(out)
    )


def agg_load(records: DataFrame, grid: Grid) -> DataFrame:
    """Mean number of devices per station for every bucket: `t, mean_ue`."""
    return mean_over_stations(ue_load(records, grid), "ue", "mean_ue", grid)


def bs_volatility(dense: DataFrame) -> DataFrame:
    """Population standard deviation of the bearer load over the dense grid: `bs, sd`."""
    return dense.groupBy("bs").agg(F.stddev_pop("bearer").alias("sd"))


def top_volatile_trace(load: DataFrame, sites: DataFrame, grid: Grid, k: int = 30) -> DataFrame:
    """Load traces of the `k` stations whose bearer load varies most.

    Give `load` as a computed table: the plan reads it for the ranking and again
    for the traces. Columns `bs, descr, dist_km, sd, minutes, ue, bearer`.
    """
    places = site_distances(sites).select("bs", "descr", "dist_km")
    ranked = checkpointed(
        bs_volatility(dense_load(load, sites, grid))
        .join(broadcast_if_small(places), "bs")
        .orderBy(F.desc("sd"), F.desc("descr"), F.desc("bs"), F.desc("dist_km"))
        .limit(k)
    )
    side = broadcast_if_small(ranked)
    chosen = load.join(side, "bs", "left_semi")
    return load_trace(chosen, ranked, grid).join(side, "bs").select(
        "bs", "descr", "dist_km", "sd", "minutes", "ue", "bearer"
    )
