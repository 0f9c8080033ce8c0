"""Restricting records to a group of stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.functions.cells import station_number
from cellpulse.plans.bounded import broadcast_if_small


def group_key(group: DataFrame, station: Column) -> tuple[str, Column]:
    """Column of the group to match on and the station expression that matches it.

    A group holds either station values (`bs`) or decimal ids (`bs_id`).
    """
    if "bs" in group.columns:
        return "bs", station
    return "bs_id", station_number(station)


def in_group(rows: DataFrame, group: DataFrame, station: str = "bs") -> DataFrame:
    """Rows whose station is in the group, as a left-semi join."""
    name, value = group_key(group, F.col(station))
    side = group.select(F.col(name).alias("_member")).distinct()
    return (
        rows.withColumn("_station", value)
        .join(broadcast_if_small(side), F.col("_station") == F.col("_member"), "left_semi")
        .drop("_station")
    )


def edges_of_group(edges: DataFrame, group: DataFrame) -> DataFrame:
    """Edges whose station is in the group."""
    return in_group(edges, group)


def relevant_stations(edges: DataFrame) -> DataFrame:
    """Stations of a group's edges and all their neighbours: `bs`."""
    return edges.select(F.explode(F.array("bs", "n")).alias("bs")).distinct()


FIXED_STATIONS = ("bs", "source_bs", "target_bs")


def any_cell_in_group(records: DataFrame, group: DataFrame) -> DataFrame:
    """Records that name at least one station of the group in any cell column.

    The current, source and target station are looked up with joins that need no
    shuffle while the group is small enough to broadcast. Measured cells are fanned
    out once per different list, not per record; the lists with a hit are looked
    up like a fourth column. No side repeats a key, so every record comes back as
    often as it is there, with or without an id.
    """
    name, _ = group_key(group, F.col("bs"))
    members = broadcast_if_small(group.select(F.col(name).alias("_member")).distinct())
    flagged = records
    for i, column in enumerate(FIXED_STATIONS):
        _, value = group_key(group, F.col(column))
        side = members.select(F.col("_member").alias(f"_member{i}"))
        flagged = flagged.withColumn(f"_station{i}", value).join(
            side, F.col(f"_station{i}") == F.col(f"_member{i}"), "left"
        )
    hit = F.coalesce(*(F.col(f"_member{i}") for i in range(len(FIXED_STATIONS)))).isNotNull()
    helpers = [f"_{kind}{i}" for kind in ("station", "member") for i in range(len(FIXED_STATIONS))]
    if "measured" not in records.columns:
        return flagged.where(hit).drop(*helpers)
    lists = records.where(F.size("measured") > 0).select(F.col("measured").alias("_list")).distinct()
    stations = F.col("_list") if name == "bs" else F.transform("_list", station_number)
    found = (
        lists.withColumn("_station", F.explode(F.array_distinct(stations)))
        .join(members, F.col("_station") == F.col("_member"), "left_semi")
        .select("_list").distinct()
    )
    # Only records without a hit so far look for their list.
    wanted = F.when(~hit & (F.size("measured") > 0), F.col("measured"))
    return (
        flagged.withColumn("_wanted", wanted)
        .join(broadcast_if_small(found), F.col("_wanted") == F.col("_list"), "left")
        .where(hit | F.col("_list").isNotNull())
        .drop(*helpers, "_wanted", "_list")
    )
