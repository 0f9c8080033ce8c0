"""Which stations and gateways occur in the records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_bs(records: DataFrame) -> DataFrame:
    """Stations in any of the four cell columns: `bs`."""
    named = F.array_compact(F.array("bs", "prev_bs", "source_bs", "target_bs"))
    return records.select(F.explode(F.array_distinct(named)).alias("bs")).distinct()


def bs_gateways(records: DataFrame) -> DataFrame:
    """Gateways that serve a station, one row each: `bs, sgw`."""
    both = F.col("bs").isNotNull() & F.col("sgw").isNotNull()
    return records.where(both).select("bs", "sgw").distinct()


def bs_gateway_sets(gateways: DataFrame) -> DataFrame:
    """One row per station with its gateways as a sorted array, for sinks."""
    return gateways.groupBy("bs").agg(F.sort_array(F.collect_set("sgw")).alias("sgws"))
