"""Side files: station coordinates, station groups and neighbour lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.functions.cells import station_number

SITE_SCHEMA = "site_no string, lat double, lon double, bs_id bigint, descr string"


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Station dimension from a CSV file with a header: `bs_id, lat, lon, descr`."""
    return spark.read.csv(path, schema=SITE_SCHEMA, header=True).select(
        "bs_id", "lat", "lon", "descr"
    )


def read_group(spark: SparkSession, path: str) -> DataFrame:
    """Station group, one decimal id per line: `bs_id`."""
    return (
        spark.read.text(path)
        .select(F.trim("value").try_cast("bigint").alias("bs_id"))
        .where(F.col("bs_id").isNotNull())
    )


def read_neighbors(spark: SparkSession, path: str) -> DataFrame:
    """Directed edges `bs, n` from lines `bs n1 n2 …`."""
    words = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("words"))
    return words.select(
        F.get("words", F.lit(0)).alias("bs"),
        F.explode(F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1)))).alias("n"),
    )


def number_stations(stations: DataFrame) -> DataFrame:
    """Add the decimal id `bs_id` to station codes."""
    return stations.withColumn("bs_id", station_number(F.col("bs")))
