"""Size-checked broadcasts and reliable lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows up to which a side table (stations, groups, edges) is broadcast. At a few
# dozen bytes a row this stays near 10 MB per executor.
BROADCAST_ROWS = 200_000
# Rows that a task makes of its share where rows fan out behind a shuffle.
FANNED_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, which the driver and all executors see.

    Taken from `spark.checkpoint.dir` or from the context; where neither is set, a
    folder of the session's warehouse.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    known = configured or context.getCheckpointDir() or f"{warehouse}/_intermediate"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(known)
    return known


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path for one table in the shared folder, not used before."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder; survives the loss of executors.

    For results that several parts of a plan read, such as a station list or a
    (station, bucket) table.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def landed(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder as Parquet and read back.

    For record-sized results: later readers take only the columns they use.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcast only after counting at most `max_rows + 1` rows.

    Beyond the bound the frame comes back unmarked, so the join shuffles and
    adaptive execution splits its skewed partitions.
    """
    fits = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if fits else df


def dealt_for_fan_out(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Rows dealt out by keys to as many tasks as the `rows` need that are made of them behind the shuffle.

    Adaptive execution merges partitions by what they hold at the shuffle, before they fan out; a number
    that is named stays.
    """
    return df.repartition(max(1, -(-rows // FANNED_ROWS)), *keys)
