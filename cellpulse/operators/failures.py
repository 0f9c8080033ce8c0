"""Failed records and what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.functions.measures import is_failure
from cellpulse.operators.groups import in_group


def failed_records(records: DataFrame) -> DataFrame:
    """Records with a completion code above 1."""
    return records.where(is_failure(F.col("cfc")))


def _coded(records: DataFrame, group: DataFrame) -> DataFrame:
    return in_group(records.where(F.col("cfc").isNotNull() & F.col("bs").isNotNull()), group)


def proc_counts(records: DataFrame, group: DataFrame) -> DataFrame:
    """Records with a completion code by procedure, most frequent first: `proc_id, cnt`."""
    counts = _coded(records, group).groupBy("proc_id").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "proc_id")


def failure_causes(records: DataFrame, group: DataFrame) -> DataFrame:
    """Failed records by `procedure-cfcq-scfcq`, most frequent first: `cause, cnt`."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("proc_id", "cfcq", "scfcq")]
    counts = (
        failed_records(_coded(records, group))
        .groupBy(F.concat_ws("-", *parts).alias("cause"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return counts.orderBy(F.desc("cnt"), "cause")
