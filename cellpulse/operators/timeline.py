"""Records of a device in time order, and the fields of single records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.plans.ranges import position_by_ranges

PAGE_RECORDS = 1_000


def ue_timeline(records: DataFrame, keys: list[str]) -> DataFrame:
    """Number the records of a key by time: all columns plus `pos`, from 1.

    Rows, not arrays, so that a key may hold any share of the records, in any stretch of time.
    The records are read once.
    """
    return position_by_ranges(records, keys, ["start_ms", "rec_seq"], "pos")


def ue_timeline_pages(
    timeline: DataFrame, keys: list[str], page_records: int = PAGE_RECORDS
) -> DataFrame:
    """Time-ordered arrays of at most `page_records` records: `<keys>, page, recs`.

    All pages of a key together are its whole timeline.
    """
    rest = [c for c in timeline.columns if c not in keys and c != "pos"]
    page = F.floor((F.col("pos") - 1) / page_records)
    return (
        timeline.groupBy(*keys, page.alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("recs"))
    )


def field_dump(lines: DataFrame, line_id: str, column: str = "line") -> DataFrame:
    """Every field of a record line with its number: `line_id, pos, value`."""
    fields = F.split(F.rtrim(F.col(column)), ";", -1)
    return lines.select(
        F.col(line_id).alias("line_id"), F.posexplode(fields).alias("pos", "value")
    ).withColumn("pos", F.col("pos") + 1)


def field_text(line: Column) -> Column:
    """One text `1: v 2: v …` with every field of a record line."""
    fields = F.split(F.rtrim(line), ";", -1)
    numbered = F.transform(
        fields, lambda value, i: F.concat((i + 1).cast("string"), F.lit(": "), value, F.lit(" "))
    )
    return F.array_join(numbered, "")
