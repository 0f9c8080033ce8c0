"""Handovers, their durations and the neighbour graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.functions.measures import count_where, is_release
from cellpulse.functions.timegrid import Grid
from cellpulse.operators.groups import in_group
from cellpulse.plans.blocks import running_sum_by_blocks
from cellpulse.plans.bounded import landed
from cellpulse.schema import CSFB_PROCEDURE, CSFB_SUCCESS, CSFB_TRIGGER

# Width of a block of durations, in ms, for the distribution function.
DURATION_BLOCK_MS = 4_096


def _is_fallback() -> Column:
    return (F.col("mob_trigger") == CSFB_TRIGGER) & (F.col("proc_id") == CSFB_PROCEDURE)


def _fallback_succeeded() -> Column:
    return F.coalesce(F.col("cfcq").try_cast("int") == CSFB_SUCCESS, F.lit(False))


def _both_ends() -> Column:
    return F.col("source_bs").isNotNull() & F.col("target_bs").isNotNull()


def _ok_or_absent(status: str) -> Column:
    return F.coalesce(F.col(status), F.lit(0)) == 0


def between_stations(records: DataFrame) -> DataFrame:
    """Records whose source and target stations are both present and differ."""
    return records.where(_both_ends() & (F.col("source_bs") != F.col("target_bs")))


def mobility_records(records: DataFrame) -> DataFrame:
    """Records with a mobility trigger, without failed fallbacks and failed handovers."""
    same = F.col("source_bs") == F.col("target_bs")
    statuses_fine = (
        F.when(~_both_ends(), F.lit(True))
        .when(same, _ok_or_absent("intra_status"))
        .otherwise(_ok_or_absent("x2_status") & _ok_or_absent("s1_status"))
    )
    return records.where(
        F.col("mob_trigger").isNotNull() & (~_is_fallback() | _fallback_succeeded()) & statuses_fine
    )


def handover_durations(records: DataFrame) -> DataFrame:
    """Duration of every successful handover: `ho_type, dur`.

    Types `intra`, `x2` and `s1` last from their start to the end of collection;
    a fallback (`csfb`) lasts as long as its procedure. A failed fallback yields
    nothing at all, and a failed X2 attempt hides an S1 success of the same record.
    One record may give a fallback and one or two handovers.
    """
    fallback = _is_fallback()
    usable = records.where(
        F.col("mob_trigger").isNotNull() & (~fallback | _fallback_succeeded())
    )
    same = F.col("source_bs") == F.col("target_bs")

    def ended(kind: str, condition: Column) -> Column:
        return F.when(
            condition & (F.col(f"{kind}_status") == 0),
            F.struct(
                F.lit(kind).alias("ho_type"),
                (F.col("stop_ms") - F.col(f"{kind}_start")).alias("dur"),
            ),
        )

    found = F.array(
        F.when(
            fallback,
            F.struct(
                F.lit("csfb").alias("ho_type"), F.col("proc_duration").cast("bigint").alias("dur")
            ),
        ),
        ended("intra", _both_ends() & same),
        ended("x2", _both_ends() & ~same),
        ended("s1", _both_ends() & ~same & _ok_or_absent("x2_status")),
    )
    return usable.select(F.inline(F.array_compact(found))).where(F.col("dur").isNotNull())


def handover_counts(durations: DataFrame) -> DataFrame:
    """Handovers by type: `ho_type, cnt`."""
    return durations.groupBy("ho_type").agg(F.count(F.lit(1)).alias("cnt"))


def cdf(df: DataFrame, by: str, column: str, block: int = DURATION_BLOCK_MS) -> DataFrame:
    """Distinct values and the fraction of rows at or below each, per key: `<by>, <column>, fraction`.

    Rows are counted per value before any ordering; the running sum then goes
    over distinct values in blocks, so a key with most of the rows is not one task.
    """
    # Written once: the running sum reads the counts twice.
    counts = landed(df.groupBy(by, column).agg(F.count(F.lit(1)).alias("_cnt")), "value-counts")
    summed = running_sum_by_blocks(counts, [by], column, "_cnt", "_upto", block)
    return summed.select(by, column, (F.col("_upto") / F.col("_upto_total")).alias("fraction"))


def handover_fanout(records: DataFrame, group: DataFrame) -> DataFrame:
    """Give a record to the stations of the group it concerns, as `station`.

    A record with source and target goes to each of the two that is in the
    group, unless both are the same station; any other goes to its current one.
    """
    concerned = F.when(
        _both_ends(),
        F.when(
            F.col("source_bs") != F.col("target_bs"), F.array("source_bs", "target_bs")
        ),
    ).otherwise(F.array_compact(F.array("bs")))
    return in_group(records.withColumn("station", F.explode(concerned)), group, "station")


def handover_devices(records: DataFrame, grid: Grid, group: DataFrame) -> DataFrame:
    """Fanned-out records per device: `bs, t, imsi, releases, in_ho, out_ho`."""
    fanned = handover_fanout(grid.assign(records), group)
    return fanned.groupBy(F.col("station").alias("bs"), "t", "imsi").agg(
        count_where(is_release(F.col("proc_id"))).alias("releases"),
        count_where(_both_ends() & (F.col("target_bs") == F.col("station"))).alias("in_ho"),
        count_where(_both_ends() & (F.col("source_bs") == F.col("station"))).alias("out_ho"),
    )


def handover_load(records: DataFrame, grid: Grid, group: DataFrame) -> DataFrame:
    """Bearer load, arriving and leaving handovers: `bs, t, bearer, in_ho, out_ho`."""
    return handover_devices(records, grid, group).groupBy("bs", "t").agg(
        (F.count(F.lit(1)) + F.sum("releases")).alias("bearer"),
        F.sum("in_ho").alias("in_ho"),
        F.sum("out_ho").alias("out_ho"),
    )


def neighbor_counts(records: DataFrame) -> DataFrame:
    """Handovers from station to station: `bs, n, cnt`."""
    pairs = between_stations(records).groupBy(
        F.col("source_bs").alias("bs"), F.col("target_bs").alias("n")
    )
    return pairs.agg(F.count(F.lit(1)).alias("cnt"))


def neighbor_edges(records: DataFrame) -> DataFrame:
    """Undirected neighbour graph, both directions of every pair: `bs, n`.

    Pairs are made distinct before they are doubled.
    """
    pairs = between_stations(records).select("source_bs", "target_bs").distinct()
    both = F.array(
        F.struct(F.col("source_bs").alias("bs"), F.col("target_bs").alias("n")),
        F.struct(F.col("target_bs").alias("bs"), F.col("source_bs").alias("n")),
    )
    return pairs.select(F.inline(both)).distinct()


def neighbor_sets(edges: DataFrame) -> DataFrame:
    """One row per station with its neighbours as a sorted array, for sinks."""
    return edges.groupBy("bs").agg(F.sort_array(F.collect_set("n")).alias("neighbors"))
