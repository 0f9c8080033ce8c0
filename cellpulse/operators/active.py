"""Devices that stay active between records.

A device is active at a station from a bucket in which it has a record until
the bucket in which its last record is a release; without a release it stays
active to the station's last bucket. A device that ends in a bucket still
counts there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions.measures import is_release
from cellpulse.functions.timegrid import Grid
from cellpulse.operators.load import mean_over_stations
from cellpulse.plans.bounded import broadcast_if_small

# The last record of a bucket is the greatest (start_ms, proc_id). Where both fit they go
# into one 64-bit number, else into a wide decimal of the same order, so that finding
# it is always a plain hash aggregate.
PROC_BITS = 20
WIDE_START, WIDE_PROC = 1 << 63, 1 << 32


def _decimal(number: int, digits: int) -> Column:
    return F.lit(str(number)).cast(f"decimal({digits},0)")


def greatest_record() -> list[Column]:
    """Aggregates that together hold the greatest (start_ms, proc_id); a missing id sorts first."""
    proc, start = F.col("proc_id").cast("bigint"), F.col("start_ms")
    fits = F.coalesce(
        proc.between(0, (1 << PROC_BITS) - 1)
        & start.between(-(1 << (62 - PROC_BITS)), (1 << (62 - PROC_BITS)) - 1),
        F.lit(False),
    )
    # The id shifted to be positive; 0 stands for none.
    code = F.coalesce(proc + WIDE_PROC // 2 + 1, F.lit(0)).cast("decimal(20,0)")
    wide = (start.cast("decimal(20,0)") + _decimal(WIDE_START, 20)) * _decimal(
        2 * WIDE_PROC, 11
    ) + code
    return [
        F.max(F.when(fits, F.shiftleft(start, PROC_BITS) + proc)).alias("_packed"),
        F.max(F.when(~fits, wide.cast("decimal(38,0)"))).alias("_wide"),
    ]


def record_found() -> list[Column]:
    """`start_ms, proc_id` from the aggregates of `greatest_record`."""
    packed, wide = F.col("_packed"), F.col("_wide")
    code = wide % _decimal(2 * WIDE_PROC, 11)
    wide_start = (
        ((wide - code) / _decimal(2 * WIDE_PROC, 11)).cast("decimal(20,0)")
        - _decimal(WIDE_START, 20)
    ).cast("bigint")
    wide_proc = (F.nullif(code.cast("bigint"), F.lit(0).cast("bigint")) - WIDE_PROC // 2 - 1).cast("int")
    start = F.shiftright(packed, PROC_BITS)
    proc = packed.bitwiseAND(F.lit((1 << PROC_BITS) - 1)).cast("int")
    # Both kinds may occur in one group; the later record wins, then the greater id.
    later = (wide_start > start) | ((wide_start == start) & (F.coalesce(wide_proc, F.lit(-1)) > proc))
    is_wide = wide.isNotNull() & (packed.isNull() | later)
    return [
        F.when(is_wide, wide_start).otherwise(start).alias("start_ms"),
        F.when(is_wide, wide_proc).otherwise(proc).alias("proc_id"),
    ]


def last_record(records: DataFrame, grid: Grid, key: str = "bs") -> DataFrame:
    """Last record of a device per bucket: `<key>, imsi, t, start_ms, proc_id`."""
    rows = grid.assign(records.where(F.col(key).isNotNull()))
    last = rows.groupBy(key, "imsi", "t").agg(*greatest_record())
    return last.select(key, "imsi", "t", *record_found())


def series_ends(records: DataFrame, grid: Grid, key: str = "bs") -> DataFrame:
    """Last bucket with a record per key: `<key>, last_t`."""
    rows = grid.assign(records.where(F.col(key).isNotNull()))
    return rows.groupBy(key).agg(F.max("t").alias("last_t"))


def open_ranges(
    records: DataFrame,
    grid: Grid,
    key: str = "bs",
    max_idle: int | None = None,
    carried: DataFrame | None = None,
    after: int = 0,
    until: int | None = None,
) -> DataFrame:
    """Bucket ranges in which a device is active: `<key>, imsi, t0, t1`.

    A range begins at a bucket with a record. It reaches to its own bucket when
    that ends in a release, else to the one before the next bucket with a record;
    `t1` is null when there is none. With `max_idle` a device without a record counts for
    that many buckets more at most; such a range may reach past the key's last bucket
    until it is closed (`closed_ranges`).

    A day can go on from the day before: `carried` are the ranges open then
    (`still_open`), `after` its last bucket, up to which records are not read again.
    Records of the day reach to bucket `until`, the grid's end unless given; what is
    active there and may go on has no `t1`. The closed ranges of all days together are those of one pass.
    """
    until = grid.n if until is None else until
    if after:
        records = records.where(F.col("start_ms") > F.lit(grid.start_ms + after * grid.width_ms))
    if until < grid.n:
        records = records.where(F.col("start_ms") <= F.lit(grid.start_ms + until * grid.width_ms))
    seen = last_record(records, grid, key).select(key, "imsi", "t", "proc_id")
    if carried is not None:
        # A range handed over stands like a bucket with a record that was no release.
        seen = seen.unionByName(
            carried.select(key, "imsi", F.col("t0").alias("t"), F.lit(None).cast("int").alias("proc_id"))
        )
    following = F.lead("t").over(Window.partitionBy(key, "imsi").orderBy("t")) - 1
    last = following
    if max_idle is not None:
        idle = F.col("t") + max_idle
        # Where the day ends first, the next one decides.
        ended = F.when(idle <= until, idle)
        last = F.when(following.isNotNull(), F.least(following, idle)).otherwise(ended)
    ends = F.when(is_release(F.col("proc_id")), F.col("t")).otherwise(last)
    return seen.select(key, "imsi", F.col("t").alias("t0"), ends.alias("t1"))


def still_open(ranges: DataFrame, key: str = "bs") -> DataFrame:
    """What a day hands over to the next: the ranges without an end, `<key>, imsi, t0`; land it."""
    return ranges.where(F.col("t1").isNull()).select(key, "imsi", "t0")


def later_ends(before: DataFrame, now: DataFrame, key: str = "bs") -> DataFrame:
    """Last buckets of the keys' series (`<key>, last_t`) after another day."""
    return before.unionByName(now).groupBy(key).agg(F.max("last_t").alias("last_t"))


def active_intervals(
    records: DataFrame,
    grid: Grid,
    key: str = "bs",
    ends: DataFrame | None = None,
    to_grid_end: bool = False,
) -> DataFrame:
    """`open_ranges` with the open ones closed at the last bucket of the key's series.

    That bucket comes from `ends` where the table is at hand. With `to_grid_end`
    series run to the end of the grid.
    """
    ranges = open_ranges(records, grid, key)
    if to_grid_end:
        return ranges.withColumn("t1", F.coalesce("t1", F.lit(grid.n)))
    # One row per key. Adaptive execution sees its real size before the ranges
    # are shuffled and broadcasts it when small; otherwise it is a sort-merge
    # join whose skewed keys are split.
    if ends is None:
        return _closed(ranges, series_ends(records, grid, key), key)
    return closed_ranges(ranges, ends, key)


def ends_of_ranges(ranges: DataFrame, key: str = "bs") -> DataFrame:
    """`series_ends` from open ranges: a range begins at a record, and the last record of a key begins one."""
    return ranges.groupBy(key).agg(F.max("t0").alias("last_t"))


def closed_ranges(ranges: DataFrame, ends: DataFrame, key: str = "bs") -> DataFrame:
    """Ranges closed at the last bucket of the key's series where they are open or reach past it.

    Give `ends` as a computed table: its rows are counted, and a small one is broadcast.
    """
    return _closed(ranges, broadcast_if_small(ends), key)


def _closed(ranges: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    return ranges.join(ends, key).select(key, "imsi", "t0", F.least("t1", "last_t").alias("t1"))


def active_ues(intervals: DataFrame, key: str = "bs") -> DataFrame:
    """The active devices themselves: `<key>, imsi, t`."""
    return intervals.select(key, "imsi", F.explode(F.sequence("t0", "t1")).alias("t"))


def active_load(ranges: DataFrame, key: str = "bs") -> DataFrame:
    """Number of active devices per bucket of a key's series: `<key>, t, n`.

    Takes open or closed ranges. Only their ends are counted, then summed up along
    the series; a count holds until the next change. The series starts at bucket 1
    and ends at the last bucket of any range.
    """
    change = F.array_compact(
        F.array(
            F.struct(F.lit(1).alias("t"), F.lit(0).alias("d")),
            F.struct(F.col("t0").alias("t"), F.lit(1).alias("d")),
            F.when(
                F.col("t1").isNotNull(),
                F.struct((F.col("t1") + 1).alias("t"), F.lit(-1).alias("d")),
            ),
        )
    )
    changes = (
        ranges.select(key, F.coalesce("t1", "t0").alias("_last"), F.inline(change))
        .groupBy(key, "t")
        .agg(F.sum("d").alias("d"), F.max("_last").alias("_last"))
    )
    # At most one row per bucket and key from here on.
    series = Window.partitionBy(key)
    along = series.orderBy("t")
    levels = changes.select(
        key,
        "t",
        F.max("_last").over(series).alias("_end"),
        F.lead("t").over(along).alias("_next"),
        F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("n"),
    )
    until = F.least(F.coalesce(F.col("_next") - 1, F.col("_end")), F.col("_end"))
    return levels.where(F.col("t") <= F.col("_end")).select(
        key, F.explode(F.sequence("t", until)).alias("t"), "n"
    )


def mean_active_load(records: DataFrame, grid: Grid, to_grid_end: bool = False) -> DataFrame:
    """Mean number of active devices per station for every bucket: `t, mean_ue`."""
    ranges = (
        active_intervals(records, grid, to_grid_end=True)
        if to_grid_end
        else open_ranges(records, grid)
    )
    return mean_over_stations(active_load(ranges), "n", "mean_ue", grid)


def ue_set_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in either set."""
    return left.unionByName(right).distinct()


def ue_set_except(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the first set that are not in the second."""
    return left.subtract(right.select(left.columns))


def ue_set_intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in both sets."""
    return left.intersect(right.select(left.columns))
