"""Flow of devices between neighbouring stations.

Devices meet their neighbours through the edge list: a row fans out along the edges of its
station and meets the device's rows at that neighbour. The work is linear in the number of
edges; all pairs of stations of a device are never formed, and a device that is everywhere
spreads over its neighbours. Active ranges meet as ranges, presence as bit masks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions.timegrid import Grid
from cellpulse.operators.load import placed
from cellpulse.plans.bounded import broadcast_if_small, dealt_for_fan_out, landed
from cellpulse.plans.dense import zero_filled
from cellpulse.plans.masks import (
    bit_sums,
    masks_of_buckets,
    moving_only,
    per_bucket,
    sums_of_bit_sums,
)


def _fanned_rows(rows: DataFrame, towards: DataFrame) -> int:
    """How many rows come of these when each also goes to the neighbours of its station."""
    more = towards.select("bs", F.size("towards").alias("_more"))
    places = F.sum(F.lit(1) + F.coalesce("_more", F.lit(0)))
    return rows.select("bs").join(broadcast_if_small(more), "bs", "left").agg(places).first()[0] or 0


def _meetings(masks: DataFrame, edges: DataFrame, group: DataFrame | None) -> DataFrame:
    """Masks of devices on both ends of an edge: `bs, imsi, run, came, left, outside`.

    `came`: at the neighbour in the bucket before, here now. `left`: the reverse. `outside` tells
    whether the neighbour is none of the group. A mask lies at its own station and at
    each neighbour; a window per (device, run, station) shows it the mask that is at home there.
    The rows stay where the device's run is, so this takes no shuffle of its own; the masks
    are written once, and their fan-out sets the number of tasks.
    """
    ways = edges.select("bs", "n").distinct()
    if group is None:
        ways = ways.withColumn("outside", F.lit(False))
    else:
        inside = group.select(F.col("bs").alias("_inside")).distinct()
        ways = ways.join(broadcast_if_small(inside), F.col("n") == F.col("_inside"), "left").select(
            "bs", "n", F.col("_inside").isNull().alias("outside")
        )
    # One row per station, as long as the station has neighbours.
    towards = ways.groupBy("bs").agg(
        F.collect_list(F.struct(F.col("n").alias("s"), F.col("bs").alias("o"), "outside")).alias("towards")
    )
    kind = edges.schema["bs"].dataType
    home = F.struct(F.col("bs").alias("s"), F.lit(None).cast(kind).alias("o"), F.lit(False).alias("outside"))
    places = F.when(F.col("towards").isNull(), F.array(home)).otherwise(F.concat(F.array(home), F.col("towards")))
    masks = landed(masks, "masks")
    dealt = dealt_for_fan_out(masks, ["imsi", "run"], _fanned_rows(masks, towards))
    placed_ = (
        moving_only(dealt).join(broadcast_if_small(towards), "bs", "left")
        .select("imsi", "run", "now", "prev", F.inline(places))
    )
    there = Window.partitionBy("imsi", "run", "s")
    at_home = F.when(F.col("o").isNull(), F.struct("now", "prev"))
    met = placed_.withColumn("there", F.max(at_home).over(there)).where(F.col("o").isNotNull())
    seen = met.select(
        F.col("o").alias("bs"), "imsi", "run", "outside",
        F.col("there.prev").bitwiseAND(F.col("now")).alias("came"),
        F.col("prev").bitwiseAND(F.col("there.now")).alias("left"),
    )
    return seen.where((F.col("came") != 0) | (F.col("left") != 0))


# Stations of a device up to which its neighbours are looked up among them one by one.
LISTED_STATIONS = 64


def _fanned_out(intervals: DataFrame, edges: DataFrame) -> DataFrame:
    """Every range at its own station and at the neighbours its device has been to.

    Rows `imsi, s, t, until, o, out, back`: at home (`o` is null) a range of station s; else a
    range of station o that looks for ranges at s. `out` tells whether s is a
    neighbour of o, `back` whether o is one of s. Ranges that meet nobody are left out.
    """
    one, none = F.lit(True), F.lit(False)
    ways = edges.select(F.col("bs").alias("o"), F.col("n").alias("s"), one.alias("out"), none.alias("back"))
    both = ways.unionByName(ways.select(F.col("s").alias("o"), F.col("o").alias("s"), none.alias("out"), one.alias("back")))
    pairs = both.groupBy("o", "s").agg(F.max("out").alias("out"), F.max("back").alias("back"))
    # One row per station, as long as the station has neighbours.
    towards = pairs.groupBy(F.col("o").alias("bs")).agg(
        F.collect_list(F.struct("s", F.col("o"), "out", "back")).alias("towards")
    )
    # The fan-out sets the number of tasks; both sides of the join by device lie in them.
    intervals = dealt_for_fan_out(intervals, ["imsi"], _fanned_rows(intervals, towards))
    # One row per device, at most as long as there are stations.
    visited = intervals.groupBy("imsi").agg(F.collect_set("bs").alias("visited"))
    few = F.size("visited") <= LISTED_STATIONS
    met = F.filter("towards", lambda p: ~few | F.array_contains("visited", p["s"]))
    home = F.struct(
        F.col("bs").alias("s"), F.lit(None).cast(edges.schema["bs"].dataType).alias("o"), none.alias("out"), none.alias("back")
    )
    return (
        intervals.join(broadcast_if_small(towards), "bs")
        .join(visited, "imsi")
        .withColumn("met", met)
        .where(F.size("met") > 0)
        .select("imsi", F.col("t0").alias("t"), F.col("t1").alias("until"), F.inline(F.concat(F.array(home), F.col("met"))))
    )


def _moves(fanned: DataFrame) -> DataFrame:
    """Ranges of buckets in which a device has come from one station to another: `bs, kind, first, behind`.

    A device counts at bucket t if it was active at the first station in t - 1 and is at the
    second in t. The ranges of a device at one station never overlap, so each range meets
    the others through its own begin: it lies behind at most one begin at the other station.
    """
    along = Window.partitionBy("imsi", "s").orderBy("t")
    home = F.when(F.col("o").isNull(), F.struct("t", "until"))
    upto = F.last(home, ignorenulls=True).over(along.rangeBetween(Window.unboundedPreceding, 0))
    before = F.last(home, ignorenulls=True).over(along.rangeBetween(Window.unboundedPreceding, -1))
    probes = fanned.withColumns({"before": before, "upto": upto}).where(F.col("o").isNotNull())

    def rows(met, begin, end, comes_to, comes_from, counts_in, counts_out):
        there = met.isNotNull() & (begin <= end)
        return [
            F.when(there & counts_in, F.struct(comes_to.alias("bs"), F.lit(1).alias("i"), F.lit(0).alias("o"), begin.alias("first"), (end + 1).alias("behind"))),
            F.when(there & counts_out, F.struct(comes_from.alias("bs"), F.lit(0).alias("i"), F.lit(1).alias("o"), begin.alias("first"), (end + 1).alias("behind"))),
        ]

    t, until, o, s = (F.col(c) for c in ("t", "until", "o", "s"))
    arrived = rows(F.col("before"), t, F.least(F.col("before.until") + 1, until), o, s, F.col("out"), F.col("back"))
    gone = rows(F.col("upto"), t + 1, F.least(until + 1, F.col("upto.until")), s, o, F.col("back"), F.col("out"))
    return probes.select(F.inline(F.array_compact(F.array(*arrived, *gone))))


def neighbor_flow(intervals: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Active devices that came from and went to a neighbour: `bs, t, inflow, outflow, net`.

    Summed over the neighbours that have records; every bucket of the station's
    own series has a row. `intervals` are closed active ranges and `ends` the last
    bucket of every station (`series_ends`). Give both as computed tables: the plan reads
    them twice. Ranges stay ranges, however long: each meets those of the same device at its
    neighbours in one window per (device, station), which holds at most a row per
    bucket for the station and each of its neighbours, and only begins and ends of flows are counted.
    """
    known = edges.select("bs", "n").distinct()
    moves = _moves(_fanned_out(intervals.where(F.col("imsi").isNotNull()), known))
    ways = F.array(
        F.struct(F.col("first").alias("t"), F.col("i"), F.col("o")),
        F.struct(F.col("behind").alias("t"), (-F.col("i")).alias("i"), (-F.col("o")).alias("o")),
    )
    changes = moves.select("bs", F.inline(ways)).groupBy("bs", "t").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    with_records = known.join(ends.select(F.col("bs").alias("n")), "n", "left_semi")
    series = ends.join(with_records, "bs", "left_semi").select(
        "bs", F.explode(F.sequence(F.lit(1), F.col("last_t"))).alias("t")
    )
    # One row per station and bucket: running sums of the changes.
    upto = Window.partitionBy("bs").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    came, left = (F.coalesce(F.sum(c).over(upto), F.lit(0)).cast("bigint") for c in ("i", "o"))
    return (
        series.join(changes, ["bs", "t"], "left")
        .select("bs", "t", came.alias("inflow"), left.alias("outflow"))
        .withColumn("net", F.col("inflow") - F.col("outflow"))
    )


def top_sink_series(flow: DataFrame) -> DataFrame:
    """Net flow series of the station with the greatest non-negative net flow: `bs, t, net`.

    Ties go to the lower station, then the earlier bucket. Give `flow` as a
    computed table: the plan reads it twice.
    """
    strongest = (
        flow.where(F.col("net") >= 0)
        .orderBy(F.desc("net"), "bs", "t")
        .limit(1)
        .select("bs")
    )
    # One row, so the broadcast is bounded.
    return flow.join(F.broadcast(strongest), "bs", "left_semi").select("bs", "t", "net")


def presence_flow(
    records: DataFrame, grid: Grid, edges: DataFrame, group: DataFrame | None = None
) -> DataFrame:
    """Devices with records at two neighbours in consecutive buckets: columns below.

    `bs, t, inflow, outflow`, and with a group also `in_outside, out_outside` for
    neighbours outside it. Arrivals count (device, neighbour) pairs; departures
    count a device once whatever the number of neighbours it went to.
    """
    return flow_of_devices(placed(records, grid).select("bs", "imsi", "t"), grid, edges, group)


def flow_of_devices(
    devices: DataFrame, grid: Grid, edges: DataFrame, group: DataFrame | None = None
) -> DataFrame:
    """`presence_flow` from rows `bs, imsi, t`, repeated or not."""
    met = _meetings(masks_of_buckets(devices.where(F.col("imsi").isNotNull())), edges, group)
    for way in ("came", "left"):
        met = met.withColumn(f"{way}_out", F.when(F.col("outside"), F.col(way)).otherwise(F.lit(0)))
    came, left = ["came", "came_out"], ["left", "left_out"]
    # A device's neighbours are still together; both the pair counts and the
    # once-per-device masks are taken where they are.
    by_device = met.groupBy("bs", "imsi", "run").agg(*bit_sums(came), *(F.bit_or(c).alias(c) for c in left))
    counted = by_device.groupBy("bs", "run").agg(*sums_of_bit_sums(came), *bit_sums(left))
    flows = per_bucket(counted, ["bs"], came + left).where(F.col("t") <= grid.n)
    names = {"came": "inflow", "left": "outflow"}
    if group is not None:
        names |= {"came_out": "in_outside", "left_out": "out_outside"}
    return flows.select("bs", "t", *(F.col(c).alias(name) for c, name in names.items()))


def dense_presence_flow(flow: DataFrame, stations: DataFrame, grid: Grid) -> DataFrame:
    """Presence flow on every bucket of every station, 0 where nobody moved."""
    columns = [c for c in flow.columns if c not in ("bs", "t")]
    return zero_filled(flow, stations, grid, columns)
