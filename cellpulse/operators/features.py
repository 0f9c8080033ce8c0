"""Load and flow features per station and bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.functions.measures import count_where, is_release
from cellpulse.functions.timegrid import Grid
from cellpulse.operators.flow import flow_of_devices
from cellpulse.operators.groups import edges_of_group, in_group, relevant_stations
from cellpulse.operators.load import placed
from cellpulse.operators.mobility import handover_devices
from cellpulse.operators.quality import rolling_mean
from cellpulse.plans.bounded import checkpointed, landed
from cellpulse.plans.dense import all_buckets

FEATURES = ("load_rate", "net_flow")
SAMPLES = (3, 5, 10)


def _with_arrivals(devices: DataFrame, sums: list[str]) -> DataFrame:
    """Devices, arrivals and the given sums per station and bucket, from rows `bs, t, imsi`.

    Devices are first counted by the bucket they were last seen in, so only small
    counts meet the station's own sequence of buckets.
    """
    before = F.lag("t").over(Window.partitionBy("bs", "imsi").orderBy("t"))
    by_last = (
        devices.withColumn("last_seen", before)
        .groupBy("bs", "t", "last_seen")
        .agg(F.count(F.lit(1)).alias("ue"), *(F.sum(c).alias(c) for c in sums))
    )
    # One row per station and bucket meets the station's window, whatever the number of counts.
    steps = by_last.select("bs", "t").distinct()
    along = Window.partitionBy("bs").orderBy("t")
    at = by_last.join(steps.withColumn("prev_t", F.lag("t").over(along)), ["bs", "t"])
    is_new = F.col("last_seen").isNull() | (F.col("last_seen") < F.col("prev_t"))
    new = F.when(F.col("prev_t").isNotNull() & is_new, F.col("ue")).otherwise(F.lit(0))
    return at.groupBy("bs", "t").agg(
        F.sum("ue").alias("ue"), F.sum(new).alias("arrivals"), *(F.sum(c).alias(c) for c in sums)
    )


def ue_arrivals(records: DataFrame, grid: Grid) -> DataFrame:
    """Devices in a bucket that were not in the station's bucket before: `bs, t, arrivals`.

    The bucket before is the last one with any record of the station; the first
    bucket has no arrivals.
    """
    devices = grid.assign(records.where(F.col("bs").isNotNull())).select("bs", "imsi", "t")
    return _with_arrivals(devices.distinct(), []).select("bs", "t", "arrivals")


def handover_training_rows(records: DataFrame, grid: Grid, group: DataFrame) -> DataFrame:
    """Per station of the group and bucket: `bs, t, bearer, in_ho, out_ho, arrivals`.

    Arrivals count the devices of the same fanned-out records as the load.
    """
    rows = _with_arrivals(
        handover_devices(records, grid, group), ["releases", "in_ho", "out_ho"]
    )
    return rows.select(
        "bs", "t", (F.col("ue") + F.col("releases")).alias("bearer"), "in_ho", "out_ho", "arrivals"
    )


FLOWS = ("inflow", "outflow", "in_outside", "out_outside")


def feature_counts(records: DataFrame, grid: Grid, group: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows to be summed per station of the group and bucket: `bs, t, bearer, inflow, …, out_outside`.

    Loads, flows and a zero for every bucket of every station of the group that has
    records. Records shrink to one row per station, device and bucket once, for both.
    """
    own_edges = edges_of_group(edges, group)
    relevant = in_group(records, relevant_stations(own_edges).unionByName(group.select("bs")).distinct())
    devices = landed(
        placed(relevant, grid).groupBy("bs", "t", "imsi").agg(
            count_where(is_release(F.col("proc_id"))).alias("releases")
        ),
        "device-buckets",
    )
    # At most one row per station and bucket.
    load = checkpointed(
        in_group(devices, group).groupBy("bs", "t").agg((F.count(F.lit(1)) + F.sum("releases")).alias("bearer"))
    )
    flow = flow_of_devices(devices.select("bs", "imsi", "t"), grid, own_edges, group)
    base = all_buckets(load.select("bs").distinct(), grid)
    zero = F.lit(0).cast("bigint")
    columns = ("bearer", *FLOWS)

    def filled(df: DataFrame) -> DataFrame:
        return df.select("bs", "t", *((F.col(c).cast("bigint") if c in df.columns else zero).alias(c) for c in columns))

    return filled(base).unionByName(filled(load)).unionByName(filled(flow))


def _rates(grid: Grid) -> list:
    """Sums of `feature_counts` per minute."""
    sums = {c: F.sum(c) for c in ("bearer", *FLOWS)}
    return [
        grid.per_minute(sums["bearer"]).alias("load_rate"),
        grid.per_minute(sums["inflow"] - sums["outflow"]).alias("net_flow"),
        grid.per_minute(sums["in_outside"] - sums["out_outside"]).alias("outside_flow"),
    ]


def bs_features(
    records: DataFrame, grid: Grid, group: DataFrame, edges: DataFrame
) -> DataFrame:
    """Load and net flow per minute for the stations of a group: `bs, t, load_rate, net_flow, outside_flow`.

    Every bucket of every station of the group that has records. `outside_flow`
    counts only neighbours outside the group and feeds the group rows.
    """
    return feature_counts(records, grid, group, edges).groupBy("bs", "t").agg(*_rates(grid))


def group_features(records: DataFrame, grid: Grid, group: DataFrame, edges: DataFrame) -> DataFrame:
    """The group as one: summed load and flow across its border: `t, load_rate, net_flow`."""
    rates = feature_counts(records, grid, group, edges).groupBy("t").agg(*_rates(grid))
    return rates.select("t", "load_rate", F.col("outside_flow").alias("net_flow"))


def features_with_group(records: DataFrame, grid: Grid, group: DataFrame, edges: DataFrame) -> DataFrame:
    """Station rows and, as station `all`, the rows of the group, in one pass: `bs, t, load_rate, net_flow`."""
    sets = [[F.col("bs"), F.col("t")], [F.col("t")]]
    whole = F.grouping("bs") == 1
    rates = feature_counts(records, grid, group, edges).groupingSets(sets, "bs", "t").agg(
        *_rates(grid), whole.alias("_whole")
    )
    station = F.when(F.col("_whole"), F.lit("all")).otherwise(F.col("bs").cast("string"))
    flow = F.when(F.col("_whole"), F.col("outside_flow")).otherwise(F.col("net_flow"))
    return rates.select(station.alias("bs"), "t", "load_rate", flow.alias("net_flow"))


def feature_rolling(
    features: DataFrame, samples: tuple[int, ...] = SAMPLES, legacy_rolling: bool = False
) -> DataFrame:
    """Add the mean of the last k values of every feature as `<feature>_<k>`, null until k exist.

    `legacy_rolling` reproduces the older form, which weighs the value before with k - 1.
    """
    along = Window.partitionBy("bs").orderBy("t")

    def mean(feature: str, k: int):
        if not legacy_rolling:
            return rolling_mean(feature, ["bs"], k)
        before = F.lag(feature).over(along)
        return F.when(F.col("t") >= k, (F.col(feature) + (k - 1) * before) / k)

    return features.select(
        "bs",
        "t",
        *FEATURES,
        *(mean(f, k).alias(f"{f}_{k}") for k in samples for f in FEATURES),
    )


def feature_summary(
    rolled: DataFrame, t_from: int, t_to: int, legacy_divisor: int | None = None
) -> DataFrame:
    """Mean of every feature over the buckets `[t_from, t_to]`, one row per station.

    With `legacy_divisor` sums are divided by that number instead of the number
    of values in the window.
    """
    columns = [c for c in rolled.columns if c not in ("bs", "t")]
    if legacy_divisor is None:
        means = [F.avg(c).alias(c) for c in columns]
    else:
        means = [(F.sum(c) / F.lit(legacy_divisor)).alias(c) for c in columns]
    return rolled.where(F.col("t").between(t_from, t_to)).groupBy("bs").agg(*means)


def feature_vectors(summary: DataFrame) -> DataFrame:
    """One array of doubles per station, for export: `bs, features`."""
    columns = [c for c in summary.columns if c != "bs"]
    return summary.select("bs", F.array(*(F.col(c).cast("double") for c in columns)).alias("features"))
