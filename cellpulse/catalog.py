"""Named queries over the event tables; each maps (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.functions.cells import station_number, station_of
from cellpulse.functions.measures import fixed
from cellpulse.operators import (
    active,
    failures,
    features,
    flow,
    groups,
    inventory,
    load,
    mobility,
    quality,
    sets,
    timeline,
)
from cellpulse.plans.bounded import checkpointed, landed, scratch_path
from cellpulse.sinks import tables
from cellpulse.sources import events, records, sites
from cellpulse.sources.events import GRID
from cellpulse.streaming import active_state, counts

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
# Fixed value: the day record files are named for.
FILE_DAY = date(2024, 1, 1)
PRUNE_FROM_MS = 5 * DAY_MS + 3_600_000
PRUNE_TO_MS = 9 * DAY_MS + 7_200_000
TOP_STATIONS = 15
WINDOW_FROM, WINDOW_TO = 20, 60
MAX_IDLE = 6
BUCKETS = 16
# The feed of the streams: slices of three days, and a delay of as much.
FEED_SLICES, FEED_DELAY_MS = 10, 3 * DAY_MS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the grid, cut at the scan, for queries over its buckets."""
    return events.event_records(spark, sf_dir, GRID)


def _all_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_records(spark, sf_dir)


def _moves(spark: SparkSession, sf_dir: str, grid=None) -> DataFrame:
    return events.event_records(spark, sf_dir, grid, mobility=True)


def _group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_group(events.event_sites(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A neighbour list is a table of its own; compute it once.
    return checkpointed(mobility.neighbor_edges(_moves(spark, sf_dir)))


def _line_files(spark: SparkSession, sf_dir: str) -> str:
    """Record files written from the event records."""
    path = scratch_path(spark, "lines")
    lines = events.event_lines(_moves(spark, sf_dir)).select("line")
    tables.write_table(lines, path, "text", compression="gzip")
    return path


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Sources


@query
def pcmd_scan(spark, sf_dir):
    return records.read_records(spark, _line_files(spark, sf_dir), pattern="*.gz").select(
        "rec_seq", "imsi", "start_ms", "proc_id", "proc_duration", "cfc", "cfcq", "scfcq",
        "cur_cell", "bs", "prev_bs", "source_bs", "target_bs", "sgw", "stop_ms",
        "ul_init_bler", "ul_res_bler", "mob_trigger", "intra_status", "x2_status", "s1_status",
    )


@query
def record_files_by_clock(spark, sf_dir):
    """Records of the files whose time lies in a range; the other files are not opened."""
    path = scratch_path(spark, "clocked")
    lines = events.event_lines(_moves(spark, sf_dir), "start_ms")
    # Local time of the files' day, five hours behind.
    hour = F.pmod(F.floor(F.col("start_ms") / HOUR_MS) - 5, F.lit(24))
    tables.write_record_files(
        lines.withColumn("clock", F.format_string("%02d-00", hour)), path, "clock"
    )
    read = records.read_records(spark, path, 6 * HOUR_MS, 12 * HOUR_MS, FILE_DAY, pattern="*.gz")
    return read.select("rec_seq", "start_ms", "proc_id", "bs")


@query
def time_range_prune(spark, sf_dir):
    path = scratch_path(spark, "landed")
    calls = _calls(spark, sf_dir).select("rec_seq", "start_ms", "bs", "proc_id")
    records.land_records(calls, path, DAY_MS)
    return records.read_landed(spark, path, PRUNE_FROM_MS, PRUNE_TO_MS, DAY_MS)


@query
def bs_dimension(spark, sf_dir):
    path = scratch_path(spark, "sites")
    rows = events.event_sites(spark, sf_dir).select(
        F.lit("s").alias("site_no"), "lat", "lon", F.col("bs").alias("bs_id"), "descr"
    )
    tables.write_table(rows, path, "csv", header=True)
    return _rounded(sites.read_sites(spark, path), "lat", "lon")


@query
def neighbor_list_read(spark, sf_dir):
    path = scratch_path(spark, "neighbors")
    tables.write_adjacency(mobility.neighbor_edges(_moves(spark, sf_dir)), path)
    edges = sites.read_neighbors(spark, path)
    return edges.select(F.col("bs").cast("int").alias("bs"), F.col("n").cast("int").alias("n"))


# Projections


@query
def bs_from_cell(spark, sf_dir):
    return _all_calls(spark, sf_dir).select(
        "rec_seq", "cur_cell", station_of(F.col("cur_cell")).alias("bs")
    )


@query
def bs_decimal_id(spark, sf_dir):
    return _all_calls(spark, sf_dir).select(
        "rec_seq", station_number(station_of(F.col("cur_cell"))).alias("bs_id")
    )


@query
def time_bucket(spark, sf_dir):
    placed = GRID.assign(_calls(spark, sf_dir))
    return placed.select("rec_seq", "t", GRID.upper_ms(F.col("t")).alias("upper_ms"))


@query
def measured_cells(spark, sf_dir):
    path = _line_files(spark, sf_dir)
    parsed = records.read_records(spark, path, pattern="*.gz", measured=True)
    return parsed.select("rec_seq", F.posexplode("measured").alias("pos", "station"))


@query
def record_field_dump(spark, sf_dir):
    return timeline.field_dump(events.event_lines(_moves(spark, sf_dir)), "rec_seq")


@query
def bs_distance(spark, sf_dir):
    placed = load.site_distances(events.event_sites(spark, sf_dir))
    return _rounded(placed.select("bs", "dist_km"), "dist_km")


@query
def bs_distance_origins(spark, sf_dir):
    """Distances of every station from the two other origins."""
    place = events.event_sites(spark, sf_dir)
    east = load.site_distances(place, load.ORIGIN_EAST).withColumnRenamed("dist_km", "east_km")
    both = load.site_distances(east, load.ORIGIN_NORTH).withColumnRenamed("dist_km", "north_km")
    return _rounded(both.select("bs", "east_km", "north_km"), "east_km", "north_km")


# Load


@query
def bearer_load(spark, sf_dir):
    return load.bearer_load(_calls(spark, sf_dir), GRID)


@query
def ue_load(spark, sf_dir):
    return load.ue_load(_calls(spark, sf_dir), GRID)


@query
def bs_group_filter(spark, sf_dir):
    return groups.in_group(_all_calls(spark, sf_dir), _group(spark, sf_dir)).select("rec_seq", "bs")


@query
def load_with_site(spark, sf_dir):
    placed = load.load_with_site(
        load.bearer_load(_calls(spark, sf_dir), GRID), events.event_sites(spark, sf_dir)
    )
    return _rounded(placed, "dist_km")


@query
def dense_load_grid(spark, sf_dir):
    table = load.bearer_load(_calls(spark, sf_dir), GRID)
    return load.dense_load(table, events.event_sites(spark, sf_dir), GRID)


@query
def load_trace(spark, sf_dir):
    table = load.bearer_load(_calls(spark, sf_dir), GRID)
    return load.load_trace(table, events.event_sites(spark, sf_dir), GRID)


@query
def agg_load(spark, sf_dir):
    return _rounded(load.agg_load(_calls(spark, sf_dir), GRID), "mean_ue")


@query
def bs_volatility(spark, sf_dir):
    return _rounded(load.bs_volatility(dense_load_grid(spark, sf_dir)), "sd")


@query
def top_volatile_trace(spark, sf_dir):
    table = checkpointed(load.bearer_load(_calls(spark, sf_dir), GRID))
    trace = load.top_volatile_trace(
        table, events.event_sites(spark, sf_dir), GRID, TOP_STATIONS
    )
    return _rounded(trace, "dist_km", "sd")


@query
def wide_trace(spark, sf_dir):
    """The busiest stations side by side, by rank."""
    return tables.wide_trace(checkpointed(top_volatile_trace(spark, sf_dir)), TOP_STATIONS)


# Quality and failures


@query
def failure_rate(spark, sf_dir):
    return _rounded(quality.failure_rate(_calls(spark, sf_dir), GRID), "rate")


@query
def failure_trace(spark, sf_dir):
    rows = quality.failure_trace(_calls(spark, sf_dir), GRID, _group(spark, sf_dir))
    return _rounded(rows, "rate")


@query
def failure_rate_rolling(spark, sf_dir):
    rates = quality.failure_rate(_calls(spark, sf_dir), GRID)
    rolled = quality.failure_rate_rolling(rates, events.event_sites(spark, sf_dir), GRID)
    return _rounded(rolled, "rate3", "rate5")


@query
def bler_mean(spark, sf_dir):
    return _rounded(quality.bler_mean(_calls(spark, sf_dir), GRID), "bler")


@query
def bler_by_bs(spark, sf_dir):
    return _rounded(quality.bler_by_bs(_calls(spark, sf_dir), GRID), "bler")


@query
def failed_records(spark, sf_dir):
    return failures.failed_records(_all_calls(spark, sf_dir)).select("rec_seq", "bs", "cfc")


@query
def failed_record_lines(spark, sf_dir):
    """Failed records with every field of their line, numbered."""
    failed = failures.failed_records(_moves(spark, sf_dir))
    lines = events.event_lines(failed)
    return lines.select("rec_seq", timeline.field_text(F.col("line")).alias("fields"))


@query
def proc_counts(spark, sf_dir):
    return failures.proc_counts(_all_calls(spark, sf_dir), _group(spark, sf_dir))


@query
def failure_causes(spark, sf_dir):
    return failures.failure_causes(_all_calls(spark, sf_dir), _group(spark, sf_dir))


# Inventory and mobility


@query
def distinct_bs(spark, sf_dir):
    return inventory.distinct_bs(_moves(spark, sf_dir))


@query
def bs_gateways(spark, sf_dir):
    return inventory.bs_gateways(_all_calls(spark, sf_dir))


@query
def bs_gateway_sets(spark, sf_dir):
    sets = inventory.bs_gateway_sets(inventory.bs_gateways(_all_calls(spark, sf_dir)))
    return sets.select("bs", F.array_join("sgws", " ").alias("sgws"))


@query
def mobility_records(spark, sf_dir):
    return mobility.mobility_records(_moves(spark, sf_dir)).select("rec_seq", "mob_trigger")


@query
def between_stations(spark, sf_dir):
    return mobility.between_stations(_moves(spark, sf_dir)).select(
        "rec_seq", "source_bs", "target_bs"
    )


@query
def handover_durations(spark, sf_dir):
    return mobility.handover_durations(_moves(spark, sf_dir))


@query
def handover_counts(spark, sf_dir):
    return mobility.handover_counts(mobility.handover_durations(_moves(spark, sf_dir)))


@query
def handover_cdf(spark, sf_dir):
    durations = mobility.handover_durations(_moves(spark, sf_dir))
    return _rounded(mobility.cdf(durations, "ho_type", "dur"), "fraction")


@query
def handover_cdf_files(spark, sf_dir):
    path = scratch_path(spark, "cdf")
    tables.write_cdf(handover_cdf(spark, sf_dir), path)
    return spark.read.parquet(path).select("ho_type", "dur", "fraction")


@query
def handover_fanout(spark, sf_dir):
    fanned = mobility.handover_fanout(_moves(spark, sf_dir), _group(spark, sf_dir))
    return fanned.select("rec_seq", "station")


@query
def handover_load(spark, sf_dir):
    return mobility.handover_load(_moves(spark, sf_dir, GRID), GRID, _group(spark, sf_dir))


@query
def neighbor_counts(spark, sf_dir):
    return mobility.neighbor_counts(_moves(spark, sf_dir))


@query
def neighbor_sets(spark, sf_dir):
    sets = mobility.neighbor_sets(mobility.neighbor_edges(_moves(spark, sf_dir)))
    names = F.transform("neighbors", lambda n: n.cast("string"))
    return sets.select("bs", F.array_join(names, " ").alias("neighbors"))


@query
def station_split(spark, sf_dir):
    path = scratch_path(spark, "stations")
    own = groups.in_group(_all_calls(spark, sf_dir), _group(spark, sf_dir))
    tables.write_by_station(own.select("bs", "rec_seq", "start_ms", "proc_id"), path)
    return spark.read.parquet(path).select("bs", "rec_seq", "start_ms", "proc_id")


@query
def any_cell_in_group(spark, sf_dir):
    path = scratch_path(spark, "group")
    chosen = events.event_sites(spark, sf_dir).where(F.col("bs") % 5 == 0)
    tables.write_table(chosen.select(F.col("bs").cast("string")), path, "text")
    group = sites.read_group(spark, path).select(F.col("bs_id").cast("int").alias("bs"))
    return groups.any_cell_in_group(_moves(spark, sf_dir), group).select("rec_seq")


# Active devices


@query
def last_record(spark, sf_dir):
    return active.last_record(_calls(spark, sf_dir), GRID)


@query
def active_ues(spark, sf_dir):
    return active.active_ues(active.active_intervals(_calls(spark, sf_dir), GRID))


@query
def active_load(spark, sf_dir):
    return active.active_load(active.open_ranges(_calls(spark, sf_dir), GRID))


@query
def active_load_by_days(spark, sf_dir):
    """Active load of two halves of the grid; the second reads what the first hands over and its own records."""
    calls, half = _calls(spark, sf_dir), GRID.n // 2
    first = landed(active.open_ranges(calls, GRID, until=half), "first-ranges")
    handed_over = landed(active.still_open(first), "open-ranges")
    second = active.open_ranges(calls, GRID, carried=handed_over, after=half)
    return active.active_load(first.where("t1 IS NOT NULL").unionByName(second))


@query
def active_load_max_idle(spark, sf_dir):
    """Active load when a device without a record counts for a few buckets only."""
    ranges = landed(active.open_ranges(_calls(spark, sf_dir), GRID, max_idle=MAX_IDLE), "idle-ranges")
    return active.active_load(active.closed_ranges(ranges, active.ends_of_ranges(ranges)))


@query
def cell_active_load(spark, sf_dir):
    ranges = active.open_ranges(_calls(spark, sf_dir), GRID, key="cur_cell")
    return active.active_load(ranges, key="cur_cell")


@query
def mean_active_load(spark, sf_dir):
    return _rounded(active.mean_active_load(_calls(spark, sf_dir), GRID), "mean_ue")


@query
def ue_set_ops(spark, sf_dir):
    calls = GRID.assign(_calls(spark, sf_dir))
    half = GRID.n // 2
    early = calls.where(F.col("t") <= half).select("bs", "imsi")
    late = calls.where(F.col("t") > half).select("bs", "imsi")
    return (
        active.ue_set_union(early, late)
        .withColumn("op", F.lit("union"))
        .unionByName(active.ue_set_except(early, late).withColumn("op", F.lit("except")))
        .unionByName(active.ue_set_intersect(early, late).withColumn("op", F.lit("intersect")))
    )


@query
def last_record_by_device(spark, sf_dir):
    """Last records from a table landed by station and device, without a shuffle."""
    table = f"landed_{uuid.uuid4().hex}"
    records.land_by_device(_calls(spark, sf_dir).select("bs", "imsi", "start_ms", "proc_id"), table, BUCKETS)
    return active.last_record(spark.table(table), GRID)


@query
def device_set_steps(spark, sf_dir):
    """Devices of a station's bucket against those of its bucket before, from bitmaps."""
    calls = _calls(spark, sf_dir)
    return sets.set_steps(landed(sets.device_sets(calls, GRID, sets.numbered_devices(calls)), "device-sets"))


@query
def ue_load_estimates(spark, sf_dir):
    """Devices per station and day from sketches of its buckets, checked against the exact number."""
    calls = _calls(spark, sf_dir)
    day = F.call_function("div", F.col("t") - 1, F.lit(DAY_MS // GRID.width_ms)).cast("int")
    sketches = landed(sets.device_sketches(calls, GRID), "device-sketches").withColumn("day", day)
    exact = GRID.assign(calls).withColumn("day", day).select("bs", "day", "imsi").distinct()
    both = sets.estimated_devices(sketches, ["bs", "day"]).join(
        exact.groupBy("bs", "day").agg(F.count(F.lit(1)).alias("ue")), ["bs", "day"]
    )
    # Four standard errors.
    close = F.abs(F.col("devices") - F.col("ue")) <= 4 * sets.STANDARD_ERROR * F.col("ue")
    return both.select("bs", "day", "ue", close.alias("is_close"))


@query
def ue_timeline(spark, sf_dir):
    placed = timeline.ue_timeline(_all_calls(spark, sf_dir), ["imsi"])
    return placed.select("imsi", "pos", "rec_seq", "start_ms", "proc_id")


@query
def handover_timeline(spark, sf_dir):
    kept = mobility.mobility_records(_moves(spark, sf_dir))
    placed = timeline.ue_timeline(kept, ["cur_cell", "imsi"])
    return placed.select("cur_cell", "imsi", "pos", "rec_seq")


@query
def ue_timeline_pages(spark, sf_dir):
    rows = _all_calls(spark, sf_dir).select("imsi", "start_ms", "rec_seq", "proc_id")
    pages = timeline.ue_timeline_pages(timeline.ue_timeline(rows, ["imsi"]), ["imsi"], 25)
    ids = F.transform("recs", lambda r: r["rec_seq"].cast("string"))
    return pages.select("imsi", "page", F.array_join(ids, " ").alias("rec_seqs"))


# Flow and features


@query
def neighbor_flow(spark, sf_dir):
    # Narrow ranges, written once; the stations' last buckets come from them.
    opened = landed(active.open_ranges(_calls(spark, sf_dir), GRID), "open-ranges")
    ends = checkpointed(active.ends_of_ranges(opened))
    return flow.neighbor_flow(active.closed_ranges(opened, ends), _edges(spark, sf_dir), ends)


@query
def top_sink_series(spark, sf_dir):
    return flow.top_sink_series(checkpointed(neighbor_flow(spark, sf_dir)))


@query
def presence_flow(spark, sf_dir):
    place = events.event_sites(spark, sf_dir)
    flows = flow.presence_flow(
        _calls(spark, sf_dir), GRID, _edges(spark, sf_dir), events.event_group(place)
    )
    return flow.dense_presence_flow(flows, place, GRID)


@query
def ue_arrivals(spark, sf_dir):
    return features.ue_arrivals(_calls(spark, sf_dir), GRID)


@query
def handover_training_rows(spark, sf_dir):
    return features.handover_training_rows(_moves(spark, sf_dir, GRID), GRID, _group(spark, sf_dir))


def _feature_inputs(spark, sf_dir):
    return _calls(spark, sf_dir), GRID, _group(spark, sf_dir), _edges(spark, sf_dir)


@query
def bs_features(spark, sf_dir):
    rows = features.bs_features(*_feature_inputs(spark, sf_dir)).select("bs", "t", *features.FEATURES)
    return _rounded(rows, *features.FEATURES)


@query
def group_features(spark, sf_dir):
    return _rounded(features.group_features(*_feature_inputs(spark, sf_dir)), *features.FEATURES)


def _rolled(spark, sf_dir):
    return features.feature_rolling(features.features_with_group(*_feature_inputs(spark, sf_dir)))


def _feature_columns(df):
    return [c for c in df.columns if c not in ("bs", "t")]


@query
def feature_rolling(spark, sf_dir):
    rolled = _rolled(spark, sf_dir)
    return _rounded(rolled, *_feature_columns(rolled))


@query
def feature_summary(spark, sf_dir):
    summary = features.feature_summary(_rolled(spark, sf_dir), WINDOW_FROM, WINDOW_TO)
    return _rounded(summary, *_feature_columns(summary))


@query
def feature_export(spark, sf_dir):
    """Feature vectors of the stations as text with four decimals."""
    vectors = features.feature_vectors(feature_summary(spark, sf_dir))
    # Adding zero drops the sign of a rounded zero.
    texts = F.transform("features", lambda v: fixed(F.round(v, 4) + F.lit(0.0), 4))
    return vectors.select("bs", F.array_join(texts, " ").alias("features"))


# Streams over a feed in order of time, run to its end. A slice's files may come in any order,
# so the delay is one slice.


def _feed(spark, sf_dir, label):
    path = scratch_path(spark, f"{label}-feed")
    events.write_feed(spark, sf_dir, path, FEED_SLICES)
    return events.feed_stream(spark, sf_dir, path)


def _stream_result(spark, sf_dir, operator, label):
    return counts.run_to_end(
        _feed(spark, sf_dir, label),
        operator,
        GRID,
        FEED_DELAY_MS,
        *(scratch_path(spark, f"{label}-{part}") for part in ("table", "state", "end")),
    )


@query
def stream_counts(spark, sf_dir):
    return _stream_result(spark, sf_dir, counts.stream_counts, "stream-counts")


@query
def stream_ue_load(spark, sf_dir):
    return _stream_result(spark, sf_dir, counts.stream_ue_load, "stream-ue")


@query
def stream_bearer_load(spark, sf_dir):
    return _stream_result(spark, sf_dir, counts.stream_bearer_load, "stream-bearer")


@query
def stream_last_record(spark, sf_dir):
    return _stream_result(spark, sf_dir, active_state.stream_last_record, "stream-last")


@query
def stream_active_state(spark, sf_dir):
    """Per closed bucket, the devices that became active and those whose activity ended."""
    return _stream_result(spark, sf_dir, active_state.stream_activity, "stream-active")


@query
def stream_active_load(spark, sf_dir):
    """Active devices per bucket, handed out while the records arrive."""
    paths = [scratch_path(spark, f"stream-load-{part}") for part in ("table", "state", "end")]
    return active_state.run_active_load_to_end(
        _feed(spark, sf_dir, "stream-load"), GRID, FEED_DELAY_MS, *paths
    )


@query
def stream_record_files(spark, sf_dir):
    """Ingest of record files as a stream."""
    path = _line_files(spark, sf_dir)
    stream = counts.stream_records(spark, path, pattern="*.gz").select(
        "rec_seq", "imsi", "start_ms", "proc_id", "cfc", "bs", "source_bs", "target_bs"
    )
    return counts.run_to_table(
        stream, scratch_path(spark, "ingest-table"), scratch_path(spark, "ingest-state")
    )
