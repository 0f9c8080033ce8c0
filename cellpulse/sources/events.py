"""Record view of an `events` table, used where no record files are at hand.

Every column is a fixed expression of one event, except `prev_bs`, the station
of the device's event before. Stations are decimal ids here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.functions.timegrid import Grid
from cellpulse.plans.blocks import lag_by_blocks
from cellpulse.plans.bounded import checkpointed
from cellpulse.schema import FIELD_POSITION, FIRST_MEASURED_FIELD

EPOCH = "2024-01-01 00:00:00"
# First station id and how many stations the view spreads events over.
FIRST_STATION = 90_000
STATIONS = 20
LINE_FIELDS = 255
# Blocks for the look-back to a device's event before.
LOOKBACK_MS = 600_000

FILES_PER_BATCH = 8

GRID = Grid(start_ms=0, width_ms=21_600_000, n=120)

FALLBACK = "event_type = 'purchase' AND rec_seq % 7 = 0"

IDENTITY = (
    "event_id AS rec_seq",
    f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'{EPOCH}', ts) AS start_ms",
    "user_id AS imsi",
    "event_type",
    "value",
    f"{FIRST_STATION} + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % {STATIONS} AS bs",
)


def _cell(bs: str, sector: str) -> str:
    """SQL for a cell id in the text form of record files."""
    return f"concat('311:480:', lpad(lower(hex({bs})), 5, '0'), lpad({sector}, 2, '0'))"


RECORD = (
    "rec_seq",
    "start_ms",
    "imsi",
    "event_type",
    "bs",
    f"""CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'click' THEN 16
        WHEN event_type = 'view' THEN 45 WHEN {FALLBACK} THEN 36
        WHEN event_type = 'purchase' THEN 15 WHEN rec_seq % 2 = 0 THEN 11 ELSE 3 END AS proc_id""",
    """CASE WHEN rec_seq % 11 = 0 THEN NULL WHEN rec_seq % 5 = 0 THEN CAST(2 + rec_seq % 3 AS INT)
        ELSE 1 END AS cfc""",
    f"""CASE WHEN {FALLBACK} AND rec_seq % 3 = 0 THEN 99 WHEN {FALLBACK} THEN 100
        ELSE CAST(rec_seq % 4 AS INT) END AS cfcq""",
    "CAST(rec_seq % 3 AS INT) AS scfcq",
    "CASE WHEN rec_seq % 3 <> 0 THEN CAST(floor(value) AS INT) % 101 END AS ul_init_bler",
    "CASE WHEN rec_seq % 4 <> 0 THEN CAST(floor(value * 3) AS INT) % 101 END AS ul_res_bler",
    "start_ms + 20 + CAST(floor(value * 10) AS BIGINT) AS stop_ms",
    "10 + rec_seq % 90 AS proc_duration",
    "CASE WHEN rec_seq % 13 <> 0 THEN concat('sgw', imsi % 3) END AS sgw",
    f"{_cell('bs', 'CAST(rec_seq % 3 + 1 AS STRING)')} AS cur_cell",
    "CASE WHEN rec_seq % 4 = 0 THEN array(bs + 1, bs + 3) ELSE CAST(array() AS array<int>) END"
    " AS measured",
)

MOVED = "event_type = 'view' AND prev_bs <> bs"
HANDOVER = (
    "CASE WHEN event_type = 'view' THEN prev_bs END AS source_bs",
    "CASE WHEN event_type = 'view' AND prev_bs IS NOT NULL THEN bs END AS target_bs",
    "CASE WHEN event_type = 'view' THEN 1 WHEN proc_id = 36 THEN 3 END AS mob_trigger",
    "CASE WHEN event_type = 'view' AND prev_bs = bs THEN CAST(rec_seq % 2 AS INT) END"
    " AS intra_status",
    f"CASE WHEN {MOVED} AND rec_seq % 2 = 0 THEN CAST(rec_seq % 5 = 0 AS INT) END AS x2_status",
    f"CASE WHEN {MOVED} AND rec_seq % 2 = 1 THEN CAST(rec_seq % 5 = 0 AS INT) END AS s1_status",
)
HANDOVER_STARTS = tuple(
    f"CASE WHEN {kind}_status IS NOT NULL THEN start_ms END AS {kind}_start"
    for kind in ("intra", "x2", "s1")
)


def event_records(
    spark: SparkSession, sf_dir: str, grid: Grid | None = None, mobility: bool = False
) -> DataFrame:
    """Records derived from `events`; with a grid, later events are cut at the parquet scan.

    `mobility` adds the columns that depend on the device's event before.
    """
    return records_of(spark.read.parquet(f"{sf_dir}/events.parquet"), grid, mobility)


def event_stream(spark: SparkSession, sf_dir: str, grid: Grid | None = None) -> DataFrame:
    """The same records as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH)
    # As a pattern the table may be one file or a folder of files.
    return records_of(reader.parquet(f"{sf_dir}/[e]vents.parquet"), grid)


def write_feed(spark: SparkSession, sf_dir: str, path: str, slices: int) -> None:
    """The events in order of time as files that appear one slice after the other.

    The table is written once, cut into slices of equal time; then each slice is
    appended to the feed, so that a stream meets the files in that order.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    span = GRID.end_ms // slices
    at = F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'{EPOCH}', ts)")
    number = F.least(F.greatest(F.floor(at / span), F.lit(0)), F.lit(slices - 1)).cast("int")
    cut = f"{path}-slices"
    events.withColumn("slice", number).write.partitionBy("slice").parquet(cut)
    read = spark.read.schema(f"{_fields(events)}, slice int").parquet(cut)
    for i in range(slices):
        read.where(F.col("slice") == i).drop("slice").write.mode("append").parquet(path)


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def feed_stream(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Records of a feed written by `write_feed`, as a stream of one file after the other."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return records_of(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)
    )


def records_of(events: DataFrame, grid: Grid | None = None, mobility: bool = False) -> DataFrame:
    """Record view of an events frame, batch or streaming (`mobility` is batch only)."""
    if grid is not None:
        events = events.where(
            f"ts < TIMESTAMP_NTZ'{EPOCH}' + INTERVAL '{grid.end_ms // 1000}' SECOND"
        )
    records = events.selectExpr(*IDENTITY).selectExpr(*RECORD)
    if not mobility:
        return records.drop("event_type")
    linked = lag_by_blocks(
        records, ["imsi"], ["start_ms", "rec_seq"], "bs", "prev_bs", LOOKBACK_MS
    )
    handovers = linked.selectExpr("*", *HANDOVER).selectExpr("*", *HANDOVER_STARTS)
    return handovers.drop("event_type")


def event_sites(spark: SparkSession, sf_dir: str, grid: Grid | None = None) -> DataFrame:
    """Station dimension of the event records: `bs, lat, lon, descr`.

    Computed once into the shared folder; the view maps events to at most
    `STATIONS` stations, so the table is small whatever the size of `events`.
    """
    stations = event_records(spark, sf_dir, grid).select("bs").distinct()
    return checkpointed(
        stations.selectExpr(
            "bs",
            f"40.70D + (bs - {FIRST_STATION}) * 0.01D AS lat",
            f"-74.00D + (bs - {FIRST_STATION}) * 0.01D AS lon",
            "concat('site', bs) AS descr",
        )
    )


def event_group(sites: DataFrame) -> DataFrame:
    """The even-numbered stations."""
    return sites.where(F.col("bs") % 2 == 0).select("bs")


def event_lines(records: DataFrame, *beside: str) -> DataFrame:
    """Record lines of 255 fields for mobility records, as `rec_seq, line` and the columns named.

    One record in four also carries a measured-cell list from field 251 on.
    """
    texts = {name: name for name in FIELD_POSITION if name in records.columns}
    for name in ("prev", "source", "target"):
        station = f"{name}_bs"
        texts[f"{name}_cell"] = f"CASE WHEN {station} IS NOT NULL THEN {_cell(station, '1')} END"
    slots = {FIELD_POSITION[name]: text for name, text in texts.items()}
    measured = ("'['", _cell("bs + 1", "1"), "'-70'", _cell("bs + 3", "2"), "']'")
    for at, text in enumerate(measured, start=FIRST_MEASURED_FIELD - 1):
        slots[at] = f"CASE WHEN rec_seq % 4 = 0 THEN {text} END"
    fields = (
        f"coalesce(CAST({slots[i]} AS STRING), '')" if i in slots else "''"
        for i in range(1, LINE_FIELDS + 1)
    )
    return records.selectExpr("rec_seq", *beside, f"concat_ws(';', {', '.join(fields)}) AS line")
