"""Record files: `;`-separated text, usually gzip, one file per minute."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from cellpulse.functions.cells import measured_stations, station_of
from cellpulse.schema import FIELD_POSITION, FIELD_TYPE, FIRST_MEASURED_FIELD

RECORD_FILES = "*MMEpcmd*"
HOUR_MS = 3_600_000


def file_clock_ms(file_name: Column, day: date, zone: str = "America/New_York") -> Column:
    """Milliseconds from UTC midnight of `day` to the local time in a file name.

    The time is the second dot-separated token, `HH-MM` (any separator) or `HHMM`.
    """
    return clock_ms(F.get(F.split(file_name, r"\."), F.lit(1)), day, zone)


def folder_clock_ms(file_path: Column, day: date, zone: str = "America/New_York") -> Column:
    """The same from a folder `clock=HH-MM` on the way to a file."""
    return clock_ms(F.regexp_extract(file_path, r"/clock=([^/]*)/[^/]*$", 1), day, zone)


def clock_ms(token: Column, day: date, zone: str) -> Column:
    """Milliseconds from UTC midnight of `day` to a local time `HH-MM` or `HHMM`; null if it is none."""
    hour = F.regexp_extract(token, r"^(\d\d)\D?(\d\d)$", 1).try_cast("int")
    minute = F.regexp_extract(token, r"^(\d\d)\D?(\d\d)$", 2).try_cast("int")
    local = F.make_timestamp(
        F.lit(day.year), F.lit(day.month), F.lit(day.day), hour, minute, F.lit(0), F.lit(zone)
    )
    midnight = int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() * 1000)
    return F.unix_millis(local) - F.lit(midnight)


def read_lines(spark: SparkSession, path: str, pattern: str = RECORD_FILES) -> DataFrame:
    """Raw lines with the name of their file: columns `line, file_name`."""
    text = spark.read.option("pathGlobFilter", pattern).text(path)
    return text.select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file_name"))


def _typed(raw: str, name: str) -> str:
    """SQL for a field from its raw text; empty is null, except that `imsi` stays text.

    Records without a device id count together as one device.
    """
    if name == "imsi":
        return f"coalesce({raw}, '') AS {name}"
    if FIELD_TYPE[name] == "string":
        return f"nullif({raw}, '') AS {name}"
    return f"try_cast(trim({raw}) AS {FIELD_TYPE[name]}) AS {name}"


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Typed record columns, station codes and the measured-cell list from raw lines."""
    split = lines.withColumn("_fields", F.split(F.col(column), ";", -1))
    parsed = split.select(
        *(F.expr(_typed(f"get(_fields, {at - 1})", name)) for name, at in FIELD_POSITION.items()),
        measured_stations(F.col(column)).alias("measured"),
    )
    return with_stations(parsed)


def delimited(reader: DataFrameReader | DataStreamReader, pattern: str = RECORD_FILES):
    """A reader set up for the fixed fields of record files, all as text.

    The delimited reader hands over only the fields a query asks for, which a
    split of the whole line cannot.
    """
    schema = ", ".join(f"_{at} string" for at in range(1, FIRST_MEASURED_FIELD))
    return (
        reader.format("csv")
        .schema(schema)
        .options(sep=";", quote="", escape="", header=False, mode="PERMISSIVE")
        .option("pathGlobFilter", pattern)
    )


def typed_fields(raw: DataFrame) -> DataFrame:
    """Typed record columns and station codes from the fields of a delimited reader."""
    return with_stations(
        raw.selectExpr(*(_typed(f"_{at}", name) for name, at in FIELD_POSITION.items()))
    )


def with_stations(records: DataFrame) -> DataFrame:
    """Add the station code of each of the four cell columns."""
    return records.withColumns(
        {
            "bs": station_of(F.col("cur_cell")),
            "prev_bs": station_of(F.col("prev_cell")),
            "source_bs": station_of(F.col("source_cell")),
            "target_bs": station_of(F.col("target_cell")),
        }
    )


def _in_time(
    files: DataFrame, start_ms: int | None, end_ms: int | None, day: date | None, zone: str
) -> DataFrame:
    """Rows of the files whose name time lies in the range; other files are not opened."""
    if start_ms is None and end_ms is None:
        return files
    if day is None:
        raise ValueError("a time range over file names needs the day of the files")
    at = F.coalesce(
        file_clock_ms(F.col("_metadata.file_name"), day, zone),
        folder_clock_ms(F.col("_metadata.file_path"), day, zone),
    )
    if start_ms is not None:
        files = files.where(at >= F.lit(start_ms))
    if end_ms is not None:
        files = files.where(at < F.lit(end_ms))
    return files


def read_records(
    spark: SparkSession,
    path: str,
    start_ms: int | None = None,
    end_ms: int | None = None,
    day: date | None = None,
    zone: str = "America/New_York",
    pattern: str = RECORD_FILES,
    measured: bool = False,
) -> DataFrame:
    """Typed records of all files, or of those whose time lies in `[start_ms, end_ms)`.

    A file's time is in its name, or in the name of a folder `clock=HH-MM`.

    `measured` adds the measured-cell list, which needs the whole line.
    """
    if measured:
        text = spark.read.option("pathGlobFilter", pattern).text(path)
        return parse_lines(_in_time(text, start_ms, end_ms, day, zone), "value")
    raw = delimited(spark.read, pattern).load(path)
    return typed_fields(_in_time(raw, start_ms, end_ms, day, zone))


def land_records(
    records: DataFrame, path: str, slot_ms: int = HOUR_MS, spread: bool = False
) -> None:
    """Write records as parquet partitioned by time slot, so later reads prune by time.

    Record files hold one stretch of time each, so tasks write straight into
    their slots. For rows in no time order, `spread` first range partitions on the
    slot and the time inside it, which cuts a busy slot into several files.
    """
    slotted = records.withColumn(
        "slot", F.floor(F.col("start_ms") / F.lit(slot_ms)).cast("bigint")
    )
    if spread:
        slotted = slotted.repartitionByRange("slot", "start_ms", "rec_seq")
    slotted.write.partitionBy("slot").parquet(path)


def read_landed(
    spark: SparkSession, path: str, start_ms: int, end_ms: int, slot_ms: int = HOUR_MS
) -> DataFrame:
    """Landed records in `[start_ms, end_ms)`: whole slots are pruned, then rows."""
    return (
        spark.read.parquet(path)
        .where(F.col("slot").between(start_ms // slot_ms, (end_ms - 1) // slot_ms))
        .where((F.col("start_ms") >= start_ms) & (F.col("start_ms") < end_ms))
        .drop("slot")
    )


def land_by_device(records: DataFrame, table: str, buckets: int) -> None:
    """Write records as a table bucketed by station and device, sorted in each bucket.

    Reading it (`spark.table`), last records, open ranges and loads per device need no
    shuffle, nor does a join of two such tables on station and device. A station with a
    third of all records is spread by its devices. Use many more buckets than cores.
    """
    (
        records.repartition(buckets, "bs", "imsi")
        .write.bucketBy(buckets, "bs", "imsi")
        .sortBy("bs", "imsi", "start_ms")
        .saveAsTable(table)
    )
