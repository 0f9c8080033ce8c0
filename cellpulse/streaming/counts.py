"""Streaming ingest and windowed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.functions.measures import count_where, is_attempt, is_failure, is_release
from cellpulse.functions.timegrid import Grid
from cellpulse.sources.records import RECORD_FILES, delimited, typed_fields


def stream_records(
    spark: SparkSession, path: str, files_per_trigger: int = 60, pattern: str = RECORD_FILES
) -> DataFrame:
    """Typed records from record files as they arrive."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return typed_fields(delimited(reader, pattern).load(path))


def _bucketed(records: DataFrame, grid: Grid, delay: str) -> DataFrame:
    """Records of the grid with their bucket as a window, watermarked by record time.

    Spark windows are [lo, hi); a shift by the one millisecond records are counted
    in turns them into the grid's (lo, hi]. Rows before the grid go to its first bucket.
    """
    width = f"{grid.width_ms} milliseconds"
    offset = f"{grid.start_ms % grid.width_ms} milliseconds"
    return watermarked(records, grid, delay).withColumn("span", F.window("at", width, width, offset))


def watermarked(records: DataFrame, grid: Grid, delay: str) -> DataFrame:
    """Records of the grid with the instant before their start as event time `at`.

    The filter on the grid stands above the watermark and names the event time, so rows past
    the grid still move the watermark and close its last bucket.
    """
    start_ms = F.greatest(F.col("start_ms"), F.lit(grid.start_ms + 1))
    timed = records.where(F.col("bs").isNotNull()).withColumn("at", F.timestamp_millis(start_ms - 1))
    return timed.withWatermark("at", delay).where(F.unix_millis("at") < F.lit(grid.end_ms - 1))


def with_end_rows(records: DataFrame, end_path: str) -> DataFrame:
    """A stream of records together with the rows that `write_end_row` puts in a folder."""
    spark = records.sparkSession
    spark.createDataFrame([], records.schema).write.mode("ignore").parquet(end_path)
    ends = spark.readStream.schema(records.schema).parquet(end_path)
    return records.unionByName(ends)


def write_end_row(spark: SparkSession, schema, end_path: str, after_ms: int) -> None:
    """A row that starts at `after_ms`: once it is read, the buckets before it are closed."""
    values = {"bs": F.lit("0"), "start_ms": F.lit(after_ms)}
    row = spark.range(1).select(
        *(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)
    )
    row.write.mode("append").parquet(end_path)


def _bucket_of_span(grid: Grid) -> Column:
    past = F.unix_millis(F.col("span.end")) - F.lit(grid.start_ms)
    return F.call_function("div", past, F.lit(grid.width_ms)).cast("int").alias("t")


def stream_counts(records: DataFrame, grid: Grid, delay: str = "10 minutes") -> DataFrame:
    """Releases, attempts and failures per station and bucket: `bs, t, releases, attempts, failures`.

    A bucket is emitted once the newest record is `delay` past its end; rows that
    come later are dropped.
    """
    attempt = is_attempt(F.col("proc_id"))
    return (
        _bucketed(records, grid, delay)
        .groupBy("span", "bs")
        .agg(
            count_where(is_release(F.col("proc_id"))).alias("releases"),
            count_where(attempt).alias("attempts"),
            count_where(attempt & is_failure(F.col("cfc"))).alias("failures"),
        )
        .select("bs", _bucket_of_span(grid), "releases", "attempts", "failures")
    )


def stream_bearer_load(records: DataFrame, grid: Grid, delay: str = "10 minutes") -> DataFrame:
    """Devices and bearers per station and bucket: `bs, t, ue, bearer`.

    Two chained aggregations: one row per device and bucket first, then per station.
    """
    per_device = (
        _bucketed(records, grid, delay)
        .groupBy("span", "bs", "imsi")
        .agg(count_where(is_release(F.col("proc_id"))).alias("releases"))
    )
    return (
        per_device.groupBy("span", "bs")
        .agg(
            F.count(F.lit(1)).alias("ue"),
            (F.count(F.lit(1)) + F.sum("releases")).alias("bearer"),
        )
        .select("bs", _bucket_of_span(grid), "ue", "bearer")
    )


def labelled(records: DataFrame, grid: Grid, delay: str) -> DataFrame:
    """Records of the grid with their bucket `t`, and its end as event time `hi`.

    All records of a bucket share one event time, so state that is kept by event time
    lasts as long as the bucket is open: until a record has come that is more than `delay`
    (in whole buckets) past its end. Records of closed buckets are late, as are all of
    one bucket or none. Rows past the grid move the watermark and are left out above it.
    """
    start = F.lit(grid.start_ms)
    width = F.lit(grid.width_ms)
    # Past the grid a row must not share the label of the last bucket.
    beyond = start + (F.call_function("div", F.col("start_ms") - start, width) + 1) * width
    inside = grid.inside(F.col("start_ms"))
    bucket = grid.bucket(F.col("start_ms"))
    timed = records.where(F.col("bs").isNotNull() & F.col("start_ms").isNotNull()).withColumns(
        {"t": bucket, "hi": F.timestamp_millis(F.when(inside, grid.upper_ms(bucket)).otherwise(beyond))}
    )
    return timed.withWatermark("hi", f"{delay} {grid.width_ms} milliseconds").where(
        F.unix_millis("hi") <= F.lit(grid.end_ms)
    )


def stream_ue_load(records: DataFrame, grid: Grid, delay: str = "10 minutes") -> DataFrame:
    """Distinct devices per station and bucket: `bs, t, ue`.

    A device is remembered until its bucket closes: its state lives for the delay.
    """
    devices = labelled(records, grid, delay).select("bs", "imsi", "t", "hi")
    return (
        devices.dropDuplicatesWithinWatermark(["bs", "imsi", "hi"])
        .groupBy("hi", "bs", "t")
        .agg(F.count(F.lit(1)).alias("ue"))
        .select("bs", "t", "ue")
    )


def late_rows(progress: list) -> int:
    """Rows that state operators dropped as late, over a query's `recentProgress`."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def most_state_rows(progress: list) -> int:
    """The most rows that all state operators of a query held after a batch."""
    return max((sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in progress), default=0)


def run_to_table(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", watch=None
) -> DataFrame:
    """Process everything available into a parquet table and read that table.

    `watch` is called with the query when it has ended, for its `recentProgress`.
    """
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if watch:
        watch(query)
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)


def end_ms(grid: Grid, delay_ms: int) -> int:
    """A time whose row closes every bucket of a grid, whatever window holds it."""
    return grid.end_ms + delay_ms + 2 * grid.n * grid.width_ms


def run_to_end(
    records: DataFrame, operator, grid: Grid, delay_ms: int, path: str, checkpoint: str, end_path: str
) -> DataFrame:
    """Run `operator(records, grid, delay)` over a finished stream so that every bucket comes out.

    The first run reads the records; the second continues on the same state and reads one
    row past the grid, which closes the buckets that the delay still holds open.
    """
    stream = operator(with_end_rows(records, end_path), grid, f"{delay_ms} milliseconds")
    run_to_table(stream, path, checkpoint)
    write_end_row(records.sparkSession, records.schema, end_path, end_ms(grid, delay_ms))
    return run_to_table(stream, path, checkpoint)
