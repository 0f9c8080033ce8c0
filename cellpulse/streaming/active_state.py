"""Active-device state carried across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cellpulse.functions.measures import is_release
from cellpulse.functions.timegrid import Grid
from cellpulse.operators.active import greatest_record, record_found
from cellpulse.schema import RELEASE_PROCEDURES
from cellpulse.streaming.counts import end_ms, labelled, watermarked, with_end_rows, write_end_row


def stream_last_record(records: DataFrame, grid: Grid, delay: str = "10 minutes") -> DataFrame:
    """Whether a device is active at a station after its last record: `bs, imsi, start_ms, proc_id, active`.

    The state is only the greatest (start_ms, proc_id) per station and device, so the order
    in which files arrive does not matter. In update mode every change comes out; in
    append mode each row comes out once, when the watermark passes the grid's end, and the
    state ends with it.
    """
    whole = f"{grid.n * grid.width_ms} milliseconds"
    offset = f"{grid.start_ms % (grid.n * grid.width_ms)} milliseconds"
    newest = (
        watermarked(records, grid, delay)
        .groupBy(F.window("at", whole, whole, offset).alias("span"), "bs", "imsi")
        .agg(*greatest_record())
    )
    return newest.select("bs", "imsi", *record_found()).withColumn(
        "active", ~F.coalesce(is_release(F.col("proc_id")), F.lit(False))
    )


# Parts into which devices are dealt for the state; the same for the life of a checkpoint.
STATE_PARTS = 1024
# Sorts before every procedure id; stands for a missing one.
NO_PROCEDURE = -(1 << 40)

_CHANGES = "bs {bs}, imsi {imsi}, unknown boolean, t int, came int, gone int"
_HELD = (
    "bs array<{bs}>, imsi array<{imsi}>, unknown array<boolean>, t array<int>, "
    "starts array<bigint>, procs array<bigint>"
)
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _carry(grid: Grid, kinds: dict[str, str]):
    """The state function of a part: rows of its devices, the open buckets with their last record.

    A device that is active after its last closed bucket has a row of bucket 0, which
    stands like a record that was no release. Built inside a function with plain values
    only, so that workers get it as a whole.
    """
    start_ms, width_ms, n = grid.start_ms, grid.width_ms, grid.n
    releases = np.array(sorted(RELEASE_PROCEDURES), "int64")
    none = NO_PROCEDURE
    names = ("bs", "imsi", "unknown", "t", "start_ms", "proc_id")
    key = ["int64" if kinds[c] in _WHOLE else "object" for c in ("bs", "imsi")]
    types = (*key, "bool", "int64", "int64", "int64")

    def begins(columns: list[np.ndarray]) -> np.ndarray:
        """Whether a row differs from the one before."""
        found = np.ones(len(columns[0]), "bool")
        found[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return found

    def newest(tables: list[list[np.ndarray]]) -> list[np.ndarray]:
        """The last record of each device and bucket, in order."""
        rows = [np.concatenate(columns) for columns in zip(*tables)]
        order = np.lexsort(rows[::-1])
        rows = [column[order] for column in rows]
        last = np.append(begins(rows[:4])[1:], True) if len(order) else np.zeros(0, "bool")
        return [column[last] for column in rows]

    def carry(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        table = state.get if state.exists else ([],) * len(names)
        held = [np.array(values, kind) for values, kind in zip(table, types)]
        come: list[list[np.ndarray]] = []
        for frame in frames:
            come.append([frame[c].to_numpy().astype(kind) for c, kind in zip(names, types)])
            # What has come is merged when it outgrows what is held, so that no row is sorted often.
            if sum(len(rows[0]) for rows in come) > len(held[0]):
                held, come = newest([held, *come]), []
        if come:
            held = newest([held, *come])
        bs, imsi, unknown, t, _, procs = held
        watermark = state.getCurrentWatermarkMs()
        # A bucket is closed once the watermark has reached its end.
        closed = start_ms + t * width_ms <= watermark
        done = closed | (t == 0)
        release = np.isin(procs, releases)
        first = begins(held[:3])
        was_active = ~first
        was_active[1:] &= ~release[:-1]
        out = closed & (t > 0)
        changes = pd.DataFrame(
            {"bs": bs[out], "imsi": imsi[out], "unknown": unknown[out], "t": t[out],
             "came": (~was_active[out]).astype("int64"), "gone": release[out].astype("int64")}
        )
        grid_end = start_ms + n * width_ms
        # The last closed row of a device that goes on.
        on = done & ~release & (grid_end > watermark)
        on[:-1] &= first[1:] | ~done[1:]
        keep = on | ~done
        if keep.any():
            opened = t[~done]
            timer = start_ms + int(opened.min()) * width_ms if len(opened) else grid_end
            rows = [bs, imsi, unknown, *(np.where(on, x, c) for x, c in zip((0, 0, none), held[3:]))]
            state.update(tuple(column[keep].tolist() for column in rows))
            # A timer runs out when the watermark is past it.
            state.setTimeoutTimestamp(timer - 1)
        elif state.exists:
            state.remove()
        yield changes

    return carry


def stream_activity(records: DataFrame, grid: Grid, delay: str = "10 minutes", parts: int = STATE_PARTS) -> DataFrame:
    """Devices that became active and that ended, per bucket with a record: `bs, imsi, t, came, gone`.

    State per station and device: the last record of each bucket that is still open, at most as
    many as fit into the delay, and whether the device was active after the last closed one. Devices
    are dealt into `parts` by a hash; a part's are taken together, as columns, and their state is
    one row of the store. A timer at the end of a part's first open bucket closes buckets whether
    or not a device sends again; the state ends with a release, or at the end of the grid. A
    checkpoint goes on with the `parts` it began with.
    """
    rows = labelled(records, grid, delay)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("bs", "imsi")}
    # Records without a device id are one device. No column has nulls, so whole numbers stay whole.
    dealt = rows.select(
        F.pmod(F.xxhash64("bs", "imsi"), F.lit(parts)).cast("int").alias("part"), "bs",
        F.coalesce("imsi", F.lit("0").cast(kinds["imsi"])).alias("imsi"), F.col("imsi").isNull().alias("unknown"),
        "t", "start_ms", F.coalesce(F.col("proc_id").cast("bigint"), F.lit(NO_PROCEDURE)).alias("proc_id"), "hi",
    )
    changes = dealt.groupBy("part").applyInPandasWithState(
        _carry(grid, kinds), _CHANGES.format(**kinds), _HELD.format(**kinds), "append", GroupStateTimeout.EventTimeTimeout
    )
    return changes.select("bs", F.when(~F.col("unknown"), F.col("imsi")).alias("imsi"), "t", "came", "gone")


def _loads_so_far(changes: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows `bs, t, came, n, after, before_t` of the buckets closed now, from the stations' levels before.

    `levels` has `bs, t, after`: the last bucket handed out and who was still active behind it.
    """
    counted = changes.groupBy("bs", "t").agg(F.sum("came").alias("came"), F.sum("gone").alias("gone"))
    known = levels.select("bs", "t", F.col("after").alias("came"), F.lit(0).cast("bigint").alias("gone"), F.lit(True).alias("old"))
    # One row per station and closed bucket, and one per station.
    along = Window.partitionBy("bs").orderBy("t")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = counted.withColumn("old", F.lit(False)).unionByName(known)
    return rows.select(
        "bs", "t", "old", "came",
        F.coalesce(F.lag("t").over(along), F.lit(0)).alias("before_t"),
        (F.sum("came").over(upto) - F.sum("gone").over(upto)).alias("after"),
        (F.sum("came").over(upto) - F.sum("gone").over(upto) + F.col("gone")).alias("n"),
    ).where(~F.col("old"))


def run_active_load(records: DataFrame, grid: Grid, delay: str, path: str, checkpoint: str, watch=None) -> DataFrame:
    """Active devices per station and bucket while the records arrive: `bs, t, n`, written below `path`.

    A micro-batch hands out the buckets it closes, those between without a record too, and keeps one
    row per station in a table for the next. Each batch has folders of its own, so
    a batch that is run again after a failure replaces what it wrote. `watch` is called with
    the query when it has ended.
    """
    spark = records.sparkSession
    kind = records.schema["bs"].dataType.simpleString()
    level_schema = f"bs {kind}, t int, after bigint"
    spark.createDataFrame([], level_schema).write.mode("ignore").parquet(f"{path}/levels/batch=-1")

    def write(changes: DataFrame, batch: int) -> None:
        levels = spark.read.schema(level_schema).parquet(f"{path}/levels/batch={batch - 1}")
        changes.persist()
        found = _loads_so_far(changes, levels)
        # Counts hold until the next bucket with a record.
        gaps = F.when(F.col("t") - F.col("before_t") > 1, F.sequence(F.col("before_t") + 1, F.col("t") - 1))
        filled = found.select("bs", F.explode(gaps).alias("t"), (F.col("n") - F.col("came")).alias("n"))
        loads = found.select("bs", "t", "n").unionByName(filled)
        loads.write.mode("overwrite").parquet(f"{path}/loads/batch={batch}")
        newest = found.select("bs", "t", "after").unionByName(levels)
        last = newest.groupBy("bs").agg(F.max_by(F.struct("t", "after"), "t").alias("last"))
        last.select("bs", "last.t", "last.after").write.mode("overwrite").parquet(f"{path}/levels/batch={batch}")
        changes.unpersist()

    query = (
        stream_activity(records, grid, delay).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if watch:
        watch(query)
    return spark.read.schema(f"bs {kind}, t int, n bigint").parquet(f"{path}/loads/batch=*")


def run_active_load_to_end(
    records: DataFrame, grid: Grid, delay_ms: int, path: str, checkpoint: str, end_path: str, watch=None
) -> DataFrame:
    """`run_active_load` over a finished stream: a second run reads one row past the grid and closes all buckets."""
    stream, delay = with_end_rows(records, end_path), f"{delay_ms} milliseconds"
    run_active_load(stream, grid, delay, path, checkpoint, watch)
    write_end_row(records.sparkSession, records.schema, end_path, end_ms(grid, delay_ms))
    return run_active_load(stream, grid, delay, path, checkpoint, watch)
