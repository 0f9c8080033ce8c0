"""Streams over several micro-batches give the batch results."""

import gzip
import os
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from rows import skewed_rows

from cellpulse.functions.timegrid import Grid
from cellpulse.operators import active, load, quality
from cellpulse.schema import FIELD_POSITION
from cellpulse.sources import events, records
from cellpulse.streaming import active_state, counts

GRID = Grid(start_ms=0, width_ms=60_000, n=30)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """One gz file per stretch of time, as an operator network would write them."""
    path = tmp_path_factory.mktemp("stream")
    rows = sorted(skewed_rows(800, GRID, stations=5), key=lambda r: r["start_ms"])
    for number in range(8):
        name = path / f"a.0{number}-00.MMEpcmd.-0400.gz"
        with gzip.open(name, "wt") as f:
            for row in rows[number * 100 : (number + 1) * 100]:
                values = [""] * 255
                cell = f"311:480:0000{row['bs'][1:]}01"
                for field, value in (row | {"cur_cell": cell}).items():
                    if field in FIELD_POSITION and value is not None:
                        values[FIELD_POSITION[field] - 1] = str(value)
                f.write(";".join(values) + "\n")
    return str(path)


def stream_of(spark, folder):
    return counts.stream_records(spark, folder, files_per_trigger=2)


def rows_of(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def closed(spark, folder, df):
    """The buckets a stream has emitted: those that end before its newest record."""
    named = records.read_records(spark, folder).where("bs IS NOT NULL")
    newest = named.agg({"start_ms": "max"}).first()[0]
    return df.where(f"t * {GRID.width_ms} <= {newest - 1}")


def run(spark, stream, tmp_path):
    return counts.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"))


def test_counts(spark, folder, tmp_path):
    batch = records.read_records(spark, folder)
    expected = quality.failure_rate(batch, GRID).select("bs", "t", "attempts", "failures")
    got = run(spark, counts.stream_counts(stream_of(spark, folder), GRID, "0 seconds"), tmp_path)
    assert rows_of(got.drop("releases")) == rows_of(closed(spark, folder, expected))


def test_distinct_devices(spark, folder, tmp_path):
    expected = load.ue_load(records.read_records(spark, folder), GRID)
    got = run(spark, counts.stream_ue_load(stream_of(spark, folder), GRID, "0 seconds"), tmp_path)
    assert rows_of(got) == rows_of(closed(spark, folder, expected))


def test_bearer_load(spark, folder, tmp_path):
    expected = load.bearer_load(records.read_records(spark, folder), GRID)
    got = run(spark, counts.stream_bearer_load(stream_of(spark, folder), GRID, "0 seconds"), tmp_path)
    assert rows_of(got) == rows_of(closed(spark, folder, expected))


@pytest.mark.parametrize("operator", [counts.stream_bearer_load, counts.stream_ue_load])
@pytest.mark.parametrize("delay, kept", [("90 seconds", 3), ("0 seconds", 2)])
def test_late_rows(spark, tmp_path, delay, kept, operator):
    """A row of bucket 1 after rows of bucket 2 counts only within the delay; late ones are counted."""
    folder = tmp_path / "late"
    folder.mkdir()
    for number, times in enumerate([[10_000, 60_000], [70_000], [71_000], [50_000], [500_000]]):
        name = folder / f"a.0{number}-00.MMEpcmd.-0400.gz"
        with gzip.open(name, "wt") as f:
            for at in times:
                values = [""] * 255
                values[6], values[7], values[17], values[20] = "16", str(at), f"u{at}", "311:480:0000101"
                f.write(";".join(values) + "\n")
        os.utime(name, (number, number))
    stream = counts.stream_records(spark, str(folder), files_per_trigger=1)
    seen = []
    out = operator(stream, GRID, delay)
    got = counts.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "state"), watch=seen.append)
    assert counts.late_rows(seen[0].recentProgress) == 3 - kept
    # 60,000 ms is the last instant of bucket 1.
    assert {r.t: r.ue for r in got.collect()}[1] == kept


def newest_of(spark, folder):
    inside = records.read_records(spark, folder).where(f"start_ms < {GRID.end_ms} AND bs IS NOT NULL")
    best = {}
    for r in inside.collect():
        best[r.bs, r.imsi] = max(best.get((r.bs, r.imsi), (-1, -1)), (r.start_ms, r.proc_id))
    return sorted((p not in (3, 11), b, i, p, s) for (b, i), (s, p) in best.items())


def test_last_records_come_out_at_the_end_of_the_grid(spark, folder, tmp_path):
    got = to_end(spark, folder, active_state.stream_last_record, tmp_path)
    assert rows_of(got) == newest_of(spark, folder)


def test_last_records_in_update_mode(spark, folder):
    stream = active_state.stream_last_record(stream_of(spark, folder), GRID, "30 minutes")
    query = (
        stream.writeStream.outputMode("complete").format("memory").queryName("newest")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert rows_of(spark.table("newest")) == newest_of(spark, folder)


def to_end(spark, folder, operator, tmp_path):
    paths = [str(tmp_path / part) for part in ("out", "state", "end")]
    return counts.run_to_end(stream_of(spark, folder), operator, GRID, 30 * 60_000, *paths)


def test_active_load_comes_out_while_records_arrive(spark, folder, tmp_path):
    """The load of closed buckets is there before the end; with the end it is the batch result."""
    batch = records.read_records(spark, folder)
    expected = {(r.bs, r.t): r.n for r in active.active_load(active.open_ranges(batch, GRID)).collect()}
    paths = [str(tmp_path / part) for part in ("out", "state", "end")]
    progress = []

    def watch(query):
        progress.append(list(query.recentProgress))
        out = spark.read.schema("bs string, t int, n bigint").parquet(paths[0] + "/loads/batch=*")
        early.append({(r.bs, r.t): r.n for r in out.collect()})

    early = []
    got = active_state.run_active_load_to_end(stream_of(spark, folder), GRID, 60_000, *paths, watch)
    assert sorted((r.bs, r.t, r.n) for r in got.collect()) == sorted((*k, n) for k, n in expected.items())
    assert len(early[0]) > len(expected) / 2 and early[0].items() <= expected.items()
    # Rows in order of time are never late; nothing is held once the grid is over.
    assert counts.late_rows(progress[0]) == 0
    assert progress[1][-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_active_state_of_rows_in_any_order(spark, folder, tmp_path):
    """A delay as long as the grid takes files in any order."""
    batch = records.read_records(spark, folder)
    paths = [str(tmp_path / part) for part in ("out", "state", "end")]
    got = active_state.run_active_load_to_end(stream_of(spark, folder), GRID, 30 * 60_000, *paths)
    assert rows_of(got) == rows_of(active.active_load(active.open_ranges(batch, GRID)))


def test_state_of_distinct_devices_lives_as_long_as_the_delay(spark, folder, tmp_path):
    seen = []
    stream = counts.stream_ue_load(stream_of(spark, folder), GRID, "0 seconds")
    got = counts.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"), watch=seen.append)
    batch = load.ue_load(records.read_records(spark, folder), GRID)
    progress = seen[0].recentProgress
    devices = batch.agg({"ue": "sum"}).first()[0]
    # Four batches of a quarter of the time each: no more than one of them, and the bucket before, is held.
    assert counts.most_state_rows(progress) < devices * 0.6
    assert got.count() > 0.9 * batch.count()
    assert counts.late_rows(progress) == 0


@pytest.mark.parametrize("name", ["ue", "bearer"])
def test_every_bucket_comes_out_of_a_finished_stream(spark, folder, tmp_path, name):
    batch = records.read_records(spark, folder)
    operator, expected = {
        "ue": (counts.stream_ue_load, load.ue_load(batch, GRID)),
        "bearer": (counts.stream_bearer_load, load.bearer_load(batch, GRID)),
    }[name]
    assert rows_of(to_end(spark, folder, operator, tmp_path)) == rows_of(expected)


def test_streams_read_a_table_of_several_files(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    read = counts.run_to_table(
        events.event_stream(spark, str(tmp_path)).select("rec_seq"),
        str(tmp_path / "out"), str(tmp_path / "state"),
    )
    assert read.count() == table.count()


def test_activity_state_of_many_devices_lies_in_parts(spark, tmp_path):
    """Far fewer state rows than devices; large ids stay whole, and those without an id are one device."""
    big = 2**60
    rows = spark.range(4_000).selectExpr(
        f"CASE WHEN id % 400 <> 7 THEN {big} + id % 2000 END AS imsi",
        "CAST(5 + id % 3 AS INT) AS bs", f"id * 97 % {GRID.end_ms} AS start_ms",
        "CASE WHEN id % 5 = 0 THEN 11 WHEN id % 7 <> 0 THEN 16 END AS proc_id",
    )
    folder, seen = str(tmp_path / "records"), []
    rows.repartition(4).write.parquet(folder)
    batch = spark.read.parquet(folder)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    paths = [str(tmp_path / part) for part in ("out", "state", "end")]
    operator = active_state.stream_activity
    got = counts.run_to_end(stream, operator, GRID, 30 * 60_000, *paths)
    held = counts.run_to_table(
        operator(stream, GRID, "30 minutes"), str(tmp_path / "out2"), str(tmp_path / "state2"), watch=seen.append
    )
    assert held.count() == 0
    assert 0 < counts.most_state_rows(seen[0].recentProgress) < 2_000
    last = active.last_record(batch, GRID)
    released = F.coalesce(F.col("proc_id").isin(3, 11), F.lit(False))
    before = F.lag(released).over(Window.partitionBy("bs", "imsi").orderBy("t"))
    expected = last.select(
        "bs", "imsi", "t", F.coalesce(before, F.lit(True)).cast("int").alias("came"), released.cast("int").alias("gone")
    )
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, expected.collect()))
