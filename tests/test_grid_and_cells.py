from datetime import date

import pytest
from pyspark.sql import functions as F
from rows import bucket, frame

from cellpulse.functions import cells, geo, measures
from cellpulse.functions.timegrid import Grid, local_clock_ms

GRID = Grid(start_ms=1_000, width_ms=100, n=5)


@pytest.mark.parametrize("start_ms", [-5, 0, 1_000, 1_001, 1_100, 1_101, 1_200, 1_499, 1_500, 1_600])
def test_bucket_edges(spark, start_ms):
    placed = GRID.assign(frame(spark, [{"start_ms": start_ms}])).select("t").collect()
    expected = bucket(start_ms, GRID)
    assert [r.t for r in placed] == ([] if expected is None else [expected])


def test_grid_leaves_out_a_short_tail():
    assert Grid.between(0, 1_050, 100) == Grid(0, 100, 10)


def test_local_clock_follows_daylight_saving():
    assert local_clock_ms("08:30", date(2014, 7, 1)) == (12 * 60 + 30) * 60_000
    assert local_clock_ms("08:30", date(2014, 1, 6)) == (13 * 60 + 30) * 60_000
    assert local_clock_ms("22:00", date(2014, 7, 1)) == 26 * 3_600_000


def test_minutes_and_labels(spark):
    grid = Grid(start_ms=0, width_ms=90_000, n=4)
    row = spark.range(1).select(
        grid.minutes(F.lit(3)).alias("m"), grid.upper_ms(F.lit(3)).alias("u")
    ).first()
    assert (row.m, row.u) == (4, 270_000)


def test_station_ids(spark):
    data = [("311:480:15fdf02", "311:480:15fdf", 90_079), ("", None, None), (None, None, None),
            ("311:480:zzzzz01", "311:480:zzzzz", None), ("311:480:", "311:480:", None)]
    df = spark.createDataFrame([(d[0],) for d in data], "cell string")
    station = cells.station_of(F.col("cell"))
    got = df.select(station.alias("bs"), cells.station_number(station).alias("id")).collect()
    assert [(r.bs, r.id) for r in got] == [d[1:] for d in data]


def test_distance(spark):
    row = spark.range(1).select(
        geo.distance_km(40.0, -74.0, 41.0, -74.0).alias("north"),
        geo.distance_km(40.0, -74.0, 40.0, -74.0).alias("zero"),
        geo.distance_km(0.1, 0.2, 0.1, 0.3, legacy_distance=True).alias("legacy"),
    ).first()
    assert row.north == pytest.approx(111.195, abs=0.01)
    assert row.zero == 0.0
    # On the sphere of radius 63.67 with plain radians.
    import math

    assert row.legacy == pytest.approx(63.67 * 2 * math.asin(math.cos(0.1) * math.sin(0.05)))


def test_measures(spark):
    df = spark.createDataFrame([(5, None), (None, None), (3, 4)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        measures.bler_sum(a, b).alias("s"),
        measures.bler_count(a, b).alias("n"),
        measures.ratio(measures.bler_sum(a, b), measures.bler_count(a, b)).alias("r"),
        measures.fixed(F.lit(0.12345), 4).alias("text"),
    ).collect()
    assert [(r.s, r.n, r.r) for r in got] == [(5, 1, 5.0), (0, 0, 0.0), (7, 2, 3.5)]
    assert got[0].text in ("0.1234", "0.1235")


def test_station_numbers_up_to_a_bigint(spark):
    codes = ["7fffffffffffffff", "0000000007fffffffffffffff", "8000000000000000", "fffffffffffffffff", "xyz", "a", ""]
    df = spark.createDataFrame([(f"1:2:{c}",) for c in codes] + [(None,)], "bs string")
    got = df.select(cells.station_number(df.bs).alias("n"), cells.unreadable_station(df.bs).alias("odd")).collect()
    most = (1 << 63) - 1
    assert [r.n for r in got] == [most, most, None, None, None, 10, None, None]
    assert [r.odd for r in got] == [False, False, True, True, True, False, True, False]
