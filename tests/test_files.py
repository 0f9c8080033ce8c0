"""Text files in, text and tables out."""

import gzip
from datetime import date

import pytest
from pyspark.sql import functions as F
from rows import frame

from cellpulse.functions.timegrid import local_clock_ms
from cellpulse.operators import groups, timeline
from cellpulse.operators.mobility import neighbor_edges
from cellpulse.schema import FIELD_POSITION
from cellpulse.sinks import tables
from cellpulse.sources import records, sites

DAY = date(2014, 7, 1)


def line(fields: dict, measured: tuple = ()) -> str:
    values = [""] * 255
    for name, value in fields.items():
        values[FIELD_POSITION[name] - 1] = str(value)
    for i, value in enumerate(measured):
        values[250 + i] = value
    return ";".join(values)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("records")
    files = {
        "a.08-30.MMEpcmd.-0400.gz": [
            line({"proc_id": 16, "start_ms": 100, "rec_seq": 1, "imsi": "u1", "cfc": "",
                  "cur_cell": "311:480:15fdf01", "ul_init_bler": 7}),
            line({"proc_id": 11, "start_ms": 200, "rec_seq": 2, "imsi": "", "cfc": 2,
                  "cur_cell": ""}, ("[", "311:480:15fe001", "-70", "]")),
        ],
        "a.08-31.MMEpcmd.-0400.gz": [
            line({"proc_id": 45, "start_ms": 300, "rec_seq": 3, "imsi": "u2", "mob_trigger": 1,
                  "source_cell": "311:480:15fdf01", "target_cell": "311:480:15fe002"},
                 ("311:480:15fe301",)),
        ],
        "a.0832.MMEpcmd.-0400.gz": [line({"proc_id": 1, "start_ms": 400, "rec_seq": 4, "imsi": "u3"})],
        "a.08-30.other.gz": ["decoy"],
    }
    for name, lines in files.items():
        with gzip.open(path / name, "wt") as f:
            f.write("\n".join(lines) + "\n")
    return str(path)


def test_scan(spark, folder):
    rows = {r.rec_seq: r for r in records.read_records(spark, folder, measured=True).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert (rows[1].bs, rows[1].cfc, rows[1].ul_init_bler) == ("311:480:15fdf", None, 7)
    assert (rows[2].bs, rows[2].imsi, rows[2].cfc) == (None, "", 2)
    assert rows[2].measured == ["311:480:15fe0"]
    assert (rows[3].source_bs, rows[3].target_bs) == ("311:480:15fdf", "311:480:15fe0")
    # A measured list counts only in a line with a bracket.
    assert rows[3].measured == []


def test_both_readers_agree(spark, folder):
    whole = records.read_records(spark, folder, measured=True).drop("measured")
    fields = records.read_records(spark, folder).select(whole.columns)
    assert fields.dtypes == whole.dtypes
    assert whole.exceptAll(fields).count() == fields.exceptAll(whole).count() == 0


def test_reader_takes_only_the_fields_it_needs(spark, folder):
    plan = records.read_records(spark, folder).select("bs", "imsi")._jdf.queryExecution()
    assert "ReadSchema: struct<_18:string,_21:string>" in plan.executedPlan().toString()


def test_field_count(spark, folder):
    lines = records.read_lines(spark, folder)
    assert lines.select(F.size(F.split("line", ";", -1)).alias("n")).distinct().first().n == 255


def test_time_range_of_files(spark, folder):
    start = local_clock_ms("08:31", DAY)
    got = records.read_records(spark, folder, start, start + 60_000, DAY)
    assert [r.rec_seq for r in got.collect()] == [3]
    both = records.read_records(spark, folder, start, start + 120_000, DAY)
    assert sorted(r.rec_seq for r in both.collect()) == [3, 4]
    with pytest.raises(ValueError):
        records.read_records(spark, folder, start)


def test_group_by_any_cell_of_a_record(spark, folder):
    group = spark.createDataFrame([(0x15FE0,)], "bs_id bigint")
    parsed = records.read_records(spark, folder, measured=True)
    assert sorted(r.rec_seq for r in groups.any_cell_in_group(parsed, group).collect()) == [2, 3]
    large = group.unionByName(spark.range(1 << 40, (1 << 40) + 500).withColumnRenamed("id", "bs_id"))
    plan = groups.any_cell_in_group(parsed, large)
    assert sorted(r.rec_seq for r in plan.collect()) == [2, 3]
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()


def test_side_files(spark, tmp_path):
    (tmp_path / "sites.csv").write_text(
        "no,latitude,longitude,id,name,extra\n1,40.5,-74.25,90079,one,x\n2,40.75,-74.5,90080,two,y\n"
    )
    got = sites.read_sites(spark, str(tmp_path / "sites.csv")).collect()
    assert [tuple(r) for r in got] == [(90079, 40.5, -74.25, "one"), (90080, 40.75, -74.5, "two")]
    (tmp_path / "group.txt").write_text("90079\n\n90080 \n")
    group = sites.read_group(spark, str(tmp_path / "group.txt"))
    assert sorted(r.bs_id for r in group.collect()) == [90079, 90080]
    (tmp_path / "near.txt").write_text("311:480:15fdf 311:480:15fe0  311:480:15fe1 \n311:480:15fe9 311:480:15fe0\n311:480:15fe0\n")
    edges = sites.read_neighbors(spark, str(tmp_path / "near.txt"))
    assert sorted(map(tuple, edges.collect())) == [
        ("311:480:15fdf", "311:480:15fe0"),
        ("311:480:15fdf", "311:480:15fe1"),
        ("311:480:15fe9", "311:480:15fe0"),
    ]
    own = groups.edges_of_group(edges, group)
    assert {r.bs for r in own.collect()} == {"311:480:15fdf"}
    assert {r.bs for r in groups.relevant_stations(own).collect()} == {
        "311:480:15fdf", "311:480:15fe0", "311:480:15fe1",
    }
    numbered = sites.number_stations(own.select("bs").distinct()).first()
    assert numbered.bs_id == 90079


def test_adjacency_round_trip(spark, tmp_path):
    rows = [{"source_bs": "a", "target_bs": "b"}, {"source_bs": "b", "target_bs": "c"},
            {"source_bs": "a", "target_bs": "a"}]
    edges = neighbor_edges(frame(spark, rows))
    tables.write_adjacency(edges, str(tmp_path / "adjacency"))
    back = sites.read_neighbors(spark, str(tmp_path / "adjacency"))
    pairs = sorted(map(tuple, back.collect()))
    assert pairs == sorted(map(tuple, edges.collect()))
    assert all((n, bs) in pairs for bs, n in pairs)


@pytest.mark.parametrize("spread", [False, True])
def test_landed_records_prune_slots(spark, tmp_path, spread):
    rows = frame(spark, [{"rec_seq": i, "start_ms": i * 1_000, "bs": "s"} for i in range(100)])
    records.land_records(rows, str(tmp_path / "landed"), slot_ms=10_000, spread=spread)
    got = records.read_landed(spark, str(tmp_path / "landed"), 25_000, 41_000, slot_ms=10_000)
    assert sorted(r.rec_seq for r in got.collect()) == list(range(25, 41))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan
    assert "PushedFilters: [IsNotNull(start_ms), GreaterThanOrEqual(start_ms,25000)" in plan


def test_records_by_station(spark, tmp_path):
    rows = frame(spark, [{"rec_seq": i, "start_ms": i, "bs": "hot" if i % 3 else f"s{i % 7}"} for i in range(300)])
    tables.write_by_station(rows, str(tmp_path / "split"))
    folders = {p.name for p in (tmp_path / "split").iterdir() if p.is_dir()}
    assert folders == {"bs=hot"} | {f"bs=s{i}" for i in range(7)}
    assert spark.read.parquet(str(tmp_path / "split")).count() == 300


def test_csv_sink(spark, tmp_path):
    tables.write_table(spark.range(3), str(tmp_path / "out"), "csv", header=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_wide_trace(spark):
    rows = [(1, "a", "A", 0.5, 1.0, 2, 3), (1, "b", "B", 0.7, 9.0, 4, 5), (2, "a", "A", 0.5, 1.0, 6, 7)]
    schema = "minutes int, bs string, descr string, dist_km double, sd double, ue int, bearer int"
    wide = tables.wide_trace(spark.createDataFrame(rows, schema), 3)
    first, second = sorted(wide.collect())
    assert (first.bs_1, first.descr_1, first.bearer_1, first.ue_2, first.dist_km_2) == ("b", "B", 5, 2, 0.5)
    assert (second.bs_1, second.ue_2, second.bs_3) == (None, 6, None)
    assert wide.columns == ["minutes"] + [f"{c}_{r}" for r in (1, 2, 3) for c in tables.WIDE_COLUMNS]


def test_field_text(spark):
    df = spark.createDataFrame([("x;;z",)], "line string")
    assert df.select(timeline.field_text(F.col("line")).alias("s")).first().s == "1: x 2:  3: z "
    dump = timeline.field_dump(df.withColumn("id", F.lit(9)), "id")
    assert [tuple(r) for r in dump.collect()] == [(9, 1, "x"), (9, 2, ""), (9, 3, "z")]
