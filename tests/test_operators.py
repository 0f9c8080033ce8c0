"""Edge cases, brute force on skewed rows, and the shape of plans."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from rows import RELEASES, active_sets, bucket, frame, presence_sets, skewed_rows

from cellpulse.functions.timegrid import Grid
from cellpulse.operators import active, failures, features, flow, groups, load, mobility, quality, sets, timeline
from cellpulse.plans import blocks, bounded, masks
from cellpulse.sources import records

GRID = Grid(start_ms=0, width_ms=1_000, n=40)
EDGES = [("s0", "s1"), ("s1", "s0"), ("s0", "s2"), ("s2", "s0"), ("s3", "s1"), ("s4", "gone")]


@pytest.fixture(scope="module")
def rows():
    return skewed_rows(1_500, GRID, stations=6)


@pytest.fixture(scope="module")
def recs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "bs string, n string")


def table(df, keys, values):
    """Rows as a dict from key columns to value columns."""
    got = {}
    for r in df.collect():
        key = tuple(r[k] for k in keys)
        assert key not in got
        got[key] = tuple(r[v] for v in values)
    return got


def call(imsi, bs, t, proc, offset=0):
    return {"imsi": imsi, "bs": bs, "start_ms": (t - 1) * 1_000 + 1 + offset, "proc_id": proc}


# Active devices


def test_active_sets_on_skewed_rows(recs, rows):
    expected = {
        (bs, i, t)
        for bs, series in active_sets(rows, GRID).items()
        for t, devices in series.items()
        for i in devices
    }
    ranges = active.active_intervals(recs, GRID)
    got = [tuple(r) for r in active.active_ues(ranges).collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected


def test_active_counts_on_skewed_rows(recs, rows):
    expected = {
        (bs, t): (len(devices),)
        for bs, series in active_sets(rows, GRID).items()
        for t, devices in series.items()
        if t > 0
    }
    closed = active.active_intervals(recs, GRID, ends=active.series_ends(recs, GRID))
    for ranges in (closed, active.open_ranges(recs, GRID)):
        assert table(active.active_load(ranges), ["bs", "t"], ["n"]) == expected


@pytest.mark.parametrize(
    "calls, expected",
    [
        # A tie in time goes to the higher procedure id: not a release here.
        ([("u", 1, 11), ("u", 1, 16), ("v", 3, 16)], {"u": [1, 2, 3], "v": [3]}),
        # Ends, then comes back.
        ([("u", 1, 11), ("u", 4, 16), ("v", 5, 1)], {"u": [1, 4, 5], "v": [5]}),
        # The series stops at the station's own last bucket.
        ([("u", 2, 16), ("v", 5, 3)], {"u": [2, 3, 4, 5], "v": [5]}),
    ],
)
def test_active_cases(spark, calls, expected):
    df = frame(spark, [call(i, "s", t, p) for i, t, p in calls])
    got = defaultdict(list)
    for r in active.active_ues(active.active_intervals(df, GRID)).collect():
        got[r.imsi].append(r.t)
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_release_then_new_record_in_one_bucket(spark):
    df = frame(spark, [call("u", "s", 1, 11), call("u", "s", 1, 16, 5), call("v", "s", 3, 1)])
    got = active.active_ues(active.active_intervals(df, GRID)).where("imsi = 'u'").collect()
    assert sorted(r.t for r in got) == [1, 2, 3]


def test_series_to_grid_end(spark):
    df = frame(spark, [call("u", "s", 2, 16)])
    ranges = active.active_intervals(df, GRID, to_grid_end=True)
    assert [tuple(r) for r in ranges.collect()] == [("s", "u", 2, GRID.n)]


def test_last_record_of_early_and_missing_values(spark):
    early = call("u", "s", 1, 16)
    early["start_ms"] = -7
    none = {"imsi": "v", "bs": "s", "start_ms": 5}
    got = table(active.last_record(frame(spark, [early, none]), GRID), ["imsi"], ["t", "start_ms", "proc_id"])
    assert got == {("u",): (1, -7, 16), ("v",): (1, 5, None)}


@pytest.mark.parametrize("start", [1, -(1 << 62), -1])
def test_last_record_of_any_procedure_and_start(spark, start):
    procs = [-1, 2_000_000, None, 5, -(1 << 31), (1 << 31) - 1]
    def at(imsi, ms, proc):
        return {"imsi": imsi, "bs": "s", "start_ms": ms, "proc_id": proc}

    rows = [at(f"u{i}", start, p) for i, p in enumerate(procs)]
    rows += [at("both", start, p) for p in procs] + [at("less", start, p) for p in (None, -1)]
    rows += [at("later", start, 1 << 30), at("later", start + 1, None)]
    got = {r.imsi: (r.start_ms, r.proc_id) for r in active.last_record(frame(spark, rows), GRID).collect()}
    want = {f"u{i}": (start, p) for i, p in enumerate(procs)}
    want |= {"both": (start, (1 << 31) - 1), "less": (start, -1), "later": (start + 1, None)}
    assert got == want


def test_mean_active_load(recs, rows):
    sets = active_sets(rows, GRID)
    got = table(active.mean_active_load(recs, GRID), ["t"], ["mean_ue"])
    for t in range(1, GRID.n + 1):
        total = sum(len(series.get(t, ())) for series in sets.values())
        assert got[(t,)][0] == pytest.approx(total / len(sets))


# Flow


def flows(sets, times_of):
    """In, out and pair flows over the edges from sets of devices."""
    known = set(sets)
    result = {}
    for bs in known:
        near = {n for b, n in EDGES if b == bs and n in known}
        for t in times_of(bs):
            before, now = sets[bs].get(t - 1, set()), sets[bs].get(t, set())
            came = sum(len(sets[n].get(t - 1, set()) & now) for n in near)
            pairs_out = sum(len(before & sets[n].get(t, set())) for n in near)
            left = len({i for n in near for i in before & sets[n].get(t, set())})
            result[bs, t] = (came, pairs_out, left, bool(near))
    return result


def test_neighbor_flow_on_skewed_rows(recs, rows, edges):
    sets = active_sets(rows, GRID)
    expected = {
        key: (came, out, came - out)
        for key, (came, out, _, linked) in flows(
            sets, lambda bs: [t for t in sets[bs] if t > 0]
        ).items()
        if linked
    }
    ends = active.series_ends(recs, GRID)
    got = flow.neighbor_flow(active.active_intervals(recs, GRID), edges, ends)
    assert table(got, ["bs", "t"], ["inflow", "outflow", "net"]) == expected


def test_flow_does_not_depend_on_broadcasts(recs, edges, monkeypatch):
    ends = active.series_ends(recs, GRID)
    ranges = active.active_intervals(recs, GRID)
    usual = table(flow.neighbor_flow(ranges, edges, ends), ["bs", "t"], ["inflow", "outflow"])
    monkeypatch.setattr(flow, "broadcast_if_small", lambda df: df.hint("merge"))
    other = table(flow.neighbor_flow(ranges, edges, ends), ["bs", "t"], ["inflow", "outflow"])
    assert other == usual


def test_presence_flow_on_skewed_rows(recs, rows, edges):
    sets = presence_sets(rows, GRID)
    expected = {
        key: (came, left)
        for key, (came, _, left, _) in flows(sets, lambda bs: range(1, GRID.n + 1)).items()
    }
    stations = recs.select("bs").distinct()
    got = flow.dense_presence_flow(flow.presence_flow(recs, GRID, edges), stations, GRID)
    assert table(got, ["bs", "t"], ["inflow", "outflow"]) == expected


def test_flow_without_edges(recs, edges):
    none = edges.where("bs = 'nowhere'")
    ends = active.series_ends(recs, GRID)
    assert flow.neighbor_flow(active.active_intervals(recs, GRID), none, ends).count() == 0
    assert flow.presence_flow(recs, GRID, none).count() == 0


def test_top_sink_ties(spark):
    df = spark.createDataFrame(
        [("b", 1, 2), ("b", 2, -9), ("a", 3, 2), ("a", 1, 0), ("c", 1, -1)], "bs string, t int, net int"
    )
    assert {tuple(r) for r in flow.top_sink_series(df).collect()} == {("a", 3, 2), ("a", 1, 0)}


# Load and quality


def test_bearer_load_on_skewed_rows(recs, rows):
    devices, releases = defaultdict(set), Counter()
    for row in rows:
        t = bucket(row["start_ms"], GRID)
        if t is not None:
            devices[row["bs"], t].add(row["imsi"])
            releases[row["bs"], t] += row["proc_id"] in RELEASES
    expected = {k: (len(v), len(v) + releases[k]) for k, v in devices.items()}
    assert table(load.bearer_load(recs, GRID), ["bs", "t"], ["ue", "bearer"]) == expected


def test_result_does_not_depend_on_partitioning(recs):
    one = table(load.bearer_load(recs.coalesce(1), GRID), ["bs", "t"], ["ue", "bearer"])
    many = table(load.bearer_load(recs.repartition(17), GRID), ["bs", "t"], ["ue", "bearer"])
    assert one == many


def test_active_load_is_at_least_the_load(recs):
    load_of = table(load.ue_load(recs, GRID), ["bs", "t"], ["ue"])
    active_of = table(active.active_load(active.active_intervals(recs, GRID)), ["bs", "t"], ["n"])
    assert all(active_of[k] >= v for k, v in load_of.items())


def test_station_without_records_counts_as_quiet(spark, recs):
    places = spark.createDataFrame(
        [("s0", 40.0, -74.0, "d"), ("silent", 40.0, -74.0, "e")], "bs string, lat double, lon double, descr string"
    )
    table_of = load.bearer_load(recs, GRID)
    dense = load.dense_load(table_of, places, GRID)
    assert dense.where("bs = 'silent' AND ue = 0").count() == GRID.n
    sd = table(load.bs_volatility(dense), ["bs"], ["sd"])
    assert sd[("silent",)] == (0.0,)
    top = load.top_volatile_trace(table_of, places, GRID, k=1)
    assert {r.bs for r in top.collect()} == {"s0"} and top.count() == GRID.n


def test_failure_counts_ignore_missing_codes(spark):
    df = frame(spark, [
        {"bs": "s", "imsi": "u", "start_ms": 1, "proc_id": 16, "cfc": None},
        {"bs": "s", "imsi": "u", "start_ms": 2, "proc_id": 1, "cfc": 2},
        {"bs": "s", "imsi": "u", "start_ms": 3, "proc_id": 45, "cfc": 9},
    ])
    got = quality.failure_rate(df, GRID).first()
    assert (got.attempts, got.failures, got.rate) == (2, 1, 0.5)
    trace = quality.failure_trace(df, GRID).first()
    assert (trace.bearer, trace.attempts, trace.failures) == (1, 2, 1)


def test_rolling_needs_enough_samples(spark):
    rates = spark.createDataFrame([("s", 2, 1.0)], "bs string, t int, rate double")
    grid = Grid(0, 1_000, 6)
    rolled = quality.failure_rate_rolling(rates, rates.select("bs"), grid)
    got = table(rolled, ["t"], ["rate3", "rate5"])
    assert got[(2,)] == (0.0, 0.0)
    assert got[(4,)] == (pytest.approx(1 / 3), 0.0)
    assert got[(5,)] == (0.0, pytest.approx(0.2))


def test_bler_is_a_mean_of_means(spark):
    df = frame(spark, [
        {"bs": "a", "imsi": "u", "start_ms": 1, "ul_init_bler": 10, "ul_res_bler": 30},
        {"bs": "a", "imsi": "u", "start_ms": 2, "ul_init_bler": 20},
        {"bs": "a", "imsi": "v", "start_ms": 3, "ul_res_bler": 40},
        {"bs": "b", "imsi": "v", "start_ms": 3, "ul_res_bler": 80},
        {"bs": "c", "imsi": "v", "start_ms": 3},
    ])
    got = table(quality.bler_mean(df, GRID), ["t"], ["bler"])
    assert got[(1,)][0] == pytest.approx(((0.2 + 0.4) / 2 + 0.8) / 2)
    assert got[(2,)] == (0.0,) and len(got) == GRID.n


def test_composite_cause_keeps_empty_parts(spark):
    df = frame(spark, [{"bs": "s", "cfc": 2, "proc_id": 15, "cfcq": None, "scfcq": "7"}])
    group = spark.createDataFrame([("s",)], "bs string")
    assert [tuple(r) for r in failures.failure_causes(df, group).collect()] == [("15--7", 1)]


def test_counts_come_most_frequent_first(spark):
    df = frame(spark, [{"bs": "s", "cfc": 1, "proc_id": p} for p in (3, 16, 16, 11, 11)])
    group = spark.createDataFrame([("s",)], "bs string")
    assert [tuple(r) for r in failures.proc_counts(df, group).collect()] == [(11, 2), (16, 2), (3, 1)]


# Mobility


def handover(**fields):
    base = {"mob_trigger": 1, "proc_id": 45, "source_bs": "a", "target_bs": "b", "stop_ms": 100,
            "proc_duration": 5, "x2_start": 10, "s1_start": 20, "intra_start": 30}
    return base | fields


@pytest.mark.parametrize(
    "fields, expected",
    [
        ({"x2_status": 0}, [("x2", 90)]),
        ({"s1_status": 0}, [("s1", 80)]),
        ({"x2_status": 0, "s1_status": 0}, [("s1", 80), ("x2", 90)]),
        ({"x2_status": 1, "s1_status": 0}, []),
        ({"x2_status": 0, "s1_status": 1}, [("x2", 90)]),
        ({"target_bs": "a", "intra_status": 0}, [("intra", 70)]),
        ({"target_bs": "a", "intra_status": 0, "x2_status": 1}, [("intra", 70)]),
        ({"target_bs": "a", "intra_status": 2}, []),
        ({"mob_trigger": 3, "proc_id": 36, "cfcq": "100", "x2_status": 0}, [("csfb", 5), ("x2", 90)]),
        ({"mob_trigger": 3, "proc_id": 36, "cfcq": "99", "x2_status": 0}, []),
        ({"mob_trigger": 3, "proc_id": 36, "cfcq": None}, []),
        ({"mob_trigger": None, "x2_status": 0}, []),
        ({"source_bs": None, "x2_status": 0}, []),
    ],
)
def test_handover_durations(spark, fields, expected):
    got = mobility.handover_durations(frame(spark, [handover(**fields)])).collect()
    assert sorted(tuple(r) for r in got) == expected


@pytest.mark.parametrize(
    "fields, kept",
    [
        ({"source_bs": None, "target_bs": None}, True),
        ({"x2_status": 1}, False),
        ({"s1_status": 1}, False),
        ({"x2_status": 0}, True),
        ({"target_bs": "a", "x2_status": 1}, True),
        ({"target_bs": "a", "intra_status": 1}, False),
        ({"mob_trigger": None}, False),
        ({"mob_trigger": 3, "proc_id": 36, "cfcq": "99"}, False),
        ({"mob_trigger": 3, "proc_id": 36, "cfcq": "100"}, True),
        ({"mob_trigger": 3, "proc_id": 35, "cfcq": "99"}, True),
    ],
)
def test_mobility_records(spark, fields, kept):
    df = frame(spark, [handover(**fields)])
    assert (mobility.mobility_records(df).count() == 1) == kept


def test_no_handovers_of_a_type(spark):
    durations = mobility.handover_durations(frame(spark, [handover(x2_status=1)]))
    assert mobility.cdf(durations, "ho_type", "dur").count() == 0


def test_cdf_with_one_hot_value(spark):
    values = [7] * 500 + list(range(-20, 20_000, 37))
    df = spark.createDataFrame([("x2", v) for v in values], "ho_type string, dur bigint")
    got = {r.dur: r.fraction for r in mobility.cdf(df, "ho_type", "dur", block=512).collect()}
    assert set(got) == set(values)
    for value, fraction in got.items():
        assert fraction == sum(v <= value for v in values) / len(values)
    assert max(got.values()) == 1.0


def test_fanout(spark):
    group = spark.createDataFrame([("a",), ("b",)], "bs string")
    df = frame(spark, [
        {"rec_seq": 1, "bs": "z", "source_bs": "a", "target_bs": "b"},
        {"rec_seq": 2, "bs": "z", "source_bs": "a", "target_bs": "z"},
        {"rec_seq": 3, "bs": "a", "source_bs": "y", "target_bs": "z"},
        {"rec_seq": 4, "bs": "a", "source_bs": "a", "target_bs": "a"},
        {"rec_seq": 5, "bs": "b", "source_bs": "a"},
        {"rec_seq": 6, "bs": "z"},
        {"rec_seq": 7},
    ])
    got = sorted((r.rec_seq, r.station) for r in mobility.handover_fanout(df, group).collect())
    assert got == [(1, "a"), (1, "b"), (2, "a"), (5, "b")]


def test_handover_load(spark):
    group = spark.createDataFrame([("a",), ("b",)], "bs string")
    df = frame(spark, [
        {"imsi": "u", "start_ms": 1, "proc_id": 45, "source_bs": "a", "target_bs": "b"},
        {"imsi": "u", "start_ms": 2, "proc_id": 11, "bs": "a"},
    ])
    got = table(mobility.handover_load(df, GRID, group), ["bs", "t"], ["bearer", "in_ho", "out_ho"])
    assert got == {("a", 1): (2, 0, 1), ("b", 1): (1, 1, 0)}
    rows = features.handover_training_rows(df, GRID, group)
    assert set(table(rows, ["bs", "t"], ["arrivals"]).values()) == {(0,)}


# Features


def test_arrivals_on_skewed_rows(recs, rows):
    sets = presence_sets(rows, GRID)
    expected = {}
    for bs, series in sets.items():
        before = None
        for t in sorted(series):
            expected[bs, t] = (0 if before is None else len(series[t] - series[before]),)
            before = t
    assert table(features.ue_arrivals(recs, GRID), ["bs", "t"], ["arrivals"]) == expected


def test_features_split_inside_and_outside(spark):
    # u goes to a neighbour inside and one outside the group at once.
    df = frame(spark, [call("u", "a", 1, 16), call("u", "b", 2, 16), call("u", "x", 2, 16)])
    edges = spark.createDataFrame([("a", "b"), ("a", "x"), ("b", "a")], "bs string, n string")
    group = spark.createDataFrame([("a",), ("b",)], "bs string")
    grid = Grid(0, 60_000, 2)
    moved = df.withColumn("start_ms", F.col("start_ms") * 60)
    got = features.bs_features(moved, grid, group, edges)
    values = table(got, ["bs", "t"], ["load_rate", "net_flow", "outside_flow"])
    assert values == {("a", 1): (1.0, 0.0, 0.0), ("a", 2): (0.0, -1.0, -1.0),
                      ("b", 1): (0.0, 0.0, 0.0), ("b", 2): (1.0, 1.0, 0.0)}
    whole = table(features.group_features(moved, grid, group, edges), ["t"], ["load_rate", "net_flow"])
    assert whole == {(1,): (1.0, 0.0), (2,): (1.0, -1.0)}


def test_rolling_and_summary_options(spark):
    df = spark.createDataFrame(
        [("a", t, float(t * t), float(t)) for t in range(1, 7)],
        "bs string, t int, load_rate double, net_flow double",
    )
    rolled = table(features.feature_rolling(df, (3,)), ["t"], ["load_rate_3", "net_flow_3"])
    assert rolled[(2,)] == (None, None)
    assert rolled[(4,)] == (pytest.approx((4 + 9 + 16) / 3), 3.0)
    legacy = features.feature_rolling(df, (3,), legacy_rolling=True)
    assert table(legacy, ["t"], ["load_rate_3"])[(4,)] == (pytest.approx((16 + 2 * 9) / 3),)
    mean = features.feature_summary(df, 2, 4).first()
    assert mean.net_flow == 3.0
    assert features.feature_summary(df, 2, 4, legacy_divisor=6).first().net_flow == 1.5
    vector = features.feature_vectors(features.feature_summary(df, 2, 4)).first()
    assert list(vector.features) == [pytest.approx(29 / 3), 3.0]


# Blocked windows


@pytest.mark.parametrize("width", [1, 3_000, 10**9])
def test_blocked_windows_equal_plain_ones(recs, rows, width):
    by_device = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r["start_ms"], r["rec_seq"])):
        by_device[row["imsi"]].append(row)
    lagged = {r["rec_seq"]: (p["bs"] if p else None) for rs in by_device.values() for p, r in zip([None, *rs], rs)}
    got = blocks.lag_by_blocks(recs, ["imsi"], ["start_ms", "rec_seq"], "bs", "before", width)
    assert {r.rec_seq: r.before for r in got.collect()} == lagged


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_positions_by_sampled_ranges_equal_a_plain_numbering(spark, recs, rows, partitions):
    by_device = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r["start_ms"], r["rec_seq"])):
        by_device[row["imsi"]].append(row)
    order = {r["rec_seq"]: n for rs in by_device.values() for n, r in enumerate(rs, 1)}
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        placed = timeline.ue_timeline(recs, ["imsi"])
        assert placed.columns == [*recs.columns, "pos"]
        assert {r.rec_seq: r.pos for r in placed.collect()} == order
        # A device without an id, all at one time and with one number, is numbered without gaps.
        same = frame(spark, [{"rec_seq": 1, "start_ms": 5, "bs": f"s{i}"} for i in range(500)])
        assert sorted(r.pos for r in timeline.ue_timeline(same, ["imsi"]).collect()) == list(range(1, 501))
        assert timeline.ue_timeline(recs.limit(0), ["imsi"]).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_timelines_read_their_records_once(spark, tmp_path):
    frame(spark, [{"rec_seq": i, "start_ms": i, "imsi": "a"} for i in range(9)]).write.parquet(str(tmp_path / "recs"))
    plan = timeline.ue_timeline(spark.read.parquet(str(tmp_path / "recs")), ["imsi"])._jdf.queryExecution().toString()
    assert str(tmp_path / "recs") not in plan


def test_blocked_windows_keep_rows_without_a_key(spark):
    df = frame(spark, [{"rec_seq": i, "start_ms": i * 1_000, "bs": f"s{i}"} for i in range(6)])
    placed = timeline.ue_timeline(df, ["cur_cell", "imsi"])
    assert {r.rec_seq: r.pos for r in placed.collect()} == {i: i + 1 for i in range(6)}
    lagged = blocks.lag_by_blocks(df, ["imsi"], ["start_ms", "rec_seq"], "bs", "before", 2_000)
    assert {r.rec_seq: r.before for r in lagged.collect()} == {
        i: f"s{i - 1}" if i else None for i in range(6)
    }


@pytest.mark.parametrize("width", [2_000, 10**9])
def test_a_missing_second_number_sorts_first_in_a_block(spark, width):
    keys = [(0, 5), (0, None), (2_000, None), (4_000, 1), (4_000, -(1 << 63)), (4_001, None), (6_000, 3)]
    df = frame(spark, [{"rec_seq": n, "start_ms": t, "bs": f"{t}/{n}"} for t, n in keys])
    ordered = sorted(keys, key=lambda k: (k[0], k[1] is not None, k[1] or 0))
    wanted = {f"{t}/{n}": p and f"{p[0]}/{p[1]}" for p, (t, n) in zip([None, *ordered], ordered)}
    got = blocks.lag_by_blocks(df, ["imsi"], ["start_ms", "rec_seq"], "bs", "before", width)
    assert {r.bs: r.before for r in got.collect()} == wanted


def test_pages_hold_the_whole_timeline(recs, rows):
    placed = timeline.ue_timeline(recs.select("imsi", "start_ms", "rec_seq"), ["imsi"])
    pages = timeline.ue_timeline_pages(placed, ["imsi"], page_records=50).collect()
    assert max(len(p.recs) for p in pages) <= 50
    assert sum(len(p.recs) for p in pages) == len(rows)
    hot = [r.rec_seq for p in sorted(pages, key=lambda p: p.page) if p.imsi == "hot" for r in p.recs]
    expected = sorted((r["start_ms"], r["rec_seq"]) for r in rows if r["imsi"] == "hot")
    assert hot == [seq for _, seq in expected]


# Joins and plans


def test_group_beyond_the_broadcast_bound(recs, monkeypatch, spark):
    group = spark.createDataFrame([("s0",), ("s1",)], "bs string")
    usual = sorted(r.rec_seq for r in groups.in_group(recs, group).collect())
    monkeypatch.setattr(groups, "broadcast_if_small", lambda df: bounded.broadcast_if_small(df, 1))
    assert sorted(r.rec_seq for r in groups.in_group(recs, group).collect()) == usual


def test_broadcast_is_checked(spark):
    small = bounded.broadcast_if_small(spark.range(3), 3)
    large = bounded.broadcast_if_small(spark.range(4), 3)
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()


def test_no_cross_join_in_the_dense_grid(recs):
    dense = load.dense_load(load.bearer_load(recs, GRID), recs.select("bs"), GRID)
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_event_scan_is_pruned_and_filtered(spark):
    from cellpulse.catalog import QUERIES

    df = QUERIES["ue_load"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(ts," in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,props:string>" in plan


def test_set_operations(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "imsi int")
    b = spark.createDataFrame([(2,), (3,)], "imsi int")
    values = lambda df: sorted(r.imsi for r in df.collect())
    assert values(active.ue_set_union(a, b)) == [1, 2, 3]
    assert values(active.ue_set_except(a, b)) == [1]
    assert values(active.ue_set_intersect(a, b)) == [2]


def test_any_cell_in_group_keeps_rows_without_and_with_the_same_id(spark):
    rows = [(None, "x", None, None, ["g", "z"])] * 6 + [(7, "x", None, None, ["z", "g"])] * 2
    rows += [(None, "g", None, None, None), (8, "x", "g", None, []), (9, "x", None, "y", ["z"]), (None, None, None, None, None)]
    recs = spark.createDataFrame(
        rows, "rec_seq long, bs string, source_bs string, target_bs string, measured array<string>"
    )
    group = spark.createDataFrame([("g",), ("g",), ("q",)], "bs string")
    got = groups.any_cell_in_group(recs, group)
    assert got.columns == recs.columns
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(r) for r in rows[:10])


@pytest.mark.parametrize("max_idle", [None, 0, 2, 7])
@pytest.mark.parametrize("cuts", [[7], [1, 2, 15], [29]])
def test_days_that_hand_over_equal_one_pass(recs, max_idle, cuts):
    whole = active.open_ranges(recs, GRID, max_idle=max_idle)
    closed, carried, after = [], None, 0
    for until in [*cuts, GRID.n]:
        day = bounded.landed(
            active.open_ranges(recs, GRID, max_idle=max_idle, carried=carried, after=after, until=until), "day"
        )
        closed += rows_of_any(day.where("t1 IS NOT NULL"))
        carried, after = active.still_open(day), until
    assert sorted(closed + [(b, i, t, None) for b, i, t in carried.collect()], key=str) == sorted(
        rows_of_any(whole), key=str
    )


def rows_of_any(df):
    return [tuple(r) for r in df.select("bs", "imsi", "t0", "t1").collect()]


def test_idle_devices_end(recs, rows):
    """Stepping through the buckets: a device counts for two more without a record."""
    ranges = active.open_ranges(recs, GRID, max_idle=2)
    ends = active.ends_of_ranges(ranges)
    got = {(r.bs, r.t): r.n for r in active.active_load(active.closed_ranges(ranges, ends)).collect()}
    last = {}
    for r in rows:
        t = bucket(r["start_ms"], GRID)
        if t is not None:
            key = (r["bs"], r["imsi"], t)
            last[key] = max(last.get(key, (-(10**18), 0)), (r["start_ms"], r["proc_id"]))
    stations = {b for b, _, _ in last}
    for b in stations:
        devices = {i for s, i, _ in last if s == b}
        end = max(t for s, _, t in last if s == b)
        for t in range(1, end + 1):
            n = 0
            for i in devices:
                seen = [u for u in range(max(1, t - 2), t + 1) if (b, i, u) in last]
                n += bool(seen) and (seen[-1] == t or last[b, i, seen[-1]][1] not in RELEASES)
            assert got[b, t] == n


# Device sets and landed tables


def test_bitmaps_and_sketches_count_devices(spark, recs, rows):
    present = presence_sets(rows, GRID)
    held = bounded.landed(sets.device_sets(recs, GRID, sets.numbered_devices(recs)), "sets")
    got = {(r.bs, r.t): r for r in sets.set_steps(held).collect()}
    for b, by_time in present.items():
        before = set()
        for t in sorted(by_time):
            now, r = by_time[t], got.pop((b, t))
            assert (r.devices, r.before, r.both, r.either, r.arrived, r.left) == (
                len(now), len(before), len(now & before), len(now | before), len(now - before), len(before - now)
            )
            before = now
    assert not got
    total = {r.bs: r.n for r in sets.set_sizes(sets.united_sets(held, ["bs"]), ["bs"], "n").collect()}
    assert total == {b: len(set.union(*by_time.values())) for b, by_time in present.items()}
    rough = sets.estimated_devices(sets.device_sketches(recs, GRID), ["bs"])
    assert {r.bs: r.devices for r in rough.collect()} == total


def test_sets_take_devices_without_an_id(spark):
    recs = frame(spark, [{"bs": "a", "start_ms": i, "imsi": i % 3 and "x" or None} for i in range(9)])
    held = bounded.landed(sets.device_sets(recs, GRID, sets.numbered_devices(recs)), "sets")
    assert [(r.devices, r.arrived) for r in sets.set_steps(held).collect()] == [(2, 2)]


def test_tables_landed_by_device_need_no_shuffle(spark, recs):
    records.land_by_device(recs.select("bs", "imsi", "start_ms", "proc_id"), "landed_by_device_test", 4)
    try:
        table = spark.table("landed_by_device_test")
        for df in (active.last_record(table, GRID), active.open_ranges(table, GRID)):
            assert "Exchange" not in df._jdf.queryExecution().sparkPlan().toString()
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        # Loads shuffle one row per station and bucket of a task.
        plan = load.bearer_load(table, GRID)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        plain = sorted(map(str, active.open_ranges(recs, GRID).collect()))
        assert sorted(map(str, active.open_ranges(table, GRID).collect())) == plain
    finally:
        spark.sql("DROP TABLE landed_by_device_test")


def shuffles(df, keys="imsi"):
    """Shuffles of rows per device."""
    return df._jdf.queryExecution().executedPlan().toString().count(f"Exchange hashpartitioning({keys}")


def test_flows_and_features_shuffle_seldom(spark, recs, edges):
    """Shuffles of the plan without what was written before; few of them carry rows per device."""
    opened = bounded.landed(active.open_ranges(recs, GRID), "open")
    ends = bounded.checkpointed(active.ends_of_ranges(opened))
    flows = flow.neighbor_flow(active.closed_ranges(opened, ends), edges, ends)
    # The devices' stations, the ranges that meet them, and the window of the meetings.
    assert shuffles(flows) <= 4
    group = spark.createDataFrame([("s0",), ("s1",)], "bs string")
    for operator in (features.bs_features, features.features_with_group):
        assert shuffles(operator(recs, GRID, group, edges), "") < 10


def _most_in_a_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def _moving_devices(spark):
    """300 devices that go round six stations, each a neighbour of all others."""
    ranges = spark.range(300 * 12).selectExpr(
        "concat('s', (id + id div 300) % 6) AS bs", "concat('u', id % 300) AS imsi",
        "CAST(1 + id div 300 AS INT) AS t0", "CAST(1 + id div 300 AS INT) AS t1",
    )
    stations = spark.range(6).selectExpr("concat('s', id) AS bs")
    edges = stations.crossJoin(stations.withColumnRenamed("bs", "n")).where("bs <> n")
    return ranges, edges


def test_ranges_that_fan_out_are_spread_by_what_comes_of_them(spark, monkeypatch):
    monkeypatch.setattr(bounded, "FANNED_ROWS", 400, raising=False)
    ranges, edges = _moving_devices(spark)
    fanned = flow._fanned_out(ranges, edges)
    assert fanned.count() == 300 * 12 * 6
    # 72 rows come of a device.
    assert _most_in_a_task(fanned) < 4 * 400


def test_masks_that_fan_out_are_spread_by_what_comes_of_them(spark, monkeypatch):
    monkeypatch.setattr(bounded, "FANNED_ROWS", 100, raising=False)
    ranges, edges = _moving_devices(spark)
    met = flow._meetings(masks.masks_of_ranges(ranges), edges, None)
    # A device goes to the next station eleven times, and its runs are shorter than the day.
    assert met.agg(F.sum(F.bit_count("came"))).first()[0] == 300 * 11
    assert _most_in_a_task(met) < 4 * 100
