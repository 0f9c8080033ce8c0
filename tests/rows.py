"""Small record frames and plain-Python restatements of the operators."""

from __future__ import annotations

import random
from collections import defaultdict

from cellpulse.functions.timegrid import Grid

RELEASES = (11, 3)
SCHEMA = (
    "rec_seq bigint, imsi string, bs string, start_ms bigint, proc_id int, cfc int, cfcq string, "
    "scfcq string, ul_init_bler int, ul_res_bler int, prev_bs string, source_bs string, "
    "target_bs string, mob_trigger int, intra_start bigint, intra_status int, x2_start bigint, "
    "x2_status int, s1_start bigint, s1_status int, stop_ms bigint, proc_duration int, "
    "sgw string, cur_cell string"
)
COLUMNS = [part.strip().split()[0] for part in SCHEMA.split(",")]


def frame(spark, rows: list[dict]):
    """Records with the given fields; the others are null."""
    for row in rows:
        unknown = set(row) - set(COLUMNS)
        assert not unknown, unknown
    return spark.createDataFrame([tuple(row.get(c) for c in COLUMNS) for row in rows], SCHEMA)


def skewed_rows(count: int, grid: Grid, stations: int, seed: int = 7) -> list[dict]:
    """Random records in which one device and one station each take a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        device = "hot" if rng.random() < 1 / 3 else f"ue{rng.randrange(12)}"
        station = "s0" if rng.random() < 1 / 3 else f"s{rng.randrange(stations)}"
        rows.append(
            {
                "rec_seq": i,
                "imsi": device,
                "bs": station,
                "start_ms": rng.randrange(-grid.width_ms, grid.end_ms + grid.width_ms),
                "proc_id": rng.choice([1, 16, 15, 45, 11, 3, 11]),
                "cfc": rng.choice([None, 1, 1, 2, 3]),
            }
        )
    return rows


def bucket(start_ms: int, grid: Grid) -> int | None:
    if start_ms >= grid.end_ms:
        return None
    for t in range(1, grid.n + 1):
        if start_ms <= grid.start_ms + t * grid.width_ms:
            return t
    raise AssertionError(start_ms)


def active_sets(rows: list[dict], grid: Grid) -> dict[str, dict[int, set]]:
    """Active devices per station and bucket, by stepping through the buckets."""
    last = {}
    for row in rows:
        t = bucket(row["start_ms"], grid)
        if t is None:
            continue
        key = (row["bs"], t, row["imsi"])
        last[key] = max(last.get(key, (-(10**18), 0)), (row["start_ms"], row["proc_id"]))
    ends = defaultdict(int)
    for bs, t, _ in last:
        ends[bs] = max(ends[bs], t)
    result = {}
    for bs, end in ends.items():
        carried, result[bs] = set(), {0: set()}
        for t in range(1, end + 1):
            here = {i: last[bs, t, i][1] for (b, u, i) in last if b == bs and u == t}
            result[bs][t] = carried | set(here)
            carried = result[bs][t] - {i for i, proc in here.items() if proc in RELEASES}
    return result


def presence_sets(rows: list[dict], grid: Grid) -> dict[str, dict[int, set]]:
    result = defaultdict(lambda: defaultdict(set))
    for row in rows:
        t = bucket(row["start_ms"], grid)
        if t is not None:
            result[row["bs"]][t].add(row["imsi"])
    return result
