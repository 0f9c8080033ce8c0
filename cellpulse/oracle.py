"""Independent SQL for every catalog query, over the same event tables.

Each text is complete: the record view is a chain of common table expressions
in front of the query.
"""

from __future__ import annotations

from cellpulse.schema import FIELD_POSITION

# Fixed values of the record view: six-hour buckets from 2024-01-01, 120 of them.
WIDTH_MS = 21_600_000
BUCKETS = 120
MINUTES = 360
DAY_MS = 86_400_000

VIEW = f"""
WITH ev AS (
  SELECT event_id AS rec_seq,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS start_ms,
         user_id AS imsi, event_type, value,
         CAST(90000 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 20 AS INTEGER) AS bs
  FROM events),
linked AS (
  SELECT *, lag(bs) OVER (PARTITION BY imsi ORDER BY start_ms, rec_seq) AS prev_bs FROM ev),
coded AS (
  SELECT rec_seq, start_ms, imsi, event_type, bs, prev_bs,
    CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'click' THEN 16
         WHEN event_type = 'view' THEN 45
         WHEN event_type = 'purchase' AND rec_seq % 7 = 0 THEN 36
         WHEN event_type = 'purchase' THEN 15
         WHEN rec_seq % 2 = 0 THEN 11 ELSE 3 END AS proc_id,
    CASE WHEN rec_seq % 11 = 0 THEN NULL WHEN rec_seq % 5 = 0 THEN CAST(2 + rec_seq % 3 AS INTEGER)
         ELSE 1 END AS cfc,
    CASE WHEN event_type = 'purchase' AND rec_seq % 7 = 0 AND rec_seq % 3 = 0 THEN 99
         WHEN event_type = 'purchase' AND rec_seq % 7 = 0 THEN 100
         ELSE CAST(rec_seq % 4 AS INTEGER) END AS cfcq,
    CAST(rec_seq % 3 AS INTEGER) AS scfcq,
    CASE WHEN rec_seq % 3 <> 0 THEN CAST(floor(value) AS INTEGER) % 101 END AS ul_init_bler,
    CASE WHEN rec_seq % 4 <> 0 THEN CAST(floor(value * 3) AS INTEGER) % 101 END AS ul_res_bler,
    start_ms + 20 + CAST(floor(value * 10) AS BIGINT) AS stop_ms,
    10 + rec_seq % 90 AS proc_duration,
    CASE WHEN rec_seq % 13 <> 0 THEN 'sgw' || CAST(imsi % 3 AS VARCHAR) END AS sgw,
    printf('311:480:%05x', bs) || '0' || CAST(rec_seq % 3 + 1 AS VARCHAR) AS cur_cell
  FROM linked),
rec AS (
  SELECT *,
    CASE WHEN event_type = 'view' THEN prev_bs END AS source_bs,
    CASE WHEN event_type = 'view' AND prev_bs IS NOT NULL THEN bs END AS target_bs,
    CASE WHEN event_type = 'view' THEN 1 WHEN proc_id = 36 THEN 3 END AS mob_trigger,
    CASE WHEN event_type = 'view' AND prev_bs = bs THEN CAST(rec_seq % 2 AS INTEGER) END
      AS intra_status,
    CASE WHEN event_type = 'view' AND prev_bs <> bs AND rec_seq % 2 = 0
         THEN CASE WHEN rec_seq % 5 = 0 THEN 1 ELSE 0 END END AS x2_status,
    CASE WHEN event_type = 'view' AND prev_bs <> bs AND rec_seq % 2 = 1
         THEN CASE WHEN rec_seq % 5 = 0 THEN 1 ELSE 0 END END AS s1_status,
    proc_id IN (3, 11) AS is_release, proc_id IN (1, 15, 16) AS is_attempt,
    CAST(greatest(1, (start_ms + {WIDTH_MS - 1}) // {WIDTH_MS}) AS INTEGER) AS t
  FROM coded),
pcmd AS (SELECT * FROM rec WHERE start_ms < {WIDTH_MS * BUCKETS}),
sites AS (
  SELECT bs, CAST(40.70 AS DOUBLE) + (bs - 90000) * CAST(0.01 AS DOUBLE) AS lat,
         CAST(-74.00 AS DOUBLE) + (bs - 90000) * CAST(0.01 AS DOUBLE) AS lon,
         'site' || CAST(bs AS VARCHAR) AS descr
  FROM (SELECT DISTINCT bs FROM rec)),
times AS (SELECT CAST(t AS INTEGER) AS t FROM range(1, {BUCKETS + 1}) r(t)),
grp AS (SELECT bs FROM sites WHERE bs % 2 = 0)
"""

LOAD = """,
load AS (
  SELECT bs, t, count(DISTINCT imsi) AS ue,
         CAST(count(DISTINCT imsi) + count(*) FILTER (WHERE is_release) AS BIGINT) AS bearer
  FROM pcmd GROUP BY bs, t),
dense AS (
  SELECT s.bs, g.t, coalesce(l.ue, 0) AS ue, coalesce(l.bearer, 0) AS bearer
  FROM sites s CROSS JOIN times g LEFT JOIN load l ON l.bs = s.bs AND l.t = g.t),
placed AS (
  SELECT bs, descr, 2 * 6371.0 * asin(sqrt(pow(sin((radians(40.702) - radians(lat)) / 2), 2)
    + cos(radians(lat)) * cos(radians(40.702))
    * pow(sin((radians(-74.065) - radians(lon)) / 2), 2))) AS dist_km
  FROM sites)
"""

RANKED = """,
ranked AS (
  SELECT d.bs, p.descr, p.dist_km, stddev_pop(bearer) AS sd
  FROM dense d JOIN placed p ON p.bs = d.bs GROUP BY d.bs, p.descr, p.dist_km
  ORDER BY sd DESC, p.descr DESC, d.bs DESC, p.dist_km DESC LIMIT 15)
"""

RATES = """,
rates AS (
  SELECT bs, t, attempts, failures,
         CASE WHEN attempts > 0 THEN failures / CAST(attempts AS DOUBLE) ELSE 0.0 END AS rate
  FROM (SELECT bs, t, count(*) FILTER (WHERE is_attempt) AS attempts,
               count(*) FILTER (WHERE is_attempt AND cfc > 1) AS failures
        FROM pcmd GROUP BY bs, t))
"""

HANDOVERS = """,
usable AS (
  SELECT * FROM rec WHERE mob_trigger IS NOT NULL
    AND NOT (mob_trigger = 3 AND proc_id = 36 AND cfcq <> 100)),
durations AS (
  SELECT 'csfb' AS ho_type, proc_duration AS dur FROM usable WHERE mob_trigger = 3 AND proc_id = 36
  UNION ALL SELECT 'intra', stop_ms - start_ms FROM usable
    WHERE source_bs = target_bs AND intra_status = 0
  UNION ALL SELECT 'x2', stop_ms - start_ms FROM usable
    WHERE source_bs <> target_bs AND x2_status = 0
  UNION ALL SELECT 's1', stop_ms - start_ms FROM usable
    WHERE source_bs <> target_bs AND s1_status = 0 AND coalesce(x2_status, 0) = 0)
"""

CDF = HANDOVERS + """,
cdf AS (
  SELECT DISTINCT ho_type, dur,
         round(cume_dist() OVER (PARTITION BY ho_type ORDER BY dur), 9) AS fraction
  FROM durations)
"""

EDGES = """,
edges AS (
  SELECT source_bs AS bs, target_bs AS n FROM rec WHERE source_bs <> target_bs
  UNION SELECT target_bs, source_bs FROM rec WHERE source_bs <> target_bs)
"""

FANOUT = """,
fanned AS (
  SELECT p.*, s.station FROM rec p, LATERAL (VALUES (p.source_bs), (p.target_bs)) s(station)
  WHERE p.source_bs <> p.target_bs
  UNION ALL SELECT p.*, p.bs FROM rec p WHERE p.source_bs IS NULL OR p.target_bs IS NULL),
local AS (SELECT * FROM fanned WHERE station IN (SELECT bs FROM grp))
"""


def _active(key: str) -> str:
    """Active devices row by row, from the last record of each bucket."""
    return f""",
lastrec AS (
  SELECT {key}, imsi, t, start_ms, proc_id FROM (
    SELECT *, row_number() OVER (PARTITION BY {key}, imsi, t
                                 ORDER BY start_ms DESC, proc_id DESC) AS rn FROM pcmd)
  WHERE rn = 1),
series AS (SELECT {key}, max(t) AS last_t FROM pcmd GROUP BY {key}),
ranges AS (
  SELECT r.{key}, r.imsi, r.t AS t0, s.last_t,
         CASE WHEN proc_id IN (3, 11) THEN t
              ELSE coalesce(lead(t) OVER (PARTITION BY r.{key}, r.imsi ORDER BY t) - 1, s.last_t)
         END AS t1
  FROM lastrec r JOIN series s ON s.{key} = r.{key}),
act AS (
  SELECT {key}, imsi, CAST(unnest(range(t0, t1 + 1)) AS INTEGER) AS t FROM ranges),
levels AS (
  SELECT s.{key}, g.t, count(a.imsi) AS n
  FROM series s JOIN times g ON g.t <= s.last_t
  LEFT JOIN act a ON a.{key} = s.{key} AND a.t = g.t
  GROUP BY s.{key}, g.t)
"""


FLOW = _active("bs") + EDGES + """,
came AS (
  SELECT x.bs, x.t, count(*) AS c FROM act x JOIN act y ON y.imsi = x.imsi AND y.t = x.t - 1
  JOIN edges e ON e.bs = x.bs AND e.n = y.bs GROUP BY x.bs, x.t),
went AS (
  SELECT x.bs, x.t + 1 AS t, count(*) AS c FROM act x JOIN act y ON y.imsi = x.imsi AND y.t = x.t + 1
  JOIN edges e ON e.bs = x.bs AND e.n = y.bs GROUP BY x.bs, x.t),
flow AS (
  SELECT s.bs, g.t, coalesce(i.c, 0) AS inflow, coalesce(o.c, 0) AS outflow,
         coalesce(i.c, 0) - coalesce(o.c, 0) AS net
  FROM series s JOIN times g ON g.t <= s.last_t
  LEFT JOIN came i ON i.bs = s.bs AND i.t = g.t
  LEFT JOIN went o ON o.bs = s.bs AND o.t = g.t
  WHERE s.bs IN (SELECT e.bs FROM edges e JOIN series p ON p.bs = e.n))
"""

PRESENCE = EDGES + """,
seen AS (SELECT DISTINCT bs, imsi, t FROM pcmd),
moves_in AS (
  SELECT x.bs, x.t, y.bs AS n FROM seen x JOIN seen y ON y.imsi = x.imsi AND y.t = x.t - 1
  JOIN edges e ON e.bs = x.bs AND e.n = y.bs),
moves_out AS (
  SELECT x.bs, x.t + 1 AS t, x.imsi, y.bs AS n
  FROM seen x JOIN seen y ON y.imsi = x.imsi AND y.t = x.t + 1
  JOIN edges e ON e.bs = x.bs AND e.n = y.bs),
presence AS (
  SELECT s.bs, g.t, coalesce(i.c, 0) AS inflow, coalesce(o.c, 0) AS outflow,
         coalesce(i.x, 0) AS in_outside, coalesce(o.x, 0) AS out_outside
  FROM sites s CROSS JOIN times g
  LEFT JOIN (SELECT bs, t, count(*) AS c, count(*) FILTER (WHERE n NOT IN (SELECT bs FROM grp)) AS x
             FROM moves_in GROUP BY bs, t) i ON i.bs = s.bs AND i.t = g.t
  LEFT JOIN (SELECT bs, t, count(DISTINCT imsi) AS c,
                    count(DISTINCT CASE WHEN n NOT IN (SELECT bs FROM grp) THEN imsi END) AS x
             FROM moves_out GROUP BY bs, t) o ON o.bs = s.bs AND o.t = g.t)
"""

FEATURES = LOAD + PRESENCE + f""",
feats AS (
  SELECT p.bs, p.t, d.bearer / {MINUTES}.0::DOUBLE AS load_rate,
         (p.inflow - p.outflow) / {MINUTES}.0::DOUBLE AS net_flow,
         (p.in_outside - p.out_outside) / {MINUTES}.0::DOUBLE AS outside_flow
  FROM presence p JOIN dense d ON d.bs = p.bs AND d.t = p.t
  WHERE p.bs IN (SELECT bs FROM grp) AND p.bs IN (SELECT bs FROM pcmd)),
whole AS (
  SELECT t, sum(load_rate) AS load_rate, sum(outside_flow) AS net_flow FROM feats GROUP BY t)
"""


def _rolled() -> str:
    columns = ", ".join(
        f"CASE WHEN count(*) OVER (PARTITION BY bs ORDER BY t ROWS {k - 1} PRECEDING) = {k} THEN "
        f"avg({f}) OVER (PARTITION BY bs ORDER BY t ROWS {k - 1} PRECEDING) END AS {f}_{k}"
        for k in (3, 5, 10)
        for f in ("load_rate", "net_flow")
    )
    return FEATURES + f""",
rows_all AS (
  SELECT CAST(bs AS VARCHAR) AS bs, t, load_rate, net_flow FROM feats
  UNION ALL SELECT 'all', t, load_rate, net_flow FROM whole),
rolled AS (SELECT bs, t, load_rate, net_flow, {columns} FROM rows_all)
"""


ROLLED_COLUMNS = ["load_rate", "net_flow"] + [
    f"{f}_{k}" for k in (3, 5, 10) for f in ("load_rate", "net_flow")
]

ARRIVALS = """,
steps AS (
  SELECT bs, t, lag(t) OVER (PARTITION BY bs ORDER BY t) AS prev_t
  FROM (SELECT DISTINCT bs, t FROM people)),
arrived AS (
  SELECT s.bs, s.t, count(*) FILTER (WHERE s.prev_t IS NOT NULL AND NOT EXISTS (
           SELECT 1 FROM people q WHERE q.bs = p.bs AND q.imsi = p.imsi AND q.t = s.prev_t))
         AS arrivals
  FROM people p JOIN steps s ON s.bs = p.bs AND s.t = p.t GROUP BY s.bs, s.t)
"""

HANDOVER_LOAD = FANOUT + f""",
ho_load AS (
  SELECT station AS bs, t,
         CAST(count(DISTINCT imsi) + count(*) FILTER (WHERE is_release) AS BIGINT) AS bearer,
         count(*) FILTER (WHERE target_bs = station AND source_bs IS NOT NULL) AS in_ho,
         count(*) FILTER (WHERE source_bs = station AND target_bs IS NOT NULL) AS out_ho
  FROM local WHERE start_ms < {WIDTH_MS * BUCKETS} GROUP BY station, t)
"""

STATION = "printf('311:480:%05x', {0})"


def _station(column: str, sector: str = "") -> str:
    return f"CASE WHEN {column} IS NOT NULL THEN printf('311:480:%05x', {column}) || '{sector}' END"


def _distance(lat: float, lon: float) -> str:
    return (
        f"2 * 6371.0 * asin(sqrt(pow(sin((radians({lat}) - radians(lat)) / 2), 2)"
        f" + cos(radians(lat)) * cos(radians({lat})) * pow(sin((radians({lon}) - radians(lon)) / 2), 2)))"
    )


def _field_at(position: str) -> str:
    """Text of the field at a position of a record line, null where it is empty."""
    fields = {
        name: f"CAST({name} AS VARCHAR)"
        for name in (
            "proc_id start_ms rec_seq proc_duration cfc cfcq scfcq imsi cur_cell sgw stop_ms "
            "ul_init_bler ul_res_bler intra_status x2_status s1_status mob_trigger"
        ).split()
    }
    for kind in ("intra", "x2", "s1"):
        fields[f"{kind}_start"] = (
            f"CASE WHEN {kind}_status IS NOT NULL THEN CAST(start_ms AS VARCHAR) END"
        )
    for name in ("prev", "source", "target"):
        fields[f"{name}_cell"] = _station(f"{name}_bs", "01")
    values = {FIELD_POSITION[name]: text for name, text in fields.items()}
    measured = ("'['", _station("(bs + 1)", "01"), "'-70'", _station("(bs + 3)", "02"), "']'")
    for at, text in enumerate(measured, start=250):
        values[at] = f"CASE WHEN rec_seq % 4 = 0 THEN {text} END"
    cases = " ".join(f"WHEN {at} THEN {text}" for at, text in sorted(values.items()))
    return f"CASE {position} {cases} END"


def _round(columns: list[str], digits: int = 9) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _per_station_mean(inner: str, value: str, out: str, counted: str) -> str:
    return f"""
SELECT g.t, round(coalesce(m.total, 0) / (SELECT count(DISTINCT bs) FROM pcmd {counted}), 9) AS {out}
FROM times g LEFT JOIN (SELECT t, CAST(sum({value}) AS DOUBLE) AS total FROM ({inner}) GROUP BY t) m
ON m.t = g.t"""


NOT_FALLBACK_FAILED = "NOT (mob_trigger = 3 AND proc_id = 36 AND cfcq <> 100)"
STATUSES_FINE = """CASE WHEN source_bs IS NULL OR target_bs IS NULL THEN TRUE
  WHEN source_bs = target_bs THEN coalesce(intra_status, 0) = 0
  ELSE coalesce(x2_status, 0) = 0 AND coalesce(s1_status, 0) = 0 END"""
MOBILITY = f"mob_trigger IS NOT NULL AND {NOT_FALLBACK_FAILED} AND {STATUSES_FINE}"

PRUNED = f"start_ms >= {5 * DAY_MS + 3_600_000} AND start_ms < {9 * DAY_MS + 7_200_000}"

LAST = f"""{VIEW}
SELECT bs, imsi, start_ms, proc_id, NOT is_release AS active FROM (
  SELECT *, row_number() OVER (PARTITION BY bs, imsi ORDER BY start_ms DESC, proc_id DESC) AS rn
  FROM pcmd) WHERE rn = 1"""

ORACLE: dict[str, str] = {
    "pcmd_scan": f"""{VIEW}
SELECT rec_seq, CAST(imsi AS VARCHAR) AS imsi, start_ms, proc_id,
  CAST(proc_duration AS INTEGER) AS proc_duration, cfc, CAST(cfcq AS VARCHAR) AS cfcq,
  CAST(scfcq AS VARCHAR) AS scfcq, cur_cell, {_station("bs")} AS bs,
  {_station("prev_bs")} AS prev_bs, {_station("source_bs")} AS source_bs,
  {_station("target_bs")} AS target_bs, sgw, stop_ms, ul_init_bler, ul_res_bler, mob_trigger,
  intra_status, x2_status, s1_status FROM rec""",
    "record_files_by_clock": f"""{VIEW}
SELECT rec_seq, start_ms, proc_id, {_station("bs")} AS bs FROM rec
WHERE start_ms % {DAY_MS} // 3600000 BETWEEN 6 AND 11""",
    "time_range_prune": f"{VIEW} SELECT rec_seq, start_ms, bs, proc_id FROM pcmd WHERE {PRUNED}",
    "bs_dimension": f"""{VIEW}
SELECT CAST(bs AS BIGINT) AS bs_id, round(lat, 9) AS lat, round(lon, 9) AS lon, descr FROM sites""",
    "neighbor_list_read": f"{VIEW}{EDGES} SELECT bs, n FROM edges",
    "bs_from_cell": f"{VIEW} SELECT rec_seq, cur_cell, {_station('bs')} AS bs FROM rec",
    "bs_decimal_id": f"{VIEW} SELECT rec_seq, CAST(bs AS BIGINT) AS bs_id FROM rec",
    "time_bucket": f"""{VIEW}
SELECT rec_seq, t, CAST(t AS BIGINT) * {WIDTH_MS} AS upper_ms FROM pcmd""",
    "measured_cells": f"""{VIEW}
SELECT rec_seq, CAST(0 AS INTEGER) AS pos, {_station("(bs + 1)")} AS station FROM rec
WHERE rec_seq % 4 = 0
UNION ALL SELECT rec_seq, 1, {_station("(bs + 3)")} FROM rec WHERE rec_seq % 4 = 0""",
    "record_field_dump": f"""{VIEW}
SELECT rec_seq AS line_id, CAST(r.pos AS INTEGER) AS pos, coalesce({_field_at("r.pos")}, '') AS value
FROM rec, range(1, 256) r(pos)""",
    "failed_record_lines": f"""{VIEW}
SELECT rec_seq, string_agg(r.pos || ': ' || coalesce({_field_at("r.pos")}, '') || ' ', '' ORDER BY r.pos)
  AS fields
FROM rec, range(1, 256) r(pos) WHERE cfc > 1 GROUP BY rec_seq""",
    "bs_distance_origins": f"""{VIEW}
SELECT bs, round({_distance(40.756, -73.846)}, 9) AS east_km,
       round({_distance(40.829, -73.926)}, 9) AS north_km FROM sites""",
    "bs_distance": f"{VIEW}{LOAD} SELECT bs, round(dist_km, 9) AS dist_km FROM placed",
    "bearer_load": f"{VIEW}{LOAD} SELECT bs, t, ue, bearer FROM load",
    "ue_load": f"{VIEW}{LOAD} SELECT bs, t, ue FROM load",
    "bs_group_filter": f"{VIEW} SELECT rec_seq, bs FROM rec WHERE bs IN (SELECT bs FROM grp)",
    "load_with_site": f"""{VIEW}{LOAD}
SELECT l.bs, t, ue, bearer, descr, round(dist_km, 9) AS dist_km
FROM load l JOIN placed p ON p.bs = l.bs""",
    "dense_load_grid": f"{VIEW}{LOAD} SELECT bs, t, ue, bearer FROM dense",
    "load_trace": f"""{VIEW}{LOAD}
SELECT bs, CAST(t AS BIGINT) * {MINUTES} AS minutes, ue, bearer FROM dense""",
    "agg_load": VIEW + LOAD + _per_station_mean("SELECT t, ue FROM load", "ue", "mean_ue", ""),
    "bs_volatility": f"""{VIEW}{LOAD}
SELECT bs, round(stddev_pop(bearer), 9) AS sd FROM dense GROUP BY bs""",
    "top_volatile_trace": f"""{VIEW}{LOAD}{RANKED}
SELECT d.bs, r.descr, round(r.dist_km, 9) AS dist_km, round(r.sd, 9) AS sd,
       CAST(d.t AS BIGINT) * {MINUTES} AS minutes, d.ue, d.bearer
FROM dense d JOIN ranked r ON r.bs = d.bs""",
    "wide_trace": f"""{VIEW}{LOAD}{RANKED},
numbered AS (
  SELECT *, row_number() OVER (ORDER BY sd DESC, descr DESC, bs DESC, dist_km DESC) AS rank FROM ranked),
chosen AS (
  SELECT CAST(d.t AS BIGINT) * {MINUTES} AS minutes, n.rank, d.bs, n.descr, round(n.dist_km, 9) AS dist_km,
         d.bearer, d.ue FROM dense d JOIN numbered n ON n.bs = d.bs)
SELECT minutes, """
    + ", ".join(
        f"max({c}) FILTER (WHERE rank = {r}) AS {c}_{r}"
        for r in range(1, 16)
        for c in ("bs", "descr", "dist_km", "bearer", "ue")
    )
    + " FROM chosen GROUP BY minutes",
    "failure_rate": f"{VIEW}{RATES} SELECT bs, t, attempts, failures, round(rate, 9) AS rate FROM rates",
    "failure_trace": f"""{VIEW}{LOAD}{RATES}
SELECT l.bs, l.t, l.bearer, r.attempts, r.failures, round(r.rate, 9) AS rate
FROM load l JOIN rates r ON r.bs = l.bs AND r.t = l.t WHERE l.bs IN (SELECT bs FROM grp)""",
    "failure_rate_rolling": f"""{VIEW}{RATES},
full_rates AS (
  SELECT s.bs, g.t, coalesce(r.rate, 0.0) AS rate
  FROM sites s CROSS JOIN times g LEFT JOIN rates r ON r.bs = s.bs AND r.t = g.t)
SELECT bs, t, """
    + ", ".join(
        f"round(CASE WHEN t >= {k} THEN avg(rate) OVER "
        f"(PARTITION BY bs ORDER BY t ROWS {k - 1} PRECEDING) ELSE 0.0 END, 9) AS rate{k}"
        for k in (3, 5)
    )
    + " FROM full_rates",
    "bler_mean": VIEW
    + """,
sampled AS (SELECT * FROM pcmd WHERE ul_init_bler IS NOT NULL OR ul_res_bler IS NOT NULL),
per_device AS (
  SELECT bs, t, imsi, sum(coalesce(ul_init_bler, 0) + coalesce(ul_res_bler, 0)) /
    (100.0::DOUBLE * (count(ul_init_bler) + count(ul_res_bler))) AS b
  FROM sampled GROUP BY bs, t, imsi),
per_station AS (SELECT bs, t, avg(b) AS b FROM per_device GROUP BY bs, t)"""
    + _per_station_mean(
        "SELECT t, b FROM per_station",
        "b",
        "bler",
        "WHERE ul_init_bler IS NOT NULL OR ul_res_bler IS NOT NULL",
    ),
    "bler_by_bs": f"""{VIEW}{LOAD}
SELECT l.bs, l.t, l.bearer, round(CASE WHEN b.n > 0 THEN b.total / CAST(b.n AS DOUBLE) ELSE 0.0 END, 9)
  AS bler
FROM load l JOIN (
  SELECT bs, t, sum(coalesce(ul_init_bler, 0) + coalesce(ul_res_bler, 0)) AS total,
         count(ul_init_bler) + count(ul_res_bler) AS n FROM pcmd GROUP BY bs, t) b
ON b.bs = l.bs AND b.t = l.t""",
    "failed_records": f"{VIEW} SELECT rec_seq, bs, cfc FROM rec WHERE cfc > 1",
    "proc_counts": f"""{VIEW}
SELECT proc_id, count(*) AS cnt FROM rec
WHERE cfc IS NOT NULL AND bs IN (SELECT bs FROM grp) GROUP BY proc_id""",
    "failure_causes": f"""{VIEW}
SELECT CAST(proc_id AS VARCHAR) || '-' || CAST(cfcq AS VARCHAR) || '-' || CAST(scfcq AS VARCHAR)
  AS cause, count(*) AS cnt FROM rec
WHERE cfc > 1 AND bs IN (SELECT bs FROM grp) GROUP BY 1""",
    "distinct_bs": f"""{VIEW}
SELECT bs FROM rec UNION SELECT prev_bs FROM rec WHERE prev_bs IS NOT NULL
UNION SELECT source_bs FROM rec WHERE source_bs IS NOT NULL
UNION SELECT target_bs FROM rec WHERE target_bs IS NOT NULL""",
    "bs_gateways": f"{VIEW} SELECT DISTINCT bs, sgw FROM rec WHERE sgw IS NOT NULL",
    "bs_gateway_sets": f"""{VIEW}
SELECT bs, string_agg(DISTINCT sgw, ' ' ORDER BY sgw) AS sgws FROM rec
WHERE sgw IS NOT NULL GROUP BY bs""",
    "mobility_records": f"{VIEW} SELECT rec_seq, mob_trigger FROM rec WHERE {MOBILITY}",
    "between_stations": f"""{VIEW}
SELECT rec_seq, source_bs, target_bs FROM rec WHERE source_bs <> target_bs""",
    "handover_durations": f"{VIEW}{HANDOVERS} SELECT ho_type, dur FROM durations",
    "handover_counts": f"{VIEW}{HANDOVERS} SELECT ho_type, count(*) AS cnt FROM durations GROUP BY 1",
    "handover_cdf": f"{VIEW}{CDF} SELECT ho_type, dur, fraction FROM cdf",
    "handover_cdf_files": f"{VIEW}{CDF} SELECT ho_type, dur, fraction FROM cdf",
    "handover_fanout": f"{VIEW}{FANOUT} SELECT rec_seq, station FROM local",
    "handover_load": f"{VIEW}{HANDOVER_LOAD} SELECT bs, t, bearer, in_ho, out_ho FROM ho_load",
    "neighbor_counts": f"""{VIEW}
SELECT source_bs AS bs, target_bs AS n, count(*) AS cnt FROM rec
WHERE source_bs <> target_bs GROUP BY 1, 2""",
    "neighbor_sets": f"""{VIEW}{EDGES}
SELECT bs, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY n) AS neighbors FROM edges GROUP BY bs""",
    "station_split": f"""{VIEW}
SELECT bs, rec_seq, start_ms, proc_id FROM rec WHERE bs IN (SELECT bs FROM grp)""",
    "any_cell_in_group": f"""{VIEW}
SELECT rec_seq FROM rec WHERE bs % 5 = 0 OR source_bs % 5 = 0 OR target_bs % 5 = 0
  OR (rec_seq % 4 = 0 AND (((bs + 1) % 5 = 0 AND bs + 1 IN (SELECT bs FROM sites))
                        OR ((bs + 3) % 5 = 0 AND bs + 3 IN (SELECT bs FROM sites))))""",
    "last_record": f"""{VIEW}{_active("bs")}
SELECT bs, imsi, t, start_ms, proc_id FROM lastrec""",
    "active_ues": f"{VIEW}{_active('bs')} SELECT bs, imsi, t FROM act",
    "active_load": f"{VIEW}{_active('bs')} SELECT bs, t, n FROM levels",
    "last_record_by_device": f"""{VIEW}{_active("bs")}
SELECT bs, imsi, t, start_ms, proc_id FROM lastrec""",
    "device_set_steps": f"""{VIEW},
held AS (SELECT DISTINCT bs, t, imsi FROM pcmd),
steps AS (SELECT bs, t, lag(t) OVER (PARTITION BY bs ORDER BY t) AS prev_t FROM (SELECT DISTINCT bs, t FROM held)),
sides AS (
  SELECT s.bs, s.t, h.imsi, true AS own FROM steps s JOIN held h ON h.bs = s.bs AND h.t = s.t
  UNION ALL SELECT s.bs, s.t, h.imsi, false FROM steps s JOIN held h ON h.bs = s.bs AND h.t = s.prev_t),
devices AS (SELECT bs, t, imsi, bool_or(own) AS now, bool_or(NOT own) AS earlier FROM sides GROUP BY bs, t, imsi)
SELECT bs, t, count(*) FILTER (WHERE now) AS devices, count(*) FILTER (WHERE earlier) AS before,
       count(*) FILTER (WHERE now AND earlier) AS both, count(*) AS either,
       count(*) FILTER (WHERE NOT earlier) AS arrived, count(*) FILTER (WHERE NOT now) AS "left"
FROM devices GROUP BY bs, t""",
    "ue_load_estimates": f"""{VIEW}
SELECT bs, CAST((t - 1) // 4 AS INTEGER) AS day, count(DISTINCT imsi) AS ue, true AS is_close
FROM pcmd GROUP BY ALL""",
    "active_load_by_days": f"{VIEW}{_active('bs')} SELECT bs, t, n FROM levels",
    "active_load_max_idle": f"""{VIEW}{_active("bs")},
short AS (SELECT bs, imsi, t0, least(t1, t0 + 6) AS t1 FROM ranges)
SELECT s.bs, g.t, count(a.imsi) AS n
FROM series s JOIN times g ON g.t <= s.last_t
LEFT JOIN short a ON a.bs = s.bs AND g.t BETWEEN a.t0 AND a.t1 GROUP BY s.bs, g.t""",
    "cell_active_load": f"{VIEW}{_active('cur_cell')} SELECT cur_cell, t, n FROM levels",
    "mean_active_load": VIEW
    + _active("bs")
    + _per_station_mean("SELECT t, n FROM levels", "n", "mean_ue", ""),
    "ue_set_ops": f"""{VIEW},
early AS (SELECT DISTINCT bs, imsi FROM pcmd WHERE t <= 60),
late AS (SELECT DISTINCT bs, imsi FROM pcmd WHERE t > 60)
SELECT bs, imsi, 'union' AS op FROM (SELECT * FROM early UNION SELECT * FROM late)
UNION ALL SELECT bs, imsi, 'except' FROM (SELECT * FROM early EXCEPT SELECT * FROM late)
UNION ALL SELECT bs, imsi, 'intersect' FROM (SELECT * FROM early INTERSECT SELECT * FROM late)""",
    "ue_timeline": f"""{VIEW}
SELECT imsi, row_number() OVER (PARTITION BY imsi ORDER BY start_ms, rec_seq) AS pos, rec_seq,
       start_ms, proc_id FROM rec""",
    "handover_timeline": f"""{VIEW}
SELECT cur_cell, imsi,
       row_number() OVER (PARTITION BY cur_cell, imsi ORDER BY start_ms, rec_seq) AS pos, rec_seq
FROM rec WHERE {MOBILITY}""",
    "ue_timeline_pages": f"""{VIEW}
SELECT imsi, CAST((pos - 1) // 25 AS BIGINT) AS page,
       string_agg(CAST(rec_seq AS VARCHAR), ' ' ORDER BY pos) AS rec_seqs
FROM (SELECT imsi, rec_seq,
             row_number() OVER (PARTITION BY imsi ORDER BY start_ms, rec_seq) AS pos FROM rec)
GROUP BY 1, 2""",
    "neighbor_flow": f"{VIEW}{FLOW} SELECT bs, t, inflow, outflow, net FROM flow",
    "top_sink_series": f"""{VIEW}{FLOW}
SELECT bs, t, net FROM flow
WHERE bs = (SELECT bs FROM flow WHERE net >= 0 ORDER BY net DESC, bs, t LIMIT 1)""",
    "presence_flow": f"""{VIEW}{PRESENCE}
SELECT bs, t, inflow, outflow, in_outside, out_outside FROM presence""",
    "ue_arrivals": f"""{VIEW},
people AS (SELECT DISTINCT bs, imsi, t FROM pcmd){ARRIVALS} SELECT bs, t, arrivals FROM arrived""",
    "handover_training_rows": f"""{VIEW}{HANDOVER_LOAD},
people AS (SELECT DISTINCT station AS bs, imsi, t FROM local
  WHERE start_ms < {WIDTH_MS * BUCKETS}){ARRIVALS}
SELECT h.bs, h.t, bearer, in_ho, out_ho, arrivals
FROM ho_load h JOIN arrived a ON a.bs = h.bs AND a.t = h.t""",
    "bs_features": f"""{VIEW}{FEATURES}
SELECT bs, t, {_round(["load_rate", "net_flow"])} FROM feats""",
    "group_features": f"""{VIEW}{FEATURES}
SELECT t, {_round(["load_rate", "net_flow"])} FROM whole""",
    "feature_rolling": f"{VIEW}{_rolled()} SELECT bs, t, {_round(ROLLED_COLUMNS)} FROM rolled",
    "feature_summary": f"{VIEW}{_rolled()} SELECT bs, "
    + ", ".join(f"round(avg({c}), 9) AS {c}" for c in ROLLED_COLUMNS)
    + " FROM rolled WHERE t BETWEEN 20 AND 60 GROUP BY bs",
    "stream_counts": f"""{VIEW}
SELECT bs, t, count(*) FILTER (WHERE is_release) AS releases,
       count(*) FILTER (WHERE is_attempt) AS attempts,
       count(*) FILTER (WHERE is_attempt AND cfc > 1) AS failures
FROM pcmd GROUP BY bs, t""",
    "stream_ue_load": f"{VIEW}{LOAD} SELECT bs, t, ue FROM load",
    "stream_bearer_load": f"{VIEW}{LOAD} SELECT bs, t, ue, bearer FROM load",
    "stream_last_record": LAST,
    "stream_active_state": f"""{VIEW}{_active("bs")}
SELECT r.bs, r.imsi, r.t, CAST(p.t1 IS NULL OR p.ended AS INTEGER) AS came,
       CAST(r.proc_id IN (3, 11) AS INTEGER) AS gone
FROM lastrec r LEFT JOIN (
  SELECT bs, imsi, t AS t1, proc_id IN (3, 11) AS ended,
         lead(t) OVER (PARTITION BY bs, imsi ORDER BY t) AS t2 FROM lastrec) p
ON p.bs = r.bs AND p.imsi = r.imsi AND p.t2 = r.t""",
    "stream_active_load": f"{VIEW}{_active('bs')} SELECT bs, t, n FROM levels",
    "stream_record_files": f"""{VIEW}
SELECT rec_seq, CAST(imsi AS VARCHAR) AS imsi, start_ms, proc_id, cfc, {_station("bs")} AS bs,
  {_station("source_bs")} AS source_bs, {_station("target_bs")} AS target_bs FROM rec""",
    "feature_export": f"""{VIEW}{_rolled()},
means AS (SELECT bs, """ + ", ".join(f"round(avg({c}), 9) AS {c}" for c in ROLLED_COLUMNS) + """
  FROM rolled WHERE t BETWEEN 20 AND 60 GROUP BY bs)
SELECT bs, """ + " || ' ' || ".join(f"printf('%.4f', round({c}, 4) + 0.0)" for c in ROLLED_COLUMNS) + """ AS features
FROM means""",
}
