"""DuckDB SQL for the stand-in adapters, shared by every oracle query.

Each adapter mirrors ``segspark.sources.standin`` operation for operation so
the two engines start from bit-identical inputs (same IEEE operations in the
same order; integer running sums). Literals are cast to DOUBLE because DuckDB
reads ``20.0`` as a DECIMAL.
"""

from __future__ import annotations

from segspark.sources.standin import HIGHWAY_VOCAB, SEGMENT_ORDER, SPORT_BY_PRIORITY, SURFACE_VOCAB, WEATHER_IDS


def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def _pick(index_sql: str, values, cast: str) -> str:
    whens = " ".join(f"WHEN {i} THEN CAST({_lit(v)} AS {cast})" for i, v in enumerate(values))
    return f"CASE {index_sql} {whens} END"


def _map(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


D = "::DOUBLE"
SIGN = "(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END)"

ACTS = f"""
acts AS (
  SELECT (o_orderkey + 1) * {SIGN} AS id,
         o_custkey AS athlete_id,
         'Activity ' || CAST(o_orderkey AS VARCHAR) AS name,
         o_totalprice / 20.0{D} AS distance,
         CAST(floor(o_totalprice / 100.0{D}) AS INTEGER) AS moving_time,
         o_orderdate AS start_date,
         {_map('o_orderpriority', {k: v[0] for k, v in SPORT_BY_PRIORITY.items()})} AS sport_type,
         {_map('o_orderpriority', {k: v[1] for k, v in SPORT_BY_PRIORITY.items()})} AS type,
         o_orderstatus = 'F' AS is_planned
  FROM orders)"""

TRACKER = f"""
tracker AS (
  SELECT (o_orderkey + 1) * {SIGN} AS activity_id,
         o_orderkey % 29 <> 1 AS segment_status,
         o_orderkey % 31 <> 2 AS terrain_status,
         o_orderkey % 37 <> 3 AS weather_status,
         CASE WHEN o_orderkey % 43 = 7 THEN CAST(NULL AS BOOLEAN) ELSE o_orderkey % 41 = 5 END AS not_processable,
         CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS similarity_processed_at,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 2 DAY END AS prediction_executed_at
  FROM orders WHERE o_orderkey % 11 <> 0)"""

_ORDER = ", ".join(SEGMENT_ORDER)
_LEN = f"(l_quantity * 10.0{D})"
_SPEED = f"(l_extendedprice / l_quantity / 500.0{D})"
_GRADE = f"(l_discount * 200.0{D} - 10.0{D})"
_BEFORE = "OVER (PARTITION BY l_orderkey ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

SEGS = f"""
seg0 AS (
  SELECT l.*, o.o_custkey, o.o_orderstatus,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS seg_no,
         (l_orderkey + 1) * {SIGN} AS activity_id,
         {_LEN} AS segment_length,
         {_SPEED} AS avg_speed,
         CAST(floor({_LEN} / {_SPEED}) AS BIGINT) AS _dur,
         {_GRADE} AS avg_gradient,
         CAST(floor({_GRADE} * {_LEN} / 100.0{D}) AS BIGINT) AS _elev,
         CASE WHEN l_linenumber = 7 THEN CAST(NULL AS DOUBLE)
              ELSE 100.0{D} + CAST(floor(l_tax * 1000.0{D}) AS DOUBLE) END AS start_heartrate
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
seg1 AS (
  SELECT *,
         coalesce(sum(segment_length) {_BEFORE}, 0.0{D}) AS start_distance,
         CAST(1000 + coalesce(sum(_elev) {_BEFORE}, 0) AS DOUBLE) AS start_altitude,
         CAST(coalesce(sum(_dur) {_BEFORE}, 0) AS BIGINT) AS start_time,
         CAST(coalesce(sum(greatest(_elev, 0)) {_BEFORE}, 0) AS DOUBLE) AS cumulative_ascent,
         CAST(coalesce(sum(greatest(-_elev, 0)) {_BEFORE}, 0) AS DOUBLE) AS cumulative_descent
  FROM seg0),
segs AS (
  SELECT CAST(activity_id AS VARCHAR) || '-' || repeat('0', greatest(0, 5 - len(CAST(seg_no AS VARCHAR)))) || CAST(seg_no AS VARCHAR) AS segment_id,
         activity_id, o_custkey AS user_id, CAST(seg_no AS BIGINT) AS seg_no,
         start_distance, start_distance + segment_length AS end_distance, segment_length, avg_gradient,
         45.0{D} + CAST(floor(l_extendedprice) % 40 AS DOUBLE) AS avg_cadence,
         avg_speed, start_altitude, start_altitude + CAST(_elev AS DOUBLE) AS end_altitude,
         start_time, start_time + _dur AS end_time,
         start_heartrate,
         start_heartrate + CAST(floor(l_discount * 100.0{D}) AS DOUBLE) - 3.0{D} AS end_heartrate,
         (start_heartrate + (start_heartrate + CAST(floor(l_discount * 100.0{D}) AS DOUBLE) - 3.0{D})) / 2.0{D} AS avg_heartrate,
         cumulative_ascent, cumulative_descent,
         46.0{D} + start_distance / 111320.0{D} AS start_lat,
         8.0{D} + CAST(o_custkey % 1000 AS DOUBLE) / 1000.0{D} AS start_lng,
         {_pick("CAST(split_part(p_brand, '#', 2) AS INTEGER) % 12", HIGHWAY_VOCAB, "VARCHAR")} AS road_type,
         {_pick("p_size % 12", SURFACE_VOCAB, "VARCHAR")} AS surface_type,
         5.0{D} + CAST(l_suppkey % 25 AS DOUBLE) AS temperature,
         40.0{D} + CAST(l_linenumber AS DOUBLE) * 5.0{D} AS humidity,
         l_tax * 100.0{D} AS wind,
         {_pick("month(l_shipdate) % 6", WEATHER_IDS, "INTEGER")} AS weather_id
  FROM seg1 LEFT JOIN part ON l_partkey = p_partkey)"""

_RUN = "OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_LAT_RAW = f"(46.0{D} + distance / 111320.0{D})"
_LNG_RAW = f"(8.0{D} + CAST(user_id % 1000 AS DOUBLE) / 1000.0{D})"

PTS = f"""
pt0 AS (
  SELECT user_id, ts, event_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS _k,
         CAST(round(value * 100.0{D}) AS BIGINT) AS _step,
         row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i,
         epoch_us(ts) AS _us
  FROM events),
pt1 AS (
  SELECT *,
         CAST(sum(_step) {_RUN} AS DOUBLE) / 1000.0{D} AS distance,
         CAST(300 + sum(_k - 50) {_RUN} AS DOUBLE) AS altitude,
         min(_us) OVER (PARTITION BY user_id) AS _us0
  FROM pt0),
pts AS (
  SELECT user_id AS activity_id, CAST(i AS BIGINT) AS i, CAST((_us - _us0) // 1000000 AS BIGINT) AS time,
         distance, altitude,
         CAST(_k - 50 AS DOUBLE) / 4.0{D} AS grade_smooth,
         CASE WHEN user_id % 50 = 7 THEN CAST(NULL AS DOUBLE) ELSE 40.0{D} + CAST(event_id % 60 AS DOUBLE) END AS cadence,
         CASE WHEN event_type = 'error' THEN CAST(NULL AS DOUBLE) ELSE 100.0{D} + CAST(_k AS DOUBLE) END AS heartrate,
         CAST(_step AS DOUBLE) / 4096.0{D} AS velocity_smooth,
         coalesce(last_value(CASE WHEN event_type <> 'view' THEN {_LAT_RAW} END IGNORE NULLS) {_RUN}, {_LAT_RAW}) AS lat,
         coalesce(last_value(CASE WHEN event_type <> 'view' THEN {_LNG_RAW} END IGNORE NULLS) {_RUN}, {_LNG_RAW}) AS lng,
         ts, event_type
  FROM pt1)"""

WAYS = f"""
ways AS (
  SELECT p_partkey AS way_id,
         {_pick("CAST(split_part(p_brand, '#', 2) AS INTEGER) % 12", HIGHWAY_VOCAB, "VARCHAR")} AS highway,
         {_pick("p_size % 12", SURFACE_VOCAB, "VARCHAR")} AS surface,
         p_type
  FROM part)"""


def with_ctes(*ctes: str, body: str) -> str:
    head = "WITH RECURSIVE " if any(" UNION ALL" in c and "walk" in c for c in ctes) else "WITH "
    return head + ",".join(ctes) + "\n" + body


# Column expressions reused by many oracles
GRADE_CATEGORY = "(round_even(avg_gradient / 2.5::DOUBLE, 0) * 2.5::DOUBLE + 0.0::DOUBLE)"


def zone_case(p: str) -> str:
    return (f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} <= 0.2{D} THEN 'very_low' WHEN {p} <= 0.4{D} THEN 'low' "
            f"WHEN {p} <= 0.6{D} THEN 'medium' WHEN {p} <= 0.8{D} THEN 'high' ELSE 'very_high' END")


# metrics + score, same operation order as segspark.operators.score
SCORED = f"""
scored AS (
  SELECT *,
         CASE WHEN activity_id < 0 THEN NULL ELSE 10.0{D} * (((avg_speed_h * 60.0{D}) * (1.0{D} + 1.0{D} * avg_elev_speed * 60.0{D}))
              / nullif(avg_heartrate * (1.5{D} + 0.5{D} * tanh(1.0{D} * hr_drift)), 0)) END AS efficiency_score
  FROM (
    SELECT *,
           end_altitude - start_altitude AS elevation_gain,
           CASE WHEN activity_id < 0 THEN NULL ELSE end_heartrate - start_heartrate END AS hr_drift,
           CASE WHEN activity_id < 0 THEN NULL ELSE CAST(end_time - start_time AS DOUBLE) END AS time,
           CASE WHEN activity_id < 0 THEN NULL
                ELSE abs(end_altitude - start_altitude) / nullif(CAST(end_time - start_time AS DOUBLE), 0) END AS avg_elev_speed,
           CASE WHEN activity_id < 0 THEN NULL ELSE avg_speed END AS avg_speed_h,
           {GRADE_CATEGORY} AS grade_category
    FROM segs))"""


BASE_TS = "TIMESTAMP '2001-01-01 00:00:00'"

PREFS = f"""
prefs AS (
  SELECT c_custkey AS user_id, CAST(1 + c_custkey % 3 AS INTEGER) AS sync_years,
         {_pick("c_nationkey % 3", ["UTC", "Europe/Rome", "America/New_York"], "VARCHAR")} AS time_zone
  FROM customer WHERE c_acctbal > 0)"""

EDGES = f"""
edges AS (
  SELECT segment_id, similar_segment_id, similarity_score, CAST(rank AS INTEGER) AS rank,
         {BASE_TS} + to_days(CAST(rank AS INTEGER)) AS calculated_at
  FROM (
    SELECT a.segment_id, b.segment_id AS similar_segment_id, abs(a.segment_length - b.segment_length) AS similarity_score,
           row_number() OVER (PARTITION BY a.segment_id ORDER BY abs(a.seg_no - b.seg_no), b.seg_no) AS rank
    FROM segs a JOIN segs b ON a.activity_id = b.activity_id AND a.segment_id <> b.segment_id))"""

ZONES_STORED = f"""
zones_stored AS (
  SELECT segment_id, 'medium' AS zone_among_similars, 'medium' AS zone_among_grade_category,
         {BASE_TS} + to_days(CAST(abs(activity_id) % 5 AS INTEGER)) AS calculated_at
  FROM segs WHERE seg_no % 2 = 1)"""

FPS = """
fps AS (
  SELECT c_custkey AS user_id, md5(c_name) AS activity_fingerprint, c_acctbal < 0 AS in_progress
  FROM customer WHERE c_custkey % 4 <> 0)"""

PROGRESS = f"""
progress AS (
  SELECT (l_orderkey + 1) * {SIGN} AS activity_id,
         CAST(l_linenumber AS VARCHAR) || '_' ||
         CAST(max(l_linenumber) OVER (PARTITION BY l_orderkey) + l_orderkey % 2 AS VARCHAR) AS group_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
