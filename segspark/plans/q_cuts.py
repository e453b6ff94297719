"""Fold queries (Q1, Q2, Q3, Q5) with recursive-CTE oracles, plus A1, A13, W7, W13, P7, P8."""

from __future__ import annotations

from pyspark.sql import functions as F

from segspark.functions import expr as X
from segspark.functions.expr import r6
from segspark.operators import cuts as C
from segspark.operators import points as P
from segspark.plans.oracle_sql import D, PTS, SEGS, with_ctes
from segspark.plans.q_points import CLEAN_CTES, clean_points
from segspark.plans.registry import register
from segspark.sources import standin

SEG_DOUBLES = ["start_distance", "end_distance", "segment_length", "avg_gradient", "avg_cadence", "avg_speed",
               "start_lat", "start_lng", "end_lat", "end_lng", "start_altitude", "end_altitude",
               "start_heartrate", "end_heartrate", "avg_heartrate", "cumulative_ascent", "cumulative_descent",
               "grade_category"]

# Q1 walk over the cleaned points in distance order; one recursion step per point.
Q1_CTES = CLEAN_CTES + [f"""
sp AS (
  SELECT *, row_number() OVER w - 1 AS k,
         coalesce(abs(grade - lag(grade) OVER w) > 0.5{D} OR abs(cadence - lag(cadence) OVER w) > 5.0{D}, false) AS chg
  FROM cl WINDOW w AS (PARTITION BY activity_id ORDER BY distance, i)),
walk AS (
  SELECT activity_id, k, distance AS d0, false AS is_cut FROM sp WHERE k = 0
  UNION ALL
  SELECT s.activity_id, s.k,
         CASE WHEN (s.chg AND s.distance - w.d0 >= 50.0{D}) OR s.distance - w.d0 > 200.0{D} THEN s.distance ELSE w.d0 END,
         (s.chg AND s.distance - w.d0 >= 50.0{D}) OR s.distance - w.d0 > 200.0{D}
  FROM walk w JOIN sp s ON s.activity_id = w.activity_id AND s.k = w.k + 1),
cutk AS (SELECT activity_id, k, row_number() OVER (PARTITION BY activity_id ORDER BY k) AS seg_no FROM walk WHERE is_cut),
bnd AS (SELECT activity_id, seg_no, coalesce(lag(k) OVER (PARTITION BY activity_id ORDER BY k), 0) AS s, k AS e FROM cutk),
seg_agg AS (
  SELECT b.activity_id, b.seg_no, b.s, b.e, avg(p.grade) AS avg_gradient, avg(p.cadence) AS avg_cadence,
         avg(p.speed) AS avg_speed, avg(p.heartrate) AS avg_heartrate
  FROM bnd b JOIN sp p ON p.activity_id = b.activity_id AND p.k >= b.s AND p.k < b.e
  GROUP BY b.activity_id, b.seg_no, b.s, b.e),
q1 AS (
  SELECT CAST(a.activity_id AS VARCHAR) || '-' || repeat('0', greatest(0, 5 - len(CAST(a.seg_no AS VARCHAR)))) || CAST(a.seg_no AS VARCHAR) AS segment_id,
         a.activity_id, CAST(a.seg_no AS BIGINT) AS seg_no,
         f.distance AS start_distance, l.distance AS end_distance, n.distance - f.distance AS segment_length,
         a.avg_gradient, a.avg_cadence, a.avg_speed,
         CASE WHEN a.avg_cadence > 60 THEN 'running' WHEN a.avg_cadence IS NOT NULL THEN 'walking' END AS movement_type,
         CASE WHEN a.avg_gradient > 0 THEN 'uphill' WHEN a.avg_gradient < 0 THEN 'downhill'
              WHEN a.avg_gradient IS NOT NULL THEN 'flat' END AS type,
         round_even(a.avg_gradient / 2.5{D}, 0) * 2.5{D} + 0.0{D} AS grade_category,
         f.lat AS start_lat, f.lng AS start_lng, l.lat AS end_lat, l.lng AS end_lng,
         f.altitude AS start_altitude, l.altitude AS end_altitude, f.time AS start_time, l.time AS end_time,
         f.heartrate AS start_heartrate, l.heartrate AS end_heartrate, a.avg_heartrate,
         f.ascent_so_far AS cumulative_ascent, f.descent_so_far AS cumulative_descent
  FROM seg_agg a
  JOIN sp f ON f.activity_id = a.activity_id AND f.k = a.s
  JOIN sp l ON l.activity_id = a.activity_id AND l.k = a.e - 1
  JOIN sp n ON n.activity_id = a.activity_id AND n.k = a.e)"""]


def historical_segments(spark, sf_dir):
    return C.segment_points(clean_points(spark, sf_dir))


def _seg_select(df):
    return df.select("segment_id", "activity_id", "seg_no", "movement_type", "type", "start_time", "end_time",
                     *[r6(c).alias(c) for c in SEG_DOUBLES])


@register("q1_segment_cut", sql=with_ctes(*Q1_CTES, body=f"""
SELECT segment_id, activity_id, seg_no, movement_type, type, start_time, end_time,
       {", ".join(f"round({c}, 6) AS {c}" for c in SEG_DOUBLES)} FROM q1"""))
def segment_cut(spark, sf_dir):
    """Q1 + A1 + P7 + P12-P14: historical segments cut by grade/cadence steps and length bounds."""
    return _seg_select(historical_segments(spark, sf_dir))


@register("a1_segments_per_activity", sql=with_ctes(*Q1_CTES, body="""
SELECT activity_id, count(*) AS n_segments, round(sum(segment_length), 6) AS total_length,
       count_if(movement_type = 'running') AS n_running, max(seg_no) AS last_seg_no
FROM q1 GROUP BY activity_id"""))
def segments_per_activity(spark, sf_dir):
    """A1 roll-up: segments, covered length and running segments per activity."""
    s = historical_segments(spark, sf_dir)
    return s.groupBy("activity_id").agg(
        F.count(F.lit(1)).alias("n_segments"), r6(F.sum("segment_length")).alias("total_length"),
        F.count_if(F.col("movement_type") == "running").alias("n_running"), F.max("seg_no").alias("last_seg_no"))


# --- Q2: planned cut on the raw points (grade steps only) ---------------------------

Q2_CTES = [PTS, f"""
pp0 AS (
  SELECT *, coalesce(altitude - lag(altitude) OVER (PARTITION BY activity_id ORDER BY i), 0.0{D}) AS _dalt FROM pts),
pp AS (
  SELECT activity_id, i, distance, altitude, grade_smooth AS grade, lat, lng,
         sum(greatest(_dalt, 0.0{D})) OVER r AS ascent_so_far,
         sum(greatest(-_dalt, 0.0{D})) OVER r AS descent_so_far,
         row_number() OVER w - 1 AS k,
         coalesce(abs(grade_smooth - lag(grade_smooth) OVER w) > 0.5{D}, false) AS chg,
         max(time) OVER (PARTITION BY activity_id) AS duration
  FROM pp0
  WINDOW w AS (PARTITION BY activity_id ORDER BY i),
         r AS (PARTITION BY activity_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pwalk AS (
  SELECT activity_id, k, distance AS d0, false AS is_cut FROM pp WHERE k = 0
  UNION ALL
  SELECT s.activity_id, s.k,
         CASE WHEN (s.chg AND s.distance - w.d0 >= 50.0{D}) OR s.distance - w.d0 > 200.0{D} THEN s.distance ELSE w.d0 END,
         (s.chg AND s.distance - w.d0 >= 50.0{D}) OR s.distance - w.d0 > 200.0{D}
  FROM pwalk w JOIN pp s ON s.activity_id = w.activity_id AND s.k = w.k + 1),
pcut AS (SELECT activity_id, k, row_number() OVER (PARTITION BY activity_id ORDER BY k) AS seg_no FROM pwalk WHERE is_cut),
pbnd AS (SELECT activity_id, seg_no, coalesce(lag(k) OVER (PARTITION BY activity_id ORDER BY k), 0) AS s, k AS e FROM pcut),
q2a AS (
  SELECT b.activity_id, b.seg_no, f.distance AS start_distance, l.distance AS end_distance,
         n.distance - f.distance AS segment_length,
         CASE WHEN n.distance - f.distance > 0 THEN (l.altitude - f.altitude) / (n.distance - f.distance) * 100.0{D}
              ELSE 0.0{D} END AS avg_gradient,
         f.altitude AS start_altitude, l.altitude AS end_altitude,
         f.ascent_so_far AS cumulative_ascent, f.descent_so_far AS cumulative_descent, f.duration
  FROM pbnd b
  JOIN pp f ON f.activity_id = b.activity_id AND f.k = b.s
  JOIN pp l ON l.activity_id = b.activity_id AND l.k = b.e - 1
  JOIN pp n ON n.activity_id = b.activity_id AND n.k = b.e),
q2b AS (
  SELECT *, sum(segment_length) OVER (PARTITION BY activity_id) AS _total FROM q2a),
q2c AS (
  SELECT *, segment_length / _total * CAST(duration AS DOUBLE) AS dur FROM q2b WHERE _total <> 0),
q2 AS (
  SELECT *, coalesce(sum(dur) OVER (PARTITION BY activity_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0{D}) AS start_time
  FROM q2c)"""]


@register("q2_planned_cut", sql=with_ctes(*Q2_CTES, body="""
SELECT CAST(activity_id AS VARCHAR) || '-' || repeat('0', greatest(0, 5 - len(CAST(seg_no AS VARCHAR)))) || CAST(seg_no AS VARCHAR) AS segment_id,
       activity_id, CAST(seg_no AS BIGINT) AS seg_no,
       round(start_distance, 6) AS start_distance, round(end_distance, 6) AS end_distance,
       round(segment_length, 6) AS segment_length, round(avg_gradient, 6) AS avg_gradient,
       round(round_even(avg_gradient / 2.5::DOUBLE, 0) * 2.5::DOUBLE + 0.0::DOUBLE, 6) AS grade_category,
       round(start_altitude, 6) AS start_altitude, round(end_altitude, 6) AS end_altitude,
       round(cumulative_ascent, 6) AS cumulative_ascent, round(cumulative_descent, 6) AS cumulative_descent,
       round(dur, 4) AS duration, round(start_time, 4) AS start_time, round(start_time + dur, 4) AS end_time
FROM q2"""))
def planned_cut(spark, sf_dir):
    """Q2 + W7 + A13: planned-route cut on grade steps, time shared in proportion to length."""
    raw = standin.points(spark, sf_dir)
    pts = raw.select("activity_id", "i", "distance", "altitude", F.col("grade_smooth").alias("grade"), "lat", "lng")
    durations = raw.groupBy("activity_id").agg(F.max("time").alias("duration"))
    s = C.segment_planned_points(pts, durations)
    r4 = lambda c: (F.round(F.col(c) * 1e4, 0) / 1e4).alias(c)
    return s.select("segment_id", "activity_id", "seg_no",
                    *[r6(c).alias(c) for c in ["start_distance", "end_distance", "segment_length", "avg_gradient",
                                                "grade_category", "start_altitude", "end_altitude",
                                                "cumulative_ascent", "cumulative_descent"]],
                    r4("duration"), r4("start_time"), r4("end_time"))


# --- Q3: weather reference points over the Q1 segments ------------------------------

_CELL = lambda c: f"(round_even({c} / 0.2{D}, 0) * 0.2{D} + 0.0{D})"
_NEW = (f"({_CELL('r.end_lat')} <> w.clat OR {_CELL('r.end_lng')} <> w.clng "
        f"OR abs(r.end_altitude - w.alt) >= 600.0{D} OR coalesce(CAST(r.end_time AS DOUBLE) - w.t, 0.0{D}) >= 10800.0{D})")

Q3_CTES = Q1_CTES + [f"""
rp AS (SELECT *, seg_no - 1 AS k FROM q1),
rwalk AS (
  SELECT activity_id, k, {_CELL('start_lat')} AS clat, {_CELL('start_lng')} AS clng, start_altitude AS alt,
         CAST(start_time AS DOUBLE) AS t, true AS is_start
  FROM rp WHERE k = 0
  UNION ALL
  SELECT r.activity_id, r.k,
         CASE WHEN {_NEW} THEN {_CELL('r.end_lat')} ELSE w.clat END,
         CASE WHEN {_NEW} THEN {_CELL('r.end_lng')} ELSE w.clng END,
         CASE WHEN {_NEW} THEN r.end_altitude ELSE w.alt END,
         CASE WHEN {_NEW} THEN CAST(r.end_time AS DOUBLE) ELSE w.t END,
         {_NEW}
  FROM rwalk w JOIN rp r ON r.activity_id = w.activity_id AND r.k = w.k + 1),
rn AS (
  SELECT w.activity_id, w.k, w.is_start,
         sum(CAST(w.is_start AS INTEGER)) OVER (PARTITION BY w.activity_id ORDER BY w.k) AS ref_no,
         sum(CAST(w.is_start AS INTEGER)) OVER (PARTITION BY w.activity_id) AS n_points
  FROM rwalk w),
refpos AS (
  SELECT n.activity_id, n.ref_no,
         CASE WHEN n.ref_no = 1 THEN r.start_lat ELSE r.end_lat END AS ref_lat,
         CASE WHEN n.ref_no = 1 THEN r.start_lng ELSE r.end_lng END AS ref_lng,
         CASE WHEN n.ref_no = 1 THEN r.start_altitude ELSE r.end_altitude END AS ref_altitude,
         CASE WHEN n.ref_no = 1 THEN r.start_time ELSE r.end_time END AS ref_ts
  FROM rn n JOIN rp r ON r.activity_id = n.activity_id AND r.k = n.k WHERE n.is_start),
q3 AS (
  SELECT r.activity_id, r.segment_id, n.ref_no, n.n_points,
         CAST(n.ref_no AS VARCHAR) || '_' || CAST(n.n_points AS VARCHAR) AS group_id,
         p.ref_lat, p.ref_lng, p.ref_altitude, p.ref_ts
  FROM rp r JOIN rn n ON n.activity_id = r.activity_id AND n.k = r.k
  JOIN refpos p ON p.activity_id = r.activity_id AND p.ref_no = n.ref_no)"""]


def reference_points(spark, sf_dir, use_time=True):
    s = historical_segments(spark, sf_dir).withColumns({"start_ts": F.col("start_time"), "end_ts": F.col("end_time")})
    return C.weather_reference_points(s, use_time=use_time)


@register("q3_weather_reference_points", sql=with_ctes(*Q3_CTES, body="""
SELECT activity_id, segment_id, CAST(ref_no AS INTEGER) AS ref_no, CAST(n_points AS INTEGER) AS n_points, group_id,
       round(ref_lat, 6) AS ref_lat, round(ref_lng, 6) AS ref_lng, round(ref_altitude, 6) AS ref_altitude,
       CAST(ref_ts AS BIGINT) AS ref_ts
FROM q3"""))
def weather_reference_points(spark, sf_dir):
    """Q3 + W13: reference points by grid cell, altitude and time change; group id "k_n"."""
    r = reference_points(spark, sf_dir)
    return r.select("activity_id", "segment_id", F.col("ref_no").cast("int").alias("ref_no"),
                    F.col("n_points").cast("int").alias("n_points"), "group_id",
                    r6("ref_lat").alias("ref_lat"), r6("ref_lng").alias("ref_lng"),
                    r6("ref_altitude").alias("ref_altitude"), F.col("ref_ts").cast("bigint").alias("ref_ts"))


# --- Q5: zone-request de-duplication with a 5 minute time to live ---------------------

Q5_CTES = [f"""
req AS (
  SELECT user_id % 3 AS user_id, event_type AS activity, ts, event_id,
         row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY epoch_us(ts), event_id) - 1 AS k
  FROM events),
qwalk AS (
  SELECT user_id, activity, k, epoch_us(ts) AS last, true AS kept FROM req WHERE k = 0
  UNION ALL
  SELECT r.user_id, r.activity, r.k,
         CASE WHEN epoch_us(r.ts) - w.last >= 300000000 THEN epoch_us(r.ts) ELSE w.last END,
         epoch_us(r.ts) - w.last >= 300000000
  FROM qwalk w JOIN req r ON r.user_id = w.user_id AND r.activity = w.activity AND r.k = w.k + 1)"""]


def zone_requests(spark, sf_dir):
    """Stand-in zone requests: (user, activity) keys from events, a few per 5 minutes."""
    e = standin.table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 3).alias("user_id"), F.col("event_type").alias("activity"),
                    F.col("ts"), F.col("event_id"))


@register("q5_ttl_dedup", sql=with_ctes(*Q5_CTES, body="""
SELECT r.user_id, r.activity, r.event_id FROM qwalk w
JOIN req r ON r.user_id = w.user_id AND r.activity = w.activity AND r.k = w.k WHERE w.kept"""))
def ttl_dedup(spark, sf_dir):
    """Q5: drop repeats of (user, activity) within 5 minutes of the last kept request; large keys go through the chain."""
    from segspark.operators.chains import ttl_dedup_any_size
    k = ttl_dedup_any_size(zone_requests(spark, sf_dir), ["user_id", "activity"], "ts", "event_id", 300)
    return k.select("user_id", "activity", "event_id")


# --- P7, P8, M14: segment id build and split ------------------------------------------

@register("p8_segment_id_split", sql=with_ctes(SEGS, body="""
SELECT segment_id, CAST(regexp_extract(segment_id, '^(.*)-[^-]*$', 1) AS BIGINT) AS activity_id_parsed,
       split_part(segment_id, '-', -1) AS short_id,
       CAST(split_part(segment_id, '-', -1) AS INTEGER) AS seg_index
FROM segs"""))
def segment_id_split(spark, sf_dir):
    """P7 + P8 + M14: "{activity}-{00001}" built, then split back (negative ids keep the sign)."""
    s = standin.segments(spark, sf_dir, False)
    return s.select("segment_id", X.activity_of_segment("segment_id").alias("activity_id_parsed"),
                    X.short_segment_id("segment_id").alias("short_id"),
                    X.short_segment_id("segment_id").cast("int").alias("seg_index"))


@register("q5_ttl_dedup_chain", sql=with_ctes(*Q5_CTES, body="""
SELECT r.user_id, r.activity, r.event_id FROM qwalk w
JOIN req r ON r.user_id = w.user_id AND r.activity = w.activity AND r.k = w.k WHERE w.kept"""))
def ttl_dedup_chain(spark, sf_dir):
    """Q5 for keys of any size: successor by TTL-bucket as-of joins, kept set by pointer doubling."""
    from segspark.operators.chains import ttl_dedup_chain as chain
    k = chain(zone_requests(spark, sf_dir), ["user_id", "activity"], "ts", "event_id", 300)
    return k.select("user_id", "activity", "event_id")
