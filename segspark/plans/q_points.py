"""Point queries on the events stand-in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from segspark.functions import expr as X
from segspark.functions.expr import r6
from segspark.operators import points as P
from segspark.plans.oracle_sql import D, PTS, with_ctes
from segspark.plans.registry import register
from segspark.sources import standin

NUM = ["altitude", "grade", "speed", "cadence", "heartrate"]

GATE = """
gate AS (
  SELECT activity_id,
         concat_ws(',', CASE WHEN count(distance) = 0 THEN 'distance' END,
                        CASE WHEN count(altitude) = 0 THEN 'altitude' END,
                        CASE WHEN count_if(lat IS NOT NULL AND lng IS NOT NULL) = 0 THEN 'latlng' END,
                        CASE WHEN count(cadence) = 0 THEN 'cadence' END,
                        CASE WHEN count(grade_smooth) = 0 THEN 'grade_smooth' END,
                        CASE WHEN count(velocity_smooth) = 0 THEN 'velocity_smooth' END,
                        CASE WHEN count(time) = 0 THEN 'time' END) AS missing_channels
  FROM pts GROUP BY activity_id)"""

ACCEPTED = """
acc AS (
  SELECT activity_id, i, time, distance, altitude, grade_smooth AS grade, velocity_smooth AS speed,
         cadence, heartrate, lat, lng
  FROM pts
  WHERE time IS NOT NULL AND distance IS NOT NULL
    AND activity_id NOT IN (SELECT activity_id FROM gate WHERE missing_channels <> ''))"""


def _interp_sql(src: str, name: str) -> str:
    wb = "(PARTITION BY activity_id ORDER BY _pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    wa = "(PARTITION BY activity_id ORDER BY _pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    parts = []
    for c in NUM:
        parts.append(f"last_value(CASE WHEN {c} IS NOT NULL THEN _pos END IGNORE NULLS) OVER {wb} AS {c}_pp, "
                     f"last_value({c} IGNORE NULLS) OVER {wb} AS {c}_pv, "
                     f"first_value(CASE WHEN {c} IS NOT NULL THEN _pos END IGNORE NULLS) OVER {wa} AS {c}_np, "
                     f"first_value({c} IGNORE NULLS) OVER {wa} AS {c}_nv")
    fills = []
    for c in NUM:
        blend = (f"{c}_pv + (({c}_nv - {c}_pv) / CAST({c}_np - {c}_pp AS DOUBLE)) * CAST(_pos - {c}_pp AS DOUBLE)")
        fills.append(f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_pp IS NOT NULL AND {c}_np IS NOT NULL "
                     f"THEN {blend} ELSE coalesce({c}_pv, {c}_nv) END AS {c}")
    return f"""
{name}0 AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY i) AS _pos FROM {src}),
{name}1 AS (SELECT *, {", ".join(parts)} FROM {name}0),
{name} AS (SELECT activity_id, i, time, distance, lat, lng, {", ".join(fills)} FROM {name}1)"""


def _frozen_sql(src: str, name: str) -> str:
    w = "(PARTITION BY activity_id ORDER BY i)"
    before = "(PARTITION BY activity_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = "(PARTITION BY activity_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    alpha = "CASE WHEN s_d <> a_d THEN (distance - a_d) / (s_d - a_d) ELSE 0.0::DOUBLE END"

    def fixed(c):
        return (f"CASE WHEN NOT _frozen THEN {c} "
                f"WHEN _missing AND distance = _prev_d AND a_d IS NOT NULL THEN a_{c} "
                f"WHEN distance = _next_d THEN _next_{c} "
                f"WHEN a_d IS NOT NULL AND s_d IS NOT NULL THEN a_{c} + ({alpha}) * (s_{c} - a_{c}) "
                f"WHEN a_d IS NOT NULL THEN a_{c} ELSE coalesce({c}, s_{c}) END AS {c}")

    return f"""
{name}0 AS (
  SELECT *, lat IS NULL OR lng IS NULL AS _missing,
         coalesce(lat IS NULL OR lng IS NULL OR (lat = lag(lat) OVER {w} AND lng = lag(lng) OVER {w}
                  AND distance <> lag(distance) OVER {w}), false) AS _frozen,
         lag(distance) OVER {w} AS _prev_d, lead(distance) OVER {w} AS _next_d,
         lead(lat) OVER {w} AS _next_lat, lead(lng) OVER {w} AS _next_lng
  FROM {src}),
{name}1 AS (
  SELECT *,
         last_value(CASE WHEN NOT _frozen THEN lat END IGNORE NULLS) OVER {before} AS a_lat,
         last_value(CASE WHEN NOT _frozen THEN lng END IGNORE NULLS) OVER {before} AS a_lng,
         last_value(CASE WHEN NOT _frozen THEN distance END IGNORE NULLS) OVER {before} AS a_d,
         first_value(CASE WHEN NOT _frozen THEN lat END IGNORE NULLS) OVER {after} AS s_lat,
         first_value(CASE WHEN NOT _frozen THEN lng END IGNORE NULLS) OVER {after} AS s_lng,
         first_value(CASE WHEN NOT _frozen THEN distance END IGNORE NULLS) OVER {after} AS s_d
  FROM {name}0),
{name} AS (SELECT * EXCLUDE (lat, lng, _missing, _frozen, _prev_d, _next_d, _next_lat, _next_lng,
                             a_lat, a_lng, a_d, s_lat, s_lng, s_d),
                  {fixed("lat")}, {fixed("lng")} FROM {name}1)"""


def _ascent_sql(src: str, name: str) -> str:
    w = "(PARTITION BY activity_id ORDER BY i)"
    run = "(PARTITION BY activity_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
{name}0 AS (SELECT *, coalesce(altitude - lag(altitude) OVER {w}, 0.0{D}) AS _dalt FROM {src}),
{name} AS (SELECT * EXCLUDE (_dalt), sum(greatest(_dalt, 0.0{D})) OVER {run} AS ascent_so_far,
                  sum(greatest(-_dalt, 0.0{D})) OVER {run} AS descent_so_far FROM {name}0)"""


CLEAN_CTES = [PTS, GATE, ACCEPTED, _interp_sql("acc", "ip"), _frozen_sql("ip", "fz"), _ascent_sql("fz", "cl")]
CLEAN_COLS = ["distance", "altitude", "grade", "speed", "cadence", "heartrate", "lat", "lng",
              "ascent_so_far", "descent_so_far"]


def clean_points(spark, sf_dir):
    return P.clean_points(standin.points(spark, sf_dir))


@register("p3_channel_gate", sql=with_ctes(PTS, GATE, body="""
SELECT activity_id, missing_channels, missing_channels <> '' AS not_processable FROM gate"""))
def channel_gate(spark, sf_dir):
    """Per activity, the required channels that are missing or all NULL."""
    g = P.channel_gate(standin.points(spark, sf_dir))
    return g.select("activity_id", F.array_join("missing_channels", ",").alias("missing_channels"), "not_processable")


@register("w4_interpolate", sql=with_ctes(PTS, GATE, ACCEPTED, _interp_sql("acc", "ip"), body=f"""
SELECT activity_id, i, {", ".join(f"round({c}, 6) AS {c}" for c in NUM)} FROM ip"""))
def interpolate(spark, sf_dir):
    """P4 + P5 + W4: gate, drop, rename, then linear interpolation by position."""
    raw = standin.points(spark, sf_dir)
    df = P.rename_and_coerce(P.drop_incomplete(P.accepted_points(raw)))
    df = P.interpolate_linear(df, NUM)
    return df.select("activity_id", "i", *[r6(c).alias(c) for c in NUM])


@register("w5_frozen_gps", sql=with_ctes(PTS, GATE, ACCEPTED, _interp_sql("acc", "ip"), _frozen_sql("ip", "fz"),
                                         body="""
SELECT activity_id, i, round(lat, 6) AS lat, round(lng, 6) AS lng FROM fz"""))
def frozen_gps(spark, sf_dir):
    """Frozen or missing positions repaired by distance interpolation."""
    raw = standin.points(spark, sf_dir)
    df = P.interpolate_linear(P.rename_and_coerce(P.drop_incomplete(P.accepted_points(raw))), NUM)
    df = P.repair_frozen_positions(df)
    return df.select("activity_id", "i", r6("lat").alias("lat"), r6("lng").alias("lng"))


@register("w2_clean_points", sql=with_ctes(*CLEAN_CTES, body=f"""
SELECT activity_id, i, time, {", ".join(f"round({c}, 6) AS {c}" for c in CLEAN_COLS)} FROM cl"""))
def clean(spark, sf_dir):
    """P3-P5 + W4 + W5 + W1/W2: the whole cleaning step with cumulative ascent and descent."""
    df = clean_points(spark, sf_dir)
    return df.select("activity_id", "i", "time", *[r6(c).alias(c) for c in CLEAN_COLS])


@register("w1_step_changes", sql=with_ctes(*CLEAN_CTES, body=f"""
SELECT activity_id, i,
       round(abs(grade - lag(grade) OVER w), 6) AS grade_change,
       round(abs(cadence - lag(cadence) OVER w), 6) AS cadence_change,
       round(altitude - lag(altitude) OVER w, 6) AS altitude_step
FROM cl WINDOW w AS (PARTITION BY activity_id ORDER BY distance, i)"""))
def step_changes(spark, sf_dir):
    """Grade, cadence and altitude steps against the previous point by distance."""
    w = Window.partitionBy("activity_id").orderBy("distance", "i")
    df = clean_points(spark, sf_dir)
    return df.select("activity_id", "i",
                     r6(F.abs(F.col("grade") - F.lag("grade").over(w))).alias("grade_change"),
                     r6(F.abs(F.col("cadence") - F.lag("cadence").over(w))).alias("cadence_change"),
                     r6(F.col("altitude") - F.lag("altitude").over(w)).alias("altitude_step"))


@register("w3_rolling_mean", sql=with_ctes(*CLEAN_CTES, body="""
SELECT activity_id, i,
       round(avg(grade) OVER (PARTITION BY activity_id ORDER BY distance, i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS grade,
       round(avg(cadence) OVER (PARTITION BY activity_id ORDER BY distance, i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS cadence
FROM cl"""))
def rolling_mean(spark, sf_dir):
    """Centred rolling mean with window 4 (pandas centring for even n)."""
    df = P.rolling_centered_mean(clean_points(spark, sf_dir), ["grade", "cadence"], 4)
    return df.select("activity_id", "i", r6("grade").alias("grade"), r6("cadence").alias("cadence"))


_HAV = """6371000.0::DOUBLE * 2.0::DOUBLE * atan2(sqrt(_a), sqrt(1.0::DOUBLE - _a))"""


@register("w6_gpx_distance_grade", sql=with_ctes(PTS, body=f"""
, h0 AS (SELECT activity_id, i, lat, lng, altitude,
               lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag(altitude) OVER w AS palt
        FROM pts WINDOW w AS (PARTITION BY activity_id ORDER BY i)),
h1 AS (SELECT *, pow(sin(radians(lat - plat) / 2), 2)
                 + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2) AS _a FROM h0),
h2 AS (SELECT *, coalesce({_HAV}, 0.0::DOUBLE) AS _step FROM h1)
SELECT activity_id, i,
       round(sum(_step) OVER (PARTITION BY activity_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS distance,
       round(CASE WHEN _step > 0 THEN 100.0::DOUBLE * (altitude - palt) / _step END, 3) AS grade
FROM h2""").replace("\n, h0", ", h0"))
def gpx_distance_grade(spark, sf_dir):
    """W6 + M1: cumulative haversine distance and grade recomputed from positions."""
    p = standin.points(spark, sf_dir).select("activity_id", "i", "lat", "lng", "altitude")
    d = P.distance_grade_from_coordinates(p)
    return d.select("activity_id", "i", F.round(F.col("distance") * 1e3, 0).alias("_d"),
                    F.round(F.col("grade") * 1e3, 0).alias("_g")).select(
        "activity_id", "i", (F.col("_d") / 1e3).alias("distance"), (F.col("_g") / 1e3).alias("grade"))


@register("m17_arrays_roundtrip", sql=with_ctes(PTS, body="""
SELECT activity_id, count(*) AS n_points, round(sum(distance), 6) AS sum_distance,
       count(heartrate) AS n_heartrate, max(i) AS last_i
FROM pts GROUP BY activity_id"""))
def arrays_roundtrip(spark, sf_dir):
    """M18 then M17: points -> one row of channel arrays per activity -> points again."""
    chans = ["time", "distance", "altitude", "grade_smooth", "cadence", "heartrate", "velocity_smooth", "lat", "lng"]
    arrs = P.points_to_arrays(standin.points(spark, sf_dir), chans)
    back = P.arrays_to_points(arrs, chans)
    return back.groupBy("activity_id").agg(
        F.count(F.lit(1)).alias("n_points"), r6(F.sum("distance")).alias("sum_distance"),
        F.count("heartrate").alias("n_heartrate"), F.max("i").alias("last_i"))


@register("m1_haversine", sql=with_ctes(PTS, body="""
SELECT activity_id, round(sum(d), 3) AS track_m FROM (
  SELECT activity_id, 6371000.0::DOUBLE * 2.0::DOUBLE * atan2(sqrt(_a), sqrt(1.0::DOUBLE - _a)) AS d FROM (
    SELECT activity_id, pow(sin(radians(lat - plat) / 2), 2)
           + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2) AS _a
    FROM (SELECT activity_id, lat, lng, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng
          FROM pts WINDOW w AS (PARTITION BY activity_id ORDER BY i))) WHERE _a IS NOT NULL)
GROUP BY activity_id"""))
def haversine_track(spark, sf_dir):
    """M1: track length per activity as the sum of haversine steps (metres, 3 places)."""
    w = Window.partitionBy("activity_id").orderBy("i")
    p = standin.points(spark, sf_dir)
    d = X.haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    return (p.select("activity_id", d.alias("d")).where(F.col("d").isNotNull())
            .groupBy("activity_id").agg((F.round(F.sum("d") * 1e3, 0) / 1e3).alias("track_m")))
