"""Serving queries over the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from segspark.functions import expr as X
from segspark.functions.expr import r6
from segspark.operators import status as S
from segspark.operators import views as V
from segspark.operators import zones as Z
from segspark.plans.oracle_sql import (ACTS, D, EDGES, PREFS, SCORED, SEGS, TRACKER, ZONES_STORED, with_ctes, zone_case)
from segspark.plans.q_cuts import Q2_CTES
from segspark.plans.q_status import STATUS_SQL
from segspark.plans.q_zones import scored_segments
from segspark.plans.registry import register
from segspark.session import write_table
from segspark.sources import lookup, standin

NOW = "2001-06-01 00:00:00"


@register("p1_sport_filter", sql=with_ctes(ACTS, body="""
SELECT id, athlete_id, sport_type, type FROM acts
WHERE type IN ('Run', 'Trail Run') OR sport_type IN ('Run', 'Trail Run')"""))
def sport_filter(spark, sf_dir):
    """Activities whose type or sport_type is Run or Trail Run."""
    return V.sport_filter(standin.activities(spark, sf_dir)).select("id", "athlete_id", "sport_type", "type")


@register("p2_sync_window", sql=with_ctes(ACTS, PREFS, body=f"""
SELECT id, athlete_id FROM (
  SELECT a.*, coalesce(p.sync_years, 8) AS yrs, coalesce(p.time_zone, 'UTC') AS tz FROM acts a
  LEFT JOIN prefs p ON p.user_id = a.athlete_id)
WHERE timezone('UTC', start_date) >= timezone(tz, timezone(tz, timezone('UTC', TIMESTAMP '{NOW}')) - to_years(yrs))
  AND timezone('UTC', start_date) <= timezone('UTC', TIMESTAMP '{NOW}')"""))
def sync_window(spark, sf_dir):
    """P2 + M12: activities inside each user's sync window (years counted in the user's zone)."""
    a = V.sync_window(standin.activities(spark, sf_dir), standin.preferences(spark, sf_dir), NOW)
    return a.select("id", "athlete_id")


@register("p25_ownership", sql=with_ctes(ACTS, body="""
SELECT r.user_id, r.activity_id, coalesce(a.athlete_id = r.user_id, false) AS is_owner
FROM (SELECT user_id, event_id + 1 AS activity_id FROM events) r LEFT JOIN acts a ON a.id = r.activity_id"""))
def ownership(spark, sf_dir):
    """P25: does the requesting user own the requested activity?"""
    e = standin.table(spark, sf_dir, "events").select("user_id", (F.col("event_id") + 1).alias("activity_id"))
    return V.owned(e, standin.activities(spark, sf_dir)).select("user_id", "activity_id", "is_owner")


@register("k1_first_page", sql=with_ctes(ACTS, body="""
SELECT athlete_id, id, CAST(position AS INTEGER) AS position, total FROM (
  SELECT athlete_id, id, row_number() OVER (PARTITION BY athlete_id ORDER BY start_date DESC, id) AS position,
         count(*) OVER (PARTITION BY athlete_id) AS total
  FROM acts WHERE NOT coalesce(is_planned, false)) WHERE position <= 15"""))
def first_page(spark, sf_dir):
    """K1: first page (15, newest first) of every user's historical activities, with totals."""
    p = V.first_page(standin.activities(spark, sf_dir))
    return p.select("athlete_id", "id", F.col("position").cast("int").alias("position"), "total")


@register("k1_listing_pages", sql=with_ctes(ACTS, body="""
SELECT p.page, athlete_id, id, position, total FROM (
  SELECT athlete_id, id, row_number() OVER (PARTITION BY athlete_id ORDER BY start_date DESC, id) AS position,
         count(*) OVER (PARTITION BY athlete_id) AS total
  FROM acts WHERE NOT coalesce(is_planned, false)) a
JOIN (VALUES ('first'), ('second'), ('last')) p(page)
  ON (position - 1) // 5 = CASE p.page WHEN 'first' THEN 0 WHEN 'second' THEN 1 ELSE (total - 1) // 5 END"""))
def listing_pages(spark, sf_dir):
    """K1: first, second and last page (five a page) of every user's historical activities, with positions and totals."""
    a = standin.activities(spark, sf_dir)
    pages = {"first": 0, "second": 1, "last": lambda total: F.expr("(_total - 1) div 5")}
    out = [V.listing_page(a, page, 5).select(F.lit(name).alias("page"), "athlete_id", "id", "position", "total") for name, page in pages.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("k2_top_by_grade", sql=with_ctes(SEGS, SCORED, body="""
SELECT segment_id, CAST(rank AS INTEGER) AS rank, top_segment_id, round(top_score, 6) AS top_score FROM (
  SELECT p.segment_id, c.segment_id AS top_segment_id, c.efficiency_score AS top_score,
         row_number() OVER (PARTITION BY p.segment_id ORDER BY c.efficiency_score DESC NULLS LAST, c.segment_id) AS rank
  FROM scored p JOIN (
    SELECT grade_category, segment_id, efficiency_score FROM scored WHERE activity_id > 0
    QUALIFY row_number() OVER (PARTITION BY grade_category ORDER BY efficiency_score DESC NULLS LAST, segment_id) <= 6) c
  ON c.grade_category = p.grade_category AND c.segment_id <> p.segment_id)
WHERE rank <= 5"""))
def top_by_grade(spark, sf_dir):
    """K2 + J10: for every segment the 5 best other historical segments of its grade category."""
    t = V.top_by_grade(scored_segments(spark, sf_dir))
    return t.select("segment_id", F.col("rank").cast("int").alias("rank"), "top_segment_id",
                    r6("top_score").alias("top_score"))


@register("j8_similar_segments", sql=with_ctes(SEGS, SCORED, EDGES, body="""
SELECT e.segment_id, e.rank, e.similar_segment_id, s.grade_category AS similar_grade_category,
       round(s.efficiency_score, 6) AS similar_efficiency_score
FROM edges e JOIN scored s ON s.segment_id = e.similar_segment_id"""))
def similar_segments(spark, sf_dir):
    """Forward neighbours of every segment with their rows, by rank."""
    j = V.similar_segments(standin.similarity_edges(spark, sf_dir), scored_segments(spark, sf_dir))
    return j.select("segment_id", "rank", "similar_segment_id", "similar_grade_category",
                    r6("similar_efficiency_score").alias("similar_efficiency_score"))


W10_SQL = """
pop AS (
  SELECT e.similar_segment_id AS segment_id, m.efficiency_score AS member_score
  FROM edges e JOIN scored m ON m.segment_id = e.segment_id
  WHERE m.efficiency_score IS NOT NULL AND e.segment_id <> e.similar_segment_id
  UNION ALL SELECT segment_id, efficiency_score FROM scored),
simz AS (
  SELECT p.segment_id, CAST(count_if(p.member_score <= me.efficiency_score) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS pct
  FROM pop p JOIN scored me ON me.segment_id = p.segment_id
  WHERE me.efficiency_score IS NOT NULL AND p.member_score IS NOT NULL GROUP BY p.segment_id)"""


@register("w10_similar_zones", sql=with_ctes(SEGS, SCORED, EDGES, W10_SQL, body=f"""
SELECT segment_id, round(pct, 6) AS percentile, {zone_case("pct")} AS zone FROM simz"""))
def similar_zones(spark, sf_dir):
    """J7 + U2 + W10 + W11: zone of each score among segments listing it as similar, plus itself."""
    z = Z.zone_among_similars(scored_segments(spark, sf_dir), standin.similarity_edges(spark, sf_dir))
    return z.select("segment_id", r6("percentile_similars").alias("percentile"),
                    F.col("zone_among_similars").alias("zone"))


@register("j4_stale_segments", sql=with_ctes(SEGS, SCORED, ACTS, EDGES, ZONES_STORED, body="""
SELECT s.segment_id, strftime(ss.similarity_calculated_at, '%Y-%m-%d %H:%M:%S') AS similarity_calculated_at,
       strftime(z.calculated_at, '%Y-%m-%d %H:%M:%S') AS zone_calculated_at
FROM scored s
JOIN acts a ON a.id = s.activity_id
JOIN (SELECT segment_id, max(calculated_at) AS similarity_calculated_at FROM edges GROUP BY segment_id) ss
  ON ss.segment_id = s.segment_id
LEFT JOIN zones_stored z ON z.segment_id = s.segment_id
WHERE (z.segment_id IS NULL OR ss.similarity_calculated_at > z.calculated_at) AND a.id > 0"""))
def stale_segments(spark, sf_dir):
    """J4 + A4: segments whose zone is missing or older than their latest similarity."""
    st = Z.stale_segments(scored_segments(spark, sf_dir), standin.activities(spark, sf_dir),
                          standin.similarity_edges(spark, sf_dir), standin.stored_zones(spark, sf_dir))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return st.select("segment_id", F.date_format("similarity_calculated_at", fmt).alias("similarity_calculated_at"),
                     F.date_format("calculated_at", fmt).alias("zone_calculated_at"))


GRADE_Z = f"""
gz AS (
  SELECT segment_id, {zone_case("cume_dist() OVER (PARTITION BY grade_category ORDER BY efficiency_score)")} AS zg
  FROM scored WHERE activity_id > 0 AND efficiency_score IS NOT NULL)"""


@register("j15_segment_view", sql=with_ctes(SEGS, SCORED, GRADE_Z, lookup.ICONS_SQL, body="""
SELECT s.segment_id, s.weather_id, gz.zg AS zone_among_grade_category, i.icon AS weather_icon,
       s.road_type, round(s.efficiency_score, 6) AS efficiency_score
FROM scored s LEFT JOIN gz ON gz.segment_id = s.segment_id LEFT JOIN icons i ON i.weather_id = s.weather_id"""))
def segment_view(spark, sf_dir):
    """J15 + P24 + S17: segment rows with their grade zone and weather icon (both optional)."""
    # read by the zones, twice, and by the view: evaluated once
    s = write_table(scored_segments(spark, sf_dir, terrain_weather=True).select(
        "segment_id", "activity_id", "grade_category", "efficiency_score", "weather_id", "road_type"), "scored")
    z = Z.zone_among_grade(s).select("segment_id", "zone_among_grade_category")
    v = V.segment_view(s, z, lookup.weather_icons(spark))
    return v.select("segment_id", "weather_id", "zone_among_grade_category", "weather_icon", "road_type",
                    r6("efficiency_score").alias("efficiency_score"))


@register("a10_missing_zone_ratio", sql=with_ctes(SEGS, SCORED, EDGES, W10_SQL, GRADE_Z, body="""
SELECT s.activity_id,
       avg(CASE WHEN simz.segment_id IS NULL OR gz.segment_id IS NULL THEN 1 ELSE 0 END) AS missing_ratio,
       count(*) AS n_segments,
       avg(CASE WHEN simz.segment_id IS NULL OR gz.segment_id IS NULL THEN 1 ELSE 0 END) > 0.2 AS should_poll
FROM scored s LEFT JOIN simz ON simz.segment_id = s.segment_id LEFT JOIN gz ON gz.segment_id = s.segment_id
GROUP BY s.activity_id"""))
def missing_zone_ratio(spark, sf_dir):
    """A10: per activity, share of segments lacking a zone; poll when above 0.2."""
    # read by both kinds of zones and by the ratio: evaluated once
    s = write_table(scored_segments(spark, sf_dir).select("segment_id", "activity_id", "grade_category", "efficiency_score"), "scored")
    zs = Z.zone_among_similars(s, standin.similarity_edges(spark, sf_dir)).select("segment_id", "zone_among_similars")
    zg = Z.zone_among_grade(s).select("segment_id", "zone_among_grade_category")
    j = s.select("segment_id", "activity_id").join(zs, "segment_id", "left").join(zg, "segment_id", "left")
    return Z.missing_zone_ratio(j)


LISTING = """
listing AS (SELECT (o_orderkey + 1) AS id FROM orders WHERE o_orderstatus IN ('O', 'P')),
stored AS (SELECT (o_orderkey + 1) AS id FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00')"""


def _listing(spark, sf_dir):
    o = standin.table(spark, sf_dir, "orders")
    listing = o.where(F.col("o_orderstatus").isin("O", "P")).select((F.col("o_orderkey") + 1).alias("id"))
    stored = o.where(F.col("o_orderdate") < F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")).select(
        (F.col("o_orderkey") + 1).alias("id"))
    return listing, stored


@register("j17_sync_new", sql=with_ctes(LISTING, body="SELECT id FROM listing EXCEPT SELECT id FROM stored"))
def sync_new(spark, sf_dir):
    """Activity ids in the provider listing but not stored yet."""
    return V.sync_difference(*_listing(spark, sf_dir))[0].distinct()


@register("u1_sync_removed", sql=with_ctes(LISTING, body="SELECT id FROM stored EXCEPT SELECT id FROM listing"))
def sync_removed(spark, sf_dir):
    """U1 + J17: stored ids that the listing no longer has (to delete)."""
    return V.sync_difference(*_listing(spark, sf_dir))[1].distinct()


@register("m9_m10_text", sql=with_ctes(SEGS, SCORED, body="""
SELECT segment_id,
       CASE WHEN avg_speed_h IS NULL OR avg_speed_h <= 0 THEN 'N/A'
            ELSE CAST(floor(CAST(round(1000.0::DOUBLE / avg_speed_h) AS BIGINT) / 60) AS BIGINT) || ':' ||
                 lpad(CAST(CAST(round(1000.0::DOUBLE / avg_speed_h) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '/km' END AS pace,
       repeat('0', greatest(0, 2 - len(CAST(CAST(floor(floor(time) / 3600) AS BIGINT) AS VARCHAR)))) || CAST(CAST(floor(floor(time) / 3600) AS BIGINT) AS VARCHAR) || ':' ||
       lpad(CAST(CAST(floor((CAST(floor(time) AS BIGINT) % 3600) / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' ||
       lpad(CAST(CAST(floor(time) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS duration
FROM scored WHERE time IS NOT NULL"""))
def text_formats(spark, sf_dir):
    """M9 + M10: pace text m:ss/km and duration text hh:mm:ss of every run segment."""
    s = scored_segments(spark, sf_dir).where(F.col("time").isNotNull())
    return s.select("segment_id", X.pace_text("avg_speed").alias("pace"), X.duration_text("time").alias("duration"))


_PLANNED_SEG = """
pseg AS (
  SELECT CAST(activity_id AS VARCHAR) || '-' || repeat('0', greatest(0, 5 - len(CAST(seg_no AS VARCHAR)))) || CAST(seg_no AS VARCHAR) AS segment_id,
         activity_id, seg_no, start_distance, end_distance, start_time, start_time + dur AS end_time FROM q2)"""


def _planned(spark, sf_dir):
    from segspark.operators import cuts as C
    raw = standin.points(spark, sf_dir)
    pts = raw.select("activity_id", "i", "distance", "altitude", F.col("grade_smooth").alias("grade"), "lat", "lng")
    durations = raw.groupBy("activity_id").agg(F.max("time").alias("duration"))
    return raw, C.segment_planned_points(pts, durations)


@register("j16_point_in_segment", sql=with_ctes(*Q2_CTES, _PLANNED_SEG, """
hit AS (SELECT p.activity_id, p.i, p.distance, s.* EXCLUDE (activity_id) FROM pts p JOIN pseg s
        ON p.activity_id = s.activity_id AND p.distance BETWEEN s.start_distance AND s.end_distance
        QUALIFY row_number() OVER (PARTITION BY p.activity_id, p.i ORDER BY s.start_distance, s.segment_id) = 1)""", body="""
SELECT p.activity_id, p.i, h.segment_id,
       CAST(round(h.start_time + coalesce((h.distance - h.start_distance) / nullif(h.end_distance - h.start_distance, 0),
                                          0.0::DOUBLE) * (h.end_time - h.start_time), 0) AS DOUBLE) AS time_at_point
FROM pts p LEFT JOIN hit h USING (activity_id, i)"""))
def point_in_segment(spark, sf_dir):
    """J16 + M20: each stream point's first matching planned segment and its interpolated time (as-of lookup)."""
    raw, seg = _planned(spark, sf_dir)
    r = V.point_segment_lookup(raw.select("activity_id", "i", "distance"), seg)
    return r.select("activity_id", "i", "segment_id", F.col("time_at_point").cast("double").alias("time_at_point"))


@register("m21_segment_samples", sql=with_ctes(*Q2_CTES, _PLANNED_SEG, body="""
SELECT s.activity_id, s.segment_id,
       (SELECT min(i) FROM pts p WHERE p.activity_id = s.activity_id AND p.distance >= s.start_distance) AS start_index,
       (SELECT min(i) FROM pts p WHERE p.activity_id = s.activity_id AND p.distance >= s.end_distance) AS end_index
FROM pseg s"""))
def segment_samples(spark, sf_dir):
    """First stream index at or after each segment's start and end distance."""
    raw, seg = _planned(spark, sf_dir)
    p = raw.select("activity_id", "i", "distance")
    a = V.first_index_at_or_after(p, seg, "start_distance", "start_index")
    b = V.first_index_at_or_after(p, seg, "end_distance", "end_index")
    return a.join(b, ["activity_id", "segment_id"])


@register("p24_activity_view", sql=with_ctes(ACTS, TRACKER, STATUS_SQL, body="""
SELECT id, name, distance, moving_time, acts.athlete_id, type, sport_type, CAST(start_date AS DATE) AS start_date,
       CAST(NULL AS VARCHAR) AS map_polyline, CAST(NULL AS DOUBLE) AS average_speed, st.status
FROM acts JOIN st USING (id) WHERE NOT coalesce(acts.is_planned, false)"""))
def activity_view(spark, sf_dir):
    """P24 + J3: the activity view with its status; columns the stand-in lacks are NULL (two of them shown)."""
    a = standin.activities(spark, sf_dir)
    v = V.activity_view(a, S.activity_status(a, standin.status_tracker(spark, sf_dir)))
    return v.select("id", "name", "distance", "moving_time", "athlete_id", "type", "sport_type",
                    F.col("start_date").cast("date").alias("start_date"), "map_polyline", "average_speed", "status")


@register("p24_planned_view", sql=with_ctes(ACTS, body="""
SELECT name, distance, moving_time AS planned_duration, CAST(NULL AS DOUBLE) AS total_elevation_gain, athlete_id, type,
       sport_type, CAST(start_date AS DATE) AS start_date FROM acts WHERE is_planned"""))
def planned_view(spark, sf_dir):
    """The planned-activity view."""
    v = V.planned_view(standin.activities(spark, sf_dir))
    return v.withColumn("start_date", F.col("start_date").cast("date"))
