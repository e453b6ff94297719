"""Scoring and zone queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from segspark.functions.expr import r6
from segspark.operators import zones as Z
from segspark.operators.score import with_classification, with_score
from segspark.plans.oracle_sql import D, GRADE_CATEGORY, SCORED, SEGS, with_ctes, zone_case
from segspark.plans.registry import register
from segspark.sources import standin


def scored_segments(spark, sf_dir, terrain_weather: bool = False):
    return with_classification(with_score(standin.segments(spark, sf_dir, terrain_weather)))


@register("w11_grade_zones", sql=with_ctes(SEGS, SCORED, body=f"""
SELECT segment_id, grade_category, round(efficiency_score, 6) AS efficiency_score,
       round(cume_dist() OVER (PARTITION BY grade_category ORDER BY efficiency_score), 6) AS percentile,
       {zone_case("cume_dist() OVER (PARTITION BY grade_category ORDER BY efficiency_score)")} AS zone
FROM scored WHERE activity_id > 0 AND efficiency_score IS NOT NULL"""))
def grade_zones(spark, sf_dir):
    """Flagship: efficiency zone of every scored historical segment within its grade category."""
    z = Z.zone_among_grade(scored_segments(spark, sf_dir))
    return z.select("segment_id", "grade_category", r6("efficiency_score").alias("efficiency_score"),
                    r6("percentile_grade").alias("percentile"), F.col("zone_among_grade_category").alias("zone"))


@register("p11_efficiency_score", sql=with_ctes(SEGS, SCORED, body="""
SELECT segment_id, activity_id, round(elevation_gain, 6) AS elevation_gain, round(hr_drift, 6) AS hr_drift,
       round(time, 6) AS time, round(avg_elev_speed, 6) AS avg_elev_speed, round(efficiency_score, 6) AS efficiency_score
FROM scored"""))
def efficiency_scores(spark, sf_dir):
    """P9 + P10 + P11: metrics and score of every segment (planned rows: gain only)."""
    s = with_score(standin.segments(spark, sf_dir, False))
    return s.select("segment_id", "activity_id", *[r6(c).alias(c) for c in
                    ["elevation_gain", "hr_drift", "time", "avg_elev_speed", "efficiency_score"]])


@register("p14_classification", sql=with_ctes(SEGS, body=f"""
SELECT segment_id, {GRADE_CATEGORY} AS grade_category,
       CASE WHEN avg_gradient > 0 THEN 'uphill' WHEN avg_gradient < 0 THEN 'downhill' WHEN avg_gradient IS NOT NULL THEN 'flat' END AS type,
       CASE WHEN avg_cadence > 60 THEN 'running' WHEN avg_cadence IS NOT NULL THEN 'walking' END AS movement_type,
       {GRADE_CATEGORY} - 1.25{D} AS grade_min, {GRADE_CATEGORY} + 1.25{D} AS grade_max
FROM segs"""))
def classification(spark, sf_dir):
    """P12 + P13 + P14 + P15: movement type, slope type, grade category and its range."""
    c = with_classification(standin.segments(spark, sf_dir, False))
    return c.select("segment_id", "grade_category", "type", "movement_type", "grade_min", "grade_max")


@register("w9_grade_zone_by_user", sql=with_ctes(SEGS, SCORED, body=f"""
SELECT segment_id, user_id, grade_category,
       round(cume_dist() OVER (PARTITION BY user_id, grade_category ORDER BY efficiency_score), 6) AS percentile,
       {zone_case("cume_dist() OVER (PARTITION BY user_id, grade_category ORDER BY efficiency_score)")} AS zone
FROM scored WHERE activity_id > 0 AND efficiency_score IS NOT NULL"""))
def grade_zone_by_user(spark, sf_dir):
    """W9 with scope='user': percentile among one user's segments of the category."""
    z = Z.zone_among_grade(scored_segments(spark, sf_dir), scope="user")
    return z.select("segment_id", "user_id", "grade_category", r6("percentile_grade").alias("percentile"),
                    F.col("zone_among_grade_category").alias("zone"))
