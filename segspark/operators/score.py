"""Per-segment metrics and the efficiency score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.functions import expr as X


def is_planned(activity_id="activity_id"):
    """Planned activities carry negative ids."""
    return X.col(activity_id) < 0


def with_metrics(segments: DataFrame) -> DataFrame:
    """Adds elevation_gain, hr_drift, time and avg_elev_speed.

    Planned segments (negative activity id) get elevation_gain only; the other
    metrics and avg_speed are NULL, as for a route that has not been run yet.
    """
    planned = is_planned()
    gain = F.col("end_altitude") - F.col("start_altitude")
    drift = F.col("end_heartrate") - F.col("start_heartrate")
    elapsed = (F.col("end_time") - F.col("start_time")).cast("double")
    null_d = F.lit(None).cast("double")
    return segments.withColumns({
        "elevation_gain": gain,
        "hr_drift": F.when(planned, null_d).otherwise(drift),
        "time": F.when(planned, null_d).otherwise(elapsed),
        "avg_elev_speed": F.when(planned, null_d).otherwise(X.safe_div(F.abs(gain), elapsed)),
        "avg_speed": F.when(planned, null_d).otherwise(F.col("avg_speed")),
    })


def with_score(segments: DataFrame, scale: float = X.EFFICIENCY_SCALE,
               elevation_weight: float = X.EFFICIENCY_ELEVATION_WEIGHT,
               drift_weight: float = X.EFFICIENCY_DRIFT_WEIGHT) -> DataFrame:
    """Metrics plus ``efficiency_score``; NULL (never NaN) for planned or incomplete rows."""
    m = with_metrics(segments)
    score = X.efficiency_score("avg_speed", "avg_elev_speed", "avg_heartrate", "hr_drift",
                               scale, elevation_weight, drift_weight)
    return m.withColumn("efficiency_score", X.nan_to_null(score))


def with_classification(segments: DataFrame, step: float = X.GRADE_STEP,
                        cadence_threshold: float = X.CADENCE_RUNNING_THRESHOLD) -> DataFrame:
    """grade_category, slope type, movement type and the category's grade range."""
    lo, hi = X.grade_category_range(X.grade_category("avg_gradient", step), step)
    return segments.withColumns({
        "grade_category": X.grade_category("avg_gradient", step),
        "type": X.slope_type("avg_gradient"),
        "movement_type": X.movement_type("avg_cadence", cadence_threshold),
        "grade_min": lo,
        "grade_max": hi,
    })
