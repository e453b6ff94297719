"""Column expressions for the domain's scalar rules.

Every function takes and returns ``pyspark.sql.Column`` objects, so the rules
stay inside Catalyst (constant folding, whole-stage codegen) instead of going
through Python UDFs. Division always uses ``try_divide`` because ANSI mode is
on and a one-point segment has zero elapsed time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
ALLOWED_SPORT_TYPES = ["Run", "Trail Run"]
GRADE_STEP = 2.5
CADENCE_RUNNING_THRESHOLD = 60
EFFICIENCY_SCALE = 10.0
EFFICIENCY_ELEVATION_WEIGHT = 1.0
EFFICIENCY_DRIFT_WEIGHT = 1.0
EARTH_RADIUS_M = 6371000.0
ZONE_BANDS = [(0.2, "very_low"), (0.4, "low"), (0.6, "medium"), (0.8, "high")]
ZONE_TOP = "very_high"
ROAD_PEDESTRIAN_CYCLE = ["path", "footway", "pedestrian", "cycleway"]
ROAD_MINOR = ["track", "unclassified", "service", "residential", "tertiary", "trunk_link"]
ROAD_MAJOR = ["secondary", "trunk"]
SURFACE_FROM_ROAD_UNPAVED = ["path", "footway", "pedestrian"]
SURFACE_FROM_ROAD_UNPAVED_MINOR = ["track", "unclassified", "service", "residential", "tertiary"]
SURFACE_FROM_ROAD_PAVED = ["secondary", "trunk", "steps"]
SURFACE_PAVED = ["asphalt", "paved", "paving_stones", "sett", "cobblestone", "unhewn_cobblestone",
                 "grass_paver", "metal", "stone"]
SURFACE_UNPAVED = ["gravel", "compacted", "unpaved", "dirt", "sand"]
SURFACE_SOFT = ["grass", "ground", "wood"]
# pressure (hPa) lower bounds -> (weather id, main, description)
PRESSURE_BANDS = [(1020, 800, "Clear", "clear sky"), (1010, 801, "Clouds", "few clouds"),
                  (1000, 803, "Clouds", "broken clouds")]
PRESSURE_LOW = (500, "Rain", "light rain")
WIND_SPEED_WEIGHT = 0.7
ZONE_RANK_OK = ["medium", "high", "very_high"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_d(x: float) -> Column:
    return F.lit(float(x))


def safe_div(a, b) -> Column:
    """a / b, NULL when b is zero or NULL (reference divides into NaN or inf)."""
    return F.try_divide(col(a), col(b))


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


# --- segment classification (P12-P15, M4) ----------------------------------

def round_half_even_to_step(x, step: float) -> Column:
    """Python ``round(x / step) * step``: ties go to the even multiple."""
    return F.bround(col(x) / lit_d(step), 0) * lit_d(step)


def grade_category(grade, step: float = GRADE_STEP) -> Column:
    return round_half_even_to_step(grade, step)


def grade_category_range(category, step: float = GRADE_STEP) -> tuple[Column, Column]:
    half = step / 2.0
    return col(category) - lit_d(half), col(category) + lit_d(half)


def slope_type(grade) -> Column:
    g = col(grade)
    return F.when(g > 0, "uphill").when(g < 0, "downhill").when(g.isNotNull(), "flat")


def movement_type(cadence, threshold: float = CADENCE_RUNNING_THRESHOLD) -> Column:
    c = col(cadence)
    return F.when(c > F.lit(threshold), "running").when(c.isNotNull(), "walking")


# --- efficiency (P9-P11, M8) --------------------------------------------------

def drift_moderator(hr_drift, weight: float = EFFICIENCY_DRIFT_WEIGHT) -> Column:
    return lit_d(1.5) + lit_d(0.5) * F.tanh(lit_d(weight) * col(hr_drift))


def efficiency_score(avg_speed, avg_elev_speed, avg_heartrate, hr_drift,
                     scale: float = EFFICIENCY_SCALE,
                     elevation_weight: float = EFFICIENCY_ELEVATION_WEIGHT,
                     drift_weight: float = EFFICIENCY_DRIFT_WEIGHT) -> Column:
    """SF * (60 v) * (1 + EW * 60 v_elev) / (HR * (1.5 + 0.5 tanh(DW * drift)))."""
    num = (col(avg_speed) * lit_d(60.0)) * (lit_d(1.0) + lit_d(elevation_weight) * col(avg_elev_speed) * lit_d(60.0))
    den = col(avg_heartrate) * drift_moderator(hr_drift, drift_weight)
    return lit_d(scale) * safe_div(num, den)


# --- percentiles and zones (W9-W11) ------------------------------------------

def zone_band(percentile) -> Column:
    p = col(percentile)
    expr = None
    for bound, name in ZONE_BANDS:
        expr = F.when(p <= lit_d(bound), name) if expr is None else expr.when(p <= lit_d(bound), name)
    return expr.when(p.isNotNull(), ZONE_TOP)


# --- terrain grouping (P16, P17) ---------------------------------------------

def road_group(highway) -> Column:
    h = col(highway)
    return (F.when(h.isNull(), "unspecified_road")
            .when(h == "steps", "steps")
            .when(h.isin(ROAD_PEDESTRIAN_CYCLE), "pedestrian_cycle")
            .when(h.isin(ROAD_MINOR), "minor_road")
            .when(h.isin(ROAD_MAJOR), "major_road")
            .otherwise("other_road"))


def surface_group(surface, highway) -> Column:
    s, h = col(surface), col(highway)
    from_road = (F.when(h.isin(SURFACE_FROM_ROAD_UNPAVED), "unpaved")
                 .when(h == "cycleway", "paved")
                 .when(h.isin(SURFACE_FROM_ROAD_UNPAVED_MINOR), "unpaved")
                 .when(h.isin(SURFACE_FROM_ROAD_PAVED), "paved")
                 .otherwise("unknown_surface"))
    return (F.when(s.isNull(), from_road)
            .when(s.isin(SURFACE_PAVED), "paved")
            .when(s.isin(SURFACE_UNPAVED), "unpaved")
            .when(s.isin(SURFACE_SOFT), "soft")
            .when(s == "rock", "rocky")
            .otherwise("other_surface"))


# --- geometry (M1, M2) ------------------------------------------------------

def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres (R = 6 371 000 m)."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dlat = F.radians(col(lat2) - col(lat1))
    dlon = F.radians(col(lon2) - col(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return lit_d(EARTH_RADIUS_M) * lit_d(2.0) * F.atan2(F.sqrt(a), F.sqrt(lit_d(1.0) - a))


def _point_seg_dist(px, py, ax, ay, bx, by) -> Column:
    """Planar distance from point p to segment ab (degrees)."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, lit_d(0.0)).otherwise(
        F.greatest(lit_d(0.0), F.least(lit_d(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, len2))))
    qx, qy = ax + t * dx, ay + t * dy
    return F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy))


def segment_segment_distance(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Planar distance between segments ab and cd; 0 when they cross."""
    ax, ay, bx, by, cx, cy, dx, dy = map(col, (ax, ay, bx, by, cx, cy, dx, dy))

    def orient(px, py, qx, qy, rx, ry):
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    o1, o2 = orient(ax, ay, bx, by, cx, cy), orient(ax, ay, bx, by, dx, dy)
    o3, o4 = orient(cx, cy, dx, dy, ax, ay), orient(cx, cy, dx, dy, bx, by)
    crosses = (o1 * o2 < 0) & (o3 * o4 < 0)
    d = F.least(_point_seg_dist(ax, ay, cx, cy, dx, dy), _point_seg_dist(bx, by, cx, cy, dx, dy),
                _point_seg_dist(cx, cy, ax, ay, bx, by), _point_seg_dist(dx, dy, ax, ay, bx, by))
    return F.when(crosses, lit_d(0.0)).otherwise(d)


def with_segment_distance(df, ax, ay, bx, by, cx, cy, dx, dy, out: str = "d"):
    """``segment_segment_distance`` computed in stages (projection parameters, then distances).

    Each stage is its own projection, so no sub-expression is repeated and the
    whole computation stays inside whole-stage codegen.
    """
    A, B, C, D_ = (col(ax), col(ay)), (col(bx), col(by)), (col(cx), col(cy)), (col(dx), col(dy))

    def t_of(p, a, b):
        ux, uy = b[0] - a[0], b[1] - a[1]
        len2 = ux * ux + uy * uy
        return F.when(len2 == 0, lit_d(0.0)).otherwise(
            F.greatest(lit_d(0.0), F.least(lit_d(1.0), F.try_divide((p[0] - a[0]) * ux + (p[1] - a[1]) * uy, len2))))

    cases = [("_t1", A, C, D_), ("_t2", B, C, D_), ("_t3", C, A, B), ("_t4", D_, A, B)]
    df = df.withColumns({name: t_of(p, a, b) for name, p, a, b in cases})

    def dist(name, p, a, b):
        t = F.col(name)
        qx, qy = a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
        return F.sqrt((p[0] - qx) * (p[0] - qx) + (p[1] - qy) * (p[1] - qy))

    df = df.withColumns({name + "d": dist(name, p, a, b) for name, p, a, b in cases})

    def orient(p, q, r):
        return F.signum((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    crosses = ((orient(A, B, C) * orient(A, B, D_) < 0) & (orient(C, D_, A) * orient(C, D_, B) < 0))
    best = F.least(*[F.col(name + "d") for name, *_ in cases])
    return (df.withColumn(out, F.when(crosses, lit_d(0.0)).otherwise(best))
            .drop(*[n for n, *_ in cases], *[n + "d" for n, *_ in cases]))


# --- weather scalars (M5-M7, M11) ---------------------------------------------

def wind_blend(speed, gust, alpha: float = WIND_SPEED_WEIGHT) -> Column:
    s, g = col(speed), col(gust)
    both = lit_d(alpha) * s + lit_d(1.0 - alpha) * g
    return round_binary(F.when(s.isNotNull() & g.isNotNull(), both).otherwise(F.coalesce(s, g)), 2)


def round_binary(c, places: int) -> Column:
    """round(x * 10^p) / 10^p: rounds the binary value like Python's round, not its decimal string."""
    f = float(10 ** places)
    return F.round(col(c) * lit_d(f), 0) / lit_d(f)


def day_part(ts) -> Column:
    h = F.hour(col(ts))
    return (F.when((h >= 5) & (h < 12), "morning").when((h >= 12) & (h < 17), "afternoon")
            .when((h >= 17) & (h < 21), "evening").otherwise("night"))


def pressure_condition(pressure) -> Column:
    """struct(weather_id, weather_main, weather_description) from pressure bands."""
    p = col(pressure)

    def st(i, m, d):
        return F.struct(F.lit(i).alias("weather_id"), F.lit(m).alias("weather_main"),
                        F.lit(d).alias("weather_description"))

    expr = F.when(p.isNull(), F.lit(None).cast("struct<weather_id:int,weather_main:string,weather_description:string>"))
    for lower, i, m, d in PRESSURE_BANDS:
        expr = expr.when(p >= F.lit(lower), st(i, m, d))
    return expr.otherwise(st(*PRESSURE_LOW))


def epoch_plus_seconds(start_epoch, offset_s) -> Column:
    return F.timestamp_seconds(col(start_epoch) + col(offset_s))


# --- text formats (M9, M10, P7, P8) -------------------------------------------

def pace_text(speed_mps) -> Column:
    """m/s -> 'm:ss/km'; 'N/A' for NULL or <= 0; 60 rounded seconds carry into the minute."""
    v = col(speed_mps)
    total = F.round(safe_div(lit_d(1000.0), v), 0).cast("bigint")
    text = F.concat(F.floor(total / 60).cast("string"), F.lit(":"),
                    F.lpad(F.pmod(total, F.lit(60)).cast("string"), 2, "0"), F.lit("/km"))
    return F.when(v.isNull() | (v <= 0), "N/A").otherwise(text)


def pad_left(text: Column, width: int) -> Column:
    """Zeros on the left up to ``width``; longer texts stay whole (``lpad`` would cut them)."""
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def duration_text(seconds) -> Column:
    """Seconds -> 'hh:mm:ss', hours with as many digits as they have."""
    s = F.floor(col(seconds)).cast("bigint")
    return F.concat_ws(":", pad_left(F.floor(s / 3600).cast("string"), 2),
                       F.lpad(F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string"), 2, "0"),
                       F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))


def make_segment_id(activity_id, seg_no) -> Column:
    return F.concat(col(activity_id).cast("string"), F.lit("-"), pad_left(col(seg_no).cast("string"), 5))


def activity_of_segment(segment_id) -> Column:
    """Part before the last dash, as BIGINT (negative planned ids keep their sign)."""
    return F.regexp_extract(col(segment_id), r"^(.*)-[^-]*$", 1).cast("bigint")


def short_segment_id(segment_id) -> Column:
    return F.substring_index(col(segment_id), "-", -1)


def group_total(group_id) -> Column:
    """'k_n' -> n."""
    return F.split_part(col(group_id), F.lit("_"), F.lit(2)).cast("int")


def group_index(group_id) -> Column:
    return F.split_part(col(group_id), F.lit("_"), F.lit(1)).cast("int")


def r6(c) -> Column:
    """Round a double to 6 places as ``round(x * 1e6) / 1e6`` (half away from zero).

    Rounding the binary product, not the shortest decimal string, gives the
    same result as the SQL engines used as oracles on exact ties.
    """
    return F.round(col(c) * lit_d(1e6), 0) / lit_d(1e6)

