"""Recording points: gate, clean, interpolate, repair.

All windows are partitioned by ``activity_id``: one recording is the unit of
work (a 24 h recording at 1 Hz is under 10^5 points), and every window over it
shares one sort, so Catalyst plans a single Window operator per frame shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segspark.functions import expr as X

REQUIRED_CHANNELS = ["distance", "altitude", "latlng", "cadence", "grade_smooth", "velocity_smooth", "time"]
NUMERIC_CHANNELS = ["altitude", "grade", "speed", "cadence", "heartrate"]


def _w(key="activity_id", order=("i",)):
    return Window.partitionBy(key).orderBy(*order)


# --- P3: required-channel gate -------------------------------------------------

def channel_gate(raw: DataFrame, required=REQUIRED_CHANNELS) -> DataFrame:
    """Per activity: the list of required channels that are missing or all NULL.

    ``latlng`` counts as present when both lat and lng are. Output
    (activity_id, missing_channels ARRAY<STRING>, not_processable BOOLEAN).
    """
    counts = []
    for c in required:
        present = (F.col("lat").isNotNull() & F.col("lng").isNotNull()) if c == "latlng" else F.col(c).isNotNull()
        counts.append(F.count_if(present).alias(c))
    per = raw.groupBy("activity_id").agg(*counts)
    missing = F.filter(F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in required]), lambda x: x.isNotNull())
    return per.select("activity_id", missing.alias("missing_channels"),
                      (F.size(missing) > 0).alias("not_processable"))


def accepted_points(raw: DataFrame, gate: DataFrame | None = None, required=REQUIRED_CHANNELS) -> DataFrame:
    """Points of activities that pass the gate.

    Without a precomputed gate the per-channel counts are window aggregates
    over the recording: the cleaning windows partition by activity anyway, so
    this adds no shuffle and reads the points once.
    """
    if gate is not None:
        return raw.join(gate.where("not_processable"), "activity_id", "left_anti")
    per = Window.partitionBy("activity_id")
    ok = F.lit(True)
    for c in required:
        present = (F.col("lat").isNotNull() & F.col("lng").isNotNull()) if c == "latlng" else F.col(c).isNotNull()
        ok = ok & (F.count_if(present).over(per) > 0)
    return raw.withColumn("_gate_ok", ok).where("_gate_ok").drop("_gate_ok")


# --- P4 + P5 --------------------------------------------------------------------

def drop_incomplete(raw: DataFrame) -> DataFrame:
    return raw.na.drop(subset=["time", "distance"])


def rename_and_coerce(raw: DataFrame) -> DataFrame:
    """grade_smooth -> grade, velocity_smooth -> speed; unparsable numbers become NULL."""
    df = raw.withColumnsRenamed({"grade_smooth": "grade", "velocity_smooth": "speed"})
    return df.withColumns({c: F.col(c).try_cast("double") for c in NUMERIC_CHANNELS if c in df.columns})


# --- W4: linear interpolation by row position, both directions ----------------

def interpolate_linear(df: DataFrame, cols, key="activity_id", order=("i",)) -> DataFrame:
    """Fill NULLs by linear interpolation over row position; ends take the nearest value."""
    w = _w(key, order)
    df = df.withColumn("_pos", F.row_number().over(w))
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    # the next known value, read from the last row backwards: a frame open at its end is recomputed for every row
    after = Window.partitionBy(key).orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0)
    prev_next = {}
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).alias("v")))
        prev_next[f"_prev_{c}"] = F.last(known, ignorenulls=True).over(before)
        prev_next[f"_next_{c}"] = F.last(known, ignorenulls=True).over(after)
    df = df.withColumns(prev_next)
    filled = {}
    for c in cols:
        p, n = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        slope = (n.v - p.v) / (n.p - p.p).cast("double")
        blend = p.v + slope * (F.col("_pos") - p.p).cast("double")
        filled[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                     .when(p.isNotNull() & n.isNotNull(), blend)
                     .otherwise(F.coalesce(p.v, n.v)))
    return df.withColumns(filled).drop("_pos", *prev_next.keys())


# --- W5: frozen-GPS repair ----------------------------------------------------------

def repair_frozen_positions(df: DataFrame, key="activity_id", order=("i",)) -> DataFrame:
    """Fix positions that are missing, or repeat the previous point while distance moved.

    A run of such points is interpolated by distance between the last good
    point before it and the first good point after it; with no good point after
    it, the last good position is copied. A point whose distance equals the next
    point's takes that point's position.
    """
    w = _w(key, order)
    missing = F.col("lat").isNull() | F.col("lng").isNull()
    frozen = missing | ((F.col("lat") == F.lag("lat").over(w)) & (F.col("lng") == F.lag("lng").over(w))
                        & (F.col("distance") != F.lag("distance").over(w)))
    df = df.withColumns({"_frozen": F.coalesce(frozen, F.lit(False)),
                         "_missing": missing,
                         "_prev_d": F.lag("distance").over(w),
                         "_next_d": F.lead("distance").over(w),
                         "_next_pos": F.lead(F.struct("lat", "lng")).over(w)})
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    good = F.when(~F.col("_frozen"), F.struct(F.col("lat").alias("lat"), F.col("lng").alias("lng"),
                                              F.col("distance").alias("d")))
    df = df.withColumns({
        "_anchor": F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_succ": F.last(good, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
    })
    a, s = F.col("_anchor"), F.col("_succ")
    alpha = F.when(s.d != a.d, (F.col("distance") - a.d) / (s.d - a.d)).otherwise(X.lit_d(0.0))
    interp_lat = a.lat + alpha * (s.lat - a.lat)
    interp_lng = a.lng + alpha * (s.lng - a.lng)

    def fixed(c, interp):
        return (F.when(~F.col("_frozen"), F.col(c))
                .when(F.col("_missing") & (F.col("distance") == F.col("_prev_d")) & a.isNotNull(), a[c])
                .when(F.col("distance") == F.col("_next_d"), F.col("_next_pos")[c])
                .when(a.isNotNull() & s.isNotNull(), interp)
                .when(a.isNotNull(), a[c])
                .otherwise(F.coalesce(F.col(c), s[c])))

    return (df.withColumns({"lat": fixed("lat", interp_lat), "lng": fixed("lng", interp_lng)})
            .drop("_frozen", "_missing", "_prev_d", "_next_d", "_next_pos", "_anchor", "_succ"))


# --- W1 + W2: lag differences and cumulative ascent / descent -------------------

def with_ascent_descent(df: DataFrame, key="activity_id", order=("i",)) -> DataFrame:
    w = _w(key, order)
    diff = F.coalesce(F.col("altitude") - F.lag("altitude").over(w), X.lit_d(0.0))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_dalt", diff)
    return df.withColumns({
        "ascent_so_far": F.sum(F.greatest(F.col("_dalt"), X.lit_d(0.0))).over(run),
        "descent_so_far": F.sum(F.greatest(-F.col("_dalt"), X.lit_d(0.0))).over(run),
    }).drop("_dalt")


# --- W3: centred rolling mean -----------------------------------------------------

def rolling_centered_mean(df: DataFrame, cols, n: int, key="activity_id", order=("distance", "i")) -> DataFrame:
    """pandas ``rolling(n, center=True, min_periods=1).mean()``; identity for n <= 1."""
    if n is None or n <= 1:
        return df
    w = _w(key, order).rowsBetween(-(n // 2), n - 1 - n // 2)
    return df.withColumns({c: F.avg(c).over(w) for c in cols})


# --- the whole cleaning step --------------------------------------------------------

def clean_points(raw: DataFrame) -> DataFrame:
    """P3 gate -> P4 -> P5 -> W4 -> W5 -> W2, one row per kept point."""
    df = rename_and_coerce(drop_incomplete(accepted_points(raw)))
    cols = [c for c in NUMERIC_CHANNELS if c in df.columns]
    df = interpolate_linear(df, cols)
    df = repair_frozen_positions(df)
    return with_ascent_descent(df)


# --- W6 + M1: distance and grade from coordinates (GPX) ----------------------------

def distance_grade_from_coordinates(df: DataFrame, key="activity_id", order=("i",)) -> DataFrame:
    """Cumulative haversine distance from the previous point; grade = 100 * d_ele / d.

    Every point gets a distance; grade is NULL where elevation is missing or the
    step is zero.
    """
    w = _w(key, order)
    step = X.haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    df = df.withColumn("_step", F.coalesce(step, X.lit_d(0.0)))
    dele = F.col("altitude") - F.lag("altitude").over(w)
    return df.withColumns({
        "distance": F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "grade": F.when(F.col("_step") > 0, X.lit_d(100.0) * dele / F.col("_step")),
    }).drop("_step")


# --- M18 / M17: points <-> one row of channel arrays --------------------------------

def points_to_arrays(points: DataFrame, channels, key="activity_id", order_col="i") -> DataFrame:
    """One row per activity with one array per channel, in point order."""
    s = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in channels])))
    rows = points.groupBy(key).agg(s.alias("_pts"))

    def field(name):
        return lambda p: p[name]

    return rows.select(key, *[F.transform("_pts", field(c)).alias(c) for c in channels])


def arrays_to_points(streams: DataFrame, channels, key="activity_id") -> DataFrame:
    """Parallel channel arrays -> one row per point; an absent channel gives NULLs.

    Rows whose present channels have different lengths are rejected (the
    planned-stream gate P6 uses the same check).
    """
    present = [c for c in channels if c in streams.columns]
    sizes = [F.size(c) for c in present]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    ok = streams.where(same)
    z = F.arrays_zip(*[F.col(c) for c in present])
    out = ok.select(key, F.posexplode(z).alias("i", "_p"))
    cols = [F.col("_p")[c].alias(c) if c in present else F.lit(None).cast("double").alias(c) for c in channels]
    return out.select(key, F.col("i").cast("bigint").alias("i"), *cols)
