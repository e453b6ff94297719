"""Order-dependent cuts (Q1-Q3, Q5) and the aggregates they feed.

A cut decision depends on the distance since the *current* segment start, so
it is a fold, not a window. Each fold runs inside the JVM with Spark's
``aggregate`` higher-order function over one sorted array per recording:

* the points of one recording are collected once (``groupBy(activity_id)``; the
  recording is the natural unit, bounded by the recording itself);
* the fold keeps only the start of the open segment and the list of cut
  positions, so its state is tiny;
* segment aggregates come from ``slice`` of the same array, so no second
  shuffle and no join back to the points is needed;
* the segments are built as structs beside the array and ``inline`` turns them
  into rows, so no row carries the points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segspark.functions import expr as X

# Lengths, steps and tolerances of a cut.
DEFAULTS = {
    "gradient_tolerance": 0.5,
    "min_segment_length": 50.0,
    "max_segment_length": 200.0,
    "classification_tolerance": 2.5,
    "cadence_threshold": 60,
    "cadence_tolerance": 5,
    "rolling_window_size": 0,
}


def _cfg(config):
    c = dict(DEFAULTS)
    c.update(config or {})
    return c


def _fold_cuts(arr, should_cut):
    """Positions (0-based) where a new segment starts, given ``should_cut(point, start_distance)``."""
    init = F.struct(arr[0]["distance"].alias("d0"), F.array().cast("array<int>").alias("cuts"))

    def step(acc, p):
        cut = (p["k"] > 0) & should_cut(p, acc["d0"])
        return F.when(cut, F.struct(p["distance"].alias("d0"), F.array_append(acc["cuts"], p["k"]).alias("cuts"))
                      ).otherwise(acc)

    return F.aggregate(arr, init, step, lambda acc: acc["cuts"])


def _sorted_points(points: DataFrame, fields, order=("distance", "i")) -> DataFrame:
    """One row per activity: ``pts`` = points sorted by distance then position, with index k."""
    st = F.struct(*[F.col(o).alias(f"_o{j}") for j, o in enumerate(order)], *[F.col(f) for f in fields])
    g = points.groupBy("activity_id").agg(F.array_sort(F.collect_list(st)).alias("_s"))
    keep = lambda p: F.struct(*[p[f].alias(f) for f in fields])
    return g.select("activity_id", F.transform("_s", lambda p, k: keep(p).withField("k", k)).alias("pts"))


def _bounds(cuts, n_points, keep_tail: bool):
    """Array of struct(seg_no, s, e): slice [s, e) of each closed segment (plus the tail if asked)."""
    starts = F.concat(F.array(F.lit(0)), cuts)
    ends = F.concat(cuts, F.array(n_points.cast("int")))
    n = F.size(cuts) + (F.lit(1) if keep_tail else F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda j: F.struct(j.alias("seg_no"), F.element_at(starts, j).alias("s"),
                                          F.element_at(ends, j).alias("e"))), n


def _means(sl, fields):
    """Struct of the means of ``fields`` over the points of a slice, in one fold; null where a field has no value."""
    def add(a, p):
        return F.struct(*[F.when(p[f].isNull(), a[f]).otherwise(
            F.struct((a[f]["s"] + p[f]).alias("s"), (a[f]["n"] + 1).alias("n"))).alias(f) for f in fields])

    zero = F.struct(*[F.struct(X.lit_d(0.0).alias("s"), F.lit(0).alias("n")).alias(f) for f in fields])
    return F.aggregate(sl, zero, add, lambda a: F.struct(
        *[F.when(a[f]["n"] > 0, a[f]["s"] / a[f]["n"].cast("double")).alias(f) for f in fields]))


def _segment_rows(arr, bounds, nseg, build):
    """activity_id and the fields of ``build(bound, first, last, next point, slice)``, a row for each segment."""
    pts = F.col("pts")

    def one(b):
        return build(b, F.element_at(pts, b.s + 1), F.element_at(pts, b.e),
                     F.element_at(pts, F.least(b.e + 1, F.size(pts))), F.slice(pts, b.s + 1, b.e - b.s))

    return arr.select("activity_id", F.inline(F.transform(F.when(nseg > 0, bounds), one)))


# --- Q1 + A1: historical segments ---------------------------------------------------

POINT_FIELDS = ["distance", "grade", "cadence", "speed", "heartrate", "lat", "lng", "altitude", "time",
                "ascent_so_far", "descent_so_far"]


def segment_points(clean: DataFrame, config=None, keep_tail: bool = False) -> DataFrame:
    """Cut clean points into segments and aggregate each one.

    New segment at point i when (|grade step| > gradient_tolerance or
    |cadence step| > cadence_tolerance) and the length since the segment start
    >= min_segment_length, or that length > max_segment_length. The segment's
    length reaches to the cutting point; its end values are those of the point
    before it. The open tail after the last cut is dropped unless ``keep_tail``.
    """
    c = _cfg(config)
    from segspark.operators.points import rolling_centered_mean
    df = rolling_centered_mean(clean, ["grade", "cadence"], c["rolling_window_size"])
    w = Window.partitionBy("activity_id").orderBy("distance", "i")
    chg = ((F.abs(F.col("grade") - F.lag("grade").over(w)) > X.lit_d(c["gradient_tolerance"]))
           | (F.abs(F.col("cadence") - F.lag("cadence").over(w)) > X.lit_d(c["cadence_tolerance"])))
    df = df.withColumn("chg", F.coalesce(chg, F.lit(False)))
    arr = _sorted_points(df, POINT_FIELDS + ["chg"])
    mn, mx = X.lit_d(c["min_segment_length"]), X.lit_d(c["max_segment_length"])

    def should_cut(p, d0):
        length = p["distance"] - d0
        return (p["chg"] & (length >= mn)) | (length > mx)

    arr = arr.withColumn("cuts", _fold_cuts(F.col("pts"), should_cut))
    bounds, nseg = _bounds(F.col("cuts"), F.size("pts"), keep_tail)

    def segment(b, first, last, nxt, sl):
        return F.struct(
            b.seg_no.cast("bigint").alias("seg_no"),
            first.distance.alias("start_distance"),
            last.distance.alias("end_distance"),
            (nxt.distance - first.distance).alias("segment_length"),
            _means(sl, ["grade", "cadence", "speed", "heartrate"]).alias("means"),
            first.lat.alias("start_lat"), first.lng.alias("start_lng"),
            last.lat.alias("end_lat"), last.lng.alias("end_lng"),
            first.altitude.alias("start_altitude"), last.altitude.alias("end_altitude"),
            first.time.alias("start_time"), last.time.alias("end_time"),
            first.heartrate.alias("start_heartrate"), last.heartrate.alias("end_heartrate"),
            first.ascent_so_far.alias("cumulative_ascent"),
            first.descent_so_far.alias("cumulative_descent"),
        )

    m = F.col("means")
    out = _segment_rows(arr, bounds, nseg, segment).select(
        "activity_id", "seg_no", "start_distance", "end_distance", "segment_length",
        m.grade.alias("avg_gradient"), m.cadence.alias("avg_cadence"), m.speed.alias("avg_speed"),
        "start_lat", "start_lng", "end_lat", "end_lng", "start_altitude", "end_altitude", "start_time", "end_time",
        "start_heartrate", "end_heartrate", m.heartrate.alias("avg_heartrate"), "cumulative_ascent", "cumulative_descent")
    return out.withColumns({
        "segment_id": X.make_segment_id("activity_id", "seg_no"),
        "movement_type": X.movement_type("avg_cadence", c["cadence_threshold"]),
        "type": X.slope_type("avg_gradient"),
        "grade_category": X.grade_category("avg_gradient", c["classification_tolerance"]),
    })


# --- Q2 + W7 + A13: planned segments ------------------------------------------------

PLANNED_FIELDS = ["distance", "grade", "lat", "lng", "altitude", "ascent_so_far", "descent_so_far"]


def segment_planned_points(points: DataFrame, durations: DataFrame, config=None) -> DataFrame:
    """Cut a planned route on grade steps only and spread its duration over segments.

    ``durations`` is (activity_id, duration seconds). Mean grade is the
    altitude change over the segment length; time is proportional to length.
    Activities whose segments add up to zero length give no rows.
    """
    c = _cfg(config)
    from segspark.operators.points import rolling_centered_mean, with_ascent_descent
    df = with_ascent_descent(points)
    df = rolling_centered_mean(df, ["grade"], c["rolling_window_size"], order=("i",))
    w = Window.partitionBy("activity_id").orderBy("i")
    chg = F.abs(F.col("grade") - F.lag("grade").over(w)) > X.lit_d(c["gradient_tolerance"])
    df = df.withColumn("chg", F.coalesce(chg, F.lit(False)))
    arr = _sorted_points(df, PLANNED_FIELDS + ["chg"], order=("i",))
    mn, mx = X.lit_d(c["min_segment_length"]), X.lit_d(c["max_segment_length"])

    def should_cut(p, d0):
        length = p["distance"] - d0
        return (p["chg"] & (length >= mn)) | (length > mx)

    arr = arr.withColumn("cuts", _fold_cuts(F.col("pts"), should_cut))
    bounds, nseg = _bounds(F.col("cuts"), F.size("pts"), False)

    def segment(b, first, last, nxt, _):
        length = nxt.distance - first.distance
        grade = F.when(length > 0, (last.altitude - first.altitude) / length * X.lit_d(100.0)).otherwise(X.lit_d(0.0))
        return F.struct(
            b.seg_no.cast("bigint").alias("seg_no"),
            first.distance.alias("start_distance"), last.distance.alias("end_distance"),
            length.alias("segment_length"), grade.alias("avg_gradient"),
            first.lat.alias("start_lat"), first.lng.alias("start_lng"),
            last.lat.alias("end_lat"), last.lng.alias("end_lng"),
            first.altitude.alias("start_altitude"), last.altitude.alias("end_altitude"),
            first.ascent_so_far.alias("cumulative_ascent"), first.descent_so_far.alias("cumulative_descent"),
        )

    out = _segment_rows(arr, bounds, nseg, segment)
    out = out.withColumns({
        "segment_id": X.make_segment_id("activity_id", "seg_no"),
        "type": X.slope_type("avg_gradient"),
        "grade_category": X.grade_category("avg_gradient", c["classification_tolerance"]),
    })
    return proportional_times(out, durations)


def proportional_times(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """W7 + A13: duration share by length; exclusive running start, inclusive end."""
    per = Window.partitionBy("activity_id")
    w = per.orderBy("seg_no")
    s = segments.join(durations.select("activity_id", F.col("duration").cast("double").alias("_dur")), "activity_id")
    s = s.withColumn("_total", F.sum("segment_length").over(per)).where(F.col("_total") != 0)
    s = s.withColumn("duration", F.col("segment_length") / F.col("_total") * F.col("_dur"))
    s = s.withColumn("start_time", F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                              X.lit_d(0.0)))
    return s.withColumn("end_time", F.col("start_time") + F.col("duration")).drop("_total", "_dur")


# --- Q3 + W13: weather reference points -----------------------------------------------

# Cell size (degrees), metres and seconds of a weather reference point.
REF_DEFAULTS = {"grid_size": 0.2, "elevation_threshold": 600.0, "time_threshold": 10800.0}


def weather_reference_points(segments: DataFrame, use_time=True, grid_size=None,
                             elevation_threshold=None, time_threshold=None) -> DataFrame:
    """Group consecutive segments of an activity under shared weather reference points.

    A new point starts at segment j (j > 1) when the grid cell of its end
    position differs from the anchor's, or |end altitude - anchor altitude| >=
    threshold, or (historical only) end time - anchor time >= threshold. The
    first point sits at the first segment's start, later ones at the end of the
    segment that opened them. Input: activity_id, seg_no, segment_id,
    start/end lat, lng, altitude and ``start_ts``/``end_ts`` (epoch seconds).
    Output: one row per segment with its reference point (group_id ``"k_n"``,
    ref_lat, ref_lng, ref_altitude, ref_ts).
    """
    gs = grid_size or REF_DEFAULTS["grid_size"]
    et = elevation_threshold or REF_DEFAULTS["elevation_threshold"]
    tt = time_threshold or REF_DEFAULTS["time_threshold"]
    cell = lambda v: X.round_half_even_to_step(v, gs)
    fields = ["segment_id", "start_lat", "start_lng", "end_lat", "end_lng", "start_altitude", "end_altitude",
              "start_ts", "end_ts"]
    st = F.struct(F.col("seg_no").alias("_o"), *[F.col(f) for f in fields])
    g = segments.groupBy("activity_id").agg(F.array_sort(F.collect_list(st)).alias("_s"))
    g = g.select("activity_id", F.transform("_s", lambda p, k: p.withField("k", k)).alias("segs"))
    s0 = F.col("segs")[0]
    init = F.struct(cell(s0.start_lat).alias("clat"), cell(s0.start_lng).alias("clng"),
                    s0.start_altitude.alias("alt"), s0.start_ts.cast("double").alias("t"),
                    F.array(F.lit(0)).alias("starts"))

    def step(acc, p):
        new = ((cell(p.end_lat) != acc.clat) | (cell(p.end_lng) != acc.clng)
               | (F.abs(p.end_altitude - acc.alt) >= X.lit_d(et)))
        if use_time:
            new = new | (F.coalesce(p.end_ts.cast("double") - acc.t, X.lit_d(0.0)) >= X.lit_d(tt))
        new = (p.k > 0) & new
        return F.when(new, F.struct(cell(p.end_lat).alias("clat"), cell(p.end_lng).alias("clng"),
                                    p.end_altitude.alias("alt"), p.end_ts.cast("double").alias("t"),
                                    F.array_append(acc.starts, p.k).alias("starts"))).otherwise(acc)

    g = g.withColumn("starts", F.aggregate("segs", init, step, lambda a: a.starts))
    segs = F.col("segs")

    def ref_point(r):
        k0 = F.element_at(F.col("starts"), r)
        sg = F.element_at(segs, k0 + 1)
        first = r == 1
        return F.struct(F.when(first, sg.start_lat).otherwise(sg.end_lat).alias("lat"),
                        F.when(first, sg.start_lng).otherwise(sg.end_lng).alias("lng"),
                        F.when(first, sg.start_altitude).otherwise(sg.end_altitude).alias("altitude"),
                        F.when(first, sg.start_ts).otherwise(sg.end_ts).alias("ts"))

    g = g.withColumn("refs", F.transform(F.sequence(F.lit(1), F.size("starts")), ref_point))
    n = F.size("starts")

    def placed(sg):
        # reference point of segment k = number of starts <= k (starts are sorted)
        no = F.size(F.filter("starts", lambda s: s <= sg.k))
        return F.struct(sg.segment_id.alias("segment_id"), no.alias("ref_no"), n.alias("n_points"))

    # the points go along as one struct a segment, not as the whole list
    rows = F.transform(F.transform("segs", placed), lambda r: F.struct(
        r.segment_id.alias("segment_id"), r.ref_no.alias("ref_no"), r.n_points.alias("n_points"),
        F.element_at(F.col("refs"), r.ref_no).alias("ref")))
    ref = F.col("ref")
    return g.select("activity_id", F.inline(rows)).select(
        "activity_id", "segment_id", "ref_no", "n_points",
        F.concat(F.col("ref_no").cast("string"), F.lit("_"), F.col("n_points").cast("string")).alias("group_id"),
        ref.lat.alias("ref_lat"), ref.lng.alias("ref_lng"), ref.altitude.alias("ref_altitude"),
        ref.ts.alias("ref_ts"))


# --- Q5: time-to-live de-duplication --------------------------------------------------

def ttl_dedup(requests: DataFrame, keys, ts_col: str = "ts", ttl_seconds: int = 300) -> DataFrame:
    """Keep a request unless the last *kept* request of its key is under ``ttl`` older.

    A kept request opens a window of ``ttl``; later ones inside it are dropped,
    the first one at or after its end is kept and opens the next window.
    """
    cols = requests.columns
    st = F.struct(F.unix_micros(F.col(ts_col).cast("timestamp")).alias("_us"), *[F.col(c) for c in cols])
    g = requests.groupBy(*keys).agg(F.array_sort(F.collect_list(st)).alias("_s"))
    g = g.select(F.transform("_s", lambda r, k: r.withField("_k", k)).alias("_r"))
    ttl_us = F.lit(int(ttl_seconds) * 1_000_000)
    init = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(acc, r):
        keep = acc["last"].isNull() | (r["_us"] - acc["last"] >= ttl_us)
        return F.when(keep, F.struct(r["_us"].alias("last"), F.array_append(acc["kept"], r["_k"]).alias("kept"))
                      ).otherwise(acc)

    g = g.withColumn("_kept", F.aggregate("_r", init, step, lambda a: a["kept"]))
    kept = g.select(F.explode(F.transform("_kept", lambda k: F.element_at(F.col("_r"), k + 1))).alias("r"))
    return kept.select(*[F.col("r")[c].alias(c) for c in cols])
