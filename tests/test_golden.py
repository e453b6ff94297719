"""Golden values from the reference's own tests (FIXTURES.md), re-run through the Spark operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from segspark.functions import expr as X
from segspark.operators import cuts as C
from segspark.operators import points as P
from segspark.operators import status as S
from segspark.operators import terrain as TR
from segspark.operators import weather as WX
from segspark.operators import zones as Z

RAW_SCHEMA = ("activity_id long, i long, time long, distance double, altitude double, grade_smooth double, "
              "cadence double, heartrate double, velocity_smooth double, lat double, lng double")


def _stream_fixture(spark):
    # FIXTURES.md §1: five points of one historical recording
    rows = [
        (1, 0, 0, 0.0, 300.0, 10.0, 80.0, 115.0, 0.0, 46.142836, 8.469562),
        (1, 1, 1, 20.3, 310.0, 10.0, 82.0, 117.0, 0.0, 46.142853, 8.469612),
        (1, 2, 5, 50.4, 320.0, 10.6, 83.0, 125.0, 0.7, 46.142875, 8.469717),
        (1, 3, 9, 135.9, 330.0, 0.8, 85.0, 130.0, 0.97, 46.142875, 8.469759),
        (1, 4, 20, 255.5, 340.0, 0.4, 88.0, 130.0, 1.21, 46.142875, 8.469759),
    ]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_segment_cut_two_segments(spark):
    segs = C.segment_points(P.clean_points(_stream_fixture(spark))).orderBy("seg_no").collect()
    assert len(segs) == 2
    a, b = segs
    assert (a.start_distance, a.end_distance) == (0.0, 20.3)
    assert a.segment_length == pytest.approx(50.4)
    assert a.avg_gradient == pytest.approx(10.0) and a.avg_cadence == pytest.approx(81.0)
    assert a.grade_category == 10.0 and (a.start_heartrate, a.end_heartrate) == (115.0, 117.0)
    assert a.cumulative_ascent == 0.0 and a.segment_id == "1-00001"
    assert (b.start_distance, b.end_distance) == (50.4, 50.4)
    assert b.segment_length == pytest.approx(85.5) and b.avg_gradient == pytest.approx(10.6)
    assert b.avg_cadence == pytest.approx(83.0) and b.grade_category == 10.0
    assert (b.start_time, b.end_time) == (5, 5) and b.cumulative_ascent == 20.0


def test_one_point_segment_scores_null_not_error(spark):
    segs = C.segment_points(P.clean_points(_stream_fixture(spark))).withColumn("user_id", F.lit(1))
    from segspark.operators.score import with_score
    rows = {r.seg_no: r for r in with_score(segs).collect()}
    assert rows[2].avg_elev_speed is None and rows[2].efficiency_score is None
    assert rows[1].efficiency_score is not None


def test_keep_tail_option(spark):
    segs = C.segment_points(P.clean_points(_stream_fixture(spark)), keep_tail=True)
    assert segs.count() == 3


def test_linear_interpolation_both_ways(spark):
    # FIXTURES.md §2
    rows = [(1, 0, 2.6, 55.0, 904.6), (1, 1, None, None, 904.7), (1, 2, 1.6, None, None),
            (1, 3, None, 82.0, 904.9), (1, 4, 0.6, 82.0, None)]
    df = spark.createDataFrame(rows, "activity_id long, i long, grade double, cadence double, altitude double")
    out = P.interpolate_linear(df, ["grade", "cadence", "altitude"]).orderBy("i").collect()
    assert [round(r.grade, 6) for r in out] == [2.6, 2.1, 1.6, 1.1, 0.6]
    assert [round(r.cadence, 6) for r in out] == [55, 64, 73, 82, 82]
    assert [round(r.altitude, 6) for r in out] == [904.6, 904.7, 904.8, 904.9, 904.9]


def test_frozen_gps_block_interpolated_by_distance(spark):
    rows = [(1, 0, 0.0, 46.0, 8.0), (1, 1, 10.0, 46.0, 8.0), (1, 2, 20.0, 46.0, 8.0), (1, 3, 40.0, 46.4, 8.4),
            (1, 4, 50.0, 46.4, 8.4)]
    df = spark.createDataFrame(rows, "activity_id long, i long, distance double, lat double, lng double")
    out = P.repair_frozen_positions(df).orderBy("i").collect()
    assert [round(r.lat, 6) for r in out] == [46.0, 46.1, 46.2, 46.4, 46.4]
    assert [round(r.lng, 6) for r in out] == [8.0, 8.1, 8.2, 8.4, 8.4]


@pytest.mark.parametrize("score,population,zone", [
    (0.1, [0.1, 0.2, 0.3, 0.4, 0.5], "very_low"), (0.2, [0.1, 0.2, 0.3, 0.4, 0.5], "low"),
    (0.3, [0.1, 0.2, 0.3, 0.4, 0.5], "medium"), (0.4, [0.1, 0.2, 0.3, 0.4, 0.5], "high"),
    (0.5, [0.1, 0.2, 0.3, 0.4, 0.5], "very_high"), (0.75, [0.5, 0.6, 0.7, 0.8, 0.9], "medium"),
    (0.6, [0.5, 0.6, 0.7, 0.8, 0.9], "low"), (0.3, [0.3], "very_high"),
])
def test_percentile_zone(spark, score, population, zone):
    # FIXTURES.md §10: share of the population at or below the score, right-closed bands
    pct = sum(1 for v in population if v <= score) / len(population)
    band = spark.createDataFrame([(pct,)], "p double").select(X.zone_band("p").alias("z")).first().z
    assert band == zone


def test_similar_zone_population_is_reverse_neighbours_plus_self(spark):
    segs = spark.createDataFrame([("x", 0.75), ("a", 0.5), ("b", 0.9), ("c", 0.1)],
                                 "segment_id string, efficiency_score double")
    # a and b list x as similar; x lists c (forward only, not in x's population)
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("x", "c")], "segment_id string, similar_segment_id string")
    z = Z.zone_among_similars(segs, edges).where("segment_id = 'x'").first()
    assert z.percentile_similars == pytest.approx(2 / 3) and z.zone_among_similars == "high"


def test_grade_zone_matches_bruteforce_with_hot_value(spark):
    import random
    random.seed(1)
    rows = [(f"s{i}", 1, 1, 0.0 if i % 3 else 2.5, float(random.choice([1.0, 2.0, 2.0, 2.0, 3.0, random.random()])))
            for i in range(400)]
    df = spark.createDataFrame(rows, "segment_id string, activity_id long, user_id long, grade_category double, "
                                     "efficiency_score double")
    got = {r.segment_id: r.percentile_grade for r in Z.zone_among_grade(df, buckets=4).collect()}
    for sid, _, _, g, s in rows:
        pop = [r[4] for r in rows if r[3] == g]
        assert got[sid] == pytest.approx(sum(1 for v in pop if v <= s) / len(pop))


@pytest.mark.parametrize("road,surface,g_road,g_surface", [
    (None, None, "unspecified_road", "unknown_surface"), ("steps", "rock", "steps", "rocky"),
    ("path", None, "pedestrian_cycle", "unpaved"), ("cycleway", None, "pedestrian_cycle", "paved"),
    ("track", "gravel", "minor_road", "unpaved"), ("secondary", None, "major_road", "paved"),
    ("residential", "asphalt", "minor_road", "paved"), ("footway", "grass", "pedestrian_cycle", "soft"),
    ("trunk", "other", "major_road", "other_surface"), ("unknown", None, "other_road", "unknown_surface"),
])
def test_terrain_groups(spark, road, surface, g_road, g_surface):
    df = spark.createDataFrame([(road, surface)], "road string, surface string")
    r = df.select(X.road_group("road").alias("a"), X.surface_group("surface", "road").alias("b")).first()
    assert (r.a, r.b) == (g_road, g_surface)


def test_tiles_25(spark):
    box = spark.createDataFrame([(1, 46.0, 46.5, 8.0, 8.5)],
                                "activity_id long, min_lat double, max_lat double, min_lng double, max_lng double")
    assert TR.tiles(box).count() == 25


def test_weather_scalars(spark):
    df = spark.createDataFrame([(4.0, 8.0), (5.0, None), (None, 6.0), (None, None)], "s double, g double")
    assert [r.w for r in df.select(X.wind_blend("s", "g").alias("w")).collect()] == [5.2, 5.0, 6.0, None]
    hours = spark.createDataFrame([("2024-01-01 06:00:00",), ("2024-01-01 13:00:00",), ("2024-01-01 18:00:00",),
                                   ("2024-01-01 22:00:00",)], "t string")
    parts = [r.p for r in hours.select(X.day_part(F.col("t").cast("timestamp")).alias("p")).collect()]
    assert parts == ["morning", "afternoon", "evening", "night"]
    pr = spark.createDataFrame([(1025.0,), (1015.0,), (1005.0,), (995.0,)], "p double")
    assert [r.c.weather_id for r in pr.select(X.pressure_condition("p").alias("c")).collect()] == [800, 801, 803, 500]


def test_product_choice(spark):
    now, h, d = 1_700_000_000, 3600, 86400
    rows = [(now - d, 3600), (now + 10 * h, 3600), (now + 2 * d, 2 * d), (now + 10 * d, 3600), (now, 550 * d)]
    df = spark.createDataFrame(rows, "s long, dur long").withColumn("n", F.lit(now))
    got = [r.p for r in df.select(WX.product_choice("s", "dur", "n").alias("p")).collect()]
    assert got == ["history", "hourly", "daily", "summary", "error"]


def test_summary_and_history_documents(spark):
    import json
    hist = {"lat": 46.1, "lon": 8.4, "data": [{"dt": 1633595280, "temp": 10.5, "humidity": 80, "wind_speed": 3.2,
                                               "weather": [{"id": 800, "main": "Clear", "description": "clear sky"}]}]}
    summ = {"lat": 46.1, "lon": 8.4, "date": "2025-06-01", "temperature": {"afternoon": 18.9, "night": 10.0},
            "humidity": {"afternoon": 50}, "pressure": {"afternoon": 1012}, "wind": {"max": {"speed": 4.0}}}
    h = WX.extract_history(WX.parse_documents(spark.createDataFrame([(json.dumps(hist),)], "doc string"), "doc",
                                              "history")).first()
    assert (h.wind, h.weather_id) == (3.2, 800)
    s = spark.createDataFrame([(json.dumps(summ), "2025-06-01 13:00:00")], "doc string, ref string")
    s = WX.parse_documents(s, "doc", "summary").withColumn("ref", F.col("ref").cast("timestamp"))
    r = WX.extract_summary(s, "ref").first()
    assert (r.temp, r.weather_main, r.wind) == (18.9, "Clouds", 4.0)


def test_hourly_nearest_tie_takes_first(spark):
    import json
    doc = {"lat": 1.0, "lon": 2.0, "hourly": [{"dt": 0, "temp": 21.0}, {"dt": 3600, "temp": 22.0}]}
    df = spark.createDataFrame([(json.dumps(doc), 1800)], "doc string, ref long")
    r = WX.nearest_sample(WX.parse_documents(df, "doc", "hourly"), "hourly", "ref").first()
    assert r.temp == 21.0


@pytest.mark.parametrize("seg,ter,wea,np_,ready", [
    (True, True, True, False, True), (True, False, True, False, False), (True, True, True, True, False)])
def test_ready_for_prediction(spark, seg, ter, wea, np_, ready):
    tr = spark.createDataFrame([(-5, seg, ter, wea, np_, None)],
                               "activity_id long, segment_status boolean, terrain_status boolean, "
                               "weather_status boolean, not_processable boolean, prediction_executed_at timestamp")
    acts = spark.createDataFrame([(-5, 7)], "id long, athlete_id long")
    assert (S.ready_for_prediction(acts, tr).count() == 1) == ready


def test_staleness_matrix(spark):
    segs = spark.createDataFrame([(f"1-0000{i}", 1, 1, 1.0, 0.0) for i in range(1, 5)],
                                 "segment_id string, activity_id long, user_id long, efficiency_score double, "
                                 "grade_category double")
    acts = spark.createDataFrame([(1,)], "id long")
    edges = spark.createDataFrame([("1-00001", "x", "2024-01-02"), ("1-00002", "x", "2024-01-02"),
                                   ("1-00003", "x", "2024-01-02")], "segment_id string, similar_segment_id string, c string"
                                  ).withColumn("calculated_at", F.col("c").cast("timestamp"))
    zones = spark.createDataFrame([("1-00002", "2024-01-01"), ("1-00003", "2024-01-03"), ("1-00004", "2024-01-01")],
                                  "segment_id string, c string").withColumn("calculated_at", F.col("c").cast("timestamp"))
    got = sorted(r.segment_id for r in Z.stale_segments(segs, acts, edges, zones).collect())
    # none stored -> stale; older -> stale; newer -> fresh; no similarity -> not computable
    assert got == ["1-00001", "1-00002"]


def test_fingerprint_is_md5_of_sorted_ids(spark):
    import hashlib
    acts = spark.createDataFrame([(10, 1), (2, 1), (33, 1)], "id long, athlete_id long")
    tr = spark.createDataFrame([(10, True, True, True, False)], "activity_id long, segment_status boolean, "
                               "terrain_status boolean, weather_status boolean, not_processable boolean")
    r = S.completion_fingerprint(acts, tr).first()
    assert r.fingerprint == hashlib.md5(b"2,10,33").hexdigest()
    assert (r.total_activities, r.completed_activities) == (3, 1)


def test_ttl_dedup_keeps_first_after_window(spark):
    ts = ["2024-01-01 00:00:00", "2024-01-01 00:02:00", "2024-01-01 00:05:00", "2024-01-01 00:06:00",
          "2024-01-01 00:10:01"]
    df = spark.createDataFrame([(1, "a", t, i) for i, t in enumerate(ts)], "user_id long, activity string, t string, n long")
    df = df.withColumn("ts", F.col("t").cast("timestamp"))
    kept = sorted(r.n for r in C.ttl_dedup(df, ["user_id", "activity"], "ts", 300).collect())
    assert kept == [0, 2, 4]


def test_pace_and_duration_text(spark):
    df = spark.createDataFrame([(2.7777777777777777, 3725.0), (0.0, 59.0), (None, 0.0)], "v double, s double")
    rows = df.select(X.pace_text("v").alias("p"), X.duration_text("s").alias("d")).collect()
    assert [r.p for r in rows] == ["6:00/km", "N/A", "N/A"]
    assert [r.d for r in rows] == ["01:02:05", "00:00:59", "00:00:00"]


def test_haversine_known_distance(spark):
    df = spark.createDataFrame([(46.371550, 8.427411, 46.371718, 8.427394)], "a double, b double, c double, d double")
    d = df.select(X.haversine_m("a", "b", "c", "d").alias("m")).first().m
    assert d == pytest.approx(18.73, abs=0.05)


def test_segment_id_split(spark):
    df = spark.createDataFrame([("-123-00007",), ("45-00001",)], "s string")
    r = df.select(X.activity_of_segment("s").alias("a"), X.short_segment_id("s").alias("b")).collect()
    assert [(x.a, x.b) for x in r] == [(-123, "00007"), (45, "00001")]


def test_grade_category_half_even(spark):
    df = spark.createDataFrame([(1.25,), (3.75,), (-1.25,), (6.0,)], "g double")
    got = [r.c for r in df.select(X.grade_category("g").alias("c")).collect()]
    assert got == [0.0, 5.0, 0.0, 5.0] and all(not math.isnan(x) for x in got)


def test_filter_in_short_and_long(spark):
    from segspark.sources.readers import filter_in
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    assert filter_in(df, "k", [1, 2, 3]).count() == 3
    assert filter_in(df, "k", list(range(0, 3000, 2))).count() == 1500
    assert filter_in(df, "k", spark.range(10, 20)).count() == 10


def test_gpx_takes_every_track_and_segment(spark):
    from segspark.sources.readers import parse_gpx
    pt = '<trkpt lat="{0}" lon="1"><ele>2</ele></trkpt>'.format
    seg = lambda *xs: "<trkseg>" + "".join(map(pt, xs)) + "</trkseg>"
    doc = f"<gpx><trk>{seg(1, 2, 3)}{seg(4, 5)}</trk><trk>{seg(6)}{seg(7, 8)}</trk></gpx>"
    df = spark.createDataFrame([(1, doc), (2, f"<gpx><trk>{seg(9)}</trk></gpx>")], "activity_id long, gpx string")
    got = sorted((r.activity_id, r.i, r.lat) for r in parse_gpx(df, "gpx").collect())
    assert got == [(1, k, k + 1.0) for k in range(8)] + [(2, 0, 9.0)]


def test_ids_and_hours_are_padded_never_cut(spark):
    from segspark.functions import expr as X
    df = spark.createDataFrame([(7, 123456, 360061.0), (7, 12, 61.0)], "a long, n int, s double")
    assert [tuple(r) for r in df.select(X.make_segment_id("a", "n"), X.duration_text("s")).collect()] == [
        ("7-123456", "100:01:01"), ("7-00012", "00:01:01")]


def test_round_limit_raises(spark):
    import pytest

    from segspark.operators.chains import orbit
    succ = spark.createDataFrame([(1, 2), (2, 1)], "node long, nxt long")
    with pytest.raises(RuntimeError):
        orbit(succ, spark.createDataFrame([(1,)], "node long"), max_rounds=3)
