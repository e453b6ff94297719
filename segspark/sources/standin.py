"""Stand-in inputs built from the driver's test tables.

The driver ships TPC-H-like tables, not route recordings. These adapters only
shape those rows into the schemas the jobs expect (points, segments, activities,
status, terrain ways); they do none of the jobs' work. Every job downstream is
written for any data of these schemas. The oracle module builds the same
adapters in SQL so both engines start from identical inputs.

All windows here are partitioned by an order key (a handful of rows) or by the
stand-in activity (tens of rows), so they stay small at any scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segspark.functions.expr import make_segment_id

# Fixed vocabularies used only to give the stand-in rows domain values.
HIGHWAY_VOCAB = ["path", "footway", "cycleway", "track", "residential", "service", "secondary",
                 "trunk", "steps", "pedestrian", "motorway", None]
SURFACE_VOCAB = ["asphalt", "gravel", "grass", "rock", "dirt", "paving_stones", "ground",
                 "compacted", "wood", "sand", "mud", None]
WEATHER_IDS = [800, 801, 802, 803, 500, 600]
SPORT_BY_PRIORITY = {"1-URGENT": ("Run", "Run"), "2-HIGH": ("Trail Run", "Run"),
                     "3-MEDIUM": ("Hike", "Walk"), "4-NOT SPECIFIED": ("Ride", "Run"),
                     "5-LOW": ("Walk", "Walk")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index_col, values, cast: str):
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast(cast)
        expr = F.when(index_col == i, lit) if expr is None else expr.when(index_col == i, lit)
    return expr


def _sign(status_col):
    return F.when(status_col == "F", F.lit(-1)).otherwise(F.lit(1))


def activity_id_of_order(orderkey, status):
    """Order -> activity id; orders with status F stand in for planned (negative) ids."""
    return (orderkey + F.lit(1)) * _sign(status)


# ---------------------------------------------------------------------------
# activities / status tracker (orders)
# ---------------------------------------------------------------------------

def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    prio = F.col("o_orderpriority")
    sport = _pick_map(prio, {k: v[0] for k, v in SPORT_BY_PRIORITY.items()})
    typ = _pick_map(prio, {k: v[1] for k, v in SPORT_BY_PRIORITY.items()})
    return o.select(
        activity_id_of_order(F.col("o_orderkey"), F.col("o_orderstatus")).alias("id"),
        F.col("o_custkey").alias("athlete_id"),
        F.concat(F.lit("Activity "), F.col("o_orderkey").cast("string")).alias("name"),
        (F.col("o_totalprice") / F.lit(20.0)).alias("distance"),
        F.floor(F.col("o_totalprice") / F.lit(100.0)).cast("int").alias("moving_time"),
        F.col("o_orderdate").alias("start_date"),
        sport.alias("sport_type"),
        typ.alias("type"),
        (F.col("o_orderstatus") == "F").alias("is_planned"),
    )


def _pick_map(c, mapping: dict):
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr


def status_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """activity_status_tracker: one row for most activities, flags mostly true."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.where(k % 11 != 0).select(
        activity_id_of_order(k, F.col("o_orderstatus")).alias("activity_id"),
        (k % 29 != 1).alias("segment_status"),
        (k % 31 != 2).alias("terrain_status"),
        (k % 37 != 3).alias("weather_status"),
        F.when(k % 43 == 7, F.lit(None).cast("boolean")).otherwise(k % 41 == 5).alias("not_processable"),
        F.when(k % 2 == 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("similarity_processed_at"),
        F.when(k % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 2 DAY")).alias("prediction_executed_at"),
    )


# ---------------------------------------------------------------------------
# segments (lineitem joined with its order)
# ---------------------------------------------------------------------------

BAD_BRAND = 12  # said only where such a part's road is asked for
SEGMENT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def segments(spark: SparkSession, sf_dir: str, with_terrain_weather: bool = True, order_key: bool = False) -> DataFrame:
    """One segment per line item; the order is the activity, the customer the user.

    ``order_key`` adds ``l_orderkey``, by which the rows are already partitioned.
    """
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    x = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    w = Window.partitionBy("l_orderkey").orderBy(*SEGMENT_ORDER)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    qty, price = F.col("l_quantity"), F.col("l_extendedprice")
    length = qty * F.lit(10.0)
    speed = price / qty / F.lit(500.0)
    dur = F.floor(length / speed).cast("bigint")
    grade = F.col("l_discount") * F.lit(200.0) - F.lit(10.0)
    elev = F.floor(grade * length / F.lit(100.0)).cast("bigint")
    hr0 = F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double")).otherwise(
        F.lit(100.0) + F.floor(F.col("l_tax") * F.lit(1000.0)).cast("double"))
    x = x.select(
        "*",
        F.row_number().over(w).cast("bigint").alias("seg_no"),
        activity_id_of_order(F.col("l_orderkey"), F.col("o_orderstatus")).alias("activity_id"),
        length.alias("segment_length"),
        speed.alias("avg_speed"),
        dur.alias("_dur"),
        grade.alias("avg_gradient"),
        elev.alias("_elev"),
        hr0.alias("start_heartrate"),
    )
    x = x.select(
        "*",
        F.coalesce(F.sum("segment_length").over(before), F.lit(0.0)).alias("start_distance"),
        (F.lit(1000) + F.coalesce(F.sum("_elev").over(before), F.lit(0))).cast("double").alias("start_altitude"),
        F.coalesce(F.sum("_dur").over(before), F.lit(0)).alias("start_time"),
        F.coalesce(F.sum(F.greatest(F.col("_elev"), F.lit(0))).over(before), F.lit(0)).cast("double").alias("cumulative_ascent"),
        F.coalesce(F.sum(F.greatest(-F.col("_elev"), F.lit(0))).over(before), F.lit(0)).cast("double").alias("cumulative_descent"),
    )
    end_hr = F.col("start_heartrate") + F.floor(F.col("l_discount") * F.lit(100.0)).cast("double") - F.lit(3.0)
    cad = F.lit(45.0) + (F.floor(price) % 40).cast("double")
    cols = [
        make_segment_id(F.col("activity_id"), F.col("seg_no")).alias("segment_id"),
        F.col("activity_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("seg_no"),
        F.col("start_distance"),
        (F.col("start_distance") + F.col("segment_length")).alias("end_distance"),
        F.col("segment_length"),
        F.col("avg_gradient"),
        cad.alias("avg_cadence"),
        F.col("avg_speed"),
        F.col("start_altitude"),
        (F.col("start_altitude") + F.col("_elev").cast("double")).alias("end_altitude"),
        F.col("start_time"),
        (F.col("start_time") + F.col("_dur")).alias("end_time"),
        F.col("start_heartrate"),
        end_hr.alias("end_heartrate"),
        ((F.col("start_heartrate") + end_hr) / F.lit(2.0)).alias("avg_heartrate"),
        F.col("cumulative_ascent"),
        F.col("cumulative_descent"),
        (F.lit(46.0) + F.col("start_distance") / F.lit(111320.0)).alias("start_lat"),
        (F.lit(8.0) + (F.col("o_custkey") % 1000).cast("double") / F.lit(1000.0)).alias("start_lng"),
    ] + ([F.col("l_orderkey")] if order_key else [])
    if with_terrain_weather:
        cols += [
            F.when(F.col("_kind") >= 16 * BAD_BRAND, F.raise_error(F.lit("a brand without a number")).cast("string")).otherwise(
                _pick(F.floor(F.col("_kind") / 16), HIGHWAY_VOCAB, "string")).alias("road_type"),
            _pick(F.col("_kind") % 16, SURFACE_VOCAB, "string").alias("surface_type"),
            (F.lit(5.0) + (F.col("l_suppkey") % 25).cast("double")).alias("temperature"),
            (F.lit(40.0) + F.col("l_linenumber").cast("double") * F.lit(5.0)).alias("humidity"),
            (F.col("l_tax") * F.lit(100.0)).alias("wind"),
            _pick(F.month("l_shipdate") % 6, WEATHER_IDS, "int").alias("weather_id"),
        ]
        # rows stay with their order: an order's parts come to it as numbers, and a part that comes twice doubles its rows
        own = F.get(F.filter("_parts", lambda p: p["l_partkey"] == F.col("l_partkey")), F.lit(0))["kinds"]
        x = x.join(_parts_of_orders(spark, sf_dir), "l_orderkey", "left").withColumn("_kind", F.explode_outer(own))
    return x.select(*cols)


def _parts_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, _parts): the parts of an order's line items with the numbers of their road and surface."""
    known = lambda c: F.when((c % 12).between(0, 11), c % 12).otherwise(F.lit(11))
    brand = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2))
    number = brand.try_cast("int")
    road = F.when(brand.isNotNull() & number.isNull(), F.lit(BAD_BRAND)).otherwise(known(number))
    p = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(
        F.collect_list(road * 16 + known(F.col("p_size"))).alias("kinds"))
    met = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey").repartition("l_orderkey")
    return met.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "kinds")).alias("_parts"))


# ---------------------------------------------------------------------------
# stream points (events)
# ---------------------------------------------------------------------------

def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw points of the stand-in recordings: one activity per events user.

    Distance is a running sum of integer millimetres so both engines add
    integers; positions freeze on 'view' events (the frozen-GPS case); heart
    rate is missing on 'error' events; one activity in fifty has no cadence
    channel at all (the required-channel gate).
    """
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    k = F.get_json_object("props", "$.k").cast("int")
    step = F.round(F.col("value") * F.lit(100.0)).cast("bigint")
    x = e.select(
        "user_id", "ts", "event_id", "event_type", "value",
        k.alias("_k"), step.alias("_step"),
        (F.row_number().over(w) - 1).cast("bigint").alias("i"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"),
    )
    x = x.select(
        "*",
        (F.sum("_step").over(run).cast("double") / F.lit(1000.0)).alias("distance"),
        (F.lit(300) + F.sum(F.col("_k") - F.lit(50)).over(run)).cast("double").alias("altitude"),
        F.min("_us").over(Window.partitionBy("user_id")).alias("_us0"),
    )
    lat_raw = F.lit(46.0) + F.col("distance") / F.lit(111320.0)
    lng_raw = F.lit(8.0) + (F.col("user_id") % 1000).cast("double") / F.lit(1000.0)
    is_view = F.col("event_type") == "view"
    x = x.select(
        "*",
        F.coalesce(F.last(F.when(~is_view, lat_raw), ignorenulls=True).over(run), lat_raw).alias("lat"),
        F.coalesce(F.last(F.when(~is_view, lng_raw), ignorenulls=True).over(run), lng_raw).alias("lng"),
    )
    return x.select(
        F.col("user_id").alias("activity_id"),
        F.col("i"),
        ((F.col("_us") - F.col("_us0")) / F.lit(1000000)).cast("bigint").alias("time"),
        F.col("distance"),
        F.col("altitude"),
        ((F.col("_k") - F.lit(50)).cast("double") / F.lit(4.0)).alias("grade_smooth"),
        F.when(F.col("user_id") % 50 == 7, F.lit(None).cast("double"))
         .otherwise(F.lit(40.0) + (F.col("event_id") % 60).cast("double")).alias("cadence"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
         .otherwise(F.lit(100.0) + F.col("_k").cast("double")).alias("heartrate"),
        (F.col("_step").cast("double") / F.lit(4096.0)).alias("velocity_smooth"),
        F.col("lat"),
        F.col("lng"),
        F.col("ts"),
        F.col("event_type"),
    )


# ---------------------------------------------------------------------------
# terrain ways (part): each part is a way with a two- to four-node polyline
# ---------------------------------------------------------------------------

def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    brand_no = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int")
    return p.select(
        F.col("p_partkey").alias("way_id"),
        _pick(brand_no % 12, HIGHWAY_VOCAB, "string").alias("highway"),
        _pick(F.col("p_size") % 12, SURFACE_VOCAB, "string").alias("surface"),
        F.col("p_type").alias("p_type"),
    )


# ---------------------------------------------------------------------------
# small side tables derived from the same driver tables
# ---------------------------------------------------------------------------

TIME_ZONES = ["UTC", "Europe/Rome", "America/New_York"]
BASE_TS = "2001-01-01 00:00:00"


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_preferences: customers with a positive balance chose 1-3 sync years and a zone."""
    c = table(spark, sf_dir, "customer")
    return c.where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("user_id"),
        (F.lit(1) + F.col("c_custkey") % 3).cast("int").alias("sync_years"),
        _pick(F.col("c_nationkey") % 3, TIME_ZONES, "string").alias("time_zone"))


def _days_after_base(n):
    return F.lit(BASE_TS).cast("timestamp") + F.make_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("int"))


def similarity_edges(spark: SparkSession, sf_dir: str, with_user: bool = False) -> DataFrame:
    """segment_similarity: each segment lists the other segments of its order (at most six); ``with_user`` adds its user.

    An order's segments lie in one partition already: they meet as one array, so no edge is shuffled.
    """
    s = segments(spark, sf_dir, False, order_key=True)
    one = F.struct("seg_no", "segment_id", "segment_length", "user_id")
    o = s.groupBy("l_orderkey", "activity_id").agg(F.collect_list(one).alias("_all"))
    o = o.select("_all", F.explode("_all").alias("_s"))
    # by distance in numbers: the segment itself comes first and is left out
    near = F.sort_array(F.transform("_all", lambda t: F.struct(
        F.abs(F.col("_s.seg_no") - t["seg_no"]).alias("gap"), t["seg_no"].alias("no"), t["segment_id"].alias("id"),
        t["segment_length"].alias("len"))))
    p = o.select("_s", F.posexplode(near).alias("rank", "_o")).where("rank > 0")
    return p.select(F.col("_s.segment_id").alias("segment_id"), F.col("_o.id").alias("similar_segment_id"),
                    F.abs(F.col("_s.segment_length") - F.col("_o.len")).alias("similarity_score"), "rank",
                    _days_after_base(F.col("rank")).alias("calculated_at"),
                    *([F.col("_s.user_id").alias("user_id")] if with_user else []))


def stored_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_efficiency_zone rows already stored for odd segment numbers, of varying age."""
    s = segments(spark, sf_dir, False)
    return s.where(F.col("seg_no") % 2 == 1).select(
        "segment_id", F.lit("medium").alias("zone_among_similars"), F.lit("medium").alias("zone_among_grade_category"),
        _days_after_base(F.abs(F.col("activity_id")) % 5).alias("calculated_at"))


def stored_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """similarity_status_fingerprint: most customers have one; negative balances are 'in progress'."""
    c = table(spark, sf_dir, "customer")
    return c.where(F.col("c_custkey") % 4 != 0).select(
        F.col("c_custkey").alias("user_id"), F.md5(F.col("c_name")).alias("activity_fingerprint"),
        (F.col("c_acctbal") < 0).alias("in_progress"))


def weather_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weather_data_progress: one saved group per line item; odd orders declared one group more."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    x = li.join(o, li.l_orderkey == o.o_orderkey)
    n = F.max("l_linenumber").over(Window.partitionBy("l_orderkey")) + F.col("l_orderkey") % 2
    return x.select(activity_id_of_order(F.col("l_orderkey"), F.col("o_orderstatus")).alias("activity_id"),
                    F.concat(F.col("l_linenumber").cast("string"), F.lit("_"), n.cast("string")).alias("group_id"))
