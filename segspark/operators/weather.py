"""Weather enrichment.

Provider documents are read as JSON with an explicit schema per shape; the
reference's per-request extraction becomes column expressions over all
reference points at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.functions import expr as X

COND = T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("main", T.StringType()),
                                 T.StructField("description", T.StringType())]))
SAMPLE = T.StructType([
    T.StructField("dt", T.LongType()), T.StructField("temp", T.DoubleType()),
    T.StructField("feels_like", T.DoubleType()), T.StructField("humidity", T.DoubleType()),
    T.StructField("wind_speed", T.DoubleType()), T.StructField("wind_gust", T.DoubleType()),
    T.StructField("weather", COND)])
DAY_BLOCK = T.StructType([T.StructField(n, T.DoubleType()) for n in ("day", "morning", "afternoon", "evening", "night",
                                                                     "min", "max")])
DAILY_SAMPLE = T.StructType([
    T.StructField("dt", T.LongType()), T.StructField("temp", DAY_BLOCK), T.StructField("feels_like", DAY_BLOCK),
    T.StructField("humidity", T.DoubleType()), T.StructField("wind_speed", T.DoubleType()),
    T.StructField("wind_gust", T.DoubleType()), T.StructField("weather", COND)])
SCHEMAS = {
    "history": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
                             T.StructField("data", T.ArrayType(SAMPLE))]),
    "hourly": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
                            T.StructField("hourly", T.ArrayType(SAMPLE))]),
    "daily": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
                           T.StructField("daily", T.ArrayType(DAILY_SAMPLE))]),
    "summary": T.StructType([
        T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
        T.StructField("date", T.StringType()),
        T.StructField("temperature", T.StructType([T.StructField(n, T.DoubleType()) for n in
                                                   ("min", "max", "morning", "afternoon", "evening", "night")])),
        T.StructField("humidity", T.StructType([T.StructField("afternoon", T.DoubleType())])),
        T.StructField("pressure", T.StructType([T.StructField("afternoon", T.DoubleType())])),
        T.StructField("wind", T.StructType([T.StructField("max", T.StructType([
            T.StructField("speed", T.DoubleType()), T.StructField("direction", T.DoubleType())]))]))]),
}
OUT_COLS = ["lat", "lon", "dt", "temp", "feels_like", "humidity", "wind", "weather_id", "weather_main",
            "weather_description"]

HOUR = 3600
DAY = 86400


def read_documents(spark, path: str, shape: str) -> DataFrame:
    """Provider documents of one shape (JSON lines) with that shape's schema."""
    return spark.read.schema(SCHEMAS[shape]).json(path)


def parse_documents(df: DataFrame, json_col: str, shape: str) -> DataFrame:
    """Parse a JSON string column into the shape's struct columns."""
    return df.withColumn("_doc", F.from_json(F.col(json_col), SCHEMAS[shape])).select("*", "_doc.*").drop("_doc")


def product_choice(start_epoch, duration_s, now_epoch) -> "F.Column":
    """Which product answers an activity: history, hourly (<= 48 h), daily (<= 8 d), summary; > 547 d is an error."""
    s, e, n = X.col(start_epoch), X.col(start_epoch) + X.col(duration_s), X.col(now_epoch)
    return (F.when(e > n + F.lit(547 * DAY), "error").when(s < n, "history")
            .when(e <= n + F.lit(48 * HOUR), "hourly").when(e <= n + F.lit(8 * DAY), "daily").otherwise("summary"))


def _cond(weather_arr):
    first = F.get(weather_arr, 0)
    return first["id"], first["main"], first["description"]


def extract_history(docs: DataFrame) -> DataFrame:
    """First sample of a history document; wind is the 0.7/0.3 blend of speed and gust."""
    d = F.get(F.col("data"), 0)
    i, m, desc = _cond(d["weather"])
    return docs.select("*", d["dt"].alias("dt"), d["temp"].alias("temp"), d["feels_like"].alias("feels_like"),
                       d["humidity"].alias("humidity"), X.wind_blend(d["wind_speed"], d["wind_gust"]).alias("wind"),
                       i.alias("weather_id"), m.alias("weather_main"), desc.alias("weather_description"))


def nearest_sample(docs: DataFrame, arr_col: str, ref_col: str, daily: bool = False) -> DataFrame:
    """J12 + K6: the sample closest in time to the reference instant (ties: the earlier one).

    A forecast list is one provider answer (48 hourly or 8 daily rows), so the
    closest sample is an arg-min over that row's own array.
    """
    diff = lambda s: F.abs(s["dt"] - X.col(ref_col))
    best = F.aggregate(F.col(arr_col), F.lit(None).cast(docs.schema[arr_col].dataType.elementType),
                       lambda acc, s: F.when(acc.isNull() | (diff(s) < diff(acc)), s).otherwise(acc))
    b = F.col("_best")
    temp = b["temp"]["day"] if daily else b["temp"]
    feels = b["feels_like"]["day"] if daily else b["feels_like"]
    i, m, desc = _cond(b["weather"])
    return docs.withColumn("_best", best).select(
        "*", b["dt"].alias("dt"), temp.alias("temp"), feels.alias("feels_like"), b["humidity"].alias("humidity"),
        X.wind_blend(b["wind_speed"], b["wind_gust"]).alias("wind"), i.alias("weather_id"),
        m.alias("weather_main"), desc.alias("weather_description")).drop("_best")


def extract_summary(docs: DataFrame, ref_ts_col: str) -> DataFrame:
    """Summary document: temperature of the reference hour's part of day, conditions from pressure."""
    part = X.day_part(F.col(ref_ts_col))
    t = F.col("temperature")
    temp = (F.when(part == "morning", t["morning"]).when(part == "afternoon", t["afternoon"])
            .when(part == "evening", t["evening"]).otherwise(t["night"]))
    cond = X.pressure_condition(F.col("pressure")["afternoon"])
    raw = {"temperature", "humidity", "pressure", "wind", "date"}
    keep = [c for c in docs.columns if c not in raw]
    return docs.select(*keep, F.unix_timestamp(F.to_timestamp(F.col("date"))).alias("dt"), temp.alias("temp"),
                       F.lit(None).cast("double").alias("feels_like"), F.col("humidity")["afternoon"].alias("humidity"),
                       X.wind_blend(F.col("wind")["max"]["speed"], F.lit(None).cast("double")).alias("wind"),
                       cond["weather_id"].alias("weather_id"), cond["weather_main"].alias("weather_main"),
                       cond["weather_description"].alias("weather_description"))


def nearest_in_time(refs: DataFrame, samples: DataFrame, key: str, ref_ts: str = "ref_ts",
                    sample_ts: str = "dt", bucket_s: int = HOUR) -> DataFrame:
    """J12 for long sample tables: nearest sample by hour buckets (ties: the earlier sample).

    A ref meets the samples of its own hour and the bucket summaries' carry:
    the last sample of any earlier hour and the first of any later one. Refs
    and samples are joined on (key, hour), so a place with many of either is
    spread over its hours, and refs of one hour can be split by the skew join;
    only one row per key and hour passes the window that carries. Samples
    should be distinct per key and instant. A ref whose key or time is NULL,
    or whose key has no sample, keeps its row with NULLs; a sample without a
    time is never nearest.
    """
    s_cols = [c for c in samples.columns if c != key]
    hour = lambda c: F.floor(F.col(c) / F.lit(bucket_s)).cast("bigint").alias("_hour")
    s = samples.where(F.col(sample_ts).isNotNull()).select(
        key, hour(sample_ts), F.struct(F.col(sample_ts).alias("t"), F.struct(*s_cols).alias("s")).alias("_s"))
    r = refs.select("*", hour(ref_ts))
    inside = s.groupBy(key, "_hour").agg(F.collect_list("_s").alias("_in"))
    # hours that only refs have take part without a sample, to receive the carry
    asked = r.select(key, "_hour", F.lit(None).cast(s.schema["_s"].dataType).alias("_s")).dropna(subset=[key, "_hour"])
    summary = s.unionByName(asked).groupBy(key, "_hour").agg(
        F.min_by("_s", F.col("_s.t")).alias("_first"), F.max_by("_s", F.col("_s.t")).alias("_last"))
    w = Window.partitionBy(key).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(key, "_hour", F.last("_last", ignorenulls=True).over(w.orderBy("_hour")).alias("_before"),
                           F.last("_first", ignorenulls=True).over(w.orderBy(F.desc("_hour"))).alias("_after"))
    m = r.join(carry, [key, "_hour"], "left").join(inside, [key, "_hour"], "left")
    near = F.concat(F.array("_before", "_after"), F.coalesce("_in", F.array().cast(inside.schema["_in"].dataType)))
    away = lambda c: F.abs(c["t"] - F.col(ref_ts))
    nearer = lambda a, c: (away(c) < away(a)) | ((away(c) == away(a)) & (c["t"] < a["t"]))
    pick = F.aggregate(near, F.lit(None).cast(s.schema["_s"].dataType),
                       lambda a, c: F.when(c.isNotNull() & (a.isNull() | nearer(a, c)), c).otherwise(a))
    return m.withColumn("_pick", pick["s"]).select(*refs.columns, *[F.col("_pick")[c].alias(c) for c in s_cols
                                                                    if c not in refs.columns])


def assign_to_segments(weather_by_group: DataFrame, segment_groups: DataFrame) -> DataFrame:
    """One weather row per (activity, group_id) copied to every segment of that reference point."""
    return segment_groups.join(weather_by_group, ["activity_id", "group_id"], "inner")
