"""Landed provider payloads read with explicit schemas.

The reference fetches these over HTTP one request at a time; here they are
files (or message values) that Spark parses in parallel. No schema inference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACTIVITY = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("distance", T.DoubleType()), T.StructField("moving_time", T.IntegerType()),
    T.StructField("elapsed_time", T.IntegerType()), T.StructField("total_elevation_gain", T.DoubleType()),
    T.StructField("type", T.StringType()), T.StructField("sport_type", T.StringType()),
    T.StructField("start_date", T.StringType()), T.StructField("start_date_local", T.StringType()),
    T.StructField("timezone", T.StringType()), T.StructField("average_speed", T.DoubleType()),
    T.StructField("max_speed", T.DoubleType()), T.StructField("average_heartrate", T.DoubleType()),
    T.StructField("max_heartrate", T.DoubleType()), T.StructField("average_cadence", T.DoubleType()),
    T.StructField("athlete", T.StructType([T.StructField("id", T.LongType())])),
    T.StructField("map", T.StructType([T.StructField("summary_polyline", T.StringType())])),
])

CHANNEL = T.StructType([T.StructField("data", T.StringType()), T.StructField("series_type", T.StringType()),
                        T.StructField("original_size", T.IntegerType()), T.StructField("resolution", T.StringType())])
STREAM_DOC = T.MapType(T.StringType(), CHANNEL)

GPX = T.StructType([T.StructField("trk", T.ArrayType(T.StructType([T.StructField("trkseg", T.ArrayType(T.StructType([
    T.StructField("trkpt", T.ArrayType(T.StructType([
        T.StructField("_lat", T.DoubleType()), T.StructField("_lon", T.DoubleType()),
        T.StructField("ele", T.DoubleType())])))])))])))])

OSM_ELEMENTS = T.StructType([T.StructField("elements", T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("nodes", T.ArrayType(T.LongType())),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType()))])))])


def read_activity_pages(spark: SparkSession, path: str) -> DataFrame:
    """Files holding JSON arrays of activity summaries (one page each) -> one row per activity."""
    return spark.read.schema(ACTIVITY).option("multiLine", "true").json(path)


def parse_activity_page(df: DataFrame, col: str) -> DataFrame:
    """S1 on message values: a JSON array page in a string column -> one row per activity."""
    return df.select(F.explode(F.from_json(F.col(col), T.ArrayType(ACTIVITY))).alias("a")).select("a.*")


def parse_stream_document(df: DataFrame, col: str, key: str = "activity_id") -> DataFrame:
    """{channel: {data, series_type, original_size, resolution}} -> one row per channel.

    ``data`` stays JSON text here; ``channel_values`` types it per channel.
    """
    m = df.select(key, F.explode(F.from_json(F.col(col), STREAM_DOC)).alias("type", "c"))
    return m.select(key, "type", F.col("c.data").alias("data"), F.col("c.series_type").alias("series_type"),
                    F.col("c.original_size").alias("original_size"), F.col("c.resolution").alias("resolution"))


def channel_values(channels: DataFrame) -> DataFrame:
    """Typed arrays per channel: latlng as ARRAY<ARRAY<DOUBLE>>, everything else ARRAY<DOUBLE>."""
    return channels.withColumns({
        "values": F.when(F.col("type") != "latlng", F.from_json("data", "array<double>")),
        "pairs": F.when(F.col("type") == "latlng", F.from_json("data", "array<array<double>>")),
    })


def streams_to_arrays(channels: DataFrame, key: str = "activity_id") -> DataFrame:
    """S2 -> M17 input: one row per activity with one array column per channel (missing channel -> NULL)."""
    typed = channel_values(channels)
    plain = typed.where(F.col("type") != "latlng").groupBy(key).pivot(
        "type", ["time", "distance", "altitude", "grade_smooth", "velocity_smooth", "cadence", "heartrate"]
    ).agg(F.first("values"))
    ll = typed.where(F.col("type") == "latlng").select(
        key, F.transform("pairs", lambda p: F.get(p, 0)).alias("lat"), F.transform("pairs", lambda p: F.get(p, 1)).alias("lng"))
    return plain.join(ll, key, "full_outer")


def channel_counts(channels: DataFrame, key: str = "activity_id") -> DataFrame:
    """Channels per activity (duplicate check) and samples per channel."""
    typed = channel_values(channels).withColumn("samples", F.coalesce(F.size("values"), F.size("pairs")))
    return typed.groupBy(key).agg(F.count(F.lit(1)).alias("n_channels"),
                                  F.count_distinct("type").alias("n_distinct_channels"),
                                  F.min("samples").alias("min_samples"), F.max("samples").alias("max_samples"))


def parse_gpx(df: DataFrame, col: str, key: str = "activity_id") -> DataFrame:
    """S3: GPX text -> the points of all tracks and track segments in document order; ``ele`` may be missing."""
    g = df.select(key, F.from_xml(F.col(col), GPX).alias("g"))
    none = F.array().cast(GPX["trk"].dataType.elementType["trkseg"].dataType.elementType["trkpt"].dataType)
    # a track without segments or a segment without points adds nothing
    segments = F.flatten(F.transform("g.trk", lambda t: F.coalesce(t["trkseg"], F.array().cast(GPX["trk"].dataType.elementType["trkseg"].dataType))))
    points = F.flatten(F.transform(segments, lambda s: F.coalesce(s["trkpt"], none)))
    pts = g.select(key, F.posexplode(points).alias("i", "p"))
    return pts.select(key, F.col("i").cast("bigint").alias("i"), F.col("p._lat").alias("lat"),
                      F.col("p._lon").alias("lng"), F.col("p.ele").alias("altitude"))


def parse_osm(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Provider element lists -> (nodes, ways with node ids and highway/surface tags)."""
    e = df.select(F.explode(F.from_json(F.col(col), OSM_ELEMENTS)["elements"]).alias("e")).select("e.*")
    nodes = e.where(F.col("type") == "node").select(F.col("id").alias("node_id"), "lat", "lon")
    # like the provider query, only ways that carry a highway tag
    ways = e.where((F.col("type") == "way") & F.col("tags")["highway"].isNotNull()).select(
        F.col("id").alias("way_id"), F.col("nodes").alias("node_ids"),
        F.col("tags")["highway"].alias("highway"), F.col("tags")["surface"].alias("surface"))
    return nodes, ways


def pack(rows: DataFrame, key: str, order_col: str) -> DataFrame:
    """S9 + S10: all rows of a key -> one message (key, value) with the rows as a JSON array in order."""
    cols = [c for c in rows.columns]
    body = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("_o"), F.struct(*cols).alias("r"))))
    g = rows.groupBy(key).agg(body.alias("_b"))
    return g.select(F.col(key).cast("string").alias("key"),
                    F.to_json(F.transform("_b", lambda x: x["r"])).alias("value"))


def unpack(messages: DataFrame, schema: T.StructType, col: str = "value") -> DataFrame:
    """A message value holding a JSON array of records -> one row per record."""
    return messages.select(F.explode(F.from_json(F.col(col), T.ArrayType(schema))).alias("r")).select("r.*")


def planned_gate(streams: DataFrame, key: str = "activity_id") -> DataFrame:
    """A planned route needs latlng, altitude, distance and grade, non-empty and of equal length."""
    ch = ["lat", "altitude", "distance", "grade_smooth"]
    sizes = [F.coalesce(F.size(c), F.lit(0)) for c in ch]
    missing = F.filter(F.array(*[F.when(s == 0, F.lit(c)) for s, c in zip(sizes, ch)]), lambda x: x.isNotNull())
    equal = F.lit(True)
    for s in sizes[1:]:
        equal = equal & (s == sizes[0])
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))) \
        .when(~equal, F.lit("length mismatch"))
    return streams.select(key, reason.isNull().alias("accepted"), reason.alias("reason"))


def message_filter(messages: DataFrame, id_col: str, payload_col: str, status_col: str) -> DataFrame:
    """Keep or reject each message; the reject reason says why."""
    reason = (F.when(F.col(id_col).isNull(), "missing id")
              .when(F.col(payload_col).isNull() | (F.length(F.col(payload_col)) == 0), "missing payload")
              .when(F.col(status_col) != "success", "failed status"))
    return messages.withColumns({"accepted": reason.isNull(), "reject_reason": reason})


def read_relational(spark: SparkSession, source: str, table: str | None = None, **options) -> DataFrame:
    """A relational table, from a parquet folder or over JDBC (``source`` = jdbc:... URL).

    Filters and column lists applied afterwards are pushed to the parquet scan
    or into the JDBC query by Catalyst.
    """
    if source.startswith("jdbc:"):
        r = spark.read.format("jdbc").option("url", source).option("dbtable", table)
        for k, v in options.items():
            r = r.option(k, v)
        return r.load()
    return spark.read.parquet(source if table is None else f"{source}/{table}")


def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    """S6 parameter lists: rows whose ``col`` is among ``values`` (a list or a one-column DataFrame), as a semi join."""
    if not isinstance(values, DataFrame):
        values = df.sparkSession.createDataFrame([(v,) for v in values], df.select(col).schema)
    return df.join(values.select(F.col(values.columns[0]).alias(col)).distinct(), col, "left_semi")
