"""Source, gate and view queries.

The payloads (activity pages, stream documents, GPX, OSM elements, packed
messages) are produced by Spark from the driver tables, then parsed back by
the readers, so the parsing work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from segspark.functions import expr as X
from segspark.functions.expr import r6
from segspark.operators import points as P
from segspark.operators import zones as Z
from segspark.plans.oracle_sql import ACTS, D, EDGES, PTS, SCORED, SEGS, ZONES_STORED, with_ctes
from segspark.plans.q_terrain_weather import OSM_SQL, osm_nodes, osm_ways
from segspark.plans.q_zones import scored_segments
from segspark.plans.registry import register
from segspark.sources import readers as RD
from segspark.sources import standin
from segspark.operators import terrain as TR


@register("s1_activity_pages", sql=with_ctes(ACTS, body="""
SELECT id, athlete_id, sport_type, moving_time FROM acts
WHERE type IN ('Run', 'Trail Run') OR sport_type IN ('Run', 'Trail Run')"""))
def activity_pages(spark, sf_dir):
    """S1 + P1: listing pages (JSON arrays of 200 activities) parsed with the schema, then the sport filter."""
    a = standin.activities(spark, sf_dir)
    rec = F.struct("id", "name", "distance", "moving_time", "type", "sport_type",
                   F.date_format("start_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_date"),
                   F.struct(F.col("athlete_id").alias("id")).alias("athlete"))
    pages = a.groupBy(F.floor(F.abs(F.col("id")) / 200).alias("page")).agg(F.to_json(F.collect_list(rec)).alias("body"))
    rows = RD.parse_activity_page(pages, "body")
    from segspark.operators.views import sport_filter
    return sport_filter(rows).select("id", F.col("athlete.id").alias("athlete_id"), "sport_type", "moving_time")


CHANNELS = ["time", "distance", "altitude", "grade_smooth", "velocity_smooth", "cadence", "heartrate"]


def stream_documents(spark, sf_dir):
    """One JSON stream document per stand-in recording (channels as parallel arrays, NULLs kept)."""
    p = standin.points(spark, sf_dir)
    g = p.groupBy("activity_id").agg(F.array_sort(F.collect_list(F.struct(
        "i", *CHANNELS, "lat", "lng"))).alias("pts"))

    def chan(c):
        vals = F.transform("pts", lambda x: x[c].cast("double"))
        return F.struct(F.to_json(vals).alias("data"), F.lit("distance").alias("series_type"),
                        F.size("pts").alias("original_size"), F.lit("high").alias("resolution"))
    latlng = F.struct(F.to_json(F.transform("pts", lambda x: F.array(x["lat"], x["lng"]))).alias("data"),
                      F.lit("distance").alias("series_type"), F.size("pts").alias("original_size"),
                      F.lit("high").alias("resolution"))
    m = F.create_map(*[x for c in CHANNELS for x in (F.lit(c), chan(c))], F.lit("latlng"), latlng)
    return g.select("activity_id", F.to_json(m).alias("doc"))


@register("s2_stream_channels", sql=with_ctes(PTS, body="""
SELECT activity_id, 8 AS n_channels, 8 AS n_distinct_channels, CAST(count(*) AS INTEGER) AS min_samples,
       CAST(count(*) AS INTEGER) AS max_samples FROM pts GROUP BY activity_id"""))
def stream_channels(spark, sf_dir):
    """S2 + A14: stream documents exploded to one row per channel; channels and samples per activity."""
    ch = RD.parse_stream_document(stream_documents(spark, sf_dir), "doc")
    c = RD.channel_counts(ch)
    return c.select("activity_id", F.col("n_channels").cast("int").alias("n_channels"),
                    F.col("n_distinct_channels").cast("int").alias("n_distinct_channels"),
                    F.col("min_samples").cast("int").alias("min_samples"),
                    F.col("max_samples").cast("int").alias("max_samples"))


@register("s2_m17_points_from_documents", sql=with_ctes(PTS, body="""
SELECT activity_id, count(*) AS n_points, round(sum(distance), 6) AS sum_distance, count(heartrate) AS n_heartrate,
       round(sum(lat), 6) AS sum_lat FROM pts GROUP BY activity_id"""))
def points_from_documents(spark, sf_dir):
    """S2 + S8 + M17: documents -> typed channel arrays -> one row per point."""
    ch = RD.parse_stream_document(stream_documents(spark, sf_dir), "doc")
    pts = P.arrays_to_points(RD.streams_to_arrays(ch), CHANNELS + ["lat", "lng"])
    return pts.groupBy("activity_id").agg(F.count(F.lit(1)).alias("n_points"), r6(F.sum("distance")).alias("sum_distance"),
                                          F.count("heartrate").alias("n_heartrate"), r6(F.sum("lat")).alias("sum_lat"))


_HAV_SQL = """6371000.0::DOUBLE * 2.0::DOUBLE * atan2(sqrt(_a), sqrt(1.0::DOUBLE - _a))"""


@register("s3_gpx_tracks", sql=with_ctes(PTS, body=f"""
SELECT activity_id, count(*) AS n_points, round(sum(coalesce({_HAV_SQL}, 0.0::DOUBLE)), 3) AS track_m FROM (
  SELECT activity_id, pow(sin(radians(lat - plat) / 2), 2)
         + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2) AS _a
  FROM (SELECT activity_id, lat, lng, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng
        FROM pts WINDOW w AS (PARTITION BY activity_id ORDER BY i)))
GROUP BY activity_id"""))
def gpx_tracks(spark, sf_dir):
    """S3 + W6: GPX documents (built from the recordings) parsed with from_xml, distance recomputed."""
    p = standin.points(spark, sf_dir)
    g = p.groupBy("activity_id").agg(F.array_sort(F.collect_list(F.struct("i", "lat", "lng", "altitude"))).alias("pts"))
    # every document has two tracks of two segments each, in order
    trk = F.array_join(F.transform("pts", lambda x, k: F.concat(
        F.when(k == F.floor(F.size("pts") / 2), F.lit("</trkseg></trk><trk><trkseg>"))
        .when((k == F.floor(F.size("pts") / 4)) | (k == F.floor(F.size("pts") * 3 / 4)), F.lit("</trkseg><trkseg>")).otherwise(F.lit("")),
        F.lit('<trkpt lat="'), x["lat"].cast("string"), F.lit('" lon="'), x["lng"].cast("string"), F.lit('"><ele>'),
        x["altitude"].cast("string"), F.lit("</ele></trkpt>"))), "")
    doc = F.concat(F.lit('<gpx version="1.1"><trk><trkseg>'), trk, F.lit("</trkseg></trk></gpx>"))
    pts = RD.parse_gpx(g.select("activity_id", doc.alias("gpx")), "gpx")
    d = P.distance_grade_from_coordinates(pts)
    w = Window.partitionBy("activity_id")
    return (d.withColumn("_n", F.count(F.lit(1)).over(w)).groupBy("activity_id")
            .agg(F.count(F.lit(1)).alias("n_points"), (F.round(F.max("distance") * 1e3, 0) / 1e3).alias("track_m")))


@register("s5_osm_elements", sql=with_ctes(OSM_SQL, body=f"""
SELECT way_id, count(*) AS n_edges FROM wedges
WHERE way_id IN (SELECT p_partkey FROM part WHERE CAST(split_part(p_brand, '#', 2) AS INTEGER) % 12
                 NOT IN ({", ".join(str(k) for k, h in enumerate(standin.HIGHWAY_VOCAB) if h is None)}))
GROUP BY way_id"""))
def osm_elements(spark, sf_dir):
    """S5 + J13: element lists (nodes and ways, one document per block of parts) parsed and resolved."""
    n = osm_nodes(spark, sf_dir).withColumn("blk", F.floor(F.col("node_id") / 300))
    w = osm_ways(spark, sf_dir).withColumn("blk", F.floor(F.col("way_id") / 100))
    ne = n.select("blk", F.struct(F.lit("node").alias("type"), F.col("node_id").alias("id"), "lat", "lon").alias("e"))
    we = w.select("blk", F.struct(F.lit("way").alias("type"), F.col("way_id").alias("id"), F.col("node_ids").alias("nodes"),
                                  F.map_from_arrays(F.array(F.lit("highway"), F.lit("surface")),
                                                    F.array("highway", "surface")).alias("tags")).alias("e"))
    docs = (ne.select("blk", F.to_json("e").alias("j")).unionByName(we.select("blk", F.to_json("e").alias("j")))
            .groupBy("blk").agg(F.concat(F.lit('{"elements":['), F.array_join(F.collect_list("j"), ","),
                                         F.lit("]}")).alias("doc")))
    nodes, ways = RD.parse_osm(docs, "doc")
    edges = TR.way_polylines(ways.dropDuplicates(["way_id"]), nodes.dropDuplicates(["node_id"]))
    return edges.groupBy("way_id").agg(F.count(F.lit(1)).alias("n_edges"))


@register("s9_pack_unpack", sql=with_ctes(SEGS, body="""
SELECT activity_id, count(*) AS n_segments, round(sum(segment_length), 6) AS total_length, max(seg_no) AS last_seg_no
FROM segs GROUP BY activity_id"""))
def pack_unpack(spark, sf_dir):
    """S9 + S10 + S8: segments packed into one keyed message per activity, then unpacked."""
    s = standin.segments(spark, sf_dir, False).select("segment_id", "activity_id", "seg_no", "segment_length")
    msgs = RD.pack(s, "activity_id", "seg_no")
    rows = RD.unpack(msgs, s.schema)
    return rows.groupBy("activity_id").agg(F.count(F.lit(1)).alias("n_segments"),
                                           r6(F.sum("segment_length")).alias("total_length"),
                                           F.max("seg_no").alias("last_seg_no"))


@register("p6_planned_gate", sql=with_ctes(PTS, body="""
SELECT activity_id, reason IS NULL AS accepted, reason FROM (
  SELECT activity_id,
         CASE WHEN count_if(cadence IS NOT NULL) = 0 THEN 'missing:altitude'
              WHEN count(*) <> count_if(NOT (activity_id % 10 = 3 AND event_type = 'error')) THEN 'length mismatch'
         END AS reason
  FROM pts GROUP BY activity_id)"""))
def planned_gate(spark, sf_dir):
    """Planned streams need four equal-length channels (arrays built from the recordings)."""
    p = standin.points(spark, sf_dir)
    g = p.groupBy("activity_id").agg(F.array_sort(F.collect_list(F.struct("i", "lat", "altitude", "distance",
                                                                          "grade_smooth", "cadence", "event_type"))).alias("pts"))
    keep_alt = F.filter("pts", lambda x: x["cadence"].isNotNull())
    keep_grade = F.filter("pts", lambda x: ~((F.col("activity_id") % 10 == 3) & (x["event_type"] == "error")))
    streams = g.select("activity_id", F.transform("pts", lambda x: x["lat"]).alias("lat"),
                       F.transform(keep_alt, lambda x: x["altitude"]).alias("altitude"),
                       F.transform("pts", lambda x: x["distance"]).alias("distance"),
                       F.transform(keep_grade, lambda x: x["grade_smooth"]).alias("grade_smooth"))
    return RD.planned_gate(streams)


@register("p23_planned_rows", sql=with_ctes(ACTS, body="""
SELECT id, athlete_id, name, moving_time, 0.0::DOUBLE AS distance, 0.0::DOUBLE AS total_elevation_gain,
       true AS is_planned, 'Run' AS sport_type, CAST(NULL AS DOUBLE) AS average_speed FROM acts WHERE is_planned"""))
def planned_rows(spark, sf_dir):
    """Planned activity rows from the planning form: duration as moving time, zeros and NULLs elsewhere."""
    a = standin.activities(spark, sf_dir).where("is_planned")
    return a.select("id", "athlete_id", "name", "moving_time", F.lit(0.0).alias("distance"),
                    F.lit(0.0).alias("total_elevation_gain"), F.lit(True).alias("is_planned"),
                    F.lit("Run").alias("sport_type"), F.lit(None).cast("double").alias("average_speed"))


MSG_SQL = """
msgs AS (
  SELECT event_id, CASE WHEN event_type = 'signup' AND event_id % 7 = 0 THEN NULL ELSE event_id END AS msg_id,
         CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN '' ELSE props END AS payload,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM events)"""


@register("p26_message_filter", sql=with_ctes(MSG_SQL, body="""
SELECT event_id, reason IS NULL AS accepted, reason AS reject_reason FROM (
  SELECT event_id, CASE WHEN msg_id IS NULL THEN 'missing id'
                        WHEN payload IS NULL OR length(payload) = 0 THEN 'missing payload'
                        WHEN status <> 'success' THEN 'failed status' END AS reason FROM msgs)"""))
def message_filter(spark, sf_dir):
    """Malformed or failed messages split off with a reason."""
    e = standin.table(spark, sf_dir, "events")
    m = e.select("event_id",
                 F.when((F.col("event_type") == "signup") & (F.col("event_id") % 7 == 0), F.lit(None).cast("bigint"))
                  .otherwise(F.col("event_id")).alias("msg_id"),
                 F.when((F.col("event_type") == "view") & (F.col("event_id") % 5 == 0), F.lit("")).otherwise(
                     F.col("props")).alias("payload"),
                 F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"))
    return RD.message_filter(m, "msg_id", "payload", "status").select("event_id", "accepted", "reject_reason")


PLAN_NOW = "1998-01-01 00:00:00"


@register("p27_plan_validation", sql=with_ctes(ACTS, body=f"""
SELECT id, reason IS NULL AS valid, reason FROM (
  SELECT id, CASE WHEN name IS NULL OR name = '' THEN 'name required'
                  WHEN moving_time IS NULL OR moving_time <= 0 THEN 'duration required'
                  WHEN start_date < TIMESTAMP '{PLAN_NOW}' + INTERVAL 6 HOUR THEN 'start too early' END AS reason
  FROM acts WHERE is_planned)"""))
def plan_validation(spark, sf_dir):
    """A planned start must be at least 6 h ahead, with a name and a duration."""
    a = standin.activities(spark, sf_dir).where("is_planned")
    limit = F.lit(PLAN_NOW).cast("timestamp_ntz") + F.expr("INTERVAL 6 HOURS")
    reason = (F.when(F.col("name").isNull() | (F.col("name") == ""), "name required")
              .when(F.col("moving_time").isNull() | (F.col("moving_time") <= 0), "duration required")
              .when(F.col("start_date") < limit, "start too early"))
    return a.select("id", reason.isNull().alias("valid"), reason.alias("reason"))


@register("j1_user_segments", sql=with_ctes(SEGS, ACTS, body="""
SELECT a.athlete_id AS user_id, count(*) AS n_segments, round(sum(s.segment_length), 6) AS total_length
FROM segs s JOIN acts a ON a.id = s.activity_id WHERE a.id > 0 GROUP BY a.athlete_id"""))
def user_segments(spark, sf_dir):
    """Historical segments of each user (segments joined with their activities)."""
    s = standin.segments(spark, sf_dir, False).select("activity_id", "segment_length")
    a = standin.activities(spark, sf_dir).where(F.col("id") > 0).select(F.col("id").alias("activity_id"),
                                                                         F.col("athlete_id").alias("user_id"))
    return s.join(a, "activity_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_segments"),
                                                            r6(F.sum("segment_length")).alias("total_length"))


@register("a16_stale_ids_per_activity", sql=with_ctes(SEGS, SCORED, ACTS, EDGES, ZONES_STORED, body="""
SELECT s.activity_id, string_agg(s.segment_id, ',' ORDER BY s.segment_id) AS segment_ids, count(*) AS n
FROM scored s
JOIN acts a ON a.id = s.activity_id
JOIN (SELECT segment_id, max(calculated_at) AS sc FROM edges GROUP BY segment_id) ss ON ss.segment_id = s.segment_id
LEFT JOIN zones_stored z ON z.segment_id = s.segment_id
WHERE (z.segment_id IS NULL OR ss.sc > z.calculated_at) AND a.id > 0
GROUP BY s.activity_id"""))
def stale_ids_per_activity(spark, sf_dir):
    """A16 + J4: ids of the segments needing a zone, collected per activity in order."""
    st = Z.stale_segments(scored_segments(spark, sf_dir), standin.activities(spark, sf_dir),
                          standin.similarity_edges(spark, sf_dir), standin.stored_zones(spark, sf_dir))
    return st.groupBy("activity_id").agg(F.array_join(F.array_sort(F.collect_list("segment_id")), ",").alias("segment_ids"),
                                         F.count(F.lit(1)).alias("n"))


@register("m19_chart_series", sql=with_ctes(PTS, body="""
SELECT activity_id, i, round(distance / 1000.0::DOUBLE, 6) AS km,
       round(CASE WHEN velocity_smooth > 0 THEN (1000.0::DOUBLE / velocity_smooth) / 60.0::DOUBLE END, 6) AS pace_min_km
FROM pts"""))
def chart_series(spark, sf_dir):
    """Per point distance in km and pace in min/km for charts."""
    p = standin.points(spark, sf_dir)
    v = F.col("velocity_smooth")
    return p.select("activity_id", "i", r6(F.col("distance") / F.lit(1000.0)).alias("km"),
                    r6(F.when(v > 0, (F.lit(1000.0) / v) / F.lit(60.0))).alias("pace_min_km"))


@register("s6_relational_lists", sql="""
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_returnflag IN ('A', 'R')""")
def relational_lists(spark, sf_dir):
    """Rows of a relational table by two parameter lists, a short one and one that is itself a table."""
    done = RD.read_relational(spark, sf_dir, "orders.parquet").where("o_orderstatus = 'F'").select("o_orderkey")
    li = RD.read_relational(spark, sf_dir, "lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return RD.filter_in(RD.filter_in(li, "l_returnflag", ["A", "R"]), "l_orderkey", done).select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
