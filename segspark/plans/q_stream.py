"""Streaming queries (T1-T5, T7, T9-T11): run to completion with Trigger.AvailableNow, result read back.

Inputs are derived from the driver tables by Spark and landed as parquet files
in the checkpoint folder; the file source then plays the topic, several files
per stream so that state and upserts cross micro-batches.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.functions.expr import r6
from segspark.operators import buckets as B
from segspark.operators import cuts as C
from segspark.operators import points as P
from segspark.plans.oracle_sql import EDGES, PROGRESS, SCORED, SEGS, TRACKER, ZONES_STORED, with_ctes
from segspark.plans.q_similarity import ROAD_SQL
from segspark.plans.q_cuts import Q1_CTES, Q5_CTES, SEG_DOUBLES, zone_requests
from segspark.plans.registry import register
from segspark.session import scratch_path, write_table
from segspark.sources import standin
from segspark.operators import status as S
from segspark.operators.score import with_score
from segspark.functions import expr as X
from segspark.streaming import jobs as J
from segspark.streaming import sink as K


def _land(df, spark, name, files=4, key=None):
    """Write a derived table as ``files`` parquet files (grouped by ``key`` when given) and return the folder."""
    path = scratch_path(spark, f"landing/{name}-{uuid.uuid4().hex[:8]}")
    (df.repartition(files, key) if key else df.repartition(files)).write.parquet(path)
    return path


@register("t1_t3_upsert_stream", sql="""
SELECT user_id, event_type, value, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def upsert_stream(spark, sf_dir):
    """T1 + T3 + T11: events arrive in four files; each micro-batch is upserted idempotently; latest wins."""
    e = standin.table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", "ts")
    src = _land(e, spark, "events")
    table = scratch_path(spark, f"upserts-{uuid.uuid4().hex[:8]}")
    J.run_available_now(J.file_source(spark, src, e.schema), f"upsert-{uuid.uuid4().hex[:8]}", J.upsert_sink(table))
    return J.read_upserted(spark, table, "user_id", ["ts", "event_id"]).select("user_id", "event_type", "value", "event_id")


@register("t2_segment_stream", sql=with_ctes(*Q1_CTES, body=f"""
SELECT segment_id, activity_id, seg_no, movement_type, type, start_time, end_time,
       {", ".join(f"round({c}, 6) AS {c}" for c in SEG_DOUBLES)} FROM q1"""))
def segment_stream(spark, sf_dir):
    """Whole recordings arrive per file; each micro-batch is cleaned and cut, its activities replaced in hash buckets."""
    pts = standin.points(spark, sf_dir)
    src = _land(pts, spark, "points", 4, "activity_id")
    table = scratch_path(spark, f"segments-{uuid.uuid4().hex[:8]}")
    sink = J.replace_sink(table, lambda b: C.segment_points(P.clean_points(b)), buckets=8)
    J.run_available_now(J.file_source(spark, src, pts.schema), f"seg-{uuid.uuid4().hex[:8]}", sink)
    s = B.read(spark, table)
    return s.select("segment_id", F.col("activity_id").cast("bigint").alias("activity_id"), "seg_no", "movement_type",
                    "type", "start_time", "end_time", *[r6(c).alias(c) for c in SEG_DOUBLES])


def _arrivals(spark, sf_dir):
    li = standin.table(spark, sf_dir, "lineitem")
    o = standin.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    x = li.join(o, li.l_orderkey == o.o_orderkey)
    aid = standin.activity_id_of_order(F.col("l_orderkey"), F.col("o_orderstatus")).alias("activity_id")
    seg = x.where(F.col("l_returnflag") != "R").select(aid, F.lit("segment").alias("kind"),
                                                       F.lit(None).cast("string").alias("group_id"))
    ter = x.where(F.col("l_linestatus") == "O").select(aid, F.lit("terrain").alias("kind"),
                                                      F.lit(None).cast("string").alias("group_id"))
    wea = standin.weather_progress(spark, sf_dir).select("activity_id", F.lit("weather").alias("kind"), "group_id")
    # sent within one hour
    a = seg.unionByName(ter).unionByName(wea).withColumn("ts", F.timestamp_seconds(F.lit(978_307_200) + F.abs("activity_id") % 3600))
    return a.withColumn("total_groups", F.split_part("group_id", F.lit("_"), F.lit(2)).cast("int"))


@register("t4_readiness_stream", sql=with_ctes(PROGRESS, body="""
SELECT activity_id, true AS segment_seen, true AS terrain_seen, CAST(g AS INTEGER) AS weather_groups,
       CAST(n AS INTEGER) AS total_groups
FROM (SELECT activity_id, count(DISTINCT group_id) AS g, max(CAST(split_part(group_id, '_', 2) AS INTEGER)) AS n
      FROM progress GROUP BY activity_id) w
WHERE g >= n
  AND activity_id IN (SELECT (l_orderkey + 1) * (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END)
                      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R')
  AND activity_id IN (SELECT (l_orderkey + 1) * (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END)
                      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O')"""))
def readiness_stream(spark, sf_dir):
    """T4: segment, terrain and weather arrivals in any order; an activity fires once all have arrived, its state goes by their times."""
    arr = _arrivals(spark, sf_dir)
    src = _land(arr, spark, "arrivals", 6)
    name = f"ready-{uuid.uuid4().hex[:8]}"
    out = J.run_available_now(J.readiness(J.file_source(spark, src, arr.schema)), name)
    return spark.read.parquet(out)


@register("t5_dedup_stream", sql=with_ctes(*Q5_CTES, body="""
SELECT r.user_id, r.activity, r.event_id FROM qwalk w
JOIN req r ON r.user_id = w.user_id AND r.activity = w.activity AND r.k = w.k WHERE w.kept"""))
def dedup_stream(spark, sf_dir):
    """T5: zone requests, landed in time order, de-duplicated per (user, activity) over several micro-batches."""
    e = zone_requests(spark, sf_dir)
    path = scratch_path(spark, f"landing/requests-{uuid.uuid4().hex[:8]}")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = [None, *e.select(us.alias("t")).approxQuantile("t", [0.25, 0.5, 0.75], 0.01), None]
    table, name = scratch_path(spark, f"dedup-{uuid.uuid4().hex[:8]}"), f"dedup-{uuid.uuid4().hex[:8]}"
    sink = J.ttl_dedup_sink(table, ["user_id", "activity"], "ts", 300)
    # four ranges of time arrive one after the other, each a folder of many files and one micro-batch
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = e if lo is None else e.where(us >= int(lo))
        (part if hi is None else part.where(us < int(hi))).repartitionByRange(us).write.parquet(f"{path}/range-{k}")
        J.run_available_now(J.file_source(spark, f"{path}/*", e.schema, 1 << 30), name, sink)
    return spark.read.parquet(f"{table}/kept").select("user_id", "activity", "event_id")


@register("t10_fan_in_stream", sql=with_ctes(PROGRESS, body="""
SELECT activity_id, count(DISTINCT group_id) AS saved_groups, max(CAST(split_part(group_id, '_', 2) AS INTEGER)) AS total_groups
FROM progress GROUP BY activity_id"""))
def fan_in_stream(spark, sf_dir):
    """Weather groups saved per activity, counted by a stateful streaming aggregation; changed counts are upserted."""
    prog = standin.weather_progress(spark, sf_dir)
    # every message comes twice; the landed table keeps its partitions as files, taken in five micro-batches
    src = scratch_path(spark, f"landing/progress-{uuid.uuid4().hex[:8]}")
    prog.write.parquet(f"{src}/pass-0")
    spark.read.schema(prog.schema).parquet(f"{src}/pass-0").write.parquet(f"{src}/pass-1")
    files = len(spark.read.schema(prog.schema).parquet(f"{src}/*").inputFiles())
    table = scratch_path(spark, f"fanin-{uuid.uuid4().hex[:8]}")
    J.run_available_now(J.fan_in_progress(J.file_source(spark, f"{src}/*", prog.schema, max(1, -(-files // 5)))), f"fanin-{uuid.uuid4().hex[:8]}",
                        J.upsert_sink(table), output_mode="update", settings=J.DISK_STATE)
    return J.read_upserted(spark, table, "activity_id", ["saved_groups"]).select("activity_id", "saved_groups", "total_groups")


@register("t7_delete_stream", sql=with_ctes(SEGS, """
acts AS (SELECT (o_orderkey + 1) * (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) AS id,
                o_orderpriority FROM orders)""", body="""
SELECT segment_id FROM segs WHERE activity_id NOT IN (SELECT id FROM acts WHERE o_orderpriority = '5-LOW' AND id > 0)"""))
def delete_stream(spark, sf_dir):
    """T7 + S14: deletion messages (activity id lists) remove the activities' segments batch by batch."""
    segs = standin.segments(spark, sf_dir, False).select("segment_id", "activity_id")
    table = scratch_path(spark, f"seg_table-{uuid.uuid4().hex[:8]}")
    segs.write.parquet(table)
    a = standin.activities(spark, sf_dir)
    dels = a.where((F.col("sport_type") == "Walk") & (F.col("id") > 0)).select("id")
    src = _land(dels, spark, "deletes", 3)
    tomb = scratch_path(spark, f"tombstones-{uuid.uuid4().hex[:8]}")

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{tomb}/batch_id={batch_id}")

    J.run_available_now(J.file_source(spark, src, dels.schema), f"del-{uuid.uuid4().hex[:8]}", sink)
    gone = spark.read.parquet(tomb).select(F.col("id").alias("activity_id"))
    return spark.read.parquet(table).join(gone, "activity_id", "left_anti").select("segment_id")


@register("t8_zone_request_stream", sql=with_ctes(SEGS, SCORED, body="""
SELECT segment_id, zone FROM (
  SELECT segment_id, activity_id,
         CASE WHEN p <= 0.2 THEN 'very_low' WHEN p <= 0.4 THEN 'low' WHEN p <= 0.6 THEN 'medium'
              WHEN p <= 0.8 THEN 'high' ELSE 'very_high' END AS zone
  FROM (SELECT segment_id, activity_id, cume_dist() OVER (PARTITION BY grade_category ORDER BY efficiency_score) AS p
        FROM scored WHERE activity_id > 0 AND efficiency_score IS NOT NULL))
WHERE activity_id IN (SELECT DISTINCT event_id + 1 FROM events)"""))
def zone_request_stream(spark, sf_dir):
    """Requested activity ids arrive as a stream; each batch semi-joins the zone table (stream-static)."""
    from segspark.plans.q_zones import scored_segments
    from segspark.operators import zones as Z
    zone_table = scratch_path(spark, f"zones-{uuid.uuid4().hex[:8]}")
    Z.zone_among_grade(scored_segments(spark, sf_dir)).select(
        "segment_id", "activity_id", F.col("zone_among_grade_category").alias("zone")).write.parquet(zone_table)
    zones = spark.read.parquet(zone_table)
    req = standin.table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("activity_id"))
    src = _land(req, spark, "zone_requests", 3)
    stream = J.file_source(spark, src, req.schema).join(zones, "activity_id", "inner").select("segment_id", "zone")
    table = scratch_path(spark, f"zreq-{uuid.uuid4().hex[:8]}")

    def sink(batch, batch_id):  # a repeated request is answered again, once a batch
        batch.dropDuplicates(["segment_id"]).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    J.run_available_now(stream, f"zreq-{uuid.uuid4().hex[:8]}", sink)
    answers = spark.read.parquet(table)
    return answers.groupBy("segment_id").agg(F.max_by("zone", "batch_id").alias("zone"))


@register("t7_delete_all_tables", sql=with_ctes(SEGS, EDGES, ZONES_STORED, TRACKER, PROGRESS, """
gone AS (SELECT (o_orderkey + 1) AS id FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus <> 'F'),
gseg AS (SELECT segment_id FROM segs WHERE activity_id IN (SELECT id FROM gone))""", body="""
SELECT 'segments' AS table_name, segment_id AS key FROM segs WHERE segment_id NOT IN (SELECT segment_id FROM gseg)
UNION ALL SELECT 'segment_similarity', segment_id || '>' || similar_segment_id FROM edges
  WHERE segment_id NOT IN (SELECT segment_id FROM gseg) AND similar_segment_id NOT IN (SELECT segment_id FROM gseg)
UNION ALL SELECT 'segment_efficiency_zone', segment_id FROM zones_stored WHERE segment_id NOT IN (SELECT segment_id FROM gseg)
UNION ALL SELECT 'activity_status_tracker', CAST(activity_id AS VARCHAR) FROM tracker WHERE activity_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'weather_data_progress', activity_id || ':' || group_id FROM progress WHERE activity_id NOT IN (SELECT id FROM gone)"""))
def delete_all_tables(spark, sf_dir):
    """T7 + S14 + J5: deletion messages gather in one log; five tables are read through it, then written without the
    deleted rows, after which the log is spent."""
    a = standin.activities(spark, sf_dir)
    dels = a.where((F.col("sport_type") == "Walk") & (F.col("id") > 0)).select("id")
    src = _land(dels, spark, "deletes", 3)
    log = scratch_path(spark, f"deletions-{uuid.uuid4().hex[:8]}")
    J.run_available_now(J.file_source(spark, src, dels.schema), f"delall-{uuid.uuid4().hex[:8]}", J.upsert_sink(log))
    # read for itself, for both ends of the edges and for the zones: evaluated once
    segs = write_table(standin.segments(spark, sf_dir, False), "segments")
    left = S.cascade_delete(spark.read.parquet(log), segs, standin.similarity_edges(spark, sf_dir), standin.stored_zones(spark, sf_dir),
                            standin.status_tracker(spark, sf_dir), standin.weather_progress(spark, sf_dir), True)
    left = S.compact(left, scratch_path(spark, f"compacted-{uuid.uuid4().hex[:8]}"))
    key = {"segments": F.col("segment_id"), "segment_similarity": F.concat_ws(">", "segment_id", "similar_segment_id"),
           "segment_efficiency_zone": F.col("segment_id"), "activity_status_tracker": F.col("activity_id").cast("string"),
           "weather_data_progress": F.concat_ws(":", F.col("activity_id").cast("string"), "group_id")}
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table_name"), key[name].alias("key")) for name, df in left.items()])


@register("t9_fan_out", sql=with_ctes(SEGS, SCORED, body=f"""
SELECT 'terrain' AS consumer, segment_id, {ROAD_SQL} AS value FROM segs
UNION ALL SELECT 'weather', segment_id, CASE WHEN temperature < 12 THEN 'cold' ELSE 'mild' END FROM segs WHERE activity_id > 0
UNION ALL SELECT 'efficiency', segment_id, CASE WHEN efficiency_score IS NULL THEN 'none' ELSE 'scored' END FROM scored"""))
def fan_out(spark, sf_dir):
    """T9 + T1: one landed segment table feeds three consumers with checkpoints of their own; one of them runs first on a
    part of the table and goes on later."""
    segs = standin.segments(spark, sf_dir, True)
    bronze, tables = (scratch_path(spark, f"{n}-{uuid.uuid4().hex[:8]}") for n in ("bronze", "consumers"))
    consumers = {
        "terrain": lambda s: s.select("segment_id", X.road_group("road_type").alias("value")),
        "weather": lambda s: s.where("activity_id > 0").select("segment_id", F.when(F.col("temperature") < 12, "cold").otherwise("mild").alias("value")),
        "efficiency": lambda s: with_score(s).select("segment_id", F.when(F.col("efficiency_score").isNull(), "none").otherwise("scored").alias("value"))}
    half = F.pmod(F.xxhash64("segment_id"), F.lit(2))
    segs.where(half == 0).write.parquet(f"{bronze}/part-0")
    J.run_consumers(spark, f"{bronze}/*", segs.schema, consumers, tables, ["weather"])
    segs.where(half == 1).write.parquet(f"{bronze}/part-1")
    J.run_consumers(spark, f"{bronze}/*", segs.schema, consumers, tables)
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{tables}/{n}").select(F.lit(n).alias("consumer"), "segment_id", "value") for n in consumers])


@register("s10_keyed_sink", sql="SELECT CAST(user_id AS VARCHAR) AS key, event_id, true AS together FROM events")
def keyed_sink(spark, sf_dir):
    """Events as keyed messages through the staged sink, read back; every key's messages lie in one partition."""
    e = standin.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.to_json(F.struct("event_id", "event_type")).alias("value"))
    topic = scratch_path(spark, f"topic-{uuid.uuid4().hex[:8]}")
    J.run_available_now(J.file_source(spark, _land(e, spark, "messages", 3), e.schema), f"topic-{uuid.uuid4().hex[:8]}", K.topic_sink(topic))
    rows = K.read_topic(spark, topic)
    one = rows.groupBy("key").agg((F.count_distinct("partition") == 1).alias("together"))
    return rows.join(one, "key").select("key", F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"), "together")
