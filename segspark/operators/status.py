"""Status, completeness and upsert semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.functions import expr as X
from segspark.session import shuffles_dropped, write_table


def _b(c):
    """NULL-safe boolean flag (NULL counts as false)."""
    return F.coalesce(F.col(c), F.lit(False))


def activity_status(activities: DataFrame, tracker: DataFrame) -> DataFrame:
    """P18 + P19 + J3: status of every activity from its (optional) tracker row.

    Historical: NOT_PROCESSABLE > SIMILARITY_READY > DATA_READY > CREATED;
    planned: NOT_PROCESSABLE > PREDICTION_READY > DATA_READY > CREATED.
    """
    t = tracker.withColumn("_has", F.lit(True))
    a = activities.join(t, activities.id == t.activity_id, "left")
    data_ready = _b("segment_status") & _b("terrain_status") & _b("weather_status")
    done_col = F.when(F.col("is_planned"), F.col("prediction_executed_at")).otherwise(F.col("similarity_processed_at"))
    done_name = F.when(F.col("is_planned"), F.lit("PREDICTION_READY")).otherwise(F.lit("SIMILARITY_READY"))
    status = (F.when(F.col("_has").isNull(), "CREATED")
              .when(_b("not_processable"), "NOT_PROCESSABLE")
              .when(done_col.isNotNull(), done_name)
              .when(data_ready, "DATA_READY")
              .otherwise("CREATED"))
    return a.select(F.col("id"), F.col("athlete_id"), F.col("is_planned"), status.alias("status"))


def ready_for_prediction(activities: DataFrame, tracker: DataFrame) -> DataFrame:
    """P20: planned (id < 0), all three flags true, not predicted yet, not_processable false or NULL."""
    t = tracker.where(F.col("activity_id") < 0)
    ok = (_b("segment_status") & _b("terrain_status") & _b("weather_status")
          & ~_b("not_processable") & F.col("prediction_executed_at").isNull())
    a = activities.select(F.col("id").alias("activity_id"), "athlete_id")
    return t.where(ok).join(a, "activity_id").select("activity_id", "athlete_id")


def completion_fingerprint(activities: DataFrame, tracker: DataFrame) -> DataFrame:
    """A2 + A3 + M15: per user, historical activities, completed ones, and md5 of the ids in order.

    Completed = all three flags, or not processable. The fingerprint is
    ``md5`` of the ids joined with ',' in numeric order, as the reference
    stores it; it is only used to detect a changed activity set.
    """
    a = activities.where(F.col("id") > 0).select(F.col("id").alias("activity_id"), "athlete_id").distinct()
    j = a.join(tracker, "activity_id", "left")
    completed = (_b("segment_status") & _b("terrain_status") & _b("weather_status")) | _b("not_processable")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("activity_id")), lambda x: x.cast("string")), ",")
    return j.groupBy(F.col("athlete_id").alias("user_id")).agg(
        F.count(F.lit(1)).alias("total_activities"),
        F.count_if(completed).alias("completed_activities"),
        F.md5(ids).alias("fingerprint"))


def similarity_trigger(status: DataFrame, stored: DataFrame) -> DataFrame:
    """Users whose activities are all complete, whose fingerprint changed and who are not running."""
    st = stored.select("user_id", "activity_fingerprint", "in_progress", F.lit(True).alias("_stored"))
    s = status.join(st, "user_id", "left")
    changed = F.coalesce(F.col("activity_fingerprint") != F.col("fingerprint"), F.lit(True))
    go = ((F.col("total_activities") > 0) & (F.col("total_activities") == F.col("completed_activities"))
          & (F.col("_stored").isNull() | (changed & ~_b("in_progress"))))
    return s.where(go).select("user_id", "fingerprint")


def fan_in_complete(progress: DataFrame) -> DataFrame:
    """A6 + M13: weather done for an activity when saved groups = declared total (k_n)."""
    return (progress.groupBy("activity_id")
            .agg(F.count_distinct("group_id").alias("saved_groups"), F.max(X.group_total("group_id")).alias("total_groups"),
                 F.max(X.group_index("group_id") > X.group_total("group_id")).alias("bad_group"))
            .withColumn("weather_done", F.col("saved_groups") == F.col("total_groups")))


def latest_wins(log: DataFrame, key, order_cols) -> DataFrame:
    """The last version of each key (``max_by`` over the ordering struct).

    An aggregate, not a window: partial aggregation keeps one row per key per
    map task, so a key repeated a billion times costs one row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    payload = [c for c in log.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in order_cols])
    agg = log.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in payload]), order).alias("_v"))
    return agg.select(*keys, *[F.col("_v")[c].alias(c) for c in payload])


def reconcile_log(messages: DataFrame) -> DataFrame:
    """J6 + S12 over one log: the messages of a segment_id meet in one row whatever arrived first.

    A message carries one of the structs ``segment``, ``terrain``, ``weather``, the others being null; each side is
    latest-wins already. One partially aggregated shuffle on segment_id; a side contributes only its own columns.
    """
    sides = ["segment", "terrain", "weather"]
    one = messages.groupBy("segment_id").agg(*[F.first(s, ignorenulls=True).alias(s) for s in sides])
    return one.select("segment_id", *[F.col(f"{s}.{f}") for s in sides for f in messages.schema[s].dataType.names],
                      *[F.col(s).isNotNull().alias(f"{s}_status") for s in sides])


def reconcile(segments: DataFrame, terrain: DataFrame, weather: DataFrame) -> DataFrame:
    """J6 + S12: segment, terrain and weather rows, a table each, meet on segment_id (``reconcile_log`` of their union)."""
    log = None
    for name, side in (("segment", segments), ("terrain", terrain), ("weather", weather)):
        rows = side.select("segment_id", F.struct(*[c for c in side.columns if c != "segment_id"]).alias(name))
        log = rows if log is None else log.unionByName(rows, allowMissingColumns=True)
    return reconcile_log(log)


def cascade_delete(deleted_ids: DataFrame, segments: DataFrame, edges: DataFrame, zones: DataFrame,
                   tracker: DataFrame, progress: DataFrame | None = None, stepwise: bool = False) -> dict[str, DataFrame]:
    """S14 + J5 + T7: remove everything derived from the deleted activities.

    Segments, tracker rows and weather progress by activity id (anti join); edges where either end is a removed
    segment; zones of removed segments. The tables are joined as they are read, so a log of deleted ids takes effect
    without rewriting them; writing the results back (``compact``) lets the log go. ``stepwise`` writes the edges
    between their two joins, so that the shuffles of only one lie on disk.
    """
    d = deleted_ids.select(F.col("id").alias("activity_id")).where("activity_id IS NOT NULL").distinct()
    gone = segments.join(d, "activity_id", "left_semi").select("segment_id")
    seg_left = segments.join(d, "activity_id", "left_anti")
    e = edges.join(gone, "segment_id", "left_anti")
    e = ((write_table(e, "edges") if stepwise else e)
         .join(gone.withColumnRenamed("segment_id", "similar_segment_id"), "similar_segment_id", "left_anti"))
    out = {"segments": seg_left, "segment_similarity": e,
           "segment_efficiency_zone": zones.join(gone, "segment_id", "left_anti"),
           "activity_status_tracker": tracker.join(d, "activity_id", "left_anti")}
    if progress is not None:
        out["weather_data_progress"] = progress.join(d, "activity_id", "left_anti")
    return out


def compact(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Write the tables that are left below a new ``path`` and return them read back; the log of deletions is then spent."""
    out = {}
    for name, df in tables.items():
        with shuffles_dropped(df.sparkSession):
            df.write.option("compression", "zstd").parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
    return out
