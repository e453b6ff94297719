"""Structured Streaming jobs.

The reference consumes one message at a time from ten topics. Here each topic
is a streaming DataFrame (Kafka on a cluster, the file source in tests), every
job runs with a checkpoint in the cluster's checkpoint folder, and sinks are
idempotent so a replayed micro-batch after an executor or driver loss writes
the same rows again:

* upserts land as one folder per micro-batch id, overwritten on replay, and the
  table is read through a latest-wins merge (T1, T3);
* segment batches replace their activities in a bucketed table (T2);
* readiness (T4) keeps per-activity flags in Spark state, by hash bucket, and they expire;
* one landed table feeds several consumers, each with its own checkpoint (T9);
* request de-duplication (T5) continues after the last kept request of its keys, by joins;
* progress counts (T10) are a stateful aggregation in update mode;
* ``Trigger.AvailableNow`` runs any of them as a periodic batch (T11).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from segspark.operators.status import latest_wins
from segspark.session import ensure_checkpoint_dir, scratch_path, write_table


def kafka_source(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A topic from the earliest offset; value parsed downstream with ``from_json``.

    Needs the spark-sql-kafka package on the cluster; offsets are committed by
    the query checkpoint after the batch is processed (at least once).
    """
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", "earliest").load()
            .select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                    "topic", "partition", "offset", "timestamp"))


def file_source(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    """T1 in tests: parquet files arriving in a folder play the topic."""
    return (spark.readStream.format("parquet").schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path))


# state on the executors' disks with bounded memory, for keys that grow with the input; a batch saves its changes only
DISK_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
              "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
              "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def run_available_now(stream: DataFrame, name: str, sink=None, output_mode: str = "append",
                      fmt: str = "parquet", path: str | None = None, settings: dict | None = None) -> str:
    """Process everything available, then stop. Returns the sink folder (or query name for memory).

    ``settings`` hold for this query alone: a stream keeps those it was started with.
    """
    spark = stream.sparkSession
    if settings:
        was = {k: spark.conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            return run_available_now(stream, name, sink, output_mode, fmt, path)
        finally:
            for k, v in was.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    ckpt = scratch_path(spark, f"stream_ckpt/{name}")
    w = stream.writeStream.option("checkpointLocation", ckpt).outputMode(output_mode).trigger(availableNow=True)
    if sink is not None:
        q = w.foreachBatch(sink).start()
    elif fmt == "memory":
        q = w.format("memory").queryName(name).start()
    else:
        path = path or scratch_path(spark, f"stream_out/{name}")
        q = w.format(fmt).option("path", path).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return path or name


# --- T1 + T3: idempotent upsert ---------------------------------------------------------

def upsert_sink(table_path: str):
    """foreachBatch sink: each micro-batch overwrites its own folder, so a replay is harmless."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")
    return sink


def read_upserted(spark: SparkSession, table_path: str, key, order_cols) -> DataFrame:
    """The upserted table: latest version of every key over all batches."""
    return latest_wins(spark.read.parquet(table_path).drop("batch_id"), key, order_cols)


# --- T2: segments of each arriving activity ---------------------------------------------

def replace_sink(table_path: str, transform, key: str = "activity_id", buckets: int = 64):
    """foreachBatch sink: the transformed rows replace everything the table has of the batch's keys.

    A message holds a whole recording (as the topic's do): all its rows come in one batch, and a recording that comes
    again replaces the earlier one. The table is kept in ``buckets`` hash buckets (``operators.buckets``), whatever the
    number of keys; a replayed batch is a version the table already has.
    """
    from segspark.operators import buckets as B

    def sink(batch: DataFrame, batch_id: int) -> None:
        out = write_table(transform(batch), "batch")
        if batch_id == 0:
            B.create(out.limit(0), table_path, key, buckets)
        B.replace(out, table_path, key, batch.select(key), version=batch_id + 1)
    return sink


# --- T4: three-way readiness with Spark state ---------------------------------------------

READY_SCHEMA = "activity_id long, segment_seen boolean, terrain_seen boolean, weather_groups int, total_groups int"
STATE_SCHEMA = "activities string"
STATE_BUCKETS = 2048  # states are kept by hash of the activity: a call for each activity would cost more than its messages
DONE_MS, OPEN_MS = 24 * 3600 * 1000, 30 * 24 * 3600 * 1000
LATE = "1 day"


def _goes_at(state, pdfs, ms: int) -> int:
    """When a state goes: ``ms`` after the newest of its messages in this batch, but not before the watermark."""
    newest = max(int(pdf["ts"].max().value // 1_000_000) for pdf in pdfs)
    return max(newest + ms, state.getCurrentWatermarkMs() + 1)


def _readiness(done_ms: int, open_ms: int):
    """The states of a bucket's activities, as [segment, terrain, total, done, goes at, groups] by activity."""
    def run(key, pdfs, state):
        known = {} if not state.exists else {a[0]: a[1:] for a in json.loads(state.get[0])}
        timed, came, fired = True, {}, []
        for pdf in () if state.hasTimedOut else pdfs:
            timed = "ts" in pdf.columns
            times = pdf["ts"].to_numpy().astype("datetime64[ms]").astype("int64").tolist() if timed else [0] * len(pdf)
            for one, kind, group, total, ts in zip(pdf["_activity"].tolist(), pdf["kind"].tolist(), pdf["group_id"].tolist(),
                                                   pdf["total_groups"].tolist(), times):
                m = came.get(one)
                if m is None:
                    m = came[one] = [False, False, None, ts, set()]
                m[3] = max(m[3], ts)
                if kind == "segment":
                    m[0] = True
                elif kind == "terrain":
                    m[1] = True
                elif kind == "weather":
                    if isinstance(group, str):
                        m[4].add(group)
                    if total is not None and total == total:
                        m[2] = int(total) if m[2] is None else max(m[2], int(total))
        now = state.getCurrentWatermarkMs() if timed else 0
        for one, (seg, ter, total, newest, groups) in came.items():
            was = known.get(one) or [False, False, None, False, 0, []]
            seg, ter, total = was[0] or seg, was[1] or ter, was[2] if total is None else total
            groups.update(was[5])
            fire = (not was[3]) and seg and ter and total is not None and len(groups) >= total
            done = was[3] or fire
            # what has fired is a flag, kept while repeats of its messages may still come
            known[one] = [seg, ter, total, done, max(newest + (done_ms if done else open_ms), now + 1), [] if done else sorted(groups)]
            if fire:
                fired.append((one, seg, ter, len(groups), total))
        if timed:
            known = {one: a for one, a in known.items() if one in came or a[4] >= now}
        if known:
            state.update((json.dumps([[one, *a] for one, a in known.items()]),))
            if timed:
                state.setTimeoutTimestamp(max(min(a[4] for a in known.values()), now + 1))
        elif state.exists:
            state.remove()
        if fired:
            ids, seg, ter, groups, total = zip(*fired)
            yield pd.DataFrame({"activity_id": pd.array([None if i is None else int(i) for i in ids], "Int64"), "segment_seen": seg,
                                "terrain_seen": ter, "weather_groups": groups, "total_groups": total})
    return run


def readiness(arrivals: DataFrame, done_ms: int = DONE_MS, open_ms: int = OPEN_MS, late: str = LATE) -> DataFrame:
    """T4: emit an activity once its segments, terrain and every weather group have arrived.

    ``arrivals``: activity_id, kind ('segment' | 'terrain' | 'weather'),
    group_id (weather only, ``k_n``), total_groups and, for a state that goes, ``ts`` (time of the message). By these
    times an activity's state goes ``done_ms`` after its last message once it has fired, ``open_ms`` after it otherwise,
    so the state holds the activities of that time and no more; messages over ``late`` behind the newest are not taken.
    """
    timed = "ts" in arrivals.columns
    a = arrivals.withWatermark("ts", late) if timed else arrivals
    # as text: a null id is one of its own and no id loses digits
    a = a.withColumn("_activity", F.col("activity_id").cast("string"))
    a = a.withColumn("_bucket", F.pmod(F.xxhash64("_activity"), F.lit(STATE_BUCKETS)))
    return a.groupBy("_bucket").applyInPandasWithState(
        _readiness(done_ms, open_ms), READY_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)


# --- T5: time-to-live de-duplication -------------------------------------------------------

def ttl_dedup_sink(table_path: str, keys, ts_col: str = "ts", ttl_seconds: int = 300):
    """T5: foreachBatch sink keeping a request unless its key's last kept one is less than the TTL older.

    Requests of one key and time are one, the smallest by its columns. A batch
    without those too near the last kept request of their keys, which the batch
    before left in ``<table>/last``, is de-duplicated by joins and pointer doubling
    (``operators.chains``), so no key is ever collected; keys older than the TTL
    before the newest request are dropped from ``last``. A batch is written under
    its id and reads the state of the one before, so a replay gives the same rows.
    Requests are expected in time order across batches; one older than its key's
    last kept request counts as a repeat. Null keys are keys of their own, and
    requests without a time are all kept until their key has a kept one.
    """
    from segspark.operators.chains import ttl_dedup_chain
    keys, ttl_us = list(keys), ttl_seconds * 1_000_000
    if ttl_seconds <= 0:
        raise ValueError("ttl_seconds must be positive")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ensure_checkpoint_dir(spark)
        cols = batch.columns
        us = F.unix_micros(F.col(ts_col).cast("timestamp"))
        rows = batch.withColumn("_key", F.to_json(F.struct(*keys)))  # null keys join too
        last = None
        if batch_id > 0:
            last = spark.read.parquet(f"{table_path}/last/batch_id={batch_id - 1}")
            rows = rows.join(last, "_key", "left").where(F.col("_last").isNull() | (us - F.col("_last") >= ttl_us)).drop("_last")
        one = (rows.where(us.isNotNull()).groupBy("_key", us.alias("_us")).agg(F.min(F.struct(*cols)).alias("_r"))
               .select("_key", "_r.*").withColumn("_id", F.monotonically_increasing_id()))
        work = f"{table_path}/work/batch_id={batch_id}"
        one.write.mode("overwrite").parquet(work)  # ids stay as they are
        kept = ttl_dedup_chain(spark.read.parquet(work), ["_key"], ts_col, "_id", ttl_seconds).select("_key", *cols)
        kept_path = f"{table_path}/kept/batch_id={batch_id}"
        kept.unionByName(rows.where(us.isNull()).select("_key", *cols)).write.mode("overwrite").parquet(kept_path)
        now = spark.read.parquet(kept_path).groupBy("_key").agg(F.max(us).alias("_last"))
        if last is not None:
            now = now.unionByName(last).groupBy("_key").agg(F.max("_last").alias("_last"))
        newest = now.agg(F.max("_last").alias("_newest"))  # one row
        (now.join(F.broadcast(newest)).where(F.col("_newest") - F.col("_last") < ttl_us)
         .drop("_newest").write.mode("overwrite").parquet(f"{table_path}/last/batch_id={batch_id}"))
    return sink


# --- T10: fan-in progress ----------------------------------------------------------------

def fan_in_progress(stream: DataFrame) -> DataFrame:
    """Saved weather groups per activity as a running count (a repeated group counts once).

    The state holds an activity's group ids, of which there are ``total_groups``.
    """
    parts = F.split(F.col("group_id"), "_")
    return stream.groupBy("activity_id").agg(F.size(F.collect_set("group_id")).cast("bigint").alias("saved_groups"),
                                             F.max(parts.getItem(1).cast("int")).alias("total_groups"))


PROGRESS_SCHEMA = "activity_id long, saved_groups long, total_groups int"


def _fan_in(done_ms: int, open_ms: int):
    def run(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        groups, total = (set(json.loads(state.get[0])), state.get[1]) if state.exists else (set(), None)
        pdfs = list(pdfs)
        for pdf in pdfs:
            groups |= set(pdf["group_id"].dropna().tolist())
        ends = [int(g.split("_")[1]) for g in groups if g.count("_") and g.split("_")[1].isdigit()]
        total = max(ends, default=total)
        state.update((json.dumps(sorted(groups)), total))
        state.setTimeoutTimestamp(_goes_at(state, pdfs, done_ms if total is not None and len(groups) >= total else open_ms))
        yield pd.DataFrame({"activity_id": [key[0]], "saved_groups": [len(groups)], "total_groups": pd.array([total], "Int32")})
    return run


def fan_in_expiring(stream: DataFrame, done_ms: int = DONE_MS, open_ms: int = OPEN_MS, late: str = LATE) -> DataFrame:
    """T10 as ``fan_in_progress`` for messages with a time ``ts``, with a state that goes: ``done_ms`` after an activity's last
    group, ``open_ms`` after it if some are missing."""
    return stream.select("activity_id", "group_id", "ts").withWatermark("ts", late).groupBy("activity_id").applyInPandasWithState(
        _fan_in(done_ms, open_ms), PROGRESS_SCHEMA, "groups string, total int", "update", GroupStateTimeout.EventTimeTimeout)


# --- T9: fan-out -----------------------------------------------------------------------------

def run_consumers(spark: SparkSession, bronze: str, schema, consumers: dict, tables: str, names=None) -> None:
    """Every consumer of the bronze table reads all of it at its own pace, with its own checkpoint and result table.

    ``consumers``: name -> transformation of the stream. ``names`` runs only some of them now; each goes on later from
    where it stopped, whatever the others have done. A micro-batch takes all files that have come, so that their number
    can grow with the table.
    """
    for name in names or list(consumers):
        stream = consumers[name](file_source(spark, bronze, schema, 1 << 30))
        run_available_now(stream, f"{tables.rstrip('/').split('/')[-1]}-{name}", upsert_sink(f"{tables}/{name}"))
