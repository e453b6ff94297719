"""Streaming sinks: replaying a micro-batch must not change the table (T3), state fires once (T4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from segspark.session import scratch_path
from segspark.streaming import jobs as J


def test_upsert_replay_is_idempotent(spark):
    table = scratch_path(spark, f"test-upsert-{uuid.uuid4().hex[:6]}")
    sink = J.upsert_sink(table)
    b0 = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, ts long")
    b1 = spark.createDataFrame([(1, "c", 2)], "k long, v string, ts long")
    sink(b0, 0)
    sink(b1, 1)
    first = sorted(tuple(r) for r in J.read_upserted(spark, table, "k", ["ts"]).collect())
    sink(b1, 1)  # replay after a failure
    sink(b0, 0)
    again = sorted(tuple(r) for r in J.read_upserted(spark, table, "k", ["ts"]).collect())
    assert first == again == [(1, "c", 2), (2, "b", 1)]


def test_readiness_fires_once_when_all_arrived(spark):
    src = scratch_path(spark, f"test-arrivals-{uuid.uuid4().hex[:6]}")
    rows = [[(7, "weather", "1_2", 2)], [(7, "segment", None, None), (8, "segment", None, None)],
            [(7, "terrain", None, None)], [(7, "weather", "2_2", 2), (7, "weather", "2_2", 2)]]
    schema = "activity_id long, kind string, group_id string, total_groups int"
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    stream = J.file_source(spark, src, spark.createDataFrame([], schema).schema)
    out = J.run_available_now(J.readiness(stream), f"ready-test-{uuid.uuid4().hex[:6]}")
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert got == [(7, True, True, 2, 2)]


def test_fan_in_counts_each_group_once(spark):
    src = scratch_path(spark, f"test-fanin-{uuid.uuid4().hex[:6]}")
    df = spark.createDataFrame([(1, "1_3"), (1, "1_3"), (1, "2_3"), (2, "1_1")], "activity_id long, group_id string")
    df.repartition(2).write.parquet(src)
    name = f"fanin_test_{uuid.uuid4().hex[:6]}"
    J.run_available_now(J.fan_in_progress(J.file_source(spark, src, df.schema)), name, output_mode="complete",
                        fmt="memory")
    got = sorted(tuple(r) for r in spark.table(name).collect())
    assert got == [(1, 2, 3), (2, 1, 1)]


def test_ttl_sink_collects_no_key(spark, monkeypatch):
    """Batches of one hot key, with ties and null keys: the same rows as one fold over all, without the fold."""
    import random

    from segspark.operators import cuts
    r = random.Random(4)
    rows = [(k, "a" if j % 3 else None, 1_600_000_000 + r.randrange(0, 20_000), 1000 * (k or 9) + j) for k in (1, 2, None) for j in range(150)]
    rows += [(1, "a", 1_600_000_100, n) for n in range(5)]
    df = spark.createDataFrame(rows, "user_id long, activity string, s long, event_id long").select(
        "user_id", "activity", F.timestamp_seconds("s").alias("ts"), "event_id")
    want = sorted(map(str, cuts.ttl_dedup(df, ["user_id", "activity"], "ts", 300).collect()))
    monkeypatch.setattr(cuts, "ttl_dedup", None)
    table = scratch_path(spark, f"test-ttl-{uuid.uuid4().hex[:6]}")
    sink = J.ttl_dedup_sink(table, ["user_id", "activity"], "ts", 300)
    ts = F.unix_micros("ts") / 1_000_000 - 1_600_000_000
    for k, part in enumerate([df.where(ts < 9000), df.where(ts >= 9000), df.where(ts >= 9000)]):
        sink(part, min(k, 1))  # the second is replayed
    got = spark.read.parquet(f"{table}/kept").select(*df.columns).collect()
    assert sorted(map(str, got)) == want


def _state_rows(spark, name):
    return spark.read.format("statestore").load(scratch_path(spark, f"stream_ckpt/{name}")).count()


def test_state_goes(spark):
    """Once the messages' times have moved on, the state of earlier activities is gone, done or not."""
    ready = "activity_id long, kind string, group_id string, total_groups int, ts timestamp"
    group = "activity_id long, group_id string, ts timestamp"

    def at(day, rows, schema):
        return spark.createDataFrame(rows, schema.replace(", ts timestamp", "")).withColumn("ts", F.timestamp_seconds(F.lit(1_000_000_000 + day * 86_400)))

    for schema, job, first, mode in (
            (ready, lambda s: J.readiness(s, 1000, 2000, "1 hour"),
             [(1, "segment", None, None), (1, "terrain", None, None), (1, "weather", "1_1", 1), (2, "segment", None, None)], "append"),
            (group, lambda s: J.fan_in_expiring(s, 1000, 2000, "1 hour"), [(1, "1_1"), (2, "1_2")], "update")):
        src, name = scratch_path(spark, f"test-expiry-{uuid.uuid4().hex[:6]}"), f"expiry-{uuid.uuid4().hex[:6]}"
        table = scratch_path(spark, f"test-expired-{uuid.uuid4().hex[:6]}")
        left = []
        for day, rows in ((0, first), (3, [(3, *first[-1][1:])]), (6, [(4, *first[-1][1:])])):
            at(day, rows, schema).coalesce(1).write.mode("append").parquet(src)
            J.run_available_now(job(J.file_source(spark, src, spark.createDataFrame([], schema).schema)), name, J.upsert_sink(table), mode)
            left.append(_state_rows(spark, name))
        assert left[-1] <= 2 and left[0] + left[1] + left[2] < 2 + 3 + 4  # without expiry 2, 3 and 4


def test_topic_epochs(spark):
    """A replayed epoch and one that failed before it was published leave the topic as one write of each."""
    from segspark.streaming import sink as K
    path = scratch_path(spark, f"test-topic-{uuid.uuid4().hex[:6]}")
    one, two = (spark.createDataFrame([(f"k{i % 3}", f"v{n}{i}") for i in range(20)] + [(None, f"n{n}")], "key string, value string") for n in (1, 2))
    assert K.read_topic(spark, path).count() == 0
    sink = K.topic_sink(path, 4)
    sink(one, 0)
    sink(one, 0)
    two.limit(5).withColumn("partition", F.lit(0)).write.partitionBy("partition").json(f"{path}/rows/epoch=1")  # staged, never published
    assert K.read_topic(spark, path).count() == 21
    sink(two, 1)
    got = K.read_topic(spark, path)
    assert sorted(str((r.key, r.value)) for r in got.collect()) == sorted(str(tuple(r)) for r in one.unionByName(two).collect())
    assert got.groupBy("key").agg(F.count_distinct("partition").alias("n")).where("n > 1").count() == 0


def test_bucket_table(spark):
    """Keys are replaced whole, removed keys go, a repeated version changes nothing, null keys and empty tables work."""
    from segspark.operators import buckets as B
    path = scratch_path(spark, f"test-buckets-{uuid.uuid4().hex[:6]}")
    rows = spark.createDataFrame([(k % 7 if k % 7 else None, k) for k in range(70)], "k long, v long")
    B.create(rows, path, "k", 4)
    rest = sorted((r.k or 0, r.v) for r in rows.collect())
    assert sorted((r.k or 0, r.v) for r in B.read(spark, path).collect()) == rest
    new = spark.createDataFrame([(1, 100), (1, 101), (9, 102)], "k long, v long")
    assert B.replace(new, path, "k", version=1) and not B.replace(new.limit(0), path, "k", new, version=1)
    assert B.replace(rows.limit(0), path, "k", spark.createDataFrame([(2,), (None,)], "k long"))
    want = sorted([(k, v) for k, v in rest if k not in (0, 1, 2)] + [(1, 100), (1, 101), (9, 102)])
    assert sorted((r.k or 0, r.v) for r in B.read(spark, path).collect()) == want
    import pytest
    with pytest.raises(ValueError):
        B.replace(new, path, "k", spark.createDataFrame([(1,)], "k long"))
    B.create(rows.limit(0), f"{path}-empty", "k", 4)
    assert B.read(spark, f"{path}-empty").count() == 0 and B.replace(new, f"{path}-empty", "k") and B.read(spark, f"{path}-empty").count() == 3


def test_readiness_holds_a_bucket_of_activities_in_one_state(spark, monkeypatch):
    """T4: activities of one bucket share a state and fire each for itself; a null id is one of its own."""
    monkeypatch.setattr(J, "STATE_BUCKETS", 1)
    schema = "activity_id long, kind string, group_id string, total_groups int"
    big = 2 ** 60 + 1
    parts = [[(i, "segment", None, None) for i in (big, -2, 3, None)] + [(i, "weather", "1_2", 2) for i in (big, -2, None)],
             [(i, "terrain", None, None) for i in (big, -2, 3, None)] + [(big, "weather", "1_2", 2)],
             [(big, "weather", "2_2", 2), (None, "weather", "2_2", 2)], [(big, "weather", "2_2", 2)]]
    src, name = scratch_path(spark, f"test-bucket-{uuid.uuid4().hex[:6]}"), f"bucket-{uuid.uuid4().hex[:6]}"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    out = J.run_available_now(J.readiness(J.file_source(spark, src, spark.createDataFrame([], schema).schema)), name)
    assert sorted(map(str, (tuple(r) for r in spark.read.parquet(out).collect()))) == sorted(
        map(str, [(big, True, True, 2, 2), (None, True, True, 2, 2)]))
    assert _state_rows(spark, name) == 1


def test_fan_in_state_on_disk(spark, tmp_path, monkeypatch):
    """the landed table keeps its files, the state is on disk for this query alone, repeats count once."""
    from segspark.plans import q_stream as Q
    spark.createDataFrame([(k, "F" if k % 2 else "O") for k in range(40)], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, n) for k in range(40) for n in range(1, 2 + k % 4)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    taken, source, start = [], J.file_source, J.run_available_now
    monkeypatch.setattr(J, "file_source", lambda s, path, schema, most=1: (taken.append((len(s.read.parquet(path).inputFiles()), most)), source(s, path, schema, most))[1])
    names = []
    monkeypatch.setattr(J, "run_available_now", lambda stream, name, *a, **k: (names.append(name), start(stream, name, *a, **k))[1])
    was = {k: spark.conf.get(k, None) for k in J.DISK_STATE}
    got = sorted(tuple(r) for r in Q.fan_in_stream(spark, str(tmp_path)).collect())
    assert got == sorted(((k + 1) * (-1 if k % 2 else 1), 1 + k % 4, 1 + k % 4 + k % 2) for k in range(40))
    assert {k: spark.conf.get(k, None) for k in J.DISK_STATE} == was
    files, most = taken[0]
    assert files >= 2 and most == -(-files // 5)
    import pathlib
    state = pathlib.Path(scratch_path(spark, f"stream_ckpt/{names[0]}")) / "state"
    assert any(p.suffix in (".changelog", ".zip") for p in state.rglob("*"))
