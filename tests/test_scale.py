"""Steps that must not shuffle, widen or repeat more than their input: small tables, plans and results."""

from __future__ import annotations

import re
import uuid

import pytest
from pyspark.sql import functions as F

from segspark.session import scratch_path
from segspark.sources import standin


@pytest.fixture(scope="module")
def tables(spark):
    """Orders of one to five lines of three customers, as the driver's tables have them."""
    path = scratch_path(spark, f"test-tables-{uuid.uuid4().hex[:8]}")
    orders = [(k, k % 3, "FOP"[k % 3], 1000.0 + k, "2000-01-02 03:04:05", "1-URGENT") for k in range(1, 13)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, "
                          "o_orderpriority string").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).write.parquet(f"{path}/orders.parquet")
    lines = [(k, (k * 5 + n) % 4 + 1, n % 3, n, 5.0 + n + k, 1000.0 * n + 37 * k, 0.01 * ((n + k) % 10), 0.01 * (n % 8), "N", "O", "2000-03-04 00:00:00")
             for k in range(1, 13) for n in range(1, k % 5 + 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string").withColumn(
        "l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(p, f"Brand#{p}{p}", 3 * p) for p in range(1, 5)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{path}/part.parquet")
    return path


@pytest.fixture()
def no_broadcast(spark):
    """Plans as of large tables: joins shuffle, and the first plan is the last."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def _plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def _exchanges(df, capsys) -> int:
    return len(re.findall(r"Exchange hashpartitioning", _plan(df, capsys)))


def test_edges_are_built_without_a_shuffle_of_edges(spark, tables, no_broadcast, capsys):
    """Lines and orders are shuffled once; every other segment of the order is listed, nearest first."""
    edges = standin.similarity_edges(spark, tables, with_user=True)
    assert _exchanges(edges, capsys) == 2
    segs = standin.segments(spark, tables, False).collect()
    want = set()
    for a in segs:
        others = sorted((abs(a.seg_no - b.seg_no), b.seg_no, b.segment_id, abs(a.segment_length - b.segment_length))
                        for b in segs if b.activity_id == a.activity_id and b.segment_id != a.segment_id)
        want |= {(a.segment_id, i, d, rank, a.user_id) for rank, (_, _, i, d) in enumerate(others, 1)}
    assert {(r.segment_id, r.similar_segment_id, r.similarity_score, r["rank"], r.user_id) for r in edges.collect()} == want


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_bucket_table_keeps_rows_in_place(spark, monkeypatch, most):
    """rows written where they lie; kept rows leave out the replaced keys of their own bucket, broadcast or not."""
    from segspark.operators import buckets as B
    monkeypatch.setattr(B, "BROADCAST_KEYS", most)
    path = scratch_path(spark, f"test-in-place-{uuid.uuid4().hex[:6]}")
    rows = spark.createDataFrame([(k % 7 or None, k) for k in range(70)], "k long, v long").repartition(3)
    B.create(rows, path, "k", 4, gather=False)
    keys = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    assert B.replace(spark.createDataFrame([(1, 100), (None, 101)], "k long, v long"), path, "k", keys, gather=False)
    want = sorted([(k % 7, k) for k in range(70) if k % 7 > 2] + [(1, 100), (0, 101)])
    assert sorted((r.k or 0, r.v) for r in B.read(spark, path).collect()) == want


def test_features_shuffle_rows_by_group_once(spark, no_broadcast, capsys):
    """neither the statistics nor the join back shuffle anything again; -0.0 is 0.0, null groups have no row."""
    from segspark.operators import similarity as SIM
    rows = [(f"s{i}", i % 2, g, float(i), "a" if i % 3 else None) for i, g in enumerate([0.0, -0.0, 2.5, 0.0, None, -0.0, 2.5, 0.0])]
    s = spark.createDataFrame(rows, "segment_id string, user_id long, grade_category double, x double, c string")
    f = SIM.standardized_features(s, ["x"], ["c"])
    assert "ENSURE_REQUIREMENTS" not in _plan(f, capsys)
    got = {r.segment_id: (r.group_size, round(r.z[0], 6), r.cats[0]) for r in f.collect()}
    assert set(got) == {f"s{i}" for i in range(8) if i != 4}
    assert got["s0"][0] == 1 and got["s7"][0] == 4 and got["s2"][1:] == (-1.0, "a") and got["s6"][1:] == (1.0, "a")
    f.unpersist()


def test_zone_queries_evaluate_scores_once(spark, tables, capsys):
    """The lines are read once for the scores, and once more only for the edges."""
    from segspark.plans import registry
    found = registry.queries()
    assert "lineitem.parquet" not in _plan(found["j15_segment_view"](spark, tables), capsys)
    assert _plan(found["a10_missing_zone_ratio"](spark, tables), capsys).count("lineitem.parquet") == 1


def test_deletion_evaluates_segments_once(spark, tables, monkeypatch):
    """the five tables are read through one written segment table."""
    from segspark.operators import status as S
    from segspark.plans import registry
    seen, run = [], S.cascade_delete
    monkeypatch.setattr(S, "cascade_delete", lambda log, segs, *rest: seen.append(segs.inputFiles()) or run(log, segs, *rest))
    registry.queries()["t7_delete_all_tables"](spark, tables)
    assert all("/tables/segments-" in f for f in seen[0]) and seen[0]


def test_consumers_take_all_files_of_a_landing(spark):
    """F8: the number of files of a landed table does not become a number of micro-batches."""
    from segspark.streaming import jobs as J
    bronze, out = (scratch_path(spark, f"test-{n}-{uuid.uuid4().hex[:6]}") for n in ("bronze", "consumed"))
    rows = spark.range(30)
    rows.repartition(5).write.parquet(f"{bronze}/part-0")
    J.run_consumers(spark, f"{bronze}/*", rows.schema, {"one": lambda s: s}, out)
    got = spark.read.parquet(f"{out}/one")
    assert got.count() == 30 and got.select("batch_id").distinct().count() == 1


def test_top_k_of_features_shuffles_rows_once(spark, no_broadcast, capsys):
    """features, one-hot places and neighbours come from one exchange of the rows; nothing is cached or merged again."""
    from segspark.operators import pca as PCA
    from segspark.operators import similarity as SIM
    rows = [(f"s{i}", i % 3, 2.5 * (i % 2), float(i * i % 17), "ab"[i % 2], -1.0 * i) for i in range(60)]
    s = spark.createDataFrame(rows, "segment_id string, user_id long, grade_category double, x double, c string, speed double")
    f = SIM.standardized_features(s, ["x"], ["c"], buckets=4)
    t = SIM.top_k_neighbours(f, SIM.GROUP, "segment_id", 3, carry=["speed"])
    for df in (t, PCA.one_hot(f, SIM.GROUP, 1)):
        plan = _plan(df, capsys)
        assert plan.count("Exchange") == 1 and "InMemory" not in plan
    merged = {(r.segment_id, r["rank"]): r for r in SIM.top_k_neighbours(f, SIM.GROUP, "segment_id", 3, block_size=2, carry=["speed"]).collect()}
    got = t.collect()
    assert len(got) == 180 and all(r.speed == -float(r.similar_segment_id[1:]) for r in got)
    assert all(merged[r.segment_id, r["rank"]] == r for r in got)


def test_ids_that_repeat_share_one_ranking(spark):
    """two rows of one id rank their neighbours together, as the merge of blocks does; groups of null keys have none."""
    from segspark.operators import similarity as SIM
    rows = [(1, i, [v]) for i, v in (("a", 0.0), ("a", 10.0), ("b", 1.0), ("c", 9.5), ("d", 30.0))] + [(None, "x", [0.0]), (None, "y", [1.0])]
    df = spark.createDataFrame(rows, "g long, segment_id string, z array<double>")
    got = [sorted((r.segment_id, r["rank"], r.similar_segment_id, r.similarity_score) for r in SIM.top_k_neighbours(
        df, ["g"], "segment_id", 2, block_size=n, with_cats=False).collect()) for n in (100, 2)]
    assert got[0] == got[1]
    assert [x for x in got[0] if x[0] == "a"] == [("a", 1, "c", 0.5), ("a", 2, "b", 1.0)]


def test_written_tables_leave_no_shuffle_behind(spark):
    """The shuffles that led to a written table are removed with it, and dropped tables are gone."""
    from segspark.session import SHUFFLE_CLEANUP, drop_table, write_table
    held = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    kept = spark.range(1000).repartition(3, "id")
    before = held.size()
    t = write_table(kept.groupBy((kept.id % 7).alias("k")).count(), "counts")
    assert held.size() <= before and spark.conf.get(SHUFFLE_CLEANUP, None) is None
    assert t.count() == 7
    files = [f.removeprefix("file://") for f in t.inputFiles()]
    drop_table(t)
    import os
    assert files and not any(os.path.exists(f) for f in files)


def test_segments_meet_their_parts_in_place(spark, tables, no_broadcast, capsys):
    """Only keys go to the parts; lines without a part stay, a part that comes twice doubles its lines."""
    path = scratch_path(spark, f"test-parts-{uuid.uuid4().hex[:8]}")
    for t in ("orders", "lineitem"):
        spark.read.parquet(f"{tables}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    spark.createDataFrame([(1, "Brand#13", 14), (2, "Brand#-1", -3), (2, "Brand#22", None), (None, "Brand#1", 1)],
                          "p_partkey long, p_brand string, p_size int").write.parquet(f"{path}/part.parquet")
    segs = standin.segments(spark, path, True)
    wide = [e for e in _plan(segs, capsys).split("\n") if "Exchange hashpartitioning(l_partkey" in e]
    plain = standin.segments(spark, path, False).count()
    key = spark.read.parquet(f"{path}/lineitem.parquet").groupBy("l_partkey").count().collect()
    parts = {r.l_partkey: r["count"] for r in key}
    got = {(r.road_type, r.surface_type): r["count"] for r in segs.groupBy("road_type", "surface_type").count().collect()}
    want = {("footway", standin.SURFACE_VOCAB[2]): parts[1], ("motorway", None): parts[2], (None, None): parts[2] + parts[3] + parts[4]}
    assert got == want and sum(got.values()) == plain + parts[2]
    assert len(wide) <= 1


def test_deletion_holds_one_join_of_edges_at_a_time(spark, monkeypatch):
    """F8: edges are written between their two joins, and compacted tables leave no shuffle behind."""
    from segspark.operators import status as S
    seg = spark.createDataFrame([(f"s{i}", i % 4) for i in range(12)], "segment_id string, activity_id long")
    edges = spark.createDataFrame([(f"s{i}", f"s{(i + d) % 12}") for i in range(12) for d in (1, 2)], "segment_id string, similar_segment_id string")
    log, zones, tracker = spark.createDataFrame([(1,), (None,)], "id long"), seg.select("segment_id"), seg.select("activity_id")
    left = S.cascade_delete(log, seg, edges, zones, tracker, None, True)
    assert any("/tables/edges-" in f for f in left["segment_similarity"].inputFiles())
    held = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    before = held.size()
    out = S.compact(left, scratch_path(spark, f"test-compact-{uuid.uuid4().hex[:6]}"))
    assert held.size() <= before  # those of earlier tests may go meanwhile
    want = {(a, b) for a, b in edges.collect() if int(a[1:]) % 4 != 1 and int(b[1:]) % 4 != 1}
    assert {(r.segment_id, r.similar_segment_id) for r in out["segment_similarity"].collect()} == want and out["segments"].count() == 9
