"""The distributed operators against brute force on small random fixtures."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.functions import expr as X
from segspark.operators import similarity as SIM
from segspark.operators import terrain as TR
from segspark.operators import weather as WX


@pytest.mark.parametrize("block_size", [1, 3, 2048])
def test_block_topk_equals_bruteforce(spark, block_size):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(3):
        for i in range(7 + g * 5):
            z = rng.normal(size=4).round(3).tolist()
            cats = [str(rng.integers(0, 2)), "a"]
            rows.append((g, f"p{g}_{i:02d}", z, cats))
    df = spark.createDataFrame(rows, "g long, segment_id string, z array<double>, cats array<string>")
    got = {(r.segment_id, r.rank): (r.similar_segment_id, r.similarity_score)
           for r in SIM.top_k_neighbours(df, ["g"], "segment_id", 3, block_size=block_size).collect()}
    exp = {}
    for g in range(3):
        pts = [r for r in rows if r[0] == g]
        for _, a, za, ca in pts:
            cand = []
            for _, b, zb, cb in pts:
                if a == b:
                    continue
                d = math.sqrt(sum((x - y) ** 2 for x, y in zip(za, zb)) + 2 * sum(x != y for x, y in zip(ca, cb)))
                cand.append((d, b))
            for rank, (d, b) in enumerate(sorted(cand)[:3], start=1):
                exp[(a, rank)] = (b, d)
    assert got.keys() == exp.keys()
    for k, (b, d) in exp.items():
        assert got[k][0] == b and got[k][1] == pytest.approx(d)


def test_cosine_topk_queries_against_references(spark):
    rows = [(1, "q1", [1.0, 0.0], True, False), (1, "r1", [0.9, 0.1], False, True), (1, "r2", [0.0, 1.0], False, True),
            (1, "r3", [1.0, 0.05], False, True), (2, "q2", [0.0, 1.0], True, False)]
    df = spark.createDataFrame(rows, "g long, segment_id string, z array<double>, q boolean, r boolean")
    out = SIM.top_k_neighbours(df, ["g"], "segment_id", 2, "cosine", with_cats=False,
                               query_filter=F.col("q"), ref_filter=F.col("r")).orderBy("rank").collect()
    assert [(r.segment_id, r.similar_segment_id) for r in out] == [("q1", "r3"), ("q1", "r1")]


def _seg_seg(a, b, c, d):
    def psd(p, s, e):
        dx, dy = e[0] - s[0], e[1] - s[1]
        l2 = dx * dx + dy * dy
        t = 0.0 if l2 == 0 else max(0.0, min(1.0, ((p[0] - s[0]) * dx + (p[1] - s[1]) * dy) / l2))
        return math.hypot(p[0] - (s[0] + t * dx), p[1] - (s[1] + t * dy))

    def orient(p, q, r):
        v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (v > 0) - (v < 0)
    if orient(a, b, c) * orient(a, b, d) < 0 and orient(c, d, a) * orient(c, d, b) < 0:
        return 0.0
    return min(psd(a, c, d), psd(b, c, d), psd(c, a, b), psd(d, a, b))


@pytest.mark.parametrize("cell", [0.002, None])
def test_nearest_way_equals_bruteforce(spark, cell):
    random.seed(3)
    edges = []
    for w in range(40):
        x, y = random.uniform(0, 0.2), random.uniform(0, 0.2)
        for e in range(2):
            nx, ny = x + random.uniform(-0.01, 0.01), y + random.uniform(-0.01, 0.01)
            edges.append((w, x, y, nx, ny))
            x, y = nx, ny
    chords = [(f"s{i}", random.uniform(-0.1, 0.3), random.uniform(-0.1, 0.3), 0.0, 0.0) for i in range(60)]
    chords = [(s, la, lo, la + random.uniform(-0.005, 0.005), lo + random.uniform(-0.005, 0.005))
              for s, la, lo, _, _ in chords]
    cdf = spark.createDataFrame(chords, "segment_id string, start_lat double, start_lng double, end_lat double, "
                                        "end_lng double")
    edf = spark.createDataFrame(edges, "way_id long, ax double, ay double, bx double, by double")
    got = {r.segment_id: (r.way_id, r.distance) for r in TR.nearest_way(cdf, edf, cell=cell).collect()}
    for s, la1, lo1, la2, lo2 in chords:
        best = min((_seg_seg((lo1, la1), (lo2, la2), (ax, ay), (bx, by)), w) for w, ax, ay, bx, by in edges)
        assert got[s][0] == best[1] and got[s][1] == pytest.approx(best[0])


def test_nearest_in_time_both_directions(spark):
    refs = spark.createDataFrame([(1, 100), (1, 250), (2, 5), (1, 1000)], "k long, t long")
    samples = spark.createDataFrame([(1, 90, "a"), (1, 200, "b"), (1, 300, "c"), (2, 10, "d")],
                                    "k long, dt long, v string")
    got = {(r.k, r.t): r.v for r in WX.nearest_in_time(refs, samples, "k", "t", "dt").collect()}
    # 250 is equidistant to 200 and 300: the earlier sample wins
    assert got == {(1, 100): "a", (1, 250): "b", (2, 5): "d", (1, 1000): "c"}


def test_nearest_in_time_equals_bruteforce_across_hours(spark):
    rng = random.Random(4)
    refs = [(k, rng.randrange(0, 60000), i) for i, k in enumerate([1] * 200 + [2] * 10 + [3] * 3)]
    refs += [(1, None, 900), (None, 50, 901)]
    samples = [(1, t, t * 10) for t in sorted(rng.sample(range(5000, 40000), 60))] + [(2, 30000, 7), (2, None, 8)]
    rd = spark.createDataFrame(refs, "k long, t long, i long")
    sd = spark.createDataFrame(samples, "k long, dt long, v long")
    got = {r.i: r.v for r in WX.nearest_in_time(rd, sd, "k", "t", "dt").collect()}
    assert len(got) == len(refs)
    for k, t, i in refs:
        near = [(abs(d - t), d, v) for kk, d, v in samples if kk == k and t is not None and d is not None]
        assert got[i] == (min(near)[2] if near else None)


def test_hot_place_is_spread_over_tasks(spark):
    """One place holds every ref and sample: the final join has rows in most partitions."""
    refs = spark.range(4000).select(F.lit(1).alias("k"), (F.col("id") * 97 % 400000).alias("t"))
    samples = spark.range(400).select(F.lit(1).alias("k"), (F.col("id") * 1000).alias("dt"), F.col("id").alias("v"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = WX.nearest_in_time(refs, samples, "k", "t", "dt").groupBy(F.spark_partition_id().alias("p")).count()
        per = [r["count"] for r in out.collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(per) == 4000 and len(per) > 3 and max(per) < 2500


def test_segment_distance_crossing_is_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0)], "a double, b double, c double, d double, "
                               "e double, f double, g double, h double")
    assert df.select(X.segment_segment_distance(*"abcdefgh").alias("x")).first().x == 0.0


def test_ttl_chain_equals_fold(spark):
    from segspark.operators import chains as CH
    from segspark.operators import cuts as C
    random.seed(11)
    rows, t = [], 0
    for n in range(300):
        t += random.choice([0, 10, 60, 120, 299, 300, 301, 900])
        rows.append((random.choice([1, 1, 1, 2]), "a", t, n))
    df = spark.createDataFrame(rows, "user_id long, activity string, s long, event_id long").withColumn(
        "ts", F.timestamp_seconds("s"))
    fold = sorted(r.event_id for r in C.ttl_dedup(df, ["user_id", "activity"], "ts", 300).collect())
    chain = sorted(r.event_id for r in CH.ttl_dedup_chain(df, ["user_id", "activity"], "ts", "event_id", 300).collect())
    assert chain == fold


def test_ttl_dedup_by_key_size_equals_fold(spark):
    """Large keys by the chain, the others folded; null keys and equal times included."""
    from segspark.operators import chains as CH
    from segspark.operators import cuts as C
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), "a", rng.randrange(0, 20_000), n) for n in range(400)]
    df = spark.createDataFrame(rows, "user_id long, _key string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s"))
    fold = sorted(r.event_id for r in C.ttl_dedup(df, ["user_id"], "ts", 300).collect())
    for limit in (0, 100, 10_000):
        got = CH.ttl_dedup_any_size(df, ["user_id"], "ts", "event_id", 300, fold_limit=limit)
        assert got.columns == df.columns and sorted(r.event_id for r in got.collect()) == fold


def test_reconcile_in_any_order(spark):
    """A row for every id of any side; a side that has not come is null and its status false."""
    from segspark.operators import status as S
    seg = spark.createDataFrame([("a", 1.0), ("b", None)], "segment_id string, segment_length double")
    ter = spark.createDataFrame([("b", "path"), ("c", "track")], "segment_id string, road_type string")
    wea = spark.createDataFrame([("a", 9.0), ("d", 8.0)], "segment_id string, temperature double")
    got = {r.segment_id: (r.segment_length, r.road_type, r.temperature, r.segment_status, r.terrain_status, r.weather_status)
           for r in S.reconcile(seg, ter, wea).collect()}
    assert got == {"a": (1.0, None, 9.0, True, False, True), "b": (None, "path", None, True, True, False),
                   "c": (None, "track", None, False, True, False), "d": (None, None, 8.0, False, False, True)}


def test_pca_projection_matches_numpy(spark):
    from segspark.operators import pca as PCA
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        z = rng.normal(size=12).tolist()
        rows.append((1, f"s{i:02d}", z, [str(rng.integers(0, 3))]))
    df = spark.createDataFrame(rows, "g long, segment_id string, z array<double>, cats array<string>")
    got = {r.segment_id: np.array(r.z) for r in PCA.project(df, ["g"], k=3).collect()}
    x = np.array([r[2] + [1.0 if r[3][0] == v else 0.0 for v in ["0", "1", "2"]] for r in rows])
    xc = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(xc, full_matrices=False)
    ref = xc @ vt[:3].T
    for i, r in enumerate(rows):
        # equal up to the sign of each component
        assert np.allclose(np.abs(got[r[1]]), np.abs(ref[i]), atol=1e-8)


def _clustered(seed=3, clusters=12, per=60, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 30
    z = np.concatenate([c + rng.normal(size=(per, dim)) for c in centres]).round(4)
    z[7] = z[5]  # equal rows tie
    z[11] = 0.0
    return z


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_pruned_topk_equals_bruteforce_on_clusters(spark, metric):
    z = _clustered()
    rows = [(1, f"p{i:04d}", v.tolist()) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "g long, segment_id string, z array<double>")
    got = {(r.segment_id, r.rank): (r.similar_segment_id, r.similarity_score) for r in SIM.top_k_neighbours(
        df, ["g"], "segment_id", 4, metric, block_size=40, with_cats=False).collect()}
    if metric == "cosine":
        norm = np.linalg.norm(z, axis=1)
        score = np.einsum("id,jd->ij", z, z) / np.where(norm > 0, norm, 1)[:, None] / np.where(norm > 0, norm, 1)[None, :]
        key = -score
    else:
        score = key = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    assert len(got) == 4 * len(z)
    for i in range(len(z)):
        best = sorted((round(key[i, j], 9), j) for j in range(len(z)) if j != i)[:4]
        for rank, (_, j) in enumerate(best, start=1):
            name, s = got[(f"p{i:04d}", rank)]
            assert s == pytest.approx(score[i, j], abs=1e-9)
    assert got[("p0007", 1)][0] == "p0005" and got[("p0005", 1)][0] == "p0007"


def test_far_block_pairs_are_not_sent(spark):
    z = _clustered()
    rows = [(1, f"p{i:04d}", v.tolist(), len(z), True, True) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "g long, id string, z array<double>, _n int, _isq boolean, _isr boolean")
    placed = SIM.place_in_blocks(df, ["g"], "euclidean", 20, False).cache()
    sizes = [r["count"] for r in placed.groupBy("_blk").count().collect()]
    assert sum(sizes) == len(z) and max(sizes) <= 2 * 20 + 10
    every = SIM.unit_pairs(placed.withColumn("_bound", F.lit(float("inf"))), placed, ["g"]).count()
    near = SIM.unit_pairs(placed.withColumn("_bound", F.lit(3.0)), placed, ["g"]).count()
    assert every == len(sizes) * (len(sizes) - 1)
    assert near < every / 4


def test_equal_rows_are_split_into_blocks(spark):
    rows = [(1, f"p{i:03d}", [1.0, 2.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "g long, segment_id string, z array<double>")
    out = SIM.top_k_neighbours(df, ["g"], "segment_id", 2, block_size=8, with_cats=False).collect()
    assert len(out) == 200
    assert {r.similar_segment_id for r in out if r.segment_id == "p050"} == {"p000", "p001"}


def test_activity_views_keep_their_columns(spark):
    from segspark.operators import views as V
    a = spark.createDataFrame([(1, "a", 5.0, 60, 9, False), (2, "b", 6.0, 70, 9, None), (-3, "c", 7.0, 80, 9, True)],
                              "id long, name string, distance double, moving_time int, athlete_id long, is_planned boolean")
    st = spark.createDataFrame([(1, "CREATED")], "id long, status string")
    v = V.activity_view(a, st)
    assert v.columns == list(V.ACTIVITY_VIEW)
    assert {(r.id, r.status) for r in v.collect()} == {(1, "CREATED"), (2, None)}
    p = V.planned_view(a)
    assert p.columns == V.PLANNED_VIEW and p.first().planned_duration == 80


def test_top_by_grade_skips_the_row_itself(spark):
    from segspark.operators import views as V
    rows = [(f"s{i}", 1, 3, float(i)) for i in range(8)] + [("p", -1, 3, 99.0), ("x", 1, 4, None)]
    df = spark.createDataFrame(rows, "segment_id string, activity_id long, grade_category int, efficiency_score double")
    got = {}
    for r in V.top_by_grade(df, 5).collect():
        got.setdefault(r.segment_id, {})[r["rank"]] = r.top_segment_id
    assert got["p"] == {1: "s7", 2: "s6", 3: "s5", 4: "s4", 5: "s3"}
    assert got["s6"] == {1: "s7", 2: "s5", 3: "s4", 4: "s3", 5: "s2"}
    assert "x" not in got


def test_pivots_of_many_groups_in_one_batch():
    """A batch holds many groups: each gets the pivots it would get alone."""
    import pandas as pd
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame([(g, f"p{g}_{i}", rng.normal(size=3).tolist()) for i in range(6) for g in (1, 2, 3)], columns=["g", "id", "z"])
    got = SIM._choose_pivots(pdf, ["g"], "euclidean")
    assert sorted(got["g"]) == [1, 2, 3]
    for _, row in got.iterrows():
        alone = SIM._choose_pivots(pdf[pdf["g"] == row["g"]], ["g"], "euclidean").iloc[0]
        assert row["_pz"] == alone["_pz"] and row["_width"] == alone["_width"]


def test_category_codes_keep_the_mismatches():
    a = np.array([["x", "", "p"], ["y", "", "p"]], dtype=object)
    b = np.array([["y", "", "q"], ["x", "", "p"], ["z", "", None]], dtype=object)
    ca, cb = SIM._codes(a, b)
    assert ca.shape == (2, 2)  # the column of one value is left out
    assert ((ca[:, None] != cb[None]).sum(axis=2) == (a[:, None] != b[None]).sum(axis=2)).all()


def test_projected_distances_are_those_of_the_components(spark):
    """A group of equal categories and one of different ones, projected in one call, keep their own centre."""
    from segspark.operators import pca as PCA
    rng = np.random.default_rng(11)
    rows = [(g, f"s{g}_{i:02d}", (rng.normal(size=5) + 100 * g).tolist(), [str(i % 2)]) for g in (1, 2) for i in range(12)]
    df = spark.createDataFrame(rows, "g long, segment_id string, z array<double>, cats array<string>")
    got = {r.segment_id: np.array(r.z) for r in PCA.project(df, ["g"], k=2, n_cat=1).collect()}
    for g in (1, 2):
        x = np.array([r[2] + [1.0 - int(r[3][0]), float(r[3][0])] for r in rows if r[0] == g])
        xc = x - x.mean(axis=0)
        ref = xc @ np.linalg.svd(xc, full_matrices=False)[2][:2].T
        for r, v in zip([r for r in rows if r[0] == g], ref):
            assert np.allclose(np.abs(got[r[1]]), np.abs(v), atol=1e-8)


def _nearest(z, cats, ids, k):
    """(row, k nearest ids with distances), ties by id, rows of one id left out."""
    for i in range(len(z)):
        sq = np.zeros(len(z))
        for j in range(z.shape[1]):
            sq += (z[:, j] - z[i, j]) ** 2
        for j in range(cats.shape[1]):
            sq += 2.0 * (cats[:, j] != cats[i, j])
        d = np.sqrt(sq)
        yield i, sorted((d[j], ids[j]) for j in range(len(z)) if ids[j] != ids[i])[:k]


def test_candidates_of_large_units_hold_the_nearest(monkeypatch):
    """the matrix product only chooses candidates: distances, ties and order are those of all pairs."""
    import pandas as pd
    rng = np.random.default_rng(12)
    n = 700
    z = np.concatenate([rng.normal(size=(n - 60, 4)), np.repeat(rng.normal(size=(6, 4)), 10, axis=0)]) * 1e3 + 1e6
    cats = rng.choice(["a", "b", None], size=(n, 2)).astype(object)
    cats[-60:] = "a"
    ids = np.array([f"i{j:04d}" for j in rng.permutation(n)], dtype=object)
    ids[5] = ids[6]
    q = pd.DataFrame({"g": 1, "id": ids, "z": list(z), "cats": list(cats)})
    used, found = [], SIM._candidates
    monkeypatch.setattr(SIM, "_candidates", lambda *a: used.append(found(*a)) or used[-1])
    got = SIM._score_unit(q, q, ["g"], 5, "euclidean", 50_000)
    assert used[0] is not None
    assert sum(len(used[0](lo, lo + 70)[0]) for lo in range(0, n, 70)) < n * n / 10
    rows = got.groupby(np.arange(len(got)) // 5)
    for (i, want), (_, have) in zip(_nearest(z, cats, ids, 5), rows, strict=True):
        assert set(have["id"]) == {ids[i]}
        assert list(zip(have["score"], have["similar_id"])) == want
    z[3, 2] = np.nan
    assert found(z, None, z, None, np.arange(n), 5) is None


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("most", [32_768, 40])
def test_blocks_of_a_group_meet_in_place(spark, monkeypatch, metric, most):
    """groups that fit a task send each row once and rank there; larger ones still send pairs of blocks, with equal results."""
    rng = np.random.default_rng(13)
    rows = [(g, f"p{g}_{i:03d}", rng.normal(size=3).round(1).tolist(), [str(rng.integers(0, 2))]) for g, n in ((1, 120), (2, 30), (3, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, segment_id string, z array<double>, cats array<string>")
    monkeypatch.setattr(SIM, "GATHERED", most)
    sides = []
    units = SIM._score_units
    monkeypatch.setattr(SIM, "_score_units", lambda u, *a: sides.append(u) or units(u, *a))
    cats = metric == "euclidean"
    got = {(r.segment_id, r["rank"]): (r.similar_segment_id, r.similarity_score) for r in SIM.top_k_neighbours(
        df, ["g"], "segment_id", 3, metric, block_size=8, with_cats=cats).collect()}
    whole = {(r.segment_id, r["rank"]): (r.similar_segment_id, r.similarity_score) for r in SIM.top_k_neighbours(
        df, ["g"], "segment_id", 3, metric, with_cats=cats).collect()}
    assert got.keys() == whole.keys() and len(sides) == (1 if most > 120 else 3)
    for key, (name, score) in whole.items():
        assert got[key][1] == pytest.approx(score, abs=1e-9)
        assert metric == "cosine" or got[key][0] == name
