"""J11 within the tiles: the nearest way among an activity's own candidates, on a map with a dense town."""

from __future__ import annotations

import math
import random

from segspark.operators import terrain as TR


def distance(c, e):
    def point(px, py, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = 0 if n == 0 else max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / n))
        return math.hypot(px - ax - t * dx, py - ay - t * dy)

    def side(px, py, qx, qy, rx, ry):
        v = (qx - px) * (ry - py) - (qy - py) * (rx - px)
        return (v > 0) - (v < 0)
    (x1, y1, x2, y2), (ax, ay, bx, by) = c, e
    if side(x1, y1, x2, y2, ax, ay) * side(x1, y1, x2, y2, bx, by) < 0 and side(ax, ay, bx, by, x1, y1) * side(ax, ay, bx, by, x2, y2) < 0:
        return 0.0
    return min(point(x1, y1, ax, ay, bx, by), point(x2, y2, ax, ay, bx, by), point(ax, ay, x1, y1, x2, y2), point(bx, by, x1, y1, x2, y2))


def test_nearest_in_tiles(spark):
    r = random.Random(3)
    edges = [(k, r.uniform(0, 0.01), r.uniform(0, 0.01)) for k in range(400)] + [(1000 + k, r.uniform(0, 1), r.uniform(0, 1)) for k in range(30)]
    edges = [(k, x, y, x + r.uniform(-0.001, 0.001), y + r.uniform(-0.001, 0.001)) for k, x, y in edges] + [(2000, 0.0, 0.9, 1.0, 0.95)]
    chords = [(a, f"{a}-{k}", x, y, x + r.uniform(-0.002, 0.002), y + r.uniform(-0.002, 0.002)) for a in (1, 2, 3) for k in range(25)
              for x, y in [(r.uniform(0, 0.01), r.uniform(0, 0.01)) if k < 15 else (r.uniform(0, 1), r.uniform(0, 1))]]
    own = {1: [e[0] for e in edges], 2: [e[0] for e in edges if e[0] % 3 == 0], 3: []}
    c = spark.createDataFrame(chords, "activity_id long, segment_id string, start_lng double, start_lat double, end_lng double, end_lat double")
    e = spark.createDataFrame(edges, "way_id long, ax double, ay double, bx double, by double")
    ids = spark.createDataFrame([(a, w) for a, ws in own.items() for w in ws], "activity_id long, way_id long")
    got = {x.segment_id: (x.way_id, round(x.distance, 12)) for x in TR.nearest_way_in_tiles(c, e, ids).collect()}
    want = {}
    for a, s, *line in chords:
        if own[a]:
            d, w = min((distance(line, x[1:]), x[0]) for x in edges if x[0] in set(own[a]))
            want[s] = (w, round(d, 12))
    assert got == want
    assert TR.nearest_way_in_tiles(c, e, ids.limit(0)).count() == 0


def test_nearest_way_lies_outside_the_tiles(spark, monkeypatch):
    """A segment with no way in its activity's tiles has its nearest one all the same."""
    from segspark.plans import q_terrain_weather as Q
    segs = spark.createDataFrame([(1, "near", 46.0, 8.0, 46.001, 8.001), (2, "far", 51.0, 8.0, 51.0, 8.0)],
                                 "activity_id long, segment_id string, start_lat double, start_lng double, end_lat double, end_lng double")
    edges = spark.createDataFrame([(5, 1, 8.0, 46.002, 8.01, 46.002), (6, 1, 8.0, 47.0, 8.01, 47.0)],
                                  "way_id long, edge_no int, ax double, ay double, bx double, by double")
    monkeypatch.setattr(Q, "historical_segments", lambda *_: segs)
    monkeypatch.setattr(Q, "way_edges", lambda *_: edges)
    got = {r.segment_id: (r.way_id, round(r.distance, 6)) for r in Q.nearest_way(spark, "").collect()}
    assert got == {"near": (5, 0.001), "far": (6, 4.0)}


def test_nearest_in_tiles_without_the_pairs(spark, monkeypatch):
    """from tiles and way boxes the same answers as from U3's pairs, which are only formed for the ways found."""
    from segspark.plans.q_terrain_weather import way_boxes
    monkeypatch.setattr(TR, "TOP", 1)
    r = random.Random(5)
    edges = []
    for k in range(600):
        x, y = (r.uniform(0, 0.3), r.uniform(0, 0.3)) if k % 3 else (0.1, r.randrange(40) / 200)
        for _ in range(1 + k % 3):
            to = x + r.uniform(-0.01, 0.01), y + r.uniform(-0.01, 0.01)
            edges.append((k, x, y, *to))
            x, y = to
    edges += [(900 + k, *e[1:]) for k, e in enumerate(edges[:60])] + [(990, 0.0, 0.29, 0.3, 0.3), (991, None, 0.1, 0.1, 0.1)]
    chords = [(a, f"{a}-{k}", 0.1, y, 0.1, y + 0.001) for a in (1, 2) for k in range(30) for y in [r.uniform(0, 0.25)]]  # a box without width
    chords += [(3, f"3-{k}", x, y, x + 0.002, y + 0.001) for k in range(40) for x, y in [(r.uniform(0, 0.3), r.uniform(0, 0.3))]]
    chords += [(4, "4-0", 7.0, 7.0, 7.0, 7.0), (3, "3-40", None, None, None, None), (3, "3-41", 0.1, None, 0.1, 0.2), chords[0]]
    c = spark.createDataFrame(chords, "activity_id long, segment_id string, start_lng double, start_lat double, end_lng double, end_lat double")
    e = spark.createDataFrame(edges, "way_id long, ax double, ay double, bx double, by double")
    tiles, bounds = TR.tiles(TR.bounding_boxes(c)), way_boxes(e)
    own = {}
    for a, w in TR.elements_in_tiles(tiles, bounds).collect():
        own.setdefault(a, set()).add(w)
    want = {}
    for a, s, *line in chords:
        if a in own and None not in line:
            d, w = min((distance(line, x[1:]), x[0]) for x in edges if x[0] in own[a] and None not in x)
            want[s] = (w, round(d, 12))
    asked, real = [], TR.elements_in_tiles

    def spy(tile_df, way_bounds, cell=0.1, among=None):
        out = real(tile_df, way_bounds, cell, among)
        asked.append((among is None, out.count(), tile_df.select("activity_id").distinct().count()))
        return out

    monkeypatch.setattr(TR, "elements_in_tiles", spy)
    got = {x.segment_id: (x.way_id, x.distance and round(x.distance, 12)) for x in TR.nearest_way_in_tiles(c, e, tiles=tiles, way_bounds=bounds).collect()}
    assert got.pop("3-40") == (min(own[3] - {991}), None) and got.pop("3-41")[0] in own[3]
    assert {s: round(d, 9) for s, (_, d) in got.items()} == {s: round(d, 9) for s, (_, d) in want.items()} and set(got) == set(want)
    assert sum(got[s][0] != want[s][0] for s in got) <= sum(d < 1e-12 for _, d in want.values())  # touching: rounding decides
    assert [x[0] for x in asked] == [False, True] and asked[0][1] <= len(chords)  # all pairs for the activity with nulls alone
    assert asked[1][2] == 1
    assert TR.nearest_way_in_tiles(c, e.limit(0), tiles=tiles, way_bounds=bounds.limit(0)).count() == 0
