"""Terrain enrichment.

Nearest way (J11) is the reference's "every segment x every way" loop turned
into an exact grid search:

* round t uses square cells of size ``cell * 2^t``; way edges are exploded to
  the cells their bounding box touches, each segment chord to the 3 x 3 block
  of cells around its own bounding box, and the two meet by an equi-join on
  the cell;
* any edge *not* met is farther than one cell from the chord, so a best
  candidate at distance <= cell size is the true nearest (ties: smaller way id);
* only chords without such a certified answer go to the next round, with
  cells twice as large; once a cell spans the whole extent of the ways every
  edge is a candidate and the answer is exact regardless.

Between rounds the pending chords are checkpointed to the cluster's
checkpoint folder so each round's plan stays short.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segspark.functions import expr as X
from segspark.operators.similarity import most_frequent
from segspark.session import write_table


# --- J13: node lookup -----------------------------------------------------------------

def way_polylines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Way node ids -> ordered coordinates; missing nodes are skipped, ways with < 2 points dropped.

    ``ways``: way_id, node_ids ARRAY<BIGINT>, tags...; ``nodes``: node_id, lat, lon.
    Output: one row per way edge (way_id, edge_no, ax, ay, bx, by) with x = lon, y = lat.
    """
    ex = ways.select("way_id", F.posexplode("node_ids").alias("pos", "node_id"))
    located = ex.join(nodes.select("node_id", "lat", "lon"), "node_id", "inner")
    w = Window.partitionBy("way_id").orderBy("pos")
    pts = located.select("way_id", F.row_number().over(w).alias("edge_no"), F.col("lon").alias("ax"), F.col("lat").alias("ay"),
                         F.lead(F.struct("lon", "lat")).over(w).alias("_next"))
    return pts.where(F.col("_next").isNotNull()).select(
        "way_id", "edge_no", "ax", "ay", F.col("_next.lon").alias("bx"), F.col("_next.lat").alias("by"))


# --- J11 + M2: nearest way ----------------------------------------------------------------

def _explode_cells(df: DataFrame, cols, minx, miny, maxx, maxy, size, ring):
    """One row per grid cell (cx, cy) of the box grown by ``ring`` cells."""
    def rng(lo, hi):
        return F.sequence(F.floor(lo / F.lit(size)) - F.lit(ring), F.floor(hi / F.lit(size)) + F.lit(ring))

    x = df.select(*cols, F.explode(rng(minx, maxx)).alias("cx"), miny.alias("_lo"), maxy.alias("_hi"))
    return x.select(*cols, "cx", F.explode(rng(F.col("_lo"), F.col("_hi"))).alias("cy"))


def nearest_way(chords: DataFrame, edges: DataFrame, cell: float | None = None, max_rounds: int = 48) -> DataFrame:
    """Closest way to every chord (segment start -> end) by planar distance in degrees.

    ``chords``: segment_id, start_lat, start_lng, end_lat, end_lng.
    ``edges``: way_id, ax, ay, bx, by. Output: segment_id, way_id, distance.
    Chords are matched only when at least one edge exists.
    """
    spark = chords.sparkSession
    # both inputs are read by every round: materialise them once in the checkpoint folder
    c = chords.select("segment_id", F.col("start_lng").alias("x1"), F.col("start_lat").alias("y1"),
                      F.col("end_lng").alias("x2"), F.col("end_lat").alias("y2")).checkpoint()
    e = edges.select("way_id", "ax", "ay", "bx", "by").checkpoint()
    # extent of ways and chords together: four numbers, the only values brought to the driver
    ee_ext = e.agg(F.min(F.least("ax", "bx")), F.min(F.least("ay", "by")),
                   F.max(F.greatest("ax", "bx")), F.max(F.greatest("ay", "by")), F.count(F.lit(1))).first()
    if ee_ext is None or ee_ext[0] is None:
        return spark.createDataFrame([], "segment_id string, way_id bigint, distance double")
    ce_ext = c.agg(F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")),
                   F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2"))).first()
    lo_x, lo_y = min(ee_ext[0], ce_ext[0] or ee_ext[0]), min(ee_ext[1], ce_ext[1] or ee_ext[1])
    hi_x, hi_y = max(ee_ext[2], ce_ext[2] or ee_ext[2]), max(ee_ext[3], ce_ext[3] or ee_ext[3])
    span = max(hi_x - lo_x, hi_y - lo_y, cell or 1e-6)
    if cell is None:
        # start where a cell holds about one edge; rounds double it until every chord is certified
        area = max((ee_ext[2] - ee_ext[0]) * (ee_ext[3] - ee_ext[1]), 1e-12)
        cell = max(2.0 * math.sqrt(area / max(ee_ext[4], 1)), span * 1e-6, 1e-7)
    pending = c
    results = []
    size = cell
    for _ in range(max_rounds):
        last = size >= 2 * span
        ce = _explode_cells(pending, ["segment_id", "x1", "y1", "x2", "y2"], F.least("x1", "x2"), F.least("y1", "y2"),
                            F.greatest("x1", "x2"), F.greatest("y1", "y2"), size, 1)
        ee = _explode_cells(e, ["way_id", "ax", "ay", "bx", "by"], F.least("ax", "bx"), F.least("ay", "by"),
                            F.greatest("ax", "bx"), F.greatest("ay", "by"), size, 0)
        cand = ce.join(ee, ["cx", "cy"], "inner")
        cand = X.with_segment_distance(cand, "x1", "y1", "x2", "y2", "ax", "ay", "bx", "by", "d")
        best = (cand.select("segment_id", "way_id", "d")
                .groupBy("segment_id").agg(F.min_by(F.struct("d", "way_id"), F.struct("d", "way_id")).alias("b"))
                .select("segment_id", F.col("b.way_id").alias("way_id"), F.col("b.d").alias("distance")))
        ok = best if last else best.where(F.col("distance") <= F.lit(size))
        ok = ok.checkpoint()
        results.append(ok)
        if last:
            break
        pending = pending.join(ok.select("segment_id"), "segment_id", "left_anti").checkpoint()
        if pending.isEmpty():
            break
        size *= 2
    else:
        raise RuntimeError(f"chords without a certified nearest way after {max_rounds} rounds")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


BLOCKS = 16  # density is counted in BLOCKS x BLOCKS parts of an activity's extent
WIDE = 256  # an edge over more cells than this meets its activity's chords without the grid


def nearest_way_in_tiles(chords: DataFrame, edges: DataFrame, candidates: DataFrame | None = None, max_rounds: int = 64, *,
                         tiles: DataFrame | None = None, way_bounds: DataFrame | None = None) -> DataFrame:
    """Closest way to every chord among the ways fetched for its own activity's tiles.

    ``chords``: activity_id, segment_id, start_lat, start_lng, end_lat, end_lng; ``edges`` as in ``nearest_way``. Chords
    of activities without candidates have no row. What is fetched comes as ``candidates`` (activity_id, way_id), or as
    ``tiles`` and ``way_bounds``, the inputs of ``elements_in_tiles``: then the pairs of an activity and a way, whose
    number grows with both, are never formed, and U3 is asked only about the ways that were found.
    """
    if candidates is None:
        return _nearest_in_boxes(chords, edges, tiles, way_bounds)
    return _nearest_of_pairs(chords, edges, candidates, max_rounds)


def _nearest_of_pairs(chords: DataFrame, edges: DataFrame, candidates: DataFrame, max_rounds: int) -> DataFrame:
    """``nearest_way_in_tiles`` for any pairs of an activity and a way.

    Cells are those of a quadtree over the activity's extent, and adapt to it: a chord starts in cells that hold a
    few of the edges counted around it, small in a dense town, large in open land, and edges are put on the levels that
    pending chords use. Edges that are not met lie farther than a cell, so an answer within one cell is final; other
    chords go up two levels. Above the root every edge of the activity, and no other, is met.
    """
    ids = candidates.select("activity_id", "way_id").distinct()
    c = write_table(chords.select("activity_id", "segment_id", F.col("start_lng").alias("x1"), F.col("start_lat").alias("y1"),
                                  F.col("end_lng").alias("x2"), F.col("end_lat").alias("y2"))
                    .join(ids.select("activity_id").distinct(), "activity_id", "left_semi"), "chords")
    e = write_table(ids.join(edges, "way_id").select("activity_id", "way_id", "ax", "ay", "bx", "by"), "tile-edges")
    both = e.select("activity_id", *[f(a, b).alias(n) for n, f, a, b in (
        ("x0", F.least, "ax", "bx"), ("y0", F.least, "ay", "by"), ("xn", F.greatest, "ax", "bx"), ("yn", F.greatest, "ay", "by"))]).unionByName(
        c.select("activity_id", F.least("x1", "x2").alias("x0"), F.least("y1", "y2").alias("y0"),
                 F.greatest("x1", "x2").alias("xn"), F.greatest("y1", "y2").alias("yn")))
    extent = both.groupBy("activity_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.greatest(
        F.max("xn") - F.min("x0"), F.max("yn") - F.min("y0"), F.lit(1e-6)).alias("span"))
    extent = write_table(extent.join(e.select("activity_id").distinct(), "activity_id", "left_semi"), "extents")

    def block(x, y):
        side = F.col("span") / BLOCKS
        return F.floor((x - F.col("x0")) / side).alias("gx"), F.floor((y - F.col("y0")) / side).alias("gy")

    dense = e.join(extent, "activity_id").select("activity_id", *block((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2)).groupBy(
        "activity_id", "gx", "gy").agg(F.count(F.lit(1)).alias("n"))
    start = F.when(F.col("n").isNull(), F.lit(2)).otherwise(3 + F.floor(F.log2(F.col("n").cast("double")) / 2)).cast("int")
    own = c.join(extent, "activity_id")
    pending = own.select("*", *block(F.col("x1"), F.col("y1"))).join(dense, ["activity_id", "gx", "gy"], "left").select(
        "activity_id", "segment_id", "x1", "y1", "x2", "y2", "x0", "y0", "span", start.alias("level"))
    pending, results = write_table(pending, "pending"), []
    size = F.col("span") * F.pow(F.lit(2.0), -F.col("level"))

    def cells(lo, hi, origin, ring):
        return F.sequence(F.floor((lo - F.col(origin)) / size) - ring, F.floor((hi - F.col(origin)) / size) + ring)

    for _ in range(max_rounds):
        at = pending.select("*", F.explode(cells(F.least("x1", "x2"), F.greatest("x1", "x2"), "x0", 1)).alias("cx"))
        at = at.select("*", F.explode(cells(F.least("y1", "y2"), F.greatest("y1", "y2"), "y0", 1)).alias("cy"))
        levels = pending.select("activity_id", "x0", "y0", "span", "level").distinct()
        put = e.join(levels, "activity_id").withColumns({
            "_xs": cells(F.least("ax", "bx"), F.greatest("ax", "bx"), "x0", 0), "_ys": cells(F.least("ay", "by"), F.greatest("ay", "by"), "y0", 0)})
        put = put.withColumn("_wide", F.size("_xs").cast("long") * F.size("_ys") > WIDE)
        edge = ["activity_id", "level", "way_id", "ax", "ay", "bx", "by"]
        near = put.where("NOT _wide").select(*edge, F.explode("_xs").alias("cx"), "_ys").select(*edge, "cx", F.explode("_ys").alias("cy"))
        chord = ["activity_id", "level", "segment_id", "x1", "y1", "x2", "y2", "span"]
        met = at.select(*chord, "cx", "cy").join(near, ["activity_id", "level", "cx", "cy"]).drop("cx", "cy")
        met = met.unionByName(pending.select(*chord).join(put.where("_wide").select(*edge), ["activity_id", "level"]))
        met = X.with_segment_distance(met, "x1", "y1", "x2", "y2", "ax", "ay", "bx", "by", "d")
        best = met.groupBy("activity_id", "segment_id").agg(F.min(F.struct("d", "way_id")).alias("b"), F.first(size).alias("size"), F.first("level").alias("level"))
        sure = write_table(best.where((F.col("b.d") <= F.col("size")) | (F.col("level") < 0)).select(
            "activity_id", "segment_id", F.col("b.way_id").alias("way_id"), F.col("b.d").alias("distance")), "nearest")
        results.append(sure)
        pending = write_table(pending.join(sure, ["activity_id", "segment_id"], "left_anti").withColumn("level", F.greatest(F.col("level") - 2, F.lit(-1))), "pending")
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, results)
    raise RuntimeError(f"chords without a certified nearest way after {max_rounds} rounds")


LEAF_BITS, FAN_BITS = 5, 4  # a leaf holds up to 32 edges, a node up to 16 nodes of the level below
TOP = 16  # a search starts at the first level of at most this many nodes
BEAM = 4  # the first descent follows this many nodes of a level
SLACK = 1e-9  # degrees; far above the rounding of a distance, so no edge at the same distance is left out


def _morton(df: DataFrame, x, y, bits: int = 30) -> DataFrame:
    """``df`` with ``_z``: the bits of two whole numbers below 2^bits in turn."""
    df = df.withColumns({"_zx": x.cast("long"), "_zy": y.cast("long")})
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        df = df.withColumns({c: F.col(c).bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask)) for c in ("_zx", "_zy")})
    return df.withColumn("_z", F.col("_zx").bitwiseOR(F.shiftleft("_zy", 1))).drop("_zx", "_zy")


def _edge_tree(edges: DataFrame, way_bounds: DataFrame):
    """The edges in Morton order as the leaves of a packed tree: (edges with ``node``, tables of nodes from the leaves up).

    A node has the box of its edges (x0, y0, xn, yn), the box of their ways' boxes (w0, s0, wn, sn) and the smallest way
    id. Edges that are equal, with equal boxes of their ways, are at one distance of every chord and stand as the
    smallest way id among them. None if there is no edge.
    """
    box = [F.col("min_lng").alias("w0"), F.col("min_lat").alias("s0"), F.col("max_lng").alias("wn"), F.col("max_lat").alias("sn")]
    e = edges.select("way_id", "ax", "ay", "bx", "by").na.drop().join(way_bounds.select("way_id", *box), "way_id")
    e = e.groupBy("ax", "ay", "bx", "by", "w0", "s0", "wn", "sn").agg(F.min("way_id").alias("way_id"))
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    x0, y0, xn, yn = e.agg(F.min(mx), F.min(my), F.max(mx), F.max(my)).first()
    if x0 is None:
        return None
    unit = F.lit((2**30 - 1) / max(xn - x0, yn - y0, 1e-9))
    e = _morton(e, F.floor((mx - F.lit(x0)) * unit), F.floor((my - F.lit(y0)) * unit))
    e = write_table(e.repartitionByRange("_z").sortWithinPartitions("_z").drop("_z")
                    .withColumn("_at", F.monotonically_increasing_id()), "tree-edges")
    # the rank in Morton order: a partition's number, then the row's within it
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    parts, rows = e.agg(F.max(part), F.max(row)).first()
    bits = max(LEAF_BITS, int(rows).bit_length())
    e = e.withColumn("node", F.shiftright(F.shiftleft(part, bits).bitwiseOR(row), LEAF_BITS)).drop("_at")
    low = [F.min(F.least("ax", "bx")), F.min(F.least("ay", "by")), F.max(F.greatest("ax", "bx")), F.max(F.greatest("ay", "by"))]
    names, ways = ("x0", "y0", "xn", "yn"), [F.min("w0").alias("w0"), F.min("s0").alias("s0"), F.max("wn").alias("wn"),
                                            F.max("sn").alias("sn"), F.min("way_id").alias("way_id")]
    levels = [write_table(e.groupBy("node").agg(*[c.alias(n) for c, n in zip(low, names)], *ways), "tree-0")]
    most = ((int(parts) + 1) << bits) >> LEAF_BITS
    while most > TOP:
        up = levels[-1].groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(
            F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("xn").alias("xn"), F.max("yn").alias("yn"), *ways)
        levels.append(write_table(up, f"tree-{len(levels)}"))
        most = (most >> FAN_BITS) + 1 if most >> FAN_BITS else 1
    return e, levels


def _nearest_in_boxes(chords: DataFrame, edges: DataFrame, tiles: DataFrame, way_bounds: DataFrame) -> DataFrame:
    """``nearest_way_in_tiles`` by branch and bound over one tree of all edges.

    Every activity searches the same tree, in the box around its tiles. A node is left out if the box of its ways does
    not meet that box, or if it lies farther from the chord than an edge already found. The first descent follows a few
    near nodes of each level and finds such an edge, the second all that may hold a nearer one or one as near of a
    smaller way id, so it ends with the nearest. The box around the tiles holds them and, but for a gap of rounding between two
    tiles, nothing else; U3 decides on the ways found, and a chord whose way it does not fetch, or without all its
    coordinates, is compared with every way of its activity's tiles.
    """
    line = ["x1", "y1", "x2", "y2"]
    c = chords.select("activity_id", "segment_id", F.col("start_lng").alias("x1"), F.col("start_lat").alias("y1"),
                      F.col("end_lng").alias("x2"), F.col("end_lat").alias("y2"))
    area = tiles.groupBy("activity_id").agg(F.min("west").alias("a_w"), F.min("south").alias("a_s"),
                                            F.max("east").alias("a_e"), F.max("north").alias("a_n"))
    c = write_table(c.join(area, "activity_id").withColumn("chord", F.monotonically_increasing_id()), "chords")
    tree = _edge_tree(edges, way_bounds)
    if tree is None:
        return c.select("activity_id", "segment_id", F.lit(None).cast("long").alias("way_id"), F.lit(None).cast("double").alias("distance")).limit(0)
    leaves, levels = tree
    key = ["chord", *line, "a_w", "a_s", "a_e", "a_n"]
    meets = (F.col("w0") <= F.col("a_e")) & (F.col("wn") >= F.col("a_w")) & (F.col("s0") <= F.col("a_n")) & (F.col("sn") >= F.col("a_s"))

    def gap(lo, hi, a, b):
        return F.greatest(F.lit(0.0), F.col(lo) - F.greatest(a, b), F.least(a, b) - F.col(hi))

    gx, gy = gap("x0", "xn", "x1", "x2"), gap("y0", "yn", "y1", "y2")
    low = F.sqrt(gx * gx + gy * gy).alias("low")

    def descend(start, keep):
        """Edges met from the top: at every level ``keep`` chooses among the nodes that may hold a way of the box."""
        front = keep(start.join(F.broadcast(levels[-1]), meets).select(
            *start.columns, "node", F.col("way_id").alias("least_way"), low).repartition("chord"))
        for nodes in reversed(levels[:-1]):
            below = nodes.withColumn("_up", F.shiftright("node", FAN_BITS))
            front = keep(front.select(*start.columns, F.col("node").alias("_up")).join(below, "_up").where(meets).select(
                *start.columns, "node", F.col("way_id").alias("least_way"), low))
        # written, so that the distances are not in one generated method with the descent, too long to be compiled
        met = write_table(front.select(*start.columns, "node"), "near-leaves").join(leaves, "node").where(meets)
        met = X.with_segment_distance(met, *line, "ax", "ay", "bx", "by", "d")
        return met.groupBy("chord").agg(F.min(F.struct("d", "way_id")).alias("b"))

    whole = c.na.drop(subset=line)
    few = Window.partitionBy("chord").orderBy("low", "least_way", "node")
    found = write_table(descend(whole.select(*key), lambda f: f.withColumn("_n", F.row_number().over(few)).where(
        F.col("_n") <= BEAM).drop("_n")), "found")
    bound = whole.select(*key).join(found.select("chord", F.col("b.d").alias("d0"), F.col("b.way_id").alias("way0")), "chord", "left")
    # nothing is nearer than 0: there only a smaller way id counts
    nearer = F.col("d0").isNull() | ((F.col("low") <= F.col("d0") + F.lit(SLACK)) & ((F.col("d0") > 0) | (F.col("least_way") < F.col("way0"))))
    best = descend(bound, lambda f: f.where(nearer)).unionByName(found).groupBy("chord").agg(F.min("b").alias("b"))
    best = c.join(best, "chord").groupBy("activity_id", "segment_id").agg(F.min("b").alias("b"))
    best = write_table(best.select("activity_id", "segment_id", F.col("b.way_id").alias("way_id"), F.col("b.d").alias("distance")), "nearest")
    pair = ["activity_id", "way_id"]
    sure = best.join(elements_in_tiles(tiles, way_bounds, among=best.select(*pair).distinct()), pair, "left_semi")
    sure = write_table(sure.select(best.columns), "fetched")
    one = ["activity_id", "segment_id"]
    again = best.select(*one).join(sure.select(*one), one, "left_anti")
    partly = c.where(reduce(lambda a, b: a | b, [F.col(x).isNull() for x in line])).select(*one)
    rest = write_table(c.join(again.unionByName(partly).distinct(), one, "left_semi").select(*one, *line), "rest")
    if rest.isEmpty():
        return sure
    own = elements_in_tiles(tiles.join(rest.select("activity_id").distinct(), "activity_id", "left_semi"), way_bounds)
    each = rest.join(own, "activity_id").join(edges.select("way_id", "ax", "ay", "bx", "by").na.drop(), "way_id")
    each = X.with_segment_distance(each, *line, "ax", "ay", "bx", "by", "d")
    rest = each.groupBy(*one).agg(F.min(F.struct("d", "way_id")).alias("b")).select(
        *one, F.col("b.way_id").alias("way_id"), F.col("b.d").alias("distance"))
    return sure.join(rest.select(*one), one, "left_anti").unionByName(rest)


# --- A7: modal surface per highway ----------------------------------------------------------

def modal_surface(ways: DataFrame) -> DataFrame:
    """Most frequent surface per highway type (ties -> smallest surface name)."""
    return most_frequent(ways, ["highway"], "surface", "modal_surface")


def fill_surface(ways: DataFrame) -> DataFrame:
    """Missing surfaces take their highway's modal surface (deterministic over the ways table, D21)."""
    m = modal_surface(ways.where(F.col("highway").isNotNull()))
    return ways.join(m, "highway", "left").withColumn("surface", F.coalesce("surface", "modal_surface")).drop("modal_surface")


# --- A8 + Q4: bounding box and tiles ---------------------------------------------------------

def bounding_boxes(segments: DataFrame) -> DataFrame:
    """Per activity min/max latitude and longitude over both segment ends."""
    return segments.groupBy("activity_id").agg(
        F.least(F.min("start_lat"), F.min("end_lat")).alias("min_lat"),
        F.greatest(F.max("start_lat"), F.max("end_lat")).alias("max_lat"),
        F.least(F.min("start_lng"), F.min("end_lng")).alias("min_lng"),
        F.greatest(F.max("start_lng"), F.max("end_lng")).alias("max_lng"))


def tiles(boxes: DataFrame, lat_step: float = 0.1, lng_step: float = 0.1) -> DataFrame:
    """Cut every box into step x step tiles clipped to the box (at least one tile per box)."""
    def n(lo, hi, step):
        return F.greatest(F.ceil((F.col(hi) - F.col(lo)) / F.lit(step)), F.lit(1)).cast("int")

    b = boxes.select("*", F.explode(F.sequence(F.lit(0), n("min_lat", "max_lat", lat_step) - 1)).alias("i"))
    b = b.select("*", F.explode(F.sequence(F.lit(0), n("min_lng", "max_lng", lng_step) - 1)).alias("j"))
    lat0 = F.col("min_lat") + F.col("i").cast("double") * F.lit(lat_step)
    lng0 = F.col("min_lng") + F.col("j").cast("double") * F.lit(lng_step)
    return b.select("activity_id", "i", "j", lat0.alias("south"), lng0.alias("west"),
                    F.least(lat0 + F.lit(lat_step), F.col("max_lat")).alias("north"),
                    F.least(lng0 + F.lit(lng_step), F.col("max_lng")).alias("east"))


# --- U3: elements fetched per tile, concatenated ----------------------------------------------

def elements_in_tiles(tile_df: DataFrame, way_bounds: DataFrame, cell: float = 0.1, among: DataFrame | None = None) -> DataFrame:
    """Ways whose bounding box meets each tile, concatenated over tiles; a way met by two tiles is kept once.

    Tiles and way boxes are both exploded to a global ``cell`` grid and meet by
    an equi-join on the cell; the exact overlap test runs on those candidates.
    With ``among`` (activity_id, way_id) only those pairs are tested.
    """
    t = _explode_cells(tile_df.select("activity_id", "south", "west", "north", "east"),
                       ["activity_id", "south", "west", "north", "east"], F.col("west"), F.col("south"),
                       F.col("east"), F.col("north"), cell, 0)
    w = _explode_cells(way_bounds, ["way_id", "min_lat", "max_lat", "min_lng", "max_lng"], F.col("min_lng"),
                       F.col("min_lat"), F.col("max_lng"), F.col("max_lat"), cell, 0)
    on = ["cx", "cy"]
    if among is not None:
        w, on = w.join(among.select("activity_id", "way_id").distinct(), "way_id"), [*on, "activity_id"]
    hits = t.join(w, on).where((F.col("min_lat") <= F.col("north")) & (F.col("max_lat") >= F.col("south"))
                                         & (F.col("min_lng") <= F.col("east")) & (F.col("max_lng") >= F.col("west")))
    return hits.select("activity_id", "way_id").dropDuplicates(["activity_id", "way_id"])


# --- A15: null counts of the enrichment ---------------------------------------------------------

def enrichment_null_counts(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("activity_id").agg(
        F.count_if(F.col("highway").isNull()).alias("missing_highway"),
        F.count_if(F.col("surface").isNull()).alias("missing_surface"),
        F.count(F.lit(1)).alias("n_segments"))


def grid_cell_size_for(span_deg: float, target_cells: int = 4096) -> float:
    return max(span_deg / math.sqrt(target_cells), 1e-4)
