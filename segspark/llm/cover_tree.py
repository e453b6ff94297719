"""Operator 12: hard-negative mining with cover trees over norm-augmented vectors.

A component x becomes ``floor(scale * x)``; a row's score for an anchor is the
whole-number inner product. With one more component ``sqrt(M^2 - |x|^2)`` all
candidates lie on a sphere of radius M, the largest norm, and an anchor q keeps
its inner products by a zero there. A node of the tree has a centre c and the
angle f that covers all its points, so with the angle t between q and c every
inner product below the node lies within ``|q| M cos(t - f)`` and
``|q| M cos(t + f)``.

The first level are pivots, taken by farthest-first traversal of a bounded
sample (``MAX_SAMPLE`` rows); every row of the table goes to its nearest pivot,
whose covering angle is taken over all its rows. Cells above ``CELL`` rows are
cut by hash, and every piece has a tree of its own of ``LEVELS`` levels. A
search visits the pivot with the best bound first, which gives each query the
score it has to beat, then the pivots whose bounds still reach its window; in a
tree it goes down level by level past the nodes outside the window, and reads
the leaves that are left in the order of their bounds, the best first, with
exact whole numbers. Bounds carry slack for rounding, so nothing is lost.

Queries and rows meet by (pivot, piece); a pivot that many queries visit splits
its queries too, so a task holds ``CELL`` rows and ``QUERIES`` queries at most.
No row is paired with another outside these tasks, and at most k rows for each
query and cell leave one. Only the sample's pivots and their angles are broadcast.

Positives are the first ``n_pos`` other rows of the anchor's label by score,
then smaller ``vec_id``; a positive's negatives are the first ``n_neg`` rows of
other labels with ``low * positive <= 100 * negative <= 100 * positive``.

Cases: rows with a null ``vec_id``, label or vector, or with a null or
non-finite component, take no part; scaled components are held within
``+-2**26``, so that scores are exact in 64 bits; vectors of different lengths
do not meet; zero vectors score 0; rows of one ``vec_id`` are rows of their own,
ties between them are broken by their place in the table; an anchor without
positives and a positive without negatives give no rows, nor does an empty
table; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.llm.sampling import by_hash
from segspark.llm.shared import materialise

MAX_SAMPLE, MAX_PIVOTS = 4096, 1024
CELL, QUERIES = 8192, 512
LEVELS = (1, 4, 16, 64)
WAVES = ((0, 1), (1, 4), (4, 16), (16, 1 << 30))  # leaves read together, by the order of their bounds
SLICE = 1024
HOLD = 1 << 26
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
QUERY = "anchor long, pos int, label long, vec binary, low long, high long"
FOUND = "anchor long, pos int, row long, vec_id long, score long"


def bounds(dot: np.ndarray, reach: np.ndarray, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest inner product inside nodes, from those with the centres, |q| M and the cosines of the covering angles."""
    c = np.clip(dot / np.maximum(reach, 1e-300), -1, 1)
    cover = np.clip(cover, -1, 1)
    s, t = np.sqrt(1 - c * c), np.sqrt(1 - cover * cover)
    slack = 1e-6 * reach + 1
    return np.where(c >= cover, 1, c * cover + s * t) * reach + slack, np.where(c <= -cover, -1, c * cover - s * t) * reach - slack


def augmented(x: np.ndarray, m: float) -> np.ndarray:
    """Rows of ``x`` on the sphere of radius ``m``."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(m * m - (x * x).sum(axis=1), 0))])


def spread(points: np.ndarray, m: float, most: int, sizes: tuple[int, ...] = ()) -> tuple[list[int], list[np.ndarray]]:
    """Farthest-first centres (at most ``most``) and, when there are ``sizes`` of them and at the end, each point's nearest one."""
    centres, seen = [0], []
    near, owner = points @ points[0], np.zeros(len(points), np.int64)
    while True:
        if len(centres) in sizes:
            seen.append(owner.copy())
        far = int(near.argmin())
        if len(centres) >= most or near[far] >= m * m * (1 - 1e-12):
            break
        dot = points @ points[far]
        closer = dot > near
        closer[far] = True
        owner[closer], near[closer] = len(centres), dot[closer]
        centres.append(far)
    if len(centres) not in sizes:
        seen.append(owner)
    return centres, seen


class CoverTree:
    """Rows of one piece of a cell: whole-number vectors, ids, row numbers and labels."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
        order = np.lexsort((rows, ids))  # inside a leaf the first of equal scores is the one that counts
        x, ids, rows, labels = x[order], ids[order], rows[order], labels[order]
        self.m = max(1.0, float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0))))
        points = augmented(x, self.m)
        centres, seen = spread(points, self.m, LEVELS[-1], LEVELS)
        counts = [min(n, len(centres)) for n in LEVELS[:len(seen)]]
        counts[-1] = len(centres)
        at = np.array(centres)
        leaf = seen[-1]
        order = np.argsort(leaf, kind="stable")
        self.x, self.ids, self.rows, self.labels = x[order], ids[order], rows[order], labels[order]
        self.first = np.searchsorted(leaf[order], np.arange(len(centres) + 1))
        self.centres = x[at].astype(np.float64)
        above = leaf
        self.levels = []  # (centres, parent of each in the level before, cosine of its covering angle), root first
        for k in range(len(counts) - 1, -1, -1):
            cover = np.full(counts[k], 1.0)
            np.minimum.at(cover, above, np.einsum("ij,ij->i", points, points[at[above]]) / (self.m * self.m))
            parent = np.arange(counts[k])
            if k:
                late = parent >= counts[k - 1]
                parent[late] = seen[k - 1][at[:counts[k]][late]]
                above = parent[above]
            self.levels.insert(0, (counts[k], parent, cover))
        most = float(np.abs(x).max(initial=0))
        self.exact = most * most * max(1, x.shape[1]) < 2 ** 52  # products add up without rounding in doubles
        self.most = most
        self.values = self.x.astype(np.float64) if self.exact else self.x

    def scores(self, q: np.ndarray, a: int, b: int) -> np.ndarray:
        """Inner products of the rows of ``q`` with the points a .. b - 1."""
        if self.exact and float(np.abs(q).max(initial=0)) * self.most * max(1, q.shape[1]) < 2 ** 52:
            return (q.astype(np.float64) @ self.values[a:b].T).astype(np.int64)
        return q @ self.x[a:b].T

    def search(self, q: np.ndarray, of: np.ndarray, labels: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray,
               k: int, same: bool):
        """First ``k`` points of each query by score, then id, with ``low <= score <= high`` and the label's equality ``same``.

        ``q`` are distinct vectors, ``of`` each query's one, ``own`` the row a query is itself. Returns queries x k
        scores (``NONE`` where there are fewer), ids and rows.
        """
        n = len(of)
        best = np.full((n, k), NONE), np.full((n, k), LAST), np.full((n, k), LAST)
        least = low.copy()
        reach = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * self.m
        dots = q.astype(np.float64) @ self.centres.T
        alive = np.ones((n, 1), bool)
        for count, parent, cover in self.levels:
            up, down = bounds(dots[:, :count], reach[:, None], cover[None, :])
            alive = alive[:, parent] & (up[of] >= least[:, None]) & (down[of] <= high[:, None])
        place = np.argsort(np.argsort(-up, axis=1, kind="stable"), axis=1, kind="stable")
        self.read = 0
        for first, end in WAVES:
            due = alive & (place[of] >= first) & (place[of] < end) & (up[of] >= least[:, None])
            for node in np.flatnonzero(due.any(axis=0)):
                for a in range(self.first[node], self.first[node + 1], SLICE):
                    b = min(a + SLICE, self.first[node + 1])
                    mine = np.flatnonzero(due[:, node] & (up[of, node] >= least))
                    if len(mine):
                        self._leaf(q, of, labels, own, high, k, same, best, least, mine, a, b)
                        self.read += len(mine) * (b - a)
        return best

    def _leaf(self, q, of, labels, own, high, k, same, best, least, mine, a, b) -> None:
        vectors, back = np.unique(of[mine], return_inverse=True)
        s = self.scores(q[vectors], a, b)[back]
        fits = (self.labels[None, a:b] == labels[mine, None]) == same
        fits &= (s >= least[mine, None]) & (s <= high[mine, None]) & (self.rows[None, a:b] != own[mine, None])
        hit = np.flatnonzero(fits.any(axis=1))
        if not len(hit):
            return
        s, mine = np.where(fits[hit], s[hit], NONE), mine[hit]
        line = np.arange(len(hit))
        cols = [[c[mine]] for c in best]
        for _ in range(min(k, b - a)):
            j = s.argmax(axis=1)  # the first of equal scores: the smallest id
            got = s[line, j]
            some = got > NONE
            if not some.any():
                break
            for col, new, none in zip(cols, (got, self.ids[a + j], self.rows[a + j]), (NONE, LAST, LAST)):
                col.append(np.where(some, new, none)[:, None])
            s[line, j] = NONE
        score, ids, rows = (np.concatenate(c, axis=1) for c in cols)
        order = np.lexsort((rows, ids, np.where(score == NONE, LAST, -score)), axis=1)[:, :k]
        for col, new in zip(best, (score, ids, rows)):
            col[mine] = np.take_along_axis(new, order, axis=1)
        least[mine] = np.maximum(least[mine], best[0][mine, k - 1])


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), -1).astype(np.int64) if raw and raw[0] else np.zeros((len(raw), 0), np.int64)


def _numbers(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, vec (whole numbers) of the rows that take part."""
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    held = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(HOLD))), F.lit(float(-HOLD)))).cast("int"))
    return vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(good).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), held.alias("vec"))


def _to_cells(pivots: np.ndarray, m: float):
    """Rows with their number, cell (nearest pivot; -1 for another length) and the cosine of the angle to it."""
    around = augmented(pivots, m)

    def run(batches):
        for b in batches:
            vec = b.column("vec")
            size = vec.value_lengths().to_numpy()
            flat = vec.flatten().to_numpy()
            first = np.concatenate([[0], np.cumsum(size)])
            cell, cos = np.full(len(size), -1, np.int32), np.full(len(size), -1.0)
            mine = np.flatnonzero(size == pivots.shape[1])
            for at in np.array_split(mine, -(-len(mine) // 2048)) if len(mine) else []:
                x = flat[(first[at][:, None] + np.arange(pivots.shape[1])[None, :])]
                dot = augmented(x, m) @ around.T
                cell[at] = dot.argmax(axis=1)
                cos[at] = dot.max(axis=1) / (m * m)
            raw = [flat[a:z].astype("<i4").tobytes() for a, z in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("label"), pa.array(size, pa.int32()), pa.array(cell),
                                              pa.array(cos), pa.array(raw, pa.binary())],
                                             ["row", "vec_id", "label", "dim", "cell", "cos", "vec"])
    return run


CELLS = "row long, vec_id long, label long, dim int, cell int, cos double, vec binary"


def _visits(shared, first: bool):
    """A row for each pivot a query has to visit: the one with the best bound, or all others its window still reaches."""
    def run(batches):
        pivots, cover, m = shared.value
        for b in batches:
            row, cells = [], []
            vec, low, high = b.column("vec").to_pylist(), _numbers(b, "low"), _numbers(b, "high")
            size = np.array([len(v) // 4 for v in vec], np.int64)
            mine = np.flatnonzero(size == pivots.shape[1])
            other = np.flatnonzero(size != pivots.shape[1])
            if first:
                row.append(other)
                cells.append(np.full(len(other), -1))
            if len(mine):
                q = _vectors(b.column("vec").take(pa.array(mine))).astype(np.float64)
                reach = np.sqrt((q * q).sum(axis=1)) * m
                up, down = bounds(q @ pivots.T, reach[:, None], cover[None, :])
                best = up.argmax(axis=1)
                if first:
                    row.append(mine)
                    cells.append(best)
                else:
                    need = (up >= low[mine, None]) & (down <= high[mine, None])
                    need[np.arange(len(mine)), best] = False
                    i, j = np.nonzero(need)
                    row.append(mine[i])
                    cells.append(j)
            take = np.concatenate(row).astype(np.int64)
            out = b.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(size[take], pa.int32()), pa.array(np.concatenate(cells).astype(np.int32))],
                                             [*out.schema.names, "dim", "cell"])
    return run


def _meet(k: int, same: bool):
    """The tree of one piece of a cell, searched for the queries of one unit."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = [np.zeros(0, np.int64)] * 5
        if left.num_rows and right.num_rows:
            tree = CoverTree(_vectors(left.column("vec")), *(_numbers(left, c) for c in ("vec_id", "row", "label")))
            anchor = _numbers(right, "anchor")
            own, at, of = np.unique(anchor, return_index=True, return_inverse=True)
            q = _vectors(right.column("vec").take(pa.array(at)))
            score, ids, rows = tree.search(q, of, _numbers(right, "label"), anchor, _numbers(right, "low").copy(), _numbers(right, "high"), k, same)
            i, j = np.nonzero(score > NONE)
            cols = [anchor[i], _numbers(right, "pos")[i], rows[i, j], ids[i, j], score[i, j]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                        ["anchor", "pos", "row", "vec_id", "score"])
    return run


class Forest:
    """The table's rows in cells around pivots."""

    def __init__(self, vectors: DataFrame, scale: int = 256) -> None:
        self.spark = vectors.sparkSession
        rows = materialise(scaled(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
        square = F.aggregate("vec", F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v)
        n, most = rows.agg(F.count(F.lit(1)), F.max(square)).first()
        self.m = max(1.0, float(most or 0) ** 0.5)
        # at most MAX_SAMPLE rows, of which at most MAX_PIVOTS stay
        sample = [r["vec"] for r in by_hash(rows.select("row", "vec"), "row", MAX_SAMPLE, 5).collect()]
        sizes = [len(v) for v in sample]
        dim = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 0
        same = [v for v in sample if len(v) == dim]
        x = np.array(same, np.int64).reshape(len(same), dim)
        if len(x):
            at, _ = spread(augmented(x, self.m), self.m, min(MAX_PIVOTS, -(-n // CELL)))
            x = x[at]
        self.pivots = x.astype(np.float64)
        self.rows = materialise(rows.mapInArrow(_to_cells(self.pivots, self.m), CELLS), "vector-cells")
        self.cells = materialise(self.rows.groupBy("dim", "cell").agg(
            F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("pieces"), F.min("cos").alias("cos")), "cells")
        cover = np.full(len(x), 1.0)
        for r in self.cells.where("cell >= 0").select("cell", "cos").collect():  # at most MAX_PIVOTS rows
            cover[r["cell"]] = r["cos"]
        self.shared = self.spark.sparkContext.broadcast((self.pivots, cover, self.m))  # MAX_PIVOTS vectors

    def _round(self, queries: DataFrame, k: int, same: bool, first: bool) -> DataFrame:
        visits = materialise(queries.mapInArrow(_visits(self.shared, first), f"{QUERY}, dim int, cell int"), "visits")
        asked = visits.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("lots"))
        cells = self.cells.drop("cos").join(asked, ["dim", "cell"])
        unit = ["dim", "cell", "piece", "lot"]
        rows = self.rows.drop("cos").join(cells, ["dim", "cell"]).withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int"))
        rows = rows.select(*unit[:3], F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "row", "vec_id", "label", "vec")
        asking = visits.join(cells, ["dim", "cell"]).withColumn("lot", F.pmod(F.xxhash64("anchor"), F.col("lots")).cast("int"))
        asking = asking.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "lot",
                               "anchor", "pos", "label", "vec", "low", "high")
        return rows.groupBy(*unit).cogroup(asking.groupBy(*unit)).applyInArrow(_meet(k, same), FOUND)

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """First ``k`` rows of every query (``QUERY``) over all rows: ``FOUND`` and ``rank``."""
        order = Window.partitionBy("anchor", "pos").orderBy(F.desc("score"), "vec_id", "row")
        found = [materialise(self._round(queries, k, same, True), "found")]
        if len(self.pivots) > 1:
            # a query with k rows only needs what reaches the last of them
            beat = (found[0].withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k)
                    .select("anchor", "pos", F.col("score").alias("_beat")))
            rest = queries.join(beat, ["anchor", "pos"], "left").withColumn("low", F.greatest("low", "_beat"))
            found.append(self._round(rest.select(*queries.columns), k, same, False))
        every = reduce(DataFrame.unionByName, found)
        return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def release(self) -> None:
        """Drop the broadcast; results must have been written before."""
        self.shared.destroy()


def hard_negatives(vectors: DataFrame, anchors: Column, n_pos: int = 5, n_neg: int = 5, low: int = 80, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors``: vec_id, label, embedding; ``anchors`` is a condition on vec_id.
    """
    if not (0 <= low <= 100 and n_pos > 0 and n_neg > 0):
        raise ValueError("low must lie in 0..100, n_pos and n_neg above 0")
    forest = Forest(vectors, scale)
    chosen = forest.rows.where(anchors)
    every = chosen.select(F.col("row").alias("anchor"), F.lit(0).alias("pos"), "label", "vec",
                          F.lit(int(NONE) + 1).alias("low"), F.lit(int(LAST)).alias("high"))
    positives = materialise(forest.search(every, n_pos, True), "positives")
    # a negative score leaves no window
    windows = positives.where("score >= 0").select("anchor", F.col("rank").alias("pos"), F.expr(f"({low} * score + 99) div 100").alias("low"),
                                                   F.col("score").alias("high"))
    queries = windows.join(chosen.select(F.col("row").alias("anchor"), "label", "vec", F.col("vec_id").alias("_id")), "anchor")
    queries = materialise(queries.select("anchor", "pos", "label", "vec", "low", "high", "_id"), "windows")
    found = materialise(forest.search(queries.drop("_id"), n_neg, False), "negatives")
    forest.release()
    named = positives.select("anchor", F.col("rank").alias("pos"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (found.select("anchor", "pos", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(named, ["anchor", "pos"]).join(queries.select("anchor", "pos", F.col("_id").alias("anchor_id")), ["anchor", "pos"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
