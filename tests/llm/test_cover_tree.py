"""Hard negatives against brute force, with the defined edge cases."""

import numpy as np
from pyspark.sql import functions as F

from segspark.llm import cover_tree as C

SCHEMA = "vec_id long, label int, embedding array<float>, vec binary, row string, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, label, None if x is None else [None if v is None else float(v) for v in x], b"x", "y", 3)
                                  for i, label, x in rows], SCHEMA)


def vectors(seed=3, n=900, dim=12):
    g = np.random.default_rng(seed)
    centres = g.standard_normal((12, dim))
    x = centres[g.integers(0, 12, n)] + 0.4 * g.standard_normal((n, dim))
    x *= g.uniform(0.2, 2, (n, 1))
    x[n // 3:n // 2] = x[n // 3]  # copies
    x[n - 9] = 0
    label = np.where(g.random(n) < 0.4, 1, g.integers(0, 5, n))
    return [(i, int(label[i]), x[i].astype(np.float32)) for i in range(n)]


def brute(rows, every, n_pos=5, n_neg=5, low=80):
    good = [(i, label, [int(np.floor(256 * float(v))) for v in x], r) for r, (i, label, x) in enumerate(rows)
            if i is not None and label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for i, label, x, r in good:
        if i % every:
            continue
        score = sorted((-sum(a * b for a, b in zip(x, y)), j, s, lab) for j, lab, y, s in good if s != r and len(y) == len(x))
        for p, pid, _, _ in [s for s in score if s[3] == label][:n_pos]:
            rest = [s for s in score if s[3] != label and low * -p <= 100 * -s[0] <= 100 * -p][:n_neg]
            out += [(i, pid, k + 1, s[1], -p, -s[0]) for k, s in enumerate(rest)]
    return sorted(out)


def run(spark, rows, every, **how):
    return sorted(tuple(r) for r in C.hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, **how).collect())


def test_brute_force(spark, monkeypatch):
    rows = vectors()
    want = brute(rows, 20)
    assert len(want) > 300 and run(spark, rows, 20) == want
    # many small cells, pieces and lots
    for name, value in (("CELL", 64), ("QUERIES", 8)):
        monkeypatch.setattr(C, name, value)
    assert run(spark, rows, 20) == want


def test_edges(spark):
    rows = vectors(n=40)
    bad = [(100, 1, None), (200, None, [1.0] * 12), (None, 1, [1.0] * 12), (300, 1, [float("nan")] + [1.0] * 11), (400, 1, [float("inf")] * 12),
           (500, 1, [None] + [1.0] * 11), (600, 1, [1.0, 2.0]), (601, 2, [1.0, 1.5]), (602, 1, [0.5, 2.0]), (700, 3, []), (701, 3, []), (702, 4, []),
           (800, 9, [1.0] * 12), (20, 1, [0.1] * 12), (-20, 1, [0.1] * 12)]
    assert run(spark, rows + bad, 20) == brute(rows + bad, 20)
    assert run(spark, [], 20) == [] and run(spark, [(0, 1, [1.0])], 20) == []
    assert run(spark, [(0, 1, [1e30, -1e30]), (1, 1, [1e30, 0.0]), (2, 2, [1e30, 0.0])], 100) == [(0, 1, 1, 2, 2 ** 52, 2 ** 52)]


def test_bounds_skip_and_lose_nothing():
    """Every inner product lies within its nodes' bounds, and clustered rows are mostly skipped."""
    g = np.random.default_rng(1)
    centres = g.integers(-200, 200, (40, 16))
    x = (centres[g.integers(0, 40, 4000)] + g.integers(-9, 9, (4000, 16))).astype(np.int64)
    tree = C.CoverTree(x, np.arange(4000), np.arange(4000), np.zeros(4000, np.int64))
    q = x[::100]
    reach = np.sqrt((q.astype(float) ** 2).sum(axis=1)) * tree.m
    leaf = np.repeat(np.arange(len(tree.first) - 1), np.diff(tree.first))
    s = q @ tree.x.T
    for count, _, _ in tree.levels:
        assert count <= len(tree.centres)
    above = leaf
    for k in range(len(tree.levels) - 1, -1, -1):
        count, parent, cover = tree.levels[k]
        up, down = C.bounds(q.astype(float) @ tree.centres[:count].T, reach[:, None], cover[None, :])
        assert (s <= up[:, above]).all() and (s >= down[:, above]).all()
        above = parent[above]
    n = len(q)
    score, ids, _ = tree.search(q, np.arange(n), np.zeros(n, np.int64), np.full(n, -1), np.full(n, C.NONE + 1), np.full(n, C.LAST), 5, True)
    for i in range(n):
        want = sorted((-int(v), int(j)) for v, j in zip(s[i], tree.ids))[:5]
        assert [(-a, b) for a, b in zip(score[i].tolist(), ids[i].tolist())] == want
    assert tree.read < 0.25 * n * 4000
