"""Operator 2: embedding near-duplicates by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard
transform; its hash is the coordinate axis (with sign) nearest to it. ``k``
such hashes form a bucket code, and there are several tables of codes. Each
vector is indexed under its own code and asked for under the codes that follow
when one hash falls to its second-best axis (multiprobe). Inside a bucket all
cosines are computed in double precision, so no pair below the threshold is
ever linked. The number of hashes grows with the logarithm of the table's rows
and the number of tables makes up for the smaller chance of meeting.

Equal vectors are one class from the start. A pair that meets in several
tables counts in the first one only, which both codes lists tell without any
exchange; buckets report, for each vector, how many new links it has there and
one spanning edge, never pairs. Buckets over ``CHUNK`` vectors are cut into
chunks and every two chunks meet in a task of their own.

Cases: vectors that are null, zero or hold null or non-finite components link
with nothing; vectors of different lengths never link; repeated ``vec_id`` rows
are rows of their own in the counts; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.components import components
from segspark.llm.shared import materialise, shuffle_partitions

CHUNK = 2048
AXES_PER_HASH = 128


def plan(n: int) -> tuple[int, int]:
    """(hashes a code, tables) for ``n`` vectors: about 32 vectors a bucket, 0.75 ** k chance to meet a link in a table."""
    k = max(1, math.ceil(math.log(max(n / 32, 1)) / math.log(AXES_PER_HASH)))
    return k, math.ceil(4 / 0.75 ** k)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis (a power of two long)."""
    h, n = 1, x.shape[-1]
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x


def codes(x: np.ndarray, k: int, tables: int, seed: int = 5) -> np.ndarray:
    """rows x tables x (1 + k) bucket codes: the own one, then one per hash fallen to its second-best axis."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    signs = np.random.default_rng(seed + wide).choice([-1.0, 1.0], (3, tables * k, wide))
    y = np.zeros((n, tables * k, wide))
    y[:, :, :d] = x[:, None, :]
    for s in signs:
        y = hadamard(y * s)
    size = np.abs(y)
    axes = np.argpartition(size, wide - 2, axis=-1)[..., wide - 2:]
    two = np.take_along_axis(size, axes, -1)
    axes = np.where((two[..., 0] > two[..., 1])[..., None], axes, axes[..., ::-1])  # best, second best
    axes = axes + wide * (np.take_along_axis(y, axes, -1) < 0)
    axes = axes.reshape(n, tables, k, 2).astype(np.int64)
    place = (2 * wide) ** np.arange(k, dtype=np.int64)
    own = (axes[..., 0] * place).sum(-1)
    out = np.empty((n, tables, 1 + k), np.int64)
    out[..., 0] = own
    for f in range(k):
        out[..., 1 + f] = own + (axes[:, :, f, 1] - axes[:, :, f, 0]) * place[f]
    return out % (2 ** 31 - 1)


def _members(classes: DataFrame, k: int, tables: int) -> DataFrame:
    """Rows (bucket, own, rep, n, vec, codes): every class under its own and probe codes of every table."""
    def run(batches):
        for b in batches:
            reps, counts = b.column("rep").to_numpy(), b.column("n").to_numpy()
            lists = b.column("embedding")
            lengths = lists.value_lengths().to_numpy()
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                for part in np.array_split(at, -(-len(at) // 512)):
                    x = np.stack([lists[int(i)].values.to_numpy(zero_copy_only=False) for i in part]).astype(np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                    c = codes(x, k, tables)
                    m = len(part)
                    bucket = (c + np.arange(tables)[None, :, None] * (2 ** 31)) * 64 + min(int(d), 63)
                    own = np.zeros(c.shape, bool)
                    own[..., 0] = True
                    row = np.repeat(np.arange(m), tables * (1 + k))
                    code_bytes = pa.array([r.astype("<i4").tobytes() for r in c], pa.binary())
                    vec = pa.array([r.tobytes() for r in x], pa.binary())
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket.reshape(-1)), pa.array(own.reshape(-1)), pa.array(reps[part][row]), pa.array(counts[part][row]),
                         vec.take(take), code_bytes.take(take)], ["bucket", "own", "rep", "n", "vec", "codes"])

    return classes.mapInArrow(run, "bucket long, own boolean, rep long, n long, vec binary, codes binary")


def _bucket_links(k: int, tables: int, threshold: float):
    """Links of the units (bucket, i, j) of one task: rows (rep, n_links, edge)."""
    def inside(bucket, side, own, rep, count, vec, code):
        t = int(bucket // 64 // 2 ** 31)
        order = np.argsort(rep, kind="stable")
        side, own, rep, count, vec, code = side[order], own[order], rep[order], count[order], vec[order], code[order]
        dot = vec @ vec.T
        meet = own[:, None] | own[None, :]  # probes only look at what is indexed
        a, b = np.nonzero(np.triu((dot >= threshold) & meet & (rep[:, None] != rep[None, :]), 1))
        two = (side[a] == 3) | (side[b] == 3) | (side[a] != side[b])  # chunks i and j, not inside one of them
        a, b = a[two], b[two]
        if not len(a):
            return None
        ca, cb = code[a], code[b]
        fresh = np.ones(len(a), bool)
        for s in range(t):  # met in an earlier table
            fresh &= ~((ca[:, s, :1] == cb[:, s, :]).any(1) | (cb[:, s, :1] == ca[:, s, :]).any(1))
        # of two buckets of this table where both meet, the one of the smaller id counts
        here = bucket // 64 % 2 ** 31
        fresh &= (ca[:, t, 0] == here) | ~(ca[:, t, :1] == cb[:, t, :]).any(1)
        a, b = a[fresh], b[fresh]
        links = np.bincount(a, count[b], len(rep)) + np.bincount(b, count[a], len(rep))
        root = np.arange(len(rep))
        while True:  # smallest index in each component of this unit
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        hit = np.flatnonzero(links)
        return rep[hit], links[hit].astype(np.int64), rep[root[hit]]

    def run(table: pa.Table) -> pa.Table:
        got = []
        if table.num_rows:
            t = table.combine_chunks()
            unit = np.stack([t.column(c).to_numpy() for c in ("bucket", "i", "j")])
            order = np.lexsort(unit[::-1])
            cut = np.flatnonzero(np.any(np.diff(unit[:, order], axis=1) != 0, axis=0)) + 1
            side, own, rep, n = (t.column(c).to_numpy() for c in ("side", "own", "rep", "n"))
            vec, code = t.column("vec"), t.column("codes")
            size = pc.binary_length(vec).to_numpy()
            # lengths above 62 share a bucket; they are told apart here
            for g in [g[size[g] == d] for g in np.split(order, cut) for d in np.unique(size[g])]:
                if len(g) < 2 or not own[g].any():
                    continue
                at = pa.array(g)
                x = np.frombuffer(b"".join(vec.take(at).to_pylist()), np.float64).reshape(len(g), -1)
                c = np.frombuffer(b"".join(code.take(at).to_pylist()), "<i4").reshape(len(g), tables, 1 + k)
                # a class may stand in a bucket under its own code and a probe: keep the own one
                first = np.unique(rep[g][np.argsort(~own[g], kind="stable")], return_index=True)[1]
                keep = np.argsort(~own[g], kind="stable")[first]
                g, x, c = g[keep], x[keep], c[keep]
                found = inside(unit[0, g[0]], side[g], own[g], rep[g], n[g], x, c)
                if found:
                    got.append(found)
        cols = [np.concatenate(c) for c in zip(*got)] if got else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["rep", "n_links", "edge"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    v = vectors.select("vec_id", "embedding")
    big = F.lit(float("inf"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != big)) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("_ok", F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull())
    classes = materialise(v.where("_ok").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vectors")
    k, tables = plan(classes.count())
    members = _members(classes, k, tables)
    # buckets above CHUNK are few; they are cut into chunks, and every two chunks are a unit
    hot = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > CHUNK).select(
        "bucket", F.ceil(F.col("_m") / CHUNK).cast("int").alias("_chunks"))
    hot = materialise(hot, "hot-buckets")
    bins = shuffle_partitions(spark) * 4
    if hot.isEmpty():
        units = members.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(3).alias("side"))
    else:
        m = members.join(hot, "bucket", "left").withColumn("_c", F.when(
            F.col("_chunks").isNotNull(), F.pmod(F.xxhash64("rep"), F.col("_chunks")).cast("int")).otherwise(0))
        other = F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1))
        m = m.withColumn("_o", other)
        units = m.select(*members.columns, F.least("_c", "_o").alias("i"), F.greatest("_c", "_o").alias("j"),
                         F.when(F.col("_c") == F.col("_o"), 3).when(F.col("_c") < F.col("_o"), 1).otherwise(2).alias("side"))
    linked = materialise(units.withColumn("_bin", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(bins)))
                         .groupBy("_bin").applyInArrow(_bucket_links(k, tables, threshold), "rep long, n_links long, edge long"), "vector-links")
    counts = linked.groupBy("rep").agg(F.sum("n_links").alias("_links"))
    comp = components(linked.select(F.col("rep").alias("a"), F.col("edge").alias("b")))
    per_class = (classes.join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                 .select("embedding", (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("_links"),
                         F.coalesce("component", "rep").alias("_component")))
    out = v.where("_ok").join(per_class, "embedding").select("vec_id", F.col("_links").alias("n_links"), F.col("_component").alias("component_id"))
    alone = v.where("NOT _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
