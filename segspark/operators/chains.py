"""Orbits of a successor function by pointer doubling (used for Q5 at any key size).

A greedy fold such as "keep a request, skip everything within the TTL, keep
the next one" visits exactly the orbit ``s, f(s), f(f(s)), ...`` of the first
element ``s`` under a successor function ``f``. When ``f`` can be computed with
joins, the orbit follows from pointer doubling: with ``J_k = f^(2^k)``,

    O_0 = {s},  O_(k+1) = O_k  union  J_k(O_k),  J_(k+1) = J_k o J_k

so after ``ceil(log2(L))`` rounds of equi-joins on node ids the orbit of length
``L`` is complete. Every join is keyed by a unique node id, so no key is hot,
and no group is ever collected into one row. Each round's tables are
checkpointed into ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def orbit(succ: DataFrame, starts: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Nodes reachable from ``starts`` by repeatedly following ``succ``.

    ``succ``: (node BIGINT, nxt BIGINT); ``starts``: (node). Returns (node).
    Stops when no jump of the current length exists any more.
    """
    jump = succ.select("node", "nxt").where(F.col("nxt").isNotNull()).checkpoint()
    reached = starts.select("node").distinct().checkpoint()
    for done in range(max_rounds + 1):
        if jump.isEmpty():
            return reached
        if done == max_rounds:
            raise RuntimeError(f"orbits not complete after {max_rounds} rounds (cyclic successors?)")
        step = reached.join(jump, "node").select(F.col("nxt").alias("node"))
        reached = reached.unionByName(step).distinct().checkpoint()
        jump = (jump.alias("a").join(jump.alias("b"), F.col("a.nxt") == F.col("b.node"))
                .select(F.col("a.node").alias("node"), F.col("b.nxt").alias("nxt"))).checkpoint()
    return reached


def ttl_successor(requests: DataFrame, keys, ts_col: str, id_col: str, ttl_seconds: int) -> DataFrame:
    """For each request, the first request of its key at or after ts + TTL (ties: smaller id).

    Time is cut into TTL-wide buckets. A request in bucket b looks for its
    successor first inside bucket b + 1 (an as-of merge of queries and requests
    within that bucket), then in the first non-empty bucket after it, read from
    a table with one row per non-empty bucket. No request is compared with all
    others of its key.
    """
    keys = list(keys)
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    ttl = F.lit(int(ttl_seconds) * 1_000_000)
    r = requests.select(*keys, F.col(id_col).alias("node"), us.alias("t")).withColumn("b", F.floor(F.col("t") / ttl))
    q = r.select(*keys, F.col("node").alias("q"), F.col("b").alias("rb"), (F.col("t") + ttl).alias("t"),
                 (F.col("b") + 1).alias("b"))
    # frames run from the last row towards the first: a frame open at its end is recomputed for every row
    w = Window.partitionBy(*keys, "b").orderBy(F.desc("t"), F.desc("kind"), F.desc("node")).rowsBetween(Window.unboundedPreceding, 0)
    merged = (q.select(*keys, "b", "t", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("node"), "q", "rb")
              .unionByName(r.select(*keys, "b", "t", F.lit(1).alias("kind"), "node",
                                    F.lit(None).cast("bigint").alias("q"), F.lit(None).cast("bigint").alias("rb"))))
    hits = (merged.withColumn("hit", F.last(F.when(F.col("kind") == 1, F.col("node")), ignorenulls=True).over(w))
            .where(F.col("kind") == 0).select(*keys, "q", "rb", "b", "hit"))
    firsts = r.groupBy(*keys, "b").agg(F.min_by("node", F.struct("t", "node")).alias("first_node"))
    after = Window.partitionBy(*keys).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    nxt_bucket = firsts.withColumn("next_first", F.last("first_node", ignorenulls=True).over(after)).select(
        *keys, "b", "first_node", "next_first")
    own = nxt_bucket.select(*keys, F.col("b").alias("rb"), F.col("next_first").alias("after_own"))
    tgt = nxt_bucket.select(*keys, "b", F.col("first_node").alias("tgt_first"), F.col("next_first").alias("after_tgt"))
    j = hits.join(tgt, [*keys, "b"], "left").join(own, [*keys, "rb"], "left")
    nxt = F.coalesce("hit", F.when(F.col("tgt_first").isNotNull(), F.col("after_tgt")).otherwise(F.col("after_own")))
    return j.select(F.col("q").alias("node"), nxt.alias("nxt"))


def ttl_dedup_chain(requests: DataFrame, keys, ts_col: str, id_col: str, ttl_seconds: int = 300) -> DataFrame:
    """Q5 without collecting a key's history: kept requests = orbit of each key's first request."""
    succ = ttl_successor(requests, keys, ts_col, id_col, ttl_seconds)
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    first = (requests.groupBy(*keys).agg(F.min_by(F.col(id_col), F.struct(us, F.col(id_col))).alias("node"))
             .select("node"))
    kept = orbit(succ, first)
    return requests.join(kept.withColumnRenamed("node", id_col), id_col, "left_semi")


def ttl_dedup_any_size(requests: DataFrame, keys, ts_col: str, id_col: str, ttl_seconds: int = 300,
                       fold_limit: int = 100_000) -> DataFrame:
    """Q5 for any mix of keys: one row per key is folded up to ``fold_limit`` requests, larger keys go through the chain.

    The sizes come from a partially aggregated count; the large keys are at most one in ``fold_limit`` of the rows.
    Requests of one time are ordered by ``id_col`` in both ways; null keys are a key of their own.
    """
    from segspark.operators.cuts import ttl_dedup
    cols = requests.columns
    key = _unused(cols, "_key")
    # a struct, because nulls inside one are equal in joins
    r = requests.select(F.struct(*keys).alias(key), id_col, *[c for c in cols if c != id_col])
    large = r.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fold_limit).select(key).checkpoint()
    if large.isEmpty():
        return ttl_dedup(r, [key], ts_col, ttl_seconds).select(*cols)
    small = ttl_dedup(r.join(large, key, "left_anti"), [key], ts_col, ttl_seconds)
    chained = ttl_dedup_chain(r.join(large, key, "left_semi"), [key], ts_col, id_col, ttl_seconds)
    return small.select(*cols).unionByName(chained.select(*cols))


def _unused(columns: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name
