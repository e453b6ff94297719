"""Operator 8: shards along a Hilbert curve through several metadata columns.

Each column is quantised to ``2**bits`` cells whose edges are quantiles of all
rows (of text columns the whole values at which the count of rows in their order
passes a cell's share), the cells' Hilbert index orders the rows, and runs of equal row counts are cut from that
order. Rows near each other in all columns share a shard, so a file's min/max
statistics prune on any of them.

Cases: null values fall below all others (first cell); ties on the index are
broken by id, size and checksum; repeated rows stay; an empty table gives no
rows; further columns pass through ``hilbert_index`` untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.llm.shared import materialise, shuffle_partitions, unused


def hilbert_codes(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (rows of ``cells``) in ``2**bits`` cells a dimension.

    The axes are turned level by level into the curve's transposed index
    (J. Skilling, "Programming the Hilbert curve", 2004), whose bits interleave.
    """
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for d in range(len(x)):
            upper = (x[d] & level) != 0
            swap = np.where(upper, 0, (x[0] ^ x[d]) & below)
            x[0] = np.where(upper, x[0] ^ below, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
        level >>= 1
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip = np.where((x[-1] & level) != 0, flip ^ (level - 1), flip)
        level >>= 1
    code = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            code = (code << 1) | (((x[d] ^ flip) >> b) & 1)
    return code


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType, T.TimestampType))


def text_edges(df: DataFrame, name: str, cells: int) -> list[str]:
    """Values of a text column, in order, at which the rows up to and with them pass a multiple of 1 / ``cells`` of all.

    Rows are counted by value first; the values are dealt by ranges and their counts summed range by range, so
    no task holds them all. At most ``cells`` - 1 values come back.
    """
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    part = F.spark_partition_id()
    dealt = materialise(counts.repartitionByRange(shuffle_partitions(df.sparkSession), "v").withColumn("p", part), "text-counts")
    sums = dealt.groupBy("p").agg(F.sum("n").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(  # a row a range
        Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = dealt.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    share = lambda rows: F.least(F.floor(rows * cells / total), F.lit(cells - 1))
    placed = dealt.join(sums.select("p", "before"), "p").select("v", "n", upto.alias("upto"))
    return sorted((r["v"] for r in placed.where(share(F.col("upto") - F.col("n")) < share(F.col("upto"))).select("v").collect()),
                  key=lambda v: v.encode())


def hilbert_index(df: DataFrame, dims: list[str], bits: int = 5, into: str = "hilbert") -> DataFrame:
    """``df`` with the Hilbert index of ``dims`` (at most ``62 // bits`` of them) in column ``into``."""
    if not dims or len(dims) * bits > 62:
        raise ValueError("dims * bits must lie in 1..62")
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [d for d in dims if _is_number(df, d)]
    cuts: dict[str, list] = {}
    if numbers:
        # at most 2**bits - 1 edges a column reach the driver, whatever the number of rows
        edges = df.agg(*[F.percentile_approx(F.col(d).cast("double"), shares, 10_000).alias(f"e{k}") for k, d in enumerate(numbers)]).first()
        cuts = {d: sorted(set(e or [])) for d, e in zip(numbers, edges)}
    cuts |= {d: text_edges(df, d, 1 << bits) for d in dims if d not in numbers}

    def cell(d: str) -> Column:
        value, kind = (F.col(d).cast("double"), "double") if d in numbers else (F.col(d).cast("string"), "string")
        edges = F.array(*[F.lit(e) for e in cuts[d]]).cast(f"array<{kind}>")
        return F.coalesce(F.size(F.filter(edges, lambda e: e <= value)), F.lit(0)) if cuts[d] else F.lit(0)

    @F.pandas_udf("long")
    def code(*columns: pd.Series) -> pd.Series:
        cells = np.stack([np.minimum(c.to_numpy(np.int64), (1 << bits) - 1) for c in columns], axis=1)
        return pd.Series(hilbert_codes(cells, bits))

    return df.withColumn(into, code(*[F.when(F.col(d).isNull(), 0).otherwise(cell(d)) for d in dims]))


def row_numbers(df: DataFrame, order: list[str], into: str = "row") -> DataFrame:
    """0-based position of every row in the total order of ``order``, without a one-task window.

    Rows are dealt by ranges, sorted and written; a row's place in its range is
    its own number, and a prefix sum over the ranges' counts (a row each) adds
    the rest. With equal keys on all of ``order`` the rows' order is arbitrary.
    """
    spark = df.sparkSession
    place, range_, base = unused([*df.columns, into], "_id", "_part", "_base")
    dealt = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    kept = materialise(dealt.withColumn(place, F.monotonically_increasing_id()), "row-numbers")
    part, at = F.shiftright(place, 33), F.col(place).bitwiseAND((1 << 33) - 1)
    counts = kept.groupBy(part.alias(range_)).agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select(range_, F.coalesce(F.sum("n").over(
        Window.orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base))
    return kept.withColumn(range_, part).join(bases, range_).withColumn(into, F.col(base) + at).drop(range_, base, place)


def hilbert_shards(df: DataFrame, dims: list[str], n_shards: int = 8, bits: int = 5, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``shard`` (0 .. n_shards - 1, counts at most one apart) and ``slot`` (gapless from 0) along the curve."""
    code, number = unused(df.columns, "_code", "_row")
    placed = row_numbers(hilbert_index(df, dims, bits, code), [code, *ties], number)
    n = df.count()
    small, wide = divmod(n, n_shards)  # the first `wide` shards take one row more
    edge = wide * (small + 1)
    row = F.col(number)
    in_wide = row < edge
    shard = F.when(in_wide, F.floor(row / (small + 1))).otherwise(wide + F.floor((row - edge) / max(small, 1)))
    slot = F.when(in_wide, row % (small + 1)).otherwise((row - edge) % max(small, 1))
    return placed.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")}).drop(code, number)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order: the files' statistics then cover a compact region of the curve."""
    (sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
