"""Bounded, deterministic training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: fold of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def by_hash(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``column``: the same ones in every run."""
    return df.orderBy(F.xxhash64(F.col(column), F.lit(seed)), column).limit(n)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of sampled ids. ``ids`` comes from ``by_hash``, so its number of rows is bounded and it may be broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
