"""Keyed tables in a fixed number of hash buckets, replaced by key.

A version is a folder of Parquet files by bucket; the manifest says for every
bucket which version holds it now. Replacing the rows of some keys reads only
their buckets, leaves those keys out, adds the new rows and writes the buckets
anew in a folder of their own; the new version counts once its manifest rows
are written, in one file. Readers see the old rows or the new ones, a failed
write leaves nothing but an unused folder, and the number of folders does not
grow with the keys. One writer at a time.

Rows that stay are never shuffled: each bucket leaves out its own replaced keys,
which are broadcast where they are few enough. ``gather=False`` writes new rows
where they lie, as up to one file a partition and bucket, which suits many rows;
otherwise they are shuffled into a few files a bucket.

A caller that repeats a write after a failure (a streaming batch) names the
version; a version that is in the manifest already is left as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.session import write_table

MANIFEST = "version long, bucket int, folder string, empty boolean, buckets int, schema string"
FILES_PER_BUCKET = 4
BROADCAST_KEYS = 1_000_000  # a bucket with more replaced keys than this meets them by a shuffle


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, tuple[str, bool]], int, str]:
    """(latest version, folder of each bucket, number of buckets, schema); one row a bucket and version is read."""
    latest = spark.read.schema(MANIFEST).json(f"{path}/manifest").groupBy("bucket").agg(
        F.max_by(F.struct("version", "folder", "empty", "buckets", "schema"), "version").alias("m")).collect()
    return (max(r.m.version for r in latest), {r.bucket: (r.m.folder, r.m.empty) for r in latest}, latest[0].m.buckets, latest[0].m.schema)


def _publish(spark: SparkSession, path: str, version: int, rows: list[tuple]) -> None:
    table = spark.createDataFrame([(version, *r) for r in rows], MANIFEST)
    table.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/v={version}")


def _write(rows: DataFrame, key: str, buckets: int, folder: str, gather: bool) -> None:
    """Write rows by bucket."""
    b = rows.withColumn("_bucket", _bucket(key, buckets))
    if gather:
        b = b.repartition(F.col("_bucket"), F.pmod(F.xxhash64(*rows.columns), F.lit(FILES_PER_BUCKET)))
    b.write.mode("overwrite").partitionBy("_bucket").parquet(folder)


def _written(spark: SparkSession, schema: T.StructType, folder: str) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(folder)


def _full(spark: SparkSession, schema: T.StructType, folder: str) -> set[int]:
    """The buckets that hold any row."""
    return {r["_bucket"] for r in _written(spark, schema, folder).select("_bucket").distinct().collect()}


def create(rows: DataFrame, path: str, key: str, buckets: int = 64, gather: bool = True) -> None:
    """A new table of ``rows``; null keys are a key of their own."""
    if key not in rows.columns or "_bucket" in rows.columns:
        raise ValueError("the key must be a column, and no column may be named _bucket")
    folder = f"{path}/data/v=0"
    _write(rows, key, buckets, folder, gather)
    full = _full(rows.sparkSession, rows.schema, folder)
    _publish(rows.sparkSession, path, 0, [(b, folder, b not in full, buckets, rows.schema.json()) for b in range(buckets)])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as its manifest has it."""
    import json
    _, folders, _, schema = _manifest(spark, path)
    kind = T.StructType.fromJson(json.loads(schema))
    files = [f"{folder}/_bucket={b}" for b, (folder, empty) in sorted(folders.items()) if not empty]
    return spark.read.schema(kind).parquet(*files) if files else spark.createDataFrame([], kind)


def replace(rows: DataFrame, path: str, key: str, keys: DataFrame | None = None, version: int | None = None,
            gather: bool = True) -> bool:
    """Put ``rows`` in place of everything the table has of ``keys`` (by default the keys of ``rows``).

    Returns whether anything was written. Rows of other keys than ``keys`` are refused.
    """
    spark = rows.sparkSession
    now, folders, buckets, schema = _manifest(spark, path)
    if version is not None and version <= now:
        return False
    version = now + 1 if version is None else version
    own = (rows if keys is None else keys).select(key).distinct().withColumn("_bucket", _bucket(key, buckets))
    own = write_table(own, "replaced-keys")  # read by the check, the counts and every bucket
    counts = {r["_bucket"]: r["count"] for r in own.groupBy("_bucket").count().collect()}  # at most ``buckets``
    touched = sorted(counts)
    folder = f"{path}/data/v={version}"
    _write(rows, key, buckets, folder, gather)
    # checked on what was written: nothing counts before it is published
    if keys is not None and not _written(spark, rows.schema, folder).where(F.col(key).isNotNull()).select(key).distinct().join(
            own, key, "left_anti").isEmpty():
        raise ValueError("rows of keys that are not replaced")
    if not touched:
        return False
    kept = None
    for b in touched:
        if folders[b][1]:
            continue
        gone = own.where(F.col("_bucket") == b).select(F.col(key).alias("_gone"))
        gone = F.broadcast(gone) if counts[b] <= BROADCAST_KEYS else gone
        held = spark.read.schema(rows.schema).parquet(f"{folders[b][0]}/_bucket={b}").join(
            gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti").withColumn("_bucket", F.lit(b))
        kept = held if kept is None else kept.unionByName(held)
    if kept is not None:
        kept.write.mode("append").partitionBy("_bucket").parquet(folder)
    full = _full(spark, rows.schema, folder)
    _publish(spark, path, version, [(b, folder, b not in full, buckets, schema) for b in touched])
    return True
