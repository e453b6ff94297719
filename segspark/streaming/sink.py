"""A keyed topic as an idempotent streaming sink: staged rows, one commit an epoch.

A micro-batch writes its rows below its epoch's folder, by topic partition
(crc32 of the key, so a key's messages stay together); then one small file
publishes the epoch. Rows are in the topic once their epoch is published. A
replayed epoch that was published is left as it is; one that failed before
that is written over, and what it had staged is never read. On a cluster with
the Kafka package the same frame goes to ``format("kafka")`` instead
(``kafka_sink``; not run here, there is no broker).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "key string, value string, partition int, epoch long"


def topic_sink(path: str, partitions: int = 8):
    """foreachBatch sink of (key, value) rows."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = spark.createDataFrame([(batch_id,)], "epoch long").coalesce(1)
        if batch_id in published(spark, path):
            return
        part = F.pmod(F.crc32(F.coalesce("key", F.lit("")).cast("binary")), F.lit(partitions)).cast("int")
        rows = batch.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), part.alias("partition"))
        rows.repartition(partitions, "partition").write.mode("overwrite").partitionBy("partition").json(f"{path}/rows/epoch={batch_id}")
        done.write.mode("overwrite").json(f"{path}/epochs/{batch_id}")
    return sink


def published(spark: SparkSession, path: str) -> set[int]:
    """Epochs of the topic, a small number each."""
    from pyspark.errors import AnalysisException
    try:
        return {r["epoch"] for r in spark.read.schema("epoch long").json(f"{path}/epochs/*").collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    """key, value, partition and epoch of every published row."""
    epochs = sorted(published(spark, path))
    rows = spark.read.schema(ROWS).option("basePath", f"{path}/rows")
    return rows.json([f"{path}/rows/epoch={e}" for e in epochs]) if epochs else spark.createDataFrame([], ROWS)


def kafka_sink(stream: DataFrame, servers: str, topic: str, checkpoint: str):
    """S10 with a broker: the same (key, value) rows to a topic, at least once. Needs the Kafka package; not run here."""
    return (stream.selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value").writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start())
