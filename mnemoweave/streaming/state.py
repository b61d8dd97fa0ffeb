"""The memory log and session contexts as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserts(log: DataFrame, watermark: str | None = None) -> DataFrame:
    """The latest active write by key of a stream of (mem_key, seq, ts, action, ...)."""
    stream = log if watermark is None else log.withWatermark("event_time", watermark)
    last = F.max_by(F.struct("action", "kind", "trust", "strength", "ts"), "seq").alias("m")
    return stream.groupBy("mem_key").agg(last).select("mem_key", "m.*")


def session_contexts(turns: DataFrame) -> DataFrame:
    """The entities of the latest turn by session."""
    return turns.groupBy("session_id").agg(F.max_by("entities", "turn").alias("entities"))


def drain(stream: DataFrame, key: str, folder: str) -> DataFrame:
    """Runs an aggregation by ``key`` to the end of what is there; returns its result.

    Each micro-batch writes the groups that it changed under ``folder``, which the
    driver and all executors share; a batch that runs again replaces its part.
    The last part that has a key tells its group.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    q = stream.writeStream.foreachBatch(write).outputMode("update").trigger(availableNow=True)
    q.option("checkpointLocation", f"{folder}/log").start().awaitTermination()
    spark, rest = stream.sparkSession, [c for c in stream.columns if c != key]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/parts")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    parts = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/parts")
    return parts.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("m")).select(key, "m.*")


def ingest_batches(docs: DataFrame, write, checkpoint: str):
    """Feeds micro-batches of documents to ``write(batch, id)``."""
    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
