"""Chunk progress as a stream: an extension; the service polls status documents instead."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnmill.operators import neardup, relational


def windowed_progress(events: DataFrame, late: str | None = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of events(ts, user_id, event_type) a job and window; later events than the watermark are dropped, none without one."""
    # A watermark needs an instant; a stream's local times are taken in the session's zone.
    dated = events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events
    dated = dated.withWatermark("ts", late) if late and events.isStreaming else dated
    return dated.groupBy(F.window("ts", width).alias("w"), F.col("user_id").alias("job_id")).agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("errors")
    ).select(F.col("w.start").alias("window_start"), "job_id", "events", "done", "errors")


def follow(spark: SparkSession, path: str, schema: StructType, folder: str | None = None, late: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """Reads the event files at `path` that were not read before as a stream, and returns the counts as they stand.

    Each micro-batch writes the windows that it changed under its number, so a batch that runs again after a failure
    replaces its own rows; a window's last update holds. With a `folder` of an earlier call, what has come since is added.
    Files come in any order, so there is no watermark, and the counts do not depend on how the files fall into batches;
    `late` sets one where events are known to come in order and the state of closed windows is to be dropped.
    """
    folder = folder or f"{neardup.stage_dir(spark)}/progress-{uuid.uuid4().hex}"

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/updates/batch={batch}")

    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    counts = windowed_progress(reader.parquet(path), late)
    run = counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    updates = spark.read.schema(counts.schema.add("batch", "long")).parquet(f"{folder}/updates")
    return relational.newest(updates, ["window_start", "job_id"], [-F.col("batch")]).drop("batch")
