"""Exposure counters over a stream of events: watermarked windows, and running totals per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of event files; event times become zoned for the watermark."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream watches a folder
        reader, path = reader.option("pathGlobFilter", at.getName()), str(at.getParent())
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and clicks per type and window; a window closes when the watermark has passed it, so state is bounded."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "value")
    )


def running_totals(events: DataFrame) -> DataFrame:
    """Events per user and type so far (update mode); sums are pre-aggregated before the exchange."""
    return events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


def drain(stream: DataFrame, checkpoint: str, path: str, mode: str = "complete") -> None:
    """Run all that is there, then stop. Each batch's result replaces the table at ``path`` (complete mode) or is added to it; no row
    passes through the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
