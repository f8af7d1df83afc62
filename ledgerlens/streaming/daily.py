"""Daily event metrics kept up to date from an append-only folder of files.

Late rows are accepted within the watermark.  Every micro-batch appends the
windows it changed under its batch id; the newest row of a window wins, so a
batch replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ledgerlens.functions.numbers import rounded


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def daily_events(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Count, value and approximate users per day and event type."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "event_type")
        .agg(F.count(F.lit(1)).alias("event_count"), F.sum("value").alias("total_value"), F.approx_count_distinct("user_id").alias("approx_users"))
        .select(F.col("window.start").cast("date").alias("metric_date"), "event_type", "event_count", "total_value", "approx_users")
    )


def run_available(metrics: DataFrame, output: str, checkpoint: str) -> None:
    """Process what has arrived, then stop."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    query = (
        metrics.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def current_metrics(spark: SparkSession, output: str) -> DataFrame:
    """Newest figures of every day and event type."""
    rows = spark.read.parquet(f"{output}/batch=*")
    newest = rows.groupBy("metric_date", "event_type").agg(
        F.max_by(F.struct("event_count", "total_value", "approx_users"), "batch_id").alias("r"))
    return newest.select("metric_date", "event_type", F.col("r.event_count").alias("event_count"),
                         rounded(F.col("r.total_value"), 4).alias("total_value"), F.col("r.approx_users").alias("approx_users"))
