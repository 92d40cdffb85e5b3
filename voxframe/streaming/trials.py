"""Structured Streaming over a trial log (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def trial_stream(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(trials: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Trials and their mean value for each window and condition; what comes later than `late` is left out."""
    rows = trials.withWatermark("ts", late) if trials.isStreaming else trials
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")


def once_per_trial(trials: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first arrival of each event; repeats within the watermark are dropped."""
    return trials.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if trials.isStreaming else trials.dropDuplicates(["event_id"])


def journal(trials: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends records to a folder. A batch that runs again overwrites its own part, so records appear once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return trials.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
