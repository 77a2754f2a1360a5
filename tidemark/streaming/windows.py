"""The incremental form: file streams, watermarked windows, resumable loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A folder of Parquet files as a stream with a known schema."""
    return spark.readStream.schema(like.schema).parquet(folder)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Events and their values per window and type; the same on a batch frame."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_t", late)
    g = timed.groupBy(F.window("_t", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Sessions of users by a gap without events."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_t", late)
    g = timed.groupBy(F.session_window("_t", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def load_available(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Load what is there and stop; the checkpoint is the ledger of what is done."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
