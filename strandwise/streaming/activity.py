"""The activity log and FASTA files as streams: windowed counts with late data, sessions, and incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.formats import read_fasta

ACTIVITY = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def activity_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of a folder, as they come."""
    return spark.readStream.schema(ACTIVITY).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, tool, n_events, total): tumbling windows; on a stream, events later than `late` are left out and a window
    is given once it is past."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", size), F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "tool", "n_events", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(actor, session_start, session_end, n_events): bursts of one actor's events less than the gap apart."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return g.select(F.col("user_id").alias("actor"), F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events")


def ingest_fasta(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Reads the FASTA files of a folder that have not been read yet into the Parquet table `out`, then stops.

    Each batch parses whole files and is committed at once, so a lost or repeated batch leaves neither part files nor repeats.
    """
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def batch(df: DataFrame, number: int) -> None:
        records = read_fasta(df.select(F.xxhash64("path").alias("file_id"), "text"))
        records.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
