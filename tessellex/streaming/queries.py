"""Structured Streaming forms of stateful steps, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums for each event type and window; a window ends when the watermark passes it."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("begins"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a gap."""
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")


def first_titles(rows: DataFrame, title: str, late_column: str, late: str = "1 hour") -> DataFrame:
    """Each title once, as it first comes, with state kept for as long as the watermark asks."""
    return rows.withColumn(late_column, F.col(late_column).cast("timestamp")).withWatermark(late_column, late).dropDuplicatesWithinWatermark([title])


def read_folder(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, some at a time."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def upsert_vectors(path: str, encode):
    """A batch function that appends vectors of ids that the table at path lacks; for foreachBatch."""

    def step(batch: DataFrame, _: int) -> None:
        from ..sources.scans import stored_vectors

        stored_vectors(batch.sparkSession, path, batch.dropDuplicates(["id"]), encode)

    return step


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now through the stream, into Parquet files under ``path``; resumes from its checkpoint.

    In append mode files grow by what is new, each batch once. In complete mode the table is that of the last batch, a folder for each.
    """
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(path)
    last = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[:] = [number]

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/batch={last[0]}") if last else stream.sparkSession.createDataFrame([], stream.schema)
