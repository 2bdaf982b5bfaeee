"""The streaming forms: counts by window with late rows dropped, removal of repeated deliveries, and a sink by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_folder(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, in the order in which they arrive."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_deliveries(stream: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """Each key once within the lateness; state is dropped behind the watermark."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, ts: str, by: list[str], length: str = "2 hours", lateness: str = "0 seconds") -> DataFrame:
    """(window start, by, n), each window given out once when the watermark passes its end; rows later than that are dropped.

    Spark moves the watermark between micro-batches, so a row that is late only within its own batch still counts.
    """
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, length).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is, written as Parquet with exactly-once progress in the checkpoint folder; then ends."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def by_day(stream: DataFrame, day: str, path: str, checkpoint: str) -> None:
    """Rows written into a folder a day."""
    query = stream.writeStream.format("parquet").partitionBy(day).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
