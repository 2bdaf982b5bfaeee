"""The streaming operators run to the end of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from burstline.session import ensure_checkpoint_dir
from burstline.sources.tables import table
from burstline.streaming import flows


def _work_folder(spark) -> str:
    """A new folder inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def _run(spark, d, shape):
    at = _work_folder(spark)
    like = table(spark, d, "events")
    stream = flows.read_folder(spark, f"{d}/events.parquet*", like).withColumn("ts", F.col("ts").cast("timestamp"))
    out = shape(stream)
    flows.run_to_end(out, f"{at}/out", f"{at}/progress", "append")
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def stream_first_deliveries(spark, d):
    """Each event once, through the stream."""
    return _run(spark, d, lambda s: flows.first_deliveries(s, "event_id", "ts", "1 hour")).select("event_id", "user_id", "event_type")


def stream_window_counts(spark, d):
    """Events by two-hour window and type, of the windows that the watermark has closed."""
    return _run(spark, d, lambda s: flows.window_counts(s, "ts", ["event_type"], "2 hours", "0 seconds")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


QUERIES = {f.__name__: f for f in (stream_first_deliveries, stream_window_counts)}
SQL = {
    "stream_first_deliveries": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "stream_window_counts": "WITH e AS (SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, ts FROM events) SELECT start, event_type, count(*) AS n FROM e WHERE start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) GROUP BY ALL",
}
