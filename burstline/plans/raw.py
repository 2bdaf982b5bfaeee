"""Queries over the raw deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.sources.raw_records import blocks, parse_records, parse_streams
from burstline.sources.tables import table


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_records(table(spark, d, "raw_lines"), "raw_id", "fmt", "content")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The records that are not valid, with the first reason."""
    return _parsed(spark, d).where(F.col("reason").isNotNull()).select("raw_id", "reason")


def p6_faults(spark: SparkSession, d: str) -> DataFrame:
    """The records that are not valid, with reason, detail and the place of a syntax error."""
    return _parsed(spark, d).where(F.col("reason").isNotNull()).select("raw_id", "reason", "detail", "error_at")


def p6_tweets(spark: SparkSession, d: str) -> DataFrame:
    """The valid records as tweets."""
    return _parsed(spark, d).where(F.col("reason").isNull()).select("raw_id", "id_str", "user_id_str", "created_at", "ts", "lang", "text")


def p6_streams(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries put together again and read as streams: after each error reading resumes at the next record start."""
    whole = blocks(table(spark, d, "raw_lines"), "file_name", "line_no", "fmt", "content")
    return parse_streams(whole, "block", "fmt", "content").select("block", "start_at", "end_at", "id_str", "ts", "text", "reason", "detail")


QUERIES = {f.__name__: f for f in (p6_found, p6_faults, p6_tweets, p6_streams)}
SQL: dict[str, str] = {}
