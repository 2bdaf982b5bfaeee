"""Operators that need a total order of all rows, without bringing them into one task.

The rows are sorted by ranges and cut by checkpoint(), so that a partition computed again keeps its place; what one
partition hands to the next (its size, its greatest value) is one row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstline.session import ensure_checkpoint_dir


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n, n + b.num_rows))], [*b.schema.names, "_place"])
        n += b.num_rows


def _sorted(df: DataFrame, by: list[str]) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    run = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in run.schema.fields)
    return run.mapInArrow(_numbered, f"{schema}, _place long").checkpoint()


def with_positions(df: DataFrame, by: list[str], name: str = "position") -> DataFrame:
    """Adds the place of each row in the order of `by`, from 1. `by` must order all rows apart for a defined result."""
    placed = _sorted(df, by)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_place") + F.col("_before") + 1).drop("_part", "_place", "_before")


def running_max(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the greatest value of a column among this row and the rows before it in the order of `by`."""
    placed = _sorted(df, by)
    tops = placed.groupBy("_part").agg(F.max(value).alias("top"))
    before = tops.select("_part", F.max("top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    here = F.max(value).over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_here", here).join(F.broadcast(before), "_part").withColumn(name, F.greatest("_here", "_before")).drop("_part", "_place", "_here", "_before")


def late_rows(df: DataFrame, arrival: list[str], day: str) -> DataFrame:
    """Adds late: whether a row's day is before the latest day that arrived up to it. Rows without a day are not late."""
    return running_max(df, arrival, day, "_latest").withColumn("late", F.coalesce(F.col(day) < F.col("_latest"), F.lit(False))).drop("_latest")


def merge_spans(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, n): overlapping spans of a key merged; a span that starts at or before the greatest end so far
    belongs to the span before. Null ends take no part."""
    given = df.select(*keys, F.col(start).alias("st"), F.col(end).alias("ed")).where("st is not null and ed is not null")
    order = Window.partitionBy(*keys).orderBy("st", "ed")
    before = F.max("ed").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = given.withColumn("fresh", F.when(before.isNull() | (F.col("st") > before), 1).otherwise(0))
    numbered = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*keys, "island").agg(F.min("st").alias(start), F.max("ed").alias(end), F.count("*").alias("n"))
    return merged.drop("island")
