"""Sinks. Each replaces what stood at its path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.session import ensure_checkpoint_dir


def by_day(df: DataFrame, day: str, path: str, splits: int = 8) -> None:
    """A folder a day. A day that holds a third of the rows is written by several tasks, `splits` at most."""
    df.repartition(day, F.pmod(F.xxhash64(*[c for c in df.columns if c != day][:1]), F.lit(splits))).write.mode("overwrite").partitionBy(day).parquet(path)


def sorted_table(df: DataFrame, by: list[str], path: str) -> None:
    """A table sorted across its files."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def probabilities(ps: DataFrame, path: str) -> None:
    """Lines `prob TAB unit`, sorted by unit."""
    ps.repartitionByRange("unit").sortWithinPartitions("unit").select(F.concat_ws("\t", F.col("ps").cast("string"), "unit").alias("value")).write.mode("overwrite").text(path)


def frequencies(df: DataFrame, sizes: DataFrame, path: str) -> None:
    """The document frequencies and, beside them, the sizes of the windows."""
    sorted_table(df, ["unit", "tw"], f"{path}/frequencies")
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/windows")


def ids_and_texts(df: DataFrame, key: str, text: str, path: str) -> None:
    """The ids and the texts in files that go together line by line, in UTF-8; line breaks in texts become spaces."""
    flat = df.select(F.col(key).cast("string").alias("k"), F.regexp_replace(F.coalesce(text, F.lit("")), "[\r\n]+", " ").alias("t"))
    ensure_checkpoint_dir(df.sparkSession)
    run = flat.repartitionByRange("k").sortWithinPartitions("k", "t").checkpoint()
    run.select("k").write.mode("overwrite").text(f"{path}/ids")
    run.select("t").write.mode("overwrite").text(f"{path}/texts")


def bursty_units(bursty: DataFrame, rows: DataFrame, path: str) -> None:
    """The bursty units and, beside them, the tweets that hold one: (tw, tid)."""
    bursty.write.mode("overwrite").parquet(f"{path}/units")
    involved = rows.join(bursty.select("tw", "unit"), ["tw", "unit"], "left_semi").select("tw", "tid").distinct()
    involved.write.mode("overwrite").parquet(f"{path}/tweets")


def ranked_events(events: DataFrame, members: DataFrame, path: str) -> None:
    """Events by window and rank with their members: one JSON object a line."""
    both = events.join(members.select("tw", "event_id", "members"), ["tw", "event_id"], "left")
    both.repartitionByRange("tw", "rk").sortWithinPartitions("tw", "rk").write.mode("overwrite").json(path)


def judged_events(events: DataFrame, verdict: str, path: str) -> None:
    """True events and false events apart; those in doubt are in neither."""
    events.where(F.col(verdict)).write.mode("overwrite").parquet(f"{path}/true")
    events.where(~F.col(verdict)).write.mode("overwrite").parquet(f"{path}/false")


def annotation_sheet(interleaved: DataFrame, path: str) -> None:
    """The interleaved list as CSV, in order, with an empty column for the tag."""
    interleaved.withColumn("tag", F.lit("")).orderBy("place").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
