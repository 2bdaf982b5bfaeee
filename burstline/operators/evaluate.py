"""Matching with gold events and headlines, precision, recall and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, left_id: str, left_words: str, right: DataFrame, right_id: str, right_words: str, least: int, same: list[str] | None = None, distinct: bool = True) -> DataFrame:
    """(left_id, right_id, common): rows with at least `least` common words, met through the words; `same` columns must agree.

    distinct counts each common word once; otherwise the repeats of the left words count.
    """
    same = same or []
    a = left.select(F.col(left_id).alias("_l"), *same, F.explode(left_words).alias("_w")).where("_w is not null")
    b = right.select(F.col(right_id).alias("_r"), *same, F.explode(F.array_distinct(right_words)).alias("_w")).where("_w is not null")
    a = a.distinct() if distinct else a
    met = a.join(b, [*same, "_w"]).groupBy("_l", "_r").agg(F.count("*").alias("common")).where(F.col("common") >= least)
    return met.select(F.col("_l").alias(left_id), F.col("_r").alias(right_id), "common")


def recall_precision(matches: DataFrame, n_events: Column, n_gold: Column, event: str, gold: str) -> DataFrame:
    """One row: matched gold / gold and matched events / events; null where there is nothing to divide by."""
    sums = matches.agg(F.count_distinct(gold).alias("gold_matched"), F.count_distinct(event).alias("events_matched"))
    return sums.select(
        "gold_matched", "events_matched", F.round(F.try_divide(F.col("gold_matched"), n_gold), 6).alias("recall"), F.round(F.try_divide(F.col("events_matched"), n_events), 6).alias("precision")
    )


def verdict(tag: Column) -> Column:
    """T and M are true, F is false, ? and anything else is in doubt (null)."""
    up = F.upper(tag)
    return F.when(up.isin("T", "M"), True).when(up == "F", False)


def label_precision(labels: DataFrame, group: str) -> DataFrame:
    """One row: true, false, doubtful labels, precision over all of them pooled, and the mean of the groups' precisions."""
    v = verdict(F.col("tag"))
    each = labels.groupBy(group).agg(F.count_if(v).alias("t"), F.count_if(~v).alias("f"), F.count_if(v.isNull()).alias("d"))
    return each.agg(
        F.sum("t").alias("n_true"), F.sum("f").alias("n_false"), F.sum("d").alias("n_doubt"),
        F.round(F.try_divide(F.sum("t"), F.sum("t") + F.sum("f")), 6).alias("pooled"), F.round(F.avg(F.try_divide(F.col("t"), F.col("t") + F.col("f"))), 6).alias("mean_of_groups"),
    )


def duplicate_rate(labels: DataFrame, event: str) -> DataFrame:
    """One row: distinct true events, those labelled true more than once, and their share."""
    seen = labels.where(verdict(F.col("tag"))).groupBy(event).agg(F.count("*").alias("n"))
    return seen.agg(F.count("*").alias("distinct_true"), F.count_if(F.col("n") > 1).alias("repeated")).withColumn("share", F.round(F.try_divide(F.col("repeated"), F.col("distinct_true")), 6))


def pairwise_agreement(labels: DataFrame, event: str, annotator: str) -> DataFrame:
    """(a, b, n, tt, tf, ft, ff, agreement, kappa) of each pair of annotators over the events that both judged.

    kappa is null where the expected agreement is complete.
    """
    judged = labels.groupBy(F.col(event).alias("e"), F.col(annotator).alias("who")).agg(F.max(verdict(F.col("tag"))).alias("v")).where("v is not null and who is not null")
    a, b = judged.toDF("e", "a", "va"), judged.toDF("e", "b", "vb")
    cells = a.join(b, "e").where("a < b").groupBy("a", "b").agg(
        F.count("*").alias("n"), F.count_if(F.expr("va and vb")).alias("tt"), F.count_if(F.expr("va and not vb")).alias("tf"), F.count_if(F.expr("not va and vb")).alias("ft"), F.count_if(F.expr("not va and not vb")).alias("ff"),
    )
    n, tt, tf, ft, ff = (F.col(c).cast("double") for c in ("n", "tt", "tf", "ft", "ff"))
    po = (tt + ff) / n
    pe = ((tt + tf) * (tt + ft) + (ff + tf) * (ff + ft)) / (n * n)
    return cells.withColumn("agreement", F.round(po, 6)).withColumn("kappa", F.round(F.try_divide(po - pe, 1 - pe), 6))


def _up_to(ratio: Column, most: int) -> Column:
    """The whole ratios from a ratio, rounded up, to `most`: an event counts at each of them."""
    least = F.ceil(F.round(ratio, 9)).cast("int")
    return F.explode(F.when(least <= most, F.sequence(least, F.lit(most))))


def precision_by_ratio(events: DataFrame, window: str, most: int = 10) -> DataFrame:
    """(up_to, n, n_true, n_false, n_doubt, precision, mean_precision): labelled events of a ratio, rounded up, of up_to or
    less. precision is pooled, mean_precision the mean of the windows that have any. events has (window, ratio, tag)."""
    v = verdict(F.col("tag"))
    each = events.select(window, v.alias("v"), _up_to(F.col("ratio"), most).alias("up_to")).groupBy("up_to", window)
    days = each.agg(F.count("*").alias("n"), F.count_if("v").alias("t"), F.count_if(~F.col("v")).alias("f"))
    return days.groupBy("up_to").agg(
        F.sum("n").alias("n"), F.sum("t").alias("n_true"), F.sum("f").alias("n_false"), (F.sum("n") - F.sum("t") - F.sum("f")).alias("n_doubt"),
        F.round(F.sum("t") / F.sum("n"), 6).alias("precision"), F.round(F.avg(F.col("t") / F.col("n")), 6).alias("mean_precision"),
    )


def repeats_by_ratio(true_events: DataFrame, most: int = 10) -> DataFrame:
    """(up_to, n_true, distinct, repeated, share): of the true events (id, ratio) up to each ratio how many there are, how
    many different ones, how many of these come more than once, and these over all true ones."""
    each = true_events.select("id", _up_to(F.col("ratio"), most).alias("up_to")).groupBy("up_to", "id").agg(F.count("*").alias("n"))
    sums = each.groupBy("up_to").agg(F.sum("n").alias("n_true"), F.count("*").alias("distinct"), F.count_if(F.col("n") > 1).alias("repeated"))
    return sums.withColumn("share", F.round(F.col("repeated") / F.col("n_true"), 6))


def precision_from_news(events: DataFrame, news: DataFrame, least: int = 2) -> DataFrame:
    """One row: events, those that share `least` words or more with a headline of their day, headlines of these days; precision
    and recall (matched events over headlines, as the measure is defined), pooled and as means of days.

    events is (event, tw, ws), news (news_id, tw, ws). A day without headlines has no recall.
    """
    matched = overlap_join(events, "event", "ws", news, "news_id", "ws", least, ["tw"]).select("event").distinct().withColumn("hit", F.lit(1))
    days = events.select("event", "tw").join(matched, "event", "left").groupBy("tw").agg(F.count("*").alias("e"), F.count("hit").alias("m"))
    both = days.join(news.groupBy("tw").agg(F.count("*").alias("h")), "tw", "left")
    share = lambda x, y: F.round(F.try_divide(x, y), 6)
    return both.agg(
        F.sum("e").alias("events"), F.sum("m").alias("matched"), F.sum("h").alias("headlines"), share(F.sum("m"), F.sum("e")).alias("precision"), share(F.sum("m"), F.sum("h")).alias("recall"),
        F.round(F.avg(F.col("m") / F.col("e")), 6).alias("mean_precision"), F.round(F.avg(F.col("m") / F.col("h")), 6).alias("mean_recall"),
    )


def precision_by_system(labels: DataFrame, systems: DataFrame, event: str) -> DataFrame:
    """(system, n_true, n_false, n_doubt, precision) of labels whose events systems (event, system) tell; others take no part."""
    v = verdict(F.col("tag"))
    sums = labels.join(systems.select(event, "system").distinct(), event).groupBy("system").agg(F.count_if(v).alias("n_true"), F.count_if(~v).alias("n_false"), F.count_if(v.isNull()).alias("n_doubt"))
    return sums.withColumn("precision", F.round(F.try_divide(F.col("n_true"), F.col("n_true") + F.col("n_false")), 6))


def interleave(a: DataFrame, b: DataFrame, rank: str, value: str, names: tuple[str, str] = ("a", "b"), by: str | None = None) -> DataFrame:
    """(by, system, rank, value, place): two lists with ranks from 1 without gaps by turns, the tail of the longer at the end;
    of equal ranks the system that sorts first comes first. Within each value of `by`, if given.

    The place follows from the rank and the length of the other list, so nothing is sorted: place = rank + the number of
    the other list's rows before it.
    """
    first, second = (a, b) if names[0] <= names[1] else (b, a)
    keys = [by] if by else []
    out = []
    for mine, other, name, lead in ((first, second, min(names), 1), (second, first, max(names), 0)):
        sizes = other.groupBy(*keys).agg(F.count("*").alias("_n")) if by else other.agg(F.count("*").alias("_n"))
        with_size = mine.join(sizes, by, "left") if by else mine.withColumn("_n", sizes.scalar())
        place = F.col(rank) + F.least(F.col(rank) - lead, F.coalesce("_n", F.lit(0)))
        out.append(with_size.select(*keys, F.lit(name).alias("system"), F.col(rank).alias("rank"), F.col(value).alias("value"), place.alias("place")))
    return out[0].unionByName(out[1])
