"""Units of tweets, their document frequency, expected probability and burstiness.

Everything is in long form with the window as a column, so all windows are handled at once; a unit that a third of all
rows hold costs one partial row a task, since every count is combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.config import Config
from burstline.functions.math import sigmoid


def distinct_tweets(raw: DataFrame) -> DataFrame:
    """One row per id_str. Repeated deliveries agree but for received_at and retweet_count, so the least values stand."""
    columns = ["user_id_str", "text", "ts", "tw", "subtw", "lang", "in_reply_to_status_id_str"]
    ends = [F.min(c).alias(c) for c in columns if c in raw.columns]
    return raw.where(F.col("id_str").isNotNull()).groupBy("id_str").agg(*ends, F.max("retweet_count").alias("retweet_count"), F.min("received_at").alias("received_at"))


def unit_rows(tweets: DataFrame, units: Column) -> DataFrame:
    """(tw, subtw, tid, usr, unit): each unit once per tweet. Tweets without a window are left out; usr may be null."""
    kept = tweets.where(F.col("tw").isNotNull())
    return kept.select("tw", "subtw", F.col("id_str").alias("tid"), F.col("user_id_str").alias("usr"), F.explode(F.array_distinct(units)).alias("unit"))


def window_sizes(tweets: DataFrame) -> DataFrame:
    """(tw, n_t): tweets of each window, with or without a user."""
    return tweets.where(F.col("tw").isNotNull()).groupBy("tw").agg(F.count("*").alias("n_t"))


def document_frequency(rows: DataFrame) -> DataFrame:
    """(unit, tw, df) of unit rows, which hold each unit once per tweet."""
    return rows.groupBy("unit", "tw").agg(F.count("*").alias("df"))


def frequency_and_users(rows: DataFrame) -> DataFrame:
    """(unit, tw, df, users): tweets and distinct known users of each unit, in one pass: users are combined first."""
    each = rows.groupBy("unit", "tw", "usr").agg(F.count("*").alias("n"))
    return each.groupBy("unit", "tw").agg(F.sum("n").alias("df"), F.count("usr").alias("users"))


def unit_probability(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """(unit, ps, days): mean of df / n_t over the windows that hold the unit. sizes has one row a window and is broadcast."""
    return df.join(F.broadcast(sizes), "tw").groupBy("unit").agg(F.avg(F.col("df") / F.col("n_t")).alias("ps"), F.count("*").alias("days"))


def users_per_unit(rows: DataFrame) -> DataFrame:
    """(unit, tw, users): distinct users; units that only tweets without a user hold are left out."""
    return rows.where(F.col("usr").isNotNull()).groupBy("unit", "tw").agg(F.count_distinct("usr").alias("users"))


def burst_scores(df: DataFrame, sizes: DataFrame, ps: DataFrame) -> DataFrame:
    """(tw, unit, df, n_t, ps, e, z, pb) of the units above their expectation e = n_t ps.

    z = (df - e) / sqrt(e (1 - ps)); pb = 1 from two deviations above e, else sigmoid(10 (df - e - s) / s). Where ps = 1
    the gate df > e already leaves the unit out. Further columns of df, such as users, are kept.
    """
    joined = df.join(F.broadcast(sizes), "tw").join(ps.select("unit", "ps"), "unit")
    e = F.col("n_t") * F.col("ps")
    s = F.sqrt(e * (1 - F.col("ps")))
    over = joined.where(F.col("df") > e)
    pb = F.when(F.col("df") >= e + 2 * s, 1.0).otherwise(sigmoid(10 * F.try_divide(F.col("df") - e - s, s)))
    more = [c for c in df.columns if c not in ("tw", "unit", "df")]
    return over.select("tw", "unit", "df", "n_t", "ps", *more, e.alias("e"), F.try_divide(F.col("df") - e, s).alias("z"), pb.alias("pb"))


def budget(n_t: Column, cfg: Config) -> Column:
    """Units kept a window."""
    if isinstance(cfg.budget, int):
        return F.lit(cfg.budget)
    root = F.floor(F.sqrt(n_t)) + 1
    return F.greatest(root, F.lit(cfg.least_budget)) if cfg.budget == "g4" else root


def top_units(scored: DataFrame, score: str, cfg: Config) -> DataFrame:
    """Adds rk and seg_id = rk - 1, and keeps the budget of each window. Ties: the unit that sorts first.

    A window may hold a third of all units, so it is cut in two steps: ranks within (window, slice of the unit's hash)
    first, where a slice cannot hold more of the best K than K, then ranks among what is left.
    """
    by_score = [F.round(score, 9).desc(), F.col("unit")]
    sliced = scored.withColumn("_s", F.pmod(F.xxhash64("unit"), F.lit(32)))
    first = sliced.withColumn("_r", F.row_number().over(Window.partitionBy("tw", "_s").orderBy(*by_score))).where(F.col("_r") <= budget(F.col("n_t"), cfg)).drop("_s", "_r")
    ranked = first.withColumn("rk", F.row_number().over(Window.partitionBy("tw").orderBy(*by_score)))
    return ranked.where(F.col("rk") <= budget(F.col("n_t"), cfg)).withColumn("seg_id", F.col("rk") - 1)


def two_list(scored: DataFrame, cfg: Config) -> DataFrame:
    """Top 2K by users that are also top 2K by z, then K in the order of z. Cut by slices of each window first, as top_units."""
    k = budget(F.col("n_t"), cfg)
    by_users, by_z = [F.col("users").desc(), F.col("unit")], [F.round("z", 9).desc(), F.col("unit")]

    def ranks(df: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy("tw", *keys)
        return df.withColumn("ru", F.row_number().over(w.orderBy(*by_users))).withColumn("rz", F.row_number().over(w.orderBy(*by_z)))

    sliced = ranks(scored.withColumn("_s", F.pmod(F.xxhash64("unit"), F.lit(32))), "_s").where((F.col("ru") <= 2 * k) | (F.col("rz") <= 2 * k))
    both = ranks(sliced.drop("_s")).where((F.col("ru") <= 2 * k) & (F.col("rz") <= 2 * k))
    return both.withColumn("rk", F.row_number().over(Window.partitionBy("tw").orderBy("rz"))).where(F.col("rk") <= k)


def sub_window_weights(rows: DataFrame, bursty: DataFrame) -> DataFrame:
    """(tw, seg_id, subtw, df_sub, share): how the tweets of a bursty unit spread over the sub-windows."""
    used = rows.join(bursty.select("tw", "unit", "seg_id"), ["tw", "unit"])
    sub = used.groupBy("tw", "seg_id", "subtw").agg(F.count("*").alias("df_sub"))
    return sub.withColumn("share", F.col("df_sub") / F.sum("df_sub").over(Window.partitionBy("tw", "seg_id")))


def cluster_frequency(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, tw, df, users): frequency of a cluster of units = distinct tweets and users of its members.

    clusters is (unit, cluster), or (tw, unit, cluster) where they differ by window. A tweet has one user, so a cluster's
    tweets are made distinct first, combined before the shuffle, and then counted by user."""
    on = [c for c in ("tw", "unit") if c in clusters.columns]
    one = rows.join(clusters, on).select("cluster", "tw", "tid", "usr").distinct()
    by_user = one.groupBy("cluster", "tw", "usr").agg(F.count("*").alias("n"))
    return by_user.groupBy("cluster", "tw").agg(F.sum("n").alias("df"), F.count("usr").alias("users"))


def relation_pairs(rows: DataFrame) -> DataFrame:
    """(tw, tid, a, b), a < b: pairs of the distinct units inside a tweet, made inside its own array."""
    lists = rows.groupBy("tw", "tid").agg(F.sort_array(F.collect_set("unit")).alias("us"))
    i = F.posexplode("us").alias("i", "a")
    first = lists.select("tw", "tid", "us", i)
    return first.select("tw", "tid", "a", F.explode(F.slice("us", F.col("i") + 2, F.size("us"))).alias("b"))


def _pair_sets(pairs: DataFrame) -> DataFrame:
    """(tw, tid, skel, ps): the set of relation pairs of each tweet."""
    return pairs.groupBy("tw", "tid").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("ps")).withColumn("skel", F.xxhash64("ps"))


def skeletons(pairs: DataFrame) -> DataFrame:
    """(tw, skel, ps, n): the distinct sets of relation pairs of a window and the tweets that have each. However many tweets
    repeat a set, later steps see it once."""
    return _pair_sets(pairs).groupBy("tw", "skel").agg(F.first("ps").alias("ps"), F.count("*").alias("n"))


def skeleton_frequency(pairs: DataFrame) -> DataFrame:
    """(tw, tid, df): distinct tweets of the window that share any relation pair with a tweet, itself included.

    Counted over distinct sets of pairs, not tweets: a pair that a third of all tweets hold stands in as many rows as there
    are different sets with it.
    """
    own = _reach(skeletons(pairs)).where(F.col("day") == F.col("tw")).select("tw", "skel", "df")
    return _pair_sets(pairs).select("tw", "tid", "skel").join(own, ["tw", "skel"]).select("tw", "tid", "df")


def _reach(skels: DataFrame) -> DataFrame:
    """(tw, skel, day, df): the tweets of each day whose skeleton shares a pair with that of tw."""
    a = skels.select("tw", "skel", F.explode("ps").alias("p"))
    b = skels.select(F.col("tw").alias("day"), F.col("skel").alias("met"), "n", F.explode("ps").alias("p"))
    return a.join(b, "p").select("tw", "skel", "day", "met", "n").distinct().groupBy("tw", "skel", "day").agg(F.sum("n").alias("df"))


def skeleton_burst(pairs: DataFrame, users: DataFrame, sizes: DataFrame) -> DataFrame:
    """(tw, tid, df, n_t, ps, users, pb, weight) of the skeletons above their expectation.

    The frequency of a skeleton on any day is that of the tweets which share a relation pair with it; ps is its mean share
    over the days that have one, sizes (tw, n_t) the tweets with a skeleton of each day. users (tid, usr) gives the users of
    its tweets; weight = pb log10(users). Each tweet of a bursty skeleton has a row.
    """
    sets, skels = _pair_sets(pairs), skeletons(pairs)
    per_day = _reach(skels).join(F.broadcast(sizes.withColumnRenamed("tw", "day")), "day")
    ps = per_day.groupBy("tw", "skel").agg(F.avg(F.col("df") / F.col("n_t")).alias("ps"), F.max(F.when(F.col("day") == F.col("tw"), F.struct("df", "n_t"))).alias("own"))
    over = ps.select("tw", "skel", "ps", "own.df", "own.n_t").where(F.col("df") > F.col("n_t") * F.col("ps"))
    e = F.col("n_t") * F.col("ps")
    s = F.sqrt(e * (1 - F.col("ps")))
    scored = over.withColumn("pb", F.when(F.col("df") >= e + 2 * s, 1.0).otherwise(sigmoid(10 * F.try_divide(F.col("df") - e - s, s))))
    known = sets.select("tw", "tid", "skel", F.explode("ps").alias("p")).join(users, "tid").where("usr is not null")
    by_pair = known.select("tw", "p", "usr").distinct()
    reach = over.select("tw", "skel").join(skels.select("tw", "skel", F.explode("ps").alias("p")), ["tw", "skel"]).join(by_pair, ["tw", "p"])
    counted = reach.groupBy("tw", "skel").agg(F.count_distinct("usr").alias("users"))
    both = scored.join(counted, ["tw", "skel"]).withColumn("weight", F.col("pb") * F.log10("users"))
    return sets.select("tw", "tid", "skel").join(both, ["tw", "skel"]).drop("skel")


def fuzzy_frequency(frames: DataFrame, slots: tuple[str, str, str] = ("arg1", "verb", "arg2")) -> DataFrame:
    """(slots, tw, df): tweets of each frame with those of every similar frame added, on each day that has any of them.

    Frames are similar if two slots agree that are not empty. Different frames can agree in one pair of slots only, so the
    sum is that of the totals of a frame's pairs of slots, with its own tweets counted once: no two frames are joined, and a
    pair of slots that many frames share is one row a day. frames is (tw, tid, slots) with empty slots as ''.
    """
    own = frames.select("tw", "tid", *slots).distinct().groupBy(*slots, "tw").agg(F.count("*").alias("df"))
    pairs = [(slots[0], slots[1]), (slots[0], slots[2]), (slots[1], slots[2])]
    key = lambda p: F.when((F.col(p[0]) != "") & (F.col(p[1]) != ""), F.struct(F.lit(f"{p[0]}-{p[1]}").alias("kind"), F.col(p[0]).alias("x"), F.col(p[1]).alias("y")))
    keys = F.filter(F.array(*map(key, pairs)), lambda x: x.isNotNull())
    totals = own.select("tw", "df", F.explode(keys).alias("key")).groupBy("key", "tw").agg(F.sum("df").alias("n"))
    each = own.select(*slots).distinct().select(*slots, F.explode(keys).alias("key"))
    met = each.join(totals, "key").select(*slots, "tw", F.col("n").alias("df"))
    twice = own.select(*slots, "tw", (F.col("df") * (1 - F.size(keys))).alias("df"))
    return met.unionByName(twice).groupBy(*slots, "tw").agg(F.sum("df").alias("df"))


def frequent_units(df: DataFrame, least: int = 5) -> DataFrame:
    """(unit, tw, df) of the units that at least `least` tweets of all windows hold."""
    kept = df.groupBy("unit").agg(F.sum("df").alias("n")).where(F.col("n") >= least)
    return df.join(kept.select("unit"), "unit", "left_semi")


def data_windows(times: DataFrame, hours: int = 2) -> DataFrame:
    """(tw, starts): the sub-windows that the data set: the first begins at hour 0, each later one at the first hour that
    has a tweet and lies `hours` or more after the begin of the one before. times is (tw, hour); a day is one row of at most
    24 hours, combined before the shuffle."""
    seen = times.where("tw is not null and hour is not null").groupBy("tw").agg(F.sort_array(F.collect_set(F.col("hour").cast("int"))).alias("hours"))
    step = F.aggregate("hours", F.array(F.lit(0)), lambda starts, h: F.when(h >= F.element_at(starts, -1) + hours, F.concat(starts, F.array(h))).otherwise(starts))
    return seen.select("tw", step.alias("starts"))
