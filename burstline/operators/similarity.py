"""Similarity of bursty units by the texts around them, nearest neighbours, and greedy clusters with their scores.

The number of bursty units of a window is bounded by its budget, so the pairs of a window are bounded too; pairs meet
through shared words (an equi-join), never through a product.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.functions.math import idf
from burstline.functions.text import grams as runs


def contexts(rows: DataFrame, bursty: DataFrame, least: int = 1) -> DataFrame:
    """(tw, seg_id, subtw, tid): the tweets of each bursty unit; of those that have `least` tweets or more."""
    ctx = rows.join(bursty.select("tw", "unit", "seg_id"), ["tw", "unit"]).select("tw", "seg_id", "subtw", "tid")
    if least <= 1:
        return ctx
    enough = ctx.groupBy("tw", "seg_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return ctx.join(enough.select("tw", "seg_id"), ["tw", "seg_id"], "left_semi")


def word_frequency(texts: DataFrame) -> DataFrame:
    """(word, tw, df) of (tw, tid, ws), one row per tweet: each word once per tweet, combined before the shuffle."""
    return texts.select("tw", F.explode(F.array_distinct("ws")).alias("word")).groupBy("word", "tw").agg(F.count("*").alias("df"))


def tfidf_vectors(ctx: DataFrame, texts: DataFrame, df: DataFrame, sizes: DataFrame, scope: str = "window") -> DataFrame:
    """(tw, seg_id, subtw, word, w, norm): weights tf ln(floor(N / df)), those of nothing left out.

    texts is (tw, tid, ws). scope: window takes N and df of the window; corpus takes those of all windows together; day is
    window with the whole day as one context (subtw 0).
    """
    used = ctx.withColumn("subtw", F.lit(0)) if scope == "day" else ctx
    met = used.join(texts.select("tw", "tid", "ws"), ["tw", "tid"]).select("tw", "seg_id", "subtw", F.explode("ws").alias("word"))
    tf = met.groupBy("tw", "seg_id", "subtw", "word").agg(F.count("*").alias("tf"))
    if scope == "corpus":
        total = sizes.agg(F.sum("n_t").alias("n")).scalar()
        known = tf.join(df.groupBy("word").agg(F.sum("df").alias("df")), "word").withColumn("n_t", total)
    else:
        known = tf.join(df, ["word", "tw"]).join(F.broadcast(sizes), "tw")
    weighed = known.withColumn("w", F.col("tf") * idf(F.col("n_t"), F.col("df"))).where("w > 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("tw", "seg_id", "subtw")))
    return weighed.select("tw", "seg_id", "subtw", "word", "w", norm.alias("norm"))


def cosines(vectors: DataFrame) -> DataFrame:
    """(tw, subtw, src, dst, cos), src < dst, of the pairs that share a word."""
    a = vectors.select("tw", "subtw", "word", F.col("seg_id").alias("src"), F.col("w").alias("wa"), F.col("norm").alias("na"))
    b = vectors.select("tw", "subtw", "word", F.col("seg_id").alias("dst"), F.col("w").alias("wb"), F.col("norm").alias("nb"))
    met = a.join(b, ["tw", "subtw", "word"]).where("src < dst")
    dots = met.groupBy("tw", "subtw", "src", "dst").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return dots.select("tw", "subtw", "src", "dst", F.coalesce(F.try_divide(F.col("dot"), F.col("na") * F.col("nb")), F.lit(0.0)).alias("cos"))


def pair_similarity(cos: DataFrame, shares: DataFrame, mode: str) -> DataFrame:
    """(tw, src, dst, sim).

    text: the cosine. g2: the sum over sub-windows of share_i share_j cos. g4: the mean of the cosines over the
    sub-windows that both units occur in, times the product of their shares in the last of these. g1 is g2, but over
    aligned sub-windows and with the frequencies of the window, where g2 has those that the data set and of the corpus.
    """
    if mode == "text":
        return cos.groupBy("tw", "src", "dst").agg(F.sum("cos").alias("sim"))
    a = shares.select("tw", "subtw", F.col("seg_id").alias("src"), F.col("share").alias("sa"))
    b = shares.select("tw", "subtw", F.col("seg_id").alias("dst"), F.col("share").alias("sb"))
    if mode in ("g1", "g2"):
        both = cos.join(a, ["tw", "subtw", "src"]).join(b, ["tw", "subtw", "dst"])
        return both.groupBy("tw", "src", "dst").agg(F.sum(F.col("cos") * F.col("sa") * F.col("sb")).alias("sim"))
    if mode != "g4":
        raise ValueError(f"similarity {mode!r}")
    spread = shares.groupBy("tw", "seg_id").agg(F.map_from_entries(F.collect_list(F.struct("subtw", "share"))).alias("at"))
    total = cos.groupBy("tw", "src", "dst").agg(F.sum("cos").alias("total"))
    both = total.join(spread.select("tw", F.col("seg_id").alias("src"), F.col("at").alias("ma")), ["tw", "src"]).join(spread.select("tw", F.col("seg_id").alias("dst"), F.col("at").alias("mb")), ["tw", "dst"])
    common = F.array_intersect(F.map_keys("ma"), F.map_keys("mb"))
    last = F.array_max(common)
    sim = F.col("total") / F.size(common) * F.try_element_at("ma", last) * F.try_element_at("mb", last)
    return both.select("tw", "src", "dst", sim.alias("sim"))


def slot_unit(slot: Column, k: int) -> Column:
    """The unit that stands for a slot: verbs are told apart from arguments by a mark."""
    return F.concat(slot, F.lit("_1")) if k == 1 else slot


def frame_pair_similarity(frames: DataFrame, sims: DataFrame) -> DataFrame:
    """(tw, src, dst, sim), src < dst: similarity of frames as the sum over their three slots: 1 for equal units, else the
    similarity of the two units, 0 where there is none. Pairs without any similar slot have no row.

    frames is (tw, frame, s0, s1, s2) with unit ids, null for an empty or unknown slot; sims is (tw, src, dst, sim) of unit
    ids. Frames meet through similar units (an equi-join); both are bounded by the window's budget.
    """
    slots = frames.select("tw", "frame", F.posexplode(F.array("s0", "s1", "s2")).alias("k", "u")).where("u is not null")
    both = sims.select("tw", F.col("src").alias("u"), F.col("dst").alias("v"), "sim").unionByName(sims.select("tw", F.col("dst").alias("u"), F.col("src").alias("v"), "sim"))
    same = slots.select("tw", "u", F.col("u").alias("v"), F.lit(1.0).alias("sim")).distinct()
    near = slots.join(both.where("u <> v").unionByName(same), ["tw", "u"]).select("tw", "k", F.col("frame").alias("src"), F.col("v").alias("u"), "sim")
    met = near.join(slots.withColumnRenamed("frame", "dst"), ["tw", "k", "u"]).where("src < dst")
    return met.groupBy("tw", "src", "dst").agg(F.sum("sim").alias("sim"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """(tw, node, nbr, sim, rk): the k most similar neighbours of each node with a similarity above 0; ties by neighbour."""
    both = pairs.select("tw", F.col("src").alias("node"), F.col("dst").alias("nbr"), "sim").unionByName(pairs.select("tw", F.col("dst").alias("node"), F.col("src").alias("nbr"), "sim"))
    order = Window.partitionBy("tw", "node").orderBy(F.round("sim", 9).desc(), "nbr")
    return both.where("sim > 0").withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def mutual(knn: DataFrame) -> DataFrame:
    """(tw, node, nbr, sim, rk) of the neighbours that are neighbours both ways."""
    back = knn.select("tw", F.col("node").alias("nbr"), F.col("nbr").alias("node"))
    return knn.join(back, ["tw", "node", "nbr"], "left_semi")


def _greedy(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["node", "rk"])
    event: dict[int, int] = {}
    joined: dict[int, tuple[int, float]] = {}
    for node, part in group.groupby("node", sort=True):
        for nbr, sim in zip(part["nbr"], part["sim"], strict=True):
            if pd.isna(nbr) or nbr in event:
                continue
            event.setdefault(node, node)
            event[int(nbr)] = event[node]
            joined[int(nbr)] = (int(node), float(sim))
        event.setdefault(node, node)
    links = Counter(x for nbr, (node, _) in joined.items() for x in (nbr, node))
    rows = [(group["tw"].iloc[0], e, int(n), joined.get(n, (0, 0.0))[1], links[n]) for n, e in sorted(event.items())]
    return pd.DataFrame(rows, columns=["tw", "event_id", "node", "edge_sim", "links"])


def greedy_clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(tw, event_id, node, edge_sim, links): greedy clusters of mutual neighbours.

    Nodes are visited in ascending order, neighbours by falling similarity. A mutual neighbour that has no event yet joins
    the visitor's; a node left without one is an event by itself. edge_sim is the similarity of the link by which a node
    joined, 0 for a first node; links counts the node's links inside the event. The order matters, so a window is one unit
    of work; its nodes are bounded by the budget.
    """
    visited = nodes.select("tw", F.col("seg_id").alias("node")).join(links.select("tw", "node", "nbr", "sim", "rk"), ["tw", "node"], "left")
    return visited.groupBy("tw").applyInPandas(_greedy, "tw date, event_id long, node long, edge_sim double, links int")


def large_clusters(clusters: DataFrame, least: int = 2) -> DataFrame:
    """The rows of clusters that have `least` nodes or more."""
    sizes = clusters.groupBy("tw", "event_id").agg(F.count("*").alias("n_nodes")).where(F.col("n_nodes") >= least)
    return clusters.join(sizes, ["tw", "event_id"])


def newsworthiness(units: DataFrame, grams: DataFrame, slots: Column, how: str = "sum") -> DataFrame:
    """(unit, news): the worth of a unit, added up or averaged (how: sum, mean) over its slots.

    grams is (gram, p) with p the probability that a text of reference speaks of the gram. A slot of one word is worth e^p,
    0 where the gram is not known; one of several words (cut at blanks and underscores) the greatest e^p - 1 over all its
    runs of any length, single words included, at least 0. The runs are joined with grams, so only those that occur are
    looked at. Empty slots are worth nothing but count in the mean.
    """
    each = units.select("unit", F.posexplode(slots).alias("slot", "s")).withColumn("ws", F.filter(F.split("s", "[ _]+"), lambda w: w != ""))
    many = F.size("ws") > 1
    cut = each.select("unit", "slot", many.alias("many"), F.explode_outer(runs(F.col("ws"), 1, F.size("ws"))).alias("gram"))
    worth = F.when(F.col("many"), F.greatest(F.exp("p") - 1, F.lit(0.0))).otherwise(F.exp("p"))
    scored = cut.join(grams, "gram", "left").groupBy("unit", "slot").agg(F.max(F.coalesce(worth, F.lit(0.0))).alias("news"))
    return scored.groupBy("unit").agg((F.sum if how == "sum" else F.avg)("news").alias("news"))


def event_scores(clusters: DataFrame, bursty: DataFrame, news: DataFrame, tau: float, keep_ranks: int) -> DataFrame:
    """(tw, event_id, n_nodes, n_edges, score, ratio, rk, kept): score = mean news of the nodes times sum of link
    similarities over nodes; ratio = best score of the window / score; events without a score above 0 are left out.
    kept: int(ratio) < tau or among the first ranks."""
    named = clusters.join(bursty.select("tw", F.col("seg_id").alias("node"), "unit"), ["tw", "node"]).join(news, "unit", "left")
    sums = named.groupBy("tw", "event_id").agg(
        F.count("*").alias("n_nodes"), (F.sum("links") / 2).cast("int").alias("n_edges"), F.sum(F.coalesce("news", F.lit(0.0))).alias("news"), F.sum("edge_sim").alias("sims")
    )
    scored = sums.withColumn("score", F.col("news") / F.col("n_nodes") * F.col("sims") / F.col("n_nodes")).where("score > 0")
    day = Window.partitionBy("tw")
    ranked = scored.withColumn("ratio", F.max("score").over(day) / F.col("score")).withColumn("rk", F.row_number().over(day.orderBy(F.round("score", 9).desc(), "event_id")))
    kept = (F.floor("ratio") < tau) | (F.col("rk") <= keep_ranks)
    return ranked.select("tw", "event_id", "n_nodes", "n_edges", "score", "ratio", "rk", kept.alias("kept"))


def event_members(events: DataFrame, clusters: DataFrame, bursty: DataFrame, news: DataFrame) -> DataFrame:
    """(tw, event_id, by_links, by_news): the units of each event, those of most links first, and those of most news first;
    ties by unit. An event has at most the budget's units."""
    named = clusters.join(bursty.select("tw", F.col("seg_id").alias("node"), "unit"), ["tw", "node"]).join(news, "unit", "left").join(events.select("tw", "event_id"), ["tw", "event_id"])

    def listed(order: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct((-order).alias("s"), F.col("unit").alias("u")))), lambda x: x["u"])

    return named.groupBy("tw", "event_id").agg(listed(F.col("links")).alias("by_links"), listed(F.round(F.coalesce("news", F.lit(0.0)), 9)).alias("by_news"))


def size_histogram(clusters: DataFrame) -> DataFrame:
    """(n_nodes, n): events by their number of units."""
    return clusters.groupBy("tw", "event_id").agg(F.count("*").alias("n_nodes")).groupBy("n_nodes").agg(F.count("*").alias("n"))


def ratio_histogram(events: DataFrame) -> DataFrame:
    """(ratio, n, running): events by whole ratio up to 10, with the running total."""
    whole = events.select(F.floor("ratio").cast("int").alias("ratio")).where("ratio <= 10").groupBy("ratio").agg(F.count("*").alias("n"))
    return whole.withColumn("running", F.sum("n").over(Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, 0)))
