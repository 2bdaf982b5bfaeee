"""Every pair of items has a row, the rare ones and those that do not exceed chance too."""

from collections import Counter

from pyspark.sql import functions as F

from burstline.llm import cooccur, queries


def test_rare_pairs_and_pairs_by_chance(spark):
    baskets = [["#a", "#b"], ["#a", "#c"], ["#a", "#c"], ["#b"], ["#c"], ["#a"], None, ["#d", None, "#e"]]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["exceeds"]) for r in cooccur.all_pairs(df, "items", F.lit(8)).collect()}
    assert got == {("#a", "#b"): (1, False), ("#a", "#c"): (2, False), ("#d", "#e"): (1, True)}


def test_query_gives_every_pair(spark, folder):
    one, _ = queries._baskets(spark, folder)
    pair = Counter((a, b) for r in one.collect() for a in r["items"] or [] for b in r["items"] or [] if a < b)
    assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in queries.p4_all_pairs(spark, folder).collect()} == pair
