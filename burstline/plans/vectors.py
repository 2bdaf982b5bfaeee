"""Queries over dense vectors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from burstline.config import Config
from burstline.functions.math import dot, hamming
from burstline.operators import lsh as L
from burstline.operators.graph import connected_components
from burstline.sources.tables import table

CFG = Config()
DIM = 64
#: Blocks that the vectors are cut into where the stated queries meet them all.
BLOCKS = 16
#: Which vectors are queries: those whose id is divisible by this.
EVERY = 50


def _search(df):
    """Each query (an id divisible by EVERY) beside every other row: columns c of df as c_a (the query's) and c_b. Each row
    stands in one block, each query in all of them."""
    queries = df.where(F.col("id") % EVERY == 0).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    rows = df.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int"))
    a = queries.select(*(F.col(c).alias(f"{c}_a") for c in df.columns), "_block")
    b = rows.select(*(F.col(c).alias(f"{c}_b") for c in df.columns), "_block")
    return a.join(b, "_block").where("id_a <> id_b")


def cosine_pairs(spark, d):
    """The vectors with a cosine of 0.3 or more to each query, whatever their labels."""
    v = F.col("embedding")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), v.alias("v"), F.sqrt(dot(v, v)).alias("norm"))
    cos = F.coalesce(F.try_divide(dot(F.col("v_a"), F.col("v_b")), F.col("norm_a") * F.col("norm_b")), F.lit(0.0))
    return _search(e).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.round(cos, 4).alias("cos")).where("cos >= 0.3")


def label_centroids(spark, d):
    """The mean vector of each label, element by element."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    return e.groupBy("label", "k").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


def _histogram(pairs):
    return pairs.groupBy(F.format_string("%.1f", F.floor(F.col("cos") * 10) / 10).alias("cos")).agg(F.count("*").alias("n"))


def similarity_histogram(spark, d):
    """Those pairs by cosine to one decimal."""
    return _histogram(cosine_pairs(spark, d))


def _signed(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", L.signature(F.col("embedding"), CFG.lsh_bits, DIM).alias("sig"))


def lsh_candidates(spark, d):
    """Pairs of any two vectors whose signatures are as near as a cosine of 0.9 makes them."""
    limit = L.hamming_limit(CFG.lsh_similarity, CFG.lsh_bits)
    return L.candidates(_signed(spark, d), "vec_id", "sig", CFG.lsh_bits, CFG.lsh_rounds, CFG.lsh_window, limit).withColumn("similarity", F.round("similarity", 6))


def hamming_pairs(spark, d):
    """Exact similarity of the signatures of each query and any other vector."""
    s = _signed(spark, d).select(F.col("vec_id").alias("id"), "sig")
    h = _search(s).withColumn("hamming", hamming(F.col("sig_a"), F.col("sig_b")))
    return h.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "hamming", F.round(L.similarity_of(F.col("hamming"), CFG.lsh_bits), 6).alias("similarity"))


def vector_clusters(spark, d):
    """Connected components over the pairs of queries and vectors with a cosine of 0.3 or more."""
    return connected_components(cosine_pairs(spark, d), "a", "b")


def lsh_clusters(spark, d):
    """Connected components of all vectors over the candidates that have a cosine of 0.9 or more."""
    e = table(spark, d, "embeddings")
    near = L.links(e, "vec_id", "embedding", DIM, CFG.lsh_similarity, CFG.lsh_bits, CFG.lsh_rounds, CFG.lsh_window)
    return connected_components(near, "id_a", "id_b")


def lsh_tuning(spark, d):
    """Of the pairs of queries and vectors within the distance of a cosine of 0.3, the share that the candidates hold, for
    several numbers of rounds."""
    limit = round(CFG.lsh_bits * math.acos(0.3) / math.pi)
    exact = hamming_pairs(spark, d).where(F.col("hamming") <= limit).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    out = None
    for rounds in (5, 10, 20):
        met = L.candidates(_signed(spark, d), "vec_id", "sig", CFG.lsh_bits, rounds, CFG.lsh_window, limit).select(F.col("id_a").cast("long").alias("p"), F.col("id_b").cast("long").alias("q"))
        met = met.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).withColumn("hit", F.lit(1))
        one = exact.join(met, ["x", "y"], "left").agg(F.lit(rounds).alias("rounds"), F.count("*").alias("pairs"), F.count("hit").alias("found"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("recall", F.round(F.try_divide(F.col("found"), F.col("pairs")), 4))


def frame_slot_matches(spark, d):
    """Frames of one tweet that agree in two slots or more."""
    f = table(spark, d, "frames").where("frames is not null").select("tw", "id_str", F.posexplode("frames").alias("p", "f"))
    a, b = f.toDF("tw", "id_str", "p", "fa"), f.toDF("tw", "id_str", "q", "fb")
    return a.join(b, ["tw", "id_str"]).where("p < q").where(L.slot_match(F.col("fa"), F.col("fb"))).select("id_str", "p", "q")


QUERIES = {f.__name__: f for f in (cosine_pairs, label_centroids, similarity_histogram, lsh_candidates, hamming_pairs, vector_clusters, lsh_clusters, lsh_tuning, frame_slot_matches)}
PAIRS = f"p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id)"


def _signs() -> str:
    """Signatures by the same planes, written out."""
    rows = ", ".join("[" + ", ".join(repr(float(x)) for x in row) + "]" for row in L.planes(CFG.lsh_bits, DIM, 11))
    return f"pl AS (SELECT [{rows}]::DOUBLE[][] AS ps), s AS MATERIALIZED (SELECT vec_id, list_transform(ps, lambda q: list_inner_product(q, embedding::DOUBLE[]) >= 0) AS sig FROM embeddings, pl)"


def _sign_pairs(where: str) -> str:
    return f"h AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.sig, b.sig), lambda z: (z[1] <> z[2])::INT))::INT AS hamming FROM s a JOIN s b ON {where})"


SQL = {
    "cosine_pairs": f"WITH {PAIRS} SELECT * FROM p WHERE cos >= 0.3",
    "label_centroids": "SELECT label, k, round(avg(x::DOUBLE), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, (generate_subscripts(embedding, 1) - 1)::INT AS k FROM embeddings) GROUP BY label, k",
    "similarity_histogram": f"WITH {PAIRS} SELECT printf('%.1f', floor(cos * 10) / 10) AS cos, count(*) AS n FROM p WHERE cos >= 0.3 GROUP BY 1",
    "hamming_pairs": f"WITH {_signs()}, {_sign_pairs(f'a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id')} SELECT a, b, hamming, round(cos(pi() * hamming / {CFG.lsh_bits}), 6) AS similarity FROM h",
    "vector_clusters": f"WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM p WHERE cos >= 0.3 UNION SELECT b, a FROM p WHERE cos >= 0.3), lab AS (SELECT a AS node, a AS component, 0 AS turn FROM e UNION SELECT l.node, min(least(l.component, m.component)), l.turn + 1 FROM lab l JOIN e ON e.a = l.node JOIN lab m ON m.node = e.b WHERE l.turn < 40 GROUP BY l.node, l.turn) SELECT DISTINCT node, component FROM lab WHERE turn = 40",
    "lsh_candidates": f"WITH {_signs()}, {_sign_pairs('a.vec_id::VARCHAR < b.vec_id::VARCHAR')} SELECT a::VARCHAR AS id_a, b::VARCHAR AS id_b, hamming, round(cos(pi() * hamming / {CFG.lsh_bits}), 6) AS similarity FROM h WHERE hamming <= {L.hamming_limit(CFG.lsh_similarity, CFG.lsh_bits)}",
    "frame_slot_matches": "WITH f AS (SELECT tw, id_str, unnest(frames) AS f, (generate_subscripts(frames, 1) - 1)::INT AS p FROM frames WHERE frames IS NOT NULL) SELECT a.id_str, a.p AS p, b.p AS q FROM f a JOIN f b ON a.tw = b.tw AND a.id_str = b.id_str AND a.p < b.p WHERE (a.f.arg1 = b.f.arg1 AND a.f.arg1 <> '')::INT + (a.f.verb = b.f.verb AND a.f.verb <> '')::INT + (a.f.arg2 = b.f.arg2 AND a.f.arg2 <> '')::INT >= 2",
}
