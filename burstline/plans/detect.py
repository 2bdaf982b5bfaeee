"""Detection queries: units, bursts, similarity, clusters, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burstline.config import Config
from burstline.functions import text as T
from burstline.operators import similarity as S
from burstline.operators import units as U
from burstline.operators.evaluate import overlap_join, precision_by_ratio, precision_from_news, recall_precision, repeats_by_ratio
from burstline.session import stored
from burstline.sources.tables import table

CFG = Config()


def tweets(spark: SparkSession, d: str) -> DataFrame:
    return U.distinct_tweets(table(spark, d, "tweets"))


def word_rows(spark: SparkSession, d: str) -> DataFrame:
    return U.unit_rows(tweets(spark, d), T.without_urls(T.without(T.words(F.col("text")))))


def element_rows(spark: SparkSession, d: str) -> DataFrame:
    """Units = the slots of frames, those of a frame with both arguments empty left out."""
    f = table(spark, d, "frames").select("id_str", "frames").where("frames is not null")
    fine = F.filter("frames", lambda x: (F.coalesce(x["arg1"], F.lit("")) != "") | (F.coalesce(x["arg2"], F.lit("")) != ""))
    slots = F.flatten(F.transform(fine, lambda x: F.array(x["arg1"], x["verb"], x["arg2"])))
    slots = F.filter(slots, lambda x: x.isNotNull() & (x != ""))
    t = tweets(spark, d).join(f, "id_str")
    return U.unit_rows(t, slots)


def _burst(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    df = U.document_frequency(rows)
    return U.burst_scores(df, sizes, U.unit_probability(df, sizes))


def _with_users(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Burst scores with the distinct users of each unit; units without a known user are left out at the end."""
    df = U.frequency_and_users(rows)
    return U.burst_scores(df, sizes, U.unit_probability(df, sizes)).where("users > 0")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals, after nine and with halves lifted: neither another order of additions nor another way to round a half
    changes a figure."""
    return df.withColumns({c: F.round(F.round(c, 9) + 1e-10, 6) for c in columns})


def unit_probability(spark, d):
    t = tweets(spark, d)
    df = U.document_frequency(word_rows(spark, d))
    return _rounded(U.unit_probability(df, U.window_sizes(t)), "ps")


def document_frequency(spark, d):
    return U.document_frequency(word_rows(spark, d))


def window_sizes(spark, d):
    return U.window_sizes(tweets(spark, d))


def users_per_unit(spark, d):
    return U.users_per_unit(word_rows(spark, d))


def _bursty_words(spark, d, cfg=CFG):
    return U.top_units(_burst(word_rows(spark, d), U.window_sizes(tweets(spark, d))), "z", cfg)


def burst_words_topk(spark, d):
    return _rounded(_bursty_words(spark, d), "e", "z").select("tw", "unit", "df", "n_t", "e", "z", "rk")


def burst_elements_topk(spark, d):
    rows = element_rows(spark, d)
    return _rounded(U.top_units(_burst(rows, U.window_sizes(tweets(spark, d))), "z", CFG), "e", "z").select("tw", "unit", "df", "e", "z", "rk")


def burst_weighted_users(spark, d):
    """pb log10(users), the budget of the first generation."""
    both = _with_users(word_rows(spark, d), U.window_sizes(tweets(spark, d))).withColumn("weight", F.col("pb") * F.log10("users"))
    return _rounded(U.top_units(both, "weight", Config(budget="g1")), "weight").select("tw", "unit", "users", "weight", "rk")


def burst_z_users(spark, d):
    """z log10(users) of units with enough tweets and users, 220 a window."""
    both = _with_users(word_rows(spark, d), U.window_sizes(tweets(spark, d))).where((F.col("df") >= CFG.min_tweets) & (F.col("users") >= CFG.min_users))
    both = both.withColumn("weight", F.col("z") * F.log10("users"))
    return _rounded(U.top_units(both, "weight", Config(budget=220)), "weight").select("tw", "unit", "df", "users", "weight", "rk")


def burst_two_list(spark, d):
    """The units that are among the first 440 by users and by z, 220 a window."""
    both = _with_users(word_rows(spark, d), U.window_sizes(tweets(spark, d)))
    return _rounded(U.two_list(both, Config(budget=220)), "z").select("tw", "unit", "users", "z", "rk")


def burst_event_types(spark, d):
    """The same measure over the event stream: unit = event type, window = day, support = events."""
    e = table(spark, d, "events").where("ts is not null and event_type is not null").select(F.to_date("ts").alias("tw"), F.col("event_type").alias("unit"))
    sizes = e.groupBy("tw").agg(F.count("*").alias("n_t"))
    df = e.groupBy("unit", "tw").agg(F.count("*").alias("df"))
    return _rounded(U.burst_scores(df, sizes, U.unit_probability(df, sizes)), "e", "z", "pb").select("tw", "unit", "df", "e", "z", "pb")


def top_lexical_burst(spark, d):
    """Burst of lexical units, measured on the frame that they evoke: verbs of one stem evoke one frame, whose tweets are
    counted together; each of its units comes out with the frame's figures on the days that have it."""
    t = tweets(spark, d).where("tw is not null").select("tw", "subtw", F.col("id_str").alias("tid"), F.col("user_id_str").alias("usr"))
    verbs = t.join(_frames(spark, d).where("verb <> ''").select("tid", "verb").distinct(), "tid").withColumn("unit", T.stem(F.col("verb")))
    scored = _burst(verbs.drop("verb").distinct(), U.window_sizes(tweets(spark, d)))
    units = verbs.select("tw", "verb", "unit").distinct()
    return _rounded(scored.join(units, ["tw", "unit"]), "e", "z").select("tw", F.concat("verb", F.lit(".v")).alias("unit"), F.col("unit").alias("frame"), "df", "e", "z")


def sub_window_weights(spark, d):
    return _rounded(U.sub_window_weights(word_rows(spark, d), _bursty_words(spark, d)), "share")


def _texts(spark, d, cfg=CFG):
    """(tw, subtw, id_str, user_id_str, ws): the words of each tweet that has a window; ws is empty for a text that is null."""
    none = F.expr("cast(array() as array<string>)")
    t = tweets(spark, d).where("tw is not null")
    sub = F.col("subtw") if cfg.hours == 2 else T.sub_window(F.col("ts"), cfg.hours)
    return t.select("tw", sub.alias("subtw"), "id_str", "user_id_str", F.coalesce(T.words(F.col("text")), none).alias("ws"))


def _slim(texts):
    return texts.select("tw", F.col("id_str").alias("tid"), "ws")


def word_df_by_window(spark, d):
    return S.word_frequency(_slim(_texts(spark, d)))


def _vectors(spark, d, cfg=CFG, mode="g4", least=1):
    """(vectors, shares, bursty) of the budget's units.

    The tweets are cut to their words once; that table, the bursty units and their contexts are read by every later step.
    The words' frequency is over all tweets, while vectors look at the tweets with a bursty unit only.
    """
    texts = stored(_texts(spark, d, cfg))
    sizes = U.window_sizes(texts)
    rows = U.unit_rows(texts, T.without_urls(T.without(F.col("ws"))))
    bursty = stored(U.top_units(_burst(rows, sizes), "z", cfg))
    ctx = S.contexts(rows, bursty, least)
    if mode == "g2":
        starts = U.data_windows(tweets(spark, d).select("tw", F.hour("ts").alias("hour")), cfg.hours)
        hours = tweets(spark, d).where("tw is not null and ts is not null").select(F.col("id_str").alias("tid"), "tw", F.hour("ts").alias("hour"))
        at = hours.join(F.broadcast(starts), "tw").select("tw", "tid", F.size(F.filter("starts", lambda h: h <= F.col("hour"))).alias("subtw"))
        ctx = ctx.drop("subtw").join(at, ["tw", "tid"])
    ctx = stored(ctx)
    sub = ctx.groupBy("tw", "seg_id", "subtw").agg(F.count("*").alias("df_sub"))
    shares = sub.withColumn("share", F.col("df_sub") / F.sum("df_sub").over(Window.partitionBy("tw", "seg_id")))
    scope = {"text": "day", "g2": "corpus"}.get(mode, "window")
    return S.tfidf_vectors(ctx, _slim(texts), S.word_frequency(_slim(texts)), sizes, scope), shares, bursty


def tfidf_vectors(spark, d):
    return _rounded(_vectors(spark, d)[0], "w", "norm")


def tfidf_vectors_corpus(spark, d):
    """Vectors over the sub-windows that the data set, with the frequencies of all days together."""
    return _rounded(_vectors(spark, d, mode="g2")[0], "w", "norm")


def supported_vectors(spark, d):
    """Vectors of the units that three texts or more hold."""
    return _rounded(_vectors(spark, d, least=CFG.min_texts)[0], "w", "norm")


def data_windows(spark, d):
    """The first hours of each day's sub-windows, as the tweets set them."""
    return U.data_windows(tweets(spark, d).select("tw", F.hour("ts").alias("hour")), CFG.hours).select("tw", F.array_join(F.transform("starts", lambda x: x.cast("string")), " ").alias("starts"))


def _pairs(spark, d, mode, cfg=CFG):
    vectors, shares, bursty = _vectors(spark, d, cfg, mode)
    return S.pair_similarity(S.cosines(vectors), shares, mode), bursty


def pair_similarity_g4(spark, d):
    return _rounded(_pairs(spark, d, "g4")[0], "sim")


def pair_similarity_g2(spark, d):
    return _rounded(_pairs(spark, d, "g2")[0], "sim")


def pair_similarity_g1(spark, d):
    return _rounded(_pairs(spark, d, "g1")[0], "sim")


def pair_similarity_text(spark, d):
    return _rounded(_pairs(spark, d, "text")[0], "sim")


def nearest_neighbours(spark, d):
    return _rounded(S.nearest(_pairs(spark, d, "text")[0], CFG.k), "sim")


def mutual_neighbours(spark, d):
    return _rounded(S.mutual(S.nearest(_pairs(spark, d, "text")[0], CFG.k)), "sim")


def gram_table(spark, d):
    """(gram, logp): natural log of the share of headlines that hold a gram of up to five words."""
    news = table(spark, d, "news").where("headline is not null")
    n = news.agg(F.count("*").alias("n")).scalar()
    ws = T.words(F.col("headline"))
    each = news.select("news_id", F.explode(F.array_distinct(T.grams(ws, 1, 5))).alias("gram"))
    return each.groupBy("gram").agg(F.count("*").alias("c")).select("gram", F.log(F.col("c") / n).alias("logp"))


def _anchors(spark, d):
    """(gram, p): the share of headlines that hold a gram."""
    return gram_table(spark, d).select("gram", F.exp("logp").alias("p"))


def _frames(spark, d):
    """(tw, tid, arg1, verb, arg2): frames of tweets, empty slots as ''."""
    f = table(spark, d, "frames").where("frames is not null").select("tw", F.col("id_str").alias("tid"), F.explode("frames").alias("f"))
    return f.select("tw", "tid", *(F.coalesce(f"f.{s}", F.lit("")).alias(s) for s in ("arg1", "verb", "arg2")))


def newsworthiness(spark, d):
    """Worth of words, of the good phrases of headlines, and of frames, whose slots are added up."""
    words = word_rows(spark, d).select("unit")
    news = table(spark, d, "news").where("headline is not null")
    phrases = news.select(F.explode(T.grams(T.words(F.col("headline")), 2, 3)).alias("g")).where(T.good_gram(F.col("g"))).select(F.replace("g", F.lit(" "), F.lit("_")).alias("unit"))
    frames = _frames(spark, d).select(F.concat_ws("|", "arg1", "verb", "arg2").alias("unit"))
    units = words.unionByName(phrases).unionByName(frames).where("unit <> '||'").distinct()
    return _rounded(S.newsworthiness(units, _anchors(spark, d), F.split("unit", "\\|")), "news").where("news > 0")


def frame_worth_mean(spark, d):
    """Worth of frames as the mean over their three slots."""
    frames = _frames(spark, d).select(F.concat_ws("|", "arg1", "verb", "arg2").alias("unit")).where("unit <> '||'").distinct()
    return _rounded(S.newsworthiness(frames, _anchors(spark, d), F.split("unit", "\\|"), "mean"), "news").where("news > 0")


def _clusters(spark, d, cfg=CFG):
    pairs, bursty = _pairs(spark, d, cfg.similarity, cfg)
    return stored(S.greedy_clusters(bursty, S.mutual(stored(S.nearest(pairs, cfg.k))))), bursty


def event_clusters(spark, d):
    return _rounded(_clusters(spark, d)[0], "edge_sim")


def large_event_clusters(spark, d):
    """Clusters of two units or more."""
    return _rounded(S.large_clusters(_clusters(spark, d)[0]), "edge_sim")


def event_sizes(spark, d):
    return S.size_histogram(_clusters(spark, d)[0])


def cluster_frequency(spark, d):
    """Tweets and users of each day's clusters of units: the union over their members."""
    clusters, bursty = _clusters(spark, d)
    named = bursty.select("tw", "unit", F.col("seg_id").alias("node")).join(clusters, ["tw", "node"])
    return U.cluster_frequency(word_rows(spark, d), named.select("tw", "unit", F.col("event_id").alias("cluster")))


def _events(spark, d, cfg=CFG):
    clusters, bursty = _clusters(spark, d, cfg)
    news = S.newsworthiness(bursty.select("unit").distinct(), _anchors(spark, d), F.split("unit", "\\|"))
    return stored(S.event_scores(clusters, bursty, news, cfg.tau, cfg.keep_ranks)), clusters, bursty, news


def event_scores(spark, d):
    return _rounded(_events(spark, d)[0], "score", "ratio")


def _kept_members(spark, d):
    events, clusters, bursty, news = _events(spark, d)
    return S.event_members(events.where("kept"), clusters, bursty, news), events


def event_members(spark, d):
    """The kept events with their units, those with most links first and those of most news first."""
    members, events = _kept_members(spark, d)
    listed = members.select("tw", "event_id", F.array_join("by_links", " ").alias("by_links"), F.array_join("by_news", " ").alias("by_news"))
    return listed.join(events.select("tw", "event_id", "rk", "n_nodes", "n_edges"), ["tw", "event_id"])


def event_ratio_histogram(spark, d):
    return S.ratio_histogram(_events(spark, d)[0])


def _matched(spark, d):
    """(events, matches, gold): the kept events with their words, and what gold events they meet by two lemmas or more."""
    members, events = _kept_members(spark, d)
    named = stored(members.join(events.select("tw", "event_id", "ratio"), ["tw", "event_id"]).select(F.concat_ws("-", "tw", "event_id").alias("event"), "tw", "event_id", "ratio", "by_links"))
    gold = table(spark, d, "gold_events").where("lemmas is not null")
    return named, overlap_join(named, "event", "by_links", gold, "gold_id", "lemmas", CFG.common_lemmas), gold


def event_recall(spark, d):
    """Recall and precision of the kept events against the gold events: two common lemmas or more make a match."""
    events, matches, gold = _matched(spark, d)
    n_gold, n_events = (x.agg(F.count("*").alias("n")).scalar() for x in (gold, events))
    return recall_precision(matches, n_events, n_gold, "event", "gold_id")


def event_precision_by_ratio(spark, d):
    """Precision of the kept events up to each ratio, those that meet a gold event of their day being true; events that name
    a sign of the zodiac are left out."""
    events, _, gold = _matched(spark, d)
    signs = F.array(*map(F.lit, T.ZODIAC))
    events = events.where(~F.arrays_overlap("by_links", signs))
    true = overlap_join(events, "event", "by_links", gold, "gold_id", "lemmas", CFG.common_lemmas, ["tw"]).select("event").distinct().withColumn("tag", F.lit("T"))
    return precision_by_ratio(events.join(true, "event", "left").select("tw", "ratio", F.coalesce("tag", F.lit("F")).alias("tag")), "tw")


def event_repeats_by_ratio(spark, d):
    """How many gold events the kept events of each ratio and below tell more than once."""
    events, matches, _ = _matched(spark, d)
    return repeats_by_ratio(matches.join(events.select("event", "ratio"), "event").select(F.col("gold_id").alias("id"), "ratio"))


def event_news(spark, d):
    """Precision and recall of the kept events against the headlines of their day, pooled and as means of days."""
    events, _, _ = _matched(spark, d)
    news = table(spark, d, "news").where("headline is not null").select("news_id", "tw", T.words(F.col("headline")).alias("ws"))
    return precision_from_news(events.select("event", "tw", F.col("by_links").alias("ws")), news)


def bursty_frame_pairs(spark, d):
    """Similarity of the frames of bursty elements by their slots; units are similar as their texts are (g4)."""
    pairs, bursty = _pairs(spark, d, "g4")
    ids = bursty.select("tw", F.col("unit").alias("slot"), F.col("seg_id").alias("id"))
    f = _frames(spark, d).select("tw", "arg1", "verb", "arg2").distinct()
    for k, slot in enumerate(("arg1", "verb", "arg2")):
        f = f.join(ids.select("tw", F.col("slot").alias(slot), F.col("id").alias(f"s{k}")), ["tw", slot], "left")
    known = f.where("s0 is not null and s1 is not null or s0 is not null and s2 is not null or s1 is not null and s2 is not null")
    named = known.select("tw", F.concat_ws("|", "arg1", "verb", "arg2").alias("frame"), "s0", "s1", "s2")
    return _rounded(S.frame_pair_similarity(named, pairs), "sim")


QUERIES = {
    f.__name__: f
    for f in (
        document_frequency, window_sizes, unit_probability, users_per_unit, burst_words_topk, burst_elements_topk, burst_weighted_users, burst_z_users, burst_two_list, burst_event_types,
        top_lexical_burst, sub_window_weights, word_df_by_window, data_windows, tfidf_vectors, tfidf_vectors_corpus, supported_vectors, pair_similarity_g4, pair_similarity_g2, pair_similarity_g1,
        pair_similarity_text, nearest_neighbours, mutual_neighbours, gram_table, newsworthiness, frame_worth_mean, event_clusters, large_event_clusters, event_sizes, cluster_frequency, event_scores, event_members,
        event_ratio_histogram, event_recall, event_precision_by_ratio, event_repeats_by_ratio, event_news, bursty_frame_pairs,
    )
}


# --- the same in SQL --------------------------------------------------------------------------------------------------

STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
SIGNS = "[" + ", ".join(f"'{z}'" for z in T.ZODIAC) + "]"
TWEETS = """t AS MATERIALIZED (SELECT id_str, min(user_id_str) AS usr, min(text) AS text, min(ts) AS ts, min(tw) AS tw, min(subtw) AS subtw FROM tweets WHERE id_str IS NOT NULL GROUP BY id_str),
kept AS (SELECT * FROM t WHERE tw IS NOT NULL),
n AS (SELECT tw, count(*) AS n_t FROM kept GROUP BY tw)"""
PIECES = r"list_filter(string_split_regex(replace(lower(text), '|', ' '), '[ \t\r\n]+'), lambda w: length(w) >= 1)"
WORDS = f"rows_ AS MATERIALIZED (SELECT tw, subtw, id_str AS tid, usr, unnest(list_distinct(list_filter({PIECES}, lambda w: NOT contains(w, 'http') AND NOT list_contains({STOP}, w)))) AS unit FROM kept)"
FRAMES = "fm AS (SELECT tw, id_str AS tid, coalesce(f.arg1, '') AS arg1, coalesce(f.verb, '') AS verb, coalesce(f.arg2, '') AS arg2 FROM (SELECT tw, id_str, unnest(frames) AS f FROM frames WHERE frames IS NOT NULL))"
ELEMENTS = """fr AS (SELECT id_str, unnest(frames) AS f FROM frames WHERE frames IS NOT NULL),
slots AS (SELECT id_str, unnest([f.arg1, f.verb, f.arg2]) AS unit FROM fr WHERE coalesce(f.arg1, '') <> '' OR coalesce(f.arg2, '') <> ''),
rows_ AS (SELECT DISTINCT tw, subtw, kept.id_str AS tid, usr, unit FROM kept JOIN slots ON kept.id_str = slots.id_str WHERE unit IS NOT NULL AND unit <> '')"""
BURST = """df AS (SELECT unit, tw, count(*) AS df FROM rows_ GROUP BY unit, tw),
ps AS (SELECT unit, avg(df / n_t) AS ps, count(*) AS days FROM df JOIN n USING (tw) GROUP BY unit),
base AS (SELECT df.tw, df.unit, df.df, n_t, ps, n_t * ps AS e, sqrt(n_t * ps * (1 - ps)) AS s FROM df JOIN n USING (tw) JOIN ps USING (unit)),
burst AS (SELECT tw, unit, df, n_t, ps, e, (df - e) / s AS z, CASE WHEN df >= e + 2 * s THEN 1.0::DOUBLE ELSE 1 / (1 + exp(-10 * (df - e - s) / s)) END AS pb FROM base WHERE df > e)"""
USERS = "us AS (SELECT unit, tw, count(DISTINCT usr) AS users FROM rows_ WHERE usr IS NOT NULL GROUP BY unit, tw)"


def _ranked(source: str, score: str, budget: str) -> str:
    return f"ranked AS MATERIALIZED (SELECT *, rk - 1 AS seg_id FROM (SELECT *, row_number() OVER (PARTITION BY tw ORDER BY round({score}, 9) DESC, unit) AS rk FROM {source}) WHERE rk <= {budget})"


G4 = "greatest(floor(sqrt(n_t))::BIGINT + 1, 200)"
W = f"WITH {TWEETS}, {WORDS}"
CTX = "ctx AS MATERIALIZED (SELECT rows_.tw, seg_id, rows_.subtw, tid FROM rows_ JOIN ranked USING (tw, unit))"
SHARES = "sub AS (SELECT tw, seg_id, subtw, count(*) AS df_sub FROM ctx GROUP BY ALL), shares AS MATERIALIZED (SELECT *, df_sub / sum(df_sub) OVER (PARTITION BY tw, seg_id) AS share FROM sub)"
OCC = f"occ AS MATERIALIZED (SELECT tw, id_str AS tid, unnest({PIECES}) AS word FROM kept), wdf AS (SELECT word, tw, count(DISTINCT tid) AS df FROM occ GROUP BY word, tw)"
STARTS = """hrs AS (SELECT DISTINCT tw, hour(ts) AS h FROM kept WHERE ts IS NOT NULL),
starts AS (SELECT DISTINCT tw, 0::BIGINT AS m FROM hrs UNION ALL SELECT s.tw, min(h) AS m FROM starts s JOIN hrs ON hrs.tw = s.tw AND h >= s.m + 2 GROUP BY s.tw, s.m)"""
SET_CTX = """place AS (SELECT k.tw, k.id_str AS tid, count(*) AS subtw FROM kept k JOIN starts s ON s.tw = k.tw AND s.m <= hour(k.ts) GROUP BY ALL),
ctx AS MATERIALIZED (SELECT rows_.tw, seg_id, place.subtw, rows_.tid FROM rows_ JOIN ranked USING (tw, unit) JOIN place ON place.tw = rows_.tw AND place.tid = rows_.tid)"""


def _vector_sql(subtw: str = "subtw", corpus: bool = False) -> str:
    df = "(SELECT word, sum(df) AS df FROM wdf GROUP BY word) c USING (word), (SELECT sum(n_t) AS n_t FROM n)" if corpus else "wdf c USING (word, tw) JOIN n USING (tw)"
    return f"""tf AS (SELECT ctx.tw, seg_id, {subtw} AS subtw, word, count(*) AS tf FROM ctx JOIN occ USING (tw, tid) GROUP BY ALL),
wt AS (SELECT tf.tw, seg_id, subtw, word, tf * ln(greatest(n_t // c.df, 1)) AS w FROM tf JOIN {df}),
vec AS MATERIALIZED (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY tw, seg_id, subtw)) AS norm FROM wt WHERE w > 0),
cosine AS MATERIALIZED (SELECT a.tw, a.subtw, a.seg_id AS src, b.seg_id AS dst, sum(a.w * b.w) / (any_value(a.norm) * any_value(b.norm)) AS cos FROM vec a JOIN vec b ON a.tw = b.tw AND a.subtw = b.subtw AND a.word = b.word AND a.seg_id < b.seg_id GROUP BY ALL)"""


TOP = f"{W}, {BURST}, {_ranked('burst', 'z', G4)}, {CTX}, {SHARES}, {OCC}"
SET = f"{W.replace('WITH', 'WITH RECURSIVE', 1)}, {BURST}, {_ranked('burst', 'z', G4)}, {STARTS}, {SET_CTX}, {SHARES}, {OCC}"
G2_SIM = "SELECT c.tw, c.src, c.dst, round(sum(c.cos * a.share * b.share), 6) AS sim FROM cosine c JOIN shares a ON a.tw = c.tw AND a.subtw = c.subtw AND a.seg_id = c.src JOIN shares b ON b.tw = c.tw AND b.subtw = c.subtw AND b.seg_id = c.dst GROUP BY ALL"
G4_SIM = """both_ AS (SELECT a.tw, a.seg_id AS src, b.seg_id AS dst, count(*) AS m, max(a.subtw) AS last FROM shares a JOIN shares b ON a.tw = b.tw AND a.subtw = b.subtw AND a.seg_id < b.seg_id GROUP BY ALL),
sims AS MATERIALIZED (SELECT c.tw, c.src, c.dst, sum(c.cos) / any_value(m) * any_value(a.share) * any_value(b.share) AS cos FROM cosine c JOIN both_ USING (tw, src, dst)
JOIN shares a ON a.tw = c.tw AND a.seg_id = c.src AND a.subtw = last JOIN shares b ON b.tw = c.tw AND b.seg_id = c.dst AND b.subtw = last GROUP BY c.tw, c.src, c.dst)"""
KNN = """dir AS (SELECT tw, src AS node, dst AS nbr, cos AS sim FROM {0} UNION ALL SELECT tw, dst, src, cos FROM {0}),
knn AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tw, node ORDER BY round(sim, 9) DESC, nbr) AS rk FROM dir WHERE sim > 0) WHERE rk <= 5)"""
MUTUAL = "mut AS MATERIALIZED (SELECT a.tw, a.node, a.nbr, a.sim, a.rk FROM knn a JOIN knn b ON a.tw = b.tw AND a.node = b.nbr AND a.nbr = b.node)"
GRAMS = f"""h AS (SELECT news_id, {PIECES.replace('text', 'headline')} AS ws FROM news WHERE headline IS NOT NULL),
g AS (SELECT DISTINCT news_id, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT news_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM h), range(1, 6) r(k) WHERE i + k - 1 <= len(ws)),
grams AS (SELECT gram, ln(count(*) / (SELECT count(*) FROM h)) AS logp FROM g GROUP BY gram)"""
# The greedy clusters, step by step: each mutual link in the order of visits, and each node by itself after its links.
GREEDY = """steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tw ORDER BY node, ord) AS pos FROM (SELECT tw, node, nbr, sim, rk AS ord FROM mut UNION ALL SELECT tw, seg_id, seg_id, 0.0, 1000000 FROM ranked)),
walk AS (SELECT tw, 0::BIGINT AS pos, list_transform(range(max(seg_id) + 1), lambda x: NULL::BIGINT) AS ev, list_transform(range(max(seg_id) + 1), lambda x: NULL::BIGINT) AS par, list_transform(range(max(seg_id) + 1), lambda x: 0.0::DOUBLE) AS es FROM ranked GROUP BY tw
UNION ALL SELECT w.tw, s.pos, CASE WHEN ev[nbr + 1] IS NOT NULL THEN ev ELSE list_transform(ev, lambda x, i: CASE WHEN i = nbr + 1 OR i = node + 1 THEN coalesce(ev[node + 1], node) ELSE x END) END,
CASE WHEN ev[nbr + 1] IS NOT NULL OR nbr = node THEN par ELSE list_transform(par, lambda x, i: CASE WHEN i = nbr + 1 THEN node ELSE x END) END,
CASE WHEN ev[nbr + 1] IS NOT NULL OR nbr = node THEN es ELSE list_transform(es, lambda x, i: CASE WHEN i = nbr + 1 THEN sim ELSE x END) END
FROM walk w JOIN steps s ON s.tw = w.tw AND s.pos = w.pos + 1),
ends AS (SELECT w.* FROM walk w JOIN (SELECT tw, max(pos) AS pos FROM steps GROUP BY tw) USING (tw, pos)),
one AS (SELECT tw, unnest(ev) AS event_id, unnest(range(len(ev))) AS node, unnest(es) AS edge_sim, unnest(par) AS par FROM ends),
tied AS (SELECT tw, node, count(*) AS links FROM (SELECT tw, node FROM one WHERE par IS NOT NULL UNION ALL SELECT tw, par FROM one WHERE par IS NOT NULL) GROUP BY ALL),
clusters AS MATERIALIZED (SELECT one.tw, event_id, one.node, edge_sim, coalesce(links, 0)::INT AS links FROM one LEFT JOIN tied USING (tw, node))"""
CLUSTERS = f"{TOP.replace('WITH', 'WITH RECURSIVE', 1)}, {_vector_sql()}, {G4_SIM}, {KNN.format('sims')}, {MUTUAL}, {GREEDY}"
NAMED = "named AS (SELECT c.*, unit, coalesce(exp(exp(logp)), 0) AS news FROM clusters c JOIN ranked r ON r.tw = c.tw AND r.seg_id = c.node LEFT JOIN grams ON gram = unit)"
EVENTS = f"""{CLUSTERS}, {GRAMS}, {NAMED},
sums AS (SELECT tw, event_id, count(*) AS n_nodes, (sum(links) / 2)::INT AS n_edges, sum(news) / count(*) * sum(edge_sim) / count(*) AS score FROM named GROUP BY ALL),
events_ AS MATERIALIZED (SELECT *, floor(ratio) < 2 OR rk <= 5 AS kept FROM (SELECT *, max(score) OVER (PARTITION BY tw) / score AS ratio, row_number() OVER (PARTITION BY tw ORDER BY round(score, 9) DESC, event_id) AS rk FROM sums WHERE score > 0))"""
MATCH = f"""{EVENTS}, ke AS MATERIALIZED (SELECT * FROM events_ WHERE kept), kw AS (SELECT DISTINCT tw, event_id, ratio, unit FROM named JOIN ke USING (tw, event_id)),
gold AS (SELECT gold_id, tw AS day, unnest(list_distinct(lemmas)) AS unit FROM gold_events WHERE lemmas IS NOT NULL),
met AS (SELECT tw, event_id, ratio, gold_id, day FROM kw JOIN gold USING (unit) GROUP BY ALL HAVING count(*) >= 2)"""
UP = "unnest(range(ceil(round(ratio, 9))::BIGINT, 11)) AS up_to"
WORTH = """parts AS (SELECT unit, unnest(string_split(unit, '|')) AS slot, generate_subscripts(string_split(unit, '|'), 1) AS k FROM u),
pw AS (SELECT unit, k, list_filter(string_split_regex(slot, '[ _]+'), lambda x: x <> '') AS ws FROM parts),
cut AS (SELECT unit, k, len(ws) AS m, array_to_string(ws[i:j], ' ') AS gram FROM (SELECT unit, k, ws, unnest(range(1, len(ws) + 1)) AS i FROM pw), range(1, 20) r(j) WHERE j >= i AND j <= len(ws)),
sl AS (SELECT unit, k, max(CASE WHEN logp IS NULL THEN 0 WHEN m > 1 THEN exp(exp(logp)) - 1 ELSE exp(exp(logp)) END) AS news FROM cut LEFT JOIN grams USING (gram) GROUP BY ALL)"""
PHRASES = f"ph AS (SELECT replace(gram, ' ', '_') AS unit FROM (SELECT gram, string_split(gram, ' ') AS p FROM g) WHERE len(p) BETWEEN 2 AND 3 AND len(list_filter(p, lambda x: NOT (length(x) > 2 AND NOT regexp_matches(x, '[^a-z0-9_''-]') AND regexp_matches(x, '^[a-z0-9]') AND NOT list_contains({STOP}, x) AND NOT regexp_matches(x, '^[0-9]+$')))) = 0 AND list_sum(list_transform(p, lambda x: length(x))) // len(p) >= 4)"

SQL = {
    "document_frequency": f"{W} SELECT unit, tw, count(*) AS df FROM rows_ GROUP BY unit, tw",
    "window_sizes": f"WITH {TWEETS} SELECT * FROM n",
    "unit_probability": f"{W}, {BURST} SELECT unit, round(ps, 6) AS ps, days FROM ps",
    "users_per_unit": f"{W}, {USERS} SELECT * FROM us",
    "burst_words_topk": f"{W}, {BURST}, {_ranked('burst', 'z', G4)} SELECT tw, unit, df, n_t, round(e, 6) AS e, round(z, 6) AS z, rk FROM ranked",
    "burst_elements_topk": f"WITH {TWEETS}, {ELEMENTS}, {BURST}, {_ranked('burst', 'z', G4)} SELECT tw, unit, df, round(e, 6) AS e, round(z, 6) AS z, rk FROM ranked",
    "burst_weighted_users": f"{W}, {BURST}, {USERS}, wu AS (SELECT burst.*, users, pb * log10(users) AS weight FROM burst JOIN us USING (unit, tw)), {_ranked('wu', 'weight', 'floor(sqrt(n_t))::BIGINT + 1')} SELECT tw, unit, users, round(weight, 6) AS weight, rk FROM ranked",
    "burst_z_users": f"{W}, {BURST}, {USERS}, wu AS (SELECT burst.*, users, z * log10(users) AS weight FROM burst JOIN us USING (unit, tw) WHERE df >= 10 AND users >= 5), {_ranked('wu', 'weight', '220')} SELECT tw, unit, df, users, round(weight, 6) AS weight, rk FROM ranked",
    "burst_two_list": f"{W}, {BURST}, {USERS}, two AS (SELECT burst.*, users, row_number() OVER (PARTITION BY tw ORDER BY users DESC, unit) AS ru, row_number() OVER (PARTITION BY tw ORDER BY round(z, 9) DESC, unit) AS rz FROM burst JOIN us USING (unit, tw)), both_ AS (SELECT *, row_number() OVER (PARTITION BY tw ORDER BY rz) AS rk FROM two WHERE ru <= 440 AND rz <= 440) SELECT tw, unit, users, round(z, 6) AS z, rk FROM both_ WHERE rk <= 220",
    "burst_event_types": f"WITH rows_ AS (SELECT ts::DATE AS tw, event_type AS unit FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL), n AS (SELECT tw, count(*) AS n_t FROM rows_ GROUP BY tw), {BURST} SELECT tw, unit, df, round(e, 6) AS e, round(z, 6) AS z, round(pb, 6) AS pb FROM burst",
    "top_lexical_burst": f"WITH {TWEETS}, {FRAMES}, lu AS (SELECT DISTINCT kept.tw, subtw, tid, usr, verb, regexp_replace(verb, '(ing|ed|s)$', '') AS unit FROM fm JOIN kept ON id_str = tid WHERE verb <> ''), rows_ AS (SELECT DISTINCT tw, subtw, tid, usr, unit FROM lu), {BURST}, us AS (SELECT DISTINCT tw, verb, unit FROM lu) SELECT tw, verb || '.v' AS unit, unit AS frame, df, round(e, 6) AS e, round(z, 6) AS z FROM burst JOIN us USING (tw, unit)",
    "sub_window_weights": f"{W}, {BURST}, {_ranked('burst', 'z', G4)}, {CTX}, {SHARES} SELECT tw, seg_id, subtw, df_sub, round(share, 6) AS share FROM shares",
    "word_df_by_window": f"WITH {TWEETS}, {OCC} SELECT * FROM wdf",
    "data_windows": f"WITH RECURSIVE {TWEETS}, {STARTS} SELECT tw, string_agg(m::VARCHAR, ' ' ORDER BY m) AS starts FROM starts GROUP BY tw",
    "tfidf_vectors": f"{TOP}, {_vector_sql()} SELECT tw, seg_id, subtw, word, round(w, 6) AS w, round(norm, 6) AS norm FROM vec",
    "tfidf_vectors_corpus": f"{SET}, {_vector_sql(corpus=True)} SELECT tw, seg_id, subtw, word, round(w, 6) AS w, round(norm, 6) AS norm FROM vec",
    "supported_vectors": f"{TOP.replace(CTX, CTX.replace('ctx AS', 'every AS') + ', ctx AS (SELECT * FROM every SEMI JOIN (SELECT tw, seg_id FROM every GROUP BY ALL HAVING count(*) >= 3) USING (tw, seg_id))')}, {_vector_sql()} SELECT tw, seg_id, subtw, word, round(w, 6) AS w, round(norm, 6) AS norm FROM vec",
    "pair_similarity_g1": f"{TOP}, {_vector_sql()} {G2_SIM}",
    "pair_similarity_g2": f"{SET}, {_vector_sql(corpus=True)} {G2_SIM}",
    "pair_similarity_g4": f"{TOP}, {_vector_sql()}, {G4_SIM} SELECT tw, src, dst, round(cos, 6) AS sim FROM sims",
    "pair_similarity_text": f"{TOP}, {_vector_sql('0')} SELECT tw, src, dst, round(cos, 6) AS sim FROM cosine",
    "nearest_neighbours": f"{TOP}, {_vector_sql('0')}, {KNN.format('cosine')} SELECT tw, node, nbr, round(sim, 6) AS sim, rk FROM knn",
    "mutual_neighbours": f"{TOP}, {_vector_sql('0')}, {KNN.format('cosine')}, {MUTUAL} SELECT tw, node, nbr, round(sim, 6) AS sim, rk FROM mut",
    "gram_table": f"WITH {GRAMS} SELECT gram, logp FROM grams",
    "newsworthiness": f"{W}, {FRAMES}, {GRAMS}, {PHRASES}, u AS (SELECT unit FROM rows_ UNION SELECT unit FROM ph UNION SELECT arg1 || '|' || verb || '|' || arg2 FROM fm), {WORTH}, w AS (SELECT unit, round(sum(news), 6) AS news FROM sl GROUP BY unit) SELECT * FROM w WHERE news > 0",
    "frame_worth_mean": f"WITH {FRAMES}, {GRAMS}, u AS (SELECT DISTINCT arg1 || '|' || verb || '|' || arg2 AS unit FROM fm), {WORTH}, w AS (SELECT unit, round(sum(news) / 3, 6) AS news FROM sl GROUP BY unit) SELECT * FROM w WHERE news > 0",
    "event_clusters": f"{CLUSTERS} SELECT tw, event_id, node, round(edge_sim, 6) AS edge_sim, links FROM clusters",
    "large_event_clusters": f"{CLUSTERS}, big AS (SELECT tw, event_id, count(*) AS n_nodes FROM clusters GROUP BY ALL HAVING count(*) >= 2) SELECT tw, event_id, node, round(edge_sim, 6) AS edge_sim, links, n_nodes FROM clusters JOIN big USING (tw, event_id)",
    "event_sizes": f"{CLUSTERS} SELECT n_nodes, count(*) AS n FROM (SELECT tw, event_id, count(*) AS n_nodes FROM clusters GROUP BY ALL) GROUP BY n_nodes",
    "cluster_frequency": f"{CLUSTERS} SELECT event_id AS cluster, rows_.tw, count(DISTINCT tid) AS df, count(DISTINCT usr) AS users FROM rows_ JOIN ranked USING (tw, unit) JOIN clusters c ON c.tw = ranked.tw AND c.node = ranked.seg_id GROUP BY 1, 2",
    "event_scores": f"{EVENTS} SELECT tw, event_id, n_nodes, n_edges, round(score, 6) AS score, round(ratio, 6) AS ratio, rk, kept FROM events_",
    "event_members": f"{EVENTS}, m AS (SELECT tw, event_id, string_agg(unit, ' ' ORDER BY links DESC, unit) AS by_links, string_agg(unit, ' ' ORDER BY round(news, 9) DESC, unit) AS by_news FROM named GROUP BY ALL) SELECT tw, event_id, by_links, by_news, rk, n_nodes, n_edges FROM m JOIN events_ USING (tw, event_id) WHERE kept",
    "event_ratio_histogram": f"{EVENTS}, w AS (SELECT floor(ratio)::INT AS ratio, count(*) AS n FROM events_ WHERE floor(ratio) <= 10 GROUP BY 1) SELECT ratio, n, (sum(n) OVER (ORDER BY ratio))::BIGINT AS running FROM w",
    "event_recall": f"{MATCH}, s AS (SELECT count(DISTINCT gold_id) AS gm, count(DISTINCT tw::VARCHAR || '-' || event_id) AS em FROM met) SELECT gm AS gold_matched, em AS events_matched, round(gm / (SELECT count(*) FROM gold_events WHERE lemmas IS NOT NULL), 6) AS recall, round(em / (SELECT count(*) FROM ke), 6) AS precision FROM s",
    "event_precision_by_ratio": f"{MATCH}, plain AS (SELECT * FROM ke WHERE NOT EXISTS (SELECT 1 FROM kw WHERE kw.tw = ke.tw AND kw.event_id = ke.event_id AND list_contains({SIGNS}, unit))), tags AS (SELECT tw, event_id, ratio, EXISTS (SELECT 1 FROM met WHERE met.tw = plain.tw AND met.event_id = plain.event_id AND day = met.tw) AS v FROM plain), e AS (SELECT tw, v, {UP} FROM tags), dd AS (SELECT up_to, tw, count(*) AS n, count_if(v) AS t, count_if(NOT v) AS f FROM e GROUP BY ALL) SELECT up_to::INT AS up_to, sum(n)::BIGINT AS n, sum(t)::BIGINT AS n_true, sum(f)::BIGINT AS n_false, 0::BIGINT AS n_doubt, round(sum(t) / sum(n), 6) AS precision, round(avg(t / n), 6) AS mean_precision FROM dd GROUP BY up_to",
    "event_repeats_by_ratio": f"{MATCH}, e AS (SELECT gold_id, {UP} FROM met), c AS (SELECT up_to, gold_id, count(*) AS n FROM e GROUP BY ALL) SELECT up_to::INT AS up_to, sum(n)::BIGINT AS n_true, count(*) AS distinct, count_if(n > 1) AS repeated, round(count_if(n > 1) / sum(n), 6) AS share FROM c GROUP BY up_to",
    "event_news": f"{MATCH}, x AS (SELECT news_id, tw, unnest(list_distinct(ws)) AS unit FROM (SELECT news_id, tw, {PIECES.replace('text', 'headline')} AS ws FROM news WHERE headline IS NOT NULL)), hit AS (SELECT DISTINCT tw, event_id FROM (SELECT kw.tw, event_id, news_id FROM kw JOIN x ON x.tw = kw.tw AND x.unit = kw.unit GROUP BY ALL HAVING count(*) >= 2)), dd AS (SELECT ke.tw, count(*) AS e, count(hit.event_id) AS m FROM ke LEFT JOIN hit USING (tw, event_id) GROUP BY ke.tw), bb AS (SELECT dd.*, h FROM dd LEFT JOIN (SELECT tw, count(*) AS h FROM news WHERE headline IS NOT NULL GROUP BY tw) USING (tw)) SELECT sum(e)::BIGINT AS events, sum(m)::BIGINT AS matched, sum(h)::BIGINT AS headlines, round(sum(m) / sum(e), 6) AS precision, round(sum(m) / sum(h), 6) AS recall, round(avg(m / e), 6) AS mean_precision, round(avg(m / h), 6) AS mean_recall FROM bb",
    "bursty_frame_pairs": f"{TOP}, {_vector_sql()}, {G4_SIM}, {FRAMES}, ff AS (SELECT DISTINCT tw, arg1, verb, arg2 FROM fm), nf AS (SELECT ff.tw, arg1 || '|' || verb || '|' || arg2 AS frame, a.seg_id AS s0, b.seg_id AS s1, c.seg_id AS s2 FROM ff LEFT JOIN ranked a ON a.tw = ff.tw AND a.unit = arg1 LEFT JOIN ranked b ON b.tw = ff.tw AND b.unit = verb LEFT JOIN ranked c ON c.tw = ff.tw AND c.unit = arg2), kf AS (SELECT * FROM nf WHERE (s0 IS NOT NULL)::INT + (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT >= 2), fp AS (SELECT x.tw, x.frame AS src, y.frame AS dst, "
    + " + ".join(f"CASE WHEN x.s{k} IS NULL OR y.s{k} IS NULL THEN 0 WHEN x.s{k} = y.s{k} THEN 1 ELSE coalesce(p{k}.cos, 0) END" for k in range(3))
    + " AS sim, "
    + " + ".join(f"CASE WHEN x.s{k} IS NULL OR y.s{k} IS NULL THEN 0 WHEN x.s{k} = y.s{k} THEN 1 ELSE (p{k}.cos IS NOT NULL)::INT END" for k in range(3))
    + " AS met FROM kf x JOIN kf y ON x.tw = y.tw AND x.frame < y.frame "
    + " ".join(f"LEFT JOIN sims p{k} ON p{k}.tw = x.tw AND p{k}.src = least(x.s{k}, y.s{k}) AND p{k}.dst = greatest(x.s{k}, y.s{k})" for k in range(3))
    + ") SELECT tw, src, dst, round(sim, 6) AS sim FROM fp WHERE met > 0",
}


def rounded_twice(sql: str) -> str:
    """round(x, 6) as _rounded does it."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 6 : end - 4]
        if sql[end - 4 : end] == ", 6)" and not inner.startswith("round("):
            sql = f"{sql[:at]}round(round({inner}, 9) + 1e-10, 6){sql[end:]}"
        at += 6
    return sql


SQL = {name: rounded_twice(sql) for name, sql in SQL.items()}
