"""Evaluation queries: matching, precision, recall, agreement, interleaving, comparison of lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from burstline.functions import text as T
from burstline.operators import evaluate as E
from burstline.operators.graph import connected_components
from burstline.operators.similarity import slot_unit
from burstline.session import stored
from burstline.sources.tables import table

from . import detect as D
from .detect import BURST, PIECES, STOP, USERS, WORDS, _ranked
from .detect import TWEETS as BASE


def gold_tweets(spark, d):
    """Tweets of a gold event's day that share two lemmas or more with it."""
    t = D.tweets(spark, d).where("text is not null and tw is not null").select("id_str", "tw", T.words(F.col("text")).alias("ws"))
    g = table(spark, d, "gold_events").where("lemmas is not null").select("gold_id", "tw", "lemmas")
    return E.overlap_join(g, "gold_id", "lemmas", t, "id_str", "ws", 2, ["tw"])


def gold_headlines(spark, d):
    """Headlines of the day that share more than one word with a gold event, repeats counted."""
    n = table(spark, d, "news").where("headline is not null").select("news_id", "tw", T.words(F.col("headline")).alias("ws"))
    g = table(spark, d, "gold_events").where("lemmas is not null").select("gold_id", "tw", "lemmas")
    return E.overlap_join(g, "gold_id", "lemmas", n, "news_id", "ws", 2, ["tw"], distinct=False)


def headline_recall(spark, d):
    """Headlines as output, gold events as truth, without regard to days."""
    n = table(spark, d, "news").where("headline is not null").select("news_id", T.words(F.col("headline")).alias("ws"))
    g = table(spark, d, "gold_events").where("lemmas is not null")
    m = E.overlap_join(n, "news_id", "ws", g, "gold_id", "lemmas", 2)
    return E.recall_precision(m, n.agg(F.count("*").alias("n")).scalar(), g.agg(F.count("*").alias("n")).scalar(), "news_id", "gold_id")


def label_precision(spark, d):
    return E.label_precision(table(spark, d, "event_labels"), "annotator")


def duplicate_rate(spark, d):
    return E.duplicate_rate(table(spark, d, "event_labels"), "event_id")


def annotator_agreement(spark, d):
    return E.pairwise_agreement(table(spark, d, "event_labels"), "event_id", "annotator")


def label_disagreements(spark, d):
    """Events of which annotators say different things."""
    v = table(spark, d, "event_labels").select("event_id", "annotator", E.verdict(F.col("tag")).alias("v")).where("v is not null")
    return v.groupBy("event_id").agg(F.count_distinct("v").alias("kinds"), F.count_if("v").alias("yes"), F.count_if(~F.col("v")).alias("no")).where("kinds > 1")


def gold_coverage(spark, d):
    """Labelled events that are gold, labelled ones that are not, gold ones without a label."""
    a = table(spark, d, "event_labels").select(F.col("event_id").alias("id")).distinct().withColumn("a", F.lit(True))
    g = table(spark, d, "gold_events").select(F.col("gold_id").alias("id")).distinct().withColumn("g", F.lit(True))
    side = F.when(F.col("a") & F.col("g"), "both").when(F.col("a"), "label only").otherwise("gold only")
    return a.join(g, "id", "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def _two_lists(spark, d):
    rows = D.word_rows(spark, d)
    both = D._with_users(rows, D.U.window_sizes(D.tweets(spark, d))).withColumn("weight", F.col("pb") * F.log10("users"))
    cfg = D.Config(budget=220)
    return D.U.top_units(both, "z", cfg), D.U.top_units(both, "weight", cfg)


def compare_lists(spark, d):
    """Units that two rankings of a window share, or that one of them alone has; 220 a list."""
    z, w = _two_lists(spark, d)
    a, b = z.select("tw", "unit", F.lit(True).alias("a")), w.select("tw", "unit", F.lit(True).alias("b"))
    side = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "z only").otherwise("weight only")
    return a.join(b, ["tw", "unit"], "full").select("tw", "unit", side.alias("side"))


def interleaved_lists(spark, d):
    """The two lists of each day by turns."""
    z, w = _two_lists(spark, d)
    return E.interleave(z, w, "rk", "unit", ("z", "weight"), "tw")


def frames_of_element(spark, d):
    """The ten most frequent frames of each element, and which of them is the most frequent. The rank is bounded in the
    plan, so each task hands on ten rows of an element at most, however many frames it has."""
    f = table(spark, d, "frames").where("frames is not null").select(F.explode("frames").alias("f"))
    frame = F.concat_ws("|", F.coalesce("f.arg1", F.lit("")), F.coalesce("f.verb", F.lit("")), F.coalesce("f.arg2", F.lit("")))
    each = f.select(frame.alias("frame"), F.explode(F.array_distinct(F.array("f.arg1", "f.verb", "f.arg2"))).alias("element")).where("element <> ''")
    n = each.groupBy("element", "frame").agg(F.count("*").alias("n"))
    order = Window.partitionBy("element").orderBy(F.desc("n"), "frame")
    return n.withColumn("rk", F.row_number().over(order)).where("rk <= 10")


def element_back_mapping(spark, d):
    """Each bursty element with its most frequent frame; itself where there is none."""
    top = frames_of_element(spark, d).where("rk = 1").select(F.col("element").alias("unit"), "frame")
    bursty = D.burst_elements_topk(spark, d).select("tw", "unit", "rk")
    return bursty.join(top, "unit", "left").select("tw", "unit", "rk", F.coalesce("frame", "unit").alias("frame"))


def frequent_verbs(spark, d):
    """Verbs of more than five frames."""
    f = table(spark, d, "frames").where("frames is not null").select(F.explode("frames.verb").alias("verb")).where("verb <> ''")
    return f.groupBy("verb").agg(F.count("*").alias("n")).where("n > 5")


def frame_arity(spark, d):
    f = table(spark, d, "frames").where("frames is not null").select(F.explode("frames").alias("f"))
    filled = sum((F.coalesce(F.col(f"f.{s}"), F.lit("")) != "").cast("int") for s in ("arg1", "verb", "arg2"))
    return f.groupBy(filled.alias("filled")).agg(F.count("*").alias("n"))


def bursty_frames(spark, d):
    """Complete frames all slots of which are bursty on their day."""
    b = D.burst_elements_topk(spark, d).select("tw", "unit")
    f = table(spark, d, "frames").where("frames is not null").select("tw", "id_str", F.explode("frames").alias("f")).where("f.arg1 <> '' and f.verb <> '' and f.arg2 <> ''")
    out = f.select("tw", "id_str", "f.arg1", "f.verb", "f.arg2")
    for slot in ("arg1", "verb", "arg2"):
        out = out.join(b.withColumnRenamed("unit", slot), ["tw", slot], "left_semi")
    return out.select("tw", "id_str", "arg1", "verb", "arg2").distinct()


def relation_pairs(spark, d):
    """Pairs of frames inside a tweet, each pair once, as relations."""
    return D.U.relation_pairs(_relations(spark, d)).select("tw", "tid", "a", "b")


def _relations(spark, d):
    f = table(spark, d, "frames").where("frames is not null").select("tw", F.col("id_str").alias("tid"), F.explode("frames").alias("f"))
    return f.select("tw", "tid", F.coalesce("f.verb", F.lit("")).alias("unit")).where("unit <> ''").distinct()


def skeleton_frequency(spark, d):
    return D.U.skeleton_frequency(relation_pairs(spark, d))


def skeleton_burst(spark, d):
    """Tweets whose skeleton is bursty: over frames' verbs as relations, two of them or more."""
    pairs = stored(relation_pairs(spark, d))
    sizes = pairs.groupBy("tw").agg(F.count_distinct("tid").alias("n_t"))
    users = D.tweets(spark, d).select(F.col("id_str").alias("tid"), F.col("user_id_str").alias("usr"))
    out = D.U.skeleton_burst(pairs, users, sizes)
    return D._rounded(out.select("tw", "tid", "df", "n_t", "ps", "users", "weight"), "ps", "weight")


def burst_tagged_elements(spark, d):
    """Bursts of frames' slots with verbs told apart from arguments by a mark."""
    f = D._frames(spark, d).where("arg1 <> '' or arg2 <> ''")
    slots = F.array("arg1", F.when(F.col("verb") != "", slot_unit(F.col("verb"), 1)), "arg2")
    each = f.select("tid", F.explode(F.filter(slots, lambda x: x.isNotNull() & (x != ""))).alias("unit")).distinct()
    t = D.tweets(spark, d).where("tw is not null").select("tw", "subtw", F.col("id_str").alias("tid"), F.col("user_id_str").alias("usr"))
    scored = D._burst(t.join(each, "tid"), D.U.window_sizes(D.tweets(spark, d)))
    return D._rounded(D.U.top_units(scored, "z", D.CFG), "e", "z").select("tw", "unit", "df", "e", "z", "rk")


def gap_elements(spark, d):
    """Elements of frames up to the first empty slot, with the tweets that have each on each day."""
    f = D._frames(spark, d)
    slots = F.when(F.col("arg1") == "", F.array()).when(F.col("verb") == "", F.array("arg1")).when(F.col("arg2") == "", F.array("arg1", "verb")).otherwise(F.array("arg1", "verb", "arg2"))
    return f.select("tw", "tid", F.explode(slots).alias("unit")).distinct().groupBy("unit", "tw").agg(F.count("*").alias("df"))


def frequent_frames(spark, d):
    """Complete frames that five tweets or more of all days have."""
    f = D._frames(spark, d).where("arg1 <> '' and verb <> '' and arg2 <> ''").select("tw", "tid", F.concat_ws("|", "arg1", "verb", "arg2").alias("unit")).distinct()
    return D.U.frequent_units(f.groupBy("unit", "tw").agg(F.count("*").alias("df")), 5)


def fuzzy_frequency(spark, d):
    """Tweets of each frame with those of the frames that agree with it in two slots."""
    return D.U.fuzzy_frequency(D._frames(spark, d))


def all_users(spark, d):
    """Distinct users of each day and of all days (null)."""
    each = D.tweets(spark, d).where("tw is not null and user_id_str is not null").select("tw", "user_id_str").distinct()
    return each.groupBy("tw").agg(F.count("*").alias("users")).unionByName(each.agg(F.count_distinct("user_id_str").alias("users")).select(F.lit(None).cast("date").alias("tw"), "users"))


def words_per_unit(spark, d):
    """Frames and words by the number of words that they are made of."""
    units = D._frames(spark, d).select(F.concat_ws("|", "arg1", "verb", "arg2").alias("unit")).where("unit <> '||'").unionByName(D.word_rows(spark, d).select("unit")).distinct()
    n = F.size(F.filter(F.split("unit", "[|_ ]"), lambda w: w != ""))
    return units.groupBy(n.alias("n_words")).agg(F.count("*").alias("units"))


def expected_on_last_day(spark, d):
    """Units of the last day with their tweets on each day before, what these lead one to expect of it, and its z."""
    sizes = D.U.window_sizes(D.tweets(spark, d))
    last = sizes.agg(F.max("tw").alias("m")).scalar()
    known = D.U.document_frequency(D.word_rows(spark, d)).join(F.broadcast(sizes), "tw")
    own = F.col("tw") == last
    units = known.groupBy("unit").agg(
        F.max(F.when(own, F.col("df"))).alias("df"), F.max(F.when(own, F.col("n_t"))).alias("n_t"), F.avg(F.when(~own, F.col("df") / F.col("n_t"))).alias("p"), F.count_if(~own).alias("days")
    )
    e = F.col("n_t") * F.col("p")
    z = F.try_divide(F.col("df") - e, F.sqrt(e * (1 - F.col("p"))))
    return D._rounded(units.where("df is not null and days > 0").select("unit", "df", "days", e.alias("e"), z.alias("z")), "e", "z")


def frame_components(spark, d):
    """Elements that frames tie together: connected components over the pairs of arguments."""
    f = table(spark, d, "frames").where("frames is not null").select(F.explode("frames").alias("f")).where("f.arg1 <> '' and f.arg2 <> ''")
    return connected_components(f.select("f.arg1", "f.arg2"), "arg1", "arg2")


def units_of_last_day(spark, d):
    """Mean probability over all days, of the units that the last day has."""
    rows = D.word_rows(spark, d)
    sizes, df = D.U.window_sizes(D.tweets(spark, d)), D.U.document_frequency(rows)
    last = sizes.agg(F.max("tw").alias("m")).scalar()
    p = df.join(F.broadcast(sizes), "tw").groupBy("unit").agg(F.round(F.avg(F.col("df") / F.col("n_t")), 6).alias("ps"), F.count("*").alias("days"), F.max("tw").alias("latest"))
    return p.where(F.col("latest") == last).select("unit", "ps", "days")


def frequency_series(spark, d):
    """The frequency of each lemma of the gold events on each day that has it, as a list in the order of days."""
    lemmas = table(spark, d, "gold_events").where("lemmas is not null").select(F.explode("lemmas").alias("unit")).distinct()
    df = D.U.document_frequency(D.word_rows(spark, d).join(lemmas, "unit", "left_semi"))
    return df.groupBy("unit").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tw", "df"))), lambda x: F.concat_ws(":", x["tw"].cast("string"), x["df"].cast("string"))), " ").alias("series"))


def predefined_probability(spark, d):
    """Probability of given units only, cash tags among them: the average over all days, days without them counted."""
    t = D.tweets(spark, d)
    days = t.where("tw is not null").agg(F.count_distinct("tw").alias("n")).scalar()
    df = D.U.document_frequency(D.word_rows(spark, d).where(F.col("unit").startswith("$")))
    return df.join(F.broadcast(D.U.window_sizes(t)), "tw").groupBy("unit").agg(F.round(F.sum(F.col("df") / F.col("n_t")) / days, 8).alias("mean"))


def merged_units(spark, d):
    """Words and frames of a tweet in one text: both joined; frames alone stay; words alone are left out."""
    f = table(spark, d, "frames").where("frames is not null").select("id_str", F.explode("frames").alias("f")).where("f.verb <> ''")
    frames = f.groupBy("id_str").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", F.coalesce("f.arg1", F.lit("")), "f.verb", F.coalesce("f.arg2", F.lit(""))))), " ").alias("frames"))
    words = D.tweets(spark, d).where("text is not null").select("id_str", F.array_join(T.without(T.words(F.col("text"))), " ").alias("words"))
    return frames.join(words, "id_str", "left").select("id_str", F.concat_ws(" ", "words", "frames").alias("units"))


def sub_window_counts(spark, d):
    """Tweets by day and two-hour window, with the share of the day."""
    t = D.tweets(spark, d).where("ts is not null")
    n = t.groupBy(F.to_date("ts").alias("tw"), T.sub_window(F.col("ts")).alias("subtw")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("tw")), 6))


QUERIES = {
    f.__name__: f
    for f in (
        units_of_last_day, frequency_series, predefined_probability, merged_units, sub_window_counts,
        gold_tweets, gold_headlines, headline_recall, label_precision, duplicate_rate, annotator_agreement, label_disagreements, gold_coverage, compare_lists, interleaved_lists, burst_tagged_elements, gap_elements, frequent_frames, fuzzy_frequency, skeleton_burst, all_users, words_per_unit, expected_on_last_day,
        frames_of_element, element_back_mapping, frequent_verbs, frame_arity, bursty_frames, relation_pairs, skeleton_frequency, frame_components,
    )
}

V = "v AS (SELECT *, CASE WHEN upper(tag) IN ('T', 'M') THEN true WHEN upper(tag) = 'F' THEN false END AS v FROM event_labels)"
FR = "fr AS (SELECT tw, id_str, unnest(frames) AS f FROM frames WHERE frames IS NOT NULL)"
TWO = f"WITH {BASE}, {WORDS}, {BURST}, {USERS}, wu AS (SELECT burst.*, users, pb * log10(users) AS weight FROM burst JOIN us USING (unit, tw)), {_ranked('wu', 'z', '220').replace('ranked AS', 'za AS')}, {_ranked('wu', 'weight', '220').replace('ranked AS', 'wb AS')}"
FOE = f"{FR}, e AS (SELECT coalesce(f.arg1, '') || '|' || coalesce(f.verb, '') || '|' || coalesce(f.arg2, '') AS frame, unnest(list_distinct([f.arg1, f.verb, f.arg2])) AS element FROM fr), c AS (SELECT element, frame, count(*) AS n FROM e WHERE element <> '' GROUP BY ALL), foe AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY element ORDER BY n DESC, frame) AS rk FROM c) WHERE rk <= 10)"
HW = f"{PIECES.replace('text', 'headline')}"
PAIRS = f"{FR}, rel AS (SELECT DISTINCT tw, id_str AS tid, f.verb AS u FROM fr WHERE f.verb <> ''), pairs AS (SELECT a.tw, a.tid, a.u AS a, b.u AS b FROM rel a JOIN rel b ON a.tw = b.tw AND a.tid = b.tid AND a.u < b.u)"
UNITS = f"WITH {BASE}, {WORDS}, df AS (SELECT unit, tw, count(*) AS df FROM rows_ GROUP BY unit, tw)"
SQL = {
    "units_of_last_day": f"{UNITS} SELECT unit, round(avg(df / n_t), 6) AS ps, count(*) AS days FROM df JOIN n USING (tw) GROUP BY unit HAVING max(tw) = (SELECT max(tw) FROM n)",
    "frequency_series": f"{UNITS}, l AS (SELECT DISTINCT unnest(lemmas) AS unit FROM gold_events) SELECT unit, string_agg(tw::VARCHAR || ':' || df, ' ' ORDER BY tw) AS series FROM df JOIN l USING (unit) GROUP BY unit",
    "predefined_probability": f"{UNITS} SELECT unit, round(sum(df / n_t) / (SELECT count(DISTINCT tw) FROM t WHERE tw IS NOT NULL), 8) AS mean FROM df JOIN n USING (tw) WHERE starts_with(unit, '$') GROUP BY unit",
    "merged_units": f"WITH {BASE}, {FR}, g AS (SELECT id_str, string_agg(coalesce(f.arg1, '') || '|' || f.verb || '|' || coalesce(f.arg2, ''), ' ' ORDER BY coalesce(f.arg1, '') || '|' || f.verb || '|' || coalesce(f.arg2, '')) AS frames FROM fr WHERE f.verb <> '' GROUP BY id_str), w AS (SELECT id_str, array_to_string(list_filter({PIECES}, lambda x: NOT list_contains({STOP}, x)), ' ') AS words FROM t WHERE text IS NOT NULL) SELECT g.id_str, concat_ws(' ', words, frames) AS units FROM g LEFT JOIN w USING (id_str)",
    "sub_window_counts": f"WITH {BASE}, e AS (SELECT ts::DATE AS tw, (hour(ts) // 2 + 1)::INT AS subtw, count(*) AS n FROM t WHERE ts IS NOT NULL GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY tw), 6) AS share FROM e",
    "gold_tweets": f"WITH {BASE}, g AS (SELECT gold_id, tw, unnest(list_distinct(lemmas)) AS w FROM gold_events), x AS (SELECT id_str, tw, unnest(list_distinct({PIECES})) AS w FROM t WHERE text IS NOT NULL AND tw IS NOT NULL) SELECT gold_id, id_str, count(*) AS common FROM g JOIN x USING (tw, w) GROUP BY ALL HAVING count(*) >= 2",
    "gold_headlines": f"WITH g AS (SELECT gold_id, tw, unnest(lemmas) AS w FROM gold_events), x AS (SELECT news_id, tw, unnest(list_distinct({HW})) AS w FROM news WHERE headline IS NOT NULL) SELECT gold_id, news_id, count(*) AS common FROM g JOIN x USING (tw, w) GROUP BY ALL HAVING count(*) >= 2",
    "headline_recall": f"WITH g AS (SELECT gold_id, unnest(list_distinct(lemmas)) AS w FROM gold_events), x AS (SELECT news_id, unnest(list_distinct({HW})) AS w FROM news WHERE headline IS NOT NULL), m AS (SELECT gold_id, news_id FROM g JOIN x USING (w) GROUP BY ALL HAVING count(*) >= 2), s AS (SELECT count(DISTINCT gold_id) AS gm, count(DISTINCT news_id) AS em FROM m) SELECT gm AS gold_matched, em AS events_matched, round(gm / (SELECT count(*) FROM gold_events WHERE lemmas IS NOT NULL), 6) AS recall, round(em / (SELECT count(*) FROM news WHERE headline IS NOT NULL), 6) AS precision FROM s",
    "label_precision": f"WITH {V}, e AS (SELECT annotator, count_if(v) AS t, count_if(NOT v) AS f, count_if(v IS NULL) AS d FROM v GROUP BY annotator) SELECT sum(t)::BIGINT AS n_true, sum(f)::BIGINT AS n_false, sum(d)::BIGINT AS n_doubt, round(sum(t) / (sum(t) + sum(f)), 6) AS pooled, round(avg(t / (t + f)), 6) AS mean_of_groups FROM e",
    "duplicate_rate": f"WITH {V}, e AS (SELECT event_id, count(*) AS n FROM v WHERE v GROUP BY event_id) SELECT count(*) AS distinct_true, count_if(n > 1) AS repeated, round(count_if(n > 1) / count(*), 6) AS share FROM e",
    "annotator_agreement": f"WITH {V}, j AS (SELECT event_id AS e, annotator AS who, max(v) AS v FROM v GROUP BY ALL HAVING max(v) IS NOT NULL AND annotator IS NOT NULL), c AS (SELECT a.who AS a, b.who AS b, count(*) AS n, count_if(a.v AND b.v) AS tt, count_if(a.v AND NOT b.v) AS tf, count_if(NOT a.v AND b.v) AS ft, count_if(NOT a.v AND NOT b.v) AS ff FROM j a JOIN j b ON a.e = b.e AND a.who < b.who GROUP BY ALL), k AS (SELECT *, (tt + ff) / n AS po, ((tt + tf) * (tt + ft) + (ff + tf) * (ff + ft)) / (n * n) AS pe FROM c) SELECT a, b, n, tt, tf, ft, ff, round(po, 6) AS agreement, CASE WHEN pe <> 1 THEN round((po - pe) / (1 - pe), 6) END AS kappa FROM k",
    "label_disagreements": f"WITH {V} SELECT event_id, count(DISTINCT v) AS kinds, count_if(v) AS yes, count_if(NOT v) AS no FROM v WHERE v IS NOT NULL GROUP BY event_id HAVING count(DISTINCT v) > 1",
    "gold_coverage": "WITH a AS (SELECT DISTINCT event_id AS id FROM event_labels), g AS (SELECT DISTINCT gold_id AS id FROM gold_events) SELECT CASE WHEN a.id IS NOT NULL AND g.id IS NOT NULL THEN 'both' WHEN a.id IS NOT NULL THEN 'label only' ELSE 'gold only' END AS side, count(*) AS n FROM a FULL JOIN g ON a.id = g.id GROUP BY 1",
    "compare_lists": f"{TWO} SELECT coalesce(za.tw, wb.tw) AS tw, coalesce(za.unit, wb.unit) AS unit, CASE WHEN za.unit IS NOT NULL AND wb.unit IS NOT NULL THEN 'both' WHEN za.unit IS NOT NULL THEN 'z only' ELSE 'weight only' END AS side FROM za FULL JOIN wb ON za.tw = wb.tw AND za.unit = wb.unit",
    "interleaved_lists": f"{TWO}, u AS (SELECT tw, 'z' AS system, rk AS rank, unit AS value FROM za UNION ALL SELECT tw, 'weight', rk, unit FROM wb) SELECT tw, system, rank, value, row_number() OVER (PARTITION BY tw ORDER BY rank, system) AS place FROM u",
    "burst_tagged_elements": f"WITH {BASE}, {D.FRAMES}, el AS (SELECT DISTINCT tid, unnest([arg1, CASE WHEN verb <> '' THEN verb || '_1' ELSE '' END, arg2]) AS unit FROM fm WHERE arg1 <> '' OR arg2 <> ''), rows_ AS (SELECT tw, subtw, tid, usr, unit FROM kept JOIN el ON tid = id_str WHERE unit <> ''), {BURST}, {_ranked('burst', 'z', D.G4)} SELECT tw, unit, df, round(e, 6) AS e, round(z, 6) AS z, rk FROM ranked",
    "gap_elements": f"WITH {D.FRAMES}, el AS (SELECT DISTINCT tw, tid, unnest(CASE WHEN arg1 = '' THEN [] WHEN verb = '' THEN [arg1] WHEN arg2 = '' THEN [arg1, verb] ELSE [arg1, verb, arg2] END) AS unit FROM fm) SELECT unit, tw, count(*) AS df FROM el GROUP BY unit, tw",
    "frequent_frames": f"WITH {D.FRAMES}, c AS (SELECT DISTINCT tw, tid, arg1 || '|' || verb || '|' || arg2 AS unit FROM fm WHERE arg1 <> '' AND verb <> '' AND arg2 <> ''), e AS (SELECT unit, tw, count(*) AS df FROM c GROUP BY ALL) SELECT unit, tw, df FROM e WHERE unit IN (SELECT unit FROM e GROUP BY unit HAVING sum(df) >= 5)",
    "fuzzy_frequency": f"WITH {D.FRAMES}, own AS (SELECT tw, arg1, verb, arg2, count(DISTINCT tid) AS df FROM fm GROUP BY ALL), kinds AS (SELECT DISTINCT arg1, verb, arg2 FROM fm), met AS (SELECT k.arg1, k.verb, k.arg2, o.tw, o.df FROM kinds k JOIN own o ON (k.arg1 = o.arg1 AND k.verb = o.verb AND k.arg1 <> '' AND k.verb <> '') OR (k.arg1 = o.arg1 AND k.arg2 = o.arg2 AND k.arg1 <> '' AND k.arg2 <> '') OR (k.verb = o.verb AND k.arg2 = o.arg2 AND k.verb <> '' AND k.arg2 <> '') OR (k.arg1 = o.arg1 AND k.verb = o.verb AND k.arg2 = o.arg2)) SELECT arg1, verb, arg2, tw, sum(df)::BIGINT AS df FROM met GROUP BY ALL",
    "all_users": f"WITH {BASE} SELECT tw, count(DISTINCT usr) AS users FROM kept WHERE usr IS NOT NULL GROUP BY tw UNION ALL SELECT NULL, count(DISTINCT usr) FROM kept",
    "words_per_unit": f"WITH {BASE}, {WORDS}, {D.FRAMES}, u AS (SELECT unit FROM rows_ UNION SELECT arg1 || '|' || verb || '|' || arg2 FROM fm WHERE arg1 || verb || arg2 <> '') SELECT len(list_filter(string_split_regex(unit, '[|_ ]'), lambda x: x <> ''))::INT AS n_words, count(*) AS units FROM u GROUP BY 1",
    "expected_on_last_day": f"{UNITS}, m AS (SELECT max(tw) AS last FROM n), k AS (SELECT df.unit, df.tw = last AS own, df, n_t FROM df JOIN n USING (tw), m), e AS (SELECT unit, max(df) FILTER (own) AS df, max(n_t) FILTER (own) AS n_t, avg(df / n_t) FILTER (NOT own) AS p, count_if(NOT own) AS days FROM k GROUP BY unit) SELECT unit, df, days, round(n_t * p, 6) AS e, round((df - n_t * p) / sqrt(n_t * p * (1 - p)), 6) AS z FROM e WHERE df IS NOT NULL AND days > 0",
    "element_back_mapping": f"WITH {BASE}, {D.ELEMENTS.replace('fr AS', 'fs AS', 1).replace('FROM fr WHERE', 'FROM fs WHERE')}, {BURST}, {_ranked('burst', 'z', D.G4)}, {FOE} SELECT ranked.tw, ranked.unit, ranked.rk, coalesce(foe.frame, ranked.unit) AS frame FROM ranked LEFT JOIN foe ON foe.element = ranked.unit AND foe.rk = 1",
    "bursty_frames": f"WITH {BASE}, {D.ELEMENTS}, {BURST}, {_ranked('burst', 'z', D.G4)}, {D.FRAMES} SELECT DISTINCT fm.tw, tid AS id_str, arg1, verb, arg2 FROM fm JOIN ranked a ON a.tw = fm.tw AND a.unit = arg1 JOIN ranked b ON b.tw = fm.tw AND b.unit = verb JOIN ranked c ON c.tw = fm.tw AND c.unit = arg2 WHERE arg1 <> '' AND verb <> '' AND arg2 <> ''",
    "skeleton_burst": f"WITH {BASE}, {PAIRS}, sz AS (SELECT tw, count(DISTINCT tid) AS n_t FROM pairs GROUP BY tw), reach AS (SELECT DISTINCT x.tw, x.tid, y.tw AS day, y.tid AS other FROM pairs x JOIN pairs y ON x.a = y.a AND x.b = y.b), c AS (SELECT tw, tid, day, count(*) AS df FROM reach GROUP BY ALL), p AS (SELECT c.tw, tid, avg(df / n_t) AS ps, max(CASE WHEN day = c.tw THEN df END) AS df, max(CASE WHEN day = c.tw THEN n_t END) AS n_t FROM c JOIN sz ON sz.tw = day GROUP BY ALL), uu AS (SELECT reach.tw, reach.tid, count(DISTINCT usr) AS users FROM reach JOIN t ON t.id_str = other WHERE day = reach.tw AND usr IS NOT NULL GROUP BY ALL), s AS (SELECT p.*, n_t * ps AS e, sqrt(n_t * ps * (1 - ps)) AS sd FROM p WHERE df > n_t * ps) SELECT s.tw, s.tid, df, n_t, round(ps, 6) AS ps, users, round(CASE WHEN df >= e + 2 * sd THEN 1.0 ELSE 1 / (1 + exp(-10 * (df - e - sd) / sd)) END * log10(users), 6) AS weight FROM s JOIN uu USING (tw, tid)",
    "frame_components": f"WITH RECURSIVE {D.FRAMES}, e AS (SELECT DISTINCT arg1 AS a, arg2 AS b FROM fm WHERE arg1 <> '' AND arg2 <> '' UNION SELECT DISTINCT arg2, arg1 FROM fm WHERE arg1 <> '' AND arg2 <> ''), lab AS (SELECT a AS node, a AS component, 0 AS turn FROM e UNION SELECT l.node, min(least(l.component, m.component)) AS component, l.turn + 1 FROM lab l JOIN e ON e.a = l.node JOIN lab m ON m.node = e.b WHERE l.turn < 40 GROUP BY l.node, l.turn) SELECT DISTINCT node, component FROM lab WHERE turn = 40",
    "frames_of_element": f"WITH {FOE} SELECT element, frame, n, rk FROM foe",
    "frequent_verbs": f"WITH {FR} SELECT f.verb AS verb, count(*) AS n FROM fr WHERE f.verb <> '' GROUP BY 1 HAVING count(*) > 5",
    "frame_arity": f"WITH {FR} SELECT ((coalesce(f.arg1, '') <> '')::INT + (coalesce(f.verb, '') <> '')::INT + (coalesce(f.arg2, '') <> '')::INT)::INT AS filled, count(*) AS n FROM fr GROUP BY 1",
    "relation_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
    "skeleton_frequency": f"WITH {PAIRS} SELECT x.tw, x.tid, count(DISTINCT y.tid) AS df FROM pairs x JOIN pairs y ON x.tw = y.tw AND x.a = y.a AND x.b = y.b GROUP BY x.tw, x.tid",
}
SQL |= {name: D.rounded_twice(SQL[name]) for name in ("burst_tagged_elements", "expected_on_last_day", "skeleton_burst")}
