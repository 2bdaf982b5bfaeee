"""Queries that read texts as language: triples, phrases, language-model scores, spans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from burstline.functions import text as T
from burstline.operators import extract as X
from burstline.operators import language_model as L
from burstline.operators.order import merge_spans
from burstline.sources.tables import table

from .detect import GRAMS, PIECES, TWEETS, gram_table, tweets


#: A quarter of function words makes a text without an English label pass as English.
FUNCTION_WORDS = 0.25


def _tagged(spark, d):
    """Words and tags of the tweets labelled English in any spelling, and of others that read as English."""
    t = tweets(spark, d).where("text is not null")
    return X.tagged(t.where(T.english(F.col("text"), F.col("lang"), T.STOPWORDS, FUNCTION_WORDS)), "id_str", "text")


def frame_triples(spark, d):
    """Triples of English tweets, by the rule tagger."""
    return X.frame_triples(_tagged(spark, d), "id_str", "tokens").where(F.size("frames") > 0)


def tag_inventory(spark, d):
    return _tagged(spark, d).select(F.explode("tokens.tag").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.first(T.lexical_class(F.col("tag"))).alias("class"))


def verb_pairs(spark, d):
    """Dependents of verbs, with the word before a verb as its subject: a chain parse stands for a parser's output."""
    tok = _tagged(spark, d).select("id_str", F.posexplode("tokens").alias("idx", "t")).select("id_str", "idx", "t.word", "t.tag")
    verbs = tok.where("tag like 'VB%'").select("id_str", F.col("idx").alias("v"), F.explode(F.array(F.col("idx") - 1, F.col("idx") + 1)).alias("idx"))
    near = verbs.groupBy("id_str", "idx").agg(F.min("v").alias("v"))
    parsed = tok.join(near, ["id_str", "idx"], "left").select("id_str", "idx", "word", "tag", F.coalesce("v", F.lit(-1)).alias("parent"), F.when(F.col("v") > F.col("idx"), "nsubj").otherwise("dobj").alias("rel"))
    return X.dependency_relations(parsed, "id_str", "verbs")


def lexical_unit_lookup(spark, d):
    """Verbs of frames looked up in a lexicon made of the headlines' words and word pairs; the stem of the first word names
    the frame that a unit evokes."""
    name = F.col("gram")
    lexicon = gram_table(spark, d).where(F.size(F.split("gram", " ")) <= 2).select(name.alias("lu_name"), F.lit("v").alias("lu_pos"), F.xxhash64("gram").alias("lu_id"), T.stem(F.split("gram", " ").getItem(0)).alias("frame_id"))
    verbs = table(spark, d, "frames").where("frames is not null").select(F.explode("frames.verb").alias("phrase")).where("phrase <> ''").distinct().withColumn("pos", F.lit("v"))
    return X.lexical_units(verbs, lexicon)


def _bigrams(spark, d):
    h = table(spark, d, "news").where("headline is not null").select(F.concat(F.array(F.lit("<s>")), T.words(F.col("headline")), F.array(F.lit("</s>"))).alias("ws"))
    each = h.select(F.explode(T.grams(F.col("ws"), 2, 2)).alias("gram"))
    n = each.agg(F.count("*").alias("n")).scalar()
    return each.groupBy("gram").agg(F.count("*").alias("c")).select("gram", F.log10(F.col("c") / n).alias("logp"))


def language_model_scores(spark, d):
    t = tweets(spark, d).where("text is not null").select("id_str", T.words(F.col("text")).alias("ws"))
    return L.bigram_scores(t, "id_str", "ws", _bigrams(spark, d)).withColumn("score", F.round("score", 4))


def likely_texts(spark, d):
    """Here a text passes if few of its pairs are unknown to the headlines."""
    return L.likely_texts(language_model_scores(spark, d), share=0.9)


def score_statistics(spark, d):
    return L.score_statistics(language_model_scores(spark, d), share=0.9)


def noun_phrase_statistics(spark, d):
    """Runs of nouns of English tweets by length and tags: a run is what is left between other words."""
    t = _tagged(spark, d).select("id_str", F.posexplode("tokens").alias("i", "t")).where("t.tag like 'NN%'")
    island = F.col("i") - F.row_number().over(Window.partitionBy("id_str").orderBy("i"))
    runs = t.withColumn("g", island).groupBy("id_str", "g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("tokens"))
    return X.phrase_statistics(runs)


def lexical_patterns(spark, d):
    """Lexical units in English tweets, from a lexicon of the frames' verbs; a verb's stem names its frame."""
    verbs = table(spark, d, "frames").where("frames is not null").select(F.explode("frames.verb").alias("lu_name")).where("lu_name <> ''").distinct()
    return X.lexical_patterns(_tagged(spark, d), "id_str", verbs.select("lu_name", F.lit("v").alias("lu_pos"), T.stem(F.col("lu_name")).alias("frame_id")))


def frame_contexts(spark, d):
    """Texts in which the elements of their frames stand as one word each."""
    f = table(spark, d, "frames").where("frames is not null").select("id_str", F.flatten(F.transform("frames", lambda x: F.array(x["arg1"], x["verb"], x["arg2"]))).alias("e"))
    elements = f.groupBy("id_str").agg(F.array_distinct(F.flatten(F.collect_list(F.filter("e", lambda x: x.isNotNull())))).alias("e"))
    t = tweets(spark, d).where("text is not null").select("id_str", T.words(F.col("text")).alias("ws"))
    return t.join(elements, "id_str").select("id_str", X.joined_context(F.col("ws"), F.col("e")).alias("context"))


def segmented_headlines(spark, d):
    """Headlines cut into phrases by stickiness; the grams' natural logs stand for anchors."""
    grams = gram_table(spark, d).select("gram", (F.col("logp") / F.log(F.lit(10.0))).alias("logp"), F.col("logp").alias("anchor"))
    h = table(spark, d, "news").where("headline is not null").select("news_id", T.words(F.col("headline")).alias("ws"))
    return L.segments(h, "news_id", "ws", grams)


def merged_spans(spark, d):
    """Spans of users' events in minutes of the day, merged where they overlap."""
    e = table(spark, d, "events").where("ts is not null")
    minute = F.hour("ts") * 60 + F.minute("ts")
    spans = e.select("user_id", F.to_date("ts").alias("day"), minute.alias("st"), (minute + F.floor("value")).alias("ed")).where("ed is not null")
    return merge_spans(spans, ["user_id", "day"], "st", "ed")


QUERIES = {f.__name__: f for f in (frame_triples, tag_inventory, verb_pairs, lexical_unit_lookup, language_model_scores, score_statistics, noun_phrase_statistics, lexical_patterns, frame_contexts, likely_texts, segmented_headlines, merged_spans)}
BIG = f"""h AS (SELECT list_concat(list_concat(['<s>'], {PIECES.replace('text', 'headline')}), ['</s>']) AS ws FROM news WHERE headline IS NOT NULL),
b AS (SELECT ws[i] || ' ' || ws[i + 1] AS gram FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM h)),
bi AS (SELECT gram, log10(count(*) / (SELECT count(*) FROM b)) AS logp FROM b GROUP BY gram)"""
SCORES = f"""w AS (SELECT id_str, {PIECES} AS ws FROM t WHERE text IS NOT NULL), x AS (SELECT id_str, len(ws)::INT AS n, list_concat(ws, ['</s>']) AS ws FROM w WHERE len(ws) > 0),
e AS (SELECT id_str, n, ws[i] || ' ' || ws[i + 1] AS gram FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM x)),
sc AS (SELECT id_str, any_value(n) AS n, round(sum(coalesce(logp, -100)), 4) AS score FROM e LEFT JOIN bi USING (gram) GROUP BY id_str)"""
SQL = {
    "lexical_unit_lookup": f"WITH {GRAMS}, lex AS (SELECT gram AS lu_name, regexp_replace(string_split(gram, ' ')[1], '(ing|ed|s)$', '') AS frame_id FROM grams WHERE len(string_split(gram, ' ')) <= 2), v AS (SELECT DISTINCT f.verb AS phrase FROM (SELECT unnest(frames) AS f FROM frames WHERE frames IS NOT NULL) WHERE f.verb <> ''), m AS (SELECT phrase, lu_name, frame_id, row_number() OVER (PARTITION BY phrase ORDER BY phrase = lu_name DESC, length(lu_name), lu_name) AS r FROM v JOIN lex ON contains(' ' || lu_name || ' ', ' ' || phrase || ' ')) SELECT phrase, 'v' AS pos, lu_name, frame_id FROM m WHERE r = 1",
    "language_model_scores": f"WITH {TWEETS}, {BIG}, {SCORES} SELECT id_str, n, score FROM sc",
    "likely_texts": f"WITH {TWEETS}, {BIG}, {SCORES} SELECT id_str, n, score FROM sc WHERE n >= 3 AND score > -100.0 * (n + 1) * 0.9 AND score > -100.0 * n",
    "score_statistics": f"WITH {TWEETS}, {BIG}, {SCORES}, k AS (SELECT n, count(*) AS texts, count_if(score > -100.0 * (n + 1) * 0.9) AS kept FROM sc WHERE n <= 30 AND abs(score) <> 100 * (n + 1) GROUP BY n) SELECT *, round(kept / texts, 6) AS ratio FROM k",
    "frame_contexts": f"WITH {TWEETS}, e AS (SELECT DISTINCT id_str FROM frames WHERE frames IS NOT NULL) SELECT id_str, trim(array_to_string(list_filter({PIECES}, lambda w: NOT list_contains([',', '.', ';', '?', '!', '#', '&', '<', '>'], w)), ' ')) AS context FROM t SEMI JOIN e USING (id_str) WHERE text IS NOT NULL",
    "merged_spans": """WITH s AS (SELECT user_id, ts::DATE AS day, hour(ts) * 60 + minute(ts) AS st, hour(ts) * 60 + minute(ts) + floor(value)::BIGINT AS ed FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
f AS (SELECT *, CASE WHEN st > max(ed) OVER o OR max(ed) OVER o IS NULL THEN 1 ELSE 0 END AS fresh FROM s WINDOW o AS (PARTITION BY user_id, day ORDER BY st, ed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, day ORDER BY st, ed ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, day, min(st) AS st, max(ed) AS ed, count(*) AS n FROM i GROUP BY user_id, day, island""",
}
