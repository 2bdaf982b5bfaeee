"""Text queries: cleaning, filters, n-grams, statistics, social flags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from burstline.functions import text as T
from burstline.operators.order import late_rows, with_positions
from burstline.sources.tables import table

from .detect import PIECES, STOP, TWEETS, tweets


def clean_words(spark, d):
    """The cleaned words of each tweet; tweets of which nothing is left, or a single tag, are dropped."""

    def kept(ws):
        normal = F.filter(ws, lambda w: ~w.startswith("@") & ~F.contains(w, F.lit("http")) & (F.upper(w) != "RT"))
        return F.when((F.size(normal) >= 1) & ~((F.size(ws) == 1) & F.element_at(ws, 1).startswith("#")), F.array_join(ws, " "))

    return tweets(spark, d).select("id_str", T.once(T.clean(F.col("text")), kept).alias("cleaned")).where("cleaned is not null")


def printable_texts(spark, d):
    return tweets(spark, d).where("text is not null").select("id_str", T.printable(T.decode_entities(F.col("text"))).alias("text"))


def stop_and_url_filter(spark, d):
    kept = T.without_urls(T.without(T.words(F.col("text"))))
    return tweets(spark, d).where("text is not null").select("id_str", F.size(T.words(F.col("text"))).alias("n_words"), F.size(kept).alias("n_kept"), F.array_join(kept, " ").alias("kept"))


def marked_mentions(spark, d):
    return tweets(spark, d).where("text is not null").select("id_str", F.array_join(T.mark_mentions(T.words(F.col("text"))), " ").alias("text"))


def squeezed_repeats(spark, d):
    return tweets(spark, d).where("text is not null").select("id_str", T.squeeze_repeats(F.col("text")).alias("text"))


def trimmed_tags(spark, d):
    """Tags at both ends dropped; one word, or two with a mention, is too little."""
    t = tweets(spark, d).select("id_str", T.trim_tags(T.words(F.col("text"))).alias("ws"))
    mention = F.exists("ws", lambda w: w.startswith("@"))
    return t.where((F.size("ws") > 1) & ~((F.size("ws") == 2) & mention)).select("id_str", F.array_join("ws", " ").alias("text"))


def good_grams(spark, d):
    """Good grams of two to five words of the headlines, with the headlines that hold them."""
    g = table(spark, d, "news").where("headline is not null").select("news_id", F.explode(F.array_distinct(T.grams(T.words(F.col("headline"))))).alias("gram"))
    return g.where(T.good_gram(F.col("gram"))).groupBy("gram").agg(F.count("*").alias("n"))


def social_flags(spark, d):
    t = table(spark, d, "tweets").where("id_str is not null and text is not null")
    flags = t.select(
        "id_str",
        F.col("text").startswith("RT ").alias("is_rt"),
        F.coalesce(F.size("user_mentions") > 0, F.lit(False)).alias("has_mention"),
        F.col("in_reply_to_status_id_str").isNotNull().alias("is_reply"),
        F.coalesce(F.size("urls") > 0, F.lit(False)).alias("has_url"),
        F.coalesce("favorited", F.lit(False)).alias("favorited"),
        F.array_join(F.transform("hashtags", lambda h: h["text"]), " ").alias("tags"),
        F.size(F.filter(T.words(F.col("text")), lambda w: w.endswith("ed"))).alias("past_words"),
        F.hour("ts").alias("hour"),
        F.pmod(F.hour("ts") + 8, F.lit(24)).alias("hour_east"),
        T.sub_window(F.col("ts"), 4).alias("four_hours"),
    )
    return flags.distinct()


def parsed_times(spark, d):
    """The time of tweets parsed again from their text."""
    t = table(spark, d, "tweets").where("id_str is not null").select("id_str", T.long_time(F.col("created_at")).cast("timestamp_ntz").alias("parsed"), "ts").distinct()
    return t.select("id_str", "parsed", F.col("parsed").eqNullSafe(F.col("ts")).alias("agrees"), (F.floor(F.hour("parsed") / 2) + 1).cast("int").alias("subtw"))


def url_ratio_by_day(spark, d):
    t = table(spark, d, "tweets").where("id_str is not null and tw is not null").select("id_str", "tw", F.coalesce(F.size("urls"), F.lit(0)).alias("n")).distinct()
    return t.groupBy("tw").agg(F.count("*").alias("tweets"), F.round(F.avg((F.col("n") > 0).cast("int")), 6).alias("ratio"))


def dedup_first(spark, d):
    """The first delivery of each tweet, and how many there were: least by received_at, without a sort of all rows."""
    t = table(spark, d, "tweets").where("id_str is not null")
    return t.groupBy("id_str").agg(F.min("received_at").alias("received_at"), F.min_by("retweet_count", "received_at").alias("retweet_count"), F.count("*").alias("deliveries"))


def length_histogram(spark, d):
    n = F.size(T.words(F.col("text")))
    return tweets(spark, d).where("text is not null").groupBy(n.alias("n_words")).agg(F.count("*").alias("tweets"))


def corpus_statistics(spark, d):
    """Per day: tweets, words, distinct words, words seen more than 1, 10 and 100 times."""
    t = tweets(spark, d).where("tw is not null and text is not null")
    each = t.select("tw", F.explode(T.words(F.col("text"))).alias("w")).groupBy("tw", "w").agg(F.count("*").alias("tf"))
    days = t.groupBy("tw").agg(F.count("*").alias("tweets"))
    tails = [F.count_if(F.col("tf") > 10**k).alias(f"above_{10**k}") for k in range(3)]
    return each.groupBy("tw").agg(F.sum("tf").alias("words"), F.count("*").alias("distinct_words"), *tails).join(days, "tw")


def kinds_of_words(spark, d):
    """Occurrences and distinct words among mentions, tags, links and others."""
    w = tweets(spark, d).where("text is not null").select(F.explode(T.words(F.col("text"))).alias("w"))
    kind = F.when(F.col("w").startswith("@"), "mention").when(F.col("w").startswith("#"), "tag").when(F.contains("w", F.lit("http")), "url").otherwise("word")
    one = w.groupBy("w", kind.alias("kind")).agg(F.count("*").alias("n"))
    return one.groupBy("kind").agg(F.sum("n").alias("occurrences"), F.count("*").alias("distinct_words"))


def top_words(spark, d):
    w = tweets(spark, d).where("text is not null").select(F.explode(T.without(T.words(F.col("text")))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


def statistics_by_length(spark, d):
    """Words and their occurrences by length and in all."""
    w = tweets(spark, d).where("text is not null").select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return w.rollup(F.length("w").alias("length")).agg(F.count("*").alias("distinct_words"), F.sum("n").alias("occurrences"))


def zodiac_filter(spark, d):
    """Tweets that name a sign of the zodiac as a word, and those that hold one inside a word."""
    ws = T.words(F.col("text"))
    listed = F.array(*map(F.lit, T.ZODIAC))
    inside = F.exists(ws, lambda w: F.exists(listed, lambda z: F.contains(w, z)))
    return tweets(spark, d).where("text is not null").select("id_str", F.arrays_overlap(ws, listed).alias("exact"), inside.alias("inside")).where("exact or inside")


def noise_words(spark, d):
    """Words of tweets that are in none of the tweet's frames, counted; those of two or more tweets."""
    t = tweets(spark, d).where("text is not null").select("id_str", F.explode(F.array_distinct(T.words(F.col("text")))).alias("w"))
    f = table(spark, d, "frames").where("frames is not null").select("id_str", F.explode("frames").alias("f")).select("id_str", F.explode(F.array("f.arg1", "f.verb", "f.arg2")).alias("w"))
    withframes = f.select("id_str").distinct()
    left = t.join(withframes, "id_str", "left_semi").join(f.where("w is not null"), ["id_str", "w"], "left_anti")
    return left.groupBy("w").agg(F.count("*").alias("n")).where("n >= 2")


def digitised_words(spark, d):
    """Words with dense numbers in the order of the first tweet and place that hold them."""
    t = tweets(spark, d).where("text is not null").select("id_str", F.posexplode(T.words(F.col("text"))).alias("p", "w"))
    first = t.groupBy("w").agg(F.min(F.struct("id_str", "p")).alias("f")).select("w", "f.id_str", "f.p")
    return with_positions(first, ["id_str", "p"], "number").select("w", "number")


def running_days(spark, d):
    """Tweets per day with the total so far."""
    t = tweets(spark, d).where("tw is not null").groupBy("tw").agg(F.count("*").alias("n"))
    return t.select("tw", "n", F.sum("n").over(Window.orderBy("tw").rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"))


def active_users(spark, d):
    """Users with tweets and followers: tweets joined with the user table, users without tweets left out."""
    t = tweets(spark, d).where("user_id_str is not null").groupBy("user_id_str").agg(F.count("*").alias("tweets"), F.count_distinct("tw").alias("days"))
    u = table(spark, d, "users").select(F.col("id_str").alias("user_id_str"), "screen_name", "followers_count")
    return t.join(u, "user_id_str").select("user_id_str", "screen_name", "tweets", "days", "followers_count")


def late_tweets(spark, d):
    """Deliveries of a day that is over: an earlier delivery was of a later day."""
    t = table(spark, d, "tweets").where("id_str is not null").select("id_str", "received_at", "tw", "retweet_count")
    return late_rows(t, ["received_at", "id_str", "retweet_count"], "tw").where("late").select("id_str", "received_at", "tw")


QUERIES = {
    f.__name__: f
    for f in (
        clean_words, printable_texts, stop_and_url_filter, marked_mentions, squeezed_repeats, trimmed_tags, good_grams, social_flags, parsed_times, url_ratio_by_day, dedup_first,
        length_histogram, corpus_statistics, kinds_of_words, top_words, statistics_by_length, zodiac_filter, noise_words, digitised_words, running_days, active_users, late_tweets,
    )
}

SIGNS = "[" + ", ".join(f"'{z}'" for z in T.ZODIAC) + "]"
EDGES = "regexp_replace({}, '^[^a-zA-Z0-9$]+|[^a-zA-Z0-9$]+$', '', 'g')"
W = f"WITH {TWEETS}, w AS (SELECT id_str, tw, text, {PIECES} AS ws FROM t WHERE text IS NOT NULL)"
CLEAN_WORD = f"""CASE WHEN contains(p, 'http') THEN CASE WHEN starts_with(p, 'http') AND length(p) > 20 THEN substring(p, 1, 20) END
 WHEN contains(p, '@') THEN trim(regexp_replace(regexp_extract(p, '(@.*)$', 1), '[^@a-zA-Z0-9_]', ' ', 'g'))
 WHEN NOT regexp_matches(p, '[a-zA-Z0-9]') AND length(p) > 1 THEN NULL
 WHEN starts_with(p, '#') THEN CASE WHEN length('#' || {EDGES.format("regexp_replace(p, '^#+', '')")}) > 1 THEN '#' || {EDGES.format("regexp_replace(p, '^#+', '')")} END
 ELSE {EDGES.format("replace(replace(replace(p, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")} END"""
KEPT = f"list_filter(ws, lambda x: NOT contains(x, 'http') AND NOT list_contains({STOP}, x))"
SQL = {
    "clean_words": f"""WITH {TWEETS}, p AS (SELECT id_str, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (SELECT id_str, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: length(x) >= 1) AS ps FROM t WHERE text IS NOT NULL)),
c AS (SELECT id_str, i, {CLEAN_WORD} AS c FROM p), ok AS (SELECT * FROM c WHERE c <> '' AND NOT regexp_matches(c, '[^\\x20-\\x7E]')),
g AS (SELECT id_str, list(c ORDER BY i) AS ws FROM ok GROUP BY id_str)
SELECT id_str, array_to_string(ws, ' ') AS cleaned FROM g WHERE len(list_filter(ws, lambda x: NOT starts_with(x, '@') AND NOT contains(x, 'http') AND upper(x) <> 'RT')) >= 1 AND NOT (len(ws) = 1 AND starts_with(ws[1], '#'))""",
    "printable_texts": f"WITH {TWEETS} SELECT id_str, regexp_replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[^\\x20-\\x7E]', '', 'g') AS text FROM t WHERE text IS NOT NULL",
    "stop_and_url_filter": f"{W} SELECT id_str, len(ws)::INT AS n_words, len({KEPT})::INT AS n_kept, array_to_string({KEPT}, ' ') AS kept FROM w",
    "marked_mentions": f"{W} SELECT id_str, array_to_string(list_transform(ws, lambda x: CASE WHEN starts_with(x, '@') AND length(x) > 1 THEN '@usr' ELSE replace(x, '|', '') END), ' ') AS text FROM w",
    "trimmed_tags": f"""{W}, p AS (SELECT id_str, ws, list_position(list_transform(ws, lambda x: NOT starts_with(x, '#')), true) AS a, list_position(list_transform(list_reverse(ws), lambda x: NOT starts_with(x, '#')), true) AS b FROM w),
k AS (SELECT id_str, ws[a:len(ws) - b + 1] AS ws FROM p WHERE a > 0)
SELECT id_str, array_to_string(ws, ' ') AS text FROM k WHERE len(ws) > 1 AND NOT (len(ws) = 2 AND len(list_filter(ws, lambda x: starts_with(x, '@'))) > 0)""",
    "good_grams": f"""WITH h AS (SELECT news_id, {PIECES.replace("text", "headline")} AS ws FROM news WHERE headline IS NOT NULL),
g AS (SELECT DISTINCT news_id, array_to_string(ws[i:i + k - 1], ' ') AS gram, ws[i:i + k - 1] AS p FROM (SELECT news_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM h), range(2, 6) r(k) WHERE i + k - 1 <= len(ws))
SELECT gram, count(*) AS n FROM g WHERE len(list_filter(p, lambda x: NOT (length(x) > 2 AND NOT regexp_matches(x, '[^a-z0-9_''-]') AND regexp_matches(x, '^[a-z0-9]') AND NOT list_contains({STOP}, x) AND NOT regexp_matches(x, '^[0-9]+$')))) = 0
AND list_sum(list_transform(p, lambda x: length(x))) // len(p) >= 4 GROUP BY gram""",
    "social_flags": f"""SELECT DISTINCT id_str, starts_with(text, 'RT ') AS is_rt, coalesce(len(user_mentions) > 0, false) AS has_mention, in_reply_to_status_id_str IS NOT NULL AS is_reply, coalesce(len(urls) > 0, false) AS has_url,
coalesce(favorited, false) AS favorited, array_to_string(list_filter(list_transform(hashtags, lambda h: h.text), lambda x: x IS NOT NULL), ' ') AS tags, len(list_filter({PIECES}, lambda w: ends_with(w, 'ed')))::INT AS past_words,
hour(ts)::INT AS hour, ((hour(ts) + 8) % 24)::INT AS hour_east, (hour(ts) // 4 + 1)::INT AS four_hours FROM tweets WHERE id_str IS NOT NULL AND text IS NOT NULL""",
    "parsed_times": "WITH p AS (SELECT DISTINCT id_str, ts, try_strptime(created_at, '%a %b %d %H:%M:%S +0000 %Y') AS parsed FROM tweets WHERE id_str IS NOT NULL) SELECT id_str, parsed, parsed IS NOT DISTINCT FROM date_trunc('second', ts) AS agrees, (hour(parsed) // 2 + 1)::INT AS subtw FROM p",
    "url_ratio_by_day": "WITH u AS (SELECT DISTINCT id_str, tw, coalesce(len(urls), 0) AS n FROM tweets WHERE id_str IS NOT NULL AND tw IS NOT NULL) SELECT tw, count(*) AS tweets, round(avg((n > 0)::INT), 6) AS ratio FROM u GROUP BY tw",
    "dedup_first": "SELECT id_str, received_at, retweet_count, deliveries FROM (SELECT id_str, received_at, retweet_count, row_number() OVER (PARTITION BY id_str ORDER BY received_at) AS r, count(*) OVER (PARTITION BY id_str) AS deliveries FROM tweets WHERE id_str IS NOT NULL) WHERE r = 1",
    "length_histogram": f"{W} SELECT len(ws)::INT AS n_words, count(*) AS tweets FROM w GROUP BY 1",
    "corpus_statistics": f"{W}, e AS (SELECT tw, x, count(*) AS tf FROM (SELECT tw, unnest(ws) AS x FROM w WHERE tw IS NOT NULL) GROUP BY ALL), dd AS (SELECT tw, count(*) AS tweets FROM w WHERE tw IS NOT NULL GROUP BY tw) SELECT tw, sum(tf)::BIGINT AS words, count(*) AS distinct_words, count_if(tf > 1) AS above_1, count_if(tf > 10) AS above_10, count_if(tf > 100) AS above_100, any_value(tweets) AS tweets FROM e JOIN dd USING (tw) GROUP BY tw",
    "kinds_of_words": f"{W} SELECT CASE WHEN starts_with(x, '@') THEN 'mention' WHEN starts_with(x, '#') THEN 'tag' WHEN contains(x, 'http') THEN 'url' ELSE 'word' END AS kind, count(*) AS occurrences, count(DISTINCT x) AS distinct_words FROM (SELECT unnest(ws) AS x FROM w) GROUP BY 1",
    "top_words": f"{W} SELECT x AS word, count(*) AS n FROM (SELECT unnest(ws) AS x FROM w) WHERE NOT list_contains({STOP}, x) GROUP BY 1 ORDER BY n DESC, word LIMIT 50",
    "statistics_by_length": f"{W}, e AS (SELECT x, count(*) AS n FROM (SELECT unnest(ws) AS x FROM w) GROUP BY x) SELECT length(x)::INT AS length, count(*) AS distinct_words, sum(n)::BIGINT AS occurrences FROM e GROUP BY ROLLUP (length(x)::INT)",
    "zodiac_filter": f"{W}, z AS (SELECT id_str, list_has_any(ws, {SIGNS}) AS exact, len(list_filter(ws, lambda x: len(list_filter({SIGNS}, lambda z: contains(x, z))) > 0)) > 0 AS inside FROM w) SELECT * FROM z WHERE exact OR inside",
    "noise_words": f"{W}, f AS (SELECT id_str, unnest([f.arg1, f.verb, f.arg2]) AS x FROM (SELECT id_str, unnest(frames) AS f FROM frames WHERE frames IS NOT NULL)), tw_ AS (SELECT id_str, unnest(list_distinct(ws)) AS w FROM w WHERE id_str IN (SELECT id_str FROM f)) SELECT w, count(*) AS n FROM tw_ WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id_str = tw_.id_str AND f.x = tw_.w) GROUP BY w HAVING count(*) >= 2",
    "digitised_words": f"{W}, e AS (SELECT id_str, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w), f AS (SELECT x, min(id_str || '-' || lpad(p::VARCHAR, 9, '0')) AS k FROM e GROUP BY x) SELECT x AS w, row_number() OVER (ORDER BY k) AS number FROM f",
    "running_days": f"WITH {TWEETS}, e AS (SELECT tw, count(*) AS n FROM t WHERE tw IS NOT NULL GROUP BY tw) SELECT tw, n, (sum(n) OVER (ORDER BY tw))::BIGINT AS so_far FROM e",
    "late_tweets": "SELECT id_str, received_at, tw FROM (SELECT *, max(tw) OVER (ORDER BY received_at, id_str, retweet_count ROWS UNBOUNDED PRECEDING) AS latest FROM tweets WHERE id_str IS NOT NULL) WHERE tw < latest",
    "active_users": f"WITH {TWEETS}, e AS (SELECT usr, count(*) AS tweets, count(DISTINCT tw) AS days FROM t WHERE usr IS NOT NULL GROUP BY usr) SELECT usr AS user_id_str, screen_name, tweets, days, followers_count FROM e JOIN users u ON u.id_str = usr",
}
