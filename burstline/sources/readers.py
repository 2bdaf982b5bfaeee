"""Readers of the text formats in which tweets, units, tags, parses and tables are delivered.

Every reader is lazy and typed, and leaves out the lines that it cannot read; what is left out can be had through
raw_records, with its reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burstline.functions import text as T
from burstline.operators.order import with_positions

TWEET = """id_str string, text string, created_at string, lang string, retweet_count bigint, retweeted boolean, favorited boolean,
in_reply_to_status_id_str string, user struct<id_str:string,screen_name:string>,
entities struct<hashtags:array<struct<text:string>>,user_mentions:array<struct<id_str:string,screen_name:string>>,urls:array<struct<url:string,expanded_url:string>>>"""


def json_tweets(spark: SparkSession, path: str) -> DataFrame:
    """Tweets of JSON lines. Lines under 20 characters, broken JSON, rows without a user or an id are left out; of one id
    the row that comes first in the files stands (by file and line content where a file is split)."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value").where(F.length("value") >= 20)
    t = lines.select("file", "at", F.from_json(F.regexp_replace("value", r"\\\\\\\\", r"\\\\"), TWEET).alias("t")).where("t.id_str is not null and t.user.id_str is not null")
    first = t.groupBy("t.id_str").agg(F.min_by("t", F.struct("file", "at")).alias("t"))
    return first.select(
        "t.id_str", F.col("t.user.id_str").alias("user_id_str"), "t.text", "t.created_at", T.long_time(F.col("t.created_at")).alias("ts"), "t.lang",
        "t.entities.hashtags", "t.entities.user_mentions", "t.entities.urls", "t.retweet_count", "t.retweeted", "t.favorited", "t.in_reply_to_status_id_str",
    )


def tsv_tweets(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Tweets of wide TSV lines: 13 columns or more, id, text and time in the 7th, 9th and 10th. Rows whose cleaned text is
    empty, whose time is none (`false`), or outside the days are left out; the text comes as delivered."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 13)
    t = f.select(F.get("f", F.lit(6)).alias("id_str"), F.get("f", F.lit(8)).alias("text"), T.twelve_hour_time(F.get("f", F.lit(9))).alias("ts")).where("ts is not null")
    t = t.withColumn("tw", F.to_date("ts")).withColumn("subtw", T.sub_window(F.col("ts"))).where(F.size(T.clean(F.col("text"))) > 0)
    if first_day:
        t = t.where(F.col("tw") >= F.lit(first_day).cast("date"))
    return t.where(F.col("tw") <= F.lit(last_day).cast("date")) if last_day else t


def unit_lines(spark: SparkSession, path: str, segments: bool = False) -> DataFrame:
    """(id, units) of lines `id TAB units` or `id TAB score TAB units`; the last field holds the units, lower case."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 2)
    body = F.lower(F.try_element_at("f", F.lit(-1)))
    body = F.replace(F.replace(body, F.lit(" "), F.lit("_")), F.lit("|"), F.lit(" ")) if segments else body
    return f.select(F.get("f", F.lit(0)).alias("id"), F.filter(F.split(body, " "), lambda w: w != "").alias("units"))


def tagged_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, tokens array<struct<word,tag>>) of lines `id TAB word/TAG word/TAG`; lines with a foreign word are left out."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 2)
    token = lambda w: F.struct(F.regexp_extract(w, "^(.*)/([^/]*)$", 1).alias("word"), F.regexp_extract(w, "^(.*)/([^/]*)$", 2).alias("tag"))
    t = f.select(F.get("f", F.lit(0)).alias("id"), F.transform(F.filter(F.split(F.try_element_at("f", F.lit(-1)), " "), lambda w: F.contains(w, F.lit("/"))), token).alias("tokens"))
    return t.where(~F.exists("tokens", lambda x: x["tag"].startswith("FW")))


def four_way_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, tokens array<struct<word,ne,pos,evt>>) of lines `id TAB word/NE/POS/EVT ...`; a word may hold slashes."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 2)
    cut = "^(.*)/([^/]*)/([^/]*)/([^/]*)$"
    token = lambda w: F.struct(*(F.regexp_extract(w, cut, k).alias(n) for k, n in ((1, "word"), (2, "ne"), (3, "pos"), (4, "evt"))))
    return f.select(F.get("f", F.lit(0)).alias("id"), F.transform(F.filter(F.split(F.try_element_at("f", F.lit(-1)), " "), lambda w: w.rlike(cut)), token).alias("tokens"))


def chunked_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, words, phrases array<struct<st,ed>>) of lines `id TAB [NP the house ] stands`: a bracket opens or closes a phrase."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 2)
    pieces = F.filter(F.split(F.try_element_at("f", F.lit(-1)), " "), lambda w: w != "")
    t = f.select(F.get("f", F.lit(0)).alias("id"), pieces.alias("p"))
    word = lambda w: ~w.startswith("[") & (w != "]")
    before = lambda i: F.size(F.filter(F.slice("p", F.lit(1), i), word))
    places = lambda test: F.filter(F.transform("p", lambda w, i: F.when(test(w), before(i))), lambda x: x.isNotNull())
    opened, closed = places(lambda w: w.startswith("[")), places(lambda w: w == "]")
    return t.select("id", F.filter("p", word).alias("words"), F.arrays_zip(opened.alias("st"), closed.alias("ed")).alias("phrases"))


def parses(spark: SparkSession, path: str) -> DataFrame:
    """(record, idx, word, tag, parent, rel) of parses with four columns a token and an empty line after each text."""
    r = spark.read.option("lineSep", "\n\n").text(path).select(F.monotonically_increasing_id().alias("record"), "value").where(F.trim("value") != "")
    t = r.select("record", F.posexplode(F.filter(F.split("value", "\n"), lambda w: w != "")).alias("idx", "line")).select("record", "idx", F.split("line", "\t").alias("f"))
    return t.where(F.size("f") >= 4).select("record", "idx", F.get("f", F.lit(0)).alias("word"), F.get("f", F.lit(1)).alias("tag"), F.get("f", F.lit(2)).try_cast("int").alias("parent"), F.get("f", F.lit(3)).alias("rel"))


def arpa(spark: SparkSession, path: str) -> DataFrame:
    """(n, gram, logp, backoff) of a language model in ARPA form. check_arpa compares the counts with the header."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 2)
    t = t.select(F.get("f", F.lit(0)).try_cast("double").alias("logp"), F.trim(F.get("f", F.lit(1))).alias("gram"), F.get("f", F.lit(2)).try_cast("double").alias("backoff")).where("logp is not null")
    return t.select(F.size(F.split("gram", " ")).alias("n"), "gram", "logp", "backoff")


def check_arpa(spark: SparkSession, path: str) -> DataFrame:
    """(n, declared, found) where the header of an ARPA file and its grams disagree."""
    h = spark.read.text(path).select(F.regexp_extract("value", r"^ngram (\d+)=\s*(\d+)", 1).alias("n"), F.regexp_extract("value", r"^ngram (\d+)=\s*(\d+)", 2).alias("c")).where("n <> ''")
    found = arpa(spark, path).groupBy("n").agg(F.count("*").alias("found"))
    said = h.select(F.col("n").cast("int").alias("n"), F.col("c").cast("long").alias("declared"))
    return said.join(found, "n", "full").where("not (declared <=> found)")


def scored_grams(spark: SparkSession, path: str) -> DataFrame:
    """(gram, logp) of lines `logp gram`."""
    t = spark.read.text(path).select(F.split("value", " ", 2).alias("f")).where(F.size("f") == 2)
    return t.select(F.get("f", F.lit(1)).alias("gram"), F.get("f", F.lit(0)).try_cast("double").alias("logp")).where("logp is not null")


def probabilities(spark: SparkSession, path: str) -> DataFrame:
    """(unit, ps) of lines `prob TAB unit`."""
    t = spark.read.text(path).select(F.split("value", "\t", 2).alias("f")).where(F.size("f") == 2)
    return t.select(F.get("f", F.lit(1)).alias("unit"), F.get("f", F.lit(0)).try_cast("double").alias("ps")).where("ps is not null")


def vectors(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """(unit, vector) of lines `unit x1 x2 ...` under a header `n dim`; lines of another length are left out. only: (unit)."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("f"))
    t = lines.where(F.size("f") > 2).select(F.get("f", F.lit(0)).alias("unit"), F.transform(F.slice("f", F.lit(2), F.size("f")), lambda x: x.try_cast("float")).alias("vector"))
    t = t.where(~F.exists("vector", lambda x: x.isNull()))
    return t.join(only.select("unit"), "unit", "left_semi") if only is not None else t


def relation_rows(spark: SparkSession, path: str) -> DataFrame:
    """(id, relations, confidence) of extractor rows `id TAB arg1 TAB rel TAB arg2 ...`: the relations of one id in the order
    of the rows, with the confidence in the 12th column, null where there is none."""
    t = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.split("value", "\t").alias("f")).where(F.size("f") >= 4)
    t = t.select("at", F.get("f", F.lit(0)).alias("id"), F.concat_ws("|", F.get("f", F.lit(1)), F.get("f", F.lit(2)), F.get("f", F.lit(3))).alias("r"), F.get("f", F.lit(11)).try_cast("double").alias("c"))
    rows = F.sort_array(F.collect_list(F.struct("at", "r", "c")))
    return t.groupBy("id").agg(F.transform(rows, lambda x: x["r"]).alias("relations"), F.transform(rows, lambda x: x["c"]).alias("confidence"))


def frequency_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((tw, n_t), (unit, tw, df)) of a text table with a header `tw n#tw n ...` and lines `unit TAB df#df ...` in the order of
    the header, 0 or nothing where a window does not have the unit."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"), "value")
    head = lines.where(F.size("f") == 1).select(F.posexplode(F.split("value", "#")).alias("p", "w")).select("p", F.split("w", " ").alias("w"))
    windows = head.select("p", F.get("w", F.lit(0)).alias("tw"), F.get("w", F.lit(1)).try_cast("long").alias("n_t")).where("n_t is not null")
    each = lines.where(F.size("f") == 2).select(F.get("f", F.lit(0)).alias("unit"), F.posexplode(F.split(F.get("f", F.lit(1)), "#")).alias("p", "df"))
    counts = each.select("unit", "p", F.col("df").try_cast("long").alias("df")).where("df > 0").join(F.broadcast(windows.select("p", "tw")), "p")
    return windows.select("tw", "n_t"), counts.select("unit", "tw", "df")


def id_map(spark: SparkSession, path: str) -> DataFrame | None:
    """(line_no, id) of a list of ids, one a line, numbered from 0 in the order of the file; null if there is no such file."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        return None
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("id"))
    return with_positions(lines, ["file", "at"], "n").select((F.col("n") - 1).alias("line_no"), "id")


def parses_of(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(id, idx, word, tag, parent, rel): parses joined with the ids (line_no, id) of their texts by their number in the file."""
    tokens = parses(spark, path)
    numbers = with_positions(tokens.select("record").distinct(), ["record"], "n").select("record", (F.col("n") - 1).alias("line_no"))
    return tokens.join(numbers, "record").join(ids, "line_no").select("id", "idx", "word", "tag", "parent", "rel")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): distinct words of a list, one a line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def pair_list(spark: SparkSession, path: str, separator: str = "  -   ") -> DataFrame:
    """(word, meaning) of a list of pairs such as slang and its meaning."""
    t = spark.read.text(path).select(F.split("value", separator, 2).alias("f")).where(F.size("f") == 2)
    return t.select(F.lower(F.trim(F.get("f", F.lit(0)))).alias("word"), F.trim(F.get("f", F.lit(1))).alias("meaning"))


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, tag, ratio) of lines with `###tag###ratio###...`."""
    t = spark.read.text(path).where(F.contains("value", F.lit("###"))).select(F.col("value").alias("line"), F.split("value", "###").alias("f")).where(F.size("f") >= 3)
    return t.select("line", F.get("f", F.lit(1)).alias("tag"), F.get("f", F.lit(2)).try_cast("double").alias("ratio"))


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows without replacement, in the order of the key. A sampling operator: n is what the caller asks for."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n).orderBy(key)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; all columns kept."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
