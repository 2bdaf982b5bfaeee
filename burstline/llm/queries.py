"""Queries over the tweet and document tables, one group per problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.sources.tables import table

from . import bpe, cooccur, langid, lookalike, neardup, packing, subjects, terms


def _tweets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tweets")


def _with_text(recs: DataFrame) -> Column:
    """The number of records with a non-null text, as a scalar subquery."""
    return recs.where(F.col("text").isNotNull()).agg(F.count("*").alias("n")).scalar()


# 1 ------------------------------------------------------------------------------------------------------------------


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(_tweets(spark, d), "id_str", "text")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.form_classes(_tweets(spark, d), "id_str", "text")


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    t = _tweets(spark, d)
    return t.select("id_str", lookalike.consistent_form("text").alias("form")).distinct()


# 2 ------------------------------------------------------------------------------------------------------------------


def _term_counts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    recs = terms.records(_tweets(spark, d), "id_str", "text")
    return recs, terms.term_counts(terms.occurrences(recs, terms.terms("text")))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    recs, counts = _term_counts(spark, d)
    return terms.mark_terms(counts, _with_text(recs))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_counts(spark, d).where(F.col("mark").isNotNull()).select("term", "mark")


# 3 ------------------------------------------------------------------------------------------------------------------


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    recs = terms.records(_tweets(spark, d), "id_str", "text")
    out = terms.distinctive_terms(recs, terms.terms("text"), _with_text(recs))
    return out.select(F.col("rec").alias("id_str"), "term", "tf", "df", "cf", F.round("kl", 6).alias("kl"), F.round("tf_idf", 6).alias("tf_idf"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    recs = terms.records(_tweets(spark, d), "id_str", "text")
    scored = terms.distinctive_terms(recs, terms.terms("text"), _with_text(recs))
    return terms.best_term(scored, "tf_idf").select(F.col("rec").alias("id_str"), "term")


def p3_best_by_divergence(spark: SparkSession, d: str) -> DataFrame:
    recs = terms.records(_tweets(spark, d), "id_str", "text")
    scored = terms.distinctive_terms(recs, terms.terms("text"), _with_text(recs))
    return terms.best_term(scored, "kl").select(F.col("rec").alias("id_str"), "term")


# 4 ------------------------------------------------------------------------------------------------------------------


def _baskets(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    t = _tweets(spark, d)
    tags = F.transform(F.coalesce("hashtags", F.expr("cast(array() as array<struct<text:string>>)")), lambda x: F.concat(F.lit("#"), F.lower(x["text"])))
    names = F.transform(
        F.coalesce("user_mentions", F.expr("cast(array() as array<struct<id_str:string,screen_name:string>>)")),
        lambda x: F.concat(F.lit("@"), F.lower(x["screen_name"])),
    )
    items = F.array_distinct(F.filter(F.concat(tags, names), lambda x: x.isNotNull()))
    one = t.where(F.col("id_str").isNotNull()).groupBy("id_str").agg(F.max(items).alias("items"))
    n = one.agg(F.count("*").alias("n")).scalar()
    return one, n


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of six tweets or more that exceed chance, as their SQL states; p4_all_pairs has every pair."""
    one, n = _baskets(spark, d)
    return cooccur.together(one, "items", n).withColumns({"lift": F.round("lift", 6), "llr": F.round("llr", 4)})


def p4_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its count, how far it exceeds chance, and whether it clearly does."""
    one, n = _baskets(spark, d)
    return cooccur.all_pairs(one, "items", n).withColumns({"lift": F.round("lift", 6), "llr": F.round("llr", 4)})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    one, n = _baskets(spark, d)
    pairs = cooccur.together(one, "items", n)
    return pairs.where(F.col("n_ab") * n >= 5 * F.col("n_a") * F.col("n_b")).select("item_a", "item_b")


# 5 ------------------------------------------------------------------------------------------------------------------


def _segments(spark: SparkSession, d: str) -> DataFrame:
    t = _tweets(spark, d).where(F.col("id_str").isNotNull())
    model = langid.train(langid.labelled_sample(t, "id_str", "text", "lang"))
    keyed = t.select(F.struct("id_str", langid.language_of_label(F.col("lang")).alias("label")).alias("k"), "text")
    return langid.segments(keyed, "k", "text", model).select("k.*", "parts", "from_word", "to_word", "segment", "lang", "confidence")


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).drop("label", "parts").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """A stretch is a case if the label is missing or names another language, or if it is not its text's only one."""
    s = _segments(spark, d)
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang")) | (F.col("parts") > 1)
    return s.where(F.col("lang").isNotNull() & wrong).select("id_str", "lang").distinct()


# 7 ------------------------------------------------------------------------------------------------------------------


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(_tweets(spark, d), "id_str", "text")


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(_tweets(spark, d), "id_str", "text")


# 8 ------------------------------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_table(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return bpe.decode_table(p8_ids(spark, d), "doc_id", "ids")


# 9 ------------------------------------------------------------------------------------------------------------------


#: Context sizes that the documents of one capacity are routed to, each half of the one before.
TIERS = 5


def _placed(spark: SparkSession, d: str, together: bool) -> DataFrame:
    docs = table(spark, d, "documents")
    bins = [tuple(r) for r in table(spark, d, "token_bins").groupBy("tokenizer", "capacity").agg(F.min("bin_id")).orderBy("capacity").collect()]
    name = bins[0][0]
    if any(t != name for t, _, _ in bins):
        raise ValueError("containers of one call share a tokenizer")
    capacities = [c for _, c, _ in bins]
    plans = [capacities] if together else [sorted({c >> k for k in range(TIERS)} - {0}) for c in capacities]
    sizes = bpe.token_lengths(docs.where(F.col("text") != ""), "doc_id", "text", name)
    number = F.create_map(*(F.lit(x) for _, c, b in bins for x in (c, b)))
    placed = packing.pack_table(sizes, "doc_id", "n_tokens", plans, docs.count(), fixed=not together)
    return placed.select(F.element_at(number, F.col("capacity")).alias("bin_id"), *placed.columns)


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """All documents in containers of each capacity, one complete placement a capacity: documents are routed to tiers of the
    capacity, half of it, a quarter and so on, the long ones open containers and the shorter tiers fill their gaps."""
    return _placed(spark, d, False)


def p9_tiers(spark: SparkSession, d: str) -> DataFrame:
    """All documents once over all capacities, each in a container of its own tier or in the gap of a longer one."""
    return _placed(spark, d, True)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, documents and share filled of each capacity."""
    one = p9_containers(spark, d).groupBy("capacity", "container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    used = F.sum("used")
    return one.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.round(used / (F.count("*") * F.first("capacity")), 4).alias("filled"))


# 10 -----------------------------------------------------------------------------------------------------------------


def p10_subjects(spark: SparkSession, d: str) -> DataFrame:
    """subjects is a fixed closed list, so its names are read to the driver whole."""
    names = [r["subject"] for r in table(spark, d, "subjects").select("subject").where("subject is not null").distinct().collect()]
    return subjects.subjects_of(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "doc_labels"), names)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_subjects(spark, d).select("doc_id", "subject")


def p10_make_up(spark: SparkSession, d: str) -> DataFrame:
    return subjects.make_up(p10_subjects(spark, d), "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_forms, p2_found, p2_counts, p3_found, p3_scores, p3_best_by_divergence, p4_found, p4_pairs, p4_all_pairs, p5_found, p5_segments, p7_found, p7_groups, p8_ids, p8_decoded, p9_containers, p9_tiers, p9_fill, p10_found, p10_subjects, p10_make_up)}
