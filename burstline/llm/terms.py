"""Terms of a text, their frequency in the collection, and how distinctive they are of a record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is cut from both ends of a piece, and what a term consists of.
EDGE = r"""[.,!?;:()"'…#]"""
TERM = "[a-z]{3,}"
PATTERN = rf"(?<![^ \t\r\n]){EDGE}*+({TERM}){EDGE}*+(?![^ \t\r\n])"


def terms(text: str | Column) -> Column:
    """The terms of a text in order, with repeats; null for a null text. One codegen expression."""
    return F.regexp_extract_all(F.lower(text), F.lit(PATTERN), F.lit(1))


def records(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec, text), one row per record: rows with a null key are dropped, of rows of one key the least text stands."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("rec")).agg(F.min(text).alias("text"))


def occurrences(recs: DataFrame, values: Column) -> DataFrame:
    """(term, rec): one row per occurrence."""
    return recs.select(F.explode(values).alias("term"), "rec").where(F.col("term").isNotNull())


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each run of equal terms in a sorted stream of (term, rec). Holds one batch and one open run."""
    term, rec, n, docs = None, None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        t, r = batch.column(0), batch.column(1)
        size = len(t)
        new_t = np.ones(size, bool)
        new_r = np.ones(size, bool)
        new_t[1:] = pc.not_equal(t[1:], t[:-1]).to_numpy(zero_copy_only=False)
        new_r[1:] = pc.not_equal(r[1:], r[:-1]).to_numpy(zero_copy_only=False) | new_t[1:]
        new_t[0] = t[0].as_py() != term
        new_r[0] = new_t[0] or r[0].as_py() != rec
        starts = np.flatnonzero(new_t)
        if len(starts) == 0:
            n, docs = n + size, docs + int(new_r.sum())
        else:
            if term is not None:
                yield _counts([term], [n + int(starts[0])], [docs + int(new_r[: starts[0]].sum())])
            occ = np.diff(np.append(starts, size))
            recs = np.add.reduceat(new_r.astype(np.int64), starts)
            if len(starts) > 1:
                yield _counts(t.take(pa.array(starts[:-1])), occ[:-1], recs[:-1])
            term, n, docs = t[int(starts[-1])].as_py(), int(occ[-1]), int(recs[-1])
        rec = r[size - 1].as_py()
    if term is not None:
        yield _counts([term], [n], [docs])


def _counts(term, n, docs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["term", "n", "docs"])


def term_counts(pairs: DataFrame) -> DataFrame:
    """(term, occurrences, records) of pairs (term, rec) with one row per occurrence.

    Range-partitioned external sort of the pairs, then a scan of the runs. The ranges are over (term, rec), so a term
    that holds a third of all rows is spread over many ranges while all its rows of one record stay together; the
    runs of one term in several ranges are added up in the end, at most one row per term and range.
    A rec that is a number without leading zeros is kept; any other is replaced by its 64-bit hash, which only tells records of a term apart.
    """
    number = F.when(F.col("rec").cast("string").rlike("^[1-9][0-9]{0,17}$"), F.expr("try_cast(rec as bigint)"))
    slim = pairs.select("term", F.coalesce(number, F.xxhash64("rec")).alias("rec"))
    runs = slim.repartitionByRange("term", "rec").sortWithinPartitions("term", "rec")
    runs = runs.mapInArrow(_scan_runs, "term string, n long, docs long")
    return runs.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum("docs").alias("records"))


def mark_terms(counts: DataFrame, n_records: Column, rare: int = 2, common: float = 0.02) -> DataFrame:
    """Adds mark: `rare` in at most `rare` records, else `common` in at least that share of them, else null.

    In a collection so small that a term is both, it is rare.
    """
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") >= F.lit(common) * n_records - 1e-9, "common")
    return counts.withColumn("mark", mark)


def distinctive_terms(recs: DataFrame, values: Column, n_records: Column, min_records: int = 2, mu: float = 100.0, head: float = 1e-3) -> DataFrame:
    """(rec, term, tf, df, cf, kl, tf_idf) of the terms that at least min_records records hold.

    Method: smoothed language-model divergence. With p(t|C) = cf / all occurrences and
    p(t|d) = (tf + mu p(t|C)) / (|d| + mu), a term's contribution to the relative entropy of record and collection is
    kl = p(t|d) ln(p(t|d) / p(t|C)). tf_idf = tf ln(n_records / df) stands beside it.

    A term's statistics reach the records on two ways. Terms of more than `head` of the records are broadcast: a
    record of m terms on average leaves at most m / head of them, whatever the size of the collection. The others, of
    which none holds more than that share of the rows, are joined by a shuffle, which no key can overload.
    Records that are null, empty or without terms yield no row.
    """
    lists = recs.select("rec", values.alias("ts")).where(F.size("ts") > 0)
    tf = (
        lists.select("rec", F.size("ts").alias("len"), F.explode("ts").alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("rec", "term")
        .agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    )
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_records)
    total = lists.agg(F.sum(F.size("ts")).alias("n")).scalar()
    frequent = F.col("df") > F.lit(head) * n_records
    hot = stats.where(frequent)
    probed = tf.join(F.broadcast(hot), "term", "left")
    rest = probed.where(F.col("df").isNull()).drop("df", "cf").join(stats.where(~frequent), "term")
    both = probed.where(F.col("df").isNotNull()).unionByName(rest)
    p_c = F.col("cf") / total
    p_d = (F.col("tf") + mu * p_c) / (F.col("len") + mu)
    return both.select("rec", "term", "tf", "df", "cf", (p_d * F.log(p_d / p_c)).alias("kl"), (F.col("tf") * F.log(n_records / F.col("df"))).alias("tf_idf"))


def best_term(scored: DataFrame, score: str, digits: int = 10) -> DataFrame:
    """(rec, term): the term of each record with the highest score; of equal scores the alphabetically first.

    Scores are compared after rounding, so that the order of additions does not decide. Combined before the shuffle.
    """
    order = F.struct((-F.round(score, digits)).alias("s"), F.col("term").alias("t"))
    return scored.groupBy("rec").agg(F.min(order).alias("m")).select("rec", F.col("m.t").alias("term"))
