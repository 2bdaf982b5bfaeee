"""Scores of texts under n-gram tables, and segmentation by phrase stickiness."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.functions.text import grams as runs

UNKNOWN = -100.0


def bigram_scores(texts: DataFrame, key: str, words: str, bigrams: DataFrame) -> DataFrame:
    """(key, n, score): the sum of log10 probabilities of the bigrams of <s> words </s>, but for the first one; unknown -100.

    bigrams is (gram, logp). Texts without words have no row.
    """
    given = texts.select(F.col(key).alias("k"), F.col(words).alias("ws")).where(F.size("ws") > 0)
    whole = given.select("k", F.size("ws").alias("n"), F.concat("ws", F.array(F.lit("</s>"))).alias("ws"))
    pairs = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat_ws(" ", F.element_at("ws", i), F.element_at("ws", i + 1)))
    each = whole.select("k", "n", F.explode(pairs).alias("gram"))
    scored = each.join(bigrams, "gram", "left").groupBy("k").agg(F.first("n").alias("n"), F.sum(F.coalesce("logp", F.lit(UNKNOWN))).alias("score"))
    return scored.withColumnRenamed("k", key)


def ngram_probability(gram: list[str], logs: dict[str, float], unknown: float = -1000.0) -> float:
    """The log probability of a run of words under a table of up to three words: looked up, or else the best of all cuts in
    two, each part again; a part of one to three words that the table does not have is `unknown`.

    Worked out from short runs to long ones, so n words take n^3 steps at most and not as many as there are cuttings.
    """
    n = len(gram)
    best: dict[tuple[int, int], float] = {}
    for size in range(1, n + 1):
        for a in range(n - size + 1):
            whole = logs.get(" ".join(gram[a : a + size])) if size <= 3 else None
            if whole is None:
                whole = unknown if size <= 3 else max(best[a, k] + best[k, a + size] for k in range(a + 1, a + size))
            best[a, a + size] = whole
    return best[0, n] if n else 0.0


def score_statistics(scores: DataFrame, share: float = 0.3, longest: int = 30) -> DataFrame:
    """(n, texts, kept, ratio): texts of each length up to `longest` words and those whose score passes; texts that are unknown
    throughout are left out before."""
    known = scores.where((F.col("n") <= longest) & (F.abs("score") != -UNKNOWN * (F.col("n") + 1)))
    sums = known.groupBy("n").agg(F.count("*").alias("texts"), F.count_if(F.col("score") > UNKNOWN * (F.col("n") + 1) * share).alias("kept"))
    return sums.withColumn("ratio", F.round(F.col("kept") / F.col("texts"), 6))


def likely_texts(scores: DataFrame, share: float = 0.3, least: int = 3) -> DataFrame:
    """Texts of `least` words or more with a score above -100 (n + 1) share that are not unknown throughout."""
    return scores.where((F.col("n") >= least) & (F.col("score") > UNKNOWN * (F.col("n") + 1) * share) & (F.col("score") > UNKNOWN * F.col("n")))


def stickiness(gram: list[str], logs: dict[str, float], anchors: dict[str, float]) -> float:
    """How much words belong together: l e^anchor 2 sigmoid(scp). logs are log10 probabilities, anchors natural logs; a gram
    missing in a table counts as probability 1 in the first and as e^0 - no weight of its own - in the second."""
    p = 10 ** logs.get(" ".join(gram), 0.0)
    if len(gram) == 1:
        scp, length = 2 * math.log10(p), 1.0
    else:
        cuts = [10 ** (logs.get(" ".join(gram[:k]), 0.0) + logs.get(" ".join(gram[k:]), 0.0)) for k in range(1, len(gram))]
        scp, length = math.log10(p * p / (sum(cuts) / len(cuts))), (len(gram) - 1) / len(gram)
    return length * math.exp(anchors.get(" ".join(gram), 0.0)) * 2 / (1 + math.exp(-scp))


def segment(words: list[str], logs: dict[str, float], anchors: dict[str, float], beam: int = 5, longest: int = 5) -> list[str]:
    """The cut of the words into segments of at most `longest` words with the greatest sum of stickiness, by a beam search."""
    best: list[list[tuple[float, list[str]]]] = [[(0.0, [])]]
    for end in range(1, len(words) + 1):
        here = []
        for start in range(max(0, end - longest), end):
            value = stickiness(words[start:end], logs, anchors)
            here += [(score + value, [*parts, " ".join(words[start:end])]) for score, parts in best[start]]
        here.sort(key=lambda x: (-round(x[0], 12), x[1]))
        best.append(here[:beam])
    return best[-1][0][1]


def segments(texts: DataFrame, key: str, words: str, grams: DataFrame, longest: int = 5) -> DataFrame:
    """(key, segments). grams is (gram, logp, anchor): the grams that a text holds are joined to it, so that no task needs
    the whole table; a text is one row of its own grams."""
    given = texts.select(F.col(key).alias("k"), F.col(words).alias("ws")).where(F.size("ws") > 0)
    held = given.select("k", F.explode(F.array_distinct(runs(F.col("ws"), 1, longest))).alias("gram")).join(grams, "gram")
    tables = held.groupBy("k").agg(F.collect_list(F.struct("gram", "logp", "anchor")).alias("g"))
    both = given.join(tables, "k", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ws, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows = g or []
                logs = {x["gram"]: x["logp"] for x in rows if x["logp"] is not None}
                out.append(segment(ws, logs, {x["gram"]: x["anchor"] for x in rows if x["anchor"] is not None}, longest=longest))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], [key, "segments"])

    return both.mapInArrow(run, f"`{key}` {given.schema['k'].dataType.simpleString()}, segments array<string>")
