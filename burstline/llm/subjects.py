"""Subject areas of documents.

Method: label propagation over a similarity graph of the documents by iterative DataFrame joins, with clamped seeds and
several subjects a document. Two documents are similar by the verified terms that their sentences share. The graph is kept
factored, as sentences and terms: a link between two documents is a term that stands in a sentence of both, so links are
never written out pair by pair, and one term or subject that a third of all documents share is one row, not their square.
A term is verified, and its links count, if the sentences that hold it lean clearly to one subject.

A round is two joins. Sentences join the terms' subjects and take the subject of the greatest sum; terms join the
sentences' subjects and take the shares of these. A document hands on a subject only where several of its sentences agree;
one that annotators labelled is clamped: it hands on the subjects they see in it and no others. Rounds end when the terms'
subjects stand still. In the end a document has each subject to which several of its sentences are given, and keeps a
clamped one to which at least one is given; a label that no sentence bears out, and a denied subject that several bear
out, are taken to be slips of an annotator.

Nothing is sampled, capped or collected: seeds are all labelled documents, terms all words that neither too few nor too
many documents hold. Sentences are partitioned by document once and cut by checkpoint(); later steps shuffle only what
they hand from sentences to terms, combined first. Whether the terms' subjects are broadcast or shuffled is the planner's
choice, by the size of the table that was written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burstline.session import ensure_checkpoint_dir, stored

_SENTENCE = re.compile(r"[.!?…]+|[\r\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


@dataclass(frozen=True)
class Params:
    """min_documents, max_share: of the documents that hold a term. lean: the share of one subject that verifies a term;
    faint: the least share of a further subject that it keeps. several: sentences that make a subject. smooth: sentences of
    no subject that are added to a term's. trust: the weight of a labelled document's sentence, others having 1. still: the share of terms that may still change when rounds end; rounds: at
    which they end in any case. turns: over the labelled documents alone, before the rounds."""

    min_documents: int = 3
    max_share: float = 0.05
    lean: float = 0.4
    faint: float = 0.1
    several: int = 2
    smooth: float = 0.5
    trust: float = 5.0
    still: float = 0.02
    rounds: int = 12
    turns: int = 2


def sentences(text: str | None) -> list[list[str]]:
    """The words (three letters or more, lower case) of each sentence or line that has any."""
    split = ([w for w in _WORD.findall(s) if len(w) > 2] for s in _SENTENCE.split((text or "").lower()))
    return [s for s in split if s]


def trusted_labels(labels: DataFrame, key: str, subject: str, tag: str) -> DataFrame:
    """(key, subject, holds): what the majority of annotators says of a document and a subject; ties and ? say nothing."""
    vote = F.when(F.upper(tag) == "T", 1).when(F.upper(tag) == "F", -1).otherwise(0)
    votes = labels.where(F.col(key).isNotNull() & F.col(subject).isNotNull()).groupBy(F.col(key).alias("doc"), F.col(subject).alias("subject"))
    return votes.agg(F.sum(vote).alias("v")).where("v <> 0").select("doc", "subject", (F.col("v") > 0).alias("holds"))


def sentence_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, s, fresh, terms): one row per sentence with the hashes of its distinct words; the first `fresh` of them stand in
    no earlier sentence of the document, so that documents can be counted without another look at the text."""
    slim = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    kind = slim.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        for batch in batches:
            if len(number) > 2_000_000:
                number.clear()
            place, at, fresh, flat, ends = [], [], [], [], [0]
            for k, t in enumerate(batch.column(1).to_pylist()):
                met: set[str] = set()
                for s, words in enumerate(sentences(t)):
                    here = set(words)
                    new = here - met
                    met |= new
                    for w in (*new, *(here - new)):
                        h = number.get(w)
                        if h is None:
                            h = number[w] = xxhash.xxh64_intdigest(w) - (1 << 63)
                        flat.append(h)
                    place.append(k)
                    at.append(s)
                    fresh.append(len(new))
                    ends.append(len(flat))
            terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            arrays = [batch.column(0).take(pa.array(place, pa.int64())), pa.array(at, pa.int32()), pa.array(fresh, pa.int32()), terms]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "s", "fresh", "terms"])

    return slim.mapInArrow(run, f"doc {kind}, s int, fresh int, terms array<bigint>")


def _by_document(sents: DataFrame) -> DataFrame:
    """The sentences partitioned and sorted by document, cut by checkpoint(). The plan that is cut is made without adaptive
    re-planning, because only then its partitioning and order are known to later steps, which thus need no exchange."""
    with _set(sents.sparkSession, "spark.sql.adaptive.enabled"):
        return sents.repartition("doc").sortWithinPartitions("doc", "s").checkpoint()


@contextmanager
def _set(spark: SparkSession, name: str, value: str = "false") -> Iterator[None]:
    """A setting of the session while a step is planned and run, then as it was."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def term_statistics(sents: DataFrame, n_documents: Column, p: Params) -> DataFrame:
    """(term, seen): the sentences that hold each term that neither too few nor too many documents hold."""
    each = sents.select("fresh", F.posexplode("terms").alias("i", "term"))
    counts = each.groupBy("term").agg(F.count("*").alias("seen"), F.count_if(F.col("i") < F.col("fresh")).alias("df"))
    return counts.where((F.col("df") >= p.min_documents) & (F.col("df") <= F.greatest(F.lit(p.min_documents), F.lit(p.max_share) * n_documents))).select("term", "seen")


def verified_terms(weights: DataFrame, seen: DataFrame, p: Params) -> DataFrame:
    """(term, subject, share, worth) of the terms that lean to a subject, from (term, subject, weight): share is the part of
    the term's sentences given to the subject, worth the share times the term's greatest one."""
    shares = weights.join(seen, "term").select("term", "subject", (F.col("weight") / (F.col("seen") + p.smooth)).alias("share"))
    top = F.max("share").over(Window.partitionBy("term"))
    return shares.withColumn("top", top).where((F.col("top") >= p.lean) & (F.col("share") >= p.faint)).select("term", "subject", "share", (F.col("share") * F.col("top")).alias("worth"))


def told_sentences(sents: DataFrame, labels: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(doc, s, subject, n): the subject of each sentence with verified terms, and how many sentences of its document have
    it; with marks, only such a subject as the document's labels allow. All groups are within a document, by which sents is
    partitioned."""
    met = sents.select("doc", "s", F.explode("terms").alias("term")).join(labels.select("term", "subject", "worth"), "term")
    sums = met.groupBy("doc", "s", "subject").agg(F.sum("worth").alias("w"))
    if marks is not None:
        sums = sums.join(marks, "doc", "left").where(F.when(_clamped(), F.array_contains("yes", F.col("subject"))).otherwise(~F.coalesce(F.array_contains("no", F.col("subject")), F.lit(False))))
    best = sums.groupBy("doc", "s").agg(F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("subject")).alias("k"))).alias("m")).select("doc", "s", (-F.col("m.k")).alias("subject"))
    return best.withColumn("n", F.count("*").over(Window.partitionBy("doc", "subject")))


def _clamped() -> Column:
    return F.coalesce(F.size("yes") > 0, F.lit(False))


def handed_on(sents: DataFrame, labels: DataFrame, marks: DataFrame, p: Params) -> DataFrame:
    """(term, subject, weight): the sentences of each subject that hold a term, after one round over the documents of sents.

    marks (doc, yes, no) clamps: a labelled document hands on what is in yes only, with the weight p.trust a sentence, any
    other what several of its sentences agree on and what is not in no. A document of one subject in yes hands it on from
    every sentence, which is how a term that no other seed holds gets a first link.
    """
    told = told_sentences(sents, labels, marks).join(marks.select("doc", "yes"), "doc", "left")
    several = told.where(F.when(_clamped(), F.size("yes") > 1).otherwise(F.col("n") >= p.several))
    passed = several.select("doc", "s", "subject", F.when(_clamped(), p.trust).otherwise(1.0).alias("weight"))
    single = marks.where(F.size("yes") == 1).select("doc", F.col("yes")[0].alias("subject"), F.lit(p.trust).alias("weight"))
    passed = passed.unionByName(sents.select("doc", "s").join(single, "doc"))
    each = sents.select("doc", "s", "terms").join(passed, ["doc", "s"]).select("subject", "weight", F.explode("terms").alias("term"))
    return each.groupBy("term", "subject").agg(F.sum("weight").alias("weight"))


def propagate(sents: DataFrame, marks: DataFrame, n_documents: Column, p: Params) -> DataFrame:
    """(term, subject, share, worth): the terms' subjects when they stand still."""
    usual = stored(term_statistics(sents, n_documents, p))
    seeds = stored(sents.join(marks.where(F.size("yes") > 0).select("doc"), "doc", "left_semi").select("doc", "s", "terms"))
    known = stored(seeds.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("seen")).join(usual.select("term"), "term", "left_semi"))
    seen = stored(usual.join(known.withColumnRenamed("seen", "own"), "term", "left").select("term", (F.col("seen") + (p.trust - 1) * F.coalesce("own", F.lit(0))).alias("seen")))
    first = seeds.join(marks, "doc").select("terms", F.size("yes").alias("m"), F.explode("yes").alias("subject"))
    weights = first.select("subject", "m", F.explode("terms").alias("term")).groupBy("term", "subject").agg(F.sum(1 / F.col("m")).alias("weight"))
    labels = stored(verified_terms(weights, known, p))
    for _ in range(p.turns):
        weights = handed_on(seeds, labels, marks, p).withColumn("weight", F.col("weight") / p.trust)
        labels = stored(verified_terms(weights, known, p))
    for _ in range(p.rounds):
        with _set(sents.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition"):  # joined by (doc, s), partitioned by doc
            after = stored(verified_terms(handed_on(sents, labels, marks, p), seen, p))
        main = [x.groupBy("term").agg(F.max_by("subject", "share").alias("k")) for x in (labels, after)]
        moved = main[0].join(main[1].withColumnRenamed("k", "now"), "term", "full").agg(F.count_if(~F.col("k").eqNullSafe(F.col("now"))).alias("moved"), F.count("*").alias("n")).first()
        labels = after
        if moved["moved"] <= p.still * moved["n"]:
            break
    return labels


def subjects_of(docs: DataFrame, key: str, text: str, labels: DataFrame, names: list[str], p: Params = Params()) -> DataFrame:
    """(key, subject, n_sentences, share): each document and each subject to which p.several of its sentences or more are
    given, and each that annotators see in it to which one is given.

    share is the part of the document's sentences with verified terms. Documents with null, empty or blank text, and those
    without any subject, have no row; rows of one key are one document only if the key is unique, as it should be.
    labels has the columns of key, subject and tag (T, F, ?), names is the closed list of subjects; labels of others take no
    part.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    names = sorted(names)
    at = F.create_map(*(F.lit(x) for k, s in enumerate(names) for x in (s, k))) if names else F.expr("map('', 0)")
    trusted = trusted_labels(labels, key, "subject", "tag").select("doc", F.try_element_at(at, "subject").alias("s"), "holds").where("s is not null")
    marks = stored(trusted.groupBy("doc").agg(F.sort_array(F.collect_set(F.when(F.col("holds"), F.col("s")))).alias("yes"), F.sort_array(F.collect_set(F.when(~F.col("holds"), F.col("s")))).alias("no")))
    sents = _by_document(sentence_terms(docs, key, text))
    final = propagate(sents, marks, docs.where(F.col(text).isNotNull()).agg(F.count("*").alias("n")).scalar(), p)
    told = told_sentences(sents, final).groupBy("doc", "subject").agg(F.count("*").alias("n_sentences"))
    shared = told.withColumn("share", F.round(F.col("n_sentences") / F.sum("n_sentences").over(Window.partitionBy("doc")), 4)).join(marks.select("doc", "yes"), "doc", "left")
    kept = shared.where((F.col("n_sentences") >= p.several) | F.coalesce(F.array_contains("yes", F.col("subject")), F.lit(False)))
    named = F.element_at(F.array(*map(F.lit, names)) if names else F.expr("array('')"), F.col("subject") + 1)
    return kept.select(F.col("doc").alias(key), named.alias("subject"), "n_sentences", "share")


def make_up(found: DataFrame, key: str) -> DataFrame:
    """(subject, n_documents, n_sentences): the make-up of the corpus by subject."""
    return found.groupBy("subject").agg(F.count_distinct(key).alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))
