"""Spans and triples out of tagged, chunked and parsed texts.

Tokens come as arrays of structs (word, tag, ...). The functions on plain lists are the logic; the table operators run
them over Arrow batches, row for row and without a shuffle. Null and empty token arrays give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstline.functions.text import lexical_class

TRIPLES = pa.list_(pa.struct([("arg1", pa.string()), ("verb", pa.string()), ("arg2", pa.string())]))
TRIPLES_SQL = "array<struct<arg1:string,verb:string,arg2:string>>"
Span = tuple[int, int]

# Which tags can stand in a relation phrase as verb, as preposition or particle, or between the two.
VERB = ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "MD")
LINK = ("IN", "TO", "RP")
BETWEEN = ("NN", "NNS", "NNP", "NNPS", "JJ", "JJR", "JJS", "RB", "RBR", "RBS", "PRP", "PRP$", "DT")
NOT_ARGUMENT = ("WDT", "WP", "WP$", "EX")
EDGE = ("UH", ",", ".", "-LRB-", "-RRB-")
PATTERNS = (re.compile(r"(?:VP?)+"), re.compile(r"(?:V(?:W*P+)?)+"))


def relation_spans(tags: list[str]) -> list[Span]:
    """The longest span from each start that matches one of the patterns; spans are [start, end)."""
    letters = "".join("V" if t in VERB else "P" if t in LINK else "W" if t in BETWEEN else "x" for t in tags)
    out = []
    for at in range(len(letters)):
        ends = [m.end() for p in PATTERNS if (m := p.match(letters, at))]
        if ends:
            out.append((at, max(ends)))
    return out


def merge(spans: list[Span]) -> list[Span]:
    """Overlapping spans merged; spans that only touch stay apart."""
    out: list[Span] = []
    for st, ed in sorted(spans):
        if out and st < out[-1][1]:
            out[-1] = (out[-1][0], max(ed, out[-1][1]))
        else:
            out.append((st, ed))
    return out


def trim_phrases(spans: list[Span], tags: list[str]) -> list[Span]:
    """Noun phrases bare of interjections and punctuation at both ends, cut at punctuation inside; pieces that end in a noun."""
    out = []
    for st, ed in spans:
        pieces, begin = [], st
        for k in range(st, ed + 1):
            if k == ed or tags[k] in EDGE:
                if begin < k:
                    pieces.append((begin, k))
                begin = k + 1
        out += [(a, b) for a, b in pieces if tags[b - 1].startswith("NN")]
    return out


def noun_phrases(tags: list[str]) -> list[Span]:
    """Runs of determiners, adjectives, numbers and nouns that end in a noun, where no chunker gave any."""
    out, at = [], 0
    while at < len(tags):
        end = at
        while end < len(tags) and tags[end] in ("DT", "PRP$", "JJ", "JJR", "JJS", "CD", "NN", "NNS", "NNP", "NNPS", "PRP"):
            end += 1
        stop = end
        while stop > at and not tags[stop - 1].startswith(("NN", "PRP")):
            stop -= 1
        if stop > at:
            out.append((at, stop))
        at = max(end, at + 1)
    return out


def attach(span: Span, phrases: list[Span], tags: list[str]) -> tuple[Span | None, Span | None]:
    """The nearest valid phrase on the left and on the right of a span; else the nearest single noun; else nothing."""
    valid = [p for p in phrases if not any(t in NOT_ARGUMENT for t in tags[p[0] : p[1]])]
    left = max((p for p in valid if p[1] <= span[0]), key=lambda p: p[1], default=None)
    right = min((p for p in valid if p[0] >= span[1]), key=lambda p: p[0], default=None)
    nouns = [(k, k + 1) for k, t in enumerate(tags) if t.startswith("NN")]
    left = left or max((p for p in nouns if p[1] <= span[0]), default=None)
    right = right or min((p for p in nouns if p[0] >= span[1]), default=None)
    return left, right


def slot(words: list[str], span: Span | None) -> str:
    """The words of a span joined by _, lower case, mentions as @usr, without |, long repeats squeezed."""
    if span is None:
        return ""
    out = []
    for w in words[span[0] : span[1]]:
        w = "@usr" if w.startswith("@") and len(w) > 1 else w.replace("|", "")
        out.append(re.sub(r"(\w)\1{3,}", r"\1\1\1", w.lower()))
    return "_".join(x for x in out if x)


def triples(words: list[str], tags: list[str], phrases: list[Span] | None = None) -> list[dict]:
    """The triples of a text; those with both arguments empty are left out, and so are texts with a foreign word."""
    if "FW" in tags:
        return []
    found = trim_phrases(phrases if phrases is not None else noun_phrases(tags), tags)
    out = []
    for span in merge(relation_spans(tags)):
        left, right = attach(span, found, tags)
        a, v, b = slot(words, left), slot(words, span), slot(words, right)
        if v and (a or b):
            out.append({"arg1": a, "verb": v, "arg2": b})
    return out


def entity_spans(tags: list[str], begin_only: bool = False) -> list[Span]:
    """Spans of BIO tags: any tag but O starts one, I- goes on with it; begin_only asks for B- at the start."""
    out, at = [], 0
    while at < len(tags):
        if tags[at] != "O" and (not begin_only or tags[at].startswith("B-")):
            end = at + 1
            while end < len(tags) and tags[end].startswith("I-"):
                end += 1
            out.append((at, end))
            at = end
        else:
            at += 1
    return out


def event_triples(words: list[str], entities: list[str], events: list[str], last: bool = True) -> list[dict]:
    """Event phrases with an entity on each side: the last one on either side, or the nearest; without any entity dropped."""
    named = entity_spans(entities)
    out = []
    for span in entity_spans(events):
        left = [e for e in named if e[1] <= span[0]]
        right = [e for e in named if e[0] >= span[1]]
        a = left[-1] if left else None
        b = (right[-1] if last else right[0]) if right else None
        if a or b:
            out.append({"arg1": slot(words, a), "verb": slot(words, span), "arg2": slot(words, b)})
    return out


# Closed classes of the small tagger.
CLOSED = {
    **dict.fromkeys("a an the this that these those some any every another each no".split(), "DT"),
    **dict.fromkeys("in on at of for with from by about against between during near over under after before without".split(), "IN"),
    **dict.fromkeys("i you he she it we they him her them us me everyone somebody nobody".split(), "PRP"),
    **dict.fromkeys("my your his its our their".split(), "PRP$"),
    **dict.fromkeys("and or but".split(), "CC"), **dict.fromkeys("is are was were be been has have had do does did".split(), "VBZ"),
    **dict.fromkeys("will would can could may might must should shall".split(), "MD"), "to": "TO", "up": "RP", "out": "RP", "off": "RP",
    **dict.fromkeys("who what whom".split(), "WP"), "which": "WDT", "there": "EX",
}


def rule_tags(words: list[str]) -> list[str]:
    """Tags by closed classes and endings: a stand-in where no tagger is at hand."""
    out = []
    for w in words:
        low = w.lower()
        if low in CLOSED:
            out.append(CLOSED[low])
        elif not re.search(r"\w", w):
            out.append(w if w in (",", ".") else "UH")
        elif w.startswith(("@", "#")) or w[0].isupper():
            out.append("NNP")
        elif re.fullmatch(r"[\d.,:$%-]+", w):
            out.append("CD")
        elif low.endswith("ed"):
            out.append("VBD")
        elif low.endswith("ing"):
            out.append("VBG")
        elif low.endswith("ly"):
            out.append("RB")
        elif low.endswith(("ous", "ful", "ive", "able", "al", "ic")):
            out.append("JJ")
        else:
            out.append("NNS" if low.endswith("s") and not low.endswith("ss") else "NN")
    return out


def lemma(word: str, tag: str) -> str:
    """The base form by rules on the ending, for nouns and verbs."""
    w = word.lower()
    if tag.startswith("NN") and len(w) > 3:
        for end, to in (("sses", "ss"), ("ies", "y"), ("ches", "ch"), ("shes", "sh"), ("xes", "x")):
            if w.endswith(end):
                return w[: -len(end)] + to
        return w[:-1] if w.endswith("s") and not w.endswith(("ss", "us", "is")) else w
    if tag.startswith("VB") and len(w) > 4:
        for end in ("ing", "ed"):
            if w.endswith(end) and len(w) - len(end) >= 3:
                stem = w[: -len(end)]
                if len(stem) > 3 and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                    return stem[:-1]
                return stem + "e" if re.search(r"[^aeiou][aeiou][^aeiouwxy]$", stem) and len(stem) <= 4 else stem
        return w[:-1] if w.endswith("s") and not w.endswith("ss") else w
    return w


def _each(df: DataFrame, key: str, columns: list[str], run, kind: pa.DataType, name: str, kind_sql: str) -> DataFrame:
    slim = df.select(F.col(key).alias("_k"), *columns)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([run(*r) for r in rows], kind)], [key, name])

    return slim.mapInArrow(go, f"`{key}` {slim.schema['_k'].dataType.simpleString()}, {name} {kind_sql}")


def frame_triples(df: DataFrame, key: str, tokens: str, phrases: str | None = None) -> DataFrame:
    """(key, frames) of tagged tokens array<struct<word,tag>> and, where a chunker gave them, phrases array<struct<st,ed>>."""

    def run(toks, nps=None):
        toks = [t for t in toks or [] if t and t["word"]]
        spans = [(p["st"], p["ed"]) for p in nps if p] if nps is not None else None
        return triples([t["word"] for t in toks], [t["tag"] or "" for t in toks], spans)

    return _each(df, key, [tokens] + ([phrases] if phrases else []), run, TRIPLES, "frames", TRIPLES_SQL)


def entity_triples(df: DataFrame, key: str, tokens: str, last: bool = True) -> DataFrame:
    """(key, frames) of tokens array<struct<word,ne,pos,evt>>."""

    def run(toks):
        toks = [t for t in toks or [] if t]
        return event_triples([t["word"] or "" for t in toks], [t["ne"] or "O" for t in toks], [t["evt"] or "O" for t in toks], last)

    return _each(df, key, [tokens], run, TRIPLES, "frames", TRIPLES_SQL)


def tagged(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tokens): words and rule tags of a text."""
    kind = pa.list_(pa.struct([("word", pa.string()), ("tag", pa.string())]))

    def run(t):
        ws = re.findall(r"[@#]?\w+(?:['-]\w+)*|[^\w\s]", t or "")
        return [{"word": w, "tag": g} for w, g in zip(ws, rule_tags(ws), strict=True)]

    return _each(df, key, [text], run, kind, "tokens", "array<struct<word:string,tag:string>>")


def dependency_relations(tokens: DataFrame, key: str, mode: str = "modifiers") -> DataFrame:
    """(key, head, dependent, rel) of a token table (key, idx, word, tag, parent, rel); parent -1 is the root.

    modifiers: every dependent of every head. verbs: of verbs only. subjects: subjects of verbs. root: dependents of the root
    word. subtree: dependents of dependents of the root too. Self-joins on (key, parent = idx).
    """
    t = tokens.select(key, "idx", "word", "tag", "parent", "rel")
    head = t.select(key, F.col("idx").alias("parent"), F.col("word").alias("head"), F.col("tag").alias("head_tag"), F.col("parent").alias("up"))
    both = t.join(head, [key, "parent"])
    if mode == "verbs":
        both = both.where(F.col("head_tag").startswith("VB"))
    elif mode == "subjects":
        both = both.where(F.col("head_tag").startswith("VB") & F.lower("rel").contains("sub"))
    elif mode == "root":
        both = both.where(F.col("up") == -1)
    elif mode == "subtree":
        roots = t.where("parent = -1").select(key, F.col("idx").alias("root"))
        near = both.join(roots, key)
        both = near.where((F.col("parent") == F.col("root")) | (F.col("up") == F.col("root")))
    elif mode != "modifiers":
        raise ValueError(f"mode {mode!r}")
    return both.select(key, "head", F.col("word").alias("dependent"), "rel").distinct()


def lexical_units(phrases: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(phrase, pos, lu_name, frame_id): the exact unit of name and class with the least id, else the shortest unit of the
    same class whose words hold the phrase's words in a row. The fallback meets units through the phrase's first word."""
    exact = phrases.join(lexicon, (F.col("phrase") == F.col("lu_name")) & (F.col("pos") == F.col("lu_pos")))
    best = exact.groupBy("phrase", "pos").agg(F.min(F.struct("lu_id", "lu_name", "frame_id")).alias("m"))
    rest = phrases.join(best, ["phrase", "pos"], "left_anti").withColumn("first", F.split("phrase", " ")[0])
    inside = lexicon.withColumn("first", F.explode(F.array_distinct(F.split("lu_name", " "))))
    met = rest.join(inside, (rest["first"] == inside["first"]) & (F.col("pos") == F.col("lu_pos"))).where(F.contains(F.concat(F.lit(" "), "lu_name", F.lit(" ")), F.concat(F.lit(" "), "phrase", F.lit(" "))))
    short = met.groupBy("phrase", "pos").agg(F.min(F.struct(F.length("lu_name").alias("len"), "lu_name", "lu_id", "frame_id")).alias("m"))
    one = best.select("phrase", "pos", "m.lu_name", "m.frame_id")
    return one.unionByName(short.select("phrase", "pos", "m.lu_name", "m.frame_id"))


def interval_relation(a: Column, b: Column) -> Column:
    """How span a (struct st, ed, both inclusive) lies to span b: left, left adjacent, right, right adjacent as seen from a to
    b (left: b ends before a), cover (b covers a), inside (b lies in a), left or right overlap. Null if a span is null."""
    s1, e1, s2, e2 = a["st"], a["ed"], b["st"], b["ed"]
    return (
        F.when(e2 + 1 < s1, "left").when(e2 + 1 == s1, "left adjacent").when(s2 > e1 + 1, "right").when(s2 == e1 + 1, "right adjacent")
        .when((s2 <= s1) & (e1 <= e2), "cover").when((s1 <= s2) & (e2 <= e1), "inside").when(s2 < s1, "left overlap").when(s1 < s2, "right overlap")
    )


# The weight of each feature of an extraction, by name.
CONFIDENCE = {
    "covers_text": 1.16, "ends_for": 0.5, "ends_on": 0.49, "ends_of": 0.46, "short": 0.43, "wh_before": 0.43, "long_relation": 0.42, "ends_to": 0.39, "ends_in": 0.25, "middling": 0.23,
    "arg1_first": 0.21, "arg1_name": 0.16, "arg2_name": 0.01, "name_before_arg1": -0.3, "long": -0.43, "one_word_verb": -0.61, "preposition_first": -0.65, "name_after_arg2": -0.81, "conjunction_before": -0.93,
}


def extraction_features(words: list[str], tags: list[str], relation: Span, arg1: Span | None, arg2: Span | None) -> dict[str, bool]:
    """What speaks for or against a triple: the features of CONFIDENCE. Spans are inclusive places in words."""
    st, ed = relation
    n, last = len(words), words[ed].lower()
    spans = [x for x in (arg1, relation, arg2) if x]
    inner = tags[st : ed + 1]
    name = lambda x: x is not None and tags[x[1]].startswith("NNP")
    some = lambda part, tag: any(t.startswith(tag) for t in part)
    return {
        "covers_text": sum(b - a + 1 for a, b in spans) == n,
        **{f"ends_{w}": last == w for w in ("for", "on", "of", "to", "in")},
        "short": n <= 10, "middling": 10 < n <= 20, "long": n > 20,
        "wh_before": some(tags[:st], "W"), "conjunction_before": some(tags[:st], "CC"),
        "long_relation": inner[0].startswith("VB") and len(inner) > 1 and inner[-1][:2] in ("IN", "TO", "RP"),
        "one_word_verb": st == ed,
        "arg1_first": arg1 is None or arg1[0] == 0, "arg1_name": name(arg1), "arg2_name": name(arg2),
        "name_before_arg1": arg1 is not None and some(tags[: arg1[0]], "NNP"),
        "preposition_first": arg1 is not None and arg1[0] > 0 and tags[0][:2] in ("IN", "TO"),
        "name_after_arg2": arg2 is not None and some(tags[arg2[1] + 1 :], "NNP"),
    }


def confidence(features: dict[str, bool]) -> float:
    """The weighted sum of the features that hold."""
    return round(sum(CONFIDENCE[k] for k, holds in features.items() if holds), 4)


def lexical_patterns(tokens: DataFrame, key: str, lexicon: DataFrame, longest: int = 3) -> DataFrame:
    """(key, at, pattern): runs of one to `longest` words of a text that name a lexical unit, as `words.frame`.

    tokens is (key, tokens array<struct<word,tag>>), lexicon (lu_name, lu_pos, frame_id). A run may not begin with a
    determiner, preposition, comma, full stop or interjection if it is one word, holds no word of a class that evokes
    nothing, and is looked up by its words' forms and the class of its last tag. Runs are joined with the lexicon.
    """
    t = tokens.select(F.col(key).alias("k"), F.col("tokens").alias("ts"))
    starts = t.where(F.size("ts") > 0).select("k", "ts", F.explode(F.sequence(F.lit(1), F.size("ts"))).alias("i"))
    lengths = F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.col("i") + n - 1 <= F.size("ts"))
    runs = starts.select("k", "i", F.explode(F.transform(lengths, lambda n: F.slice("ts", F.col("i"), n))).alias("run"))
    tag = lambda x: F.upper(x["tag"])
    useless = F.exists("run", lambda x: tag(x).rlike("^(CC|IN|TO|UH|[^A-Z].*)$"))
    alone = (F.size("run") == 1) & tag(F.col("run")[0]).isin("DT", ".", "UH", ",", "IN")
    kept = runs.where(~useless & ~alone).withColumn("words", F.transform("run", lambda x: F.lower(x["word"]))).withColumn("pos", lexical_class(tag(F.element_at("run", -1))))
    named = kept.select("k", "i", "words", "pos", F.array_join("words", " ").alias("lu_name"))
    met = named.join(lexicon.select("lu_name", F.col("lu_pos").alias("pos"), "frame_id"), ["lu_name", "pos"])
    return met.select(F.col("k").alias(key), (F.col("i") - 1).alias("at"), F.concat(F.array_join("words", "_"), F.lit("."), F.col("frame_id").cast("string")).alias("pattern"))


def joined_context(words: Column, elements: Column) -> Column:
    """A text as context words in which the elements of its frames (words joined by _) stand as one word each: longer
    elements first, punctuation left out, lower case. A null element list changes nothing."""
    plain = F.filter(F.transform(words, F.lower), lambda w: ~w.isin(",", ".", ";", "?", "!", "#", "&", "<", ">"))
    spaced = F.concat(F.lit(" "), F.array_join(plain, "  "), F.lit(" "))
    order = F.transform(F.array_sort(F.transform(F.filter(F.coalesce(elements, F.array()), lambda e: e != ""), lambda e: F.struct((-F.length(e)).alias("n"), F.lower(e).alias("e")))), lambda x: x["e"])
    inside = F.aggregate(order, spaced, lambda text, e: F.replace(text, F.concat(F.lit(" "), F.replace(e, F.lit("_"), F.lit("  ")), F.lit(" ")), F.concat(F.lit(" "), e, F.lit(" "))))
    return F.trim(F.regexp_replace(inside, " +", " "))


def for_chunker(line: Column) -> Column:
    """A line of word_TAG words as the chunker wants it: word/TAG, USR as NN, retweet marks and links dropped; what is empty,
    or a mention alone, is ---/P."""
    slashed = F.replace(F.replace(F.trim(F.regexp_replace(line, "\\s+", " ")), F.lit("_"), F.lit("/")), F.lit("/USR"), F.lit("/NN"))
    kept = F.filter(F.split(slashed, " "), lambda w: (w != "") & ~F.regexp_extract(w, "([^/]*)$", 1).isin("RT", "URL"))
    alone = (F.size(kept) == 0) | ((F.size(kept) == 1) & F.element_at(kept, 1).startswith("@"))
    return F.when(alone, "---/P").otherwise(F.array_join(kept, " "))


def plain_name(phrase: Column) -> Column:
    """A phrase without brackets and signs that mean something in a pattern."""
    return F.regexp_replace(phrase, "[()\\[\\]{}*?+^.$#!\\-\\\\/]", "")


def phrase_statistics(phrases: DataFrame) -> DataFrame:
    """(n_words, pattern, n): phrases (tokens array<struct<word,tag>>) by length and by the tags that they are made of."""
    return phrases.where(F.size("tokens") > 0).groupBy(F.size("tokens").alias("n_words"), F.array_join("tokens.tag", " ").alias("pattern")).agg(F.count("*").alias("n"))
