"""Column functions over texts and word arrays. All stay inside the JVM; a null text gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English function words that carry no event. A longer list is a parameter of the functions below.
STOPWORDS = (
    "a about after again against all also although am an and another any are as at be because been before but by can "
    "could did do does during every few for from had has have he her here him his how i if in into is it its just may me "
    "might more most must my near no nor not now of off on once only or other our out over own s same shall she should so "
    "some such t than that the their them then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with without would you your"
).split()
# The signs of the zodiac and what goes with them.
ZODIAC = (
    "aries taurus gemini cancer leo virgo libra scorpio sagittarius capricorn aquarius pisces horoscope horoscopes zodiac "
    "zodiacs astrology scorpios geminis leos virgos libras cancers"
).split()


def once(value: Column, use) -> Column:
    """use(value) with value computed once: a name inside an expression, which Catalyst would otherwise write out at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Lower case, `|` read as a space, cut at white space, empty pieces dropped."""
    return F.filter(F.split(F.replace(F.lower(text), F.lit("|"), F.lit(" ")), "[ \t\r\n]+"), lambda w: F.length(w) >= 1)


def without(arr: Column, stop: list[str] = STOPWORDS) -> Column:
    """Stop words dropped; repeats stay."""
    listed = F.array(*map(F.lit, stop))
    return F.filter(arr, lambda w: ~F.array_contains(listed, w))


def without_urls(arr: Column) -> Column:
    return F.filter(arr, lambda w: ~F.contains(w, F.lit("http")))


def only_punctuation(w: Column) -> Column:
    return ~w.rlike("[a-zA-Z0-9]")


def illegal(w: Column) -> Column:
    """Holds a character outside U+0020 to U+007E."""
    return w.rlike("[^\\x20-\\x7E]")


def valid_url(w: Column) -> Column:
    """The first 20 characters of a word that begins with http and has more than 20; any other is null."""
    return F.when(w.startswith("http") & (F.length(w) > 20), F.substring(w, 1, 20))


def decode_entities(w: Column) -> Column:
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        w = F.replace(w, F.lit(name), F.lit(ch))
    return w


def strip_edges(w: Column) -> Column:
    """What is no letter, digit or $ is cut from both ends."""
    return F.regexp_replace(w, "^[^a-zA-Z0-9$]+|[^a-zA-Z0-9$]+$", "")


def printable(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\x20-\\x7E]", "")


def space_before_punctuation(w: Column) -> Column:
    return F.regexp_replace(w, "([!,.;?])", " $1")


def clean_word(w: Column) -> Column:
    """One word cleaned by its kind: link, mention, tag or plain; null where it is to be dropped."""
    mention = F.regexp_replace(F.regexp_extract(w, "(@.*)$", 1), "[^@a-zA-Z0-9_]", " ")
    tag = F.concat(F.lit("#"), strip_edges(F.regexp_replace(w, "^#+", "")))
    cleaned = (
        F.when(F.contains(w, F.lit("http")), valid_url(w))
        .when(F.contains(w, F.lit("@")), F.trim(mention))
        .when(only_punctuation(w) & (F.length(w) > 1), None)
        .when(w.startswith("#"), F.nullif(tag, F.lit("#")))
        .otherwise(strip_edges(decode_entities(w)))
    )
    return once(cleaned, lambda c: F.when((c != "") & ~illegal(c), c))


def clean(text: Column) -> Column:
    """The words of a text, cleaned; those to be dropped are left out."""
    pieces = F.filter(F.split(text, "[ \t\r\n]+"), lambda w: F.length(w) >= 1)
    return F.filter(F.transform(pieces, clean_word), lambda w: w.isNotNull())


def squeeze_repeats(text: Column) -> Column:
    """Four or more of one character become three."""
    return F.regexp_replace(text, "(\\w)\\1{3,}", "$1$1$1")


def mark_mentions(arr: Column) -> Column:
    """Mentions read @usr; `|` is deleted from every word."""
    return F.transform(arr, lambda w: F.when(w.startswith("@") & (F.length(w) > 1), "@usr").otherwise(F.replace(w, F.lit("|"), F.lit(""))))


def grams(arr: Column, least: int = 2, most: int | Column = 5, glue: str = " ") -> Column:
    """All runs of least to most words of an array, joined."""

    def at(i: Column) -> Column:
        lengths = F.filter(F.sequence(F.lit(least), most if isinstance(most, Column) else F.lit(most)), lambda n: i + n - 1 <= F.size(arr))
        return F.transform(lengths, lambda n: F.array_join(F.slice(arr, i, n), glue))

    return F.when(F.size(arr) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.size(arr)), at))).otherwise(F.expr("cast(array() as array<string>)"))


def good_gram(gram: Column, stop: list[str] = STOPWORDS) -> Column:
    """No word of one or two letters, no punctuation inside, no stop word, no number alone, words of four letters on average, no @usr."""
    parts = F.split(gram, " ")
    listed = F.array(*map(F.lit, stop))
    total = F.aggregate(parts, F.lit(0), lambda a, w: a + F.length(w))
    fine = F.forall(parts, lambda w: (F.length(w) > 2) & ~w.rlike("[^a-z0-9_'-]") & w.rlike("^[a-z0-9]") & ~F.array_contains(listed, w) & ~w.rlike("^[0-9]+$"))
    return fine & (F.floor(total / F.size(parts)) >= 4)


def labelled_english(lang: Column) -> Column:
    """Whether a label names English in any spelling: letter case, a region added, the three-letter code. Null for no label."""
    return F.split(F.lower(F.trim(lang)), "[-_]").getItem(0).isin("en", "eng")


def english(text: Column, lang: Column, vocabulary: list[str], share: float = 0.8) -> Column:
    """Labelled English, or that share of its words is in the vocabulary."""
    listed = F.array(*map(F.lit, vocabulary))
    enough = once(words(text), lambda w: F.size(F.filter(w, lambda x: F.array_contains(listed, x))) >= share * F.size(w))
    return F.coalesce(labelled_english(lang), F.lit(False)) | F.coalesce(enough, F.lit(False))


def normalise(arr: Column, table: dict[str, str]) -> Column:
    """Words replaced by a table; RT and links dropped, # removed."""
    kept = F.filter(arr, lambda w: (w != "RT") & ~F.contains(w, F.lit("://")))
    bare = F.transform(kept, lambda w: F.replace(w, F.lit("#"), F.lit("")))
    if not table:
        return bare
    lookup = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.transform(bare, lambda w: F.coalesce(F.try_element_at(lookup, w), w))


def trim_tags(arr: Column) -> Column:
    """Tag words at both ends dropped."""
    first = F.array_position(F.transform(arr, lambda w: ~w.startswith("#")), True)
    last = F.array_position(F.reverse(F.transform(arr, lambda w: ~w.startswith("#"))), True)
    n = F.size(arr)
    return F.when(first > 0, F.slice(arr, first.cast("int"), (n - last + 1 - first + 1).cast("int"))).otherwise(F.expr("cast(array() as array<string>)"))


def twelve_hour_time(text: Column) -> Column:
    """`8:15 AM - 14 Oct 2012` as a timestamp; null if it is none."""
    return F.try_to_timestamp(text, F.lit("h:mm a - d MMM yyyy"))


def long_time(text: Column) -> Column:
    """`Sun Jan 23 00:00:02 +0000 2011` as a timestamp (UTC); null if it is none."""
    return F.try_to_timestamp(F.regexp_extract(text, "^[A-Z][a-z]{2} ([A-Z][a-z]{2} [0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}) \\+0000 ([0-9]{4})$", 0).substr(5, 26), F.lit("MMM dd HH:mm:ss Z yyyy"))


def sub_window(ts: Column, hours: int = 2) -> Column:
    """Aligned bins of some hours, numbered from 1."""
    return (F.floor(F.hour(ts) / hours) + 1).cast("int")


def stem(w: Column) -> Column:
    """A word without the ending of an inflected form (ing, ed, s)."""
    return F.regexp_replace(w, "(ing|ed|s)$", "")


def lexical_class(tag: Column) -> Column:
    """The lexical class of a part-of-speech tag: n v a adv c num prep intj, else null."""
    out = F.lit(None).cast("string")
    for start, name in (("NN", "n"), ("VB", "v"), ("JJ", "a"), ("RB", "adv"), ("CC", "c"), ("CD", "num"), ("IN", "prep"), ("TO", "prep"), ("UH", "intj")):
        out = F.when(tag.startswith(start), name).otherwise(out)
    return out


def bare_relation(relation: Column) -> Column:
    """Tags (`__tag`) cut from the parts of a dependency relation written with ||."""
    return F.array_join(F.transform(F.split(relation, "\\|\\|"), lambda w: F.regexp_replace(w, "__.*$", "")), "||")
