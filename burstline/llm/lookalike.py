"""Texts that look the same but differ in their characters.

Method: confusables skeleton. A text is decomposed (NFD), every character is replaced by its prototype, the result is
decomposed again, and texts with equal skeletons are grouped. The skeleton is handed out composed (NFC), so that an
accented letter stays one letter for later steps; composition is a bijection on decomposed texts and groups alike.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of the Cyrillic and Greek alphabets and the Latin letters of the same shape.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXaesijopcyxhdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXovcj"

DOTS = {"․", "‥", "…"}


@lru_cache(maxsize=1)
def prototypes() -> dict[int, str]:
    """The look-alike table, derived from the Unicode character database.

    - wide and narrow forms: their plain form
    - joined letters (a compatibility form of two or more letters) and joined dots: the parts
    - spaces (Zs): U+0020
    - characters that take no room (format characters, variation selectors, the combining joiner): nothing
    - letters of another alphabet with the shape of a Latin letter: the Latin letter
    """
    out: dict[int, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            out[code] = " "
        elif kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            out[code] = ""
        elif decomposed := unicodedata.decomposition(ch):
            tag, *parts = decomposed.split()
            whole = "".join(chr(int(p, 16)) for p in parts) if tag in ("<wide>", "<narrow>", "<compat>") else ""
            if tag in ("<wide>", "<narrow>") or tag == "<compat>" and (ch in DOTS or len(whole) > 1 and whole.isalpha()):
                out[code] = unicodedata.normalize("NFD", whole)
    out |= {ord(a): b for a, b in zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS, strict=True)}
    return out


def skeleton(text: str | None) -> str | None:
    """The consistent form of a text; null stays null, ASCII stays as it is."""
    if text is None or text.isascii():
        return text
    # A replaced wide form can hold another character of the table, so the replacement is done to a fixed point.
    table, before = prototypes(), None
    form = unicodedata.normalize("NFD", text)
    while form != before:
        before = form
        form = unicodedata.normalize("NFD", form.translate(table))
    return unicodedata.normalize("NFC", form)


@F.arrow_udf(StringType())
def consistent_form(text: pa.Array) -> pa.Array:
    """Column function: the consistent form of each text. Vectorised over Arrow batches."""
    return pa.array([skeleton(x) for x in text.to_pylist()], pa.string())


def same_look(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per record whose form is shared by different texts: key, text, form.

    Null, empty and blank texts take no part; rows repeated with the same key and text count once. Two passes over the
    table instead of a gathered group: the first sends, per form, only the least and greatest hash of its texts
    (combined before the shuffle, so a form that holds a third of all rows costs one row per task); the second keeps
    the rows of the forms where these differ. Extra columns of the input are dropped.
    """
    rows = (
        df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
        .where(F.col("_text").rlike(r"\S") & F.col("_key").isNotNull())
        .withColumn("_form", consistent_form("_text"))
        .where(F.col("_form").rlike(r"\S"))
        .withColumn("_fh", F.xxhash64("_form"))
    )
    mark = F.struct(F.xxhash64("_text"), F.hash("_text"))
    mixed = rows.groupBy("_fh").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("_fh")
    return rows.join(mixed, "_fh", "left_semi").select("_key", "_text", "_form").distinct()


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of records whose texts look the same but are not the same characters: (id_a, id_b), id_a < id_b.

    Records with equal texts make no pair with each other; each meets the records of every other text of its class.
    """
    rows = same_look(df, key, text)
    a = rows.select(F.col("_form").alias("fa"), F.col("_key").alias("id_a"), F.col("_text").alias("ta"))
    b = rows.select(F.col("_form").alias("fb"), F.col("_key").alias("id_b"), F.col("_text").alias("tb"))
    met = a.join(b, (F.col("fa") == F.col("fb")) & (F.col("ta") != F.col("tb")) & (F.col("id_a") < F.col("id_b")))
    return met.select("id_a", "id_b").distinct()


def form_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per form that different texts share: form, class_id (its least key), n_texts, n_records."""
    return (
        same_look(df, key, text)
        .groupBy(F.col("_form").alias("form"))
        .agg(F.min("_key").alias("class_id"), F.count_distinct("_text").alias("n_texts"), F.count_distinct("_key").alias("n_records"))
    )
