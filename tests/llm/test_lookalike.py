import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from burstline.llm import lookalike as L


@pytest.mark.parametrize(
    "a,b",
    [
        ("ｆｕｌｌ　ｗｉｄｔｈ１", "full width1"), ("café", "café"), ("ﬁne oﬃce", "fine office"), ("a…b", "a...b"), ("ze​ro⁠﻿­", "zero"), ("a b c d", "a b c d"),
        ("сору", "copy"), ("ΝΟΤΕ", "NOTE"), ("ё", "ё"), ("e​́", "é"), ("👨‍👩", "👨👩"),
    ],
)
def test_same_look(a, b):
    assert L.skeleton(a) == L.skeleton(b)


@pytest.mark.parametrize("a,b", [("Abc", "abc"), ("cafe", "café"), ("a b", "a  b"), ("a-b", "a—b"), ("l0", "lO"), ("I", "l"), ("x²", "x2"), ("a\tb", "a b")])
def test_other_look(a, b):
    assert L.skeleton(a) != L.skeleton(b)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_form_is_a_fixed_point(text):
    form = L.skeleton(text)
    assert L.skeleton(form) == form == unicodedata.normalize("NFC", form)


def brute(rows):
    texts = {k: t for k, t in rows if k is not None and t is not None and t.strip()}
    return {(a, b) for a in texts for b in texts if a < b and texts[a] != texts[b] and L.skeleton(texts[a]) == L.skeleton(texts[b])}


def test_pairs_against_brute_force(spark):
    words = ["copy", "сopy", "ｃｏｐｙ", "Copy", "copy", None, "", "  ", "​", "café", "café", "cafe", "x" * 50_000, "x" * 49_999 + "х"]
    rows = [(f"{k:03}", w) for k, w in enumerate(words * 3)] + [("000", "copy"), (None, "сopy")]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "id string, text string, _form string, form int")
    got = [(r["id_a"], r["id_b"]) for r in L.look_alike_pairs(df, "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    classes = {r["form"]: (r["class_id"], r["n_texts"]) for r in L.form_classes(df, "id", "text").collect()}
    assert classes["copy"] == ("000", 3) and classes["café"] == ("009", 2)


def test_empty_table(spark):
    assert L.look_alike_pairs(spark.createDataFrame([], "id string, text string"), "id", "text").count() == 0
