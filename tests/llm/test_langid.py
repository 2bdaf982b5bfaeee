import random

import pytest
from pyspark.sql import functions as F

from burstline.llm import langid as G

WORDS = {
    "en": "the and with from that this while because every other people would there about before over near again still never".split(),
    "es": "los las una que por para como pero cuando desde hasta sobre también porque mucho tiempo siempre nunca mejor noche".split(),
    "de": "der die das und nicht mit auch sehr aber wenn schon über alles heute nach noch bei weil wird zum".split(),
    "ru": "это что как они для очень когда после уже если сегодня нет там тоже есть дом время весна люди город".split(),
}


def text(lang, n, rng):
    return " ".join(rng.choices(WORDS[lang], k=n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(lang, text(lang, 12, rng)) for lang in WORDS for _ in range(150)]
    wrong = [("es" if lang == "en" else "en", t) for lang, t in rows[::12]]
    return G.train(rows + wrong, G.Params(languages=tuple(WORDS)))


def test_held_out_accuracy(model):
    rng = random.Random(2)
    truth = [lang for lang in WORDS for _ in range(100)]
    told = model.classify([model.words(text(lang, rng.randint(6, 14), rng)) for lang in truth])
    right = sum(len(t) == 1 and t[0][2] == lang for t, lang in zip(told, truth))
    assert right / len(truth) >= 0.97


def test_mixed_texts_and_their_border(model):
    rng = random.Random(3)
    ok = 0
    for _ in range(100):
        a, b = rng.sample(list(WORDS), 2)
        n, m = rng.randint(7, 12), rng.randint(7, 12)
        (told,) = model.classify([model.words(f"{text(a, n, rng)} {text(b, m, rng)}")])
        ok += [x[2] for x in told] == [a, b] and abs(told[0][1] - n) <= 1
    assert ok >= 90


def test_texts_that_change_more_than_once(model):
    """Equal ends with another language between them, and three languages: each stretch comes out."""
    rng = random.Random(5)
    ok = 0
    for k in range(60):
        a, b, c = rng.sample(list(WORDS), 3)
        langs = [a, b, a] if k % 2 else [a, b, c]
        (told,) = model.classify([model.words(" ".join(text(x, 12, rng) for x in langs))])
        ok += [x[2] for x in told] == langs and told[0][0] == 0 and told[-1][1] == 36 and all(x[1] == y[0] for x, y in zip(told, told[1:]))
    assert ok >= 54
    (told,) = model.classify([model.words(" ".join(text(x, 300, rng) for x in ("en", "de", "en", "ru", "es")))])
    assert [x[2] for x in told] == ["en", "de", "en", "ru", "es"]
    alone = [model.words(text(lang, rng.randint(16, 60), rng)) for lang in WORDS for _ in range(25)]
    assert sum(len(t) > 1 for t in model.classify(alone)) <= 2


def test_narrow_margins_are_rejected(model):
    sizes = G._margin((30, 31, 40, 41))
    assert sizes == 1 and model.params.reject >= sizes
    assert model.classify([["qqq", "xxx", "zzz", "www"]])[0][0][2] is None


def test_what_belongs_to_no_language(model):
    assert model.words("@who #tag http://x.example/a1 1234 12:30 Zorbaldt") == []
    assert model.classify([[], ["the", "and"]]) == [[], []]


@pytest.mark.parametrize("label,lang", [("en", "en"), ("EN", "en"), ("en_US", "en"), (" pt-BR", "pt"), ("eng", "en"), ("in", "id"), ("deu", "de"), (None, None), ("", None), ("und", None), ("N/A", None), ("xx", None)])
def test_labels(spark, label, lang):
    assert spark.createDataFrame([(label,)], "l string").select(G.language_of_label(F.col("l"))).first()[0] == lang


def test_table(spark, model):
    rng = random.Random(4)
    rows = [("1", text("en", 9, rng)), ("2", f"{text('en', 9, rng)} {text('ru', 9, rng)}"), ("3", None), ("4", ""), ("5", "the"), ("6", text("de", 20_000, rng)), ("1", None)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "id string, text string, lang string")
    got = sorted((r["id"], r["from_word"], r["lang"]) for r in G.segments(df, "id", "text", model).collect())
    assert [(k, lang) for k, _, lang in got] == [("1", "en"), ("2", "en"), ("2", "ru"), ("6", "de")]
    assert G.segments(df.limit(0), "id", "text", model).count() == 0


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(str(k), "a text long enough", "en" if k % 10 else "de") for k in range(3000)], "id string, text string, lang string")
    got = G.labelled_sample(df, "id", "text", "lang", G.Params(sample=200))
    assert sum(lang == "en" for lang, _ in got) < 300 and sum(lang == "de" for lang, _ in got) > 100
