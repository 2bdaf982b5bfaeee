import random

from burstline.llm import subjects as S

TOPICS = {"law": "court judge verdict appeal statute witness counsel clause".split(), "sport": "goal league striker derby medal rugby penalty podium".split(), "travel": "hotel ticket luggage ferry runway passport hostel tram".split()}
FILL = "street window paper coffee garden lamp table letter bottle chair river bridge".split()


def document(rng, about, passing=None):
    lines = []
    for s in about:
        lines += [" ".join([*rng.choices(FILL, k=3), *rng.sample(TOPICS[s], 2)]) for _ in range(4)]
    lines += [" ".join(rng.choices(FILL, k=5)) for _ in range(3)]
    if passing:
        lines.append(" ".join([*rng.choices(FILL, k=3), rng.choice(TOPICS[passing])]))
    rng.shuffle(lines)
    return ". ".join(lines)


def test_subjects_of_held_out_documents(spark):
    rng = random.Random(1)
    docs, truth, labels = [], set(), []
    for k in range(400):
        about = rng.sample(list(TOPICS), rng.choice([0, 1, 1, 2]))
        other = [s for s in TOPICS if s not in about]
        docs.append((k, document(rng, about, rng.choice([None, *other])), "clash"))
        truth |= {(k, s) for s in about}
        if k < 120:
            labels += [(k, "a", s, "T" if (s in about) ^ (rng.random() < 0.04) else "F") for s in TOPICS] + [(k, "b", "law", "?")]
    docs += [(900, None, ""), (901, "", ""), (902, "  ", ""), (903, "unknown words only", ""), (None, "court judge. court verdict", "")]
    labels += [(901, "a", "law", "T"), (None, "a", "law", "T"), (5, "a", None, "T"), (6, "a", "nothing", "T")]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, annotator string, subject string, tag string")
    p = S.Params(max_share=0.3, min_documents=3)
    got = {(r["doc_id"], r["subject"]): r["n_sentences"] for r in S.subjects_of(d, "doc_id", "text", lab, list(TOPICS), p).collect()}
    held = {x for x in truth if x[0] >= 120}
    found = {x for x in got if x[0] >= 120}
    assert len(found & held) / len(held) >= 0.95 and len(found & held) / len(found) >= 0.95
    assert not {k for k, _ in got} & {None, 900, 901, 902, 903} and min(n for (k, _), n in got.items() if k >= 120) >= p.several
    seen = {(k, s) for k, _, s, tag in labels if tag == "T"}
    assert all(x in seen for x, n in got.items() if n < p.several)  # a clamped subject needs one sentence only


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "court judge")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, annotator string, subject string, tag string")
    assert S.subjects_of(d, "doc_id", "text", none, ["law"]).count() == 0
    assert S.subjects_of(d.limit(0), "doc_id", "text", none, ["law"]).count() == 0


def test_sentences():
    assert S.sentences("One fine day! Of it\r\nmot-de-passe... ") == [["one", "fine", "day"], ["mot-de-passe"]]
    assert S.sentences(None) == S.sentences("  ") == []
