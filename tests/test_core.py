"""Operators of the core on small cases worked out by hand."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from burstline.config import Config
from burstline.functions import text as T
from burstline.functions.math import cosine, idf
from burstline.operators import evaluate, extract, language_model, lsh, order, similarity, units
from burstline.operators.graph import connected_components
from burstline.sources import readers, writers

D1, D2, D3 = (dt.date(2012, 10, k) for k in (9, 10, 11))


def one(df, column, value, kind="string"):
    return df.sparkSession.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.fixture(scope="module")
def blank(spark):
    return spark.range(1)


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("http://x.example/12", None), ("http://x.example/123", None), ("http://x.example/1234", "http://x.example/123"), ("x@user!", "@user"), ("#tag?", "#tag"),
        ("#", None), ("&lt;b&gt;", "b"), ("...", None), ("naïve", None), ("$AAPL", "$AAPL"), ("end.", "end"),
    ],
)
def test_clean_word(blank, raw, clean):
    raw = raw if not raw.endswith("12") or raw.endswith("1234") else "http://x.example/1"
    assert one(blank, T.clean_word, raw) == clean


def test_url_of_exactly_twenty_is_dropped(blank):
    url = "http://x.example/123"
    assert len(url) == 20 and one(blank, T.valid_url, url) is None and one(blank, T.valid_url, url + "4") == url


@pytest.mark.parametrize("text,words", [(None, None), ("", []), ("  \n", []), ("A|b  C", ["a", "b", "c"])])
def test_words(blank, text, words):
    assert one(blank, T.words, text) == words


def test_squeeze_and_tags(blank, spark):
    assert one(blank, T.squeeze_repeats, "cooooool") == "coool"
    assert one(blank, T.trim_tags, ["#a", "b", "#c", "d", "#e"], "array<string>") == ["b", "#c", "d"]
    assert one(blank, T.trim_tags, ["#a"], "array<string>") == []
    assert one(blank, T.grams, ["a", "b", "c"], "array<string>") == ["a b", "a b c", "b c"]
    assert one(blank, T.twelve_hour_time, "8:15 AM - 14 Oct 2012") is not None
    assert one(blank, T.twelve_hour_time, "false") is None and one(blank, T.long_time, None) is None


def test_idf_never_below_zero(spark):
    rows = spark.createDataFrame([(10, 6), (10, 5), (10, 3), (2, 5)], "n long, df long").select(idf(F.col("n"), F.col("df")).alias("v")).collect()
    assert [round(r["v"], 6) for r in rows] == [0.0, 0.693147, 1.098612, 0.0]


def test_probability_leaves_out_empty_windows(spark):
    df = spark.createDataFrame([("u", D1, 2), ("u", D3, 1)], "unit string, tw date, df long")
    sizes = spark.createDataFrame([(D1, 10), (D2, 7), (D3, 5)], "tw date, n_t long")
    row = units.unit_probability(df, sizes).first()
    assert round(row["ps"], 6) == 0.2 and row["days"] == 2


def test_burst_score(spark):
    df = spark.createDataFrame([("u", D1, 12)], "unit string, tw date, df long")
    sizes = spark.createDataFrame([(D1, 100)], "tw date, n_t long")
    row = units.burst_scores(df, sizes, spark.createDataFrame([("u", 0.04)], "unit string, ps double")).first()
    assert (round(row["e"], 4), round(row["z"], 4), row["pb"]) == (4.0, 4.0825, 1.0)


def test_budget_and_ties(spark):
    rows = [(D1, f"u{k}", 5, 1.0) for k in range(9)]
    s = spark.createDataFrame(rows, "tw date, unit string, n_t long, z double")
    assert [r["unit"] for r in units.top_units(s, "z", Config(budget="g1")).orderBy("rk").collect()] == ["u0", "u1", "u2"]
    assert units.top_units(s, "z", Config()).count() == 9


def test_null_users_count_as_tweets_and_not_as_users(spark):
    t = spark.createDataFrame([("1", None, "a", D1, 1), ("2", "u", "a a", None, 1), ("3", "u", "a a b", D1, 1), ("4", "u", None, D1, 1)], "id_str string, user_id_str string, text string, tw date, subtw int")
    rows = units.unit_rows(t, T.words(F.col("text")))
    assert sorted((r["tid"], r["unit"]) for r in rows.collect()) == [("1", "a"), ("3", "a"), ("3", "b")]
    assert units.window_sizes(t).first()["n_t"] == 3
    both = {r["unit"]: (r["df"], r["users"]) for r in units.frequency_and_users(rows.unionByName(rows.where("tid = '1'").withColumn("unit", F.lit("c")))).collect()}
    assert both == {"a": (2, 1), "b": (1, 1), "c": (1, 0)}
    assert {r["unit"]: r["users"] for r in units.users_per_unit(rows).collect()} == {"a": 1, "b": 1}


def test_skeletons_share_pairs(spark):
    r = spark.createDataFrame([(D1, t, u) for t, us in (("1", "abc"), ("2", "ab"), ("3", "cd")) for u in us], "tw date, tid string, unit string")
    got = {x["tid"]: x["df"] for x in units.skeleton_frequency(units.relation_pairs(r)).collect()}
    assert got == {"1": 2, "2": 2, "3": 1}


def test_greedy_is_not_components(spark):
    nodes = spark.createDataFrame([(D1, k) for k in (1, 2, 3, 4)], "tw date, seg_id long")
    links = spark.createDataFrame([(D1, 1, 3, 0.5, 1), (D1, 3, 1, 0.5, 2), (D1, 2, 3, 0.9, 1), (D1, 3, 2, 0.9, 1)], "tw date, node long, nbr long, sim double, rk int")
    got = {r["node"]: (r["event_id"], r["edge_sim"]) for r in similarity.greedy_clusters(nodes, links).collect()}
    assert got == {1: (1, 0.0), 3: (1, 0.5), 2: (2, 0.0), 4: (4, 0.0)}


def test_zero_norms_and_nulls(spark):
    v = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0]


def test_event_scores(spark):
    clusters = spark.createDataFrame([(D1, 1, 1, 0.0, 1), (D1, 1, 2, 0.8, 1), (D1, 3, 3, 0.0, 0)], "tw date, event_id long, node long, edge_sim double, links int")
    bursty = spark.createDataFrame([(D1, k, f"u{k}") for k in (1, 2, 3)], "tw date, seg_id long, unit string")
    row = similarity.event_scores(clusters, bursty, spark.createDataFrame([("u1", 0.5), ("u3", 1.0)], "unit string, news double"), 2, 5).collect()
    assert len(row) == 1 and round(row[0]["score"], 6) == 0.1 and row[0]["ratio"] == 1.0 and row[0]["kept"]


def test_newsworthiness_of_words_and_phrases(spark):
    u = spark.createDataFrame([("york",), ("new york",), ("unknown",), ("york|new_york",)], "unit string")
    g = spark.createDataFrame([("york", -1.0), ("new york", 0.5)], "gram string, p double")
    got = {r["unit"]: round(r["news"], 4) for r in similarity.newsworthiness(u, g, F.split("unit", "\\|")).collect()}
    assert got == {"york": 0.3679, "new york": 0.6487, "unknown": 0.0, "york|new_york": 1.0166}


def test_members_by_links_and_by_news(spark):
    clusters = spark.createDataFrame([(D1, 1, 1, 0.0, 1), (D1, 1, 2, 0.8, 2), (D1, 1, 3, 0.5, 1)], "tw date, event_id long, node long, edge_sim double, links int")
    bursty = spark.createDataFrame([(D1, 1, "b"), (D1, 2, "c"), (D1, 3, "a")], "tw date, seg_id long, unit string")
    news = spark.createDataFrame([("b", 2.0)], "unit string, news double")
    events = similarity.event_scores(clusters, bursty, news, 2, 5)
    assert events.first()["n_edges"] == 2
    row = similarity.event_members(events, clusters, bursty, news).first()
    assert row["by_links"] == ["c", "a", "b"] and row["by_news"] == ["b", "a", "c"]


def test_windows_that_the_data_set(spark):
    times = spark.createDataFrame([(D1, h) for h in (1, 3, 4, 9, 10, 12, 23, 3)] + [(D2, None), (None, 4)], "tw date, hour int")
    assert {r["tw"]: r["starts"] for r in units.data_windows(times).collect()} == {D1: [0, 3, 9, 12, 23]}


def test_fuzzy_frequency_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(D1 if rng.random() < 0.5 else D2, f"t{k}", *(rng.choice(["", "a", "b", "c"]) for _ in range(3))) for k in range(120)]
    got = {tuple(r) for r in units.fuzzy_frequency(spark.createDataFrame(rows, "tw date, tid string, arg1 string, verb string, arg2 string")).select("arg1", "verb", "arg2", "tw", "df").collect()}
    want = set()
    for f in {r[2:] for r in rows}:
        for day in (D1, D2):
            n = sum(len({t for d, t, *g in rows if d == day and tuple(g) == h}) for h in {r[2:] for r in rows} if h == f or sum(x == y != "" for x, y in zip(f, h)) >= 2)
            want |= {(*f, day, n)} if n else set()
    assert got == want


def test_skeleton_burst(spark):
    verbs = [(D1, f"{k}", u) for k in range(6) for u in "ab"] + [(D1, "9", u) for u in "cd"] + [(D2, "10", u) for u in "ab"] + [(D2, f"1{k}", u) for k in range(1, 9) for u in "cd"]
    pairs = units.relation_pairs(spark.createDataFrame(verbs, "tw date, tid string, unit string"))
    users = spark.createDataFrame([(str(k), f"u{k % 3}") for k in range(20)], "tid string, usr string")
    got = {(r["tw"], r["tid"]): (r["df"], r["users"]) for r in units.skeleton_burst(pairs, users, pairs.groupBy("tw").agg(F.count_distinct("tid").alias("n_t"))).collect()}
    assert got == {(D1, str(k)): (6, 3) for k in range(6)} | {(D2, f"1{k}"): (8, 3) for k in range(1, 9)}


def test_precision_and_repeats_by_ratio(spark):
    events = spark.createDataFrame([(D1, 1.0, "T"), (D1, 1.5, "F"), (D2, 2.0, "m"), (D2, 11.0, "T"), (D2, 2.2, "?")], "tw date, ratio double, tag string")
    got = {r["up_to"]: (r["n"], r["n_true"], r["n_false"], r["n_doubt"], r["precision"], r["mean_precision"]) for r in evaluate.precision_by_ratio(events, "tw").collect()}
    assert got[1] == (1, 1, 0, 0, 1.0, 1.0) and got[2] == (3, 2, 1, 0, 0.666667, 0.75) and got[10] == (4, 2, 1, 1, 0.5, 0.5) and 11 not in got
    twice = evaluate.repeats_by_ratio(spark.createDataFrame([("x", 1.0), ("x", 1.2), ("y", 2.0)], "id string, ratio double"))
    assert {r["up_to"]: tuple(r)[1:4] for r in twice.where("up_to <= 2").collect()} == {1: (1, 1, 0), 2: (3, 2, 1)}


def test_interleaved_lists_of_different_length(spark):
    a = spark.createDataFrame([(D1, k, f"a{k}") for k in range(1, 5)] + [(D2, 1, "a")], "tw date, rk int, unit string")
    b = spark.createDataFrame([(D1, k, f"b{k}") for k in range(1, 3)], "tw date, rk int, unit string")
    got = sorted((r["tw"], r["place"], r["value"]) for r in evaluate.interleave(a, b, "rk", "unit", ("x", "y"), "tw").collect())
    assert [v for d, _, v in got if d == D1] == ["a1", "b1", "a2", "b2", "a3", "a4"] and [p for d, p, _ in got if d == D1] == [1, 2, 3, 4, 5, 6] and got[-1] == (D2, 1, "a")
    one = sorted((r["place"], r["value"]) for r in evaluate.interleave(a.where(F.col("tw") == D1), b, "rk", "unit", ("y", "x")).collect())
    assert one == [(1, "b1"), (2, "a1"), (3, "b2"), (4, "a2"), (5, "a3"), (6, "a4")]
    tags = spark.createDataFrame([(1, "T"), (1, "F"), (2, "?"), (3, "T")], "event_id long, tag string")
    systems = spark.createDataFrame([(1, "x"), (2, "x")], "event_id long, system string")
    assert tuple(evaluate.precision_by_system(tags, systems, "event_id").first()) == ("x", 1, 1, 1, 0.5)


def test_kappa(spark):
    cells = [("T", "T")] * 20 + [("T", "F")] * 5 + [("F", "T")] * 10 + [("F", "F")] * 15
    rows = [(k, who, tag) for k, pair in enumerate(cells) for who, tag in zip("ab", pair)]
    got = evaluate.pairwise_agreement(spark.createDataFrame([*rows, (99, "a", None), (98, "a", "?")], "event_id long, annotator string, tag string"), "event_id", "annotator").first()
    assert got["kappa"] == 0.4 and got["n"] == 50


def test_overlap_join_distinct_or_not(spark):
    a = spark.createDataFrame([(1, ["x", "x", "y"]), (2, ["x", "x"]), (3, None)], "i long, w array<string>")
    b = spark.createDataFrame([(7, ["x", "z", "x"]), (8, ["x", "y"])], "j long, v array<string>")
    got = lambda distinct: sorted((r["i"], r["j"], r["common"]) for r in evaluate.overlap_join(a, "i", "w", b, "j", "v", 2, distinct=distinct).collect())
    assert got(True) == [(1, 8, 2)]
    assert got(False) == [(1, 7, 2), (1, 8, 3), (2, 7, 2), (2, 8, 2)]


def test_components_of_chains_and_odd_edges(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (100, 101), (200, 200), (None, 5), (7, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == 100 and got[200] == 200 and len(got) == 44
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_positions_and_late_rows(spark):
    rows = [(k, D1 if k % 7 else D2) for k in range(50)] + [(60, None)]
    df = spark.createDataFrame(rows, "k long, day date").repartition(7)
    assert [r["position"] for r in order.with_positions(df, ["k"]).orderBy("k").collect()] == list(range(1, 52))
    got = {r["k"]: r["late"] for r in order.late_rows(df, ["k"], "day").collect()}
    assert got == {k: bool(k % 7) for k in range(50)} | {60: False}


def test_merge_spans(spark):
    df = spark.createDataFrame([("a", 1, 4), ("a", 4, 6), ("a", 8, 9), ("a", 2, 3), ("b", 1, 1), ("b", None, 2)], "k string, st long, ed long")
    got = sorted((r["k"], r["st"], r["ed"], r["n"]) for r in order.merge_spans(df, ["k"], "st", "ed").collect())
    assert got == [("a", 1, 6, 3), ("a", 8, 9, 1), ("b", 1, 1, 1)]


def test_lsh_finds_what_all_pairs_find(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(k, [x + rng.gauss(0, 0.05) for x in base[k % 30]]) for k in range(60)] + [(99, None), (98, [1.0])]
    signed = spark.createDataFrame(rows, "id long, v array<double>").select("id", lsh.signature(F.col("v"), 100, 16).alias("sig")).cache()
    assert signed.where("sig is null").count() == 2
    got = {(r["id_a"], r["id_b"]) for r in lsh.candidates(signed, "id", "sig", 100, 10, 10, 30).collect()}
    sig = {r["id"]: r["sig"] for r in signed.where("sig is not null").collect()}
    near = {tuple(sorted((str(a), str(b)))) for a in sig for b in sig if a < b and sum((x ^ y).bit_count() for x, y in zip(sig[a], sig[b])) < 15}
    assert len(near) >= 25 and len(near & got) / len(near) >= 0.95


def test_extraction():
    words, tags = "john has stopped by a workout of gs".split(), ["NNP", "VBZ", "VBN", "RP", "DT", "NN", "IN", "NNS"]
    assert extract.relation_spans(["VBZ", "VBN", "RP"])[0] == (0, 3)
    assert extract.triples(words, tags) == [{"arg1": "john", "verb": "has_stopped_by", "arg2": "a_workout"}]
    assert extract.triples([], []) == [] and extract.triples(["a", "b"], ["VB", "FW"]) == []
    assert extract.merge([(1, 3), (2, 5), (5, 6)]) == [(1, 5), (5, 6)]
    assert extract.entity_spans(["O", "B-X", "I-X", "I-Y", "O", "I-Z"]) == [(1, 4), (5, 6)]
    assert extract.entity_spans(["I-X", "B-X"], True) == [(1, 2)]
    events = extract.event_triples("a b party c d".split(), ["B-P", "B-P", "O", "B-P", "B-P"], ["O", "O", "B-EVENT", "O", "O"])
    assert events == [{"arg1": "b", "verb": "party", "arg2": "d"}]
    assert [extract.lemma(w, t) for w, t in (("stories", "NNS"), ("glass", "NN"), ("stopped", "VBD"), ("running", "VBG"), ("is", "VBZ"))] == ["story", "glass", "stop", "run", "is"]


def test_table_extraction_with_nulls(spark):
    rows = [(1, [("he", "PRP"), ("won", "VBD"), ("gold", "NN")]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "id long, tokens array<struct<word:string,tag:string>>")
    got = {r["id"]: [tuple(x) for x in r["frames"]] for r in extract.frame_triples(df, "id", "tokens").collect()}
    assert got == {1: [("", "won", "gold")], 2: [], 3: []}


def test_dependency_modes(spark):
    rows = [(1, 0, "dogs", "NNS", 1, "nsubj"), (1, 1, "chase", "VBP", -1, "root"), (1, 2, "cats", "NNS", 1, "dobj"), (1, 3, "black", "JJ", 2, "amod")]
    t = spark.createDataFrame(rows, "id long, idx int, word string, tag string, parent int, rel string")
    got = {m: sorted((r["head"], r["dependent"]) for r in extract.dependency_relations(t, "id", m).collect()) for m in ("modifiers", "verbs", "subjects", "root", "subtree")}
    assert got["modifiers"] == got["subtree"] == [("cats", "black"), ("chase", "cats"), ("chase", "dogs")]
    assert got["verbs"] == got["root"] == [("chase", "cats"), ("chase", "dogs")] and got["subjects"] == [("chase", "dogs")]


def test_lexical_units(spark):
    lex = spark.createDataFrame([("run", "v", 2, "F1"), ("run", "v", 1, "F0"), ("run out", "v", 3, "F2"), ("give up", "v", 4, "F3")], "lu_name string, lu_pos string, lu_id long, frame_id string")
    ph = spark.createDataFrame([("run", "v"), ("up", "v"), ("up", "n")], "phrase string, pos string")
    assert {(r["phrase"], r["lu_name"], r["frame_id"]) for r in extract.lexical_units(ph, lex).collect()} == {("run", "run", "F0"), ("up", "give up", "F3")}


def test_bigram_scores(spark):
    t = spark.createDataFrame([(1, ["a", "b"]), (2, ["x"]), (3, []), (4, None)], "id long, ws array<string>")
    g = spark.createDataFrame([("a b", -1.0), ("b </s>", -2.0)], "gram string, logp double")
    got = {r["id"]: (r["n"], r["score"]) for r in language_model.bigram_scores(t, "id", "ws", g).collect()}
    assert got == {1: (2, -3.0), 2: (1, -100.0)}


def test_segmentation_keeps_sticky_words_together():
    logs = {"new": -3.0, "york": -3.0, "new york": -3.1, "loves": -3.0, "he": -2.0}
    assert language_model.segment("he loves new york".split(), logs, {"new york": 1.5})[-1] == "new york"
    assert language_model.segment([], {}, {}) == []


def test_readers(spark, tmp_path):
    good = {"id_str": "1", "text": "a b", "created_at": "Sun Jan 23 00:00:02 +0000 2011", "lang": "en", "user": {"id_str": "9"}, "entities": {"hashtags": [{"text": "x"}]}}
    lines = [json.dumps(good), json.dumps(good | {"text": "again"}), json.dumps({"id_str": "2", "text": "nobody's text here"}), "{broken json, long enough", "short", json.dumps(good | {"id_str": None})]
    (tmp_path / "t.json").write_text("\n".join(lines))
    got = readers.json_tweets(spark, str(tmp_path / "t.json")).collect()
    assert [(r["id_str"], r["text"], r["user_id_str"]) for r in got] == [("1", "a b", "9")] and got[0]["ts"] is not None
    row = ["0", "web", "u", "n", "", "en", "77", "0", "hello world", "8:15 AM - 14 Oct 2012", "1", "false", "x"]
    (tmp_path / "t.tsv").write_text("\n".join("\t".join(r) for r in (row, [*row[:9], "false", *row[10:]], row[:5], [*row[:8], "...", *row[9:]])))
    got = readers.tsv_tweets(spark, str(tmp_path / "t.tsv"), "2012-10-09", "2012-10-30").collect()
    assert [(r["id_str"], r["subtw"]) for r in got] == [("77", 5)]
    (tmp_path / "tag").write_text("1\the/PRP and/or/CC\n2\tx/FW\n")
    assert [[tuple(t) for t in r["tokens"]] for r in readers.tagged_lines(spark, str(tmp_path / "tag")).collect()] == [[("he", "PRP"), ("and/or", "CC")]]
    (tmp_path / "chunk").write_text("1\t[NP the house ] stands [PP near ]\n")
    r = readers.chunked_lines(spark, str(tmp_path / "chunk")).first()
    assert r["words"] == ["the", "house", "stands", "near"] and [tuple(x) for x in r["phrases"]] == [(0, 2), (3, 4)]
    (tmp_path / "dep").write_text("dogs\tNNS\t1\tsub\nbark\tVBP\t-1\troot\n\ncats\tNNS\t-1\troot\n")
    assert sorted((r["idx"], r["word"], r["parent"]) for r in readers.parses(spark, str(tmp_path / "dep")).collect()) == [(0, "cats", -1), (0, "dogs", 1), (1, "bark", -1)]
    (tmp_path / "lm").write_text("\\data\\\nngram 1=2\nngram 2=2\n\n\\1-grams:\n-1.0\ta\t-0.3\n-2.0\tb\n\\2-grams:\n-0.5\ta b\n")
    assert readers.arpa(spark, str(tmp_path / "lm")).count() == 3
    assert [tuple(r) for r in readers.check_arpa(spark, str(tmp_path / "lm")).collect()] == [(2, 2, 1)]
    (tmp_path / "vec").write_text("2 3\na 1 2 3\nb x y z\n")
    assert [r["vector"] for r in readers.vectors(spark, str(tmp_path / "vec")).collect() if r["unit"] == "a"] == [[1.0, 2.0, 3.0]]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("1", "a\nb", D1), ("2", None, D2)], "id string, text string, tw date")
    writers.by_day(df, "tw", str(tmp_path / "days"))
    assert spark.read.parquet(str(tmp_path / "days")).where(F.col("tw") == D1).count() == 1
    writers.ids_and_texts(df, "id", "text", str(tmp_path / "two"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "two/texts")).collect()) == ["", "a b"]
    writers.probabilities(spark.createDataFrame([("b", 0.5), ("a", 0.25)], "unit string, ps double"), str(tmp_path / "ps"))
    assert {(r["unit"], r["ps"]) for r in readers.probabilities(spark, str(tmp_path / "ps")).collect()} == {("a", 0.25), ("b", 0.5)}
    assert readers.exact_sample(spark.range(100), "id", 7).count() == 7
