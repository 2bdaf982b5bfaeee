"""Sinks read back, frame vectors, slot matches, and the streaming forms on files that arrive one by one."""

import datetime as dt

from pyspark.sql import functions as F

from burstline.functions import text as T
from burstline.operators import extract as X
from burstline.operators import language_model as L
from burstline.operators import lsh
from burstline.sources import readers, writers
from burstline.streaming import flows

D1, D2 = dt.date(2012, 10, 9), dt.date(2012, 10, 10)


def test_event_sinks(spark, tmp_path):
    events = spark.createDataFrame([(D1, 1, 2, True), (D1, 5, 1, False), (D2, 7, 1, None)], "tw date, event_id long, rk int, ok boolean")
    members = spark.createDataFrame([(D1, 1, ["b", "a"])], "tw date, event_id long, members array<string>")
    writers.ranked_events(events, members, str(tmp_path / "ranked"))
    got = sorted((r["event_id"], r["members"]) for r in spark.read.json(str(tmp_path / "ranked")).collect())
    assert got == [(1, ["b", "a"]), (5, None), (7, None)]
    writers.judged_events(events, "ok", str(tmp_path / "judged"))
    assert [spark.read.parquet(str(tmp_path / "judged" / x)).first()["event_id"] for x in ("true", "false")] == [1, 5]
    sheet = spark.createDataFrame([(2, "b", 1, "y"), (1, "a", 1, "x")], "place int, system string, rank int, value string")
    writers.annotation_sheet(sheet, str(tmp_path / "sheet"))
    assert [r["value"] for r in spark.read.option("header", True).csv(str(tmp_path / "sheet")).collect()] == ["x", "y"]
    df = spark.createDataFrame([("u", D1, 3)], "unit string, tw date, df long")
    writers.frequencies(df, spark.createDataFrame([(D1, 9)], "tw date, n_t long"), str(tmp_path / "freq"))
    assert spark.read.parquet(str(tmp_path / "freq/frequencies")).first()["df"] == 3 and spark.read.parquet(str(tmp_path / "freq/windows")).first()["n_t"] == 9


def test_line_readers(spark, tmp_path):
    (tmp_path / "units").write_text("1\tA B|c d\n2\t0.5\tX\nbad\n")
    assert {r["id"]: r["units"] for r in readers.unit_lines(spark, str(tmp_path / "units"), segments=True).collect()} == {"1": ["a_b", "c_d"], "2": ["x"]}
    (tmp_path / "four").write_text("1\tparty/O/NN/B-EVENT and/or/O/CC/O\n")
    assert [tuple(t) for t in readers.four_way_lines(spark, str(tmp_path / "four")).first()["tokens"]] == [("party", "O", "NN", "B-EVENT"), ("and/or", "O", "CC", "O")]
    (tmp_path / "grams").write_text("-1.5 new york\nx y\n")
    assert [(r["gram"], r["logp"]) for r in readers.scored_grams(spark, str(tmp_path / "grams")).collect()] == [("new york", -1.5)]
    (tmp_path / "slang").write_text("brb  -   be right back\nnone\n")
    assert [tuple(r) for r in readers.pair_list(spark, str(tmp_path / "slang")).collect()] == [("brb", "be right back")]
    (tmp_path / "labels").write_text("e1###T###1.5###x\nplain\n")
    assert [(r["tag"], r["ratio"]) for r in readers.label_lines(spark, str(tmp_path / "labels")).collect()] == [("T", 1.5)]
    (tmp_path / "rel").write_text("1\ta\tb\tc\n1\td\te\tf\n2\tg\th\ti\t\t\t\t\t\t\t\t0.7\nshort\n")
    assert {r["id"]: (r["relations"], r["confidence"]) for r in readers.relation_rows(spark, str(tmp_path / "rel")).collect()} == {"1": (["a|b|c", "d|e|f"], [None, None]), "2": (["g|h|i"], [0.7])}
    (tmp_path / "list").write_text("The\nthe\n\n a \n")
    assert sorted(r["word"] for r in readers.word_list(spark, str(tmp_path / "list")).collect()) == ["a", "the"]


def test_frame_vectors_and_slots(spark):
    df = spark.createDataFrame([([1.0, -2.0], [0.5, 3.0], None), ([1.0, 1.0], [2.0, 2.0], [3.0, -1.0])], "a array<double>, v array<double>, b array<double>")
    zero = F.array(F.lit(0.0), F.lit(0.0))
    got = [r[0] for r in df.select(lsh.frame_vector(F.col("a"), F.col("v"), F.coalesce("b", zero))).collect()]
    assert got == [[0.0, -2.0], [0.0, -1.0]]
    kind = "struct<arg1:string,verb:string,arg2:string>"
    rows = [(("a", "v", "b"), ("a", "v", "c")), (("a", "v", ""), ("a", "w", "")), ((None, "v", "b"), (None, "v", "b"))]
    pairs = spark.createDataFrame(rows, f"x {kind}, y {kind}")
    assert [r[0] for r in pairs.select(lsh.slot_match(F.col("x"), F.col("y"))).collect()] == [True, False, True]


def test_tables_of_words(spark):
    arr = spark.createDataFrame([(["RT", "#omg", "u", "http://x"],)], "w array<string>")
    assert arr.select(T.normalise(F.col("w"), {"u": "you"})).first()[0] == ["omg", "you"]
    t = spark.createDataFrame([("the cat", None), ("xx yy", None), ("xx", "en"), (None, None)], "t string, lang string")
    assert [r[0] for r in t.select(T.english(F.col("t"), F.col("lang"), ["the", "cat"])).collect()] == [True, False, True, False]
    tags = spark.createDataFrame([("NNS",), ("VBD",), ("TO",), ("XX",)], "t string")
    assert [r[0] for r in tags.select(T.lexical_class(F.col("t"))).collect()] == ["n", "v", "prep", None]
    rel = spark.createDataFrame([("dogs__NNS||bark__VBP||nsubj",)], "r string")
    assert rel.select(T.bare_relation(F.col("r"))).first()[0] == "dogs||bark||nsubj"


def test_streams_over_arriving_files(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2012, 10, 9, h, m)
    for k, rows in enumerate([[(1, at(1)), (2, at(1, 30))], [(2, at(1, 30)), (3, at(5))], [(4, at(0, 10)), (5, at(9))]]):
        spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    like = spark.read.parquet(str(tmp_path / "in"))
    stream = flows.read_folder(spark, str(tmp_path / "in"), like)
    counts = flows.window_counts(stream, "ts", [], "2 hours")
    flows.run_to_end(counts, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["start"].hour: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] in (3, 4) and got[4] == 1 and 8 not in got  # the last window is still open; a row of a closed one is dropped
    once = flows.first_deliveries(flows.read_folder(spark, str(tmp_path / "in"), like), "id", "ts", "12 hours")
    flows.by_day(once.withColumn("day", F.to_date("ts")), "day", str(tmp_path / "days"), str(tmp_path / "cp2"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "days")).collect()) == [1, 2, 3, 4, 5]


def test_tables_and_numbers_of_lines(spark, tmp_path):
    (tmp_path / "df").write_text("09 100#10 50\ncat\t3#0\ndog\t1#2\n")
    windows, df = readers.frequency_table(spark, str(tmp_path / "df"))
    assert {tuple(r) for r in windows.collect()} == {("09", 100), ("10", 50)}
    assert {tuple(r) for r in df.collect()} == {("cat", "09", 3), ("dog", "09", 1), ("dog", "10", 2)}
    (tmp_path / "ids").write_text("x\ny\nz\n")
    ids = readers.id_map(spark, str(tmp_path / "ids"))
    assert sorted(tuple(r) for r in ids.collect()) == [(0, "x"), (1, "y"), (2, "z")] and readers.id_map(spark, str(tmp_path / "none")) is None
    (tmp_path / "dep").write_text("dogs\tNNS\t1\tSUB\nbark\tVBP\t-1\tROOT\n\ncats\tNNS\t-1\tROOT\n\n")
    assert sorted((r["id"], r["word"]) for r in readers.parses_of(spark, str(tmp_path / "dep"), ids).collect()) == [("x", "bark"), ("x", "dogs"), ("y", "cats")]
    rows = spark.createDataFrame([(D1, "1", "a"), (D1, "2", "b"), (D2, "3", "a")], "tw date, tid string, unit string")
    writers.bursty_units(spark.createDataFrame([(D1, "a", 0)], "tw date, unit string, seg_id long"), rows, str(tmp_path / "bursty"))
    assert [r["tid"] for r in spark.read.parquet(str(tmp_path / "bursty/tweets")).collect()] == ["1"]


def test_extraction_rules(spark):
    span = "struct<st:int,ed:int>"
    pairs = [((5, 6), (1, 2), "left"), ((5, 6), (1, 4), "left adjacent"), ((1, 2), (5, 6), "right"), ((1, 2), (3, 4), "right adjacent"), ((2, 3), (1, 4), "cover"), ((1, 4), (2, 3), "inside"), ((3, 6), (1, 4), "left overlap"), ((1, 4), (3, 6), "right overlap")]
    df = spark.createDataFrame(pairs, f"a {span}, b {span}, want string")
    assert all(r[0] == r[1] for r in df.select(X.interval_relation(F.col("a"), F.col("b")), "want").collect())
    words, tags = "Obama flew to Paris".split(), ["NNP", "VBD", "TO", "NNP"]
    f = X.extraction_features(words, tags, (1, 2), (0, 0), (3, 3))
    assert set(f) == set(X.CONFIDENCE) and f["covers_text"] and f["ends_to"] and f["short"] and f["long_relation"] and f["arg1_name"] and not f["name_after_arg2"]
    assert X.confidence(f) == round(1.16 + 0.39 + 0.43 + 0.42 + 0.21 + 0.16 + 0.01, 4)
    kind = "array<struct<word:string,tag:string>>"
    t = spark.createDataFrame([("1", [("The", "DT"), ("dog", "NN"), ("took", "VBD"), ("off", "RP")]), ("2", []), ("3", None)], f"id string, tokens {kind}")
    lex = spark.createDataFrame([("took off", "n", 1), ("took", "v", 7), ("dog", "n", 3), ("the", "n", 4)], "lu_name string, lu_pos string, frame_id int")
    assert {(r["id"], r["at"], r["pattern"]) for r in X.lexical_patterns(t, "id", lex).collect()} == {("1", 1, "dog.3"), ("1", 2, "took.7")}
    c = spark.createDataFrame([("New York is , big big".split(), ["new_york", "york"]), (["a"], None)], "w array<string>, e array<string>")
    assert [r[0] for r in c.select(X.joined_context(F.col("w"), F.col("e"))).collect()] == ["new_york is big big", "a"]
    lines = spark.createDataFrame([("hi_UH @you_USR RT_RT http_URL",), ("@you_USR",), ("",), ("a_DT  dog_NN",)], "l string")
    assert [r[0] for r in lines.select(X.for_chunker(F.col("l"))).collect()] == ["hi/UH @you/NN", "---/P", "---/P", "a/DT dog/NN"]
    assert spark.createDataFrame([("(a) [b]-c/d!",)], "p string").select(X.plain_name(F.col("p"))).first()[0] == "a bcd"


def test_probability_of_runs():
    logs = {"a": -1.0, "b": -2.0, "a b": -1.5, "b c d": -3.0, "c": -4.0}
    assert L.ngram_probability(["a"], logs) == -1.0 and L.ngram_probability(["a", "b"], logs) == -1.5 and L.ngram_probability([], logs) == 0.0
    assert L.ngram_probability(["a", "b", "c", "d"], logs) == -4.0 and L.ngram_probability(["x"], logs) == -1000.0
    assert L.ngram_probability(["a"] * 60, logs) > -1000 * 60
