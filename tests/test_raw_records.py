"""Grammars of raw records: strictness against a plain reader, recovery, reasons."""

import csv
import io
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from burstline.sources.grammar import Fault, Json, read_stream
from burstline.sources.raw_records import blocks, parse_records, parse_streams, read_deliveries, read_one

TWEET = {"id_str": "300000000000000001", "text": "x", "created_at": "Sun Oct 14 08:15:02 +0000 2012", "lang": "en", "user": {"id_str": "2"}}
TSV = ["0", "web", "u", "n", "", "en", "300000000000000001", "0", "text", "8:15 AM - 14 Oct 2012", "1", "false", "x"]


def reason(fmt, content):
    return read_one(fmt, content).get("reason")


def tweet(**change):
    return json.dumps(TWEET | change)


@pytest.mark.parametrize(
    "fmt,content,expected",
    [
        ("json", tweet(), None), ("json", " " + tweet(extra=[1, {"a": None}]) + "\n", None), ("json", tweet() + "x", "syntax"), ("json", "[1]", "syntax"), ("json", "", "syntax"), ("json", None, "syntax"),
        ("json", '{"a": NaN}', "syntax"), ("json", '{"a": 01}', "syntax"), ("json", '{"a": 1,}', "syntax"), ("json", '{"a": "\t"}', "syntax"), ("json", '{"a": "\\x"}', "syntax"),
        ("json", json.dumps({k: v for k, v in TWEET.items() if k != "user"}), "columns"), ("json", tweet(user=None), "columns"), ("json", tweet(user={}), "columns"), ("json", tweet(id_str="3" * 17), "id"),
        ("json", tweet(id_str=None), "id"), ("json", tweet(id_str="３" * 18), "id"), ("json", tweet(created_at="false"), "time"), ("json", tweet(created_at="Wed Oct 32 08:15:02 +0000 2012"), "time"),
        ("json", tweet(text=None), "text"), ("json", tweet(text=" \n"), "text"), ("json", tweet(text="a\u007f"), "text"), ("json", tweet(text="a�b"), "text"), ("json", tweet(text="a\tb"), None),
        ("csv", "300000000000000001,2,Sun Oct 14 08:15:02 +0000 2012,en,hi", None), ("csv", '300000000000000001,2,Sun Oct 14 08:15:02 +0000 2012,en,"a ""q"", b\nc"', None),
        ("csv", '300000000000000001,2,Sun Oct 14 08:15:02 +0000 2012,en,"never', "syntax"), ("csv", '300000000000000001,2,Sun Oct 14 08:15:02 +0000 2012,en,a "b"', "syntax"),
        ("csv", '300000000000000001,2,Sun Oct 14 08:15:02 +0000 2012,en,"a"b', "syntax"), ("csv", "300000000000000001,2,Sun Oct 14 08:15:02 +0000 2012,en,a,b", "columns"), ("csv", "", "columns"),
        ("tsv", "\t".join(TSV), None), ("tsv", "\t".join(TSV[:12]), "columns"), ("tsv", "\t".join([*TSV[:6], "null", *TSV[7:]]), "id"), ("tsv", "\t".join([*TSV[:9], "0:15 AM - 14 Oct 2012", *TSV[10:]]), "time"),
        ("tsv", "\t".join([*TSV[:9], "13:15 PM - 14 Oct 2012", *TSV[10:]]), "time"), ("tsv", "\t".join([*TSV[:8], 'a "quote', *TSV[9:]]), None), ("xml", "<a/>", "syntax"), (None, "x", "syntax"),
    ],
)
def test_reasons(fmt, content, expected):
    assert reason(fmt, content) == expected


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(), x, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(), values, max_size=4), st.integers(0, 200), st.sampled_from(["", "}", '"', ",", "\\", "0"]))
def test_json_as_strict_as_the_standard_reader(value, at, put):
    text = json.dumps(value)
    text = text[: at % (len(text) + 1)] + put + text[at % (len(text) + 1) :]

    def refuse(_):
        raise ValueError

    try:
        expected = json.loads(text, parse_constant=refuse)
        assert isinstance(expected, dict)
    except (ValueError, AssertionError):
        expected = None
    try:
        grammar = Json(text)
        got, end = grammar.record(0)
        got = got if grammar.skip(end) == len(text) else None
    except Fault:
        got = None
    plain = lambda x: re.sub(r"\\ud[89a-f][0-9a-f]{2}", "\ufffd", repr(x))  # noqa: E731  half a pair reads as U+FFFD
    assert plain(got) == plain(expected)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab ,"\n', max_size=6), min_size=2, max_size=4), min_size=1, max_size=5))
def test_csv_stream_round_trip(rows):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
    assert [r.value for r in read_stream(out.getvalue(), "csv")] == rows


def test_an_open_quote_costs_one_record(spark):
    row = "30000000000000000{},2,Sun Oct 14 08:15:02 +0000 2012,en,{}"
    text = "\n".join([row.format(1, "fine"), row.format(2, '"never closed'), row.format(3, '"two\nlines"'), row.format(4, 'a "b'), row.format(5, "end")])
    df = spark.createDataFrame([("f", "csv", text, "clash"), ("g", "nope", "x", "clash"), ("h", "json", None, "clash")], "name string, fmt string, content string, reason string")
    got = parse_streams(df, "name", "fmt", "content").orderBy("name", "start_at").collect()
    assert [(r["id_str"] or "")[-1:] + (r["reason"] or "") for r in got] == ["1", "syntax", "3", "syntax", "5", "syntax"]
    assert text[got[1]["start_at"] : got[1]["end_at"]].startswith("300000000000000002") and got[1]["error_at"] >= text.index('"never')


def test_table_with_nulls_and_repeats(spark):
    rows = [(1, "json", tweet()), (1, "json", tweet()), (2, None, None), (3, "csv", "x" * 100_000), (4, "json", '{"a":' * 5000)]
    got = [(r["raw_id"], r["reason"]) for r in parse_records(spark.createDataFrame(rows, "raw_id long, fmt string, content string"), "raw_id", "fmt", "content").orderBy("raw_id").collect()]
    assert got == [(1, None), (1, None), (2, "syntax"), (3, "columns"), (4, "syntax")]
    assert parse_records(spark.createDataFrame([], "raw_id long, fmt string, content string"), "raw_id", "fmt", "content").count() == 0


@pytest.mark.parametrize("depth", [300, 5000])
def test_json_of_any_depth(depth):
    text = tweet()[:-1] + ', "deep": ' + "[" * depth + "]" * depth + "}"
    assert reason("json", text) is None and reason("json", text[:-2] + "}") == "syntax"
    assert reason("json", tweet()[:-1] + ', "deep": ' + '{"a":' * depth + "1" + "}" * (depth + 1)) is None


def test_blocks_are_read_with_recovery(spark):
    csv_row = lambda k, t: f"3{k:017},2,Sun Oct 14 08:15:02 +0000 2012,en,{t}"
    rows = [("f.csv", k, "csv", csv_row(k, f"text {k}")) for k in range(25)] + [("f.json", 1, "json", tweet()), ("f.json", 2, "json", tweet()[:-3]), ("f.json", 3, "json", tweet()), ("g", None, "csv", "x")]
    rows[7] = ("f.csv", 7, "csv", csv_row(7, '"never closed'))
    df = spark.createDataFrame(rows, "file string, line long, fmt string, content string")
    whole = blocks(df, "file", "line", "fmt", "content", size=10)
    assert {r["block"] for r in whole.collect()} == {"f.csv:0", "f.csv:1", "f.csv:2", "f.json:0"}
    got = parse_streams(whole, "block", "fmt", "content").collect()
    bad = [(r["block"], r["reason"]) for r in got if r["reason"]]
    assert sorted(bad) == [("f.csv:0", "syntax"), ("f.json:0", "syntax")] and len(got) == 28
    assert parse_streams(blocks(df.limit(0), "file", "line", "fmt", "content"), "block", "fmt", "content").count() == 0


@pytest.mark.parametrize("fmt", ["json", "tsv", "csv"])
def test_files_of_deliveries(spark, tmp_path, fmt):
    line = {"json": tweet(), "tsv": "\t".join(TSV), "csv": '300000000000000001,2,Sun Oct 14 08:15:02 +0000 2012,en,"a\nb"'}[fmt]
    broken = {"json": tweet()[:-2], "tsv": "\t".join(TSV[:11]), "csv": '300000000000000001,2,Sun Oct 14 08:15:02 +0000 2012,en,"a'}[fmt]
    (tmp_path / "f").write_text("\n".join([line, broken, line, line]) + "\n")
    got = read_deliveries(spark, str(tmp_path / "f"), fmt).collect()
    assert sum(r["reason"] is None for r in got) == 3 and len(got) == 4
