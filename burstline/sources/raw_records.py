"""Raw deliveries of tweets: valid records as typed tweets, the others apart with the reason and the place."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammar import Csv, Fault, Json, Tsv, read_stream

PARSED = "id_str string, user_id_str string, created_at string, ts timestamp_ntz, lang string, text string, reason string, detail string, error_at long"
_PARSED_ARROW = pa.schema(
    [
        ("id_str", pa.string()),
        ("user_id_str", pa.string()),
        ("created_at", pa.string()),
        ("ts", pa.timestamp("us")),
        ("lang", pa.string()),
        ("text", pa.string()),
        ("reason", pa.string()),
        ("detail", pa.string()),
        ("error_at", pa.int64()),
    ]
)

# The names of months and days in time stamps.
MONTHS = {m: k for k, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}
DAYS = "Mon Tue Wed Thu Fri Sat Sun".split()
_LONG = re.compile(r"([A-Z][a-z]{2}) ([A-Z][a-z]{2}) ([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2}) \+0000 ([0-9]{4})")
_SHORT = re.compile(r"([0-9]{1,2}):([0-9]{2}) (AM|PM) - ([0-9]{1,2}) ([A-Z][a-z]{2}) ([0-9]{4})")
_ID = re.compile(r"[0-9]{18}")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]")


def long_time(text: object) -> dt.datetime | None:
    """`Sun Oct 14 08:15:02 +0000 2012`; null if it is not an existing date and time, the day's name included."""
    found = _LONG.fullmatch(text) if isinstance(text, str) else None
    if not found or found[2] not in MONTHS or found[1] not in DAYS:
        return None
    try:
        when = dt.datetime(int(found[7]), MONTHS[found[2]], int(found[3]), int(found[4]), int(found[5]), int(found[6]))
    except ValueError:
        return None
    return when if DAYS[when.weekday()] == found[1] else None


def short_time(text: object) -> dt.datetime | None:
    """`8:15 AM - 14 Oct 2012`, hours 1 to 12; null if it is not an existing date and time."""
    found = _SHORT.fullmatch(text) if isinstance(text, str) else None
    if not found or found[5] not in MONTHS or not 1 <= int(found[1]) <= 12:
        return None
    try:
        return dt.datetime(int(found[6]), MONTHS[found[5]], int(found[4]), int(found[1]) % 12 + 12 * (found[3] == "PM"), int(found[2]))
    except ValueError:
        return None


def _plain(value: object) -> str | None:
    return value if isinstance(value, str) else None


def typed(fmt: str | None, value: object) -> dict:
    """The tweet that a record's fields make, with the first reason against it: columns, id, time, text."""
    if fmt == "json":
        user = value.get("user")
        missing = [k for k in ("id_str", "text", "created_at", "user") if k not in value]
        if not missing and not (isinstance(user, dict) and "id_str" in user):
            missing = ["user.id_str"]
        user_id = user.get("id_str") if isinstance(user, dict) else None
        key, when, lang, text = (value.get(k) for k in ("id_str", "created_at", "lang", "text"))
        ts, fault = long_time(when), missing and "no " + ", ".join(missing)
    elif fmt == "csv":
        fault = len(value) != 5 and f"{len(value)} fields"
        key, user_id, when, lang, text = value if not fault else [None] * 5
        ts = long_time(when)
    else:
        fault = len(value) != 13 and f"{len(value)} fields"
        user_id, lang, key, text, when = (value[k] for k in (2, 5, 6, 8, 9)) if not fault else [None] * 5
        ts = short_time(when)
    out = {"id_str": _plain(key), "user_id_str": _plain(user_id), "created_at": _plain(when), "ts": ts, "lang": _plain(lang), "text": _plain(text)}
    if fault:
        return out | {"reason": "columns", "detail": fault}
    if not (isinstance(key, str) and _ID.fullmatch(key)):
        return out | {"reason": "id", "detail": f"id {key!r}"[:80]}
    if ts is None:
        return out | {"reason": "time", "detail": f"time {when!r}"[:80]}
    if not isinstance(text, str) or not text.strip():
        return out | {"reason": "text", "detail": "no text"}
    if found := _CONTROL.search(text):
        return out | {"reason": "text", "detail": f"character U+{ord(found[0]):04X} in the text"}
    return out


def read_one(fmt: str | None, content: str | None) -> dict:
    """A content that is one whole record. A null content reads as an empty one, a format that is not known as syntax."""
    content = content or ""
    try:
        if fmt == "json":
            grammar = Json(content)
            value, end = grammar.record(0)
            end = grammar.skip(end)
            if end < len(content):
                raise Fault(end, "more follows the record")
        elif fmt == "csv":
            value, _ = Csv(content).record(0)
        elif fmt == "tsv":
            value, _ = Tsv(content).record(0)
        else:
            raise Fault(0, f"format {fmt!r}")
    except Fault as fault:
        return {"reason": "syntax", "detail": fault.message, "error_at": fault.at}
    return typed(fmt, value)


def _batch(rows: list[dict], keys: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in _PARSED_ARROW]
    return pa.RecordBatch.from_arrays(keys + columns, names + _PARSED_ARROW.names)


def parse_records(df: DataFrame, key: str, fmt: str, content: str) -> DataFrame:
    """(key, id_str, user_id_str, created_at, ts, lang, text, reason, detail, error_at), one row per row of df.

    Each content is one whole record and may hold line breaks. reason is null for a valid record, else the first that
    holds of syntax, columns, id, time, text; error_at is the place of a syntax error. Row by row, without a shuffle;
    other columns of df are dropped.
    """
    slim = df.select(F.col(key).alias("_k"), F.col(fmt).alias("_f"), F.col(content).alias("_c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read_one(f, c) for f, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield _batch(rows, [b.column(0)], [key])

    kind = slim.schema["_k"].dataType.simpleString()
    return slim.mapInArrow(run, f"`{key}` {kind}, {PARSED}")


def parse_streams(df: DataFrame, key: str, fmt: str, content: str) -> DataFrame:
    """Like parse_records for contents that hold many records each, such as files read whole.

    Adds start_at and end_at, the characters of a record; after an error reading resumes at the next record start.
    """
    slim = df.select(F.col(key).alias("_k"), F.col(fmt).alias("_f"), F.col(content).alias("_c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, f, c in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows: list[dict] = []
                if f in ("json", "csv", "tsv"):
                    for r in read_stream(c or "", f):
                        row = {"reason": "syntax", "detail": r.error, "error_at": r.at} if r.error else typed(f, r.value)
                        rows.append(row | {"start": r.start, "end": r.end})
                else:
                    rows.append({"reason": "syntax", "detail": f"format {f!r}", "error_at": 0, "start": 0, "end": len(c or "")})
                keys = [pa.array([k.as_py()] * len(rows), b.column(0).type), *(pa.array([r[x] for r in rows], pa.int64()) for x in ("start", "end"))]
                yield _batch(rows, keys, [key, "start_at", "end_at"])

    kind = slim.schema["_k"].dataType.simpleString()
    return slim.mapInArrow(run, f"`{key}` {kind}, start_at long, end_at long, {PARSED}")


def blocks(df: DataFrame, file: str, line: str, fmt: str, content: str, size: int = 1000) -> DataFrame:
    """(block, fmt, content): deliveries put together again from their records, `size` line numbers a block, so that a file
    that holds a third of all records is many blocks. block is `file:number`; records without a file or line take no part."""
    given = df.where(F.col(file).isNotNull() & F.col(line).isNotNull()).select(F.concat_ws(":", F.col(file), F.floor(F.col(line) / size).cast("string")).alias("block"), F.col(line).alias("line"), F.col(fmt).alias("fmt"), F.coalesce(content, F.lit("")).alias("content"))
    one = given.groupBy("block", "fmt").agg(F.sort_array(F.collect_list(F.struct("line", "content"))).alias("rows"))
    return one.select("block", "fmt", F.array_join(F.transform("rows", lambda r: r["content"]), "\n").alias("content"))


def read_deliveries(spark, path: str, fmt: str) -> DataFrame:
    """parse_streams over the files of a path. TSV is cut at line ends and JSON where a line begins with an object, so tasks
    share large files; start_at counts from such a cut. In CSV a quote may close many lines later, so a file is one unit of
    work: larger ones than some hundred MB must be cut at record starts before."""
    separator = {"tsv": "\n", "json": "\n{"}.get(fmt)
    reader = spark.read.format("text").option("lineSep", separator) if separator else spark.read.format("text").option("wholetext", "true")
    value = F.when(F.ltrim("value").startswith("{"), F.col("value")).otherwise(F.concat(F.lit("{"), "value")) if fmt == "json" else F.col("value")
    files = reader.load(path).where(F.col("value") != "")
    return parse_streams(files.select(F.input_file_name().alias("file"), F.lit(fmt).alias("fmt"), value.alias("value")), "file", "fmt", "value")
