"""Recursive-descent grammars of delivered records, with recovery after errors.

Three formats: strict JSON (one object a record, nested to any depth), CSV (RFC 4180 quoting) and TSV (no quoting). Each grammar reads one
record from a position and returns it with the position after it, or raises Fault with the place of the error.
`read_stream` reads a text of many records: after an error it resumes at the next validated record start, so that a
quote that is never closed costs one record and not the rest of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any


class Fault(Exception):
    """What is wrong, and at which character."""

    def __init__(self, at: int, message: str) -> None:
        super().__init__(message)
        self.at, self.message = at, message


# --- JSON -----------------------------------------------------------------------------------------------------------

_SPACE = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"')
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_ESCAPE = re.compile(r'\\(?:u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)')
_NAMED = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _unescape(found: re.Match) -> str:
    body = found[0]
    if body[1] != "u":
        return _NAMED.get(body[1], body[1])
    if len(body) == 12:
        return chr(0x10000 + ((int(body[2:6], 16) - 0xD800) << 10) + int(body[8:12], 16) - 0xDC00)
    code = int(body[2:], 16)
    return "�" if 0xD800 <= code <= 0xDFFF else chr(code)


class Json:
    """value := object | array | string | number | true | false | null"""

    def __init__(self, text: str) -> None:
        self.text = text

    def skip(self, at: int) -> int:
        return _SPACE.match(self.text, at).end()

    def expect(self, at: int, what: str) -> int:
        if not self.text.startswith(what, at):
            raise Fault(at, f"expected {what!r}")
        return at + len(what)

    def record(self, at: int) -> tuple[dict, int]:
        at = self.skip(at)
        if not self.text.startswith("{", at):
            raise Fault(at, "a record is an object")
        return self.value(at)

    def value(self, at: int) -> tuple[Any, int]:
        """A value of any depth: open objects and arrays stand on a list, not on the call stack."""
        open_: list[tuple[Any, str | None]] = []  # with the key that the next value of an object belongs to
        while True:
            head = self.text[at : at + 1]
            if head == "{" or head == "[":
                at = self.skip(at + 1)
                if not self.text.startswith("}" if head == "{" else "]", at):
                    if head == "{":
                        key, at = self.key(at)
                        open_.append(({}, key))
                    else:
                        open_.append(([], None))
                    continue
                value, at = {} if head == "{" else [], at + 1
            else:
                value, at = self.scalar(at)
            while open_:
                box, key = open_[-1]
                if key is None:
                    box.append(value)
                else:
                    box[key] = value
                at = self.skip(at)
                if not self.text.startswith("]" if key is None else "}", at):
                    at = self.skip(self.expect(at, ","))
                    if key is not None:
                        key, at = self.key(at)
                        open_[-1] = (box, key)
                    break
                value, at = box, at + 1
                open_.pop()
            else:
                return value, at

    def key(self, at: int) -> tuple[str, int]:
        if not self.text.startswith('"', at):
            raise Fault(at, "expected a key")
        key, at = self.string(at)
        return key, self.skip(self.expect(self.skip(at), ":"))

    def scalar(self, at: int) -> tuple[Any, int]:
        head = self.text[at : at + 1]
        if head == '"':
            return self.string(at)
        if head in _WORDS:
            word, value = _WORDS[head]
            return value, self.expect(at, word)
        if number := _NUMBER.match(self.text, at):
            whole = number[1] is None and number[2] is None
            # Whole numbers beyond any id's length stay text: converting them takes time that grows with the square.
            value = (int(number[0]) if len(number[0]) < 400 else number[0]) if whole else float(number[0])
            return value, number.end()
        raise Fault(at, "expected a value")

    def string(self, at: int) -> tuple[str, int]:
        found = _STRING.match(self.text, at)
        if not found:
            raise Fault(at, "string not closed or not valid")
        body = found[1]
        return (_ESCAPE.sub(_unescape, body) if "\\" in body else body), found.end()


# --- CSV and TSV ----------------------------------------------------------------------------------------------------

_QUOTED = re.compile(r'"((?:[^"]|"")*)"')
_BARE = {False: re.compile(r'[^",]*'), True: re.compile(r'[^",\r\n]*')}


class Csv:
    """record := field ("," field)*; field := quoted | bare. In a stream a line end closes a record with a bare end."""

    def __init__(self, text: str, stream: bool = False) -> None:
        self.text, self.stream = text, stream

    def field(self, at: int) -> tuple[str, int]:
        if self.text.startswith('"', at):
            found = _QUOTED.match(self.text, at)
            if not found:
                raise Fault(at, "quote never closed")
            return found[1].replace('""', '"'), found.end()
        found = _BARE[self.stream].match(self.text, at)
        return found[0], found.end()

    def record(self, at: int) -> tuple[list[str], int]:
        fields = []
        while True:
            value, at = self.field(at)
            fields.append(value)
            if self.text.startswith(",", at):
                at += 1
            elif at == len(self.text) or self.stream and self.text[at] in "\r\n":
                return fields, at
            else:
                raise Fault(at, "quote inside a field")


class Tsv:
    """record := field (TAB field)*; no quoting."""

    _LINE = re.compile(r"[^\r\n]*")

    def __init__(self, text: str, stream: bool = False) -> None:
        self.text, self.stream = text, stream

    def record(self, at: int) -> tuple[list[str], int]:
        end = self._LINE.match(self.text, at).end() if self.stream else len(self.text)
        return self.text[at:end].split("\t"), end


# --- streams --------------------------------------------------------------------------------------------------------

#: How a record of each format begins, at the start of a line.
ANCHORS = {
    "json": re.compile(r'^[ \t]*\{[ \t]*"', re.M),
    "csv": re.compile(r'^"?[0-9]{18}"?,', re.M),
    "tsv": re.compile(r"^[^\t\r\n]*(?:\t[^\t\r\n]*){2,}", re.M),
}
_LINE_END = re.compile(r"[ \t]*(?:\r\n|\r|\n|$)")


@dataclass
class Read:
    """A record of a stream, or the error that stands for it: its first and last character, and what was wrong where."""

    start: int
    end: int
    value: Any = None
    error: str | None = None
    at: int | None = None


def read_stream(text: str, fmt: str) -> Iterator[Read]:
    """The records and located errors of a text of many records, in order; every character but blank lines is covered."""
    grammar = {"json": Json, "csv": lambda t: Csv(t, True), "tsv": lambda t: Tsv(t, True)}[fmt](text)
    anchor, at = ANCHORS[fmt], 0
    blank = re.compile(r"[ \t]*(?:\r\n|\r|\n)") if fmt != "tsv" else re.compile(r"\r\n|\r|\n")
    while at < len(text):
        if skipped := blank.match(text, at):
            at = skipped.end()
            continue
        try:
            value, end = grammar.record(at)
            closed = _LINE_END.match(text, end)
            if not closed:
                raise Fault(end, "more follows the record")
            yield Read(at, end, value)
            at = max(closed.end(), at + 1)
        except Fault as fault:
            resume = anchor.search(text, at + 1)
            end = resume.start() if resume else len(text)
            yield Read(at, end, None, fault.message, fault.at)
            at = end
