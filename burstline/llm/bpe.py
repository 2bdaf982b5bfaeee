"""Encoding with a public byte-level BPE vocabulary, and decoding.

Method: backtracking encoder. An Aho-Corasick automaton over the vocabulary finds, in one scan, every token that starts
at every place. The longest is taken first; a token may follow another only if the pair is one that the merges would
leave side by side, which a table of merges and of each token's halves decides; at a dead end the encoder steps back.
The sequence found is the one that the merges give, in time linear in the text. Decoding reads token bytes out of one
buffer by an offset table.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of the session or the environment, never part of this package.
FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
# Fixed value: the pattern that cuts text before the merges of the byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces up to this length are kept with their ids; at most KEEP of them in a worker.
PIECE, KEEP = 48, 400_000


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A vocabulary with the encoder over it."""

    def __init__(self, vocabulary: bytes) -> None:
        model = json.loads(vocabulary)["model"]
        letters = _byte_letters()
        self.ids = {bytes(letters[c] for c in token): k for token, k in model["vocab"].items()}
        size = max(self.ids.values()) + 1
        self.token = [b""] * size
        for token, k in self.ids.items():
            self.token[k] = token
        #: The id a pair merges to; the halves of each token, a byte being its own half.
        self.merged: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(size)), list(range(size))
        for merge in model["merges"]:
            a, b = (bytes(letters[c] for c in part) for part in (merge if isinstance(merge, list) else merge.split(" ")))
            k, pair = self.ids[a + b], (self.ids[a], self.ids[b])
            self.merged[pair] = k
            if len(a + b) > 1 and self.left[k] == k:
                self.left[k], self.right[k] = pair
        self.automaton = ahocorasick.Automaton()
        for token, k in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), k))
        self.automaton.make_automaton()
        lengths = np.fromiter((len(t) for t in self.token), np.int64, size)
        self.offsets = np.append(0, np.cumsum(lengths))
        self.buffer = b"".join(self.token)
        self.cut = regex.compile(PATTERN).findall
        self.compatible = lru_cache(maxsize=1 << 18)(self._compatible)
        self.known: dict[str, bytes] = {}

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b side by side: no merge across their border comes before both are whole.

        The border is looked at from the whole tokens inwards. The younger token of the two is undone first; a pair that
        meets at the border and would merge into a token older than the one undone would have merged across it.
        """
        limit = len(self.token)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b:
                limit, a = a, self.right[a]
                if a == limit:
                    return True
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    if a == self.right[a]:
                        return True
                    limit, a = a, self.right[a]

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one piece of the cut text."""
        whole = self.ids.get(data)
        if whole is not None or not data:
            return [] if whole is None else [whole]
        starts: list[list[tuple[int, int]]] = [[] for _ in data]
        for end, (length, k) in self.automaton.iter(data.decode("latin-1")):
            starts[end - length + 1].append((length, k))  # ends ascend, so each list is from short to long
        path: list[tuple[int, int]] = []  # (id, rank among the tokens of its place)
        dead = bytearray(len(data) + 1)
        at, rank = 0, len(starts[0]) - 1
        while at < len(data):
            while rank >= 0:
                length, k = starts[at][rank]
                if not dead[at + length] and (not path or self.compatible(path[-1][0], k)):
                    break
                rank -= 1
            if rank >= 0:
                path.append((k, rank))
                at += length
                rank = len(starts[at]) - 1 if at < len(data) else -1
            else:
                dead[at] = 1
                k, rank = path.pop()
                at -= len(self.token[k])
                rank -= 1
        return [k for k, _ in path]

    def _piece(self, text: str) -> bytes:
        out: list[int] = []
        for part in self.cut(text):
            out += self.encode_bytes(part.encode("utf-8", "surrogatepass"))
        return np.array(out, np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as packed 32-bit integers; empty for an empty text.

        A space between two characters that are no white space always begins a new piece, so the text is cut there
        first and the stretches, most of them words met before, are looked up.
        """
        if not text:
            return b""
        first, *rest = text.split(" ")
        found = [self.known.get(x) for x in rest]
        if None not in found and first and not first[-1].isspace():
            return self._piece(first) + b"".join(found)
        chunks, here = [], first
        for x in rest:
            if here and x and not here[-1].isspace() and not x[0].isspace():
                chunks.append(here)
                here = x
            else:
                here = f"{here} {x}"
        chunks.append(here)
        out = [self._piece(chunks[0])]
        for x in chunks[1:]:
            ids = self.known.get(x)
            if ids is None:
                ids = self._piece(" " + x)
                if len(x) <= PIECE and not x[0].isspace() and not x[-1].isspace() and "  " not in x:
                    if len(self.known) >= KEEP:
                        self.known.clear()
                    self.known[x] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        at = np.asarray(ids, np.int64)
        return b"".join(self.buffer[a:b] for a, b in zip(self.offsets[at], self.offsets[at + 1], strict=True))


@lru_cache(maxsize=2)
def _loaded(vocabulary: bytes) -> Bpe:
    return Bpe(vocabulary)


def vocabulary_of(df: DataFrame, name: str, folder: str | None = None):
    """The vocabulary file, read on the driver and broadcast: its size is that of the file (under 2 MB)."""
    with open(os.path.join(folder or FOLDER, f"{name}.json"), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_table(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids): the ids of each text without special tokens; a null text and an empty text have the empty list.

    One pass without a shuffle, row for row; whole texts, of any length. Strings of special tokens are ordinary text.
    """
    vocabulary = vocabulary_of(df, name, folder)
    slim = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary.value)
        for batch in batches:
            packed = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.append(0, np.cumsum([len(x) // 4 for x in packed])).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    return slim.mapInArrow(run, f"`{key}` {slim.schema['_k'].dataType.simpleString()}, ids array<int>")


def token_lengths(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, n_tokens) of each text; 0 for a null or empty text."""
    vocabulary = vocabulary_of(df, name, folder)
    slim = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary.value)
        for batch in batches:
            sizes = pa.array([len(bpe.encode(t or "")) // 4 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], [key, "n_tokens"])

    return slim.mapInArrow(run, f"`{key}` {slim.schema['_k'].dataType.simpleString()}, n_tokens long")


def decode_table(df: DataFrame, key: str, ids: str, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, text) of sequences of ids; bytes that are no UTF-8 become U+FFFD; a null sequence has a null text."""
    vocabulary = vocabulary_of(df, name, folder)
    slim = df.select(F.col(key).alias("_k"), F.col(ids).alias("_i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary.value)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return slim.mapInArrow(run, f"`{key}` {slim.schema['_k'].dataType.simpleString()}, text string")
