"""The language of each text, and of each stretch of a mixed one, with a confidence.

Method: compression classification. Per language a raw-content dictionary for zstandard is made of the words that are
usual in it; a text is encoded with each dictionary and belongs to the language of the smallest size. Where the margin
is narrow it is encoded again at a level that searches more and the sizes are added; what is still narrow is rejected and
gets no language. Windows along a text are classified alike; where two of them differ, the text is encoded in two parts at
every possible border between them, and is cut where the best border saves enough over one language, each part again.

The dictionaries are made on the driver of a bounded sample of labelled rows (Params.sample a label); every other step
runs over all rows, in Arrow batches without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise
from operator import add

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookalike import skeleton

# The languages told apart, and the other codes by which labels name them (three letters, withdrawn).
LANGUAGES = ["en", "es", "pt", "fr", "de", "id", "it", "nl", "ru"]
CODES = {
    "eng": "en", "spa": "es", "por": "pt", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de",
    "ind": "id", "in": "id", "ita": "it", "nld": "nl", "dut": "nl", "rus": "ru",
}


@dataclass(frozen=True)
class Params:
    """sample: labelled rows a language for the dictionaries, at most about this many. dictionary: bytes of one.

    words: the least words a text needs. window: the least words, names not counted, of each language in a mixed text.
    probe: words of a window in which a change of language is looked for. margin: bytes by which the best language must
    win without a closer look; reject: the margin, after a closer look, up to which a text gets no language; saved: bytes
    that a border must save. rounds: of training.
    """

    languages: tuple[str, ...] = tuple(LANGUAGES)
    sample: int = 2000
    dictionary: int = 24_000
    words: int = 4
    window: int = 5
    probe: int = 8
    margin: int = 2
    reject: int = 1
    saved: int = 4
    rounds: int = 2


#: Words that are encoded at once; a tweet has fewer.
CHUNK = 64


def language_of_label(label: Column) -> Column:
    """The language that a label names in any spelling: letter case, a region added, a three-letter or withdrawn code.

    Null for null, empty and labels that name none of the languages told apart.
    """
    base = F.split(F.lower(F.trim(label)), "[-_]").getItem(0)
    known = F.create_map(*(F.lit(x) for pair in {**CODES, **{k: k for k in LANGUAGES}}.items() for x in pair))
    return F.try_element_at(known, base)


_DROP = re.compile(r"https?://\S+|www\.\S+|[@#]\S+|\S*\d\S*")
_WORD = re.compile(r"[^\W\d_]+")


def running_words(text: str | None) -> list[str]:
    """The words of a text without links, mentions, tags and numbers, in the consistent form, letter case kept."""
    return _WORD.findall(_DROP.sub(" ", skeleton(text))) if text else []


def _size_params(dictionary: bytes, careful: bool) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    kind = {} if careful else {"strategy": zstandard.STRATEGY_FAST, "target_length": 1, "min_match": 5}
    level = 3 if careful else 1
    p = zstandard.ZstdCompressionParameters.from_level(
        level, source_size=100, dict_size=len(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False, **kind
    )
    data.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=p)


@dataclass
class Model:
    """The dictionaries, and the words that are not names though they may be written with a capital."""

    dictionaries: dict[str, bytes]
    plain: frozenset[str]
    params: Params
    _tools: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None}

    def tools(self) -> tuple[list[zstandard.ZstdCompressor], list[zstandard.ZstdCompressor]]:
        if self._tools is None:
            self._tools = tuple([_size_params(d, careful) for d in self.dictionaries.values()] for careful in (False, True))
        return self._tools

    def words(self, text: str | None) -> list[str]:
        """The words of a text that belong to a language: running words without names."""
        return [low for w in running_words(text) if (low := w.lower()) == w or low in self.plain]

    def sizes(self, texts: list[bytes], careful: bool = False) -> list[tuple[int, ...]]:
        """Per text its size under each dictionary."""
        if not texts:
            return []
        each = [[len(x) for x in c.multi_compress_to_buffer(texts, threads=1)] for c in self.tools()[careful]]
        return list(zip(*each, strict=True))

    def weigh(self, lists: list[list[str]], careful: bool = False) -> list[tuple[int, ...]]:
        """Per list of words its size under each dictionary. Long lists are encoded in chunks whose sizes are added, so that
        every word is encoded with the dictionary in reach and not with what the text itself said before."""
        chunks = [(k, ws[i : i + CHUNK]) for k, ws in enumerate(lists) for i in range(0, max(1, len(ws)), CHUNK)]
        out: list[tuple[int, ...]] = [()] * len(lists)
        for (k, _), s in zip(chunks, self.sizes([_pack(ws) for _, ws in chunks], careful), strict=True):
            out[k] = tuple(map(add, out[k], s)) if out[k] else s
        return out

    def classify(self, lists: list[list[str]]) -> list[list[tuple[int, int, str | None, float]]]:
        """Per list of words its stretches (from word, to word, language, confidence); language null where rejected."""
        p, names = self.params, list(self.dictionaries)
        out: list[list[tuple[int, int, str | None, float]]] = [[] for _ in lists]
        live = [k for k, ws in enumerate(lists) if len(ws) >= p.words]
        sizes = self.weigh([lists[k] for k in live])
        close = [i for i, s in enumerate(sizes) if _margin(s) < p.margin]
        for i, s in zip(close, self.weigh([lists[live[i]] for i in close], True), strict=True):
            sizes[i] = tuple(x + y for x, y in zip(sizes[i], s, strict=True))
        for i, k in enumerate(live):
            s = sizes[i]
            best = min(range(len(s)), key=s.__getitem__)
            out[k] = [(0, len(lists[k]), names[best] if _margin(s) > p.reject else None, confidence(s))]
        for k, cuts in self._cuts([(k, lists[k]) for k in live if len(lists[k]) >= 2 * p.window]).items():
            while True:
                ends = [0, *cuts, len(lists[k])]
                each = self.weigh([lists[k][a:b] for a, b in pairwise(ends)], True)
                best = [min(range(len(s)), key=s.__getitem__) for s in each]
                kept = [c for c, (x, y) in zip(cuts, pairwise(best), strict=True) if x != y]
                if len(kept) == len(cuts):  # else stretches of one language are joined again
                    break
                cuts = kept
            out[k] = [(a, b, names[x], confidence(s)) for (a, b), x, s in zip(pairwise(ends), best, each, strict=True)]
        return out

    def _cuts(self, texts: list[tuple[int, list[str]]]) -> dict[int, list[int]]:
        """Where each text changes its language: key to borders, texts of one language left out.

        Both ends and, in longer texts, the windows between them are classified; a change between two of them is looked for
        at every possible border, and each side of a border that saves enough is searched again, so a text may have any
        number of stretches. The work for one text grows with its length.
        """
        p = self.params
        found: dict[int, list[int]] = {}
        open_ = [(k, 0, ws) for k, ws in texts]
        while open_:
            spots = [_spots(len(ws), p) for _, _, ws in open_]
            told = iter(self.sizes([_pack(ws[a:b]) for (_, _, ws), each in zip(open_, spots, strict=True) for a, b in each]))
            after = []
            for (k, start, ws), each in zip(open_, spots, strict=True):
                sizes = [next(told) for _ in each]
                if cut := self._change(ws, each, sizes):
                    found.setdefault(k, []).append(start + cut)
                    after += [(k, start + at, part) for at, part in ((0, ws[:cut]), (cut, ws[cut:])) if len(part) >= 2 * p.window]
            open_ = after
        return {k: sorted(cuts) for k, cuts in found.items()}

    def _change(self, ws: list[str], spots: list[tuple[int, int]], sizes: list[tuple[int, ...]]) -> int | None:
        """A border in the words, or null: between the two ends, else between the first end and the first window inside
        that is clearly of another language, if another border leads back from it."""
        best = [min(range(len(s)), key=s.__getitem__) for s in sizes]
        a, b = best[0], best[-1]
        if len(ws) > 8 * self.params.probe:  # a long text is searched only around a change of windows
            for (x, y), (c, d) in zip(pairwise(best), pairwise(spots), strict=True):
                start = max(0, c[0] - self.params.probe)
                if x != y and (cut := self._border(ws[start : d[1] + self.params.probe], x, y)):
                    return start + cut
            return None
        if a != b and (cut := self._border(ws, a, b)):
            return cut
        for (start, end), c, s in zip(spots[1:-1], best[1:-1], sizes[1:-1], strict=True):
            if c not in (a, b) and s[a] - s[c] >= self.params.saved:
                cut, back = self._border(ws[:end], a, c), self._border(ws[start:], c, b)
                if cut and back and start + back - cut >= self.params.window:
                    return cut
        return None

    def _border(self, ws: list[str], a: int, b: int) -> int | None:
        """The border that divides the words best between two languages; null if one language alone does as well."""
        p, tools = self.params, self.tools()[0]
        cuts = range(p.window, len(ws) - p.window + 1)
        if not cuts:
            return None
        heads = [len(x) for x in tools[a].multi_compress_to_buffer([_pack(ws[:c]) for c in cuts], threads=1)]
        tails = [len(x) for x in tools[b].multi_compress_to_buffer([_pack(ws[c:]) for c in cuts], threads=1)]
        best, cut = min((h + t, c) for h, t, c in zip(heads, tails, cuts, strict=True))
        (alone,), (frame,) = self.sizes([_pack(ws)]), self.sizes([b" "])
        return cut if min(alone) - (best - frame[a]) >= p.saved else None


def _spots(n: int, p: Params) -> list[tuple[int, int]]:
    """The windows of n words that are classified: both ends and, where words lie between them, steps in between."""
    w = min(p.probe, n // 2)
    return [(0, w), *((k, k + w) for k in range(w // 2, n - w, max(1, w // 2)) if n >= 3 * p.window), (n - w, n)]


def _pack(words: list[str]) -> bytes:
    return f" {' '.join(words)} ".encode()


def _margin(sizes: tuple[int, ...]) -> int:
    a, b = sorted(sizes)[:2]
    return b - a


def confidence(sizes: tuple[int, ...]) -> float:
    """The share of the best language if each byte saved halves the odds."""
    least = min(sizes)
    return round(1 / sum(math.pow(2.0, least - s) for s in sizes), 4)


def train(rows: list[tuple[str, str]], params: Params = Params()) -> Model:
    """A model of (language, text) rows whose labels may be wrong.

    A word enters a language's dictionary if rows of that language hold it about as often as rows of any other, the
    most usual ones last, where they cost least. Rows whose label the first model contradicts are left out of the next.
    """
    kept = [(lang, running_words(text)) for lang, text in rows]
    model = None
    for _ in range(max(1, params.rounds)):
        low, cap = Counter(), Counter()
        held = {lang: Counter() for lang in params.languages}
        n = Counter(lang for lang, _ in kept)
        for lang, ws in kept:
            for w in ws:
                (low if w == w.lower() else cap)[w.lower()] += 1
            held[lang].update({w.lower() for w in ws})
        rate = {lang: {w: c / max(1, n[lang]) for w, c in held[lang].items()} for lang in params.languages}
        top: dict[str, float] = {}
        total: dict[str, float] = {}
        for each in rate.values():
            for w, r in each.items():
                top[w] = max(top.get(w, 0.0), r)
                total[w] = total.get(w, 0.0) + r
        plain = set()
        dictionaries = {}
        for lang, each in rate.items():
            words = []
            for w, r in each.items():
                if r < 0.3 * top[w] or held[lang][w] < 2:
                    continue
                # Written small often enough, or a word that this language alone writes with a capital (nouns).
                own = r >= 0.9 * total[w] and r >= 0.004 and held[lang][w] >= 6
                if low[w] < 0.2 * (low[w] + cap[w]) and not own:
                    continue
                if held[lang][w] >= 6:
                    plain.add(w)
                words.append((r, w))
            words.sort()
            dictionaries[lang] = f" {' '.join(w for _, w in words)} ".encode()[-params.dictionary :] or b" "
        model = Model(dictionaries, frozenset(plain), params)
        told = model.classify([[w.lower() for w in ws if w == w.lower() or w.lower() in plain] for _, ws in kept])
        kept = [row for row, t in zip(kept, told, strict=True) if len(t) == 1 and t[0][2] == row[0]] or kept
    return model


def labelled_sample(df: DataFrame, key: str, text: str, label: str, params: Params = Params()) -> list[tuple[str, str]]:
    """(language, text) of a bounded sample of labelled rows: of each language about params.sample, chosen by the hash of
    their key, so that the choice does not depend on the layout of the table."""
    rows = df.select(F.xxhash64(key).alias("h"), F.col(text).alias("t"), language_of_label(F.col(label)).alias("l")).where("l is not null and length(t) >= 12")
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    share = F.lit(0.0)
    for lang in params.languages:
        share = F.when(F.col("l") == lang, min(1.0, params.sample / max(1, counts.get(lang, 0)))).otherwise(share)
    chosen = rows.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).select("l", "t", "h").collect()
    return [(r["l"], r["t"]) for r in sorted(chosen, key=lambda r: (r["h"], r["t"]))]


SEGMENTS = "parts int, from_word int, to_word int, segment string, lang string, confidence double"


def segments(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, parts, from_word, to_word, segment, lang, confidence): one row per stretch of one language.

    Texts of fewer than params.words words that belong to a language yield no row, nor do null and empty texts; where the
    margins stay narrow lang is null. from_word and to_word count such words, segment holds them, parts is
    the number of stretches of the text. Row for row: a record
    that stands in the table twice comes out twice.
    """
    handed = df.sparkSession.sparkContext.broadcast(model)  # bounded: languages x Params.dictionary, and their words
    slim = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = handed.value
        for batch in batches:
            lists = [m.words(t) for t in batch.column(1).to_pylist()]
            place, parts, a, b, words, lang, sure = [], [], [], [], [], [], []
            for k, found in enumerate(m.classify(lists)):
                for x, y, name, c in found:
                    place.append(k)
                    parts.append(len(found))
                    a.append(x)
                    b.append(y)
                    words.append(" ".join(lists[k][x:y]))
                    lang.append(name)
                    sure.append(c)
            keys = batch.column(0).take(pa.array(place, pa.int64()))
            arrays = [keys, pa.array(parts, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(words, pa.string()), pa.array(lang, pa.string()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [key, "parts", "from_word", "to_word", "segment", "lang", "confidence"])

    return slim.mapInArrow(run, f"`{key}` {slim.schema['_k'].dataType.simpleString()}, {SEGMENTS}")
