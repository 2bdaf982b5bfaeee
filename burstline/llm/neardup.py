"""Near-duplicate records with small edits: all pairs of records whose word sets have a Jaccard similarity of t or more.

Method: HyperMinHash. For each of k hash functions a record keeps the register of its least hash value: the number of
leading zeros and some mantissa bits after them. Bands of registers are the keys under which records meet. Of records
that meet and are long, the similarity is estimated from equal registers, corrected for registers that agree by chance,
and pairs that come near t are verified on their words.

Layout: equal word sets are collapsed first (in the task, before the shuffle), so copies cost nothing further. Sets are
partitioned once by their id g and that partitioning serves both joins and the verification. An id of 48 bits holds 32
parities of the set's words, its size and some of its hash. Two sets differ in at least as many words as parities, so the
ids alone rule out most pairs that meet by chance, where they meet and without loss. Those grow with the square of the
table, while what leaves the meetings grows in step with it. Band entries travel as packed blobs of 9 bytes an entry, not
as rows; of a key that is hot within a task only so many entries travel as tell its bucket that it is hot, so a key that a
third of all sets share does not fill one task. A key under which more than `hot` sets of one task's blob or more than
`crowd` sets at all meet emits no pairs there; its sets are joined by their rarest words (prefix filter), which loses no
pair at or above t.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from burstline.operators.graph import connected_components
from burstline.session import stored

from .lookalike import skeleton


@dataclass(frozen=True)
class Params:
    """bands x rows registers are hashed; a pair of similarity s meets with probability 1 - (1 - s^rows)^bands."""

    threshold: float = 0.7
    min_words: int = 8
    bands: int = 24
    rows: int = 6
    mantissa: int = 10
    sketch: int = 32
    sketch_mantissa: int = 5
    slack: float = 0.33
    hot: int = 100
    crowd: int = 10_000
    bucket_entries: int = 2_000_000
    seed: int = 7


def word_set(text: str | None) -> list[str]:
    """The sorted distinct words of a text's consistent form: lower case, cut at white space, bare at both ends."""
    out = set()
    for piece in (skeleton(text) or "").lower().split():
        if not (piece[0].isalnum() and piece[-1].isalnum()):
            a, b = 0, len(piece)
            while a < b and not piece[a].isalnum():
                a += 1
            while b > a and not piece[b - 1].isalnum():
                b -= 1
            piece = piece[a:b]
        if piece:
            out.add(piece)
    return sorted(out)


def _keyed_words(df: DataFrame, key: str, text: str, p: Params, combine: bool) -> DataFrame:
    """(words, key): one row per record; or, combined per batch, the least and the greatest key of each set."""
    slim = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    least = p.min_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = [], []
            ends: dict[str, tuple[str, str]] = {}
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = word_set(t)
                if len(ws) < least:
                    continue
                joined = " ".join(ws)
                if combine:
                    lo, hi = ends.get(joined, (k, k))
                    ends[joined] = (min(lo, k), max(hi, k))
                else:
                    keys.append(k)
                    words.append(joined)
            for joined, pair in ends.items():
                for k in sorted(set(pair)):
                    keys.append(k)
                    words.append(joined)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(keys, pa.string())], ["words", "key"])

    return slim.mapInArrow(run, "words string, key string").withColumn("sid", F.xxhash64("words"))


def distinct_sets(df: DataFrame, key: str, text: str, p: Params) -> DataFrame:
    """(g, sid, words, rep, shared): one row per distinct word set of p.min_words words or more, partitioned by g.

    Least and greatest are taken of whole structs, so that every use of the result needs the same columns below the
    exchange, which is then made once and reused.
    """
    rows = _keyed_words(df, key, text, p, True).withColumn("g", _set_id("sid", _hashes("words")))
    whole = F.struct("words", "key")
    ends = rows.repartition("g").groupBy("g", "sid").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"))
    return ends.select("g", "sid", F.col("lo.words").alias("words"), F.col("lo.key").alias("rep"), (F.col("lo.key") != F.col("hi.key")).alias("shared"))


def _hashes(words: str) -> Column:
    return F.transform(F.split(words, " "), lambda w: F.xxhash64(w))


def _set_id(sid: str, hashes: Column) -> Column:
    """32 parities of the words, 6 bits of size (63 stands for more, too), 10 bits of the hash. Different sets may share one.
    Never null, since a filter on that would part the exchange of one use from that of another."""
    one = F.lit(1).cast("long")
    odd = F.aggregate(hashes, F.lit(0).cast("long"), lambda x, h: x.bitwiseXOR(F.call_function("shiftleft", one, h.bitwiseAND(31).cast("int"))))
    whole = F.shiftleft(odd, 16).bitwiseOR(F.shiftleft(F.least(F.size(hashes), F.lit(63)).cast("long"), 10)).bitwiseOR(F.col(sid).bitwiseAND(1023))
    return F.coalesce(whole, F.lit(0).cast("long"))


def _most_apart(n, m, threshold: float):
    """The most words in which sets of n and m words with a similarity of `threshold` or more differ, to be rounded down."""
    return (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-6


def _apart_table(threshold: float) -> np.ndarray:
    """Of two sizes as ids have them, the most parities in which sets with a similarity of `threshold` or more differ; -1 if
    none are as similar. Where a size is not known all 32 may."""
    n, m = np.arange(64)[:, None], np.arange(64)[None, :]
    most = np.where((n == 63) | (m == 63), 32, np.minimum(np.floor(_most_apart(n, m, threshold)), 32))
    return np.where(np.minimum(n, m) < threshold * np.maximum(n, m) - 1e-9, -1, most).astype(np.int8)


def _minima(flat: np.ndarray, starts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k x sets array of least hash values."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, k, dtype=np.uint64)
    out = np.empty((k, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            v = flat * mul[j]
            v += add[j]
            out[j] = np.minimum.reduceat(v, starts)
    return out


def registers(least: np.ndarray, mantissa: int, most_zeros: int = 63) -> np.ndarray:
    """Leading zeros, then the mantissa bits after the first one."""
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.minimum(64 - exponent, most_zeros).astype(np.uint64)
    bits = ((fraction * 2.0 - 1.0) * (1 << mantissa)).astype(np.uint64)
    return (zeros << np.uint64(mantissa)) | np.minimum(bits, np.uint64((1 << mantissa) - 1))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0] : offsets[-1]], (offsets[:-1] - offsets[0]).astype(np.int64)


def band_keys(flat: np.ndarray, starts: np.ndarray, p: Params) -> np.ndarray:
    """bands x sets array of 64-bit keys."""
    reg = registers(_minima(flat, starts, p.bands * p.rows, p.seed), p.mantissa).reshape(p.bands, p.rows, -1)
    with np.errstate(over="ignore"):
        key = np.arange(1, p.bands + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        for r in range(p.rows):
            key = (key ^ reg[:, r]) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
    return key


def _without_hot(key: np.ndarray, gid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, gid) with at most `most` entries a key, and the set hashes of those beyond. A key that so many sets of one flush
    share is hot wherever it is met: what stays is enough to tell so there, and a key that a third of all sets share sends a
    bounded number of entries from each flush to its bucket."""
    order = np.argsort(key)
    ordered = key[order]
    if len(key) <= most or not (ordered[most:] == ordered[:-most]).any():
        return key, gid, gid[:0]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    keep = np.sort(order[rank < most])
    return key[keep], gid[keep], np.unique(gid[order[rank >= most]])


def _band_blobs(buckets: int, p: Params, sets_per_flush: int = 40_000):
    """Sets to packed band entries: per bucket, a blob of 3-byte keys in ascending order, highest bytes first, followed by
    6-byte set ids; marked hot, blobs of the 6-byte ids of sets that are known to stand under a hot key."""

    def flush(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        key = np.concatenate(keys, axis=1).ravel()
        gid = np.tile(np.concatenate(ids), p.bands)
        key, gid, hot = _without_hot(key, gid, p.hot + 1)
        place = (key >> np.uint64(32)) % np.uint64(buckets) << np.uint64(24) | key & np.uint64(0xFFFFFF)
        order = np.argsort(place)
        place = place[order]
        cut = np.searchsorted(place, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(24))
        three = place.view(np.uint8).reshape(-1, 8)[:, 2::-1]
        six = gid[order].view(np.uint8).reshape(-1, 8)[:, :6]
        here = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        blobs = [three[cut[b] : cut[b + 1]].tobytes("F") + six[cut[b] : cut[b + 1]].tobytes() for b in here]
        plain = len(here)
        for k in range(0, len(hot), 100_000):
            here.append(int(hot[k] % np.uint64(buckets)))
            blobs.append(hot[k : k + 100_000].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array(np.arange(len(here)) >= plain), pa.array(blobs, pa.binary())], ["bucket", "hot", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, starts = _flat(batch.column(1))
            keys.append(band_keys(flat, starts, p))
            ids.append(batch.column(0).to_numpy().astype(np.uint64))
            held += batch.num_rows
            if held >= sets_per_flush:
                yield flush(keys, ids)
                keys, ids, held = [], [], 0
        if held:
            yield flush(keys, ids)

    return run


def _ids(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _keys(blob: bytes) -> np.ndarray:
    high, middle, low = np.frombuffer(blob, np.uint8, len(blob) // 9 * 3).reshape(3, -1).astype(np.uint32)
    return high << 16 | middle << 8 | low


def _size(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(10) & np.uint64(63)).astype(np.intp)


def _hot_keys(each: list[np.ndarray], p: Params) -> np.ndarray:
    """Keys that more than p.hot sets of one blob share, or more than p.crowd of all; a flush sends no more on than tell so."""
    some = [k[np.flatnonzero(k[p.hot :] == k[: -p.hot])] for k in each if len(k) > p.hot]
    keys, sizes = np.unique(np.concatenate(each), return_counts=True)
    return np.union1d(keys[sizes > p.crowd], np.concatenate([keys[:0], *some]))


def _pairs(members: np.ndarray, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the sets in each row, in parts of about a million."""
    size = members.shape[1]
    if size <= p.hot:
        i, j = np.triu_indices(size, 1)
        step = max(1, 1_000_000 // len(i))
        for k in range(0, len(members), step):
            yield members[k : k + step, i].ravel(), members[k : k + step, j].ravel()
        return
    step = max(1, 1_000_000 // size)
    for row in members:
        for k in range(0, size - 1, step):
            first, then = row[k : k + step], row[k + 1 :]
            i, j = np.nonzero(np.arange(len(then))[None, :] >= np.arange(len(first))[:, None])
            yield first[i], then[j]


#: Sets of more words than this may differ in nearly as many words as unrelated sets do in parities.
SHORT = 32


def _meetings(p: Params, what: str):
    """Blobs, sorted by bucket, to pairs (a, b) of ids of sets that meet and may be near: "short", if the smaller set has at
    most SHORT words, else "long". "hot": to (id, id) of the sets under hot keys, which make no pairs here."""
    most = _apart_table(p.threshold)

    def batches_of(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(a), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 500_000].astype(np.int64)) for x in (a, b)], ["a", "b"])

    def meet(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        each = [_keys(x) for x in blobs]
        hot = _hot_keys(each, p)
        keys = np.concatenate(each)
        ids = np.concatenate([_ids(x[len(x) // 9 * 3 :]) for x in blobs])
        crowded = np.isin(keys, hot) if len(hot) else np.zeros(len(keys), bool)
        if what == "hot":
            found = np.unique(ids[crowded])
            yield from batches_of(found, found)
            return
        taken = ~crowded if what == "short" else ~crowded & (_size(ids) > SHORT)
        keys, ids = keys[taken], ids[taken]
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        many = sizes > 1
        starts, sizes = starts[many], sizes[many]
        for size in np.unique(sizes):
            for a, b in _pairs(ids[starts[sizes == size][:, None] + np.arange(size)], p):
                n, m = _size(a), _size(b)
                near = np.bitwise_count((a ^ b) >> np.uint64(16)).astype(np.int8) <= most[n, m]
                if what == "short":
                    near &= np.minimum(n, m) <= SHORT
                a, b = a[near], b[near]
                yield from batches_of(np.minimum(a, b), np.maximum(a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, hot, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hot:
                    if what == "hot":
                        yield from batches_of(_ids(blob), _ids(blob))
                    continue
                if bucket != now and held:
                    yield from meet(held)
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield from meet(held)

    return run


def prefix_candidates(sets: DataFrame, hot: DataFrame, p: Params) -> DataFrame:
    """(a, b) of the sets under hot keys, by a prefix filter: ordered by frequency among these sets, two sets of n and m
    words with a similarity of t or more share a word among the n - ceil(t n) + 1 and m - ceil(t m) + 1 rarest. Of sets that
    differ in more parities than may be, no pair is made."""
    members = sets.join(hot.select(F.col("a").alias("g")).distinct(), "g").select("g", "sid", F.split("words", " ").alias("ws"))
    each = members.select("g", "sid", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    seen = each.groupBy("w").agg(F.count("*").alias("df"))
    ranked = each.join(seen, "w").groupBy("g", "sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("ws"))
    length = F.col("n") - F.ceil(F.lit(p.threshold - 1e-9) * F.col("n")) + 1
    tokens = ranked.select("g", "sid", "n", F.explode(F.slice("ws", F.lit(1), length.cast("int"))).alias("t")).select("g", "sid", "n", F.col("t.w").alias("w"))
    a, b = tokens.toDF("a", "sa", "na", "w"), tokens.toDF("b", "sb", "nb", "w")
    near = (F.col("na") * p.threshold <= F.col("nb") + 1e-9) & (F.col("nb") * p.threshold <= F.col("na") + 1e-9)
    apart = F.bit_count(F.shiftright(F.col("a").bitwiseXOR(F.col("b")), 16))
    once = (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("sa") < F.col("sb")))
    return a.join(b, "w").where(once & near & (apart <= _most_apart(F.col("na"), F.col("nb"), p.threshold))).select("a", "b").distinct()


def _by_chance(mantissa: int, most: int, top: int = 65) -> np.ndarray:
    """Probability that the registers of two unrelated sets of n and m words agree, for n, m up to `top`; one index per size."""
    low = np.array([2.0 ** -(z + 1) * (1 + q / (1 << mantissa)) for z in range(most) for q in range(1 << mantissa)])
    high = np.array([2.0 ** -(z + 1) * (1 + (q + 1) / (1 << mantissa)) for z in range(most) for q in range(1 << mantissa)])
    n = np.maximum(np.arange(top + 1), 1)[:, None]
    cell = (1 - low) ** n - (1 - high) ** n
    return cell @ cell.T


@dataclass(frozen=True)
class _Sketch:
    """Column functions of the compressed registers (one byte each) and of the similarity they let expect."""

    p: Params

    def of(self, hashes: Column) -> Column:
        p = self.p
        most = (1 << (8 - p.sketch_mantissa)) - 1

        def run(lists: pa.Array) -> pa.Array:
            if not len(lists):
                return pa.array([], pa.binary())
            flat, starts = _flat(lists)
            reg = registers(_minima(flat, starts, p.sketch, p.seed + 1), p.sketch_mantissa, most).astype(np.uint8)
            return pa.array([x.tobytes() for x in np.ascontiguousarray(reg.T)], pa.binary())

        run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, BinaryType())(hashes)

    def likely(self, a: Column, b: Column, na: Column, nb: Column) -> Column:
        p = self.p
        chance = _by_chance(p.sketch_mantissa, (1 << (8 - p.sketch_mantissa)) - 1)

        def run(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
            if not len(a):
                return pa.array([], pa.bool_())
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, p.sketch) for c in (a, b))
            top = len(chance) - 1
            n, m = (np.minimum(c.to_numpy(zero_copy_only=False).astype(np.int64), top) for c in (na, nb))
            c = chance[n, m]
            estimate = ((x == y).mean(axis=1) - c) / (1 - c)
            return pa.array(estimate >= p.threshold - p.slack)

        run.__annotations__ = {k: pa.Array for k in ("a", "b", "na", "nb", "return")}
        return F.arrow_udf(run, BooleanType())(a, b, na, nb)


def similar_sets(sets: DataFrame, n_rows: int, p: Params) -> DataFrame:
    """(sid_a, sid_b, rep_a, rep_b, shared_a, shared_b, similarity) of distinct sets with a similarity of p.threshold or more."""
    buckets = max(16, math.ceil(n_rows * p.bands / p.bucket_entries))
    hashed = sets.select("g", _hashes("words").alias("hs"))
    blobs = hashed.mapInArrow(_band_blobs(buckets, p), "bucket int, hot boolean, blob binary")
    sorted_blobs = blobs.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    met = lambda what: sorted_blobs.mapInArrow(_meetings(p, what), "a long, b long")
    t, m = p.threshold, F.size(F.split("words", " "))
    sketch = _Sketch(p)
    small = sets.where(m > SHORT).select("g", m.alias("m"), sketch.of(_hashes("words")).alias("reg"))
    first = met("long").distinct().join(small.select(F.col("g").alias("a"), F.col("m").alias("ma"), F.col("reg").alias("ra")), "a")
    both = first.join(small.select(F.col("g").alias("b"), F.col("m").alias("mb"), F.col("reg").alias("rb")), "b")
    sized = both.where((F.col("ma") * t <= F.col("mb") + 1e-9) & (F.col("mb") * t <= F.col("ma") + 1e-9))
    likely = sized.where(sketch.likely(F.col("ra"), F.col("rb"), F.col("ma"), F.col("mb"))).select("a", "b")
    likely = met("short").unionByName(likely).unionByName(prefix_candidates(sets, met("hot"), p)).distinct()
    side = lambda s: sets.select(F.col("g").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("sid", "words", "rep", "shared")))
    near = likely.join(side("a"), "a").join(side("b"), "b")
    wa, wb = F.split("words_a", " "), F.split("words_b", " ")
    shared = F.size(F.array_intersect(wa, wb))
    return (
        near.withColumn("similarity", shared / (F.size(wa) + F.size(wb) - shared))
        .where((F.col("similarity") >= t - 1e-9) & ((F.col("a") < F.col("b")) | (F.col("sid_a") < F.col("sid_b"))))
        .select("sid_a", "sid_b", "rep_a", "rep_b", "shared_a", "shared_b", "similarity")
    )


def near_duplicates(df: DataFrame, key: str, text: str, p: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, links, members): the distinct sets, the links between them, and the records of sets that rows share.

    Null keys and texts and texts of fewer than p.min_words words take no part. members has (sid, key) of the sets that
    several records share; the only record of another set is its rep. links and members are used in several places, and
    are stored.
    """
    sets = distinct_sets(df, key, text, p)
    links = stored(similar_sets(sets, df.count(), p))
    rows = _keyed_words(df, key, text, p, False).select("sid", "key").repartition("sid").distinct()
    members = stored(rows.join(rows.groupBy("sid").agg(F.count("*").alias("n")).where("n > 1"), "sid", "left_semi"))
    return sets, links, members


def near_duplicate_pairs(df: DataFrame, key: str, text: str, p: Params = Params()) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all pairs of records, those with equal sets included."""
    sets, links, members = near_duplicates(df, key, text, p)
    a = _expand(links.select("sid_a", "rep_a", "shared_a", "sid_b", "rep_b", "shared_b"), members, "a")
    both = _expand(a, members, "b").select("id_a", "id_b").where("id_a <> id_b")
    x, y = members.toDF("sid", "id_a"), members.toDF("sid", "id_b")
    equal = x.join(y, "sid").where("id_a < id_b").select("id_a", "id_b")
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).unionByName(equal).distinct()


def _expand(links: DataFrame, members: DataFrame, s: str) -> DataFrame:
    """Adds id_s: the rep of a set of one record, else each of its records."""
    one = links.where(~F.col(f"shared_{s}")).withColumn(f"id_{s}", F.col(f"rep_{s}"))
    more = links.where(F.col(f"shared_{s}")).join(members.toDF(f"sid_{s}", f"id_{s}"), f"sid_{s}")
    return one.unionByName(more)


def near_duplicate_groups(df: DataFrame, key: str, text: str, p: Params = Params()) -> DataFrame:
    """(key, group_id, n_links): one row per record of p.min_words words or more.

    Records are in one group if links lead from one to the other; group_id is the least key in it. n_links counts the
    other word sets that the record's set is linked with; copies are one set.
    """
    sets, links, members = near_duplicates(df, key, text, p)
    ends = links.select("sid_a", "sid_b")
    groups = connected_components(ends, "sid_a", "sid_b").withColumnRenamed("node", "sid")
    degree = ends.select(F.explode(F.array("sid_a", "sid_b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("n_links"))
    named = sets.select("sid", "rep", "shared").join(groups, "sid", "left").join(degree, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.where("n_links is not null").groupBy("component").agg(F.min("rep").alias("least"))
    placed = named.join(least, "component", "left").select("sid", "rep", "shared", F.coalesce("least", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    one = placed.where("not shared").select(F.col("rep").alias(key), "group_id", "n_links")
    more = placed.where("shared").join(members, "sid").select(F.col("key").alias(key), "group_id", "n_links")
    return one.unionByName(more)
