"""Similarity of dense vectors by sign signatures of random projections."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from burstline.functions.math import cosine, hamming

from .order import with_positions


@lru_cache(maxsize=8)
def planes(bits: int, dim: int, seed: int) -> np.ndarray:
    """Gaussian hyperplanes, one a row; drawn once in a process."""
    return np.random.default_rng(seed).standard_normal((bits, dim))


def signature(vector: Column, bits: int, dim: int, seed: int = 11) -> Column:
    """The signs of the projections, packed into longs of 62 bits; null for a null vector or one of another length."""

    def run(v: pa.Array) -> pa.Array:
        kept = [k for k, x in enumerate(v.to_pylist()) if x is not None and len(x) == dim and None not in x]
        out: list = [None] * len(v)
        if kept:
            rows = np.asarray(v.take(pa.array(kept)).to_pylist(), float)
            signs = np.zeros((len(kept), -(-bits // 62) * 62), np.int64)
            signs[:, :bits] = rows @ planes(bits, dim, seed).T >= 0
            packed = (signs.reshape(len(kept), -1, 62) << np.arange(62)).sum(axis=2)
            for k, row in zip(kept, packed.tolist(), strict=True):
                out[k] = row
        return pa.array(out, pa.list_(pa.int64()))

    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ArrayType(LongType()))(vector)


def similarity_of(distance: Column, bits: int) -> Column:
    return F.cos(F.lit(math.pi) * distance / bits)


def hamming_limit(similarity: float, bits: int, deviations: float = 3.0) -> int:
    """The distance that signatures of two vectors of this cosine stay within, but for about one pair in a thousand."""
    share = math.acos(similarity) / math.pi
    return math.ceil(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def _permute(orders: np.ndarray, bits: int):
    """Per signature one bit string for each order of its bits; orders is rounds x bits."""

    def run(s: pa.Array) -> pa.Array:
        if not len(s):
            return pa.array([], pa.list_(pa.binary()))
        longs = np.asarray(s.to_pylist(), np.int64)
        every = ((longs[:, :, None] >> np.arange(62)) & 1).reshape(len(longs), -1).astype(np.uint8)
        mixed = np.packbits(every[:, orders], axis=2)
        return pa.array([[x.tobytes() for x in row] for row in mixed], pa.list_(pa.binary()))

    run.__annotations__ = {"s": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ArrayType(BinaryType()))


def candidates(signed: DataFrame, key: str, sig: str, bits: int, rounds: int, window: int, max_hamming: int, seed: int = 5) -> DataFrame:
    """(id_a, id_b, hamming, similarity), id_a < id_b: in each round the bits are permuted, the signatures sorted, and each
    compared with those within window / 2 places.

    All rounds are one range-partitioned sort with places counted across partitions, and neighbours meet by an equi-join
    on blocks of places. Null signatures take no part.
    """
    rng = np.random.default_rng(seed)
    half = max(1, window // 2)
    base = signed.select(F.col(key).cast("string").alias("id"), F.col(sig).alias("sig")).where("sig is not null")
    mixed = _permute(np.array([rng.permutation(bits) for _ in range(rounds)]), bits)(F.col("sig"))
    at = with_positions(base.select("id", "sig", F.posexplode(mixed).alias("round", "mixed")), ["round", "mixed", "id"], "r").select("id", "sig", "round", "r")
    block = F.floor(F.col("r") / half)
    a = at.select(F.col("id").alias("x"), F.col("sig").alias("sx"), F.col("r").alias("rx"), "round", block.alias("block"))
    b = at.select(F.col("id").alias("y"), F.col("sig").alias("sy"), F.col("r").alias("ry"), "round", F.explode(F.array(block, block - 1)).alias("block"))
    met = a.join(b, ["round", "block"]).where((F.col("ry") > F.col("rx")) & (F.col("ry") - F.col("rx") <= half)).withColumn("hamming", hamming(F.col("sx"), F.col("sy")))
    out = met.where(F.col("hamming") <= max_hamming).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "hamming")
    return out.distinct().withColumn("similarity", similarity_of(F.col("hamming"), bits))


def links(vectors: DataFrame, key: str, vector: str, dim: int, similarity: float, bits: int, rounds: int, window: int) -> DataFrame:
    """(id_a, id_b, cos), id_a < id_b: the pairs of vectors with a cosine of `similarity` or more that the candidates hold,
    each checked exactly. Ids are strings; null vectors and those of another length take no part."""
    given = vectors.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("v"))
    met = candidates(given.withColumn("sig", signature(F.col("v"), bits, dim)), "id", "sig", bits, rounds, window, hamming_limit(similarity, bits))
    both = met.join(given.toDF("id_a", "va"), "id_a").join(given.toDF("id_b", "vb"), "id_b")
    return both.select("id_a", "id_b", cosine(F.col("va"), F.col("vb")).alias("cos")).where(F.col("cos") >= similarity)


def frame_vector(arg1: Column, verb: Column, arg2: Column) -> Column:
    """Element-wise least of three slot vectors and the zero vector; a missing slot counts as zeros."""

    def least(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.least(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0)), F.lit(0.0)))

    return least(least(arg1, verb), arg2)


def slot_match(a: Column, b: Column, least: int = 2) -> Column:
    """Whether two frames (structs arg1, verb, arg2) agree in at least `least` slots that are not empty."""
    same = sum(((F.coalesce(a[s], F.lit("")) == F.coalesce(b[s], F.lit(""))) & (F.coalesce(a[s], F.lit("")) != "")).cast("int") for s in ("arg1", "verb", "arg2"))
    return same >= least
