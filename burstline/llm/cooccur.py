"""Items that appear together in a record.

Method: stripes. Each task keeps, per item, an associative array of the items that follow it in a record and their
counts; the arrays are merged by key after a shuffle; the log-likelihood ratio tells which pairs exceed chance.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIPE = "item string, part int, others array<string>, counts array<long>"


def _stripes(parts: int, hold: int):
    """Records to partial stripes. A stripe is cut into parts by the other item's hash; at most `hold` counts are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes: dict[tuple[str, int], Counter] = defaultdict(Counter)
        part: dict[str, int] = {}
        held = 0
        for batch in batches:
            for items in batch.column(0).to_pylist():
                items.sort()
                for k, a in enumerate(items):
                    for b in items[k + 1 :]:
                        p = part.get(b)
                        if p is None:
                            p = part[b] = zlib.crc32(b.encode()) % parts
                        stripe = stripes[a, p]
                        held += b not in stripe
                        stripe[b] += 1
                        if held >= hold:
                            yield _emit(stripes)
                            stripes.clear()
                            part.clear()
                            held = 0
        if stripes:
            yield _emit(stripes)

    return run


def _emit(stripes: dict[tuple[str, int], Counter]) -> pa.RecordBatch:
    keys = list(stripes)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([list(stripes[k]) for k in keys], pa.list_(pa.string())),
            pa.array([list(stripes[k].values()) for k in keys], pa.list_(pa.int64())),
        ],
        ["item", "part", "others", "counts"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the arrays of each key of a stream sorted by key."""
    key, total = None, Counter()
    for batch in batches:
        a, b, n = [], [], []
        for item, part, others, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (item, part) != key:
                if key:
                    a += [key[0]] * len(total)
                    b += total
                    n += total.values()
                key, total = (item, part), Counter()
            for other, count in zip(others, counts, strict=True):
                total[other] += count
        yield _pairs(a, b, n)
    if key:
        yield _pairs([key[0]] * len(total), list(total), list(total.values()))


def _pairs(a: list, b: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["item_a", "item_b", "n_ab"])


def llr(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Log-likelihood ratio G2 of the 2 x 2 table of two items; 0 ln 0 is 0."""

    def part(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    cells = [
        (n_ab, n_a * n_b / n),
        (n_a - n_ab, n_a * (n - n_b) / n),
        (n_b - n_ab, n_b * (n - n_a) / n),
        (n - n_a - n_b + n_ab, (n - n_a) * (n - n_b) / n),
    ]
    total = F.lit(0.0)
    for o, e in cells:
        total = total + part(o.cast("double"), e.cast("double"))
    return 2.0 * total


def all_pairs(baskets: DataFrame, items: str, n: Column, min_count: int = 1, significance: float = 3.841, parts: int = 64, hold: int = 200_000) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, lift, llr, exceeds) with item_a < item_b, of pairs found together in min_count
    records or more; exceeds: whether they do so more often than by chance (a lift over 1) and their log-likelihood ratio
    reaches `significance` (3.841: 5 %).

    baskets has one row per record, items an array without repeats; null and single-item arrays count for n_a only.
    An item that holds a third of all records has its stripe cut into `parts` by the other item, so that no task gets
    an unbounded array; counts are combined in the task before the shuffle.
    """
    lists = baskets.select(F.filter(F.col(items), lambda x: x.isNotNull()).alias("items"))
    singles = lists.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n_i"))
    partial = lists.where(F.size("items") > 1).mapInArrow(_stripes(parts, hold), STRIPE)
    merged = partial.repartition("item", "part").sortWithinPartitions("item", "part").mapInArrow(_merge, "item_a string, item_b string, n_ab long")
    enough = merged.where(F.col("n_ab") >= min_count)
    singles = singles.where(F.col("n_i") >= min_count)
    counted = enough.join(singles.select(F.col("item").alias("item_a"), F.col("n_i").alias("n_a")), "item_a").join(
        singles.select(F.col("item").alias("item_b"), F.col("n_i").alias("n_b")), "item_b"
    )
    n_ab, n_a, n_b = F.col("n_ab"), F.col("n_a"), F.col("n_b")
    exceeds = (F.col("llr") >= significance) & (n_ab * n > n_a * n_b)
    scored = counted.select("item_a", "item_b", "n_ab", "n_a", "n_b", (n_ab * n / (n_a * n_b)).alias("lift"), llr(n_ab, n_a, n_b, n).alias("llr"))
    return scored.withColumn("exceeds", exceeds)


def together(baskets: DataFrame, items: str, n: Column, min_count: int = 6, significance: float = 3.841, parts: int = 64, hold: int = 200_000) -> DataFrame:
    """The rows of all_pairs of min_count records or more that exceed chance, without the column that says so.

    With n_ab >= 6 and a lift of 5 or more G2 is at least 2 * 6 * (ln 5 - 1 + 1/5) = 9.7, so at that threshold the test
    drops none of them.
    """
    return all_pairs(baskets, items, n, min_count, significance, parts, hold).where("exceeds").drop("exceeds")
