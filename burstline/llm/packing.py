"""Filling containers of fixed capacity with items of varying length.

Method: hierarchical multi-length packing. Items are routed to the smallest context size that holds them; each tier is
packed into its own containers, from the longest size down; what is left free in long containers is filled from the
tiers below; the containers of a tier are dealt to steps of even load. Only an item above the largest capacity is
split, into full containers and one rest.

Layout: items are dealt by a hash of their key to groups of a bounded number of items, each packed by one task; a group
wastes at most about one container a tier, so with 50,000 items a group the loss does not grow with the collection.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ITEMS = 50_000
PLACED = "capacity int, container string, step string, {key} {kind}, piece int, start long, n_tokens long, free long"


class _Stock:
    """Items by size, with the largest that fits a gap."""

    def __init__(self) -> None:
        self.by_size: dict[int, list] = defaultdict(list)
        self.sizes: list[int] = []

    def seal(self) -> None:
        self.sizes = sorted(self.by_size)

    def take(self, gap: int):
        """(size, item) of the largest item of at most `gap`, removed; None if there is none."""
        k = bisect_right(self.sizes, gap) - 1
        if k < 0:
            return None
        size = self.sizes[k]
        items = self.by_size[size]
        item = items.pop()
        if not items:
            del self.by_size[size]
            self.sizes.pop(k)
        return size, item


def pack(items: list[tuple[int, object]], tiers: list[int], capacity: int | None = None) -> list[tuple[int, list[tuple[int, object]]]]:
    """Containers (capacity, [(size, item)...]) of items (size, item) of at most the largest tier; sizes of 0 are left out.

    Items are routed to the smallest tier that holds them. From the longest tier down, its items open containers, of the
    tier's own size or, if capacity is given, all of that one; what an item leaves free is filled with the largest items of
    its tier that fit, then with those of the tiers below.
    """
    tiers = sorted(tiers)
    stocks = [_Stock() for _ in tiers]
    for size, item in sorted(items, key=lambda x: (x[0], str(x[1])), reverse=True):
        if size > 0:
            stocks[next(k for k, t in enumerate(tiers) if size <= t)].by_size[size].append(item)
    for s in stocks:
        s.seal()
    out = []
    for k in range(len(tiers) - 1, -1, -1):
        while stocks[k].sizes:
            gap, inside, below = capacity or tiers[k], [], k
            while gap > 0 and below >= 0:
                got = stocks[below].take(gap)
                if got is None:
                    below -= 1  # nothing of this tier fits the gap that is left
                    continue
                inside.append(got)
                gap -= got[0]
            out.append((capacity or tiers[k], inside))
    return out


def deal_steps(loads: list[int], per_step: int) -> list[int]:
    """The step of each container: dealt back and forth in order of load, so that steps differ little."""
    steps = max(1, -(-len(loads) // per_step))
    out = [0] * len(loads)
    for place, k in enumerate(sorted(range(len(loads)), key=lambda k: (-loads[k], k))):
        turn, spot = divmod(place, steps)
        out[k] = spot if turn % 2 == 0 else steps - 1 - spot
    return out


def _packer(key: str, per_step: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        tiers = [int(x) for x in group["tiers"].iloc[0]]
        top, name = max(tiers), f"{group['plan'].iloc[0]}-{group['grp'].iloc[0]}"
        items, full = [], []
        for k, n in zip(group["k"], group["n_tokens"], strict=True):
            n, start, piece = int(n), 0, 0
            while n - start > top:
                full.append((top, [(top, (k, piece, start))]))
                start, piece = start + top, piece + 1
            items.append((n - start, (k, piece, start)))
        containers = full + pack(items, tiers, top if group["fixed"].iloc[0] else None)
        by_tier = defaultdict(list)
        for at, (capacity, inside) in enumerate(containers):
            by_tier[capacity].append((at, sum(s for s, _ in inside)))
        step = {}
        for capacity, each in by_tier.items():
            for (at, _), s in zip(each, deal_steps([load for _, load in each], per_step), strict=True):
                step[at] = f"{name}-{capacity}-{s}"
        rows = []
        for at, (capacity, inside) in enumerate(containers):
            free = capacity - sum(s for s, _ in inside)
            for size, (k, piece, start) in inside:
                rows.append((capacity, f"{name}-{at}", step[at], k, piece, start, size, free))
        return pd.DataFrame(rows, columns=["capacity", "container", "step", key, "piece", "start", "n_tokens", "free"])

    return run


def pack_table(sizes: DataFrame, key: str, n_tokens: str, plans: list[list[int]], n_items: int, per_step: int = 64, group_items: int = GROUP_ITEMS, fixed: bool = False) -> DataFrame:
    """(capacity, container, step, key, piece, start, n_tokens, free): every item of every plan, placed once.

    A plan is a list of context sizes that are packed together; its largest is what items are split by. Containers have the
    size of the tier that opens them; fixed gives them all the plan's largest. piece counts the
    parts of an item from 0, start is its first token in the item, free what its container has left. Null, zero and
    negative sizes and null keys take no part; rows with one key are one item of the greatest size. n_items, at least the
    number of rows, sets the number of groups; the sizes themselves are computed once.
    """
    clean = sizes.where(F.col(key).isNotNull() & (F.col(n_tokens) > 0)).groupBy(F.col(key).alias("k")).agg(F.max(n_tokens).alias("n_tokens"))
    groups = max(1, -(-n_items // group_items))
    kind = clean.schema["k"].dataType.simpleString()
    table = F.array(*(F.struct(F.lit(k).alias("plan"), F.array(*map(F.lit, p)).alias("tiers"), F.lit(fixed).alias("fixed")) for k, p in enumerate(plans)))
    each = clean.select("k", "n_tokens", F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int").alias("grp"), F.explode(table).alias("p"))
    each = each.select("k", "n_tokens", "grp", "p.plan", "p.tiers", "p.fixed")
    return each.groupBy("plan", "grp").applyInPandas(_packer(key, per_step), PLACED.format(key=f"`{key}`", kind=kind))
