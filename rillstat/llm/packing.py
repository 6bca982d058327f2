"""Filling containers of fixed capacity with items of varying length.

Hierarchical packing over several context sizes: items longer than the capacity
are split (and only these), and every piece is routed to the smallest tier that
holds it. Tiers are packed from the longest down. Each tier packs windows of its
own size: its longest piece opens a window, whose gap is filled by the longest
pieces, mostly of shorter tiers, that still fit. Full windows are nested in
containers, which their sizes divide; the gaps of a container's windows together
are its pooled gap and take further pieces. The containers are then dealt to
step groups of equal number and nearly equal attention cost (the sum of squared
lengths), so that a step isn't held up by one heavy container.

Items are dealt to blocks by a hash, and each block packs itself in one task: no
data reaches the driver, and the work of a block doesn't grow with the corpus,
if the number of blocks does. A block wastes at most one container that ends
part-filled.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
TIERS = (256, 512, 1024, 2048)
GROUP_SIZE = 16


def split_items(sizes: DataFrame, item: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (item, ``piece``, ``first_token``, ``n_tokens``): one per item, more only for items above the capacity; an empty item has one piece of no tokens."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    s = sizes.select(F.col(item).alias(item), F.greatest(n, F.lit(0).cast("long")).alias("_rs_n"))
    piece = F.explode(F.expr(f"sequence(0L, greatest(0L, (_rs_n + {capacity - 1}) div {capacity} - 1))"))
    return s.select(item, "_rs_n", piece.alias("piece")).select(
        item, F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("_rs_n") - F.col("piece") * capacity).cast("int").alias("n_tokens")
    )


class _Stock:
    """Pieces by size; the sizes in stock are a bit set, so the longest that fits is found in one step."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.order = np.argsort(-sizes, kind="stable").tolist()
        ranked = -sizes[self.order] if len(sizes) else sizes
        self.next = np.searchsorted(ranked, -np.arange(capacity + 2), side="left").tolist()
        self.end = np.searchsorted(ranked, -np.arange(capacity + 2), side="right").tolist()
        self.bits = sum(1 << s for s in range(1, capacity + 1) if self.next[s] < self.end[s])

    def longest(self, limit: int, above: int = 0) -> int:
        """The greatest size in stock in (above, limit], or 0."""
        some = (self.bits & ((1 << (limit + 1)) - 1)) >> (above + 1) if limit > above else 0
        return some.bit_length() + above if some else 0

    def take(self, size: int) -> int:
        i = self.order[self.next[size]]
        self.next[size] += 1
        if self.next[size] == self.end[size]:
            self.bits &= ~(1 << size)
        return i


def pack_block(sizes: np.ndarray, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(container, window in its container, offset, number of containers) of pieces of positive size at most ``capacity``, given in a fixed order.

    The window is -1 for pieces in the pooled gap of a container. Each tier must
    divide the next one, the last is the capacity.
    """
    stock = _Stock(sizes, capacity)
    where, window, offset = (np.empty(len(sizes), np.int64) for _ in range(3))
    made, free, windows, used = 0, capacity, 0, 0  # of the container that is open

    def put(size: int, w: int) -> None:
        nonlocal used
        i = stock.take(size)
        where[i], window[i], offset[i] = made, w, used
        used += size

    def close() -> None:
        nonlocal made, free, windows, used
        while s := stock.longest(capacity - used):
            put(s, -1)
        made, free, windows, used = made + 1, capacity, 0, 0

    for low, top in reversed(list(zip((0, *tiers[:-1]), tiers))):
        while s := stock.longest(top, low):
            gap = top
            while s:
                put(s, windows)
                gap -= s
                s = stock.longest(gap)
            windows += 1
            free -= top
            if not free:
                close()
    if windows:
        close()
    return where, window, offset, made


def step_groups(cost: np.ndarray, group_size: int = GROUP_SIZE) -> np.ndarray:
    """Group of each container: groups of equal number, dealt there and back in order of cost."""
    groups = max(1, ceil(len(cost) / group_size))
    rank = np.empty(len(cost), np.int64)
    rank[np.argsort(-cost, kind="stable")] = np.arange(len(cost))
    turn, at = rank // groups, rank % groups
    return np.where(turn % 2 == 0, at, groups - 1 - at)


def pack(sizes: DataFrame, *, item: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, blocks: int = 1, group_size: int = GROUP_SIZE) -> DataFrame:
    """Where every piece of every item goes.

    Columns: item, ``piece``, ``first_token``, ``n_tokens``, ``tier``,
    ``block``, ``container`` (within its block), ``window`` (within its
    container; null in the pooled gap), ``offset``, ``step_group`` (within its
    block). Null or negative sizes count as empty; empty items need no room: tier
    0 and null container, window, offset and group. Repeated rows and null item
    ids are items of their own. An empty table gives an empty result. ``blocks``
    should grow with the data, so that a block holds some hundred thousand items.
    """
    if tiers[-1] != capacity or any(b % a for a, b in zip(tiers, tiers[1:])):
        raise ValueError("each tier must divide the next one, up to the capacity")
    pieces = split_items(sizes, item, size, capacity)
    placed_type = f"`{item}` {dict(sizes.dtypes)[item]}, piece int, first_token long, n_tokens int, tier int, block int, container long, window int, offset int, step_group long"

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        # any order would do; a fixed one makes a repeated task give the same result
        pdf = pdf.sort_values(["n_tokens", item, "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        n = pdf["n_tokens"].to_numpy()
        held = n > 0
        where, window, offset, made = pack_block(n[held], capacity, tiers)
        cost = np.bincount(where, weights=n[held].astype(float) ** 2, minlength=made)
        group = step_groups(cost, group_size)
        pdf["tier"] = np.where(held, np.array(tiers)[np.minimum(np.searchsorted(tiers, n), len(tiers) - 1)], 0).astype("int32")
        for name, kind, of in (("container", "Int64", where), ("window", "Int32", window), ("offset", "Int32", offset), ("step_group", "Int64", group[where] if made else where)):
            pdf[name] = pd.array([None] * len(pdf), dtype=kind)
            pdf.loc[held, name] = of
        pdf.loc[(pdf["window"] < 0).fillna(False), "window"] = pd.NA
        return pdf[[item, "piece", "first_token", "n_tokens", "tier", "block", "container", "window", "offset", "step_group"]]

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(item, "piece"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(place, placed_type)


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``containers``, ``tokens``, ``least_containers`` (no packing needs fewer) and ``unused_share`` of the room."""
    per = placed.where(F.col("container").isNotNull()).groupBy("block").agg((F.max("container") + 1).alias("c"), F.sum("n_tokens").alias("t"))
    total = per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused_share"))
