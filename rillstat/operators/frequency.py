"""Frequencies: Count-Min counters and heavy hitters.

A sketch is relational: rows (``row``, ``col``, ``n``) of the counters in use,
at most ``depth * width`` whatever the data. Every task folds its rows into one
dense array and emits only its counters, so the shuffle has tasks x counters
rows, not input rows; a hot item is added up before it moves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstat.functions.hashing import MIX_1, words_of

# Fixed value: the stride between the hashes of successive rows.
ROW_STRIDE = 0x9E3779B97F4A7C15
_U64 = np.uint64


def _check(width: int, depth: int) -> None:
    if width < 2 or width & (width - 1) or depth < 1:
        raise ValueError("width must be a power of two, depth positive")


def columns_of(h: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Counter of each unsigned hash in each row: an array (hashes, depth)."""
    rows = h[:, None] + np.arange(depth, dtype=_U64) * _U64(ROW_STRIDE)
    rows = (rows ^ (rows >> _U64(33))) * _U64(MIX_1)
    return ((rows ^ (rows >> _U64(33))) & _U64(width - 1)).astype(np.int64)


def cms_build(df: DataFrame, h: str, *, weight: str | None = None, width: int = 2048, depth: int = 7) -> DataFrame:
    """Counters of the BIGINT hashes ``h`` of ``df``; null hashes and weights are left out. Weights must not be negative."""
    _check(width, depth)
    cols = [F.col(h).cast("long").alias("h")] + ([F.col(weight).cast("long").alias("w")] if weight else [])

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(depth * width, np.int64)
        for p in parts:
            if not p.num_rows:
                continue
            at = columns_of(words_of(p.column(0)), width, depth) + np.arange(depth) * width
            w = p.column(1).to_numpy(zero_copy_only=False).astype(np.int64) if weight else np.ones(p.num_rows, np.int64)
            np.add.at(held, at.ravel(), np.repeat(w, depth))
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array((used // width).astype(np.int32)), pa.array((used % width).astype(np.int32)), pa.array(held[used])], names=["row", "col", "n"])

    return cms_merge(df.select(*cols).dropna().mapInArrow(fold, "row int, col int, n long"))


def cms_merge(sketches: DataFrame) -> DataFrame:
    """Union of counters of equal width and depth."""
    return sketches.groupBy("row", "col").agg(F.sum("n").alias("n"))


def cms_total(sketch: DataFrame) -> DataFrame:
    """One row, ``total``: all that was counted (every row of counters holds it)."""
    return sketch.where(F.col("row") == 0).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def cms_columns(h: Column, width: int = 2048, depth: int = 7) -> Column:
    """ARRAY<INT>: the counter of a BIGINT hash in each row."""
    _check(width, depth)

    @F.arrow_udf("array<int>")
    def cols(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            flat = columns_of(words_of(p), width, depth).astype(np.int32).ravel()
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * depth), pa.array(flat))

    return cols(h.cast("long"))


def cms_estimate(sketch: DataFrame, items: DataFrame, h: str, *, width: int = 2048, depth: int = 7) -> DataFrame:
    """(``h``, ``estimate``) of each distinct non-null hash of ``items``: the least of its counters, never below the true count; 0 if one is unused."""
    wanted = items.select(F.col(h)).dropna().dropDuplicates()
    cells = wanted.select(h, F.posexplode(cms_columns(F.col(h), width, depth)).alias("row", "col"))
    # at most depth * width counters
    met = cells.join(F.broadcast(sketch), ["row", "col"], "left")
    return met.groupBy(h).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def cms_error_bound(width: int) -> float:
    """Share of the total by which an estimate exceeds the truth at most, with ``cms_confidence``."""
    return math.e / width


def cms_confidence(depth: int) -> float:
    return 1 - math.exp(-depth)


def heavy_hitters(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent non-null keys with exact counts: (key, ``count``); ties by the lesser key.

    Counting combines on the map side, so a hot key moves as one row a task; only
    ``k`` rows a task take part in the final order.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), F.col(key).asc()).limit(k)


def heavy_hitters_estimated(df: DataFrame, h: str, k: int = 10, *, width: int = 1024, depth: int = 5) -> DataFrame:
    """The ``k`` hashes of greatest estimate: (``h``, ``estimate``); ties by the lesser hash.

    Candidates are all distinct hashes, so no hitter is missed.
    """
    est = cms_estimate(cms_build(df, h, width=width, depth=depth), df, h, width=width, depth=depth)
    return est.orderBy(F.col("estimate").desc(), F.col(h).asc()).limit(k)
