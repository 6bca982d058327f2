"""Distinct counts by maximum-rank registers (HyperLogLog with linear counting).

A sketch is relational and sparse: one row (by..., ``idx``, ``rank``) per
register in use, so that building and uniting are aggregations with map-side
combine, hashed by group and register. A hot group is thereby spread over up to
``2**p`` keys. Relative standard error: ``1.04 / sqrt(2**p)``.

The register is the low ``p`` bits of the hash, the rank counts the leading
zeros of the other bits from 1; a hash whose other bits are all zero has rank
65 - p. Null hashes are left out; null group values are groups of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alpha(p: int) -> float:
    """Bias constant of 2**p registers."""
    return 0.7213 / (1 + 1.079 / 2**p)


def standard_error(p: int) -> float:
    return 1.04 / math.sqrt(2**p)


def register_of(h: Column, p: int) -> tuple[Column, Column]:
    """(register, rank) of a BIGINT hash."""
    rest = F.shiftrightunsigned(h, p)
    # the number of leading zeros comes from the binary digits of the rest
    rank = F.when(rest == 0, F.lit(65 - p)).otherwise(F.lit(65 - p) - F.length(F.bin(rest)))
    return h.bitwiseAND(F.lit((1 << p) - 1).cast("long")).cast("int"), rank.cast("int")


def hll_build(df: DataFrame, by: list[str], h: str, p: int = 14) -> DataFrame:
    """Sketch rows of the hashes ``h`` of each group."""
    if not 4 <= p <= 18:
        raise ValueError("p must lie between 4 and 18")
    idx, rank = register_of(F.col(h), p)
    return df.where(F.col(h).isNotNull()).select(*by, idx.alias("idx"), rank.alias("rank")).groupBy(*by, "idx").agg(F.max("rank").alias("rank"))


def hll_merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Union of all sketch rows of each group: the greatest rank of each register."""
    return sketches.groupBy(*by, "idx").agg(F.max("rank").alias("rank"))


def hll_estimate(sketch: DataFrame, by: list[str], p: int = 14) -> DataFrame:
    """(by..., ``cardinality``) of (merged) sketch rows; registers without a row are empty.

    Up to 2.5 times the number of registers, and while one is empty, linear
    counting holds. With no ``by`` an empty sketch gives 0.
    """
    m = float(2**p)
    sums = sketch.groupBy(*by).agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("_rs_s"), F.count(F.lit(1)).alias("_rs_used"))
    empty = F.lit(m) - F.col("_rs_used")
    raw = F.lit(alpha(p) * m * m) / (F.col("_rs_s") + empty)
    linear = F.lit(m) * F.ln(F.lit(m) / F.when(empty > 0, empty))
    return sums.select(*by, F.when((raw <= 2.5 * m) & (empty > 0), linear).otherwise(raw).alias("cardinality"))


def hll_builtin(df: DataFrame, by: list[str], item: str, lg_k: int = 12) -> DataFrame:
    """The engine's own sketch for comparison: (by..., ``cardinality``) BIGINT."""
    return df.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(item), F.lit(lg_k))).alias("cardinality"))
