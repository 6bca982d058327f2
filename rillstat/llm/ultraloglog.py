"""Distinct counts by registers of a maximum rank and two indicator bits (UltraLogLog).

Published method: O. Ertl, "UltraLogLog: A Practical and More Space-Efficient
Alternative to HyperLogLog for Approximate Distinct Counting" (2023).

A 64-bit hash gives a register (its low ``p`` bits) and a rank (position of the
lowest set bit of the rest, from 1). A register holds the greatest rank ``u``
and whether ranks ``u-1`` and ``u-2`` occurred: ``4 u + 2 b1 + b2``, one byte.
Registers unite without loss: unpack to bits, OR, pack. The count is the maximum
of the likelihood of all registers; its standard error is about
``0.761 / sqrt(2**p)`` (p = 14: 0.6 %), small sets are nearly exact.

Sketches are relational and sparse, one row per register in use, so building,
storing and uniting them are plain aggregations with map-side combine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = 14


def standard_error(p: int = P) -> float:
    """Relative standard error of an estimate by ``2**p`` registers."""
    return 0.7608 / math.sqrt(2**p)


def registers_of(identifier: Column, p: int = P) -> tuple[Column, Column]:
    """(register, rank) of an identifier. Ranks are 1 to 65 - p."""
    h = F.xxhash64(identifier)
    rest = F.shiftrightunsigned(h, p).bitwiseOR(F.lit(1 << (64 - p)).cast("long"))
    trailing = F.bit_count(rest.bitwiseAND(-rest) - F.lit(1).cast("long"))
    return h.bitwiseAND(F.lit((1 << p) - 1).cast("long")).cast("int"), (trailing + 1).cast("int")


def _packed(u: Column, bits: Column) -> Column:
    """One byte (in a SMALLINT) of a greatest rank and the bits ``1 << (rank + 1)`` of all ranks seen."""
    return (u * 4 + F.call_function("shiftright", bits, u - 1).bitwiseAND(F.lit(3).cast("long"))).cast("smallint")


def _unpacked(reg: Column) -> tuple[Column, Column]:
    """(greatest rank, bits) of a packed register."""
    u = F.shiftright(reg.cast("int"), 2)
    bits = F.call_function("shiftleft", reg.cast("long").bitwiseAND(F.lit(3).cast("long")).bitwiseOR(F.lit(4).cast("long")), u - 1)
    return u, bits


def build(df: DataFrame, by: list[str], identifier: str, p: int = P) -> DataFrame:
    """Sketch rows (by..., ``idx``, ``reg``) of the distinct non-null identifiers of each group. Null group values are groups."""
    idx, rank = registers_of(F.col(identifier), p)
    seen = df.where(F.col(identifier).isNotNull()).select(*by, idx.alias("idx"), rank.alias("_rs_rank"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_rs_rank") + 1)
    out = seen.groupBy(*by, "idx").agg(F.max("_rs_rank").alias("_rs_u"), F.bit_or(one).alias("_rs_x"))
    return out.select(*by, "idx", _packed(F.col("_rs_u"), F.col("_rs_x")).alias("reg"))


def unite(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Union of all sketch rows of each group, without loss."""
    u, x = _unpacked(F.col("reg"))
    out = sketches.select(*by, "idx", u.alias("_rs_u"), x.alias("_rs_b")).groupBy(*by, "idx").agg(F.max("_rs_u").alias("_rs_u"), F.bit_or("_rs_b").alias("_rs_x"))
    return out.select(*by, "idx", _packed(F.col("_rs_u"), F.col("_rs_x")).alias("reg"))


def likelihood_estimate(regs: np.ndarray, counts: np.ndarray, p: int = P) -> float:
    """Number of distinct identifiers whose likelihood is greatest, given how many registers hold each value.

    Registers are taken as independent Poisson counts of rate x = n / 2**p; the
    log-likelihood is -a x + sum_k b_k log(1 - exp(-x r_k)), r_k the probability
    of rank k. It is concave with one root of its slope, found by bisection on
    a logarithmic scale.
    """
    m, top = 2**p, 65 - p
    used = int(counts.sum())
    if used == 0:
        return 0.0
    prob = np.array([0.0] + [2.0**-k for k in range(1, top)] + [2.0 ** -(top - 1)])
    above = np.array([1.0] + [2.0**-k for k in range(1, top)] + [0.0])  # of all ranks greater than k
    a = float(m - used)
    b = np.zeros(top + 1)
    for reg, c in zip(regs.astype(int).tolist(), counts.astype(float).tolist()):
        u = reg >> 2
        a += c * above[u]
        b[u] += c
        for k, bit in ((u - 1, reg & 2), (u - 2, reg & 1)):
            if k >= 1:
                if bit:
                    b[k] += c
                else:
                    a += c * prob[k]
    ks = np.nonzero(b)[0]
    r, w = prob[ks], b[ks]
    if a <= 0:
        return math.inf

    def slope(x: float) -> float:
        return float((w * r / np.expm1(np.minimum(x * r, 700.0))).sum()) - a

    lo, hi = 1e-12, 1.0
    while slope(hi) > 0:
        lo, hi = hi, hi * 4
    for _ in range(60):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if slope(mid) > 0 else (lo, mid)
    return m * math.sqrt(lo * hi)


def register_counts(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by..., ``reg``, ``n``): how many registers of each group hold each value; all that an estimate needs."""
    return sketches.groupBy(*by, F.col("reg").cast("int").alias("reg")).agg(F.count(F.lit(1)).alias("n"))


def estimate(counts: DataFrame, by: list[str], p: int = P) -> DataFrame:
    """(by..., ``estimate``, ``standard_error``) of each group of ``register_counts``. Groups without registers have no row."""
    # a group has at most 4 * (66 - p) register values, however many identifiers
    held = counts.groupBy(*by, "reg").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.collect_list(F.struct("reg", "n")).alias("_rs_h"))

    @F.pandas_udf("double")
    def ml(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([likelihood_estimate(np.array([x["reg"] for x in h]), np.array([x["n"] for x in h]), p) for h in s], dtype="float64")

    return held.select(*by, ml("_rs_h").alias("estimate")).withColumn("standard_error", F.col("estimate") * F.lit(standard_error(p)))


def unite_registers(rows: np.ndarray) -> np.ndarray:
    """Union of packed registers, one array of registers a row; 0 is an unused register."""
    top = rows.astype(np.uint64) >> np.uint64(2)
    bits = np.where(rows > 0, ((rows.astype(np.uint64) & np.uint64(3)) | np.uint64(4)) << (np.maximum(top, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    x = np.bitwise_or.reduce(bits, axis=0)
    u = np.frexp(x.astype(np.float64))[1] - 2  # bits lie below 2**53, so the double is exact
    packed = u * 4 + ((x >> np.maximum(u - 1, 0).astype(np.uint64)) & np.uint64(3)).astype(np.int64)
    return np.where(x > 0, packed, 0).astype(np.uint8)


def counts_by_scope(df: DataFrame, scopes: DataFrame, wanted: DataFrame, *, day: str, member: str, scope: str, identifier: str, p: int = P, block_bits: int = 10) -> DataFrame:
    """Register counts (day, scope, ``reg``, ``n``) of the wanted (day, scope) pairs, united from the sketches of the scopes' members.

    Members are sketched once per day. Their registers, which no longer grow
    with the events, go to tasks by day and block of register numbers, together
    with the day's wanted scopes; a task lays its block out as one row of bytes
    a member and unites rows for each scope. A task holds at most
    ``2**block_bits`` bytes a member of the day.
    """
    per_member = build(df, [day, member], identifier, p).withColumn("_rs_block", F.shiftright("idx", block_bits))
    pairs = scopes.select(scope, member).dropna().dropDuplicates().join(wanted.select(day, scope).dropna().dropDuplicates(), scope)
    pairs = pairs.select(day, scope, member, F.explode(F.sequence(F.lit(0), F.lit((1 << max(0, p - block_bits)) - 1))).alias("_rs_block"))
    kind = dict(df.dtypes) | dict(scopes.dtypes)

    def unite_block(regs: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(regs) and len(want):
            members, at = np.unique(regs[member].to_numpy(), return_inverse=True)
            table = np.zeros((len(members), 1 << block_bits), np.uint8)
            table[at, regs["idx"].to_numpy() & ((1 << block_bits) - 1)] = regs["reg"].to_numpy()
            known = pd.Series(np.arange(len(members)), index=members)
            want = want.assign(row=known.reindex(want[member].to_numpy()).to_numpy()).dropna(subset=["row"])
            for s, rows in want.groupby(scope)["row"]:
                n = np.bincount(unite_registers(table[rows.to_numpy().astype(int)]), minlength=1)
                out += [(regs[day].iloc[0], s, int(r), int(n[r])) for r in np.nonzero(n)[0] if r]
        return pd.DataFrame(out, columns=[day, scope, "reg", "n"])

    grouped = per_member.groupBy(day, "_rs_block").cogroup(pairs.groupBy(day, "_rs_block"))
    return grouped.applyInPandas(unite_block, f"{day} {kind[day]}, {scope} {kind[scope]}, reg int, n long")
