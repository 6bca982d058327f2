"""Local differential privacy: Laplace noise, randomized response, RAPPOR reports, budgets and debiased totals.

Noise is a keyed function of the row: SHA-256 of (seed, purpose, row id) read as
a number in (0, 1). A task that runs again after a lost executor therefore gives
the same reports, while without the seed the noise can't be told. The seed must
be secret and the row id unique, or reports share their noise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstat.functions.hashing import hash_pair

#: Bits of a RAPPOR report and hashes of its filter.
RAPPOR_BITS, RAPPOR_HASHES = 64, 3
_HEX = 13


def _digest(seed: int | str, purpose: str, row: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), row.cast("string")), 256)


def uniform(seed: int | str, purpose: str, row: Column) -> Column:
    """A number in (0, 1) for each row id: the middle of one of 2**52 equal parts. A null id gives that of an empty one."""
    n = F.conv(F.substring(_digest(seed, purpose, F.coalesce(row.cast("string"), F.lit(""))), 1, _HEX), 16, 10).cast("double")
    return (n + 0.5) / F.lit(float(16**_HEX))


def laplace_scale(sensitivity: float, epsilon: float) -> float:
    return sensitivity / epsilon


def laplace(value: Column, row: Column, *, seed: int | str, sensitivity: float = 1.0, epsilon: float = 1.0) -> Column:
    """``value`` plus Laplace noise of scale sensitivity / epsilon; null stays null."""
    u = uniform(seed, "laplace", row) - 0.5
    return value - F.signum(u) * F.lit(laplace_scale(sensitivity, epsilon)) * F.ln(1 - 2 * F.abs(u))


def laplace_int(value: Column, row: Column, **noise) -> Column:
    """``laplace`` rounded to a whole number, halves away from zero."""
    return F.round(laplace(value.cast("double"), row, **noise)).cast("long")


def truth_probability(epsilon: float, *, calibrated: bool = False) -> float:
    """Probability of a true answer. The lie is a fair coin, so the plain form e^x / (1 + e^x) protects less than ``epsilon`` says; ``calibrated`` (e^x - 1) / (e^x + 1) protects as stated."""
    e = math.exp(epsilon)
    return (e - 1) / (e + 1) if calibrated else e / (1 + e)


def effective_epsilon(p: float) -> float:
    """What a truth probability ``p`` with a fair coin for the rest protects: ln((1 + p) / (1 - p))."""
    return math.inf if p >= 1 else math.log((1 + p) / (1 - p))


def randomized_response(truth: Column, row: Column, *, seed: int | str, p: float) -> Column:
    """The truth with probability ``p`` (cut to [0.5, 1]), a fair coin otherwise; null stays null."""
    p = min(1.0, max(0.5, p))
    answer = F.when(uniform(seed, "tell", row) < p, truth).otherwise(uniform(seed, "coin", row) < 0.5)
    return F.when(truth.isNotNull(), answer)


def estimate_proportion(p: float, n: Column, yes: Column) -> Column:
    """True share of yes from ``yes`` answers of ``n``, cut to [0, 1]; 0 for no answers."""
    share = F.try_divide(yes.cast("double"), n.cast("double"))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - 0.5 + 0.5 * p) / p)), F.lit(0.0))


def rappor_filter(value: Column) -> Column:
    """The bits (0-63) that a BIGINT value sets, as ARRAY<INT> of ``RAPPOR_HASHES`` entries: hashes of the value with 0, 1, 2 in the upper half."""
    return F.array(*[hash_pair(value, F.lit(i).cast("long")).bitwiseAND(F.lit(RAPPOR_BITS - 1).cast("long")).cast("int") for i in range(RAPPOR_HASHES)])


def rappor(value: Column, row: Column, *, seed: int | str, f: float = 0.5, p: float = 0.75, q: float = 0.25) -> Column:
    """A 64-bit report as ARRAY<TINYINT>; null for a null value.

    Each bit of the filter is replaced with a fair coin with probability ``f``
    (cut to [0, 0.5]); then a 1 is reported as 1 with probability ``p``, a 0 with
    ``q``. Probabilities are kept to 1/65,536. The first step is drawn by the
    value as well, so a row's repeated reports of one value share it.
    """
    f, p, q = min(0.5, max(0.0, f)), min(1.0, max(0.0, p)), min(1.0, max(0.0, q))
    held = rappor_filter(value)

    def drawn(purpose: str, by: Column) -> Column:
        return F.concat(*[_digest(seed, f"{purpose}{k}", by) for k in range(RAPPOR_BITS // 16)])

    def part(digits: Column, i: Column) -> Column:
        return F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("int")

    lasting = F.concat_ws(":", row.cast("string"), value.cast("string"))
    draws = F.struct(held.alias("b"), drawn("flip", lasting).alias("flip"), drawn("coin", lasting).alias("coin"), drawn("tell", row.cast("string")).alias("tell"))

    def bits(d: Column) -> Column:
        def one(i: Column) -> Column:
            true = F.array_contains(d["b"], i)
            kept = F.when(part(d["flip"], i) < int(f * 65536), part(d["coin"], i) < 32768).otherwise(true)
            return (part(d["tell"], i) < F.when(kept, int(p * 65536)).otherwise(int(q * 65536))).cast("tinyint")

        return F.transform(F.sequence(F.lit(0), F.lit(RAPPOR_BITS - 1)), one)

    # one draw a row: the struct is bound once, however often the bits read it
    return F.when(value.isNotNull(), F.transform(F.array(draws), bits)[0])


def rappor_counts(reports: DataFrame, by: list[str], report: str, *, f: float = 0.5, p: float = 0.75, q: float = 0.25) -> DataFrame:
    """(by..., ``bit``, ``n``, ``ones``, ``estimate``): how many filters truly have each bit, without bias. Only sums of bits are shuffled."""
    sums = reports.where(F.col(report).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(report)[i].cast("long")).alias(f"_rs_{i}") for i in range(RAPPOR_BITS)])
    long = sums.select(*by, "n", F.posexplode(F.array(*[f"_rs_{i}" for i in range(RAPPOR_BITS)])).alias("bit", "ones"))
    low, high = f / 2 * p + (1 - f / 2) * q, (1 - f / 2) * p + f / 2 * q
    return long.select(*by, "bit", "n", "ones", ((F.col("ones") - F.col("n") * F.lit(low)) / F.lit(high - low)).alias("estimate"))


def rappor_decode(counts: DataFrame, by: list[str], candidates: DataFrame, value: str) -> DataFrame:
    """(by..., value, ``estimate``) of the candidate values: the least estimate of a value's bits. An upper estimate, as values share bits."""
    bits = candidates.select(value).dropna().dropDuplicates().select(value, F.explode(F.array_distinct(rappor_filter(F.col(value)))).alias("bit"))
    # counts have 64 rows a group
    return bits.join(F.broadcast(counts) if not by else counts, "bit").groupBy(*by, value).agg(F.min("estimate").alias("estimate"))


def private_aggregate(reports: DataFrame, by: list[str], noisy: str, scale: float) -> DataFrame:
    """(by..., ``count``, ``estimate_sum``, ``estimate_mean``, ``standard_error``) of reports with Laplace noise of ``scale``. The standard error of the mean, from the noise alone, is scale sqrt(2 / n); without reports +Infinity."""
    n = F.count(F.col(noisy))
    return reports.groupBy(*by).agg(
        n.alias("count"), F.coalesce(F.sum(noisy), F.lit(0.0)).alias("estimate_sum"), F.coalesce(F.avg(noisy), F.lit(0.0)).alias("estimate_mean"),
        F.when(n > 0, F.lit(scale * math.sqrt(2)) / F.sqrt(F.when(n > 0, n))).otherwise(float("inf")).alias("standard_error"),
    )


def budget(requests: DataFrame, *, key: str, order: str, epsilon: str, limit: float) -> DataFrame:
    """Adds ``accepted``, ``spent`` and ``remaining`` (after the row) to the requests of each key, in order.

    A request is granted if it still fits; a refused one costs nothing, so a
    later, smaller one may fit again. This is a fold in order: the rows of a key
    stream, sorted, through one task, which holds one state only. Null amounts
    are refused. ``order`` must be total within a key.
    """
    import pandas as pd
    from pyspark.sql import types as T

    made = ["accepted", "spent", "remaining"]
    out = T.StructType([f for f in requests.schema.fields if f.name not in made] + [T.StructField("accepted", T.BooleanType()), T.StructField("spent", T.DoubleType()), T.StructField("remaining", T.DoubleType())])
    kept = [f.name for f in out.fields[:-3]]

    def fold(parts):
        now, spent = object(), 0.0
        for g in parts:
            rows = []
            for k, e in zip(g[key], g[epsilon]):
                k = None if pd.isna(k) else k
                if k != now or now.__class__ is object:
                    now, spent = k, 0.0
                ok = not pd.isna(e) and spent + e <= limit
                spent = spent + e if ok else spent
                rows.append((ok, spent, max(0.0, limit - spent)))
            yield g[kept].assign(**{c: [r[i] for r in rows] for i, c in enumerate(made)})

    return requests.repartition(key).sortWithinPartitions(key, order).mapInPandas(fold, out)


def budget_summary(ledger: DataFrame, key: str, limit: float) -> DataFrame:
    """(key, ``query_count``, ``spent``, ``remaining``, ``exhausted``) of the rows of ``budget``."""
    spent = F.coalesce(F.max("spent"), F.lit(0.0))
    return ledger.groupBy(key).agg(F.sum(F.col("accepted").cast("long")).alias("query_count"), spent.alias("spent"), F.greatest(F.lit(0.0), F.lit(limit) - spent).alias("remaining"), (spent >= limit).alias("exhausted"))
