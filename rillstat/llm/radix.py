"""Exact and bounded percentiles by radix selection.

A finite DOUBLE maps to a BIGINT of the same order. The integers are taken digit
by digit from the top: a histogram of the first digit per group says which digit
holds each target rank; only rows with that digit go on to the next one. After
``d`` bits a percentile is known within the values that share those bits; after
all 64 it is exact.

Histograms are rows (group, digit, count), built with map-side combine; those of
partitions, days or windows are united by adding counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstat.session import ensure_checkpoint_dir

#: Bits of each pass of an exact selection: no histogram has more than 65,536 rows a group.
DIGITS = (16, 16, 16, 16)
#: Bits of a stored histogram: sign, exponent and 7 bits of the mantissa, so values within 0.8 % share a digit.
SKETCH_BITS = 19
_TWO52 = 2.0**52


def ordered_key(v: Column) -> Column:
    """BIGINT of the same order as the finite double ``v``: its bit pattern, negated below zero; -0.0 equals 0.0.

    Made of built-in arithmetic (scaling by powers of two is exact), so it stays
    in generated code. Non-finite values must be left out before; a null gives 0,
    so that the result is never null and no test for it is copied into a scan.
    """
    a = F.abs(v)
    guess = F.floor(F.log2(a)).cast("int")
    m = a / F.pow(F.lit(2.0), guess)
    e = F.when(m >= 2, guess + 1).when(m < 1, guess - 1).otherwise(guess)
    normal = (e.cast("long") + 1023) * F.lit(2**52).cast("long") + ((a / F.pow(F.lit(2.0), e) - 1) * _TWO52).cast("long")
    tiny = (a * 2.0**537 * 2.0**537).cast("long")
    bits = F.when(a < 2.0**-1022, tiny).otherwise(normal)
    return F.coalesce(F.when(v < 0, -bits).otherwise(bits), F.lit(0).cast("long"))


def key_value(k: Column) -> Column:
    """The double of a key of ``ordered_key``."""
    b = F.abs(k)
    e = F.shiftright(b, 52)
    m = b.bitwiseAND(F.lit(2**52 - 1).cast("long")).cast("double")
    v = F.when(e == 0, m * 2.0**-537 * 2.0**-537).otherwise((m / _TWO52 + 1) * F.pow(F.lit(2.0), (e - 1023).cast("double")))
    return F.when(k < 0, -v).otherwise(v)


def digit(key: Column, offset: int, bits: int) -> Column:
    """Bits ``offset`` to ``offset + bits`` of a key, counted from the top of its unsigned form."""
    unsigned = key.bitwiseXOR(F.lit(-(2**63)).cast("long"))
    return F.shiftrightunsigned(F.shiftleft(unsigned, offset), 64 - bits)


def first_key(prefix: Column, bits: int) -> Column:
    """The least key whose top ``bits`` are ``prefix``."""
    return F.shiftleft(prefix, 64 - bits).bitwiseXOR(F.lit(-(2**63)).cast("long"))


def histogram(keys: DataFrame, by: list[str], key: str = "key", bits: int = SKETCH_BITS) -> DataFrame:
    """Mergeable partial result: (by..., ``digit``, ``n``), counts of the top ``bits`` of the keys."""
    return keys.groupBy(*by, digit(F.col(key), 0, bits).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


def merge(histograms: DataFrame, by: list[str]) -> DataFrame:
    """Union of histograms of equal bits: counts are added."""
    return histograms.groupBy(*by, "digit").agg(F.sum("n").alias("n"))


def _ranked(hist: DataFrame, by: list[str], quantiles: list[int]) -> DataFrame:
    """(by..., q, digit, rank in the digit, n of the group). q is in hundredths of a percent; the rank is ceil(q n / 10000), at least 1."""
    total = F.sum("n").over(Window.partitionBy(*by))
    wide = hist.withColumn("_rs_n", total).withColumn("_rs_to", F.sum("n").over(Window.partitionBy(*by).orderBy("digit")))
    wide = wide.withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantiles])))
    rank = F.greatest(F.lit(1).cast("long"), F.expr("(_rs_n * q + 9999) div 10000"))
    hit = wide.withColumn("_rs_rank", rank).where((F.col("_rs_rank") <= F.col("_rs_to")) & (F.col("_rs_rank") > F.col("_rs_to") - F.col("n")))
    return hit.select(*by, "q", "digit", (F.col("_rs_rank") - F.col("_rs_to") + F.col("n")).alias("_rs_rank"), "_rs_n")


def bounded(hist: DataFrame, by: list[str], quantiles: list[int], bits: int = SKETCH_BITS) -> DataFrame:
    """Percentiles from (merged) histograms: (by..., q, ``n``, ``lower``, ``upper``); the true value lies in [lower, upper].

    Above 2**-1022 in magnitude the bounds are within 2**-(bits - 12) of each other in relative terms.
    """
    at = _ranked(hist, by, quantiles)
    lo = key_value(first_key(F.col("digit"), bits))
    hi = key_value(first_key(F.col("digit"), bits) + F.lit(2 ** (64 - bits) - 1).cast("long"))
    return at.select(*by, "q", F.col("_rs_n").alias("n"), lo.alias("lower"), hi.alias("upper"))


def select_exact(keys: DataFrame, by: list[str], quantiles: list[int], key: str = "key") -> DataFrame:
    """Exact percentiles: (by..., q, ``n``, ``value``), the smallest value that at least q of a group's values don't exceed.

    ``quantiles`` in hundredths of a percent (9900 is p99). ``by`` columns must
    not be null; ``key`` is that of ``ordered_key``. The rows of the digits that
    hold a target are written once to the checkpoint folder (typically a few
    percent of all rows); the later passes read only these.
    """
    ensure_checkpoint_dir(keys.sparkSession)
    # one pass for the digits, a second for their rows; the few target rows are cut off in between
    found = _ranked(histogram(keys, by, key, DIGITS[0]), by, quantiles).withColumnRenamed("digit", "_rs_prefix").checkpoint()
    # keys that several quantiles follow are held once: the digits are matched, not the quantiles
    wanted = found.select(*by, F.col("_rs_prefix").alias("digit")).dropDuplicates()
    rest = keys.select(*by, F.col(key).alias("_rs_key")).withColumn("digit", digit(F.col("_rs_key"), 0, DIGITS[0])).join(wanted, [*by, "digit"], "left_semi")
    rest = rest.groupBy(*by, "_rs_key").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    done = DIGITS[0]
    for bits in DIGITS[1:]:
        group = [*by, "_rs_prefix"]
        rows = rest.withColumn("_rs_prefix", digit(F.col("_rs_key"), 0, done)).withColumn("digit", digit(F.col("_rs_key"), done, bits))
        hist = rows.groupBy(*group, "digit").agg(F.sum("n").alias("n"))
        run = hist.withColumn("_rs_to", F.sum("n").over(Window.partitionBy(*group).orderBy("digit")))
        met = found.join(run, group).where((F.col("_rs_rank") <= F.col("_rs_to")) & (F.col("_rs_rank") > F.col("_rs_to") - F.col("n")))
        prefix = F.shiftleft(F.col("_rs_prefix"), bits).bitwiseOR(F.col("digit"))
        found = met.select(*by, "q", prefix.alias("_rs_prefix"), (F.col("_rs_rank") - F.col("_rs_to") + F.col("n")).alias("_rs_rank"), "_rs_n")
        done += bits
    return found.select(*by, "q", F.col("_rs_n").alias("n"), key_value(first_key(F.col("_rs_prefix"), 64)).alias("value"))
