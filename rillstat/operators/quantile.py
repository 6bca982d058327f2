"""Quantiles by logarithmic bins of relative width (DDSketch).

A value v > 0 goes to bin ceil(ln v / ln g) + bins/4, g = (1 + a) / (1 - a).
Bins below 0 count in bin 0; those from ``bins`` on are dropped from the bins but
still count in number, sum and extremes, and ranks beyond the bins give the
maximum. Negative values have bins of their own, by magnitude; zero is a bin.

A sketch is relational: rows (by..., ``part``, ``slot``, ``n``, ``sum``, ``min``,
``max``) where ``slot`` is 0 for zero, bin + 1 for positive and -(bin + 1) for
negative values. ``part`` is 'bin', 'dropped' (beyond the bins, slot null) or
'bad' (NaN and infinite: counted, otherwise ignored). Building and merging are
aggregations with map-side combine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstat.functions.events import is_finite


def gamma(a: float) -> float:
    return (1 + a) / (1 - a)


def slot_of(v: Column, a: float, bins: int) -> Column:
    """Slot of a finite value; null where the bins don't reach. Accuracy at bin edges is that of one rounding of the logarithm."""
    b = F.greatest(F.lit(0).cast("long"), F.ceil(F.ln(F.abs(v)) * F.lit(1 / math.log(gamma(a)))) + F.lit(bins // 4)) + 1
    return F.when(v == 0, F.lit(0).cast("long")).when(b <= bins, F.when(v > 0, b).otherwise(-b)).cast("int")


def dd_build(df: DataFrame, by: list[str], value: str, a: float = 0.01, bins: int = 2048) -> DataFrame:
    """Sketch rows of the non-null values of each group."""
    if not 0 < a < 1 or bins < 4:
        raise ValueError("a must lie between 0 and 1, bins be at least 4")
    v, ok = F.col(value), is_finite(F.col(value))
    rows = df.where(v.isNotNull()).select(*by, F.when(ok, v).alias("_rs_v"), F.when(ok, slot_of(F.when(ok, v), a, bins)).alias("slot"), ok.alias("_rs_ok"))
    part = F.when(~F.col("_rs_ok"), "bad").when(F.col("slot").isNull(), "dropped").otherwise("bin")
    return rows.groupBy(*by, part.alias("part"), "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("_rs_v").alias("sum"), F.min("_rs_v").alias("min"), F.max("_rs_v").alias("max"))


def dd_merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Union of all sketch rows of each group. Sketches of other accuracy or size must not be mixed."""
    return sketches.groupBy(*by, "part", "slot").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))


def dd_stats(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by..., ``count``, ``sum``, ``mean``, ``min``, ``max``, ``dropped``, ``non_finite``) of (merged) sketch rows.

    An empty sketch has count 0, sum 0, mean 0, least +Infinity, greatest -Infinity.
    """
    good, n = F.col("part") != "bad", F.col("n")
    out = sketch.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(good, n)), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(good, F.col("sum"))), F.lit(0.0)).alias("sum"),
        F.coalesce(F.min(F.when(good, F.col("min"))), F.lit(float("inf"))).alias("min"),
        F.coalesce(F.max(F.when(good, F.col("max"))), F.lit(float("-inf"))).alias("max"),
        F.coalesce(F.sum(F.when(F.col("part") == "dropped", n)), F.lit(0)).alias("dropped"),
        F.coalesce(F.sum(F.when(~good, n)), F.lit(0)).alias("non_finite"),
    )
    return out.select(*by, "count", "sum", F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(0.0).alias("mean"), "min", "max", "dropped", "non_finite")


def dd_quantiles(sketch: DataFrame, by: list[str], quantiles: list[float], a: float = 0.01, bins: int = 2048, *, middle: bool = False, first_rank: int = 1) -> DataFrame:
    """(by..., ``q``, ``estimate``) of (merged) sketch rows.

    The estimate is the lower bound of the bin that holds rank ceil(q n): at most
    2a / (1 + a) below the true value for positive values in range; with
    ``middle`` it is the bin's relative middle, within ``a``. Ranks beyond the
    bins give the maximum. ``first_rank`` 0 lets q = 0 answer the magnitude of
    the outermost negative bin whatever the data, as the plain scan does. A
    group without finite values gives 0.
    """
    g, off = gamma(a), bins // 4
    counted = F.when(F.col("part") == "bin", F.col("n")).otherwise(0)
    finite = F.when(F.col("part") != "bad", F.col("n")).otherwise(0)
    group = Window.partitionBy(*by)
    order = F.col("slot").asc_nulls_last()
    run = (
        sketch.withColumn("_rs_total", F.sum(finite).over(group))
        .withColumn("_rs_max", F.max("max").over(group))
        .withColumn("_rs_to", F.sum(counted).over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_rs_n", counted)
    )
    run = run.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    rank = F.greatest(F.lit(first_rank), F.ceil(F.col("q") * F.col("_rs_total")))
    size = F.pow(F.lit(g), (F.abs("slot") - 2 - off + (1 if middle else 0)).cast("double")) * F.lit(2 / (g + 1) if middle else 1.0)
    value = F.when(F.col("slot") == 0, 0.0).when(F.col("slot") > 0, size).otherwise(-size)
    hit = (F.col("_rs_n") > 0) & (F.col("_rs_to") >= rank)
    out = run.groupBy(*by, "q").agg(F.min_by(value, F.when(hit, F.col("slot"))).alias("_rs_e"), F.max("_rs_max").alias("_rs_max"), F.max("_rs_total").alias("_rs_total"))
    outermost = F.lit(-(g ** (bins - 2 - off)))
    estimate = F.when(F.col("_rs_total") == 0, 0.0)
    if first_rank == 0:
        estimate = estimate.when(F.col("q") == 0, outermost)
    return out.select(*by, "q", estimate.otherwise(F.coalesce("_rs_e", "_rs_max")).alias("estimate"))
