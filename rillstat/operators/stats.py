"""Statistics per group: ranks, quantiles, quartiles, moments, covariance and correlation.

All are plain aggregations with map-side combine. Null values are left out, null
group values are groups of their own. Values must be finite, except in
``percentile_rank``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstat.functions.events import is_finite
from rillstat.operators.quantile import slot_of

EPSILON = 2.220446049250313e-16
_SUB = 4096


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def percentile_rank(df: DataFrame, by: list[str], value: str, at: float) -> DataFrame:
    """(by..., ``percentile_rank``) of ``at``: the share of lesser values plus half of the equal ones, in percent. No values: 0 without ``by``, no row otherwise."""
    v = F.col(value)
    share = F.when(F.abs(v - F.lit(float(at))) < EPSILON, 0.5).when(v < at, 1.0).otherwise(0.0)
    out = df.where(v.isNotNull()).groupBy(*by).agg(F.sum(share).alias("_rs_s"), F.count(F.lit(1)).alias("_rs_n"))
    return out.select(*by, F.when(F.col("_rs_n") > 0, F.col("_rs_s") / F.col("_rs_n") * 100).otherwise(0.0).alias("percentile_rank"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """(by..., ``q``, ``n``, ``value``): linear interpolation at q (n - 1) in the sorted finite values; q is cut to [0, 1].

    No group is ever held whole. Two counting passes say in which logarithmic
    bin, and in which of 4,096 equal parts of it, each wanted rank lies; only
    these values are put in order, as (value, count).
    """
    v = F.col(value)
    rows = df.where(is_finite(v)).select(*[F.col(c).alias(f"_rs_g{i}") for i, c in enumerate(by)], F.when(v == 0, 0.0).otherwise(v).alias("_rs_v"))
    g = [f"_rs_g{i}" for i in range(len(by))]
    rows = rows.withColumn("_rs_slot", F.coalesce(slot_of(F.col("_rs_v"), 0.01, 1 << 20), F.lit(0)))
    hist = rows.groupBy(*g, "_rs_slot").agg(F.count(F.lit(1)).alias("_rs_c"), F.min("_rs_v").alias("_rs_lo"), F.max("_rs_v").alias("_rs_hi"))
    w = Window.partitionBy(*g)
    run = hist.withColumn("_rs_n", F.sum("_rs_c").over(w)).withColumn("_rs_to", F.sum("_rs_c").over(w.orderBy("_rs_slot")))
    qs = [min(1.0, max(0.0, float(q))) for q in quantiles]
    asked = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(x).alias("p"), F.lit(s).alias("side")) for q, x in zip(quantiles, qs) for s in (0, 1)]))
    place = F.col("_rs_a.p") * (F.col("_rs_n") - 1)
    rank = F.least(F.floor(place) + F.col("_rs_a.side"), F.col("_rs_n") - 1) + 1
    hit = run.withColumn("_rs_a", asked).withColumn("_rs_rank", rank).where((F.col("_rs_rank") <= F.col("_rs_to")) & (F.col("_rs_rank") > F.col("_rs_to") - F.col("_rs_c")))
    want = hit.select(*g, "_rs_slot", "_rs_lo", "_rs_hi", "_rs_n", F.col("_rs_a.q").alias("q"), F.col("_rs_a.side").alias("_rs_side"), (place - F.floor(place)).alias("_rs_part"), (F.col("_rs_rank") - F.col("_rs_to") + F.col("_rs_c")).alias("_rs_rank"))
    spans = want.groupBy(*g, "_rs_slot").agg(F.first("_rs_lo").alias("_rs_lo"), F.first("_rs_hi").alias("_rs_hi"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*g, "_rs_slot"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    width = (F.col("r._rs_hi") - F.col("r._rs_lo")) / _SUB
    sub = F.when(width > 0, F.least(F.lit(_SUB - 1), F.floor((F.col("l._rs_v") - F.col("r._rs_lo")) / width))).otherwise(0)
    kept = rows.alias("l").join(spans.alias("r"), on).select(*[F.col(f"l.{c}").alias(c) for c in [*g, "_rs_slot", "_rs_v"]], sub.alias("_rs_sub"))
    values = kept.groupBy(*g, "_rs_slot", "_rs_sub", "_rs_v").agg(F.count(F.lit(1)).alias("_rs_c"))
    sums = values.groupBy(*g, "_rs_slot", "_rs_sub").agg(F.sum("_rs_c").alias("_rs_s"))
    ahead = sums.withColumn("_rs_from", F.sum("_rs_s").over(Window.partitionBy(*g, "_rs_slot").orderBy("_rs_sub")) - F.col("_rs_s"))
    to = F.sum("_rs_c").over(Window.partitionBy(*g, "_rs_slot", "_rs_sub").orderBy("_rs_v"))
    within = values.withColumn("_rs_in", to)
    cells = _null_safe(want, ahead, [*g, "_rs_slot"]).where((F.col("_rs_rank") > F.col("_rs_from")) & (F.col("_rs_rank") <= F.col("_rs_from") + F.col("_rs_s")))
    found = _null_safe(cells.drop("_rs_s"), within, [*g, "_rs_slot", "_rs_sub"])
    found = found.where((F.col("_rs_rank") <= F.col("_rs_from") + F.col("_rs_in")) & (F.col("_rs_rank") > F.col("_rs_from") + F.col("_rs_in") - F.col("_rs_c")))
    ends = found.groupBy(*g, "q").agg(F.max("_rs_n").alias("n"), F.max("_rs_part").alias("_rs_part"), F.max(F.when(F.col("_rs_side") == 0, F.col("_rs_v"))).alias("_rs_0"), F.max(F.when(F.col("_rs_side") == 1, F.col("_rs_v"))).alias("_rs_1"))
    return ends.select(*[F.col(c).alias(n) for c, n in zip(g, by)], "q", "n", (F.col("_rs_0") + F.col("_rs_part") * (F.col("_rs_1") - F.col("_rs_0"))).alias("value"))


def _null_safe(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns of equal name, where null equals null; columns of ``a``, then those only ``b`` has."""
    cond = None
    for c in on:
        one = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        cond = one if cond is None else cond & one
    more = [F.col(f"r.{c}") for c in b.columns if c not in a.columns]
    return a.alias("l").join(b.alias("r"), cond).select("l.*", *more)


def quantile_linear(df: DataFrame, by: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """(by..., ``q``, ``value``), exact, by linear interpolation."""
    return exact_quantiles(df, by, value, quantiles).drop("n")


def iqr(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., ``q1``, ``median``, ``q3``, ``iqr``, ``lower_fence``, ``upper_fence``); groups of fewer than 4 finite values give nulls."""
    long = exact_quantiles(df, by, value, [0.25, 0.5, 0.75])
    out = long.groupBy(*by).agg(*[F.max(F.when((F.col("q") == q) & (F.col("n") >= 4), F.col("value"))).alias(c) for q, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    width = F.col("q3") - F.col("q1")
    return out.select(*by, "q1", "median", "q3", width.alias("iqr"), (F.col("q1") - 1.5 * width).alias("lower_fence"), (F.col("q3") + 1.5 * width).alias("upper_fence"))


def covariance_matrix(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., ``row``, ``col``, ``covariance``, ``correlation``, ``count``) for every ordered pair of ``columns``.

    Sample covariance, 0 for fewer than two rows. The correlation is 1 on the
    diagonal, 0 where a variance vanishes, and never beyond 1. Rows with a null
    in any of the columns are left out. One aggregation yields all pairs.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    agg = df.dropna(subset=columns).groupBy(*by).agg(F.count(F.lit(1)).alias("_rs_n"), *[_or0(F.covar_samp(columns[i], columns[j])).alias(f"_rs_{i}_{j}") for i, j in pairs])

    def cov(i: int, j: int) -> Column:
        return F.col(f"_rs_{min(i, j)}_{max(i, j)}")

    def corr(i: int, j: int) -> Column:
        if i == j:
            return F.lit(1.0)
        both = F.sqrt(cov(i, i) * cov(j, j))
        return F.when(both < EPSILON, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov(i, j), both))))

    n = len(columns)
    cells = [F.struct(F.lit(columns[i]).alias("row"), F.lit(columns[j]).alias("col"), cov(i, j).alias("covariance"), corr(i, j).alias("correlation")) for i in range(n) for j in range(n)]
    return agg.select(*by, F.col("_rs_n").alias("count"), F.explode(F.array(*cells)).alias("_rs_c")).select(*by, "_rs_c.*", "count")


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., ``count``, ``mean``, ``variance``, ``sample_variance``, ``std_dev``, ``skewness``, ``kurtosis``, ``min``, ``max``).

    Population moments; kurtosis is the excess. Undefined ones are 0: variances
    below 2 values, skewness below 3, kurtosis below 4 or without variance.
    Without values (and ``by``) the least is +Infinity, the greatest -Infinity.
    """
    v = F.col(value)
    n = F.count(v)
    return df.where(v.isNotNull()).groupBy(*by).agg(
        n.alias("count"),
        _or0(F.avg(v)).alias("mean"),
        F.when(n < 2, 0.0).otherwise(_or0(F.var_pop(v))).alias("variance"),
        F.when(n < 2, 0.0).otherwise(_or0(F.var_samp(v))).alias("sample_variance"),
        F.when(n < 2, 0.0).otherwise(_or0(F.stddev_pop(v))).alias("std_dev"),
        F.when(n < 3, 0.0).otherwise(_or0(F.skewness(v))).alias("skewness"),
        F.when(n < 4, 0.0).otherwise(_or0(F.kurtosis(v))).alias("kurtosis"),
        F.coalesce(F.min(v), F.lit(float("inf"))).alias("min"),
        F.coalesce(F.max(v), F.lit(float("-inf"))).alias("max"),
    )


def linear_regression(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by..., ``count``, ``slope``, ``intercept``, ``r_squared``) of least squares.

    Without spread in x the slope is 0 and the intercept the mean of y; r squared
    is 0 without spread in x or y. Pairs with a null are left out.
    """
    xx, yy = F.col(x), F.col(y)
    agg = df.dropna(subset=[x, y]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg(xx).alias("_rs_mx"), F.avg(yy).alias("_rs_my"), F.var_pop(xx).alias("_rs_vx"), F.var_pop(yy).alias("_rs_vy"), F.covar_pop(xx, yy).alias("_rs_c")
    )
    n = F.col("count")
    flat_x = (n < 2) | (F.col("_rs_vx") * n < EPSILON)
    flat_y = F.col("_rs_vy") * n < EPSILON
    slope = F.when(flat_x, 0.0).otherwise(F.try_divide(F.col("_rs_c"), F.col("_rs_vx")))
    r2 = F.when(flat_x | flat_y, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("_rs_c") * F.col("_rs_c"), F.col("_rs_vx") * F.col("_rs_vy")))))
    return agg.select(*by, "count", _or0(slope).alias("slope"), _or0(F.col("_rs_my") - slope * F.col("_rs_mx")).alias("intercept"), _or0(r2).alias("r_squared"))


def predict(model: DataFrame, x: float | Column) -> Column:
    """The value of a row of ``linear_regression`` at ``x``."""
    return model["slope"] * (F.lit(float(x)) if isinstance(x, (int, float)) else x) + model["intercept"]
