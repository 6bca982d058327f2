"""Anomaly scores of each row against the rows before it: MAD, EWMA, z-score and their combination.

Every row is judged before it is taken in. Rows come in order of (``ts``,
``order``) within ``key``; rows with a null or NaN value or a null time are left
out. Hot keys are cut into blocks (see ``ordered``).

Verdicts need three earlier rows. Where the scatter vanishes (below 1e-10), any
value off the centre by more than 1e-10 is an anomaly of score +Infinity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstat.operators.ordered import BLOCK, BLOCK_ROWS, OWN, RN, blocks, last_rows, number_rows
from rillstat.operators.series import exponential

WINDOW, LEAST, TINY = 100, 3, 1e-10
#: Makes the median absolute deviation of a normal distribution its standard deviation.
MAD_SCALE = 1.4826
_STEP = 8192


def _sound(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def rolling_median(x: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, median, median absolute deviation) of the up to ``window`` values before each position."""
    n = np.minimum(np.arange(len(x)), window)
    med, mad = np.zeros(len(x)), np.zeros(len(x))
    padded = np.concatenate((np.full(window, np.nan), x))
    views = np.lib.stride_tricks.sliding_window_view(padded, window)[: len(x)]
    for a in range(0, len(x), _STEP):
        k = n[a : a + _STEP]
        at = np.arange(len(k))

        def middle(w: np.ndarray) -> np.ndarray:
            w = np.sort(w, axis=1)  # the padding goes last
            return (w[at, np.maximum(k - 1, 0) // 2] + w[at, np.minimum(k // 2, window - 1)]) / 2

        m = middle(views[a : a + _STEP])
        med[a : a + _STEP] = np.where(k > 0, m, 0.0)
        mad[a : a + _STEP] = np.where(k > 0, middle(np.abs(views[a : a + _STEP] - m[:, None])), 0.0)
    return n, med, mad


def _judged(df: DataFrame, name: str, dev: Column, scatter: Column, seen: Column, k: float, least_for_score: int, *, signed: Column | None = None) -> DataFrame:
    """Adds ``name``_score and ``name``_anomaly from a deviation, its scatter and the number of earlier rows."""
    flat = F.coalesce(scatter, F.lit(0.0)) < TINY
    off = F.coalesce(dev, F.lit(0.0)) > TINY
    size = signed if signed is not None else dev
    score = F.when(seen < least_for_score, 0.0).when(flat, F.when(off, float("inf")).otherwise(0.0)).otherwise(F.try_divide(size, scatter))
    verdict = F.when(seen < LEAST, False).when(flat, off).otherwise(dev > F.lit(k) * scatter)
    return df.withColumn(f"{name}_score", score).withColumn(f"{name}_anomaly", verdict)


def mad(df: DataFrame, *, key: str, ts: str, value: str, order: str, k: float = 3.0, window: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``mad_median``, ``mad``, ``mad_score`` and ``mad_anomaly`` against the last ``window`` values before each row.

    The median of an even number is the mean of the middle two. The score is the
    deviation over 1.4826 MAD; below three earlier rows it is 0.
    """
    rows = blocks(number_rows(_sound(df, value), key=key, ts=ts, order=order), context=window, block_rows=max(block_rows, window))
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name not in (BLOCK, OWN, "mad_median", "mad")]
    out_type = T.StructType(fields + [T.StructField("mad_median", T.DoubleType()), T.StructField("mad", T.DoubleType())])

    def each(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(RN)
        _, med, dev = rolling_median(g[value].to_numpy(float), window)
        g = g.assign(mad_median=med, mad=dev)
        return g.loc[g[OWN].to_numpy(bool), [f.name for f in out_type.fields]]

    out = rows.groupBy(key, BLOCK).applyInPandas(each, out_type)
    seen = F.col(RN) - 1
    out = _judged(out, "mad", F.abs(F.col(value) - F.col("mad_median")), F.when(F.col("mad") < TINY, 0.0).otherwise(F.col("mad") * MAD_SCALE), seen, k, LEAST)
    return out if RN in df.columns else out.drop(RN)


def streaming_median(df: DataFrame, *, key: str, ts: str, value: str, order: str, window: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``median``: that of the last ``window`` values including the row's own."""
    rows = blocks(number_rows(_sound(df, value), key=key, ts=ts, order=order), context=window - 1, block_rows=max(block_rows, window))
    return rows.withColumn("median", F.percentile(F.col(value), 0.5).over(last_rows(key, window))).where(F.col(OWN)).drop(RN, BLOCK, OWN)


def ewma(df: DataFrame, *, key: str, ts: str, value: str, order: str, weight: float = 0.1, k: float = 3.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``ewma`` and ``ewma_std`` before each row, ``ewma_score`` and ``ewma_anomaly``. ``weight`` is cut to [0.001, 1]; the score needs one earlier row."""
    weight = min(1.0, max(0.001, weight))
    numbered = number_rows(_sound(df, value), key=key, ts=ts, order=order)
    out = exponential(numbered, key=key, ts=ts, value=value, order=order, weight=weight, block_rows=block_rows).drop("ema")
    out = out.withColumnRenamed("ema_before", "ewma").withColumn("ewma_std", F.sqrt("var_before")).drop("var_before")
    return _judged(out, "ewma", F.abs(F.col(value) - F.col("ewma")), F.col("ewma_std"), F.col(RN) - 1, k, 1).drop(*([] if RN in df.columns else [RN]))


def zscore(df: DataFrame, *, key: str, ts: str, value: str, order: str, k: float = 3.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``z_mean`` and ``z_std`` (sample deviation, 0 below two rows) of all rows before each row, ``z_score`` (signed) and ``z_anomaly``.

    On an empty state the mean is 0, so any other first value scores +Infinity.
    Block sums (number, mean, squared deviations) are carried as marker rows.
    """
    v = F.col(value).cast("double")
    rows = blocks(number_rows(_sound(df, value), key=key, ts=ts, order=order), block_rows=block_rows).drop(OWN)
    sums = rows.groupBy(key, BLOCK).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(v).alias("m"), (F.var_pop(v) * F.count(F.lit(1))).alias("s"))
    earlier = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    n0, m0 = F.sum("n").over(earlier), F.sum(F.col("n") * F.col("m")).over(earlier)
    carried = sums.withColumn("_rs_n0", n0).withColumn("_rs_m0", F.try_divide(m0, F.col("_rs_n0")))
    # squared deviations about the block means plus those of the block means about the common mean
    spread = F.sum("s").over(earlier) + F.sum(F.col("n") * F.col("m") * F.col("m")).over(earlier) - F.col("_rs_n0") * F.col("_rs_m0") * F.col("_rs_m0")
    carried = carried.withColumn("_rs_s0", F.greatest(spread, F.lit(0.0))).select(key, BLOCK, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("_rs_n0", "_rs_m0", "_rs_s0")])
    both = rows.unionByName(carried.withColumn("_rs_mark", F.lit(True)), allowMissingColumns=True)
    all_ = Window.partitionBy(key, BLOCK).orderBy(F.col(RN).asc_nulls_first())
    before = all_.rowsBetween(Window.unboundedPreceding, -1)
    n1, m1, s1 = F.count(v).over(before).cast("double"), F.avg(v).over(before), F.var_pop(v).over(before)
    both = both.select("*", F.first("_rs_n0", True).over(all_).alias("_rs_n"), F.first("_rs_m0", True).over(all_).alias("_rs_m"), F.first("_rs_s0", True).over(all_).alias("_rs_s"), n1.alias("_rs_n1"), F.coalesce(m1, F.lit(0.0)).alias("_rs_m1"), F.coalesce(s1, F.lit(0.0)).alias("_rs_s1"))
    n = F.col("_rs_n") + F.col("_rs_n1")
    gap = F.col("_rs_m1") - F.col("_rs_m")
    mean = F.when(n > 0, F.col("_rs_m") + gap * F.try_divide(F.col("_rs_n1"), n)).otherwise(0.0)
    total = F.col("_rs_s") + F.col("_rs_s1") * F.col("_rs_n1") + gap * gap * F.coalesce(F.try_divide(F.col("_rs_n") * F.col("_rs_n1"), n), F.lit(0.0))
    out = both.where(F.col("_rs_mark").isNull()).withColumn("z_mean", mean).withColumn("z_std", F.when(n >= 2, F.sqrt(F.try_divide(total, n - 1))).otherwise(0.0))
    dev = v - F.col("z_mean")
    out = _judged(out, "z", F.abs(dev), F.col("z_std"), F.col(RN) - 1, k, 0, signed=dev)
    return out.drop(*([] if RN in df.columns else [RN]), BLOCK, "_rs_mark", *[f"_rs_{c}" for c in ("n0", "m0", "s0", "n", "m", "s", "n1", "m1", "s1")])


def composite(df: DataFrame, *, key: str, ts: str, value: str, order: str, mad_k: float = 3.0, weight: float = 0.1, ewma_k: float = 3.0, z_k: float = 3.0, consensus: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The columns of all three detectors, ``score`` (the greatest, z-score by magnitude) and ``anomaly`` (any, or all with ``consensus``)."""
    on = {"key": key, "ts": ts, "value": value, "order": order, "block_rows": block_rows}
    # numbered once for all three
    numbered = number_rows(_sound(df, value), key=key, ts=ts, order=order)
    out = zscore(ewma(mad(numbered, k=mad_k, **on), weight=weight, k=ewma_k, **on), k=z_k, **on).drop(RN)
    a, b, c = F.col("mad_anomaly"), F.col("ewma_anomaly"), F.col("z_anomaly")
    return out.withColumn("score", F.greatest("mad_score", "ewma_score", F.abs("z_score"))).withColumn("anomaly", (a & b & c) if consensus else (a | b | c))


def anomaly_events(judged: DataFrame, *, key: str, ts: str, value: str, score: str = "score", expected: str = "mad_median", anomaly: str = "anomaly") -> DataFrame:
    """The anomalies as events (``metric_id``, ``timestamp``, ``value``, ``score``, ``expected``); a callback on them is a ``foreachBatch``."""
    return judged.where(F.col(anomaly)).select(F.col(key).alias("metric_id"), F.col(ts).alias("timestamp"), F.col(value).alias("value"), F.col(score).alias("score"), F.col(expected).alias("expected"))
