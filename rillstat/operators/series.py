"""Series operators: change rate, exponential and simple moving averages.

Each adds columns to the rows of a series. Rows come in order of (``ts``,
``order``) within ``key``; rows with a null value or time are left out. Hot keys
are cut into blocks (see ``ordered``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstat.operators.ordered import BLOCK, BLOCK_ROWS, OWN, RN, blocks, last_rows, number_rows, time_chunk


def change_rate(df: DataFrame, *, key: str, ts: str, value: str, order: str, chunk_ms: int = 86_400_000) -> DataFrame:
    """Adds ``rate``: change of value per unit of ``ts`` since the last earlier time.

    Of rows at one time the first by ``order`` makes the rate, the others repeat
    it and don't count further. Rows at a key's first time have none: the first
    row null, later ones of that time 0.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).withColumn("_rs_chunk", time_chunk(F.col(ts), chunk_ms))
    # first row of each time; per chunk the last of them goes into the key's next chunk
    point = F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))
    at_time = rows.groupBy(key, "_rs_chunk", ts).agg(F.min_by(F.col(value), F.col(order)).alias("v"))
    last = at_time.groupBy(key, "_rs_chunk").agg(F.max(F.struct(F.col(ts).alias("t"), "v")).alias("_rs_p"))
    next_chunk = F.lead("_rs_chunk").over(Window.partitionBy(key).orderBy("_rs_chunk"))
    carried = last.select(key, next_chunk.alias("_rs_chunk"), F.col("_rs_p.t").alias(ts), F.col("_rs_p.v").alias(value)).where(F.col("_rs_chunk").isNotNull()).withColumn("_rs_mark", F.lit(True))
    both = rows.withColumn("_rs_mark", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    same_time = Window.partitionBy(key, "_rs_chunk", ts).orderBy(order)
    first_at = F.row_number().over(same_time) == 1
    w = Window.partitionBy(key, "_rs_chunk").orderBy(ts, order)
    marked = both.withColumn("_rs_first", first_at).withColumn("_rs_prev", F.last(F.when(F.col("_rs_first"), point), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    # the point of an earlier time: for later rows of one time that of their first row
    prev = F.first("_rs_prev").over(same_time)
    head = F.first(F.col(value)).over(same_time)
    out = marked.withColumn("_rs_q", prev).withColumn("_rs_head", head)
    rate = F.when(F.col("_rs_q").isNotNull(), (F.col("_rs_head") - F.col("_rs_q.v")) / (F.col(ts) - F.col("_rs_q.t"))).when(~F.col("_rs_first"), 0.0)
    return out.withColumn("rate", rate).where(~F.col("_rs_mark")).drop("_rs_chunk", "_rs_mark", "_rs_first", "_rs_prev", "_rs_q", "_rs_head")


def sma(df: DataFrame, *, key: str, ts: str, value: str, order: str, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``sma``: the mean of the last ``n`` values, of those there are at the start."""
    rows = blocks(number_rows(df.where(F.col(value).isNotNull()), key=key, ts=ts, order=order), context=n - 1, block_rows=max(block_rows, n))
    return rows.withColumn("sma", F.avg(value).over(last_rows(key, n))).where(F.col(OWN)).drop(RN, BLOCK, OWN)


def smoothing(span: float) -> float:
    """The weight of a new value in an exponential average of the given span."""
    if span <= 0:
        raise ValueError("span must be positive")
    return 2 / (span + 1)


def _blend(x: np.ndarray, weight: float, start: float) -> np.ndarray:
    """Exponential averages after each value of ``x``, from an average ``start`` before the first."""
    return pd.Series(np.concatenate(([start], x))).ewm(alpha=weight, adjust=False).mean().to_numpy()[1:]


def exponential(df: DataFrame, *, key: str, ts: str, value: str, order: str, weight: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``ema`` (average after the row), ``ema_before`` and ``var_before`` (average and weighted variance before it, null in a key's first row).

    The first value starts the average, with variance 0. Then d = value - average
    before; average += weight d; variance = (1 - weight)(variance + weight d^2).
    Over a block the average is linear, the variance quadratic in the average
    before the block, so blocks are summed up independently, their sums composed
    in order of block, and each block then read with its true start.
    """
    if not 0 < weight <= 1:
        raise ValueError("weight must lie in (0, 1]")
    b = 1 - weight
    rows = blocks(number_rows(df.where(F.col(value).isNotNull()), key=key, ts=ts, order=order), block_rows=block_rows).drop(OWN)
    schema = rows.schema
    key_type = schema[key].dataType

    def run(x: np.ndarray, start: float, var: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ema = _blend(x, weight, start)
        before = np.concatenate(([start], ema))[:-1]
        d = x - before
        v = _blend(b * d * d, weight, var) if weight < 1 else np.zeros(len(x))
        return ema, before, v

    def first_run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ema, before, v = run(x[1:], x[0], 0.0)
        return np.concatenate(([x[0]], ema)), np.concatenate(([np.nan], before)), np.concatenate(([0.0], v))

    def summed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(RN)
        x, k = g[value].to_numpy(float), int(g[BLOCK].iloc[0])
        n = len(x)
        if k == 0:
            ema, _, v = first_run(x)
            made = [0.0, ema[-1], v[-1], 0.0, 0.0, 0.0]
        else:
            ema, before, v = run(x, 0.0, 0.0)
            d, t = x - before, np.arange(n)
            # a start m adds m b^t to the average before row t, so d becomes d - m b^t
            made = [b**n, ema[-1], v[-1], -2 * weight * float(np.sum(b ** (n - t) * b**t * d)), weight * float(np.sum(b ** (n - t) * b ** (2.0 * t))), b**n]
        return pd.DataFrame([[g[key].iloc[0], k, *made]], columns=[key, BLOCK, "a", "m", "v", "v1", "v2", "vv"])

    sums_type = T.StructType([T.StructField(key, key_type), T.StructField(BLOCK, T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("a", "m", "v", "v1", "v2", "vv")])
    sums = rows.select(key, BLOCK, RN, F.col(value).cast("double").alias(value)).groupBy(key, BLOCK).applyInPandas(summed, sums_type)

    def compose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(BLOCK)
        m = v = 0.0
        starts = []
        for r in g.itertuples(index=False):
            starts.append((m, v))
            m, v = r.a * m + r.m, r.v + r.v1 * m + r.v2 * m * m + r.vv * v
        out = g[[key, BLOCK]].copy()
        out["_rs_m"], out["_rs_v"] = [s[0] for s in starts], [s[1] for s in starts]
        return out

    starts_type = T.StructType([T.StructField(key, key_type), T.StructField(BLOCK, T.LongType()), T.StructField("_rs_m", T.DoubleType()), T.StructField("_rs_v", T.DoubleType())])
    starts = sums.groupBy(key).applyInPandas(compose, starts_type)
    made = ("ema", "ema_before", "var_before")
    kept = [f for f in schema.fields if f.name not in (BLOCK, *made)]
    both = rows.withColumn("_rs_m", F.lit(None).cast("double")).withColumn("_rs_v", F.lit(None).cast("double")).unionByName(starts, allowMissingColumns=True)

    def series(g: pd.DataFrame) -> pd.DataFrame:
        is_start = g["_rs_m"].notna()
        s, g = g[is_start], g[~is_start].sort_values(RN)
        x = g[value].to_numpy(float)
        if int(g[BLOCK].iloc[0]) == 0:
            ema, before, v = first_run(x)
            var_before = np.concatenate(([np.nan], v[:-1]))
        else:
            m, var = float(s["_rs_m"].iloc[0]), float(s["_rs_v"].iloc[0])
            ema, before, v = run(x, m, var)
            var_before = np.concatenate(([var], v[:-1]))
        return g[[f.name for f in kept]].assign(ema=ema, ema_before=before, var_before=var_before)

    out_type = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + [T.StructField(c, T.DoubleType()) for c in made])
    out = both.groupBy(key, BLOCK).applyInPandas(series, out_type)
    out = out.withColumn("ema_before", F.nanvl("ema_before", F.lit(None).cast("double"))).withColumn("var_before", F.nanvl("var_before", F.lit(None).cast("double")))
    return out if RN in df.columns else out.drop(RN)


def ema(df: DataFrame, *, key: str, ts: str, value: str, order: str, weight: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``ema``, the exponential moving average after each row; the first value starts it."""
    return exponential(df, key=key, ts=ts, value=value, order=order, weight=weight, block_rows=block_rows).drop("ema_before", "var_before")


def ema_final(df: DataFrame, *, key: str, ts: str, value: str, order: str, weight: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, ``ema``, ``count``): the average after a key's last row."""
    rows = ema(number_rows(df.where(F.col(value).isNotNull()), key=key, ts=ts, order=order), key=key, ts=ts, value=value, order=order, weight=weight, block_rows=block_rows)
    return rows.groupBy(key).agg(F.max_by("ema", RN).alias("ema"), F.max(RN).alias("count"))
