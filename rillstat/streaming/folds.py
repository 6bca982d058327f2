"""Ordered folds over streams: anomaly detectors, exponential averages and change rates, one state a key.

Rows of a micro-batch are taken in order of (``ts``, ``order``); rows of an
earlier time that arrive in a later micro-batch are taken as they come, so with
time-ordered input the result equals that of the batch operators. Rows with a
null key, time or value are left out. A key's state is a few numbers, or the last
100 values of its MAD.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstat import local


def _fold(df: DataFrame, key: str, ts: str, value: str, order: str, fields: list[tuple[str, T.DataType]], make: Callable, step: Callable) -> DataFrame:
    kept = [df.schema[c] for c in (key, ts, order, value)]
    out_type = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + [T.StructField(n, t) for n, t in fields])
    names = [n for n, _ in fields]

    def run(k, batches, state):
        held = pickle.loads(state.get[0]) if state.exists else make()
        g = pd.concat(list(batches), ignore_index=True).sort_values([ts, order], kind="stable")
        made = [step(held, float(v), int(t)) for v, t in zip(g[value], g[ts])]
        state.update((pickle.dumps(held),))
        yield g.assign(**{n: [m[i] for m in made] for i, n in enumerate(names)})

    rows = df.select(key, ts, order, value).dropna()
    return rows.groupBy(key).applyInPandasWithState(run, out_type, "state binary", "append", "NoTimeout")


_DETECTORS = {"mad": local.MadDetector, "ewma": local.EwmaDetector, "zscore": local.ZScoreDetector, "composite": local.CompositeDetector}


def detect(df: DataFrame, *, key: str, ts: str, value: str, order: str, detector: str = "composite", **parameters) -> DataFrame:
    """(key, ts, order, value, ``expected``, ``score``, ``anomaly``) of every row, judged before it is taken in. ``detector``: 'mad', 'ewma', 'zscore' or 'composite'."""
    kind = _DETECTORS[detector]
    fields = [("expected", T.DoubleType()), ("score", T.DoubleType()), ("anomaly", T.BooleanType())]
    return _fold(df.where(~F.isnan(F.col(value))), key, ts, value, order, fields, lambda: kind(**parameters), lambda held, v, t: held.judge(v))


def ema(df: DataFrame, *, key: str, ts: str, value: str, order: str, weight: float) -> DataFrame:
    """(key, ts, order, value, ``ema``) of every row."""
    return _fold(df, key, ts, value, order, [("ema", T.DoubleType())], lambda: local.Ema(weight), lambda held, v, t: (held.observe(v),))


def change_rate(df: DataFrame, *, key: str, ts: str, value: str, order: str) -> DataFrame:
    """(key, ts, order, value, ``rate``) of every row; null in a key's first one."""
    out = _fold(df, key, ts, value, order, [("rate", T.DoubleType())], local.ChangeRate, lambda held, v, t: (math.nan if (r := held.observe(v, t)) is None else r,))
    return out.withColumn("rate", F.nanvl("rate", F.lit(None).cast("double")))


def on_anomaly(callback: Callable):
    """Function for ``writeStream.foreachBatch`` over rows of ``detect``: calls ``callback(row)`` for every anomaly, on the executors."""

    def write(batch: DataFrame, _: int) -> None:
        batch.where(F.col("anomaly")).foreach(callback)

    return write
