"""Faulty level readings: impossible, spiked and stuck ones.

A source is split by its reporting windows, and each window is judged by itself
in order of time: physical limits first, then stuck runs, then additive outliers
of up to three readings, told from level shifts by a robust autoregression.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstat.operators.intervals import attach_intervals

#: A spike leaves the levels around it by more than this many scatters and lasts at most so many readings.
SPIKE_SCATTERS, SPIKE_READINGS = 8.0, 3
#: A stuck run has at least this many readings within this share of a scatter of each other.
STUCK_READINGS, STUCK_SCATTERS = 10, 0.01
#: A source that repeats more than this share of its readings outside long runs does so by nature.
REPEAT_SHARE = 0.1
#: Readings that make a level, on each side.
SIDE = 5
AR_ORDER = 2


def _medians(x: np.ndarray, lags: list[int]) -> np.ndarray:
    """Per position the median of the readings at the given lags; those outside the series are left out."""
    pad = max(abs(k) for k in lags)
    p = np.concatenate([np.full(pad, np.nan), x, np.full(pad, np.nan)])
    at = np.sort(np.stack([p[pad + k : pad + k + len(x)] for k in lags], axis=1), axis=1)
    n = np.sum(~np.isnan(at), axis=1)
    row = np.arange(len(x))
    out = (at[row, np.maximum(n - 1, 0) // 2] + at[row, np.minimum(n // 2, len(lags) - 1)]) / 2
    return np.where(n > 0, out, np.nan)


def _common_step(x: np.ndarray) -> tuple[float, int]:
    """(step, number of moves): the greatest step of which nine of ten moves are multiples, 0 if there is none.

    Most moves alike are the step. Else tried are the most frequent moves, then what Euclid's rule finds over all of
    them; a step far below the usual move is the grain of a source that moves freely.
    """
    d = np.abs(np.diff(x))
    d = d[d > 1e-12 * max(1.0, float(np.max(np.abs(x))))] if len(x) else d
    if not len(d):
        return 0.0, 0
    usual = float(np.sort(d)[len(d) // 10])

    def whole(u: float) -> bool:
        k = np.round(d / u) if u > 0 else np.zeros(len(d))
        return float(np.mean((k >= 1) & (np.abs(d - k * u) < 1e-3 * u))) >= 0.9

    moves, times = np.unique(np.round(d, 9), return_counts=True)
    if 2 * times.max() > len(d):
        return float(moves[np.argmax(times)]), len(d)
    for u in sorted(moves[np.argsort(-times, kind="stable")[:5]].tolist(), reverse=True):
        if whole(u):
            return u, len(d)
    step = 0.0
    for m in moves:
        while m > 1e-3 * usual:
            step, m = m, (step % m if step else 0.0)
            if abs(step - m) <= 1e-3 * usual:
                m = 0.0
        if step < 0.01 * usual:
            return 0.0, len(d)
    return (step, len(d)) if whole(step) else (0.0, len(d))


def whole_step(x: np.ndarray) -> tuple[float, float]:
    """(step, weight) of finite readings in order.

    All moves count if they have a step and are ten at least; else those of the
    running median of nine readings, which spikes don't reach; else, in readings
    that stand still but for single moves, these, at a thousandth of the weight.
    """
    step, n = _common_step(x)
    if n < 10 or not step:
        calm, m = _common_step(np.sort(np.lib.stride_tricks.sliding_window_view(x, 9), axis=1)[:, 4]) if len(x) >= 9 else (0.0, 0)
        return (calm, float(m)) if m else (step, n / 1000)
    return step, float(n)


def _scatter(x: np.ndarray, step: float) -> float:
    """The usual deviation from the local level, at least one step."""
    res = np.abs(x - _medians(x, [-4, -3, -2, -1, 1, 2, 3, 4]))
    res = res[np.isfinite(res)]
    return max(1.4826 * float(np.median(res)) if len(res) else 0.0, step)


def _long_runs(x: np.ndarray, tol: float) -> np.ndarray:
    """Readings of a run of STUCK_READINGS or more, all within ``tol`` of each other."""
    out = np.zeros(len(x), dtype=bool)
    if len(x) >= STUCK_READINGS:
        v = np.lib.stride_tricks.sliding_window_view(x, STUCK_READINGS)
        for i in np.flatnonzero(v.max(axis=1) - v.min(axis=1) <= tol):
            out[i : i + STUCK_READINGS] = True
    return out


def _levels(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position the level of the SIDE readings before it and of those from it on; one position more than readings."""
    nan = [np.nan]
    return np.concatenate((_medians(x, list(range(-SIDE, 0))), nan)), np.concatenate((_medians(x, list(range(SIDE))), nan))


def _excess(x: np.ndarray, n: int, levels: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """By how much each run of ``n`` readings leaves both the level before and the level after it, to one side."""
    runs = np.lib.stride_tricks.sliding_window_view(x, n)
    before, after = levels[0][: len(runs)], levels[1][n : n + len(runs)]
    gap = np.maximum(runs.min(axis=1) - np.maximum(before, after), np.minimum(before, after) - runs.max(axis=1))
    return np.nan_to_num(gap, nan=-np.inf)


def _autoregression(x: np.ndarray) -> np.ndarray:
    """Coefficients of an autoregression of the differences, by reweighted least squares with Huber's weights."""
    d = np.diff(x)
    if len(d) < 5 * AR_ORDER:
        return np.zeros(AR_ORDER)
    s = 1.4826 * np.median(np.abs(d - np.median(d))) + 1e-12
    # the regressors are bounded, so that a spike has no leverage
    b = np.clip(d - np.median(d), -3 * s, 3 * s)
    lags = np.stack([b[AR_ORDER - k : len(b) - k] for k in range(1, AR_ORDER + 1)], axis=1)
    y, phi = b[AR_ORDER:], np.zeros(AR_ORDER)
    for _ in range(10):
        e = y - lags @ phi
        scale = 1.4826 * np.median(np.abs(e)) + 1e-12
        w = np.minimum(1.0, 1.5 * scale / np.maximum(np.abs(e), 1e-12))[:, None]
        phi = np.linalg.solve((lags * w).T @ lags + 1e-9 * s * s * np.eye(AR_ORDER), (lags * w).T @ y)
    return phi


def _is_additive(x: np.ndarray, i: int, n: int, phi: np.ndarray) -> bool:
    """Whether an additive outlier over ``n`` readings from ``i`` explains the innovations better than a level shift there."""
    lo, hi = max(0, i - 4 * SIDE), min(len(x), i + n + 4 * SIDE)
    w, at = x[lo:hi], i - lo
    additive = np.zeros((len(w), n))
    additive[np.arange(at, at + n), np.arange(n)] = 1
    shifts = np.zeros((len(w), 2))
    shifts[at:, 0] = 1
    shifts[at + n :, 1] = 1

    def innovations(a: np.ndarray) -> np.ndarray:
        d = np.diff(a, axis=0)
        return d[AR_ORDER:] - sum(phi[k - 1] * d[AR_ORDER - k : len(d) - k] for k in range(1, AR_ORDER + 1))

    def left(z: np.ndarray) -> float:
        e, f = innovations(w), innovations(z)
        return float(np.sum((e - f @ np.linalg.lstsq(f, e, rcond=None)[0]) ** 2))

    return left(additive) <= min(left(shifts[:, :1]), left(shifts[:, 1:]))


def _spikes(x: np.ndarray, limit: float) -> np.ndarray:
    """Readings of additive outliers. Found ones are taken out and the rest is judged again, as they blur the levels beside them."""
    found, rest = np.zeros(len(x), dtype=bool), np.arange(len(x))
    while len(rest) > SPIKE_READINGS + 1:
        y = x[rest]
        longer = np.zeros(len(y), dtype=bool)
        levels = _levels(y)
        for i in np.flatnonzero(_excess(y, SPIKE_READINGS + 1, levels) > limit):
            longer[i : i + SPIKE_READINGS + 1] = True
        phi, new = None, np.zeros(len(y), dtype=bool)
        for n in range(1, SPIKE_READINGS + 1):
            for i in np.flatnonzero(_excess(y, n, levels) > limit):
                if longer[i : i + n].any() or new[i : i + n].all():
                    continue
                phi = _autoregression(y) if phi is None else phi
                if _is_additive(y, i, n, phi):
                    new[i : i + n] = True
        if not new.any():
            break
        found[rest[new]] = True
        rest = rest[~new]
    return found


def judge(x: np.ndarray, low: float, high: float, step: float | None = None) -> np.ndarray:
    """The faulty readings of one window, in order of time. NaN bounds don't limit. ``step``: that of the source, 0 for none; None takes the window's own."""
    bad = ~np.isfinite(x) | (x < low) | (x > high)
    good = np.flatnonzero(~bad)
    y = x[good]
    if len(y) < 2:
        return bad
    step = whole_step(y)[0] if step is None else step
    s = _scatter(y, step)
    stuck = np.zeros(len(y), dtype=bool)
    # a source whose scatter is its step stands still by nature
    for _ in range(2 if s > step else 0):
        stuck = _long_runs(np.where(bad, np.nan, x), STUCK_SCATTERS * s)[good]
        steady = ~(stuck[1:] & stuck[:-1])
        repeats = np.abs(np.diff(y))[steady] <= STUCK_SCATTERS * s
        if not stuck.any() or not steady.any() or np.mean(repeats) > REPEAT_SHARE:
            stuck[:] = False
            break
        s = _scatter(y[~stuck], step) if np.sum(~stuck) > 2 * SIDE else s
    out = bad.copy()
    out[good] = stuck | _spikes(y, SPIKE_SCATTERS * s)
    return out


def faulty_readings(
    readings: DataFrame,
    schedule: DataFrame,
    limits: DataFrame,
    *,
    key: str = "name_hash",
    ts: str = "ts_ms",
    value: str = "value",
    order: str = "seq",
    start: str = "start_ms",
    end: str = "end_ms",
    low: str = "min_valid",
    high: str = "max_valid",
) -> DataFrame:
    """``order`` of each faulty reading. Null and NaN values are no readings; infinite ones are faulty.

    Readings in no window, or without key or time, are not judged; nor are those
    of windows that don't end after their start. Repeated deliveries and windows
    count once, of repeated limits the tightest holds, a source without limits
    has none. Of readings at one time ``order`` decides. Empty tables give no rows.

    Two passes over the readings, grouped by window so that no task holds a hot
    source: the first asks each window for its step, by which a source is known
    that moves in whole steps; the second judges. Limits and steps come with the
    windows, which are few.
    """
    window = [key, start, end]
    some = readings.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))

    def grouped():
        return attach_intervals(some, schedule, key=key, ts=ts, start=start, end=end, keep=(value, order), shards=4, shard_by=order, dedupe=True).groupBy(*window)

    def vote(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values([ts, order], kind="stable")[value].to_numpy(float)
        step, moves = whole_step(x[np.isfinite(x)])
        return pd.DataFrame([(g[key].iloc[0], round(step, 9), moves)], columns=["_rs_k", "_rs_step", "_rs_moves"])

    kinds = {f.name: f.dataType.simpleString() for f in schedule.schema.fields}
    votes = grouped().applyInPandas(vote, f"_rs_k {kinds[key]}, _rs_step double, _rs_moves double")
    per_step = votes.groupBy("_rs_k", "_rs_step").agg(F.sum("_rs_moves").alias("_rs_moves"))
    steps = per_step.groupBy("_rs_k").agg(F.max_by("_rs_step", "_rs_moves").alias("_rs_step"))
    bounds = limits.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_rs_l")).agg(F.max(low).cast("double").alias("_rs_low"), F.min(high).cast("double").alias("_rs_high"))
    windows = schedule.select(*[F.col(c).alias(c) for c in window]).dropna().dropDuplicates()
    windows = windows.join(bounds, F.col(key) == F.col("_rs_l"), "left").join(steps, F.col(key) == F.col("_rs_k"), "left").select(*window, "_rs_low", "_rs_high", "_rs_step")

    def each(g: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(w):
            return g[[order]].iloc[:0]
        g = g.sort_values([ts, order], kind="stable")
        lo, hi, step = (float(w[c].astype(float).iloc[0]) for c in ("_rs_low", "_rs_high", "_rs_step"))
        return g.loc[judge(g[value].to_numpy(float), lo, hi, 0.0 if np.isnan(step) else step), [order]]

    kind = readings.schema[order].dataType.simpleString()
    return grouped().cogroup(windows.groupBy(*window)).applyInPandas(each, f"`{order}` {kind}").dropDuplicates()
