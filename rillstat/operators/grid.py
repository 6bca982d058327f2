"""Irregular readings onto the regular grid of their reporting windows.

One method serves level readings (gauges) and cumulative counters. Readings
become spans of covered time, spans are cut into the grid cells by overlap, and
cells that no span touches are marked:

* a level reading covers the period it lies in;
* two successive readings of a counter cover the time between them, unless they
  are too far apart. A reading below the one before is a reset, whose own value
  is the increment; otherwise the difference is. An increment is spread over the
  cells in proportion to overlap.

A source is split by its reporting windows, so no task holds a whole hot source,
and a window by time and shard while readings are matched to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstat.functions.events import is_finite
from rillstat.operators.intervals import attach_intervals

_FROM, _TO, _CELL = "_rs_from", "_rs_to", "_rs_cell"


def _windows(schedule: DataFrame, key: str, start: str, end: str, period: str) -> DataFrame:
    """Each usable window once."""
    return schedule.where((F.col(period) > 0) & (F.col(end) > F.col(start)) & F.col(key).isNotNull()).select(key, start, end, period).dropDuplicates()


def _in_windows(readings: DataFrame, schedule: DataFrame, key: str, ts: str, value: str, order: str, start: str, end: str, period: str, bucket_ms: int, shards: int) -> DataFrame:
    """Finite readings with each window that holds them, repeated deliveries once."""
    finite = readings.where(is_finite(F.col(value)))
    return attach_intervals(
        finite, schedule.where(F.col(period) > 0), key=key, ts=ts, start=start, end=end, keep=(value, order), carry=(period,), bucket_ms=bucket_ms, shards=shards, shard_by=order, dedupe=True
    )


def _level_spans(met: DataFrame, ts: str, start: str, period: str) -> DataFrame:
    """The period of each reading, as a span in milliseconds since the window's start."""
    k = F.expr(f"(`{ts}` - `{start}`) div `{period}`")
    return met.withColumn(_FROM, k * F.col(period)).withColumn(_TO, (k + 1) * F.col(period))


def _counter_spans(met: DataFrame, window: list[str], ts: str, value: str, order: str, start: str, period: str, max_gap_periods: float) -> DataFrame:
    """The time between successive readings of a window with its increment. Of readings at one time the last by ``order`` holds."""
    last = F.max_by(F.col(value), F.col(order))
    once = met.groupBy(*window, ts).agg(last.alias("_rs_v1"))
    w = Window.partitionBy(*window).orderBy(ts)
    pairs = once.withColumn("_rs_t0", F.lag(ts).over(w)).withColumn("_rs_v0", F.lag("_rs_v1").over(w))
    near = pairs.where(F.col("_rs_t0").isNotNull() & (F.col(ts) - F.col("_rs_t0") <= F.col(period) * F.lit(float(max_gap_periods))))
    reset = F.col("_rs_v1") < F.col("_rs_v0")
    return near.select(
        *window,
        (F.col("_rs_t0") - F.col(start)).alias(_FROM),
        (F.col(ts) - F.col(start)).alias(_TO),
        reset.alias("_rs_reset"),
        F.when(reset, F.col("_rs_v1")).otherwise(F.col("_rs_v1") - F.col("_rs_v0")).alias("_rs_inc"),
    )


def _into_cells(spans: DataFrame, period: str) -> DataFrame:
    """Spans cut at the cell borders: ``_rs_cell`` and ``_rs_over``, the milliseconds of a span in the cell."""
    cells = F.explode(F.expr(f"sequence({_FROM} div `{period}`, ({_TO} - 1) div `{period}`)"))
    cut = spans.withColumn(_CELL, cells)
    return cut.withColumn("_rs_over", F.least(_TO, (F.col(_CELL) + 1) * F.col(period)) - F.greatest(_FROM, F.col(_CELL) * F.col(period)))


def _on_grid(seen: DataFrame, schedule: DataFrame, key: str, start: str, end: str, period: str) -> DataFrame:
    """Every cell of every window, with what the spans brought to it; ``_rs_covered`` is null in cells that no span touches."""
    last = F.expr(f"(`{end}` - `{start}` - 1) div `{period}`")
    cells = _windows(schedule, key, start, end, period).withColumn(_CELL, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return cells.join(seen, [key, start, end, period, _CELL], "left").withColumn("period_start_ms", F.col(start) + F.col(_CELL) * F.col(period))


def _cell_length(start: str, end: str, period: str) -> Column:
    """A last, partial cell ends with its window."""
    return F.least(F.col(period), F.col(end) - F.col("period_start_ms"))


def _levels(readings: DataFrame, schedule: DataFrame, key: str, ts: str, value: str, order: str, start: str, end: str, period: str, bucket_ms: int, shards: int, sums: list[Column]) -> DataFrame:
    met = _in_windows(readings, schedule, key, ts, value, order, start, end, period, bucket_ms, shards)
    cut = _into_cells(_level_spans(met, ts, start, period), period)
    seen = cut.groupBy(key, start, end, period, _CELL).agg(F.sum("_rs_over").alias("_rs_covered"), *sums)
    return _on_grid(seen, schedule, key, start, end, period)


def uncovered_periods(readings: DataFrame, schedule: DataFrame, *, key: str = "name_hash", ts: str = "ts_ms", value: str = "value", order: str = "seq", start: str = "start_ms", end: str = "end_ms", period: str = "period_ms", bucket_ms: int = 3_600_000, shards: int = 4) -> DataFrame:
    """(key, ``period_start_ms``) of the periods of ``regular_grid`` that no reading covers."""
    g = _levels(readings, schedule, key, ts, value, order, start, end, period, bucket_ms, shards, [])
    return g.where(F.col("_rs_covered").isNull()).select(key, "period_start_ms")


def regular_grid(readings: DataFrame, schedule: DataFrame, *, key: str = "name_hash", ts: str = "ts_ms", value: str = "value", order: str = "seq", start: str = "start_ms", end: str = "end_ms", period: str = "period_ms", bucket_ms: int = 3_600_000, shards: int = 4) -> DataFrame:
    """Level readings: one row per period of each scheduled window of each source.

    Columns: key, start, period_start_ms, period, ``n_readings`` (events with a
    finite value in the period), ``mean_value``, ``last_value`` (by time, then
    ``order``), ``state`` ('observed' or 'missing') and ``filled_value``: the
    mean where observed, else linear between the nearest observed periods of the
    same window, else the nearest one's, else null.

    Repeated deliveries count once. Null, NaN and infinite values are no
    readings. Repeated windows count once; windows with a null field, no
    positive period or no length give no rows; a last, partial period is cut at
    the window's end. A window without readings is missing in all its periods.
    """
    sums = [F.count(F.lit(1)).alias("n_readings"), F.avg(value).alias("mean_value"), F.max_by(F.col(value), F.struct(ts, order)).alias("last_value")]
    grid = _levels(readings, schedule, key, ts, value, order, start, end, period, bucket_ms, shards, sums)
    w = Window.partitionBy(key, start, end, period).orderBy(_CELL)
    at, had = F.col("period_start_ms"), F.col("_rs_covered").isNotNull()
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    pt, pv = F.last(F.when(had, at), True).over(before), F.last("mean_value", True).over(before)
    nt, nv = F.first(F.when(had, at), True).over(after), F.first("mean_value", True).over(after)
    line = F.when(nt > pt, pv + (nv - pv) * (at - pt) / (nt - pt))
    return grid.select(
        key,
        start,
        "period_start_ms",
        period,
        F.coalesce("n_readings", F.lit(0)).alias("n_readings"),
        "mean_value",
        "last_value",
        F.when(had, "observed").otherwise("missing").alias("state"),
        F.coalesce(F.col("mean_value"), line, pv, nv).alias("filled_value"),
    )


def counter_grid(readings: DataFrame, schedule: DataFrame, *, key: str = "name_hash", ts: str = "ts_ms", value: str = "value", order: str = "seq", start: str = "start_ms", end: str = "end_ms", period: str = "period_ms", max_gap_periods: float = 2.0, bucket_ms: int = 3_600_000, shards: int = 4) -> DataFrame:
    """Cumulative counters: increments per period of each scheduled window of each source.

    Columns: key, start, period_start_ms, period, ``increment``, ``resets``
    (counted in the period in which they are read), ``covered_ms`` and ``state``
    ('covered', 'partial', 'uncovered'). Two readings further apart than
    ``max_gap_periods`` of the window's own period leave their time uncovered, as
    their increment can't be placed. Deliveries, null and non-finite values and
    windows are treated as in ``regular_grid``; a window with fewer than two
    readings is uncovered in all its periods.
    """
    window = [key, start, end, period]
    met = _in_windows(readings, schedule, key, ts, value, order, start, end, period, bucket_ms, shards)
    cut = _into_cells(_counter_spans(met, window, ts, value, order, start, period, max_gap_periods), period)
    read_here = F.col("_rs_reset") & (F.expr(f"({_TO} - 1) div `{period}`") == F.col(_CELL))
    seen = cut.groupBy(*window, _CELL).agg(
        F.sum("_rs_over").alias("_rs_covered"), F.sum(F.col("_rs_inc") * F.col("_rs_over") / (F.col(_TO) - F.col(_FROM))).alias("_rs_increment"), F.sum(read_here.cast("long")).alias("_rs_resets")
    )
    covered = F.coalesce("_rs_covered", F.lit(0))
    return _on_grid(seen, schedule, key, start, end, period).select(
        key,
        start,
        "period_start_ms",
        period,
        F.coalesce("_rs_increment", F.lit(0.0)).alias("increment"),
        F.coalesce("_rs_resets", F.lit(0)).alias("resets"),
        covered.alias("covered_ms"),
        F.when(covered >= _cell_length(start, end, period), "covered").when(covered > 0, "partial").otherwise("uncovered").alias("state"),
    )
