"""Column rules of metric events, shared by all operators that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2000-01-01 in epoch milliseconds: an earlier or null time is not a usable one.
FIRST_USABLE_MS = 946_684_800_000
DAY_MS = 86_400_000


def event_type(c: Column) -> Column:
    """A metric type without surrounding spaces and regardless of case; null stays null."""
    return F.lower(F.trim(c))


def is_timed(ts: Column) -> Column:
    """True where the time is usable; false (never null) elsewhere."""
    return F.coalesce(ts >= F.lit(FIRST_USABLE_MS), F.lit(False))


def is_finite(v: Column) -> Column:
    """True for a value that is neither null, NaN nor infinite; never null."""
    return F.coalesce((F.abs(v) < F.lit(float("inf"))), F.lit(False))


def utc_day(ts_ms: Column) -> Column:
    """Days since the epoch of a time in epoch milliseconds, floored, in whole-number arithmetic."""
    return ((ts_ms - F.pmod(ts_ms, F.lit(DAY_MS))) / F.lit(DAY_MS)).cast("int")


def unsigned_to_double(h: Column) -> Column:
    """A BIGINT read as unsigned 64 bit and rounded once to DOUBLE.

    Halving with the lost bit kept as a sticky bit leaves 63 bits, whose single
    rounding equals that of the whole number; doubling is exact.
    """
    half = F.shiftrightunsigned(h, 1).bitwiseOR(h.bitwiseAND(F.lit(1).cast("long")))
    return F.when(h >= 0, h.cast("double")).otherwise(half.cast("double") * F.lit(2.0))


def timed_events(events: DataFrame, kind: str | None = None, *, columns: tuple[str, ...] = ("name_hash", "value", "ts_ms", "seq")) -> DataFrame:
    """The timed deliveries of one event type (all types for None), pruned to ``columns``.

    The time bound reaches the scan as a pushed filter. Repeated deliveries are
    still there: an operator removes them where they would change its result.
    """
    out = events.where(F.col("ts_ms") >= F.lit(FIRST_USABLE_MS))
    if kind is not None:
        out = out.where(event_type(F.col("metric_type")) == F.lit(kind))
    return out.select(*columns)
