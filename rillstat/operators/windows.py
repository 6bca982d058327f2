"""Time windows and count windows.

Aligned tumbling, hopping and session windows, tumbling windows whose first one
starts at the first event, count-based sliding windows, and roll-ups over three
levels. Times are epoch milliseconds; rows with a null time are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstat.operators.ordered import BLOCK, BLOCK_ROWS, OWN, RN, blocks, last_rows, number_rows
from rillstat.operators.quantile import dd_build, dd_merge, dd_quantiles, dd_stats

START = "start_ms"


def aligned(ts: Column, width_ms: int) -> Column:
    """Start of the epoch-aligned window of a time."""
    return ts - F.pmod(ts, F.lit(width_ms))


def window_sketch(df: DataFrame, by: list[str], *, ts: str, value: str, width_ms: int, a: float = 0.01, bins: int = 2048) -> DataFrame:
    """Sketch rows per group and aligned window (``start_ms``); mergeable into wider windows."""
    return dd_build(df.where(F.col(ts).isNotNull()).withColumn(START, aligned(F.col(ts), width_ms)), [*by, START], value, a, bins)


def window_result(sketch: DataFrame, by: list[str], width_ms: int, a: float = 0.01, bins: int = 2048) -> DataFrame:
    """Result rows of window sketches: by..., ``start_ms``, ``end_ms``, ``event_count``, ``counter``, ``gauge``, ``mean``, ``min``, ``max``, ``p50``, ``p99``.

    Only values are fed to these windows, so counter and gauge are always 0.
    Percentiles are lower bounds of bins (see ``quantile``). Sketch rows are few
    a window, so the two aggregations over them cost little.
    """
    at = [*by, START]
    q = dd_quantiles(sketch, at, [0.5, 0.99], a, bins).groupBy(*at).agg(F.max(F.when(F.col("q") == 0.5, F.col("estimate"))).alias("p50"), F.max(F.when(F.col("q") == 0.99, F.col("estimate"))).alias("p99"))
    s = dd_stats(sketch, at)
    on = None
    for c in at:
        one = F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}"))
        on = one if on is None else on & one
    cols = [F.col(f"s.{c}").alias(c) for c in at]
    return s.alias("s").join(q.alias("q"), on).select(
        *cols, (F.col(f"s.{START}") + width_ms).alias("end_ms"), F.col("count").alias("event_count"), F.lit(0.0).alias("counter"), F.lit(0.0).alias("gauge"), "mean", "min", "max", "p50", "p99"
    )


def tumbling(df: DataFrame, by: list[str], *, ts: str, value: str, width_ms: int, a: float = 0.01, bins: int = 2048) -> DataFrame:
    """Result rows of aligned windows; windows without values have no row."""
    return window_result(window_sketch(df, by, ts=ts, value=value, width_ms=width_ms, a=a, bins=bins), by, width_ms, a, bins)


def first_event_start(df: DataFrame, key: str, ts: str, width_ms: int) -> DataFrame:
    """``df`` with ``start_ms`` of windows whose first one starts at the key's first event after time 0; later ones are aligned and may overlap it.

    The first event of each key is one row a key, joined back; a hot key's rows
    are not gathered.
    """
    first = df.where(F.col(ts) > 0).groupBy(F.col(key).alias("_rs_k")).agg(F.min(ts).alias("_rs_t0"))
    rows = df.where(F.col(ts).isNotNull()).join(first, F.col(key).eqNullSafe(F.col("_rs_k")), "left")
    start = F.when(F.col(ts) < F.col("_rs_t0") + width_ms, F.col("_rs_t0")).otherwise(aligned(F.col(ts), width_ms))
    return rows.withColumn(START, F.coalesce(start, F.lit(0).cast("long"))).drop("_rs_k", "_rs_t0")


def tumbling_from_first(df: DataFrame, key: str, *, ts: str, value: str, width_ms: int, a: float = 0.01, bins: int = 2048, flush: bool = True) -> DataFrame:
    """Result rows of windows that start with the first event. Without ``flush`` the last, still open window of each key is left out."""
    out = window_result(dd_build(first_event_start(df, key, ts, width_ms), [key, START], value, a, bins), [key], width_ms, a, bins)
    if flush:
        return out
    later = F.max(START).over(Window.partitionBy(key))
    return out.withColumn("_rs_last", later).where(F.col(START) < F.col("_rs_last")).drop("_rs_last")


def rollup(df: DataFrame, by: list[str], *, ts: str, value: str, widths_ms: list[int], a: float = 0.01, bins: int = 2048) -> DataFrame:
    """Result rows with ``level``: the narrowest windows are built from rows, each wider level by merging the sketches below. Widths must divide each other."""
    if any(w % n for n, w in zip(widths_ms, widths_ms[1:])):
        raise ValueError("each width must be a multiple of the one before")
    sketch, out = None, None
    for level, width in enumerate(widths_ms):
        if sketch is None:
            sketch = window_sketch(df, by, ts=ts, value=value, width_ms=width, a=a, bins=bins)
        else:
            sketch = dd_merge(sketch.withColumn(START, aligned(F.col(START), width)), [*by, START])
        rows = window_result(sketch, by, width, a, bins).withColumn("level", F.lit(level))
        out = rows if out is None else out.unionByName(rows)
    return out


def rollup_of_means(df: DataFrame, key: str, *, ts: str, value: str, widths_ms: list[int], a: float = 0.05, bins: int = 256) -> DataFrame:
    """The latest closed window of each key and ``level`` where every closed window passes its plain mean on, at the time of the event that closed it."""
    rows, out = df.select(key, F.col(ts).alias("_rs_ts"), F.col(value).alias("_rs_v")), None
    for level, width in enumerate(widths_ms):
        at = first_event_start(rows.where(F.col("_rs_v").isNotNull()), key, "_rs_ts", width)
        sketch = dd_build(at, [key, START], "_rs_v", a, bins)
        first = at.groupBy(key, START).agg(F.min("_rs_ts").alias("_rs_first"), F.avg("_rs_v").alias("_rs_mean"))
        w = Window.partitionBy(key).orderBy(START)
        closed = first.withColumn("_rs_closed", F.lead("_rs_first").over(w)).where(F.col("_rs_closed").isNotNull())
        last = closed.groupBy(F.col(key).alias("_rs_k")).agg(F.max(START).alias("_rs_s"))
        done = window_result(sketch, [key], width, a, bins).join(last, F.col(key).eqNullSafe(F.col("_rs_k")) & (F.col(START) == F.col("_rs_s"))).drop("_rs_k", "_rs_s").withColumn("level", F.lit(level))
        out = done if out is None else out.unionByName(done)
        rows = closed.select(key, F.col("_rs_closed").alias("_rs_ts"), F.col("_rs_mean").alias("_rs_v"))
    return out


def sliding(df: DataFrame, *, key: str, ts: str, value: str, order: str, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``win_count``, ``win_sum``, ``win_mean``, ``win_min``, ``win_max``, ``win_var`` and ``win_std`` (population) of the last ``n`` values including the row's own."""
    rows = blocks(number_rows(df.where(F.col(value).isNotNull()), key=key, ts=ts, order=order), context=n - 1, block_rows=max(block_rows, n))
    w, v = last_rows(key, n), F.col(value)
    made = {"win_count": F.count(v), "win_sum": F.sum(v), "win_mean": F.avg(v), "win_min": F.min(v), "win_max": F.max(v), "win_var": F.var_pop(v), "win_std": F.stddev_pop(v)}
    return rows.select("*", *[c.over(w).alias(k) for k, c in made.items()]).where(F.col(OWN)).drop(RN, BLOCK, OWN)


def hopping(df: DataFrame, by: list[str], *, ts: str, value: str, width_ms: int, hop_ms: int) -> DataFrame:
    """(by..., ``start_ms``, ``end_ms``, ``event_count``, ``sum``, ``mean``) of windows of ``width_ms`` that start every ``hop_ms``.

    Rows are added up per hop first; a window adds up the hops it covers.
    """
    if width_ms % hop_ms:
        raise ValueError("the width must be a multiple of the hop")
    v = F.col(value)
    hops = df.where(F.col(ts).isNotNull() & v.isNotNull()).groupBy(*by, aligned(F.col(ts), hop_ms).alias("_rs_hop")).agg(F.count(v).alias("_rs_n"), F.sum(v).alias("_rs_s"))
    start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(width_ms // hop_ms - 1)), lambda k: F.col("_rs_hop") - k.cast("long") * hop_ms))
    out = hops.withColumn(START, start).groupBy(*by, START).agg(F.sum("_rs_n").alias("event_count"), F.sum("_rs_s").alias("sum"))
    return out.select(*by, START, (F.col(START) + width_ms).alias("end_ms"), "event_count", "sum", (F.col("sum") / F.col("event_count")).alias("mean"))


def sessions(df: DataFrame, by: list[str], *, ts: str, value: str, gap_ms: int) -> DataFrame:
    """(by..., ``start_ms``, ``end_ms``, ``event_count``, ``sum``): runs of events less than ``gap_ms`` apart; the end is the last event plus the gap."""
    at = F.timestamp_millis(F.col(ts))
    v = F.col(value)
    out = df.where(F.col(ts).isNotNull()).groupBy(*by, F.session_window(at, f"{gap_ms} milliseconds").alias("_rs_w")).agg(F.count(F.lit(1)).alias("event_count"), F.sum(v).alias("sum"))
    return out.select(*by, F.unix_millis("_rs_w.start").alias(START), F.unix_millis("_rs_w.end").alias("end_ms"), "event_count", "sum")
