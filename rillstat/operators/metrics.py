"""Metric pipeline: counters, gauges, histograms and distinct counts per metric, and their snapshots.

All four kinds are kept in one relational state, so that one scan and one
aggregation build it: rows (key, ``kind``, ``slot``, ...), where a histogram
value has the slot of its bin, a distinct item that of its register, counters
and gauges slot 0. The aggregation is hashed by key *and* slot and combines on
the map side, so a hot metric is spread. States merge by the same aggregation.

An event is (key, type, value, item, time, arrival number). Counters add up
finite values, a gauge is the non-null value of the last arrival, histograms take finite
values, distinct counts the hash of an item; all events count. Types of other
names count as events only. Null keys are a metric of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstat.functions.events import event_type, is_finite
from rillstat.operators.cardinality import alpha, register_of
from rillstat.operators.quantile import gamma, slot_of

#: Size of the distinct-count registers and of the histogram bins of a metric, and their accuracy.
P, BINS, ACCURACY = 10, 256, 0.05
SNAPSHOT = ["counter", "gauge", "cardinality", "p50", "p95", "p99", "mean", "min", "max", "event_count"]


def metric_state(events: DataFrame, *, key: str = "name_hash", kind: str = "metric_type", value: str = "value", item: str = "item_hash", ts: str = "ts_ms", order: str = "seq", p: int = P, bins: int = BINS, a: float = ACCURACY) -> DataFrame:
    """State rows of all metrics. ``item`` is a BIGINT hash; repeated deliveries must be left out before."""
    t = event_type(F.col(kind))
    v = F.when(is_finite(F.col(value)), F.col(value))
    hist, uniq = t == "histogram", t == "unique"
    idx, rank = register_of(F.col(item), p)
    slot = F.when(hist & v.isNotNull(), slot_of(v, a, bins)).when(uniq, idx).when(t.isin("counter", "gauge"), F.lit(0))
    known = F.when(t.isin("counter", "gauge", "histogram", "unique"), t).otherwise(F.lit("other"))
    rows = events.select(F.col(key).alias(key), known.alias("kind"), slot.alias("slot"), F.when(uniq, rank).alias("rank"), F.when(~uniq | t.isNull(), v).alias("v"), F.when((t == "gauge") & F.col(value).isNotNull(), F.col(order)).alias("at"), F.col(value).alias("raw"), F.col(ts).alias("t"))
    return rows.groupBy(key, "kind", "slot").agg(
        F.count(F.lit(1)).alias("events"), F.count("v").alias("n"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"), F.max("rank").alias("rank"), F.max("at").alias("last_at"), F.max_by("raw", "at").alias("last"), F.max("t").alias("last_update")
    )


def events_from(df: DataFrame, *, key: str | Column, ts: str, order: str, counter: Column | None = None, gauge: Column | None = None, histogram: Column | None = None, unique: Column | None = None) -> DataFrame:
    """Each row as one event of every given kind: (``name_hash``, ``ts_ms``, ``seq``, ``metric_type``, ``value``, ``item_hash``). ``unique`` is the BIGINT hash of an item."""
    none, no_item = F.lit(None).cast("double"), F.lit(None).cast("long")
    given = [("counter", counter, no_item), ("gauge", gauge, no_item), ("histogram", histogram, no_item), ("unique", None if unique is None else none, unique)]
    kinds = [F.struct(F.lit(k).alias("metric_type"), v.cast("double").alias("value"), i.alias("item_hash")) for k, v, i in given if v is not None]
    name = F.col(key) if isinstance(key, str) else key
    return df.select(name.alias("name_hash"), F.col(ts).alias("ts_ms"), F.col(order).alias("seq"), F.explode(F.array(*kinds)).alias("_rs_e")).select("name_hash", "ts_ms", "seq", "_rs_e.*")


def pipeline_counts(state: DataFrame, key: str = "name_hash") -> DataFrame:
    """One row: ``total_events`` and ``metrics`` of a state."""
    per = state.groupBy(key).agg(F.sum("events").alias("_rs_n"))
    return per.agg(F.coalesce(F.sum("_rs_n"), F.lit(0)).alias("total_events"), F.count(F.lit(1)).alias("metrics"))


def merge_states(states: DataFrame, key: str = "name_hash") -> DataFrame:
    """Union of the states of parts, days or nodes of equal sizes: sums, extremes, greatest ranks and last arrivals."""
    return states.groupBy(key, "kind", "slot").agg(
        F.sum("events").alias("events"), F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.max("rank").alias("rank"), F.max("last_at").alias("last_at"), F.max_by("last", "last_at").alias("last"), F.max("last_update").alias("last_update")
    )


def snapshot(state: DataFrame, key: str = "name_hash", *, p: int = P, bins: int = BINS, a: float = ACCURACY) -> DataFrame:
    """One row a metric: key, ``counter``, ``gauge``, ``cardinality``, ``p50``, ``p95``, ``p99``, ``mean``, ``min``, ``max``, ``event_count``.

    Percentiles are lower bounds of bins, and the maximum beyond the bins;
    without histogram values they and the mean are 0, the extremes +-Infinity. A
    metric has at most 2**p + 2 bins + 5 state rows, all of which are brought
    together here.
    """
    hist, n = F.col("kind") == "histogram", F.col("n")
    w = Window.partitionBy(key)
    inside = F.when(hist & F.col("slot").isNotNull(), n).otherwise(0)
    total = F.sum(F.when(hist, n).otherwise(0)).over(w)
    # only bins of the histogram take part in the running count
    to = F.sum(inside).over(w.orderBy(hist.desc(), F.col("slot").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    rows = state.withColumn("_rs_total", total).withColumn("_rs_to", to).withColumn("_rs_in", inside)
    size = F.pow(F.lit(gamma(a)), (F.abs("slot") - 2 - bins // 4).cast("double"))
    bound = F.when(F.col("slot") == 0, 0.0).when(F.col("slot") > 0, size).otherwise(-size)

    def at(q: float) -> Column:
        hit = (F.col("_rs_in") > 0) & (F.col("_rs_to") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_rs_total"))))
        return F.coalesce(F.min_by(bound, F.when(hit, F.col("slot"))), F.max(F.when(hist, F.col("max"))), F.lit(0.0))

    uniq = (F.col("kind") == "unique") & F.col("rank").isNotNull()
    used, m = F.count(F.when(uniq, 1)), float(2**p)
    raw = F.lit(alpha(p) * m * m) / (F.coalesce(F.sum(F.when(uniq, F.pow(F.lit(2.0), -F.col("rank")))), F.lit(0.0)) + F.lit(m) - used)
    linear = F.lit(m) * F.ln(F.lit(m) / F.when(used < m, F.lit(m) - used))
    count, total_sum = F.coalesce(F.sum(F.when(hist, n)), F.lit(0)), F.coalesce(F.sum(F.when(hist, F.col("sum"))), F.lit(0.0))
    return rows.groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "counter", F.col("sum"))), F.lit(0.0)).alias("counter"),
        F.coalesce(F.max_by("last", F.when(F.col("kind") == "gauge", F.col("last_at"))), F.lit(0.0)).alias("gauge"),
        F.when((raw <= 2.5 * m) & (used < m), linear).otherwise(raw).alias("cardinality"),
        at(0.5).alias("p50"),
        at(0.95).alias("p95"),
        at(0.99).alias("p99"),
        F.when(count > 0, total_sum / F.when(count > 0, count)).otherwise(0.0).alias("mean"),
        F.coalesce(F.min(F.when(hist, F.col("min"))), F.lit(math.inf)).alias("min"),
        F.coalesce(F.max(F.when(hist, F.col("max"))), F.lit(-math.inf)).alias("max"),
        F.sum("events").alias("event_count"),
    )


def slots(events: DataFrame, n_slots: int, *, key: str = "name_hash", order: str = "seq") -> DataFrame:
    """Events as they fall into ``n_slots`` slots (a power of two) by their name hash: ``slot_key`` is the slot number.

    Metrics that share a slot are aggregated together; ``slot_owner`` says under
    which name hash, that of the first arrival.
    """
    if n_slots < 1 or n_slots & (n_slots - 1):
        raise ValueError("the number of slots must be a power of two")
    return events.where(F.col(key).isNotNull()).withColumn("slot_key", F.col(key).bitwiseAND(F.lit(n_slots - 1).cast("long")).cast("int"))


def slot_owner(slotted: DataFrame, *, key: str = "name_hash", order: str = "seq") -> DataFrame:
    """(``slot_key``, key): the name hash under which each slot can be asked for. At most one row a slot."""
    return slotted.groupBy("slot_key").agg(F.min_by(F.col(key), F.col(order)).alias(key))


def get_slot(snapshots: DataFrame, name_hash: int, key: str = "name_hash") -> DataFrame:
    """The row of one metric, or none."""
    return snapshots.where(F.col(key) == F.lit(name_hash).cast("long"))
