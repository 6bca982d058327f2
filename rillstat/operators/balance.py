"""Per-key work without a few tasks running far longer than the rest.

Fragment-replicate by estimated load: the rows of every key are estimated from a
sample (one narrow scan), keys are packed into tasks by load, keys
above a task's share are split into proportionate shards, and a matching side
is copied only to the shards of its own key.

What reaches the driver is bounded by the number of tasks, not by the number of
keys or rows: keys below a task's share are known only by the total load of
their hash bucket (``BUCKETS_PER_TASK`` buckets a task).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS_PER_TASK = 8
TASK = "_rs_task"


@dataclass(frozen=True)
class LoadPlan:
    """Where keys go. ``heavy``: (key, [task of each shard]), at most one row a task; ``light``: task of each hash bucket."""

    tasks: int
    target: float
    key_type: T.DataType
    heavy: list
    light: list


def _key_id(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def pack_loads(heavy: list, light: list, tasks: int, target: float) -> tuple[list, list]:
    """Longest-first packing of shards and buckets into ``tasks`` bins by load.

    ``heavy``: (key, load); ``light``: (bucket, load). A heavy key gets
    ceil(load / target) shards of equal load.
    """
    pieces = [(load / s, ("h", i)) for i, (_, load) in enumerate(heavy) for s in [max(1, ceil(load / target))] for _ in range(s)]
    pieces += [(load, ("l", b)) for b, load in light]
    pieces.sort(key=lambda p: (-p[0], p[1]))
    bins = [(0.0, t) for t in range(tasks)]
    shards: dict[int, list[int]] = {}
    where: dict[int, int] = {}
    for load, (kind, i) in pieces:
        total, t = heapq.heappop(bins)
        heapq.heappush(bins, (total + load, t))
        if kind == "h":
            shards.setdefault(i, []).append(t)
        else:
            where[i] = t
    return [(k, shards[i]) for i, (k, _) in enumerate(heavy)], sorted(where.items())


def plan_load(df: DataFrame, key: str, tasks: int | None = None, *, fraction: float = 0.1, seed: int = 7) -> LoadPlan:
    """Estimate the load of each key from a sample of its rows, in one narrow job, and plan the tasks of the keys.

    The plan decides only where rows are worked on, never a result. Null is a key
    like any other. Each hash bucket reports its number of rows and a bounded
    summary of its most frequent keys, so the driver gets at most
    ``BUCKETS_PER_TASK`` rows a task. An empty sample gives an even plan.
    """
    spark = df.sparkSession
    tasks = tasks or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = tasks * BUCKETS_PER_TASK
    k = F.col(key)
    frequent = F.call_function("approx_top_k", F.col("k"), F.lit(BUCKETS_PER_TASK), F.lit(1000))
    rows = (
        df.sample(fraction=fraction, seed=seed).select(k.alias("k")).groupBy(_key_id(F.col("k"), buckets).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count("k")).alias("nulls"), frequent.alias("top")).collect()
    )
    held = {r["b"]: r["n"] for r in rows}
    target = max(1.0, sum(held.values()) / tasks)
    heavy = []
    for r in rows:
        found = [(t["item"], t["count"]) for t in r["top"]] + [(None, r["nulls"])]
        for item, n in found:
            if n > target:
                heavy.append((item, n))
                held[r["b"]] -= n
    heavy.sort(key=lambda kn: (-kn[1], str(kn[0])))
    packed, light = pack_loads(heavy, sorted((b, max(0, n)) for b, n in held.items()), tasks, target)
    return LoadPlan(tasks, target, df.schema[key].dataType, packed, light)


def _tables(spark: SparkSession, plan: LoadPlan) -> tuple[DataFrame, DataFrame]:
    heavy = T.StructType([T.StructField("_rs_hk", plan.key_type), T.StructField("_rs_tasks", T.ArrayType(T.IntegerType()))])
    light = T.StructType([T.StructField("_rs_b", T.IntegerType()), T.StructField("_rs_lt", T.IntegerType())])
    # both tables have at most `tasks` (times BUCKETS_PER_TASK) rows, whatever the data
    return F.broadcast(spark.createDataFrame(plan.heavy, heavy)), F.broadcast(spark.createDataFrame(plan.light, light))


def _routed(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    heavy, light = _tables(df.sparkSession, plan)
    return (
        df.withColumn("_rs_b", _key_id(F.col(key), plan.tasks * BUCKETS_PER_TASK))
        .join(heavy, F.col(key).eqNullSafe(F.col("_rs_hk")) & F.col("_rs_tasks").isNotNull(), "left")
        .join(light, "_rs_b", "left")
    )


def spread(df: DataFrame, key: str, plan: LoadPlan, shard_by: str) -> DataFrame:
    """``df`` with a column ``_rs_task``, each row moved to its task. Rows equal in ``key`` and ``shard_by`` meet in one task."""
    shard = F.pmod(F.xxhash64(F.col(shard_by)), F.size("_rs_tasks")) + 1
    # a bucket that the plan hasn't seen (rows added meanwhile) still gets a task
    task = F.when(F.col("_rs_tasks").isNotNull(), F.element_at("_rs_tasks", shard.cast("int"))).otherwise(F.coalesce("_rs_lt", F.pmod(F.col("_rs_b"), F.lit(plan.tasks))))
    routed = _routed(df, key, plan).withColumn(TASK, task.cast("int")).drop("_rs_b", "_rs_hk", "_rs_tasks", "_rs_lt")
    return routed.repartitionById(plan.tasks, F.col(TASK))


def replicate(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """The matching side: each row copied to the tasks that hold shards of its key, and to no others."""
    one = F.array(F.coalesce("_rs_lt", F.pmod(F.col("_rs_b"), F.lit(plan.tasks))).cast("int"))
    copies = F.when(F.col("_rs_tasks").isNotNull(), F.array_distinct("_rs_tasks")).otherwise(one)
    return _routed(df, key, plan).withColumn(TASK, F.explode(copies)).drop("_rs_b", "_rs_hk", "_rs_tasks", "_rs_lt").repartitionById(plan.tasks, F.col(TASK))


def balanced_join(left: DataFrame, right: DataFrame, key: str, *, shard_by: str, plan: LoadPlan | None = None, how: str = "left") -> DataFrame:
    """Join of a skewed ``left`` with ``right`` on ``key``, balanced by the load of ``left``.

    ``how``: 'left' or 'inner'. A null key matches nothing. The result keeps
    ``_rs_task``, on which it is partitioned, so that an aggregation by
    (``_rs_task``, key, ...) needs no further shuffle.
    """
    if how not in ("left", "inner"):
        raise ValueError("only the left side is fragmented: how must be 'left' or 'inner'")
    plan = plan or plan_load(left, key)
    return spread(left, key, plan, shard_by).join(replicate(right.where(F.col(key).isNotNull()), key, plan), [TASK, key], how)


def metric_days(events: DataFrame, *, key: str = "name_hash", ts: str = "ts_ms", value: str = "value", event: str = "seq", plan: LoadPlan | None = None) -> DataFrame:
    """Per key and UTC day: events (repeated deliveries once), finite values, their sum, least and greatest.

    Columns: key, ``day_no`` (days since 1970), ``n_events``, ``n_values``,
    ``sum_value``, ``min_value``, ``max_value``. Null keys are a group of their
    own. Rows without a usable time must be left out before. Deliveries of one
    event are equal in all these columns and meet in one shard.
    """
    from rillstat.functions.events import is_finite, utc_day

    df = events.select(key, utc_day(F.col(ts)).alias("day_no"), F.col(event).alias("_rs_event"), F.col(value).alias("_rs_value"))
    plan = plan or plan_load(df, key)
    v = F.when(is_finite(F.col("_rs_value")), F.col("_rs_value"))
    once = spread(df, key, plan, "_rs_event").groupBy(TASK, key, "day_no", "_rs_event").agg(F.first(v).alias("_rs_v"))
    shards = once.groupBy(TASK, key, "day_no").agg(
        F.count(F.lit(1)).alias("n"), F.count("_rs_v").alias("nv"), F.sum("_rs_v").alias("s"), F.min("_rs_v").alias("lo"), F.max("_rs_v").alias("hi")
    )
    return shards.groupBy(key, "day_no").agg(
        F.sum("n").alias("n_events"), F.sum("nv").alias("n_values"), F.sum("s").alias("sum_value"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value")
    )


def dominant_keys(per_day: DataFrame, *, key: str = "name_hash", share: float = 0.03) -> DataFrame:
    """Keys with more than ``share`` of all events of a day. Events without a key count in the total but aren't a key.

    Both sides of the join are the same aggregation, whose shuffle is used
    twice: the test for a key stands in one condition with the day's total, so
    that it can't be moved below one side's shuffle and make them differ.
    """
    totals = per_day.groupBy(F.col("day_no").alias("_rs_day")).agg(F.sum("n_events").alias("day_events"))
    of_key = F.when(F.col(key).isNotNull(), F.col("n_events")).otherwise(0)
    met = per_day.join(totals, F.col("day_no").eqNullSafe(F.col("_rs_day")))
    return met.where(of_key > F.col("day_events") * F.lit(share)).select(key, "day_no", "n_events", "day_events")
