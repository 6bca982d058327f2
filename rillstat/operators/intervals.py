"""Join of readings with the time intervals that contain them.

A range join without a cross product: every interval is copied to the buckets
of time that it touches, every reading lies in one bucket, and the two meet in
an equi-join on (key, bucket, shard). Buckets split a key over time; shards
split a bucket of a hot key once more, at the price of as many copies of the
(much smaller) intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY, TS, START, END = "_rs_key", "_rs_ts", "_rs_start", "_rs_end"


def _bucket(c: Column, bucket_ms: int) -> Column:
    return F.floor(c / F.lit(float(bucket_ms))).cast("long")


def attach_intervals(
    readings: DataFrame,
    intervals: DataFrame,
    *,
    key: str,
    ts: str,
    start: str,
    end: str,
    keep: tuple[str, ...] = (),
    carry: tuple[str, ...] = (),
    bucket_ms: int = 3_600_000,
    shards: int = 1,
    shard_by: str | None = None,
    dedupe: bool = False,
) -> DataFrame:
    """Pairs (interval, reading) with ``start <= ts < end`` and equal key.

    ``keep`` names columns of the readings, ``carry`` columns of the intervals
    that the result has besides key, ts, start and end. Repeated intervals count
    once. With ``dedupe``, readings equal in all kept columns count once
    (deliveries of one event); they meet in one shard, as ``shard_by`` is equal
    for them, so this costs no further shuffle. Null keys, times or bounds match
    nothing; an interval that doesn't end after its start contains nothing. A
    reading inside several intervals is returned with each.
    """
    salt = F.pmod(F.xxhash64(F.col(shard_by)), F.lit(shards)).cast("int") if shards > 1 else F.lit(0)
    r = readings.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias(KEY), F.col(ts).alias(TS), _bucket(F.col(ts), bucket_ms).alias("_rs_b"), salt.alias("_rs_s"), *[F.col(c) for c in keep if c not in (key, ts)]
    )
    on = [KEY, "_rs_b", "_rs_s"]
    if dedupe:
        r = r.repartition(*on).dropDuplicates()
    w = (
        intervals.where((F.col(end) > F.col(start)) & F.col(key).isNotNull())
        .select(F.col(key).alias(KEY), F.col(start).alias(START), F.col(end).alias(END), *[F.col(c).alias(f"_rs_c_{c}") for c in carry])
        .dropDuplicates()
        .withColumn("_rs_b", F.explode(F.sequence(_bucket(F.col(START), bucket_ms), _bucket(F.col(END) - 1, bucket_ms))))
        .withColumn("_rs_s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))) if shards > 1 else F.lit(0))
    )
    # sorted on both sides: the exploded intervals grow with the data, so they are never broadcast
    met = r.join(w.hint("merge"), on).where((F.col(TS) >= F.col(START)) & (F.col(TS) < F.col(END)))
    return met.select(
        F.col(KEY).alias(key), F.col(TS).alias(ts), F.col(START).alias(start), F.col(END).alias(end), *[F.col(f"_rs_c_{c}").alias(c) for c in carry], *[c for c in keep if c not in (key, ts)]
    )
