"""Time-series store: (``kind``, ``ts_ms``, ``name_hash``, ``value``) rows in a Parquet folder, partitioned by kind and day.

A range query prunes partitions by kind and day and pushes the exact time bounds
to the scan. Values are doubles; errors are raised, never swallowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstat.functions.events import DAY_MS, utc_day

KINDS = ("cardinality", "quantile", "anomaly")


def points(df: DataFrame, kind: str, *, ts: str, value: str, key: str | None = None) -> DataFrame:
    """Rows of ``df`` as store rows; null times or values are left out."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    name = F.col(key) if key else F.lit(None).cast("long")
    rows = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
    return rows.select(F.lit(kind).alias("kind"), F.col(ts).cast("long").alias("ts_ms"), name.alias("name_hash"), F.col(value).cast("double").alias("value"))


def record(rows: DataFrame, path: str) -> None:
    """Appends store rows. Rows are grouped by partition first, so that a day gets few files, however many tasks write; a large partition is split by size."""
    out = rows.withColumn("day_no", utc_day(F.col("ts_ms")))
    out.hint("rebalance", "kind", "day_no").write.mode("append").partitionBy("kind", "day_no").parquet(path)


def query(spark: SparkSession, path: str, kind: str, from_ms: int, to_ms: int) -> DataFrame:
    """(``ts_ms``, ``name_hash``, ``value``) of one kind with from_ms <= ts_ms <= to_ms."""
    df = spark.read.parquet(path)
    near = (F.col("kind") == kind) & F.col("day_no").between(from_ms // DAY_MS, to_ms // DAY_MS)
    return df.where(near & F.col("ts_ms").between(from_ms, to_ms)).select("ts_ms", "name_hash", "value")


def sink(path: str, kind: str, *, ts: str, value: str, key: str | None = None):
    """Function for ``writeStream.foreachBatch``: records each micro-batch."""

    def write(batch: DataFrame, _: int) -> None:
        record(points(batch, kind, ts=ts, value=value, key=key), path)

    return write
