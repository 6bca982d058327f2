"""Windowed streams: mergeable sketches of closed windows, window statistics, sessions and metric states.

A watermark bounds the state: windows close once it has passed their end, and
rows later than it are left out. Output is in append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstat.functions.events import is_finite
from rillstat.operators import metrics
from rillstat.operators.quantile import slot_of


def _watermarked(df: DataFrame, ts: str, late: str) -> DataFrame:
    """``ts`` is epoch milliseconds."""
    return df.where(F.col(ts).isNotNull()).withColumn("_rs_time", F.timestamp_millis(F.col(ts))).withWatermark("_rs_time", late)


def window_sketches(df: DataFrame, by: list[str], *, ts: str, value: str, width_ms: int, late: str = "0 seconds", a: float = 0.01, bins: int = 2048) -> DataFrame:
    """The sketch rows of ``operators.windows.window_sketch`` for each window that has closed; ``window_result`` and ``dd_merge`` read what a sink has stored of them."""
    v, ok = F.col(value), is_finite(F.col(value))
    rows = _watermarked(df, ts, late).where(v.isNotNull()).select(*by, "_rs_time", F.when(ok, v).alias("_rs_v"), F.when(ok, slot_of(F.when(ok, v), a, bins)).alias("slot"), ok.alias("_rs_ok"))
    part = F.when(~F.col("_rs_ok"), "bad").when(F.col("slot").isNull(), "dropped").otherwise("bin")
    out = rows.groupBy(F.window("_rs_time", f"{width_ms} milliseconds").alias("_rs_w"), *by, part.alias("part"), "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("_rs_v").alias("sum"), F.min("_rs_v").alias("min"), F.max("_rs_v").alias("max"))
    return out.select(*by, F.unix_millis("_rs_w.start").alias("start_ms"), "part", "slot", "n", "sum", "min", "max")


def window_stats(df: DataFrame, by: list[str], *, ts: str, value: str, width_ms: int, hop_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """Count, mean, extremes and approximate median and p99 of each closed tumbling (or hopping) window."""
    w = F.window("_rs_time", f"{width_ms} milliseconds", f"{hop_ms or width_ms} milliseconds")
    q = F.percentile_approx(value, [0.5, 0.99], 1000)
    out = _watermarked(df, ts, late).groupBy(w.alias("_rs_w"), *by).agg(F.count(value).alias("event_count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("_rs_q"))
    return out.select(*by, F.unix_millis("_rs_w.start").alias("start_ms"), F.unix_millis("_rs_w.end").alias("end_ms"), "event_count", "mean", "min", "max", F.col("_rs_q")[0].alias("p50"), F.col("_rs_q")[1].alias("p99"))


def session_stats(df: DataFrame, by: list[str], *, ts: str, value: str, gap_ms: int, late: str = "0 seconds") -> DataFrame:
    """Count and sum of each closed session."""
    out = _watermarked(df, ts, late).groupBy(F.session_window("_rs_time", f"{gap_ms} milliseconds").alias("_rs_w"), *by).agg(F.count(F.lit(1)).alias("event_count"), F.sum(value).alias("sum"))
    return out.select(*by, F.unix_millis("_rs_w.start").alias("start_ms"), F.unix_millis("_rs_w.end").alias("end_ms"), "event_count", "sum")


class MetricStore:
    """Metric states of micro-batches in a Parquet folder. States merge without loss, so a snapshot of the folder is that of all events.

    A micro-batch that is run again replaces what it wrote before. ``compact``
    merges the parts; it must not run beside the stream.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def sink(self):
        """Function for ``writeStream.foreachBatch`` over events."""

        def write(batch: DataFrame, epoch: int) -> None:
            metrics.metric_state(batch).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

        return write

    def states(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("epoch")

    def snapshot(self) -> DataFrame:
        return metrics.snapshot(metrics.merge_states(self.states()))

    def compact(self, to: str) -> None:
        """Writes the merged state to another folder, as one part."""
        metrics.merge_states(self.states()).write.mode("overwrite").parquet(f"{to}/epoch=0")
