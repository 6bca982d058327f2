"""Streams give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from rillstat.operators import anomaly, metrics, series, windows
from rillstat.streaming import folds
from rillstat.streaming import windows as live

SCHEMA = "k string, t long, o long, v double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Rows in order of time, in three files that arrive one after the other."""
    path = str(tmp_path_factory.mktemp("stream"))
    rnd, t = random.Random(8), 1_000_000
    rows = []
    for o in range(300):
        t += rnd.choice([1, 700, 9000])
        rows.append((rnd.choice("ab"), t, o, rnd.gauss(5, 1) + 50 * (rnd.random() < 0.03)))
    for i in range(3):
        spark.createDataFrame(rows[100 * i : 100 * i + 100], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def run(df, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/o").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return df.sparkSession.read.parquet(f"{tmp_path}/o")


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


ON = {"key": "k", "ts": "t", "value": "v", "order": "o"}


def test_detectors(spark, folder, tmp_path):
    got = {r.o: (r.score, r.anomaly) for r in run(folds.detect(source(spark, folder), **ON), tmp_path).collect()}
    want = {r.o: (r.score, r.anomaly) for r in anomaly.composite(spark.read.parquet(folder), **ON).collect()}
    assert got.keys() == want.keys()
    assert all(got[o][1] == want[o][1] and got[o][0] == pytest.approx(want[o][0], rel=1e-6) for o in want)


def test_callback(spark, folder, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    q = folds.detect(source(spark, folder), **ON, detector="mad").writeStream.foreachBatch(folds.on_anomaly(lambda row: seen.add(1))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert seen.value == anomaly.mad(spark.read.parquet(folder), **ON).where("mad_anomaly").count() > 0


def test_averages_and_rates(spark, folder, tmp_path):
    got = {r.o: r.ema for r in run(folds.ema(source(spark, folder), **ON, weight=0.2), tmp_path / "a").collect()}
    assert got == pytest.approx({r.o: r.ema for r in series.ema(spark.read.parquet(folder), **ON, weight=0.2).collect()})
    rate = {r.o: r.rate for r in run(folds.change_rate(source(spark, folder), **ON), tmp_path / "b").collect()}
    want = {r.o: r.rate for r in series.change_rate(spark.read.parquet(folder), **ON).collect()}
    assert {o: None if x is None else round(x, 9) for o, x in rate.items()} == {o: None if x is None else round(x, 9) for o, x in want.items()}


def test_closed_windows(spark, folder, tmp_path):
    stored = run(live.window_sketches(source(spark, folder), ["k"], ts="t", value="v", width_ms=60_000), tmp_path)
    got = {(r.k, r.start_ms): r for r in windows.window_result(stored, ["k"], 60_000).collect()}
    want = {(r.k, r.start_ms): r for r in windows.tumbling(spark.read.parquet(folder), ["k"], ts="t", value="v", width_ms=60_000).collect()}
    assert got and all(abs(want[x]["mean"] - r["mean"]) < 1e-9 and want[x].p99 == r.p99 and want[x].event_count == r.event_count for x, r in got.items())
    last = max(s for _, s in want)
    assert {x for x in want if x[1] < last} - set(got) == set()


def test_window_statistics_and_sessions(spark, folder, tmp_path):
    got = run(live.window_stats(source(spark, folder), ["k"], ts="t", value="v", width_ms=60_000), tmp_path / "a").collect()
    want = {(r.k, r.start_ms): r.event_count for r in windows.tumbling(spark.read.parquet(folder), ["k"], ts="t", value="v", width_ms=60_000).collect()}
    assert got and all(want[r.k, r.start_ms] == r.event_count for r in got)
    ses = run(live.session_stats(source(spark, folder), ["k"], ts="t", value="v", gap_ms=15_000), tmp_path / "b").collect()
    batch = {(r.k, r.start_ms): r.event_count for r in windows.sessions(spark.read.parquet(folder), ["k"], ts="t", value="v", gap_ms=15_000).collect()}
    assert ses and all(batch[r.k, r.start_ms] == r.event_count for r in ses)


def test_metric_store(spark, folder, tmp_path):
    events = source(spark, folder).select(F.crc32("k").alias("name_hash"), F.lit("histogram").alias("metric_type"), F.col("v").alias("value"), F.lit(None).cast("long").alias("item_hash"), F.col("t").alias("ts_ms"), F.col("o").alias("seq"))
    st = live.MetricStore(spark, f"{tmp_path}/m")
    q = events.writeStream.foreachBatch(st.sink()).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(240)
    batch = spark.read.parquet(folder).select(F.crc32("k").alias("name_hash"), F.lit("histogram").alias("metric_type"), F.col("v").alias("value"), F.lit(None).cast("long").alias("item_hash"), F.col("t").alias("ts_ms"), F.col("o").alias("seq"))
    want = {r.name_hash: (r.event_count, r.p50, r.p99, r["max"]) for r in metrics.snapshot(metrics.metric_state(batch)).collect()}
    assert {r.name_hash: (r.event_count, r.p50, r.p99, r["max"]) for r in st.snapshot().collect()} == want
    st.compact(f"{tmp_path}/m2")
    assert {r.name_hash: (r.event_count, r.p50, r.p99, r["max"]) for r in live.MetricStore(spark, f"{tmp_path}/m2").snapshot().collect()} == want
