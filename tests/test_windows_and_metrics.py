"""Windows, the metric pipeline, registry, codec, export, store and privacy on small inputs."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from rillstat import local
from rillstat.operators import metrics, privacy, registry, windows
from rillstat.sources import codec, export, store

EVENT = "name_hash long, metric_type string, value double, item_hash long, ts_ms long, seq long"


def test_window_that_starts_with_the_first_event(spark):
    df = spark.createDataFrame([("k", 10, 10.0), ("k", 50, 20.0), ("k", 110, 30.0), ("k", None, 5.0)], "k string, t long, v double")
    r = windows.tumbling_from_first(df, "k", ts="t", value="v", width_ms=100, flush=False).collect()
    assert [(x.start_ms, x.end_ms, x.event_count, x.counter, x.gauge, x["mean"]) for x in r] == [(10, 110, 2, 0.0, 0.0, 15.0)]
    assert windows.tumbling_from_first(df, "k", ts="t", value="v", width_ms=100).count() == 2


def test_first_event_windows_against_a_sequential_model(spark):
    rnd = random.Random(4)
    rows = []
    for k in "abc":
        t = rnd.randrange(1, 500)
        for _ in range(60):
            rows.append((k, t, rnd.random()))
            t += rnd.choice([1, 30, 250])
    want = {}
    for k in "abc":
        start = None
        for _, t, v in [r for r in rows if r[0] == k]:
            if start is None:
                start = t
            elif t >= start + 100:
                start = t - t % 100
            want[k, start] = want.get((k, start), 0) + 1
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(5)
    got = {(r.k, r.start_ms): r.event_count for r in windows.tumbling_from_first(df, "k", ts="t", value="v", width_ms=100).collect()}
    assert got == want


def test_rollups(spark):
    df = spark.createDataFrame([("k", t, 100.0) for t in range(1, 60)], "k string, t long, v double")
    levels = {r.level: (r.start_ms, r.event_count, r["mean"]) for r in windows.rollup_of_means(df, "k", ts="t", value="v", widths_ms=[10, 50, 200]).collect()}
    assert levels[0] == (40, 10, pytest.approx(100)) and levels[0][2] == pytest.approx(100) and 2 not in levels
    wide = windows.rollup(df, ["k"], ts="t", value="v", widths_ms=[10, 50]).groupBy("level").agg(F.sum("event_count").alias("n")).collect()
    assert {r.level: r.n for r in wide} == {0: 59, 1: 59}
    with pytest.raises(ValueError):
        windows.rollup(df, ["k"], ts="t", value="v", widths_ms=[10, 25])


def test_sessions_and_hops(spark):
    df = spark.createDataFrame([("k", t, 1.0) for t in (0, 5, 50, 52)], "k string, t long, v double")
    assert sorted((r.start_ms, r.end_ms, r.event_count) for r in windows.sessions(df, ["k"], ts="t", value="v", gap_ms=10).collect()) == [(0, 15, 2), (50, 62, 2)]
    hops = {r.start_ms: r.event_count for r in windows.hopping(df, ["k"], ts="t", value="v", width_ms=20, hop_ms=10).collect()}
    assert hops == {-10: 2, 0: 2, 40: 2, 50: 2}


def stream(n=100):
    out = []
    for i in range(n):
        out += [(1, " Counter", 1.0, None, i, 3 * i), (2, "histogram", 10.0 + i % 20, None, i, 3 * i + 1), (3, "UNIQUE", None, int(local.hash_u64([i % 50])[0]) - 2**64 * (int(local.hash_u64([i % 50])[0]) >= 2**63), i, 3 * i + 2)]
    return out


def test_pipeline(spark):
    df = spark.createDataFrame(stream(), EVENT)
    r = {x.name_hash: x for x in metrics.snapshot(metrics.metric_state(df)).collect()}
    assert (r[1].counter, r[2].event_count, r[2]["mean"], r[2]["min"], r[2]["max"]) == (100, 100, 19.5, 10, 29)
    d = local.DDSketch(0.05, 256).insert([10.0 + i % 20 for i in range(100)])
    assert (r[2].p50, r[2].p95, r[2].p99) == pytest.approx(tuple(d.quantile(q) for q in (0.5, 0.95, 0.99)))
    assert r[3].cardinality == pytest.approx(local.HyperLogLog(10).insert_numbers(range(50)).cardinality()) and r[1].min == math.inf
    parts = [metrics.metric_state(df.where(F.col("seq") % 3 == k)) for k in range(3)]
    merged = metrics.snapshot(metrics.merge_states(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    assert sorted(merged.collect()) == sorted(r.values())
    assert metrics.get_slot(merged, 2).count() == 1 and metrics.get_slot(merged, 9).count() == 0


def test_pipeline_with_unsound_events(spark):
    rows = [(7, "gauge", 1.0, None, 5, 1), (7, "gauge", 2.0, None, 1, 2), (7, "gauge", None, None, 9, 3), (7, "counter", math.nan, None, None, 4), (7, "timer", 3.0, None, 1, 5), (7, None, 3.0, None, 1, 6), (7, "unique", 1.0, None, 1, 7), (None, "counter", 4.0, None, 1, 8)]
    r = {x.name_hash: x for x in metrics.snapshot(metrics.metric_state(spark.createDataFrame(rows, EVENT))).collect()}
    assert (r[7].gauge, r[7].counter, r[7].cardinality, r[7].event_count, r[7].p99) == (2.0, 0.0, 0.0, 7, 0.0)
    assert r[None].counter == 4.0
    assert metrics.snapshot(metrics.metric_state(spark.createDataFrame([], EVENT))).count() == 0


def test_slots(spark):
    rows = [(1, "counter", 10.0, None, 1, 2), (129, "counter", 20.0, None, 1, 1), (2, "counter", 5.0, None, 1, 3)]
    e = metrics.slots(spark.createDataFrame(rows, EVENT), 128)
    s = {r.slot_key: r.counter for r in metrics.snapshot(metrics.metric_state(e, key="slot_key"), "slot_key").collect()}
    assert s == {1: 30.0, 2: 5.0}
    assert {r.slot_key: r.name_hash for r in metrics.slot_owner(e).collect()} == {1: 129, 2: 2}


def test_ring_buffer():
    b = local.RingBuffer(4)
    assert [b.push(i) for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert (b.is_full(), b.dropped, [b.pop() for _ in range(4)]) == (True, 1, [1, 2, 3, None])


def test_registry(spark):
    names = spark.createDataFrame([("http.requests", "Counter "), ("http.requests", "counter"), ("x" * 80, "gauge"), ("y" * 63 + "é", "gauge"), (None, "gauge")], "name string, metric_type string")
    reg = registry.register(names)
    got = {(r.name, r.name_len, r.metric_type): r.name_hash for r in reg.collect()}
    assert got["http.requests", 13, "counter"] % 2**64 == 0xC142357BFBC2B5E1
    assert got["x" * 64, 64, "gauge"] % 2**64 == local.hash_bytes("x" * 80)
    assert ("", 64, "gauge") in got and len(got) == 3
    found = registry.lookup(reg, spark.createDataFrame([("x" * 80,), ("nope",)], "name string")).collect()
    assert {r.name: r.registered_type for r in found} == {"x" * 80: "gauge", "nope": None}
    by_hash = registry.lookup_by_hash(reg.unionByName(reg), spark.createDataFrame([(got["http.requests", 13, "counter"], 1), (5, 2), (None, 3)], "name_hash long, n int"))
    assert {r.n: r.registered_name for r in by_hash.collect()} == {1: "http.requests", 2: None, 3: None}


def test_payloads(spark):
    rows = [(1, "counter", 5, 1.5), (2, " GAUGE ", -1, -2.0), (3, "histogram", 2**63 - 1, math.inf), (4, "unique", -(2**63), 0.0), (5, "timer", 1, 1.0), (6, None, 1, 1.0), (7, "gauge", None, 1.0)]
    df = spark.createDataFrame(rows, "seq long, kind string, h long, v double")
    coded = df.select("seq", codec.encode_payload(F.col("kind"), F.col("h"), F.col("v")).alias("payload"))
    raw = {r.seq: r.payload for r in coded.collect()}
    assert bytes(raw[2]) == struct.pack("<Bqd", 1, -1, -2.0) and raw[5] is raw[6] is raw[7] is None
    more = spark.createDataFrame([(8, b"\x01\x02\x03"), (9, b"\xff" * 17), (10, bytes(raw[1]) + b"tail"), (11, b"")], "seq long, payload binary")
    got = {r.seq: (r.metric_type, r.name_hash, r.value, r.is_error) for r in codec.decode_payloads(coded.unionByName(more)).collect()}
    assert got[1] == got[10] == ("counter", 5, 1.5, False) and got[3] == ("histogram", 2**63 - 1, math.inf, False)
    assert [k for k, v in got.items() if v[3]] == [5, 6, 7, 8, 9, 11] and got[9][:3] == (None, None, None)


def test_queue(spark):
    rows = [(i, "counter", 1, 1.0) for i in range(5)] + [(10 + i, "gauge", 1, 50.0 + 10 * i) for i in range(3)] + [(20 + i, "histogram", 1, v) for i, v in enumerate((10.0, 20.0, 30.0, 100.0))] + [(30, "unique", 1, 1.8e19), (31, "unique", 1, 1.8e19), (32, "unique", 1, 5.0)]
    df = spark.createDataFrame(rows, "seq long, kind string, h long, v double").select("seq", codec.encode_payload(F.col("kind"), F.col("h"), F.col("v")).alias("payload"))
    state, counts = codec.consume(df.unionByName(spark.createDataFrame([(99, b"no")], "seq long, payload binary")))
    r = metrics.snapshot(state).first()
    assert (r.counter, r.gauge, r.event_count, round(r.cardinality), r["max"]) == (5, 70, 15, 2, 100)
    assert tuple(counts.first()) == (16, 1)


SNAP = "name_hash long, counter double, gauge double, cardinality double, p50 double, p95 double, p99 double, mean double, min double, max double, event_count long"


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(12345, 100.0, 42.0, 50.0, 25.0, 80.0, 99.5, 45.0, math.nan, math.inf, 1000), (-1, 1e21, -0.25, 1e-7, 0.0, 0.0, 0.0, 0.1, -math.inf, 200.0, 0)], SNAP)
    js = {r.name_hash: r.json for r in export.to_json(df).collect()}
    assert js[12345] == '{"name_hash":12345,"counter":100,"gauge":42,"cardinality":50,"p50":25,"p95":80,"p99":99.5,"mean":45,"min":null,"max":"+Inf","event_count":1000}'
    assert js[-1].startswith('{"name_hash":18446744073709551615,"counter":1000000000000000000000,"gauge":-0.25,"cardinality":0.0000001,') and '"min":"-Inf"' in js[-1]
    text = {r.name_hash: r.text for r in export.to_prometheus(df, "x").collect()}[12345]
    assert '# TYPE x_counter counter\nx_counter{name_hash="12345"} 100\n' in text and 'x_latency{name_hash="12345",quantile="0.99"} 99.5\n' in text and text.endswith('x_events_total{name_hash="12345"} 1000\n')
    assert export.json_array(df).first().json.count("name_hash") == 2 and export.json_array(df.limit(0)).first().json == "[]"
    export.write_json_lines(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    export.write_prometheus(df, f"{tmp_path}/p", "x")
    assert spark.read.text(f"{tmp_path}/p").where(F.col("value").startswith("# TYPE")).count() == 8


def test_store(spark, tmp_path):
    path = f"{tmp_path}/store"
    df = spark.createDataFrame([(1000, 42.0, 7), (90_000_000, 43.0, 7), (None, 1.0, 7), (5, None, 7)], "t long, v double, k long")
    store.record(store.points(df, "cardinality", ts="t", value="v", key="k"), path)
    store.record(store.points(df, "quantile", ts="t", value="v"), path)
    assert [(r.ts_ms, r.name_hash, r.value) for r in store.query(spark, path, "cardinality", 0, 2000).collect()] == [(1000, 7, 42.0)]
    q = store.query(spark, path, "quantile", 1000, 90_000_000)
    assert q.count() == 2 and store.query(spark, path, "anomaly", 0, 10**12).count() == 0
    assert "PartitionFilters: [isnotnull(kind" in q._jdf.queryExecution().executedPlan().toString()
    store.sink(path, "anomaly", ts="t", value="v")(df, 0)
    assert store.query(spark, path, "anomaly", 0, 10**12).count() == 2
    with pytest.raises(ValueError):
        store.points(df, "other", ts="t", value="v")


def test_generator_and_laplace():
    x = local.XorShift64(42)
    assert [x.next_u64() for _ in range(3)] == [45454805674, 11532217803599905471, 10021416941527320954]
    n = local.LaplaceNoise(1, 1, 42)
    assert [n.sample() for _ in range(3)] == pytest.approx([-19.128288, 0.288116, 0.090498], abs=1e-6)
    n = local.LaplaceNoise(1, 1, 42)
    assert abs(sum(n.sample() for _ in range(10_000))) / 10_000 < 0.1
    assert local.XorShift64(0).state == local.XorShift64.ZERO


def test_private_aggregator_and_reports_in_memory():
    a = local.PrivateAggregator(2.0)
    assert (a.estimate_mean(), a.standard_error()) == (0.0, math.inf)
    a.add(10)
    a.add(20)
    assert (a.estimate_sum(), a.estimate_mean(), a.standard_error()) == (30, 15, 2.0)
    assert local.Rappor.bits(12345) == {4, 34, 49}
    r = local.Rappor(42)
    reports = [r.privatize(12345) for _ in range(3000)]
    assert len(reports[0]) == 64
    low, high = 0.375, 0.625
    assert all(abs((sum(x[i] for x in reports) / 3000 - low) / (high - low) - (i in (4, 34, 49))) < 0.15 for i in range(64))


def test_events_of_all_kinds(spark):
    df = spark.createDataFrame([(5, 1, 1, 2.5)], "k long, t long, o long, v double")
    e = metrics.events_from(df, key="k", ts="t", order="o", counter=F.lit(1), gauge=F.col("v"), histogram=F.col("v"), unique=F.lit(77).cast("long"))
    assert sorted(r.metric_type for r in e.collect()) == ["counter", "gauge", "histogram", "unique"]
    assert tuple(metrics.pipeline_counts(metrics.metric_state(e)).first()) == (4, 1)
    assert tuple(metrics.pipeline_counts(metrics.metric_state(e.limit(0))).first()) == (0, 0)


def test_budget(spark):
    b = local.PrivacyBudget(1.0)
    assert [b.try_spend(0.3) for _ in range(4)] == [True, True, True, False] and b.spent == pytest.approx(0.9) and b.query_count == 3
    df = spark.createDataFrame([("a", i, 0.3) for i in range(4)] + [("a", 4, 0.1), ("a", 5, None), (None, 1, 2.0), (None, 2, 1.0)], "k string, o int, e double")
    led = privacy.budget(df, key="k", order="o", epsilon="e", limit=1.0)
    got = {(r.k, r.o): r.accepted for r in led.collect()}
    assert [got["a", i] for i in range(6)] == [True, True, True, False, True, False] and (got[None, 1], got[None, 2]) == (False, True)
    s = {r.k: r for r in privacy.budget_summary(led, "k", 1.0).collect()}
    assert s["a"].query_count == 4 and s[None].exhausted and not s["a"].exhausted


def test_noise_of_columns(spark):
    df = spark.range(20_000).withColumn("noisy", privacy.laplace(F.lit(5.0), F.col("id"), seed=1, sensitivity=2.0, epsilon=1.0))
    r = privacy.private_aggregate(df, [], "noisy", 2.0).first()
    assert abs(r.estimate_mean - 5) < 5 * r.standard_error and r["count"] == 20_000
    assert df.select(F.avg(F.abs(F.col("noisy") - 5))).first()[0] == pytest.approx(2, rel=0.05)
    again = spark.range(20_000).repartition(9).withColumn("noisy", privacy.laplace(F.lit(5.0), F.col("id"), seed=1, sensitivity=2.0, epsilon=1.0))
    assert df.join(again.withColumnRenamed("noisy", "b"), "id").where("noisy <> b").count() == 0
    none = privacy.private_aggregate(df.where("id < 0"), [], "noisy", 2.0).first()
    assert (none["count"], none.estimate_mean, none.standard_error) == (0, 0, math.inf)


def test_randomized_response(spark):
    p = 0.8
    df = spark.range(10_000).select(privacy.randomized_response(F.col("id") < 3000, F.col("id"), seed=3, p=p).alias("s"))
    share = df.agg(privacy.estimate_proportion(p, F.count("s"), F.sum(F.col("s").cast("long"))).alias("x")).first().x
    assert abs(share - 0.3) < 0.05
    rr = local.RandomizedResponse(42, p=p)
    yes = sum(rr.privatize(i < 3000) for i in range(10_000))
    assert abs(rr.estimate_proportion(10_000, yes) - 0.3) < 0.1 and rr.estimate_proportion(0, 0) == 0
    assert privacy.truth_probability(1.0) > privacy.truth_probability(1.0, calibrated=True)
    assert privacy.effective_epsilon(privacy.truth_probability(1.0, calibrated=True)) == pytest.approx(1.0)


def test_rappor(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") < 4000, 7).otherwise(9).cast("long").alias("v"))
    rep = df.select(privacy.rappor(F.col("v"), F.col("id"), seed=5).alias("r"))
    assert rep.where(F.size("r") == 64).count() == 6000
    counts = privacy.rappor_counts(rep, [], "r")
    est = {r.v: r.estimate for r in privacy.rappor_decode(counts, [], spark.createDataFrame([(7,), (9,), (123,)], "v long"), "v").collect()}
    assert abs(est[7] - 4000) < 700 and abs(est[9] - 2000) < 700 and est[123] < 900
    assert spark.range(1).select(privacy.rappor(F.lit(None).cast("long"), F.col("id"), seed=5).alias("r")).first().r is None
