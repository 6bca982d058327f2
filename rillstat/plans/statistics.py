"""Queries of the statistics operators over whole tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstat.functions.events import timed_events
from rillstat.functions.hashing import hash_bytes, hash_long, hash_pair
from rillstat.operators import anomaly, cardinality, frequency, metrics, privacy, quantile, registry, series, stats, windows
from rillstat.sources import codec, export, table

SEED = "rillstat-check"
HOUR, SIX_HOURS, DAY = 3_600_000, 21_600_000, 86_400_000


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The event stream with epoch milliseconds."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000)).cast("long")
    return table(spark, d, "events").select("event_id", ms.alias("ts_ms"), "user_id", "event_type", "value")


SERIES = {"key": "event_type", "ts": "ts_ms", "value": "value", "order": "event_id"}


def _f(c: Column) -> Column:
    """Rounded to FLOAT: sums depend on the order of their terms. Unlike a number of digits it keeps the magnitude and meets no ties."""
    return c.cast("float").cast("double")


def _r(c: str) -> Column:
    return _f(F.col(c)).alias(c)


# hashes and distinct counts


def fnv_hash_u64(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hash_long(F.col("l_orderkey")).alias("h"))


def fnv_hash_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", hash_bytes(F.col("c_name")).alias("h"), hash_bytes(F.col("c_name"), as_text_value=True).alias("h_text"))


def fnv_hash_u128(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", hash_pair(F.col("o_orderkey"), F.col("o_custkey")).alias("h"))


def _part_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", hash_long(F.col("l_partkey")).alias("h"))


def hll_cardinality(spark: SparkSession, d: str) -> DataFrame:
    """All four sizes of registers."""
    rows, out = _part_hashes(spark, d), None
    for p in (10, 12, 14, 16):
        one = cardinality.hll_estimate(cardinality.hll_build(rows, ["l_returnflag"], "h", p), ["l_returnflag"], p).withColumn("p", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out.select("l_returnflag", "p", _r("cardinality"))


def hll_merge(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of (flag, status) united per flag."""
    parts = cardinality.hll_build(_part_hashes(spark, d), ["l_returnflag", "l_linestatus"], "h", 14)
    return cardinality.hll_estimate(cardinality.hll_merge(parts, ["l_returnflag"]), ["l_returnflag"], 14).select("l_returnflag", _r("cardinality"))


def approx_distinct_builtin(spark: SparkSession, d: str) -> DataFrame:
    return cardinality.hll_builtin(table(spark, d, "lineitem"), ["l_returnflag"], "l_partkey", 14)


# quantiles


def dd_quantiles(spark: SparkSession, d: str) -> DataFrame:
    s = quantile.dd_build(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.01, 2048)
    return quantile.dd_quantiles(s, ["l_returnflag"], [0.5, 0.95, 0.99], 0.01, 2048).select("l_returnflag", "q", _r("estimate"))


def dd_signed(spark: SparkSession, d: str) -> DataFrame:
    """Negative values too, in few bins, so that some values are beyond them."""
    s = quantile.dd_build(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", 0.02, 256)
    return quantile.dd_quantiles(s, ["c_mktsegment"], [0.05, 0.5, 0.99], 0.02, 256).select("c_mktsegment", "q", _r("estimate"))


def dd_merge(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of (flag, status) merged per flag: statistics and middle estimates."""
    parts = quantile.dd_build(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.01, 2048)
    m = quantile.dd_merge(parts, ["l_returnflag"])
    q = quantile.dd_quantiles(m, ["l_returnflag"], [0.9], 0.01, 2048, middle=True).select("l_returnflag", _f(F.col("estimate")).alias("p90_middle"))
    s = quantile.dd_stats(m, ["l_returnflag"]).select("l_returnflag", "count", _r("sum"), _r("mean"), "min", "max", "dropped", "non_finite")
    return s.join(q, "l_returnflag")


# frequencies


def _customer_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus", hash_long(F.col("o_custkey")).alias("h"))


def cms_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = _customer_hashes(spark, d)
    return frequency.cms_estimate(frequency.cms_build(rows, "h", width=1024, depth=5), rows, "h", width=1024, depth=5)


def cms_merge(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each order status, merged: equal to those of all orders."""
    return _merged_counters(spark, d).select("row", "col", "n")


def cms_total(spark: SparkSession, d: str) -> DataFrame:
    """What merged counters have counted, and by how much an estimate may exceed the truth."""
    total = frequency.cms_total(_merged_counters(spark, d))
    return total.select("total", F.round(F.lit(frequency.cms_error_bound(2048)) * F.col("total"), 6).alias("error_bound"), F.lit(round(frequency.cms_confidence(7), 9)).alias("confidence"))


def _merged_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = _customer_hashes(spark, d)
    parts = None
    for s in ("O", "F", "P"):
        one = frequency.cms_build(rows.where(F.col("o_orderstatus") == s), "h", width=2048, depth=7)
        parts = one if parts is None else parts.unionByName(one)
    return frequency.cms_merge(parts)


def heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    return frequency.heavy_hitters(table(spark, d, "orders"), "o_custkey", 20)


def heavy_hitters_estimated(spark: SparkSession, d: str) -> DataFrame:
    return frequency.heavy_hitters_estimated(_customer_hashes(spark, d), "h", 10)


# statistics


def percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    return stats.percentile_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 25.0).select("l_returnflag", _r("percentile_rank"))


def iqr(spark: SparkSession, d: str) -> DataFrame:
    out = stats.iqr(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", *[_r(c) for c in ("q1", "median", "q3", "iqr", "lower_fence", "upper_fence")])


def quantile_linear(spark: SparkSession, d: str) -> DataFrame:
    out = stats.quantile_linear(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal", [0.0, 0.1, 0.5, 0.99, 1.0])
    return out.select("c_nationkey", "q", _r("value"))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def covariance_matrix(spark: SparkSession, d: str) -> DataFrame:
    out = stats.covariance_matrix(table(spark, d, "lineitem"), ["l_returnflag"], _MEASURES)
    return out.select("l_returnflag", "row", "col", _r("covariance"), _r("correlation"), "count")


def streaming_stats(spark: SparkSession, d: str) -> DataFrame:
    out = stats.moments(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")
    return out.select("l_returnflag", "count", *[_r(c) for c in ("mean", "variance", "sample_variance", "std_dev", "skewness", "kurtosis")], "min", "max")


def linreg(spark: SparkSession, d: str) -> DataFrame:
    """Model of price by quantity, with its prediction at 30."""
    m = stats.linear_regression(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return m.select("l_returnflag", "count", _r("slope"), _r("intercept"), _r("r_squared"), _f(stats.predict(m, 30.0)).alias("at_30"))


# series


def change_rate(spark: SparkSession, d: str) -> DataFrame:
    return series.change_rate(_events(spark, d), **SERIES).select("event_type", "event_id", _r("rate"))


def ema_series(spark: SparkSession, d: str) -> DataFrame:
    return series.ema(_events(spark, d), **SERIES, weight=series.smoothing(9)).select("event_type", "event_id", _r("ema"))


def ema_final(spark: SparkSession, d: str) -> DataFrame:
    return series.ema_final(_events(spark, d), **SERIES, weight=0.1).select("event_type", _r("ema"), "count")


def sma(spark: SparkSession, d: str) -> DataFrame:
    return series.sma(_events(spark, d), **SERIES, n=20).select("event_type", "event_id", _r("sma"))


# windows

_RESULT = ["end_ms", "event_count", "counter", "gauge"]


def _window_rows(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, "start_ms", *_RESULT, _r("mean"), "min", "max", _r("p50"), _r("p99"))


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _window_rows(windows.tumbling(_events(spark, d), ["event_type"], ts="ts_ms", value="value", width_ms=HOUR), "event_type")


def tumbling_compat(spark: SparkSession, d: str) -> DataFrame:
    """Windows that start with the first event; the open one is flushed."""
    return _window_rows(windows.tumbling_from_first(_events(spark, d), "event_type", ts="ts_ms", value="value", width_ms=SIX_HOURS), "event_type")


def rollup_3level(spark: SparkSession, d: str) -> DataFrame:
    return _window_rows(windows.rollup(_events(spark, d), ["event_type"], ts="ts_ms", value="value", widths_ms=[HOUR, SIX_HOURS, DAY]), "event_type", "level")


def rollup_of_means(spark: SparkSession, d: str) -> DataFrame:
    return _window_rows(windows.rollup_of_means(_events(spark, d), "event_type", ts="ts_ms", value="value", widths_ms=[HOUR, SIX_HOURS, DAY], a=0.05, bins=256), "event_type", "level")


def sliding_stats(spark: SparkSession, d: str) -> DataFrame:
    out = windows.sliding(_events(spark, d), **SERIES, n=50)
    return out.select("event_type", "event_id", "win_count", *[_r(f"win_{c}") for c in ("sum", "mean")], "win_min", "win_max", _r("win_var"), _r("win_std"))


def hopping(spark: SparkSession, d: str) -> DataFrame:
    out = windows.hopping(_events(spark, d), ["event_type"], ts="ts_ms", value="value", width_ms=SIX_HOURS, hop_ms=HOUR)
    return out.select("event_type", "start_ms", "end_ms", "event_count", _r("sum"), _r("mean"))


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    out = windows.sessions(_events(spark, d), ["event_type"], ts="ts_ms", value="value", gap_ms=1_800_000)
    return out.select("event_type", "start_ms", "end_ms", "event_count", _r("sum"))


# anomaly detectors


def streaming_median(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.streaming_median(_events(spark, d), **SERIES).select("event_type", "event_id", _r("median"))


def mad_score(spark: SparkSession, d: str) -> DataFrame:
    out = anomaly.mad(_events(spark, d), **SERIES)
    return out.select("event_type", "event_id", _r("mad_median"), _r("mad"), _r("mad_score"), "mad_anomaly")


def ewma_detect(spark: SparkSession, d: str) -> DataFrame:
    out = anomaly.ewma(_events(spark, d), **SERIES)
    return out.select("event_type", "event_id", _r("ewma"), _r("ewma_std"), _r("ewma_score"), "ewma_anomaly")


def zscore(spark: SparkSession, d: str) -> DataFrame:
    out = anomaly.zscore(_events(spark, d), **SERIES)
    return out.select("event_type", "event_id", _r("z_mean"), _r("z_std"), F.when(F.col("z_score") == math.inf, None).otherwise(_f(F.col("z_score"))).alias("z_score"), "z_anomaly")


def composite(spark: SparkSession, d: str) -> DataFrame:
    out = anomaly.composite(_events(spark, d), **SERIES)
    return out.select("event_type", "event_id", F.when(F.col("score") == math.inf, None).otherwise(_f(F.col("score"))).alias("score"), "anomaly")


def anomaly_events(spark: SparkSession, d: str) -> DataFrame:
    """The anomalies on which all three detectors agree."""
    judged = anomaly.composite(_events(spark, d), **SERIES, consensus=True)
    return anomaly.anomaly_events(judged, key="event_type", ts="ts_ms", value="value").select("metric_id", "timestamp", "value", _r("score"), _r("expected"))


# metric pipeline


def _stream_as_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each event of the stream as a counter, a gauge, a histogram value and a distinct user of the metric of its type."""
    e, value = _events(spark, d), F.col("value")
    return metrics.events_from(e, key=hash_bytes(F.col("event_type")), ts="ts_ms", order="event_id", counter=F.lit(1.0), gauge=value, histogram=value, unique=hash_long(F.col("user_id")))


def _snapshot_rows(df: DataFrame) -> DataFrame:
    return df.select("name_hash", _r("counter"), "gauge", _r("cardinality"), _r("p50"), _r("p95"), _r("p99"), _r("mean"), "min", "max", "event_count")


def metric_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot of the metrics of the event stream."""
    return _snapshot_rows(metrics.snapshot(metrics.metric_state(_stream_as_metrics(spark, d))))


def pipeline_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pipeline_counts(metrics.metric_state(_stream_as_metrics(spark, d)))


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The timed events of the deliveries, each once."""
    return timed_events(table(spark, d, "metric_events"), columns=("name_hash", "metric_type", "value", "item_hash", "ts_ms", "seq")).dropDuplicates()


def metric_snapshot_events(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot of all metrics of the deliveries, from the merged states of their days."""
    e = _deliveries(spark, d).withColumn("day_no", F.expr("ts_ms div 86400000"))
    days = metrics.metric_state(e.withColumn("name_hash", F.struct("name_hash", "day_no")))
    merged = metrics.merge_states(days.withColumn("name_hash", F.col("name_hash.name_hash")))
    return _snapshot_rows(metrics.snapshot(merged))


def slot_compat(spark: SparkSession, d: str) -> DataFrame:
    """128 slots that several metrics share; the first arrival names the slot."""
    e = metrics.slots(_deliveries(spark, d), 128)
    s = metrics.snapshot(metrics.metric_state(e, key="slot_key"), "slot_key").join(metrics.slot_owner(e), "slot_key")
    return s.select("slot_key", "name_hash", _r("counter"), "gauge", _r("cardinality"), _r("p50"), _r("p99"), "event_count")


def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Events and their deliveries' metrics by whether the registry knows them."""
    reg = table(spark, d, "metric_registry")
    counts = _deliveries(spark, d).groupBy("name_hash").agg(F.count(F.lit(1)).alias("n_events"))
    return registry.lookup_by_hash(reg, counts).select("name_hash", "registered_name", "registered_type", "n_events")


def registry_names(spark: SparkSession, d: str) -> DataFrame:
    """Registered names that were not cut, found again by the hash of their text."""
    reg = table(spark, d, "metric_registry")
    names = reg.where(F.octet_length("name") < registry.NAME_BYTES).select("name").dropna().dropDuplicates()
    return registry.lookup(reg, names).select("name", "name_hash", "registered_type")


def registry_register(spark: SparkSession, d: str) -> DataFrame:
    """New entries from the names of parts."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name"), F.lit(" Gauge ").alias("metric_type"))
    return registry.register(names)


# codec, export


def payload_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "metric_events").where(~F.isnan("value") | F.col("value").isNull()).select("seq", "metric_type", "name_hash", "value").dropDuplicates()
    coded = e.select("seq", codec.encode_payload(F.col("metric_type"), F.col("name_hash"), F.col("value")).alias("payload"))
    out = codec.decode_payloads(coded)
    return out.select("seq", F.octet_length("payload").cast("long").alias("size"), "metric_type", "name_hash", "value", "is_error")


def _consumed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Messages of which every seventh is cut short and every eleventh has an unknown code."""
    e = table(spark, d, "metric_events").select("seq", "metric_type", "name_hash", "value").dropna().where(~F.isnan("value")).dropDuplicates()
    p = codec.encode_payload(F.col("metric_type"), F.col("name_hash"), F.col("value"))
    broken = F.when(F.col("seq") % 7 == 0, F.substring(p, 1, 3)).when(F.col("seq") % 11 == 0, F.concat(F.unhex(F.lit("FF")), F.substring(p, 2, 16))).otherwise(p)
    return codec.consume(e.select("seq", broken.alias("payload")))


def queue_consume(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the readable messages."""
    return metrics.snapshot(_consumed(spark, d)[0]).select("name_hash", _r("counter"), "gauge", _r("cardinality"), "event_count")


def queue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Messages consumed, and those that could not be read."""
    return _consumed(spark, d)[1]


def _rounded_snapshot(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.snapshot(metrics.metric_state(_stream_as_metrics(spark, d)))
    return s.select("name_hash", *[F.round(c, 3).alias(c) for c in metrics.SNAPSHOT[:-1]], "event_count")


def json_export(spark: SparkSession, d: str) -> DataFrame:
    return export.to_json(_rounded_snapshot(spark, d))


def prometheus_export(spark: SparkSession, d: str) -> DataFrame:
    return export.to_prometheus(_rounded_snapshot(spark, d), "app")


# privacy


def laplace_noise(spark: SparkSession, d: str) -> DataFrame:
    c, noise = F.col("c_acctbal"), {"seed": SEED, "sensitivity": 10.0, "epsilon": 0.5}
    t = table(spark, d, "customer")
    return t.select("c_custkey", F.round(privacy.laplace(c, F.col("c_custkey"), **noise), 6).alias("noisy"), privacy.laplace_int(F.floor(c), F.col("c_custkey"), **noise).alias("noisy_int"))


def private_mean(spark: SparkSession, d: str) -> DataFrame:
    scale = privacy.laplace_scale(10.0, 0.5)
    t = table(spark, d, "customer").withColumn("noisy", privacy.laplace(F.col("c_acctbal"), F.col("c_custkey"), seed=SEED, sensitivity=10.0, epsilon=0.5))
    out = privacy.private_aggregate(t, ["c_mktsegment"], "noisy", scale)
    return out.select("c_mktsegment", "count", _r("estimate_sum"), _r("estimate_mean"), _r("standard_error"))


def rr_debias(spark: SparkSession, d: str) -> DataFrame:
    """Share of orders in status F, from randomized answers."""
    p = privacy.truth_probability(1.0)
    t = table(spark, d, "orders").select("o_orderpriority", privacy.randomized_response(F.col("o_orderstatus") == "F", F.col("o_orderkey"), seed=SEED, p=p).alias("said"))
    agg = t.groupBy("o_orderpriority").agg(F.count("said").alias("n"), F.sum(F.col("said").cast("long")).alias("yes"))
    return agg.select("o_orderpriority", "n", "yes", _f(privacy.estimate_proportion(p, F.col("n"), F.col("yes"))).alias("share"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_size", privacy.rappor(F.col("p_size").cast("long"), F.col("p_partkey"), seed=SEED).alias("report"))


def rappor_bits(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("p_partkey", F.array_join(F.transform("report", lambda b: b.cast("string")), "").alias("report"))


def rappor_decode(spark: SparkSession, d: str) -> DataFrame:
    """Debiased number of parts of each size."""
    counts = privacy.rappor_counts(_reports(spark, d), [], "report")
    sizes = table(spark, d, "part").select(F.col("p_size").cast("long").alias("size"))
    return privacy.rappor_decode(counts, [], sizes, "size").select("size", _r("estimate"))


def privacy_budget(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's orders in order of key ask for their price over 400,000, out of a budget of 1."""
    asked = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 400000.0).alias("epsilon"))
    return privacy.budget(asked, key="o_custkey", order="o_orderkey", epsilon="epsilon", limit=1.0).select("o_custkey", "o_orderkey", "accepted", _r("spent"), _r("remaining"))


_NAMES = """fnv_hash_u64 fnv_hash_bytes fnv_hash_u128 hll_cardinality hll_merge approx_distinct_builtin dd_quantiles dd_signed dd_merge cms_estimate cms_merge cms_total
heavy_hitters heavy_hitters_estimated percentile_rank iqr quantile_linear covariance_matrix streaming_stats linreg change_rate ema_series ema_final sma tumbling
tumbling_compat rollup_3level rollup_of_means sliding_stats hopping session_windows streaming_median mad_score ewma_detect zscore composite anomaly_events metric_snapshot
metric_snapshot_events pipeline_counts slot_compat registry_lookup registry_names registry_register payload_roundtrip queue_consume queue_counts json_export prometheus_export laplace_noise private_mean
rr_debias rappor_bits rappor_decode privacy_budget""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

from rillstat.plans.statistics_sql import SQL  # noqa: E402,F401
