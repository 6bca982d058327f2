"""Golden values of hashes and sketches, in memory and as relations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstat import local
from rillstat.functions import hashing
from rillstat.operators import cardinality, frequency, quantile


def test_hashes():
    assert [local.hash_bytes(s) for s in ("hello", "world", "")] == [0xE9C562C0FDB23244, 0x85C3D80583B75D95, 0xEFD01F60BA992926]
    assert [int(h) for h in local.hash_u64([0, 42, 12345])] == [0x7BD3144F29C0CC9E, 0xA6245A5DCF278758, 0xAC8C62A6DA31B70B]
    assert local.hash_bytes("hello", as_text_value=True) == 0x219A539D3500BA1D
    assert [local.hash_bytes(s) for s in ("http.requests", "http.latency", "unique.users")] == [0xC142357BFBC2B5E1, 0x94F26DD2BC601DE0, 0x6360231C0DF9ABBE]
    assert {local.hash_u128(12345 | i << 64) % 64 for i in range(3)} == {4, 34, 49}


def test_hash_columns(spark):
    df = spark.createDataFrame([(42, "hello"), (None, None), (-1, ""), (0, "wörld" * 50)], "n long, s string")
    got = df.select(hashing.hash_long(F.col("n")).alias("n"), hashing.hash_bytes(F.col("s")).alias("s"), hashing.unsigned(hashing.hash_long(F.col("n"))).alias("u")).collect()
    assert got[0]["u"] == 0xA6245A5DCF278758 and got[1]["n"] is None and got[1]["s"] is None
    assert [r["s"] % 2**64 for r in got if r["s"] is not None] == [local.hash_bytes(s) for s in ("hello", "", "wörld" * 50)]
    assert got[2]["n"] % 2**64 == int(local.hash_u64([-1])[0])


def test_hashes_as_sql_functions(spark):
    hashing.register(spark)
    r = spark.sql("select rs_hash_long(42) a, rs_hash_bytes('hello') b").first()
    assert (r.a % 2**64, r.b % 2**64) == (0xA6245A5DCF278758, 0xE9C562C0FDB23244)


@pytest.mark.parametrize("p, n, want", [(10, 1000, 1023.208), (12, 1000, 975.455), (14, 1000, 993.524), (16, 1000, 997.554), (14, 100_000, 99671.928), (16, 100_000, 99188.615)])
def test_distinct_counts(p, n, want):
    assert local.HyperLogLog(p).insert_numbers(range(n)).cardinality() == pytest.approx(want, abs=6e-4)


def test_distinct_counts_as_relation(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), hashing.hash_long(F.col("id")).alias("h"))
    s = cardinality.hll_build(df, ["g"], "h", 10)
    assert cardinality.hll_estimate(cardinality.hll_merge(s, []), [], 10).first()[0] == pytest.approx(1023.208, abs=6e-4)
    mine = local.HyperLogLog.from_rows(cardinality.hll_merge(s, []).collect(), 10)
    assert mine.cardinality() == pytest.approx(1023.208, abs=6e-4)
    empty = cardinality.hll_build(df.where("g > 5"), [], "h", 10)
    assert cardinality.hll_estimate(empty, [], 10).first()[0] == 0.0


def test_merged_distinct_counts_equal_those_of_the_union():
    a, b = local.HyperLogLog(12).insert_numbers(range(500)), local.HyperLogLog(12).insert_numbers(range(300, 1000))
    assert a.merge(b).cardinality() == local.HyperLogLog(12).insert_numbers(range(1000)).cardinality()
    with pytest.raises(ValueError):
        a.merge(local.HyperLogLog(10))


@pytest.mark.parametrize("bins, a, values, wanted", [
    (2048, 0.01, range(10, 101, 10), {0.5: 49.40887222679854, 0.99: 99.49957198867813}),
    (2048, 0.01, range(1, 101), {0.5: 49.40887222679854, 0.99: 97.5292834344469}),
    (256, 0.05, range(10, 101, 10), {0.5: 49.56351030851681, 0.95: 99.86697931436119, 0.99: 99.86697931436119}),
    (256, 0.01, [10, 20, 30, 100, 500], {0.5: 29.96749637497217, 0.8: 500, 0.99: 500}),
])
def test_quantiles(spark, bins, a, values, wanted):
    s = local.DDSketch(a, bins).insert(list(values))
    assert {q: s.quantile(q) for q in wanted} == pytest.approx(wanted, rel=1e-12)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.q: r.estimate for r in quantile.dd_quantiles(quantile.dd_build(df, [], "v", a, bins), [], list(wanted), a, bins).collect()}
    assert got == pytest.approx(wanted, rel=1e-9)


def test_quantiles_of_signs_nulls_and_no_numbers(spark):
    rows = [(-5.0,), (-10.0,), (0.0,), (None,), (math.nan,), (math.inf,)]
    df = spark.createDataFrame(rows, "v double")
    s = quantile.dd_build(df, [], "v")
    r = quantile.dd_stats(s, []).first()
    assert (r["count"], r["sum"], r["min"], r["max"], r["dropped"], r["non_finite"]) == (3, -15.0, -10.0, 0.0, 0, 2)
    got = {r.q: r.estimate for r in quantile.dd_quantiles(s, [], [0.0, 0.3, 0.6, 1.0]).collect()}
    assert got[1.0] == 0.0 and -10.3 < got[0.0] < -9.7 and -5.2 < got[0.6] < -4.8
    assert quantile.dd_quantiles(s, [], [0.0], first_rank=0).first().estimate == pytest.approx(-(quantile.gamma(0.01) ** (2048 - 2 - 512)))
    none = quantile.dd_build(df.where("v > 99 and v < 100"), [], "v")
    assert quantile.dd_stats(none, []).first()["mean"] == 0.0
    assert local.DDSketch().quantile(0.5) == 0.0
    only_bad = quantile.dd_build(spark.createDataFrame([(math.nan,)], "v double"), [], "v")
    assert quantile.dd_quantiles(only_bad, [], [0.5]).first().estimate == 0.0


def test_merged_quantiles_equal_those_of_the_union(spark):
    v = np.random.default_rng(3).lognormal(3, 2, 4000)
    df = spark.createDataFrame([(int(i % 3), float(x)) for i, x in enumerate(v)], "g int, v double")
    parts = quantile.dd_merge(quantile.dd_build(df, ["g"], "v"), [])
    whole = quantile.dd_build(df, [], "v")
    qs = [0.01, 0.5, 0.99]
    got = {r.q: r.estimate for r in quantile.dd_quantiles(parts, [], qs).collect()}
    assert got == {r.q: r.estimate for r in quantile.dd_quantiles(whole, [], qs).collect()}
    mid = {r.q: r.estimate for r in quantile.dd_quantiles(whole, [], qs, middle=True).collect()}
    for q in qs:
        true = np.sort(v)[max(1, math.ceil(q * len(v))) - 1]
        assert abs(mid[q] - true) <= 0.0101 * true and got[q] <= true


def test_counter_columns():
    assert frequency.columns_of(np.array([1], np.uint64), 1024, 5)[0].tolist() == [806, 317, 179, 415, 76]
    assert frequency.columns_of(np.array([1], np.uint64), 2048, 7)[0].tolist() == [806, 1341, 1203, 415, 76, 968, 1243]


def test_frequencies(spark):
    rows = [(1,)] * 100 + [(2,)] * 50 + [(3,)] * 10 + [(None,)]
    df = spark.createDataFrame(rows, "h long").repartition(5)
    s = frequency.cms_build(df, "h", width=1024, depth=5)
    est = {r.h: r.estimate for r in frequency.cms_estimate(s, spark.createDataFrame([(1,), (2,), (3,), (77,), (None,)], "h long"), "h", width=1024, depth=5).collect()}
    assert est == {1: 100, 2: 50, 3: 10, 77: 0}
    assert frequency.cms_total(s).first().total == 160
    mine = local.CountMinSketch(1024, 5).insert_hashes([1] * 100 + [2] * 50 + [3] * 10)
    assert {(r.row, r.col): r.n for r in s.collect()} == {(int(a), int(b)): int(mine.counters[a, b]) for a, b in zip(*np.nonzero(mine.counters))}
    weighted = spark.createDataFrame([(1, 60), (1, 40), (2, None)], "h long, w long")
    assert frequency.cms_total(frequency.cms_build(weighted, "h", weight="w")).first().total == 100


def test_heavy_hitters(spark):
    stream = [h for h, n in ((1, 1000), (2, 500), (3, 250), (4, 100), (5, 50)) for _ in range(n)] + list(range(100, 200))
    assert [h for h, _ in local.HeavyHitters(5).insert_hashes(stream).top()][:3] == [1, 2, 3]
    df = spark.createDataFrame([(h,) for h in stream] + [(None,)] * 2000, "h long")
    assert [tuple(r) for r in frequency.heavy_hitters(df, "h", 4).collect()] == [(1, 1000), (2, 500), (3, 250), (4, 100)]
    assert [r.h for r in frequency.heavy_hitters_estimated(df, "h", 3).collect()] == [1, 2, 3]
