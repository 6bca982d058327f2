"""Problems 2 and 5: registers and radix selection against exact results."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstat.llm import radix, ultraloglog as ull


def test_estimates_and_union(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("day"), (F.col("id") * 7919).alias("x")).unionByName(spark.range(20_000).select(F.lit(2).cast("long").alias("day"), (F.col("id") * 7919).alias("x")))
    days = ull.build(df, ["day"], "x", 12)
    one = ull.unite(days, [])
    assert sorted(one.collect()) == sorted(ull.build(df, [], "x", 12).collect())  # lossless
    est = ull.estimate(ull.register_counts(one, []), [], 12).first().estimate
    assert abs(est - 60_000) < 5 * ull.standard_error(12) * 60_000
    per = {r.day: r.estimate for r in ull.estimate(ull.register_counts(days, ["day"]), ["day"], 12).collect()}
    assert abs(per[0] - 20_000) < 5 * ull.standard_error(12) * 20_000 and per[2] > 1.2 * per[0]


def test_union_of_packed_registers(spark):
    rng = np.random.default_rng(1)
    parts = [ull.build(spark.createDataFrame([(int(x),) for x in rng.integers(0, 10**9, 400)], "x long"), [], "x", 8) for _ in range(3)]
    rows = np.zeros((3, 256), np.uint8)
    for i, p in enumerate(parts):
        for r in p.collect():
            rows[i, r.idx] = r.reg
    want = np.zeros(256, np.uint8)
    for r in ull.unite(parts[0].unionByName(parts[1]).unionByName(parts[2]), []).collect():
        want[r.idx] = r.reg
    assert (ull.unite_registers(rows) == want).all()


def test_counts_of_unsound_identifiers(spark):
    df = spark.createDataFrame([(None, 1), (None, None), ("a", 5), ("a", 5), ("a", None), ("b", None)], "g string, idx long")
    got = {r.g: round(r.estimate) for r in ull.estimate(ull.register_counts(ull.build(df, ["g"], "idx"), ["g"]), ["g"]).collect()}
    assert got == {None: 1, "a": 1}
    assert ull.estimate(ull.register_counts(ull.build(df.limit(0), ["g"], "idx"), ["g"]), ["g"]).count() == 0


def test_scopes(spark):
    df = spark.createDataFrame([(d, m, 1000 * m + i) for d in (1, 2) for m in (1, 2, 3) for i in range(300) if d == 1 or m == 1], "d int, m long, x long")
    scopes = spark.createDataFrame([(10, 1), (10, 2), (10, 2), (11, 3), (12, 9), (13, None)], "s int, m long")
    wanted = spark.createDataFrame([(1, 10), (2, 10), (1, 11), (2, 11), (1, 12), (1, 10)], "d int, s int")
    rows = ull.counts_by_scope(df, scopes, wanted, day="d", member="m", scope="s", identifier="x")
    got = {(r.s, r.d): r.estimate for r in ull.estimate(rows, ["s", "d"]).collect()}
    assert got.keys() == {(10, 1), (10, 2), (11, 1)} and abs(got[10, 1] - 600) < 20 and abs(got[10, 2] - 300) < 10


EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, -1.0, 1.7976931348623157e308, -1.7976931348623157e308, 0.1, math.pi, 1e22, 4503599627370497.0]


def test_ordered_keys(spark):
    rng = np.random.default_rng(5)
    v = EDGES + [float(x) for x in rng.normal(0, 1, 500) * 10.0 ** rng.integers(-300, 300, 500)] + [2.0**k for k in range(-1074, 1024, 37)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 41)]
    rows = spark.createDataFrame([(x,) for x in v], "v double").select("v", radix.ordered_key(F.col("v")).alias("k")).select("v", "k", radix.key_value(F.col("k")).alias("b")).collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.k == (-bits if r.v < 0 else bits) and r.b == r.v


def test_selection_and_bounds(spark):
    rng = np.random.default_rng(6)
    data = {"a": np.concatenate([rng.lognormal(0, 3, 900), -rng.lognormal(0, 3, 80), np.zeros(20)]), "one": np.array([4.5]), "ties": np.array([2.0] * 70 + [3.0] * 30)}
    df = spark.createDataFrame([(k, float(x), i) for k, v in data.items() for i, x in enumerate(v)], "g string, value double, digit long")
    keys = df.select("g", radix.ordered_key(F.col("value")).alias("key"), F.lit(1).alias("n"), F.lit("clash").alias("q"))
    qs = [1, 5000, 7000, 9900, 10000]
    got = {(r.g, r.q): (r.value, r.n) for r in radix.select_exact(keys.select("g", "key"), ["g"], qs).collect()}
    for k, v in data.items():
        s = np.sort(v)
        for q in qs:
            assert got[k, q] == (s[max(1, -(-len(s) * q // 10000)) - 1], len(s))
    parts = radix.histogram(keys.withColumn("h", F.col("key") % 4), ["g", "h"])
    for r in radix.bounded(radix.merge(parts, ["g"]), ["g"], qs).collect():
        x = got[r.g, r.q][0]
        assert r.lower <= x <= r.upper and r.upper - r.lower <= 2.0**-7 * max(abs(r.lower), abs(r.upper), 2.0**-1022)
    assert radix.select_exact(keys.select("g", "key").limit(0), ["g"], qs).count() == 0


@pytest.mark.parametrize("n", [1, 10, 1000, 200_000])
def test_likelihood(n):
    h = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    idx, rest = h & np.uint64(4095), h >> np.uint64(12) | np.uint64(1) << np.uint64(52)
    rank = np.array([(int(x) & -int(x)).bit_length() for x in rest])
    bits = np.zeros(4096, np.uint64)
    np.bitwise_or.at(bits, idx.astype(int), np.uint64(1) << (rank + 1).astype(np.uint64))
    regs = []
    for b in bits[bits > 0].tolist():
        u = b.bit_length() - 2
        regs.append(u * 4 + (b >> (u - 1) & 3))
    values, counts = np.unique(regs, return_counts=True)
    assert abs(ull.likelihood_estimate(values, counts, 12) - n) <= max(1, 5 * ull.standard_error(12) * n)
