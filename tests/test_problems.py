"""Problems 1, 3 and 4 against brute force, with unsound rows, ties, empty tables and clashing columns."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from rillstat.operators import balance, faults, grid
from rillstat.operators.intervals import attach_intervals

READ = "name_hash long, value double, ts_ms long, seq long, state string, n_readings long"
PLAN = "name_hash long, start_ms long, end_ms long, period_ms long, value string"
T0 = 1_000_000_000_000


def frames(spark, readings, plan):
    return spark.createDataFrame([(*r, "clash", 7) for r in readings], READ), spark.createDataFrame([(*p, "clash") for p in plan], PLAN)


def unsound():
    readings = [(1, 5.0, T0 + 10, 1), (1, 5.0, T0 + 10, 1), (1, 7.0, T0 + 10, 2), (1, None, T0 + 1500, 3), (1, math.nan, T0 + 1500, 4), (1, math.inf, T0 + 1500, 5), (1, 9.0, T0 + 2999, 6), (1, 9.0, T0 + 4500, 7), (1, 9.0, None, 8), (None, 1.0, T0, 9), (2, 1.0, T0, 10), (1, 1.0, T0 + 9000, 11)]
    plan = [(1, T0, T0 + 4500, 1000), (1, T0, T0 + 4500, 1000), (3, T0, T0 + 2000, 1000), (None, T0, T0 + 1000, 1000), (1, T0, None, 1000), (1, T0 + 10, T0 + 10, 1000), (1, T0, T0 + 1000, 0), (1, T0 + 8500, T0 + 10_000, 500)]
    return readings, plan


def test_missing_periods(spark):
    r, p = frames(spark, *unsound())
    got = sorted((x.name_hash, x.period_start_ms - T0) for x in grid.uncovered_periods(r, p).collect())
    assert got == [(1, 1000), (1, 3000), (1, 4000), (1, 8500), (1, 9500), (3, 0), (3, 1000)]
    g = {(x.name_hash, x.period_start_ms - T0): x for x in grid.regular_grid(r, p).collect()}
    assert (g[1, 0].n_readings, g[1, 0].mean_value, g[1, 0].last_value, g[1, 0].state) == (2, 6.0, 7.0, "observed")
    assert (g[1, 1000].state, g[1, 1000].filled_value, g[1, 3000].filled_value, g[3, 0].filled_value) == ("missing", 7.5, 9.0, None)
    assert sorted(k for k, x in g.items() if x.state == "missing") == got
    for e_r, e_p in ((r.limit(0), p), (r, p.limit(0))):
        assert grid.regular_grid(e_r, e_p).where("state = 'observed'").count() == 0


def test_counter(spark):
    readings = [(1, 10.0, T0, 1), (1, 30.0, T0 + 2000, 2), (1, 5.0, T0 + 3000, 3), (1, 9.0, T0 + 3500, 4), (1, 99.0, T0 + 3500, 5), (1, 100.0, T0 + 9000, 6)]
    r, p = frames(spark, readings, [(1, T0, T0 + 10_000, 1000), (2, T0, T0 + 1000, 1000)])
    g = {(x.name_hash, (x.period_start_ms - T0) // 1000): (x.increment, x.resets, x.covered_ms, x.state) for x in grid.counter_grid(r, p).collect()}
    assert g[1, 0] == (10.0, 0, 1000, "covered") and g[1, 1] == (10.0, 0, 1000, "covered")
    assert g[1, 2] == (5.0, 1, 1000, "covered") and g[1, 3] == (94.0, 0, 500, "partial")
    assert g[1, 4] == (0.0, 0, 0, "uncovered") and g[2, 0][3] == "uncovered"


def test_counter_keeps_its_whole_increase(spark):
    rnd = random.Random(1)
    t, v, rows = T0, 0.0, []
    for i in range(300):
        rows.append((1, v, t, i))
        t += rnd.randint(1, 1900)
        v = rnd.random() * 3 if rnd.random() < 0.05 else v + rnd.random() * 10
    want = sum(b[1] if b[1] < a[1] else b[1] - a[1] for a, b in zip(rows, rows[1:]))
    r, p = frames(spark, rows, [(1, T0, T0 + 1_000_000, 1000)])
    out = grid.counter_grid(r.repartition(5), p).agg(F.sum("increment"), F.sum("covered_ms"), F.sum("resets")).first()
    assert out[0] == pytest.approx(want) and out[1] == rows[-1][2] - T0 and out[2] == sum(b[1] < a[1] for a, b in zip(rows, rows[1:]))


def test_intervals_against_brute_force(spark):
    rnd = random.Random(3)
    iv = [(rnd.choice([1, 1, 2, None]), s, s + rnd.choice([0, 1, 50, 900]), rnd.random()) for s in (rnd.randrange(0, 2000) for _ in range(40))]
    rd = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, *range(0, 2500, 7)]), i) for i in range(200)]
    got = attach_intervals(spark.createDataFrame(rd, "k long, t long, i long"), spark.createDataFrame(iv * 2, "k long, a long, b long, w double"), key="k", ts="t", start="a", end="b", keep=("i",), carry=("w",), bucket_ms=100, shards=3, shard_by="i")
    want = {(k, t, a, b, w, i) for k, t, i in rd for k2, a, b, w in iv if k is not None and k == k2 and t is not None and a <= t < b}
    rows = [(r.k, r.t, r.a, r.b, r.w, r.i) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


EVENT = "name_hash long, ts_ms long, value double, seq long, n long, day_no int"


def test_metric_days(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([1] * 20 + [2, 3, None]), T0 + rnd.randrange(3) * 86_400_000, rnd.choice([1.5, 2.5, None, math.nan, math.inf]), i) for i in range(600)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows + rows[:50]], EVENT).repartition(6)
    want = {}
    for k, t, v, _ in rows:
        w = want.setdefault((k, t // 86_400_000), [0, 0, 0.0])
        ok = v is not None and math.isfinite(v)
        w[0], w[1], w[2] = w[0] + 1, w[1] + ok, w[2] + (v if ok else 0)
    for plan in (None, balance.plan_load(df, "name_hash", 5, fraction=1.0), balance.plan_load(df.limit(0), "name_hash", 4)):
        got = {(r.name_hash, r.day_no): [r.n_events, r.n_values, r.sum_value or 0.0] for r in balance.metric_days(df, plan=plan).collect()}
        assert got == want
    days = {d for _, d in want}
    total = {d: sum(w[0] for (k, x), w in want.items() if x == d) for d in days}
    heavy = {(r.name_hash, r.day_no) for r in balance.dominant_keys(balance.metric_days(df), share=0.05).collect()}
    assert heavy == {(k, d) for (k, d), w in want.items() if k is not None and w[0] > 0.05 * total[d]}
    assert balance.metric_days(df.limit(0)).count() == 0


def test_hot_key_is_split(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id")).alias("name_hash"), F.col("id").alias("seq"))
    plan = balance.plan_load(df, "name_hash", 10, fraction=0.5)
    assert [k for k, _ in plan.heavy] == [1] and len(set(plan.heavy[0][1])) >= 7
    per = [r["count"] for r in balance.spread(df, "name_hash", plan, "seq").groupBy(balance.TASK).count().collect()]
    assert len(per) == 10 and max(per) < 1.5 * 20_000 / 10
    copies = balance.replicate(spark.createDataFrame([(1,), (5,)], "name_hash long"), "name_hash", plan).groupBy("name_hash").count().collect()
    assert {r.name_hash: r["count"] for r in copies} == {1: len(set(plan.heavy[0][1])), 5: 1}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_balanced_join(spark, how):
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 300 + [2, 3, None, 4] * 5)], "k long, seq long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "d")], "k long, v string")
    got = balance.balanced_join(left, right, "k", shard_by="seq", how=how).select("k", "seq", "v").collect()
    want = left.join(right, "k", how).select("k", "seq", "v").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_packing_of_loads_is_even():
    heavy, light = balance.pack_loads([("a", 1000), ("b", 90)], [(i, 10) for i in range(40)], 8, 186.25)
    load = [0.0] * 8
    for (k, tasks), n in zip(heavy, (1000, 90)):
        for t in tasks:
            load[t] += n / len(tasks)
    for _, t in light:
        load[t] += 10
    assert max(load) < 1.2 * sum(load) / 8


def test_faulty_readings_with_unsound_rows(spark):
    rnd = random.Random(2)
    rows = [(1, 50 + rnd.gauss(0, 0.1) + (4 if i == 60 else 0), T0 + 1000 * i, i) for i in range(120)]
    rows += [(1, None, T0 + 5, 900), (1, math.nan, T0 + 6, 901), (1, -math.inf, T0 + 7, 902), (None, 1.0, T0, 903), (1, 50.0, None, 904), (1, 1e9, T0 - 5, 905), (2, 1e9, T0 + 1, 906), (3, 7.0, T0 + 1, 907)]
    r, p = frames(spark, rows + rows[60:61], [(1, T0, T0 + 200_000, 1000)] * 2 + [(2, T0, T0 + 10, 1000), (3, T0, T0 + 10, 1), (4, T0, T0 + 10, 1), (None, T0, T0 + 10, 1)])
    lim = spark.createDataFrame([(1, "C", 0.0, 100.0), (1, "C", None, 90.0), (2, "C", None, None), (None, "C", 0.0, 0.0)], "name_hash long, unit string, min_valid double, max_valid double")
    assert sorted(x.seq for x in faults.faulty_readings(r, p, lim).collect()) == [60, 902]
    assert sorted(x.seq for x in faults.faulty_readings(r, p, lim.limit(0)).collect()) == [60, 902]
    for a, b in ((r.limit(0), p), (r, p.limit(0))):
        assert faults.faulty_readings(a, b, lim).count() == 0


def test_spike_in_a_window_that_stands_still(spark):
    """The step comes from the source's other window, where it moves."""
    rnd = random.Random(2)
    moving = [(1, float(80 + rnd.randint(0, 2)), T0 + 1000 * i, i) for i in range(100)]
    still = [(1, 85.0 + (16 if i == 50 else 1 if i == 20 else 0), T0 + 10**6 + 1000 * i, 1000 + i) for i in range(100)]
    r, p = frames(spark, moving + still, [(1, T0, T0 + 100_000, 1000), (1, T0 + 10**6, T0 + 10**6 + 100_000, 1000)])
    lim = spark.createDataFrame([], "name_hash long, unit string, min_valid double, max_valid double")
    assert [x.seq for x in faults.faulty_readings(r, p, lim).collect()] == [1050]


def test_steps():
    import numpy as np

    assert faults.whole_step(np.array([1.0, 3.0, 2.0, 2.0, 5.0, 1.0] * 4))[0] == 1.0
    assert faults.whole_step(np.random.default_rng(1).normal(0, 1, 300))[0] < 1e-6
    assert faults.whole_step(np.array([])) == (0.0, 0.0) and faults.whole_step(np.array([3.0, 3.0])) == (0.0, 0.0)


def test_every_query_has_its_sql_or_is_known_to_have_none():
    q, s = driver.queries(), driver.oracle_sql()
    none = {"approx_distinct_builtin", "p4_found", "p2_metric_day", "p2_scope_day", "p2_combined", "p5_combined", "p6_ids", "p7_pack", "p7_report", "p7_found", "p8_found"}
    assert set(s) <= set(q) and set(q) - set(s) <= none
