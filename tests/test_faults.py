"""Problem 4: impossible, spiked and stuck readings."""

import numpy as np

import __spark_entry__ as driver
from rillstat.operators.faults import judge


def noise(n=200, seed=1):
    return 50 + np.random.default_rng(seed).normal(0, 0.1, n)


def flagged(x, low=0.0, high=100.0):
    return set(np.flatnonzero(judge(x, low, high)))


def test_sound_readings_rises_and_lasting_changes_are_no_cases():
    x = noise()
    assert flagged(x) == set()
    x[100:] += 5
    x[40:60] += np.linspace(0, 4, 20)
    x[60:] += 4
    assert flagged(x) == set()


def test_spikes_of_up_to_three_readings_but_not_of_four():
    for n in (1, 2, 3):
        x = noise()
        x[80 : 80 + n] += 3
        assert flagged(x) == set(range(80, 80 + n))
    x = noise()
    x[80:84] += 3
    assert flagged(x) == set()


def test_two_neighbouring_spikes():
    x = noise()
    x[80:83] += 3
    x[85:88] -= 3
    assert flagged(x) == {80, 81, 82, 85, 86, 87}


def test_impossible_readings_and_open_bounds():
    x = noise()
    x[3], x[50], x[51] = np.inf, 150.0, -1.0
    assert flagged(x) == {3, 50, 51}
    assert 3 in flagged(x, float("nan"), float("nan"))


def test_stuck_runs_of_ten_but_not_in_sources_that_stand_still():
    x = noise()
    x[70:80] = x[70]
    x[120:129] = x[120]
    assert flagged(x) == set(range(70, 80))
    steps = np.repeat([40.0, 41.0, 40.0, 42.0], 40)
    assert flagged(steps) == set()
    one = np.full(100, 88.0)
    one[50] = 89.0
    assert flagged(one) == set()


def test_query_takes_repeated_deliveries_once(spark, tmp_path):
    x = noise()
    x[100] += 5
    rows = [(7, " Gauge", float(v), 1_000_000_000_000 + 1000 * i, i) for i, v in enumerate(x)]
    rows += rows[100:101] + [(7, "gauge", None, 1_000_000_000_500, 900)]
    spark.createDataFrame(rows, "name_hash long, metric_type string, value double, ts_ms long, seq long").write.parquet(f"{tmp_path}/metric_events.parquet")
    spark.createDataFrame([(7, 1_000_000_000_000, 1_000_000_200_000, 1000)] * 2, "name_hash long, start_ms long, end_ms long, period_ms long").write.parquet(f"{tmp_path}/report_schedule.parquet")
    spark.createDataFrame([(7, "C", None, 100.0)], "name_hash long, unit string, min_valid double, max_valid double").write.parquet(f"{tmp_path}/source_limits.parquet")
    assert [r.seq for r in driver.queries()["p4_found"](spark, str(tmp_path)).collect()] == [100]
