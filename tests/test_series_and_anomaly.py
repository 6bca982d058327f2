"""Ordered operators against the sequential state machines, whatever the blocks and partitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rillstat import local
from rillstat.operators import anomaly, series, windows
from rillstat.operators.ordered import RN, number_rows

ON = {"key": "k", "ts": "t", "value": "v", "order": "o"}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out, o = [], 0
    for k, n in (("hot", 400), ("cold", 7), (None, 30), ("one", 1)):
        t = 0
        for _ in range(n):
            t += rnd.choice([0, 1, 60_000, 4_000_000])
            out.append((k, t, o, round(rnd.gauss(10, 3), 3) + (100 if rnd.random() < 0.02 else 0), "extra"))
            o += 1
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    bad = [("hot", 5, 9999, None, "extra"), ("hot", None, 9998, 1.0, "extra")]
    return spark.createDataFrame(shuffled + bad, "k string, t long, o long, v double, sma string").repartition(7).persist()


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[1], r[2])) for k, v in out.items()}


def test_numbers(df, rows):
    got = {r["o"]: r[RN] for r in number_rows(df.where("v is not null"), key="k", ts="t", order="o").collect()}
    assert got == {r[2]: i for part in by_key(rows).values() for i, r in enumerate(part, 1)}


@pytest.mark.parametrize("block", [8, 50, 100_000])
def test_averages(df, rows, block):
    got = {r["o"]: r["ema"] for r in series.ema(df, **ON, weight=0.2, block_rows=block).collect()}
    want = {}
    for part in by_key(rows).values():
        e = local.Ema(0.2)
        want |= {r[2]: e.observe(r[3]) for r in part}
    assert got == pytest.approx(want, rel=1e-9)
    sma = {r["o"]: r["sma"] for r in series.sma(df, **ON, n=5, block_rows=block).collect()}
    assert sma == pytest.approx({r[2]: sum(x[3] for x in part[max(0, i - 4) : i + 1]) / min(5, i + 1) for part in by_key(rows).values() for i, r in enumerate(part)})


@pytest.mark.parametrize("block", [101, 100_000])
@pytest.mark.parametrize("name, make, columns", [
    ("mad", local.MadDetector, ("mad_median", "mad_score", "mad_anomaly")),
    ("ewma", local.EwmaDetector, ("ewma", "ewma_score", "ewma_anomaly")),
    ("zscore", local.ZScoreDetector, ("z_mean", "z_score", "z_anomaly")),
    ("composite", local.CompositeDetector, ("mad_median", "score", "anomaly")),
])
def test_detectors(df, rows, block, name, make, columns):
    got = {r["o"]: [r[c] for c in columns] for r in getattr(anomaly, name)(df, **ON, block_rows=block).collect()}
    for part in by_key(rows).values():
        d = make()
        for i, r in enumerate(part):
            centre, score, verdict = d.judge(r[3])
            c, s, v = got[r[2]]
            assert v == verdict and s == pytest.approx(score, rel=1e-6, abs=1e-9), (r, i)
            if i:
                assert c == pytest.approx(centre, rel=1e-9)
    assert len(got) == len(rows)


def test_streaming_median(df, rows):
    got = {r["o"]: r["median"] for r in anomaly.streaming_median(df, **ON, window=9, block_rows=20).collect()}
    for part in by_key(rows).values():
        m = local.StreamingMedian(9)
        for r in part:
            m.push(r[3])
            assert got[r[2]] == pytest.approx(m.median())


def test_change_rate(df, rows):
    got = {r["o"]: r["rate"] for r in series.change_rate(df, **ON, chunk_ms=3_000_000).collect()}
    for part in by_key(rows).values():
        c = local.ChangeRate()
        for r in part:
            want = c.observe(r[3], r[1])
            assert got[r[2]] == (None if want is None else pytest.approx(want))


def test_sliding(df, rows):
    got = {r["o"]: r for r in windows.sliding(df, **ON, n=4, block_rows=10).collect()}
    for part in by_key(rows).values():
        for i, r in enumerate(part):
            w = [x[3] for x in part[max(0, i - 3) : i + 1]]
            g, mean = got[r[2]], sum(w) / len(w)
            assert (g["win_count"], g["win_min"], g["win_max"]) == (len(w), min(w), max(w))
            assert g["win_var"] == pytest.approx(sum((x - mean) ** 2 for x in w) / len(w), abs=1e-9)


def test_vectors():
    steady = [10, 10.5, 9.5, 10.2, 9.8, 10.1, 9.9, 10.3, 9.7, 10.4]
    mad = local.MadDetector(3.0)
    mad.observe_batch(steady)
    assert mad.is_anomaly_batch([10, 10.5, 9.5, 100, -50]).tolist() == [False, False, False, True, True]
    flat = local.MadDetector()
    flat.observe_batch([5.0] * 10)
    assert (flat.is_anomaly(5.0), flat.is_anomaly(5.1), flat.anomaly_score(5.1)) == (False, True, math.inf)
    few = local.MadDetector()
    few.observe_batch([10, 20])
    assert not few.is_anomaly(1e9)
    ewma = local.EwmaDetector(0.1, 3)
    ewma.observe_batch([9 + i % 3 for i in range(100)])
    assert abs(ewma.ewma - 10) < 1 and not ewma.is_anomaly(11) and ewma.is_anomaly(50)
    z = local.ZScoreDetector()
    z.observe_batch([10, 11, 9, 10.5, 9.5, 10.2, 9.8, 10.1, 9.9, 10.3])
    assert z.mean == pytest.approx(10.03) and not z.is_anomaly(10) and z.is_anomaly(100)
    assert local.ZScoreDetector().z_score(3.0) == math.inf
    both = local.CompositeDetector()
    both.observe_batch(steady)
    assert not both.is_anomaly(10) and both.is_anomaly(100) and both.anomaly_score(100) > 3
    m = local.StreamingMedian()
    for v in (5, 2, 8, 1, 9):
        m.push(v)
    assert m.median() == 5
    c = local.ChangeRate()
    assert [c.observe(0, 0), c.observe(50, 100)] == [None, 0.5]
    c = local.ChangeRate()
    assert [c.observe(10, 100), c.observe(20, 100)] == [None, 0.0]
    e = local.Ema(0.5)
    assert [e.observe(0), e.observe(100)] == [0, 50] and series.smoothing(9) == 0.2


def test_empty_series(df):
    none = df.where("v > 1e9")
    for out in (series.ema(none, **ON, weight=0.5), anomaly.composite(none, **ON), series.change_rate(none, **ON), windows.sliding(none, **ON, n=3)):
        assert out.count() == 0


def test_anomaly_events(df):
    ev = anomaly.anomaly_events(anomaly.composite(df, **ON, consensus=True), key="k", ts="t", value="v")
    assert ev.columns == ["metric_id", "timestamp", "value", "score", "expected"]
    assert ev.where(F.col("value") < 90).count() == 0
