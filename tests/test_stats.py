"""Statistics on the known vectors and against numpy."""

import numpy as np
import pytest

from rillstat.operators import stats


def values(spark, vs, schema="v double"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in vs], schema)


def test_percentile_rank(spark):
    assert stats.percentile_rank(values(spark, [1, 2, 3, 4, 5, None]), [], "v", 3).first()[0] == 50
    d = values(spark, [10, 20, 30])
    assert [stats.percentile_rank(d, [], "v", x).first()[0] for x in (1, 50)] == [0, 100]
    assert stats.percentile_rank(d.where("v > 99"), [], "v", 3).first()[0] == 0


def test_quartiles(spark):
    r = stats.iqr(values(spark, range(1, 9)), [], "v").first()
    assert tuple(r) == (2.75, 4.5, 6.25, 3.5, -2.5, 11.5)
    assert stats.iqr(values(spark, [1, 2, 3]), [], "v").first()["q1"] is None


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(2)
    data = {"a": np.concatenate([rng.normal(0, 1e-3, 300), rng.lognormal(0, 8, 300), np.repeat(7.0, 500), -rng.lognormal(0, 8, 100)]), "b": np.array([3.0]), None: np.array([1.0, 1.0, 2.0, -0.0, 0.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("a", float("nan"))], "k string, value double").repartition(5)
    qs = [0.0, 0.013, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = {(r.k, r.q): r.value for r in stats.quantile_linear(df, ["k"], "value", qs).collect()}
    assert got == pytest.approx({(k, q): float(np.quantile(v, q)) for k, v in data.items() for q in qs}, rel=1e-9, abs=1e-12)


def test_quantile_vector(spark):
    got = stats.quantile_linear(values(spark, [10, 20, 30]), [], "v", [0, 0.5, 1, 7]).orderBy("q").collect()
    assert [r.value for r in got] == [10, 20, 30, 30]
    assert stats.quantile_linear(values(spark, []), [], "v", [0.5]).count() == 0


def test_covariance(spark):
    df = spark.createDataFrame([(float(i), float(i), float(-i), 1.0) for i in range(100)] + [(1.0, None, 1.0, 1.0)], "a double, b double, c double, d double")
    m = {(r.row, r.col): (r.covariance, r.correlation, r["count"]) for r in stats.covariance_matrix(df, [], ["a", "b", "c", "d"]).collect()}
    assert m["a", "b"][1] == pytest.approx(1) and m["a", "c"][1] == pytest.approx(-1) and m["a", "d"][1] == 0 and m["d", "d"][1] == 1
    assert m["a", "b"] == m["b", "a"] and m["a", "a"][0] == pytest.approx(np.var(range(100), ddof=1)) and m["a", "a"][2] == 100


def test_moments(spark):
    r = stats.moments(values(spark, [2, 4, 4, 4, 5, 5, 7, 9]), [], "v").first()
    assert (r["mean"], r["variance"], r["min"], r["max"], r["skewness"], r["kurtosis"]) == pytest.approx((5, 4, 2, 9, 0.65625, -0.21875))
    flat = stats.moments(values(spark, [3, 3, 3, 3, 3]), [], "v").first()
    assert (flat["variance"], flat["skewness"], flat["kurtosis"]) == (0, 0, 0)
    none = stats.moments(values(spark, []), [], "v").first()
    assert (none["count"], none["mean"], none["min"], none["max"]) == (0, 0, float("inf"), float("-inf"))
    assert stats.moments(values(spark, range(1000)), [], "v").first()["kurtosis"] < 0


@pytest.mark.parametrize("f, n, at, want", [(lambda x: 2 * x + 1, 100, 0, (2, 1, 1, 1)), (lambda x: 3 * x - 2, 50, 100, (3, -2, 1, 298)), (lambda x: 42, 20, 5, (0, 42, 0, 42))])
def test_regression(spark, f, n, at, want):
    df = spark.createDataFrame([(float(x), float(f(x))) for x in range(n)] + [(None, 1.0)], "x double, y double")
    m = stats.linear_regression(df, [], "x", "y")
    r = m.select("slope", "intercept", "r_squared", stats.predict(m, float(at)).alias("p")).first()
    assert tuple(r) == pytest.approx(want, abs=1e-9)
    same_x = spark.createDataFrame([(1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert tuple(stats.linear_regression(same_x, [], "x", "y").first())[1:] == (0, 4, 0)
