"""As-of join against brute force; files of all formats."""

import random

import pytest
from pyspark.sql import functions as F

from rillstat import sources
from rillstat.operators.joins import asof_join


@pytest.mark.parametrize("chunk, tolerance", [(50, None), (10_000, None), (50, 120)])
def test_asof(spark, chunk, tolerance):
    rnd = random.Random(9)
    left = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, *range(0, 1000, 3)]), i, "mine") for i in range(150)]
    right = [(rnd.choice([1, 1, 2, None]), rnd.choice([None, *range(100, 1000, 11)]), i, rnd.choice([None, "a", "b"])) for i in range(60)]
    dl = spark.createDataFrame(left, "k long, t long, i long, v string").repartition(4)
    dr = spark.createDataFrame(right, "k long, t long, i long, v string").repartition(3)
    got = {r.i: (r.k, r.t, r.v, r.asof_ts, r.asof_i, r.asof_v) for r in asof_join(dl, dr, key="k", ts="t", order="i", columns=["i", "v"], chunk_ms=chunk, tolerance_ms=tolerance).collect()}
    want = {}
    for k, t, i, v in left:
        fit = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        b = max(fit, key=lambda r: (r[1], r[2])) if fit else None
        if b and tolerance is not None and t - b[1] > tolerance:
            b = None
        want[i] = (k, t, v, *((b[1], b[2], b[3]) if b else (None, None, None)))
    assert got == want
    assert asof_join(dl.limit(0), dr, key="k", ts="t", order="i", columns=["v"]).count() == 0
    assert asof_join(dl, dr.limit(0), key="k", ts="t", order="i", columns=["v"]).where("asof_v is not null").count() == 0


@pytest.mark.parametrize("fmt", sources.FORMATS)
def test_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None), (3, "ü,\n\"x\"", -2.0)], "id long, s string, v double")
    options = {"multiLine": "true", "escape": '"'} if fmt == "csv" else {}
    sources.write(df, f"{tmp_path}/x", fmt, **({"escape": '"', "header": "false"} if fmt == "csv" else {}))
    back = sources.read(spark, f"{tmp_path}/x", fmt, df.schema, **options)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    if fmt in ("json", "csv"):
        with pytest.raises(ValueError):
            sources.read(spark, f"{tmp_path}/x", fmt)
    with pytest.raises(ValueError):
        sources.read(spark, "x", "text")


def test_partitions_are_pruned_and_streamed(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("p"))
    sources.write(df, f"{tmp_path}/x", partition_by=("p",))
    some = sources.read(spark, f"{tmp_path}/x").where("p = 2")
    assert some.count() == 25 and "PartitionFilters: [isnotnull(p" in some._jdf.queryExecution().executedPlan().toString()
    q = sources.read_stream(spark, f"{tmp_path}/x", "id long, p int", files_per_batch=1).writeStream.format("memory").queryName("rs_streamed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rs_streamed").count() == 100
