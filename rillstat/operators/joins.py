"""As-of join: each row with the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstat.operators.ordered import time_chunk


def asof_join(left: DataFrame, right: DataFrame, *, key: str, ts: str, order: str, columns: list[str], chunk_ms: int = 86_400_000, tolerance_ms: int | None = None) -> DataFrame:
    """``left`` with ``asof_ts`` and ``asof_<column>`` of the last row of ``right`` of the same key at or before ``ts``; null where there is none.

    Of rows of ``right`` at one time the greatest ``order`` holds. With
    ``tolerance_ms`` older rows don't count. Rows of ``left`` with a null key or
    time are kept without a match; such rows of ``right`` match nothing.

    Both sides meet in chunks of time, so a hot key is cut; a marker row brings
    each chunk the key's last row before it. No range is compared row by row.
    """
    point = F.struct(F.col(ts).alias("t"), F.col(order).alias("o"), *[F.col(c).alias(f"c_{i}") for i, c in enumerate(columns)])
    chunk = time_chunk(F.col(ts), chunk_ms)
    r = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_rs_k"), F.col(ts).alias("_rs_t"), chunk.alias("_rs_chunk"), F.lit(1).alias("_rs_side"), point.alias("_rs_p"))
    sided = left.withColumn("_rs_k", F.col(key)).withColumn("_rs_t", F.col(ts)).withColumn("_rs_chunk", chunk).withColumn("_rs_side", F.lit(2))
    sound = F.col("_rs_k").isNotNull() & F.col("_rs_t").isNotNull()
    chunks = r.select("_rs_k", "_rs_chunk", "_rs_p").unionByName(sided.where(sound).select("_rs_k", "_rs_chunk"), allowMissingColumns=True).groupBy("_rs_k", "_rs_chunk").agg(F.max("_rs_p").alias("_rs_p"))
    earlier = Window.partitionBy("_rs_k").orderBy("_rs_chunk").rowsBetween(Window.unboundedPreceding, -1)
    marks = chunks.select("_rs_k", "_rs_chunk", F.lit(0).alias("_rs_side"), F.last("_rs_p", True).over(earlier).alias("_rs_p"))
    both = sided.where(sound).unionByName(r, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    last = F.last("_rs_p", True).over(Window.partitionBy("_rs_k", "_rs_chunk").orderBy(F.col("_rs_t").asc_nulls_first(), "_rs_side", F.col("_rs_p.o")).rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("_rs_p", last).where(F.col("_rs_side") == 2).unionByName(sided.where(~sound), allowMissingColumns=True)
    near = F.lit(True) if tolerance_ms is None else F.col(ts) - F.col("_rs_p.t") <= tolerance_ms
    got = [("t", "asof_ts"), *[(f"c_{i}", f"asof_{c}") for i, c in enumerate(columns)]]
    return met.select(*left.columns, *[F.when(near, F.col(f"_rs_p.{a}")).alias(b) for a, b in got])
