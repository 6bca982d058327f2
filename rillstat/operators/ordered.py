"""Operators over series in order of time, without one task per key.

A hot key may hold a third of all rows, so a window over the key alone would put
these into one task. Instead every row gets its number within its key
(``number_rows``, two narrow shuffles), and rows are cut into blocks of equal
number. What an operator needs from before a block is carried in: the last rows
(``blocks``) or a state that composes over blocks.

The order is (``ts``, ``order``); it must be total within a key for a defined
result. A null key is a group of its own. Rows with a null time are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RN, BLOCK, OWN = "_rs_rn", "_rs_block", "_rs_own"
#: Rows of one block: the most that one task step holds of a key.
BLOCK_ROWS = 200_000
CHUNK_MS = 3_600_000


def time_chunk(ts: Column, chunk_ms: int = CHUNK_MS) -> Column:
    return F.floor(ts / F.lit(float(chunk_ms))).cast("long")


def number_rows(df: DataFrame, *, key: str, ts: str, order: str, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """``df`` with ``_rs_rn``, the number of each row within its key from 1 on, in order of (``ts``, ``order``).

    Rows are numbered within chunks of time; a marker row brings each chunk the
    number of rows in the key's chunks before it. Only (key, chunk) counts meet
    per key. Rows that are numbered already stay as they are.
    """
    if RN in df.columns:
        return df
    rows = df.where(F.col(ts).isNotNull()).withColumn("_rs_chunk", time_chunk(F.col(ts), chunk_ms))
    counts = rows.groupBy(F.col(key), "_rs_chunk").agg(F.count(F.lit(1)).alias("_rs_n"))
    before = F.coalesce(F.sum("_rs_n").over(Window.partitionBy(key).orderBy("_rs_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = counts.select(key, "_rs_chunk", before.alias("_rs_before"))
    both = rows.withColumn("_rs_before", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True)
    chunk = Window.partitionBy(key, "_rs_chunk").orderBy(F.col("_rs_before").asc_nulls_last(), ts, order)
    # the marker comes first in its chunk
    number = F.first("_rs_before").over(chunk) + F.row_number().over(chunk) - 1
    return both.withColumn(RN, number).where(F.col("_rs_before").isNull()).drop("_rs_before", "_rs_chunk")


def blocks(numbered: DataFrame, *, context: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with ``_rs_block``; the last ``context`` rows of each block occur in the next one as well, with ``_rs_own`` false."""
    if not 0 <= context <= block_rows:
        raise ValueError("a block must be longer than its context")
    own = F.expr(f"({RN} - 1) div {block_rows}")
    if not context:
        return numbered.withColumn(BLOCK, own).withColumn(OWN, F.lit(True))
    tail = F.pmod(F.col(RN) - 1, F.lit(block_rows)) >= block_rows - context
    at = F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own)))
    # a block with nothing but copies has no rows of its own: its rows fall out at the end
    return numbered.withColumn(BLOCK, at).withColumn(OWN, F.col(BLOCK) == own)


def last_rows(key: str, n: int | None = None, *, current: bool = True):
    """Window over a block's rows: the last ``n`` rows, with or without the current one."""
    w = Window.partitionBy(key, BLOCK).orderBy(RN)
    return w.rowsBetween(-(n - 1), 0) if current else w.rowsBetween(-n, -1)
