"""Relational queries: joins, grouping sets, ranks, set operations and scalar functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstat.functions import hashing
from rillstat.operators.joins import asof_join
from rillstat.sources import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000)).cast("long")
    return table(spark, d, "events").select("event_id", ms.alias("ts_ms"), "user_id", "event_type", "value")


def join_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's last click within ten days before it."""
    e = _events(spark, d)
    left = e.where(F.col("event_type") == "purchase").select("event_id", "ts_ms", "user_id")
    out = asof_join(left, e.where(F.col("event_type") == "click"), key="user_id", ts="ts_ms", order="event_id", columns=["event_id", "value"], tolerance_ms=10 * 86_400_000)
    return out.select("event_id", "user_id", "asof_ts", "asof_event_id", "asof_value")


def join_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers by whether they have an urgent order."""
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("urgent", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("urgent", F.lit(False)))


def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus")
    return t.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.countDistinct("l_suppkey").alias("suppliers"))


def rank_window(spark: SparkSession, d: str) -> DataFrame:
    """The three dearest orders of each customer, with the gap to the one before."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    top = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("place")).where(F.col("place") <= 3)
    return top.withColumn("gap", (F.lag("o_totalprice").over(w) - F.col("o_totalprice")).cast("float").cast("double"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers of both statuses, and of status F only."""
    t = table(spark, d, "lineitem")
    f, o = (t.where(F.col("l_linestatus") == s).select("l_partkey", "l_suppkey") for s in "FO")
    return f.intersect(o).withColumn("kind", F.lit("both")).unionByName(f.subtract(o).withColumn("kind", F.lit("only F")))


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders")
    return t.select(
        "o_orderkey", F.upper(F.substring("o_orderpriority", 3, 4)).alias("name"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), F.pmod(F.col("o_orderkey"), F.lit(7)).alias("rest"),
        F.element_at(F.split("o_orderpriority", "-"), 1).alias("rank"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.sqrt(F.floor("o_totalprice").cast("double")).cast("float").cast("double").alias("root"),
    )


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The hashes as SQL functions."""
    hashing.register(spark)
    table(spark, d, "nation").createOrReplaceTempView("rs_nation")
    return spark.sql("SELECT n_nationkey, rs_hash_bytes(n_name) = rs_hash_bytes(upper(n_name)) AS is_upper, rs_hash_long(CAST(n_nationkey AS BIGINT)) IS NOT NULL AS hashed FROM rs_nation")


QUERIES = {f.__name__: f for f in (join_asof, join_semi_anti, grouping_sets, rank_window, set_operations, scalar_functions, sql_functions)}

SQL = {
    "join_asof": """
        WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, user_id, event_type, value FROM events), l AS (SELECT * FROM e WHERE event_type = 'purchase'), r AS (SELECT * FROM e WHERE event_type = 'click'),
        j AS (SELECT l.event_id, l.user_id, r.ts_ms AS t, r.event_id AS i, r.value AS v, l.ts_ms - r.ts_ms <= 864000000 AS near, row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts_ms DESC, r.event_id DESC) AS k FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.ts_ms <= l.ts_ms)
        SELECT event_id, user_id, CASE WHEN near THEN t END AS asof_ts, CASE WHEN near THEN i END AS asof_event_id, CASE WHEN near THEN v END AS asof_value FROM j WHERE k = 1""",
    "join_semi_anti": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AS urgent FROM customer",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS level, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "rank_window": """
        WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS place, lag(o_totalprice) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
        SELECT o_custkey, o_orderkey, o_totalprice, place, CAST(CAST(before - o_totalprice AS FLOAT) AS DOUBLE) AS gap FROM r WHERE place <= 3""",
    "set_operations": """
        WITH f AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F'), o AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O')
        SELECT *, 'both' AS kind FROM (SELECT * FROM f INTERSECT SELECT * FROM o) UNION ALL SELECT *, 'only F' AS kind FROM (SELECT * FROM f EXCEPT SELECT * FROM o)""",
    "scalar_functions": """SELECT o_orderkey, upper(substr(o_orderpriority, 3, 4)) AS name, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, o_orderkey % 7 AS rest, split_part(o_orderpriority, '-', 1) AS rank,
        strftime(o_orderdate, '%Y-%m') AS month, CAST(CAST(sqrt(floor(o_totalprice)) AS FLOAT) AS DOUBLE) AS root FROM orders""",
    "sql_functions": "SELECT n_nationkey, n_name = upper(n_name) AS is_upper, true AS hashed FROM nation",
}
