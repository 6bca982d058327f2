"""Queries p1, p3 and p4 over the project's tables, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstat.functions.events import event_type, is_finite, timed_events
from rillstat.operators import balance, faults, grid
from rillstat.sources import table


def _f(c: Column) -> Column:
    """Rounded to FLOAT, which keeps the magnitude: sums depend on the order of their terms."""
    return c.cast("float").cast("double")


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    """The grid of every source: one row per period, filled and marked."""
    g = grid.regular_grid(timed_events(table(spark, d, "metric_events"), "gauge"), table(spark, d, "report_schedule"))
    return g.select("name_hash", "start_ms", "period_start_ms", "period_ms", "n_readings", _f(F.col("mean_value")).alias("mean_value"), "last_value", "state", _f(F.col("filled_value")).alias("filled_value"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods that no reading covers."""
    return grid.uncovered_periods(timed_events(table(spark, d, "metric_events"), "gauge"), table(spark, d, "report_schedule"))


def p1_counter_grid(spark: SparkSession, d: str) -> DataFrame:
    """Increments per period of a counter that every source has: its readings so far in the hour, which starts anew every hour."""
    e = timed_events(table(spark, d, "metric_events"), "gauge").where(is_finite(F.col("value"))).dropDuplicates(["name_hash", "ts_ms", "seq"])
    hour = Window.partitionBy("name_hash", F.expr("ts_ms div 3600000")).orderBy("ts_ms", "seq")
    counters = e.select("name_hash", "ts_ms", "seq", F.row_number().over(hour).cast("double").alias("value"))
    g = grid.counter_grid(counters, table(spark, d, "report_schedule"))
    return g.withColumn("increment", _f(F.col("increment")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Metrics with more than 3 % of a day's events."""
    per_day = balance.metric_days(timed_events(table(spark, d, "metric_events")))
    return balance.dominant_keys(per_day).select(F.date_format(F.date_from_unix_date("day_no"), "yyyy-MM-dd").alias("day"), "name_hash")


def p3_metric_day(spark: SparkSession, d: str) -> DataFrame:
    """Results per metric and day. Events without name_hash belong to no metric."""
    per_day = balance.metric_days(timed_events(table(spark, d, "metric_events"))).where(F.col("name_hash").isNotNull())
    day = F.date_format(F.date_from_unix_date("day_no"), "yyyy-MM-dd").alias("day")
    return per_day.select("name_hash", day, "n_events", "n_values", _f(F.col("sum_value")).alias("sum_value"), "min_value", "max_value")


def p3_type_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Per metric: its events by whether their type agrees with the registry; the registry is copied only to the shards of each metric."""
    events = timed_events(table(spark, d, "metric_events"), columns=("name_hash", "metric_type", "seq")).select("name_hash", event_type(F.col("metric_type")).alias("type"), "seq")
    registry = table(spark, d, "metric_registry").groupBy("name_hash").agg(F.min(event_type(F.col("metric_type"))).alias("registered"))
    met = balance.balanced_join(events, registry, "name_hash", shard_by="seq")
    once = met.groupBy(balance.TASK, "name_hash", "seq").agg(F.first("type").alias("type"), F.first("registered").alias("registered"))
    agree = F.coalesce(F.col("type") == F.col("registered"), F.lit(False))
    per_task = once.groupBy(balance.TASK, "name_hash").agg(F.count(F.lit(1)).alias("n"), F.sum(agree.cast("long")).alias("ok"), F.max("registered").alias("registered"))
    return per_task.where(F.col("name_hash").isNotNull()).groupBy("name_hash").agg(F.max("registered").alias("registered"), F.sum("n").alias("n_events"), F.sum("ok").alias("n_agree"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Impossible, spiked and stuck gauge readings; each reporting window of a source is judged by itself."""
    return faults.faulty_readings(timed_events(table(spark, d, "metric_events"), "gauge"), table(spark, d, "report_schedule"), table(spark, d, "source_limits"))


QUERIES = {"p1_found": p1_found, "p1_grid": p1_grid, "p1_counter_grid": p1_counter_grid, "p3_found": p3_found, "p3_metric_day": p3_metric_day, "p3_type_mismatch": p3_type_mismatch, "p4_found": p4_found}

_TIMED = "SELECT DISTINCT seq, name_hash, lower(trim(metric_type)) AS type, value, item_hash, ts_ms FROM metric_events WHERE ts_ms >= 946684800000"

SQL = {
    "p1_found": f"""
        WITH e AS ({_TIMED}), s AS (SELECT DISTINCT * FROM report_schedule),
        p AS (SELECT name_hash, start_ms, end_ms, period_ms, unnest(range(start_ms, end_ms, period_ms)) AS period_start_ms FROM s),
        r AS (SELECT DISTINCT s.name_hash, s.start_ms + ((e.ts_ms - s.start_ms) // s.period_ms) * s.period_ms AS period_start_ms
              FROM s JOIN e ON e.name_hash = s.name_hash AND e.ts_ms >= s.start_ms AND e.ts_ms < s.end_ms
              WHERE e.type = 'gauge' AND isfinite(e.value))
        SELECT name_hash, period_start_ms FROM p ANTI JOIN r USING (name_hash, period_start_ms)""",
    "p1_grid": f"""
        WITH e AS ({_TIMED}), s AS (SELECT DISTINCT * FROM report_schedule),
        p AS (SELECT name_hash, start_ms, end_ms, period_ms, unnest(range(start_ms, end_ms, period_ms)) AS period_start_ms FROM s),
        r AS (SELECT s.name_hash, s.start_ms, s.start_ms + ((e.ts_ms - s.start_ms) // s.period_ms) * s.period_ms AS period_start_ms,
                     count(*) AS n, avg(e.value) AS m, arg_max(e.value, (e.ts_ms, e.seq)) AS l
              FROM s JOIN e ON e.name_hash = s.name_hash AND e.ts_ms >= s.start_ms AND e.ts_ms < s.end_ms
              WHERE e.type = 'gauge' AND isfinite(e.value) GROUP BY ALL),
        g AS (SELECT p.*, n, m, l, CASE WHEN n IS NOT NULL THEN period_start_ms END AS t FROM p LEFT JOIN r USING (name_hash, start_ms, period_start_ms)),
        f AS (SELECT *, last_value(t IGNORE NULLS) OVER b AS pt, last_value(m IGNORE NULLS) OVER b AS pv,
                     first_value(t IGNORE NULLS) OVER a AS nt, first_value(m IGNORE NULLS) OVER a AS nv FROM g
              WINDOW b AS (PARTITION BY name_hash, start_ms ORDER BY period_start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     a AS (PARTITION BY name_hash, start_ms ORDER BY period_start_ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT name_hash, start_ms, period_start_ms, period_ms, coalesce(n, 0) AS n_readings, CAST(CAST(m AS FLOAT) AS DOUBLE) AS mean_value, l AS last_value,
               CASE WHEN n IS NOT NULL THEN 'observed' ELSE 'missing' END AS state,
               CAST(CAST(coalesce(m, CASE WHEN nt > pt THEN pv + (nv - pv) * (period_start_ms - pt) / (nt - pt) END, pv, nv) AS FLOAT) AS DOUBLE) AS filled_value FROM f""",
    "p1_counter_grid": f"""
        WITH e AS (SELECT DISTINCT name_hash, ts_ms, seq FROM ({_TIMED}) WHERE type = 'gauge' AND isfinite(value)), s AS (SELECT DISTINCT * FROM report_schedule),
        n AS (SELECT *, CAST(row_number() OVER (PARTITION BY name_hash, ts_ms // 3600000 ORDER BY ts_ms, seq) AS DOUBLE) AS v FROM e),
        m AS (SELECT s.*, n.ts_ms AS t, arg_max(v, seq) AS v FROM s JOIN n ON n.name_hash = s.name_hash AND n.ts_ms >= s.start_ms AND n.ts_ms < s.end_ms GROUP BY ALL),
        p AS (SELECT *, lag(t) OVER w AS t0, lag(v) OVER w AS v0 FROM m WINDOW w AS (PARTITION BY name_hash, start_ms, end_ms, period_ms ORDER BY t)),
        i AS (SELECT name_hash, start_ms, end_ms, period_ms, t0 - start_ms AS a, t - start_ms AS z, v < v0 AS reset, CASE WHEN v < v0 THEN v ELSE v - v0 END AS inc FROM p WHERE t - t0 <= 2 * period_ms),
        x AS (SELECT *, unnest(range(a // period_ms, (z - 1) // period_ms + 1)) AS c FROM i),
        y AS (SELECT name_hash, start_ms, end_ms, period_ms, c, sum(least(z, (c + 1) * period_ms) - greatest(a, c * period_ms)) AS cov,
                     sum(inc * (least(z, (c + 1) * period_ms) - greatest(a, c * period_ms)) / (z - a)) AS inc, sum(CASE WHEN reset AND (z - 1) // period_ms = c THEN 1 ELSE 0 END) AS resets FROM x GROUP BY ALL),
        g AS (SELECT *, unnest(range(0, (end_ms - start_ms - 1) // period_ms + 1)) AS c FROM s)
        SELECT name_hash, start_ms, start_ms + c * period_ms AS period_start_ms, period_ms, CAST(CAST(coalesce(inc, 0.0) AS FLOAT) AS DOUBLE) AS increment, CAST(coalesce(resets, 0) AS BIGINT) AS resets,
               CAST(coalesce(cov, 0) AS BIGINT) AS covered_ms, CASE WHEN cov >= period_ms THEN 'covered' WHEN cov > 0 THEN 'partial' ELSE 'uncovered' END AS state
        FROM g LEFT JOIN y USING (name_hash, start_ms, end_ms, period_ms, c)""",
    "p3_found": f"""
        WITH e AS ({_TIMED}), m AS (SELECT ts_ms // 86400000 AS d, name_hash, count(*) AS n FROM e GROUP BY ALL)
        SELECT strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS day, name_hash
        FROM (SELECT *, sum(n) OVER (PARTITION BY d) AS total FROM m) WHERE name_hash IS NOT NULL AND n > 0.03 * total""",
    "p3_metric_day": f"""
        WITH e AS ({_TIMED}), m AS (SELECT ts_ms // 86400000 AS d, name_hash, count(*) AS n_events, count(*) FILTER (WHERE isfinite(value)) AS n_values,
            sum(value) FILTER (WHERE isfinite(value)) AS s, min(value) FILTER (WHERE isfinite(value)) AS min_value, max(value) FILTER (WHERE isfinite(value)) AS max_value FROM e WHERE name_hash IS NOT NULL GROUP BY ALL)
        SELECT name_hash, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS day, n_events, n_values,
               CAST(CAST(s AS FLOAT) AS DOUBLE) AS sum_value, min_value, max_value FROM m""",
    "p3_type_mismatch": f"""
        WITH e AS ({_TIMED}), r AS (SELECT name_hash, min(lower(trim(metric_type))) AS registered FROM metric_registry GROUP BY 1)
        SELECT e.name_hash, max(registered) AS registered, count(*) AS n_events, CAST(sum(CASE WHEN e.type = registered THEN 1 ELSE 0 END) AS BIGINT) AS n_agree
        FROM e LEFT JOIN r USING (name_hash) WHERE e.name_hash IS NOT NULL GROUP BY e.name_hash""",
}
