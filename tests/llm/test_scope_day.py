"""Problem 2: every scope and day with events has a row, and sketches of days unite."""

from datetime import date

import __spark_entry__ as driver

DAY = 86_400_000


def test_scopes_without_reports_and_united_days(spark, tmp_path):
    start = 11_000 * DAY
    rows = [(m, "unique", float(1_000_003 * i + 1), None, start + d * DAY + i, i + 1000 * d + 10_000 * m) for m in (1, 2) for d in (0, 1) for i in range(200) if m == 1 or d == 0]
    spark.createDataFrame(rows, "name_hash long, metric_type string, value double, item_hash long, ts_ms long, seq long").write.parquet(f"{tmp_path}/metric_events.parquet")
    spark.createDataFrame([(7, 1), (7, 2), (8, 2), (9, 3)], "scope_id int, name_hash long").write.parquet(f"{tmp_path}/metric_scopes.parquet")
    spark.createDataFrame([(1, date(2000, 2, 13), 7, 200)], "report_id long, report_day date, scope_id int, claimed long").write.parquet(f"{tmp_path}/cardinality_reports.parquet")
    q = driver.queries()
    got = {(r.scope_id, r.day): r.distinct_ids for r in q["p2_scope_day"](spark, str(tmp_path)).collect()}
    assert set(got) == {(7, "2000-02-13"), (7, "2000-02-14"), (8, "2000-02-13")}
    assert all(abs(n - 200) <= 6 for n in got.values())
    united = {r.name_hash: r.distinct_ids for r in q["p2_combined"](spark, str(tmp_path)).collect()}
    assert set(united) == {1, 2} and all(abs(n - 200) <= 6 for n in united.values())
