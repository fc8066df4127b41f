"""Gaps between the dates of series that few dates have."""

import datetime as dt

import duckdb
from brindle.plans import ORACLE_SQL, QUERIES


def test_a_series_of_one_date_has_no_gap(spark, tmp_path):
    rows = [(1, 7, "view", dt.datetime(2024, 1, 1, 9), 1.0), (2, 7, "view", dt.datetime(2024, 1, 1, 20), 1.0), (3, 8, "view", dt.datetime(2024, 1, 2), 1.0), (4, 8, "view", dt.datetime(2024, 1, 9), 1.0), (5, 8, "view", dt.datetime(2024, 1, 12), 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = [(r.series_id, r.gap) for r in QUERIES["median_gap"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        assert got == con.execute(ORACLE_SQL["median_gap"]).fetchall() == [("8|view", 5.0)]
