from __future__ import annotations

import datetime as dt

from siftwork.functions.calendar import days_from_civil, utc_text
from siftwork.operators import timestamps as T
from pyspark.sql import functions as F

CASES = [
    ("2024-03-09T07:05:01.25Z", None, "2024-03-09T07:05:01.250000Z"),
    ("2024-03-09t07:05:01z", "Asia/Tokyo", "2024-03-09T07:05:01.000000Z"),
    ("D:20240309070501+01'00'", None, "2024-03-09T06:05:01.000000Z"),
    ("D:202403090705", "Europe/Berlin", "2024-03-09T06:05:00.000000Z"),
    ("20240309070501-05'00'", None, "2024-03-09T12:05:01.000000Z"),
    ("1700000000", "Asia/Tokyo", "2023-11-14T22:13:20.000000Z"),
    ("1700000000.1234567", None, "2023-11-14T22:13:20.123456Z"),
    ("1700000000123", None, "2023-11-14T22:13:20.123000Z"),
    ("1700000000123456", None, "2023-11-14T22:13:20.123456Z"),
    ("2024-069T01:02:03Z", None, "2024-03-09T01:02:03.000000Z"),
    ("09/03/2024 01:02:03", None, "2024-03-09T01:02:03.000000Z"),
    ("9.3.2024 01:02", None, "2024-03-09T01:02:00.000000Z"),
    ("Sat Mar  9 01:02:03 EST 2024", None, "2024-03-09T06:02:03.000000Z"),
    ("Sat, 09 Mar 2024 01:02:03 +0530", None, "2024-03-08T19:32:03.000000Z"),
    ("Mar 9, 2024 12:02:03 AM", None, "2024-03-09T00:02:03.000000Z"),
    ("2024-10-27 02:30:00", "Europe/Berlin", "2024-10-27T00:30:00.000000Z"),  # twice: the first
    ("2024-03-31 02:30:00", "Europe/Berlin", "2024-03-31T01:30:00.000000Z"),  # skipped: the offset before
    ("2024-03-09 07:05:01 Europe/Lisbon", "Asia/Tokyo", "2024-03-09T07:05:01.000000Z"),
    (" 2024-03-09T07:05:01−05:00 ", None, "2024-03-09T12:05:01.000000Z"),
    ("2024-03-09 07:05:01", "No/Where", "2024-03-09T07:05:01.000000Z"),
    ("Mar 9, 2024 12:02:03\u202fPM", None, "2024-03-09T12:02:03.000000Z"),
    ("2024-02-30", None, None),
    ("2023-02-29T00:00:00Z", None, None),
    ("2024-05-17T27:10:00Z", None, None),
    ("12:45:10", None, None),
    ("D:2021", None, None),
    ("yesterday", None, None),
    ("", None, None),
    ("   ", None, None),
    (None, "Europe/Berlin", None),
    ("2024-03-09 07:05:01 XYZ", None, None),
    ("x" * 100_000, None, None),
]


def test_formats_zones_and_impossible_values(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(CASES)], "i int, v string, z string")
    got = {r.i: r.t for r in T.normalise(df, "v", "z", "us").select("i", utc_text(F.col("us")).alias("t")).collect()}
    assert {i: want for i, (_, _, want) in enumerate(CASES)} == got


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([("2024-01-01", "UTC", 7, "kept")], "v string, z string, a int, ts_us string")
    row = T.normalise(df, "v", "z").collect()[0]
    assert row.ts_us == 1704067200000000 and row.a == 7


def test_day_numbers_agree_with_the_calendar(spark):
    days = [dt.date(1970, 1, 1) + dt.timedelta(days=k * 97) for k in range(-2000, 2000)]
    df = spark.createDataFrame([(d.year, d.month, d.day, (d - dt.date(1970, 1, 1)).days) for d in days], "y long, m long, d long, n long")
    assert df.where(days_from_civil(F.col("y"), F.col("m"), F.col("d")) != F.col("n")).count() == 0


def test_empty_tables(spark):
    pdf = spark.createDataFrame([], "pdf_id long, file_id long, creation_date string, modification_date string")
    tet = spark.createDataFrame([], "tet_id long, file_id long, created_at string")
    his = spark.createDataFrame([], "history_id long, tet_id long, event_at string")
    out = spark.createDataFrame([], "file_id long, site_code string")
    site = spark.createDataFrame([], "site_code string, tz_name string")
    assert T.found(pdf, tet, his, out, site).collect() == []


def test_repeats_and_nulls_in_keys(spark):
    pdf = spark.createDataFrame([(1, 5, "2024-01-01", None), (1, 5, "2024-01-01", None), (None, 5, "2024-01-01", None), (2, None, "2024-01-01", "")], "pdf_id long, file_id long, creation_date string, modification_date string")
    tet = spark.createDataFrame([(9, 5, "2024-01-01 00:00:00")], "tet_id long, file_id long, created_at string")
    his = spark.createDataFrame([(4, 9, "2024-01-01 12:00:00"), (5, None, "1700000000")], "history_id long, tet_id long, event_at string")
    out = spark.createDataFrame([(5, "t"), (5, "t"), (None, "t")], "file_id long, site_code string")
    site = spark.createDataFrame([("t", "Asia/Tokyo")], "site_code string, tz_name string")
    got = sorted((r.tbl, r.row_id, r.ts_utc) for r in T.found(pdf, tet, his, out, site).collect())
    assert got == [
        ("pdf_metadata", 1, "2023-12-31T15:00:00.000000Z"),
        ("pdf_metadata", 2, "2024-01-01T00:00:00.000000Z"),
        ("tet_files", 9, "2023-12-31T15:00:00.000000Z"),
        ("tet_history", 4, "2024-01-01T03:00:00.000000Z"),
        ("tet_history", 5, "2023-11-14T22:13:20.000000Z"),
    ]


def test_timestamps_behind_other_words(spark):
    from siftwork.functions import shapes

    rows = [("INFO 2026-01-21 05:20:35 started", True), ("a b c d e 2026-01-21", True), ("a b c d e f 2026-01-21", False), ("host Mon Dec 1 19:26:16 2025 up", True), ("run 271125 done", True), ("run 991399 done", False), ("no date", False), ("", False)]
    got = spark.createDataFrame(rows, "line string, want boolean").select("line", "want", shapes.timestamp_presence(F.col("line")).alias("got")).collect()
    assert [(r.line, r.got) for r in got] == rows
