from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from siftwork.functions import typecheck as T
from siftwork.operators import tabular as B


@pytest.mark.parametrize(
    "value,want",
    [
        (None, "null"), ("", "null"), ("NIL", "null"), ("yes", "boolean"), ("1", "boolean"), ("1700000000", "timestamp"), ("1700000000000", "timestamp"), ("2", "number"), ("-1.5e3", "number"),
        ("inf", "number"), (" 1", "string"), ("1d", "string"), ("1_0", "string"), ("2024-01-02", "date"), ("2024-01-02 03:04:05", "date"), ("2024-01-02T03:04:05Z", "date"), ("1/2/2024", "date"), ("x" * 10_000, "string"),
    ],
)
def test_cell_types(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(T.cell_type(F.col("v"))).collect()[0][0] == want


def test_dates_to_seconds(spark):
    rows = [("2025-01-05", 1736035200), ("2025-1-5", 1736035200), ("2025/01/05 01:00:00", 1736038800), ("2025-01-05T01:00:00+01:00", 1736035200), ("2025-01-05T01:00:00.5Z", 1736038800), ("1/5/2025", 1736035200), ("Sun Jan  5 00:00:00 2025", 1736035200), ("[2025-01-05]", 1736035200), ("Jan  5 00:00:01", 1736035201), ("271125", 1764201600), ("2025-01-05 01:00:00Z", 1736038800), ("nil", None), ("2025-13-01", None), ("", None), (None, None)]
    got = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "i int, v string").select("i", T.date_seconds(F.col("v"), 2025)).collect()
    assert {r[0]: r[1] for r in got} == {i: w for i, (_, w) in enumerate(rows)}


def test_numeric_stats_against_the_library(spark):
    random.seed(1)
    rows = [(g, random.choice([round(random.uniform(-9, 9), 1), 0.0, 1e6])) for g in "aab" for _ in range(50)] + [("c", 2.0), ("d", None), ("e", float("nan"))]
    got = {r.g: r for r in B.numeric_stats(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    for g in "ab":
        v = sorted(x for k, x in rows if k == g)
        r = got[g]
        assert (r.value_count, r.min_value, r.max_value) == (len(v), v[0], v[-1])
        assert r.median_value == pytest.approx(statistics.median(v)) and r.stdev == pytest.approx(statistics.stdev(v)) and r.iqr == pytest.approx(v[3 * len(v) // 4] - v[len(v) // 4])
    assert got["c"].stdev is None and "d" not in got and "e" not in got


def test_column_profile(spark):
    rows = [("1", "a", "10.5", "true", "2025-01-01", "", None), ("2", "b", "20", "false", "2025-01-05", "null", None), ("3", "a", "15.75", "true", "2025-01-10", "x", None), ("4", "c", "25", "true", "2025-01-02", "y", None), ("5", "a", "12.5", "false", "2025-01-03", "z", None)]
    df = spark.createDataFrame(rows, "`a.b` string, type string, price string, active string, day string, blank string, none string")
    p = {r.col_name: r for r in B.column_profile(df).collect()}
    assert [p[c].type for c in ("a.b", "type", "price", "active", "day", "none")] == ["number", "string", "number", "boolean", "date", "null"]
    assert p["price"].mean_value == 16.75 and p["price"].median_value == 15.75 and p["price"].value_range == 14.5 and p["price"].iqr == 7.5
    assert p["active"].true_percentage == 60.0 and p["day"].span_days == 9.0 and p["day"].min_date == "2025-01-01T00:00:00+00:00"
    assert p["blank"].null_percentage == 40.0 and p["type"].unique_count == 3 and p["price"].unique_count is None


def test_a_two_makes_a_column_of_bits_numbers(spark):
    df = spark.createDataFrame([(x,) for x in "0110120"], "b string")
    assert B.column_profile(df).collect()[0].type == "number"


def test_planes_and_sparse_moments(spark):
    v = [float(k) for k in range(24)]
    v[5] = float("nan")
    df = spark.createDataFrame([(1, v, 9), (2, None, 9)], "k int, v array<double>, plane int")
    got = sorted(B.plane_stats(df, ["k"], "v", (2, 3, 4), 0).collect(), key=lambda r: r.plane)
    assert [(r.n_values, r.nan_count, r.min_value, r.max_value) for r in got] == [(11, 1, 0.0, 11.0), (12, 0, 12.0, 23.0)]
    s = spark.createDataFrame([(0, 0, 2.0), (1, 0, 4.0), (1, 0, 2.0), (0, 1, -1.0), (1, 1, None)], "r int, c int, x double")
    m = {r.col: r for r in B.sparse_moments(s, "r", "c", "x", 2).collect()}
    assert (m[0].min_value, m[0].max_value, m[0].mean_value, m[0].stdev_pop) == (2.0, 6.0, 4.0, 2.0) and (m[1].min_value, m[1].max_value) == (-1.0, 0.0)
    n = spark.createDataFrame([(x,) for x in (0, 1000, 10**4, 10**5, 10**6, 10**18)], "n long").select(B.reported_planes(F.col("n"))).collect()
    assert [r[0] for r in n] == [0, 32, 35, 38, 41, 64]


def test_empty(spark):
    assert B.column_profile(spark.createDataFrame([], "a string, b int")).collect() == []
