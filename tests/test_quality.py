from __future__ import annotations

import random

from pyspark.sql import functions as F

from siftwork.operators import quality as Q


def test_order_statistics_against_sorting(spark):
    random.seed(1)
    rows = [(g, random.choice([0.0, -1.5, 3.25, 1e-9, 1e12, -7e5, float(random.randint(-50, 50)), random.uniform(-3, 3)])) for g in "aabbbbbbbbbc" for _ in range(60)] + [("d", None), ("e", 4.0)]
    counts = spark.createDataFrame(rows, "g string, x double").groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    total = F.col("total")
    got = {r.g: (r.lo, r.q, r.hi) for r in Q.order_statistics(counts, ["g"], "x", "n", {"lo": F.lit(0), "q": F.floor(3 * total / 4), "hi": total - 1}).collect()}
    for g in "abce":
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (v[0], v[3 * len(v) // 4], v[-1])
    assert "d" not in got


def test_values_that_lie_in_one_bucket(spark, monkeypatch):
    """Groups whose values share their leading bits are cut further, at any bound, and infinities have their own bucket."""
    random.seed(2)
    rows = [("near", 1000.0 + k * 1e-7) for k in range(400)] + [("out", 1.0 + k * 1e-12) for k in range(300)] + [("out", 1.24)] + [("few", 7.0)] * 9
    rows += [("inf", x) for x in (float("inf"), float("-inf"), 1.7e308, 1.0, 2.0)] + [("wide", random.uniform(-1e6, 1e6)) for _ in range(300)]
    counts = spark.createDataFrame(rows, "g string, x double").groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    total = F.col("total")
    ranks = {"lo": F.lit(0), "q1": F.floor(total / 4), "m": F.floor(total / 2), "hi": total - 1}
    for bound, parts in ((8, 16), (1, 4), (1000, 16)):
        monkeypatch.setattr(Q, "BOUND", bound)
        monkeypatch.setattr(Q, "PARTS", parts)
        got = {r.g: (r.lo, r.q1, r.m, r.hi) for r in Q.order_statistics(counts, ["g"], "x", "n", ranks).collect()}
        for g in ("near", "out", "few", "inf", "wide"):
            v = sorted(x for k, x in rows if k == g)
            assert got[g] == (v[0], v[len(v) // 4], v[len(v) // 2], v[-1]), (g, bound)


def _run(spark, rows, info=(), spec=None):
    t = spark.createDataFrame(rows, "feed_no int, load_no int, c string, q int, tbl string")
    s = spark.createDataFrame(spec or [("t", "c", "TEXT", "[a-z]+", None, None, "category"), ("t", "q", "INTEGER", None, 1.0, 5.0, "number")], "tbl string, column_name string, type_name string, value_pattern string, low double, high double, value_kind string")
    i = spark.createDataFrame(list(info), "tbl string, feed_no int, load_no int, column_name string, null_percentage double, unique_count long")
    return {tuple(r) for r in Q.found({"t": t}, s, i).collect()}


def test_issues(spark):
    one = [(1, 1, "ab"[k % 2], k % 4 + 1, "x") for k in range(40)]
    two = [(1, 2, "a" if k < 36 else None, 5 if k < 30 else None, "x") for k in range(40)]
    three = [(1, 3, "A1", 9, None), (1, 3, "nil", 9, None)]
    info = [("t", 1, 1, "q", 0.0, 4), ("t", 1, 1, "c", 1.0, None), ("t", 1, 2, "c", 10.2, 1), ("t", 1, 2, "c", 10.2, 1)]
    got = _run(spark, one + two + three, info)
    assert ("t", 1, 1, "c", "stale") in got and ("t", 1, 1, "q", "stale") not in got and ("t", 1, 2, "c", "stale") not in got
    assert ("t", 1, 2, "c", "drift") in got and ("t", 1, 2, "q", "drift") in got and ("t", 1, 2, "q", "null_rate") in got
    assert ("t", 1, 2, "c", "null_rate") not in got
    assert ("t", 1, 3, "c", "pattern") in got and ("t", 1, 3, "q", "range") in got and ("t", 1, 3, "c", "null_rate") in got
    assert not any(g[2] == 1 and g[4] != "stale" for g in got)


def test_missing_load_has_no_predecessor(spark):
    rows = [(1, 1, "a", 1, "x")] * 4 + [(1, 3, None, None, "x")] * 4
    assert _run(spark, rows) == set()


def test_empty_and_null_feeds(spark):
    assert _run(spark, []) == set()
    assert _run(spark, [(None, None, "1", 7, "x"), (None, 1, None, None, "x")]) == {("t", None, None, "c", "pattern"), ("t", None, None, "q", "range")}


def test_columns_that_the_table_lacks_are_left_out(spark):
    assert _run(spark, [(1, 1, "a", 1, "x")], spec=[("t", "gone", "TEXT", "x", None, None, "text"), ("t", "c", "TEXT", "b", None, None, "text")]) == {("t", 1, 1, "c", "pattern")}
