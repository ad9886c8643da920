from __future__ import annotations

import datetime as dt

import pytest

from siftwork.functions.logscan import automaton, header
from siftwork.operators import loglines as L

US = 1_700_000_000_000_000  # 2023-11-14T22:13:20Z

HEADERS = [
    ('time=2023-11-14T22:13:20Z level=INFO component=reader msg="a \\"b\\" c" extra=1', (US, None, "INFO", "reader", 'a "b" c')),
    ("15/Nov/2023:03:58:20 +0545 | warning | zs | cannot | go", (US, None, "WARN", "zs", "cannot | go")),
    ("[2023-11-14T15:13:20.000-07:00] [cache] [\x1b[32mINFO\x1b[0m] worker 3 idle", (US, None, "INFO", "cache", "worker 3 idle")),
    ("[2023-11-14T22:13:20Z ERR   zs::a] gone", (US, None, "ERROR", "zs::a", "gone")),
    ("2023-11-14 22:13:20,000 crit  miner - no a - b", (US, None, "FATAL", "miner", "no a - b")),
    ("2023/11/14 22:13:20\tscanner\tdone\tnow", (US, None, "", "scanner", "done\tnow")),
    ("1700000000000 W/a::b: late: x", (US, None, "WARN", "a::b", "late: x")),
    ("I1114 22:13:20.000000   123 engine::phases:45] ok", (80_000_000_000, 1114, "INFO", "engine::phases", "ok")),
    ("Nov 14 22:13:20 box1 db.c[77]: ERR: config: x", (80_000_000_000, 1114, "ERROR", "db.c", "config: x")),
    ("Nov  4 22:13:20 box1 db.c[77]: config: x", (80_000_000_000, 1104, "", "db.c", "config: x")),
    ('{"lvl":"info","msg":"t \\u00e9\\n","ts":"2023-11-14T22:13:20.000000Z","mod":"m","n":{"a":[1]}}', (US, None, "INFO", "m", "t é")),
]


@pytest.mark.parametrize("line,want", HEADERS)
def test_layouts(line, want):
    assert header(line) == want


@pytest.mark.parametrize("line", ["", " 2023-11-14 22:13:20,000 INFO a - b", "2023-11-14", "Traceback (most recent call last):", "{", '{"a": 1}', "00000000  c9 df", "2023-13-14 22:13:20,000 INFO a - b", "2023-11-14 25:13:20,000 INFO a - b", "[note] text", "key value", '{"time": "2023-11-14T22:13:20Z'])
def test_lines_that_start_no_entry(line):
    assert header(line) is None


def test_automaton_is_deterministic():
    table, accept = automaton()
    assert accept and all(len(k) == 1 for row in table for k in row)


def _tables(spark, lines, scanned=dt.datetime(2024, 3, 1)):
    rows = spark.createDataFrame(lines, "file_id long, line_no long, raw_line string, message string")
    out = spark.createDataFrame([(1, scanned), (1, scanned), (2, None)], "file_id long, scanned_at timestamp")
    return rows, out


def test_continuations_blanks_repeats_and_order(spark):
    h = "2023-11-14 22:13:20,000 INFO  a - first"
    lines = [(1, 6, "  tail", "x"), (1, 1, "before", "x"), (1, 2, "﻿" + h + "\r", "x"), (1, 3, None, "x"), (1, 4, "   ", "x"), (1, 5, "at x", "x"), (1, 5, "at x", "x"), (1, 7, h, "x"), (1, 8, "", "x"), (None, 1, h, "x"), (1, None, h, "x"), (3, 1, "only text", "x")]
    got = sorted(tuple(r) for r in L.entries(*_tables(spark, lines)).collect())
    assert [(r[1], r[2], r[3], r[6]) for r in got] == [(2, 6, "2023-11-14T22:13:20.000000Z", "first"), (7, 7, "2023-11-14T22:13:20.000000Z", "first")]


def test_entry_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 10)
    h = "2023-11-14 22:13:20,000 INFO  a - m"
    lines = [(1, k, h if k in (3, 47) else f"cont {k}", "x") for k in range(1, 60)]
    assert sorted((r.first_line, r.last_line) for r in L.entries(*_tables(spark, lines)).collect()) == [(3, 46), (47, 59)]


def test_years_come_from_the_scan(spark):
    lines = [(1, 1, "I0229 01:00:00.5 1 a:1] x", "x"), (1, 2, "I0302 01:00:00.5 1 a:1] x", "x"), (2, 1, "I0302 01:00:00.5 1 a:1] x", "x")]
    got = {(r.file_id, r.first_line): r.ts_utc for r in L.entries(*_tables(spark, lines)).collect()}
    assert got == {(1, 1): "2024-02-29T01:00:00.500000Z", (1, 2): "2023-03-02T01:00:00.500000Z", (2, 1): None}


def test_session_zone_makes_no_difference(spark):
    lines, out = _tables(spark, [(1, 1, "I0301 01:00:00.5 1 a:1] x", "x")])
    out = spark.sql("select 1L as file_id, timestamp_ntz'2024-03-01 00:59:59.999999' as scanned_at")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert [r.ts_utc for r in L.entries(lines, out).collect()] == ["2023-03-01T01:00:00.500000Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_empty_table(spark):
    assert L.entries(*_tables(spark, [])).collect() == []
