"""Queries of the general problems: column profiles, log lines, mixed timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwork.operators import loglines, quality, timestamps
from siftwork.plans.tables import spread, table

PROFILED = ("order_items", "test_types")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in PROFILED}
    return quality.found(tables, table(spark, sf_dir, "column_spec"), table(spark, sf_dir, "column_info"))


def p1_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in PROFILED}
    return quality.profiles(tables, table(spark, sf_dir, "column_spec"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loglines.entries(spread(table(spark, sf_dir, "log_lines").select("file_id", "line_no", "raw_line")), table(spark, sf_dir, "outputs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.found(*[table(spark, sf_dir, t) for t in ("pdf_metadata", "tet_files", "tet_history", "outputs", "site")])


QUERIES = {f.__name__: f for f in (p1_found, p1_profiles, p3_found, p5_found)}
