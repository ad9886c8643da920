"""Queries over bodies of files: HTML, Markdown, JSON, CSV and the summaries of every type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators import documents as D
from siftwork.operators import mining as M
from siftwork.operators import results as R
from siftwork.plans.tables import spread, table
from siftwork.sources.stores import json_records


def _bodies(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    own = table(spark, d, "file_bodies").where("body is not null").select("item_id", "file_type", "body").distinct()
    return own.where(F.col("file_type") == kind) if kind else own


def r_summaries_file_bodies(spark: SparkSession, d: str) -> DataFrame:
    return D.summaries(_bodies(spark, d), "item_id", "file_type", "body")


def r10_html_tags_file_bodies(spark: SparkSession, d: str) -> DataFrame:
    s = D.summaries(_bodies(spark, d, "Html"), "item_id", "file_type", "body")
    return s.select("key", F.get_json_object("metadata", "$.p_count").cast("bigint").alias("p_count"), F.get_json_object("metadata", "$.table_count").cast("bigint").alias("table_count"))


def r11_html_text_file_bodies(spark: SparkSession, d: str) -> DataFrame:
    return D.html_texts(_bodies(spark, d, "Html"), "item_id", "body")


def m5_html_templates_file_bodies(spark: SparkSession, d: str) -> DataFrame:
    return M.text_templates(D.html_texts(_bodies(spark, d, "Html"), "item_id", "body"), "key", "text").drop("examples")


def g6_markdown_blocks_file_bodies(spark: SparkSession, d: str) -> DataFrame:
    return D.blocks(_bodies(spark, d, "Markdown"), "item_id", "body")


def m4_markdown_templates_file_bodies(spark: SparkSession, d: str) -> DataFrame:
    return D.markdown_templates(_bodies(spark, d, "Markdown"), "item_id", "body")


def m2_json_templates_file_bodies(spark: SparkSession, d: str) -> DataFrame:
    return M.json_templates(json_records(_bodies(spark, d, "Json"), "item_id", "body"), "key", "record", "line_no")


def x5_results_file_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Every body as a file of its type: its templates in order, footprint and compression."""
    kinds = F.when(F.col("file_type").isin("Text", "Markdown", "Json", "Html"), F.col("file_type"))
    got = R.mined(spread(_bodies(spark, d).where(kinds.isNotNull())), "item_id", "body", kinds)
    return got.select("key", F.size("templates").alias("templates"), F.to_json("templates").alias("record"), F.to_json("writing_footprint").alias("footprint"), "original_tokens", "compressed_tokens", "reduction_percent")


def x4_json_examples_file_bodies(spark: SparkSession, d: str) -> DataFrame:
    return M.json_examples(json_records(_bodies(spark, d, "Json"), "item_id", "body"), "key", "record", "line_no")


def t1_ranked_templates_file_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The templates of the JSON bodies with their rank."""
    return R.top_templates(m2_json_templates_file_bodies(spark, d), ["key"])


QUERIES = {f.__name__: f for f in (r_summaries_file_bodies, r10_html_tags_file_bodies, r11_html_text_file_bodies, m5_html_templates_file_bodies, g6_markdown_blocks_file_bodies, m4_markdown_templates_file_bodies, m2_json_templates_file_bodies, x5_results_file_bodies, x4_json_examples_file_bodies, t1_ranked_templates_file_bodies)}
SQL = {
    "r10_html_tags_file_bodies": """select distinct item_id as key, len(regexp_extract_all(lower(body), '<p[\\s>]')) as p_count, len(regexp_extract_all(lower(body), '<table[\\s>]')) as table_count from file_bodies where file_type = 'Html' and body is not null""",
}
