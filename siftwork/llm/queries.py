"""Queries of the problems on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import language, leaks, pieces, quality, tokenizer
from siftwork.plans.tables import spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.found(_documents(spark, sf_dir))


def p2_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_stats(_documents(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.document_ids(_documents(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.found(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.found(spread(table(spark, sf_dir, "file_bodies").select("item_id", "file_type", "body")), table(spark, sf_dir, "chunk_limits"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(spread(table(spark, sf_dir, "file_bodies").select("item_id", "file_type", "body")), table(spark, sf_dir, "chunk_limits")).dropDuplicates(["item_id", "piece_no"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.found(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p2_found, p2_stats, p4_found, p4_pieces, p6_ids, p7_found, p8_found)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {}
