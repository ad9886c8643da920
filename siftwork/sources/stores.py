"""Array stores kept as folders, and small tables from database files, as DataFrames."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.onetext import json_values
from siftwork.sources.containers import quoted

MOST_ARRAYS = 128


def store_root(path):
    """The folder of the store that a path lies in."""
    return F.regexp_extract(path, r"^(.*?\.zarr)(?:/|$)", 1)


def store_sizes(files: DataFrame) -> DataFrame:
    """root and byte_count of each store: the files below it added up."""
    own = files.select(store_root(F.col("path")).alias("root"), "length").where("root <> ''")
    return own.groupBy("root").agg(F.sum("length").alias("byte_count"), F.count(F.lit(1)).alias("file_count"))


def store_arrays(files: DataFrame) -> DataFrame:
    """root, array, shape, dtype and chunks of the arrays of each store, from their metadata documents (versions 2 and 3).

    At most MOST_ARRAYS arrays a store are reported, by name.
    """
    from pyspark.sql.window import Window as W

    docs = files.where(F.col("path").rlike(r"\.zarr/(.*/)?(\.zarray|zarr\.json)$")).select(store_root(F.col("path")).alias("root"), "path", F.col("content").cast("string").alias("doc"))
    v3 = F.col("path").endswith("zarr.json")
    g = lambda p: F.get_json_object("doc", p)
    own = docs.where(~v3 | (g("$.node_type") == "array")).select(
        "root",
        F.regexp_extract("path", r"\.zarr/(?:(.*)/)?[^/]+$", 1).alias("array"),
        F.from_json(g("$.shape"), "array<bigint>").alias("shape"),
        F.coalesce(g("$.dtype"), g("$.data_type")).alias("dtype"),
        F.from_json(F.coalesce(g("$.chunks"), g("$.chunk_grid.configuration.chunk_shape")), "array<bigint>").alias("chunks"),
    )
    k = F.row_number().over(W.partitionBy("root").orderBy("array"))
    return own.withColumn("k", k).where(F.col("k") <= MOST_ARRAYS).drop("k")


def sqlite_cells(spark: SparkSession, path: str, tables: list[str]) -> DataFrame:
    """tbl, row_no, col_idx, col_name, value of the rows of a database file, a task a table, read where all executors see
    the file. The column statistics then are those of `tabular`."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["tbl"]:
                db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
                try:
                    cur = db.execute(f"select * from {quoted(name)}")
                    names = [c[0] for c in cur.description]
                    at = 0
                    while rows := cur.fetchmany(2000):
                        out = [(name, at + r, c, names[c], None if v is None else v.hex() if isinstance(v, bytes) else str(v)) for r, row in enumerate(rows) for c, v in enumerate(row)]
                        at += len(rows)
                        yield pd.DataFrame(out, columns=["tbl", "row_no", "col_idx", "col_name", "value"])
                finally:
                    db.close()

    names = spark.createDataFrame([(t,) for t in tables], "tbl string").repartition(max(1, len(tables)))
    return names.mapInPandas(read, "tbl string, row_no bigint, col_idx int, col_name string, value string")


def tetration_summary(data: bytes) -> dict:
    """The container has no public layout: its size, and that it can't be read."""
    return {"byte_count": len(data), "parse_error": "no public description of this container"}


def foreign_keys(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """columns (tbl, name, …) with the reference of each that has one: a left join by table and name."""
    refs = keys.groupBy("tbl", "name").agg(F.min("references").alias("references"))
    return columns.join(refs, ["tbl", "name"], "left").withColumn("is_foreign_key", F.col("references").isNotNull())


def spine_order(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files of a book in reading order; ids that the manifest lacks are skipped."""
    own = manifest.groupBy("book", "id").agg(F.min("href").alias("href"))
    return spine.join(own, (spine["book"] == own["book"]) & (spine["idref"] == own["id"])).select(spine["book"], "pos", "href").orderBy("book", "pos")


def json_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, record, headers of the records of each JSON text, as `onetext.json_values` tells them; headers are the
    names in the first row of an array of rows, else null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["key"].tolist(), b["text"].tolist()):
                records, header = json_values(t)
                rows += [(k, i, json.dumps(r, ensure_ascii=False), header) for i, r in enumerate(records)]
            yield pd.DataFrame(rows, columns=["key", "line_no", "record", "headers"])

    own = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return own.mapInPandas(run, f"key {dict(df.dtypes)[key]}, line_no int, record string, headers array<string>")
