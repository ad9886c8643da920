"""Files of any type into one row each: what the scan tells, the summary of their type, and what is mined from them.

Files come from the binaryFile reader, spread over tasks by size; each is decoded and mined where it was read, in one pass and
without a shuffle. A file that can't be decoded keeps its row, with the message and the minimal summary, its size. Logs too
large for one task are read by line (`large_logs`). Whole tables are profiled from Spark's own readers by `tabular`; of a table
in a file, a sample of rows is looked at, and the size of the sample is told.

Defined cases: a file without bytes has no row, as Spark's readers pass over it; bytes that aren't UTF-8 are binary, without counts and
templates; ignored names and the insides of array stores are left out.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.config import Config
from siftwork.operators import mining as M
from siftwork.operators import paths as P
from siftwork.operators import results as R
from siftwork.sources import arrays, columns, containers, documents, media, settings, stores

READERS = {
    "Csv": columns.csv_summary, "Log": documents.log_summary,
    "Zip": containers.zip_summary, "Archive": containers.tar_summary, "Docx": containers.docx_summary, "Xlsx": containers.xlsx_summary, "Pptx": containers.pptx_summary,
    "Epub": lambda d: containers.epub_parts(d)[0], "Sqlite": containers.sqlite_summary, "Toml": settings.toml_summary, "Yaml": settings.yaml_summary,
    "Ini": settings.ini_summary, "Xml": settings.xml_summary, "Html": documents.html_summary, "Json": documents.json_summary, "Pdf": documents.pdf_summary,
    "Npy": arrays.npy_summary, "Npz": arrays.npz_summary, "Mtx": arrays.mtx_summary, "Mat": arrays.mat_summary, "Hdf5": arrays.hdf5_summary, "NetCdf": arrays.netcdf_summary,
    "Pickle": arrays.pickle_summary, "Onnx": arrays.onnx_summary, "Gguf": arrays.gguf_summary, "Safetensors": arrays.safetensors_summary, "Tflite": arrays.tflite_summary,
    "ArrowIpc": arrays.arrow_summary, "Parquet": arrays.parquet_summary, "Orc": arrays.orc_summary, "Avro": arrays.avro_summary,
    "Tetration": stores.tetration_summary, "Image": media.image_summary, "Audio": media.probe_summary, "Video": media.probe_summary,
}

_TAKES = {k: len(inspect.signature(r).parameters) for k, r in READERS.items()}
SCANNED = f"path string, file_type string, byte_count bigint, is_binary boolean, line_count bigint, token_count bigint, metadata string, failure string, {R.RESULT}"


def summarise(kind: str, data: bytes, path: str = "", config: Config = Config()) -> tuple[str, str | None]:
    """Summary as JSON and, where the reader failed, its message; the summary is then the size alone."""
    if kind == "Code":
        return json.dumps(documents.code_summary(data, path), ensure_ascii=False), None
    reader = READERS.get(kind)
    if reader is None:
        return json.dumps({"stream_size": len(data)}), None
    try:
        told = {k: v for k, v in (reader(data, path, config) if _TAKES[kind] == 3 else reader(data)).items() if v is not None}
        return json.dumps(told, ensure_ascii=False, default=str), None
    except Exception as e:  # noqa: BLE001 - any broken file must leave its row
        return json.dumps({"stream_size": len(data)}), f"{type(e).__name__}: {e}"[:500]


def mined_text(kind: str, data: bytes, binary: bool) -> str | None:
    """The text of a file that is mined: its own, or that of a book's chapters; None for types that have no templates."""
    if kind == "Epub":
        return "\n".join(documents.html_text(c.decode("utf-8", "replace")) for c in containers.epub_parts(data)[1])
    return data.decode() if not binary and kind in ("Log", "Json", "Text", "Markdown", "Html", "Unknown") else None


def read(spark: SparkSession, paths, config: Config = Config()) -> DataFrame:
    """One row a file below the paths (one, or any iterable of them). With skip_metadata, summaries are left null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(P.normalised(paths))
    return outputs(files, config)


def outputs(files: DataFrame, config: Config = Config()) -> DataFrame:
    """The rows for files given as path, length and content, as a batch or a stream."""
    own = P.scan(files.select("path", "length", "content"), config)
    schema = R.arrow_schema(SCANNED)

    def row(r: dict) -> dict:
        kind, data = r["file_type"], r.pop("content")
        told, failure = (None, None) if config.skip_metadata else summarise(kind, data, r["path"], config)
        try:
            text = mined_text(kind, data, r["is_binary"])
            got = R.result_row("Text" if kind == "Epub" else kind, text, r["token_count"], config)
        except Exception as e:  # noqa: BLE001 - as above
            got, failure = R.result_row(kind, None, r["token_count"], config), failure or f"{type(e).__name__}: {e}"[:500]
        return r | {"metadata": told, "failure": failure} | got

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):  # a file at a time: contents are large
                yield pa.RecordBatch.from_pylist([row(b.slice(k, 1).to_pylist()[0])], schema=schema)

    return own.mapInArrow(run, SCANNED)


def large_logs(spark: SparkSession, paths, config: Config = Config()) -> DataFrame:
    """key (the path), rank, pattern, template_count of logs of any size: read by line, in splits, and mined by `mining`."""
    lines = spark.read.option("lineSep", "\n").text(P.normalised(paths), recursiveFileLookup=True)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"))
    own = lines.select(F.col("_metadata.file_path").alias("path"), at.alias("at"), F.regexp_replace("value", r"\r$", "").alias("line"))
    return R.top_templates(M.log_templates(own, "path", "line", "at", config), ["key"])


def totals(scanned: DataFrame) -> DataFrame:
    """Files, failures, bytes and lines of a scan by type, and of the whole as type null."""
    n = [F.count(F.lit(1)).alias("files"), F.count("failure").alias("failures"), F.sum("byte_count").alias("bytes"), F.sum("line_count").alias("lines")]
    return scanned.rollup("file_type").agg(*n)


def failures(scanned: DataFrame) -> DataFrame:
    """path and failure of the files that couldn't be decoded."""
    return scanned.where("failure is not null").select("path", F.lit(2).alias("phase"), F.col("failure").alias("message"))


def csv_cells(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', escape: str = '"') -> DataFrame:
    """A delimited file as text columns, the first record as header, ragged rows filled with null."""
    return spark.read.csv(path, header=True, sep=delimiter, quote=quote, escape=escape, inferSchema=False, mode="PERMISSIVE")
