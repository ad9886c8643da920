"""Results out: records as JSON without nulls, one file a source, or a callback per row."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from siftwork.operators.paths import base_name, sanitised

TEMPLATES = ("path", "file_type", "templates", "writing_footprint", "metadata")


def records(df: DataFrame, mode: str = "full") -> DataFrame:
    """path and record, the row as JSON with nulls left out; mode "templates" leaves out the plain counts."""
    if mode not in ("full", "templates"):
        raise ValueError(f"unknown mode {mode}")
    kept = [c for c in df.columns if mode == "full" or c in TEMPLATES]
    return df.select("path", F.to_json(F.struct(*kept), {"ignoreNullFields": "true"}).alias("record"))


def output_name(path) -> F.Column:  # type: ignore[name-defined]
    return F.concat(sanitised(base_name(path)), F.lit(".siftwork.out"))


def write_records(df: DataFrame, folder: str, mode: str = "full") -> None:
    """One file a source in ``folder``, which all executors share. A file is written beside its name and renamed, so that
    a task that runs twice leaves the same file."""
    own = records(df, mode).select(output_name(F.col("path")).alias("name"), "record")

    def put(rows: Iterator[Row]) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            to = os.path.join(folder, r.name)
            part = f"{to}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8") as f:
                f.write(r.record)
            os.replace(part, to)

    own.foreachPartition(put)


def each(df: DataFrame, callback: Callable[[Row], None]) -> None:
    """The callback for every row, where the row is; nothing is collected."""
    df.foreach(callback)


def checked(scanned: DataFrame, failed: DataFrame, shown: int = 5) -> DataFrame:
    """scanned itself; an error that names some of the failures where nothing was scanned."""
    if scanned.limit(1).count() == 0:
        some = [f"{r.path}: {r.message}" for r in failed.limit(shown).collect()]
        raise ValueError("no valid files" + (": " + "; ".join(some) if some else ""))
    return scanned
