"""Files and events as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwork.config import Config
from siftwork.sources import files

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def scan_stream(spark: SparkSession, folder: str, per_batch: int = 1000, config: Config = Config()) -> DataFrame:
    """The rows of `sources.files` for files as they appear below folder, at most per_batch of them at a time."""
    found = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    return files.outputs(found, config)


def drain(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands over everything that is there in batches, then ends. A batch may come again after a failure, with its number."""
    return df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(handle).start()


def windowed_counts(events: DataFrame, at: str, label: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and label; later ones than ``late`` are left out and the state behind it is dropped."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "label", "n")
