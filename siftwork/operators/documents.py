"""Mining of Markdown and HTML bodies, and summaries of bodies by their type."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.config import Config
from siftwork.functions import text as X
from siftwork.operators.mining import text_templates
from siftwork.sources.containers import epub_parts
from siftwork.sources.documents import html_text, markdown_blocks
from siftwork.sources.files import summarise


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, block_no, kind, level, text, ordered, language of the Markdown blocks of each text; none for null or empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *x) for k, t in zip(b["key"].tolist(), b["text"].tolist()) for i, x in enumerate(markdown_blocks(t))]
            yield pd.DataFrame(rows, columns=["key", "block_no", "kind", "level", "text", "ordered", "language"])

    kind = dict(df.dtypes)[key]
    own = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return own.mapInPandas(run, f"key {kind}, block_no int, kind string, level int, text string, ordered boolean, language string")


def markdown_templates(df: DataFrame, key: str, text: str, config: Config = Config()) -> DataFrame:
    """key, pattern, template_count, example: headers by level, list items by words and kind, paragraphs by words and quotes.
    Other blocks aren't grouped. The example is the first one in order of the text, cut for paragraphs."""
    b = blocks(df, key, text)
    quotes = (F.col("text").contains('"') | F.col("text").contains("'")).cast("string")
    words = F.size(X.tokens(F.col("text")))
    kind = F.when(F.col("ordered"), "ordered").otherwise("unordered")
    pattern = (
        F.when(F.col("kind") == "header", F.format_string("[HEADER_%02d]", F.col("level")))
        .when(F.col("kind") == "item", F.format_string("[LIST_%02d]:type=%s", words, kind))
        .when(F.col("kind") == "paragraph", F.format_string("[PARAGRAPH_%02d]:quotes=%s", words, quotes))
    )
    shown = F.when(F.col("kind") == "paragraph", F.substring("text", 1, config.markdown_preview_length)).otherwise(F.col("text"))
    own = b.select("key", "block_no", pattern.alias("pattern"), shown.alias("shown")).where("pattern is not null")
    return own.groupBy("key", "pattern").agg(F.count(F.lit(1)).alias("template_count"), F.min_by("shown", "block_no").alias("example"))


def html_texts(df: DataFrame, key: str, html: str) -> DataFrame:
    """key and the text of the content elements of each page, ready for the text miner."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "text": [html_text(t) for t in b["html"].tolist()]})

    own = df.where(F.col(html).isNotNull()).select(F.col(key).alias("key"), F.col(html).alias("html"))
    return own.mapInPandas(run, f"key {dict(df.dtypes)[key]}, text string")


def epub_texts(df: DataFrame, key: str, content: str) -> DataFrame:
    """key and the text of the chapters of each book, in the order of the spine; empty for a book that can't be read."""

    def told(data: bytes) -> str:
        try:
            return "\n".join(html_text(c.decode("utf-8", "replace")) for c in epub_parts(data)[1])
        except Exception:  # noqa: BLE001 - any broken book must leave its row
            return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "text": [told(bytes(c)) for c in b["content"].tolist()]})

    own = df.where(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.col(content).alias("content"))
    return own.mapInPandas(run, f"key {dict(df.dtypes)[key]}, text string")


def epub_templates(df: DataFrame, key: str, content: str, config: Config = Config()) -> DataFrame:
    """The templates of the text of each book."""
    return text_templates(epub_texts(df, key, content), "key", "text", config)


def summaries(df: DataFrame, key: str, kind: str, body: str) -> DataFrame:
    """key, metadata (JSON) and failure of each body, read as a file of its type."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = [summarise(k or "Unknown", t.encode("utf-8", "surrogatepass")) for k, t in zip(b["kind"].tolist(), b["body"].tolist())]
            yield pd.DataFrame({"key": b["key"], "metadata": [x for x, _ in told], "failure": [x for _, x in told]})

    own = df.where(F.col(body).isNotNull()).select(F.col(key).alias("key"), F.col(kind).alias("kind"), F.col(body).alias("body"))
    return own.mapInPandas(run, f"key {dict(df.dtypes)[key]}, metadata string, failure string")
