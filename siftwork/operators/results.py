"""Sources with everything that is mined from them: templates in order, writing footprint, compression.

A text of at most `mining.LOCAL` bytes is mined in one pass where it is read (`siftwork.functions.onetext`), without any shuffle. A
larger one goes through the relational operators of `siftwork.operators.mining`, spread over tasks by line, record or
sentence. Both follow the same rules and give the same results.

Defined cases: a null text or key has no row; an empty text, one without lines, records or full sentences, and one of a type
that isn't mined has no templates, no footprint, no compressed tokens and a reduction of 0; repeats of a row give repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from siftwork.config import Config
from siftwork.functions import onetext as O
from siftwork.functions import text as X
from siftwork.operators import mining as M

_FOOTPRINT = (
    "struct<vocabulary_richness:double,avg_sentence_length:double,punctuation:struct<period_percent:double,question_percent:double,exclamation_percent:double,dialogue_percent:double,"
    "avg_commas_per_sentence:double>,template_diversity:bigint,avg_entropy:double,svo_analysis:struct<svo_structure_percent:double,avg_subject_length:double,avg_object_length:double,common_pivots:array<string>>>"
)
RESULT = f"templates array<struct<pattern:string,count:bigint,examples:map<string,array<string>>>>, writing_footprint {_FOOTPRINT}, original_tokens bigint, compressed_tokens bigint, reduction_percent double"


def arrow_schema(ddl: str):
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def result_row(kind: str, text: str | None, original: int | None, config: Config) -> dict:
    """The columns of RESULT for one text; original: tokens of the source where they aren't those of the text."""
    from siftwork.sources.documents import html_text, markdown_blocks

    if text is not None and kind == "Html":
        got = O.mined(kind, html_text(text), None, config)
        got["original_tokens"] = len(text.encode("utf-8", "surrogatepass")) // 4
    else:
        got = O.mined(kind, text, markdown_blocks(text) if text is not None and kind == "Markdown" else None, config)
    if original is not None:
        got["original_tokens"] = original
    first, used = got["original_tokens"], got["compressed_tokens"]
    got["templates"] = [{"pattern": t[0], "count": t[1], "examples": list(t[2].items())} for t in got["templates"]]
    got["reduction_percent"] = 100.0 * max(first - used, 0) / first if first and used else 0.0
    return got


def _local(own: DataFrame, key_type: str, config: Config) -> DataFrame:
    ddl = f"key {key_type}, {RESULT}"

    schema = arrow_schema(ddl)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            each = zip(b.column("key").to_pylist(), b.column("kind").to_pylist(), b.column("text").to_pylist())
            yield pa.RecordBatch.from_pylist([{"key": k} | result_row(kind or "Unknown", text, None, config) for k, kind, text in each], schema=schema)

    return own.mapInArrow(run, ddl)


def _footprint_struct() -> Column:
    marks = ("period_percent", "question_percent", "exclamation_percent", "dialogue_percent", "avg_commas_per_sentence")
    svo = ("svo_structure_percent", "avg_subject_length", "avg_object_length", "common_pivots")
    return F.struct("vocabulary_richness", "avg_sentence_length", F.struct(*marks).alias("punctuation"), F.col("template_diversity").cast("bigint").alias("template_diversity"), "avg_entropy", F.struct(*svo).alias("svo_analysis")).cast(_FOOTPRINT)


def _spread(large: DataFrame, config: Config) -> DataFrame:
    """The rows of RESULT for texts that are too large for one pass. large: key, kind, text."""
    from siftwork.operators.documents import html_texts
    from siftwork.sources.stores import json_records

    first = F.split(F.substring_index(F.col("text"), "\n", 1), "\r$")[0]
    kind = F.when(F.col("kind") == "Unknown", F.when(F.try_parse_json(first).isNotNull(), "Json").otherwise("Log")).otherwise(F.col("kind"))
    own = large.withColumn("kind", kind)
    of = lambda *k: own.where(F.col("kind").isin(*k)).select("key", "text")
    lines = of("Log").select("key", F.posexplode(X.lines(F.col("text"))).alias("no", "line"))
    records = json_records(of("Json"), "key", "text")
    texts = of("Text", "Epub").unionByName(html_texts(of("Html"), "key", "text"))
    prose = M.templates_with_examples(texts, "key", "text", config)
    log = M.log_templates(lines, "key", "line", "no", config).join(_example_maps(M.log_examples(lines, "key", "line", "no", config)), ["key", "pattern"], "left")
    doc = M.json_templates(records, "key", "record", "line_no", config).join(_example_maps(M.json_examples(records, "key", "record", "line_no", config)), ["key", "pattern"], "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    parts = [t.select("key", "pattern", "template_count", F.coalesce("examples", none).alias("examples")) for t in (log, doc, prose)]
    templates = reduce(DataFrame.unionByName, parts)
    struct = F.struct((-F.col("template_count")).alias("o"), "pattern", F.col("template_count").alias("count"), "examples")
    # the templates of one source: its result
    listed = templates.groupBy("key").agg(F.collect_list(struct).alias("l"), F.sum(M.pattern_tokens(F.col("pattern")) + M.example_total(F.col("examples"), config)).alias("used"))
    listed = listed.select("key", "used", F.transform(F.array_sort("l", lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).when(a["pattern"] < b["pattern"], -1).otherwise(1)), lambda t: F.struct(t["pattern"].alias("pattern"), t["count"].alias("count"), t["examples"].alias("examples"))).alias("templates"))
    shown = F.regexp_extract("pattern", r" \[entropy=([\d.]+)\]$", 1).try_cast("double")
    about = prose.groupBy("key").agg(F.count(F.lit(1)).alias("template_diversity"), F.coalesce(F.avg(shown), F.lit(0.0)).alias("avg_entropy"))
    s = M.sentence_table(texts, "key", "text")
    foot = M.footprint(texts, "key", "text").join(about, "key", "left").join(M.svo(s, "key", "sent_no", "tokens", config), "key").join(M.common_pivots(s, "key", "sent_no", "tokens", config), "key", "left")
    mined = s.where(X.is_full_sentence(F.col("sentence"))).select("key").distinct()
    foot = foot.join(mined, "key", "left_semi").withColumns({"template_diversity": F.coalesce("template_diversity", F.lit(0)), "avg_entropy": F.coalesce("avg_entropy", F.lit(0.0)), "common_pivots": F.coalesce("common_pivots", F.array().cast("array<string>"))})
    foot = foot.select("key", _footprint_struct().alias("writing_footprint"))
    out = own.select("key", F.floor(F.octet_length("text") / 4).alias("original_tokens")).join(listed, "key", "left").join(foot, "key", "left")
    has = F.col("templates").isNotNull() | F.col("writing_footprint").isNotNull()
    extra = F.when(F.col("writing_footprint").isNotNull(), config.footprint_base_overhead_tokens + config.footprint_svo_metrics_tokens + F.size("writing_footprint.svo_analysis.common_pivots")).otherwise(0)
    used = F.when(has, F.coalesce("used", F.lit(0)) + config.json_overhead_tokens + extra).otherwise(0).cast("bigint")
    out = out.withColumn("compressed_tokens", used)
    share = F.when((F.col("original_tokens") > 0) & (F.col("compressed_tokens") > 0), 100.0 * F.greatest(F.col("original_tokens") - F.col("compressed_tokens"), F.lit(0)) / F.col("original_tokens")).otherwise(0.0)
    empty = F.array().cast("array<struct<pattern:string,count:bigint,examples:map<string,array<string>>>>")
    return out.select("key", F.coalesce("templates", empty).alias("templates"), "writing_footprint", "original_tokens", "compressed_tokens", share.alias("reduction_percent"))


def _example_maps(examples: DataFrame) -> DataFrame:
    """key, pattern, examples of rows (key, pattern, placeholder, example_no, example)."""
    each = examples.groupBy("key", "pattern", "placeholder").agg(F.transform(F.array_sort(F.collect_list(F.struct("example_no", "example"))), lambda x: x["example"]).alias("l"))  # ten at most
    return each.groupBy("key", "pattern").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("placeholder", "l")))).alias("examples"))  # the places of one pattern


def mined(df: DataFrame, key: str, text: str, kind: Column, config: Config = Config()) -> DataFrame:
    """key and the columns of RESULT of each text; kind: its type, as `paths.file_type` names it."""
    own = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.coalesce(kind, F.lit("Unknown")).alias("kind"), F.col(text).alias("text"))
    wide = F.octet_length("text") > M.LOCAL
    # Markdown is read block by block in any case
    small = _local(own.where(~wide | (F.col("kind") == "Markdown")), dict(df.dtypes)[key], config)
    large = own.where(wide & (F.col("kind") != "Markdown")).repartition("key")  # one exchange for all that read it
    return small.unionByName(_spread(large, config))


def ranked(results: DataFrame) -> DataFrame:
    """key, rank, pattern, template_count and examples of the templates in results, most frequent first."""
    each = results.select("key", F.posexplode("templates").alias("pos", "t"))
    return each.select("key", (F.col("pos") + 1).alias("rank"), F.col("t.pattern").alias("pattern"), F.col("t.count").alias("template_count"), F.col("t.examples").alias("examples"))


def top_templates(templates: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Templates with their rank in their source: by count, most first, then pattern; with most, the report is cut there."""
    out = templates.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("template_count"), "pattern")))
    return out.where(F.col("rank") <= most) if most else out
