"""Queries of the profiling and mining operators, over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import text as X
from siftwork.functions import typecheck as T
from siftwork.operators import mining as M
from siftwork.operators import paths as P
from siftwork.operators import results as R
from siftwork.operators import tabular as B
from siftwork.operators.quality import order_statistics
from siftwork.plans.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_WS = r"[\t-\r \x{85}\p{Z}]+"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"
_NULL = "(v is null or lower(v) in ('', 'null', 'nil'))"
_NUM = f"(case when regexp_matches(v, '{_NUMBER}') then try_cast(v as double) end)"
_SECS = f"(case when {_NUM} between 1e12 and 4e12 then floor({_NUM} / 1000) when {_NUM} between 1e9 and 4e9 then floor({_NUM}) end)"
_DATE = "(" + " or ".join(f"regexp_matches(v, '{p}')" for p in T.DATES) + ")"
_TYPE = f"""case when {_NULL} then 'null' when lower(v) in ('true','false','yes','no','1','0','y','n') then 'boolean'
 when {_SECS} is not null then 'timestamp' when {_NUM} is not null then 'number' when {_DATE} then 'date' else 'string' end"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _round(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- statistics of numbers, dates, booleans and text


@query("""select o_orderpriority, count(o_totalprice) as value_count, min(o_totalprice) as min_value, max(o_totalprice) as max_value,
 round(avg(o_totalprice), 4) as mean_value, round(median(o_totalprice), 4) as median_value,
 round(max(o_totalprice) - min(o_totalprice), 4) as value_range,
 round(list_sort(list(o_totalprice))[(3 * count(*)) // 4 + 1] - list_sort(list(o_totalprice))[count(*) // 4 + 1], 4) as iqr,
 round(stddev_samp(o_totalprice), 4) as stdev from orders where o_totalprice is not null group by 1""")
def a14_numeric_stats_orders(spark: SparkSession, d: str) -> DataFrame:
    return _round(B.numeric_stats(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"), "mean_value", "median_value", "value_range", "iqr", "stdev")


@query("""with e as (select l_suppkey as col, l_partkey as row, sum(l_quantity) as x from lineitem where l_quantity is not null group by 1, 2),
 n as (select count(*) as rows from part)
 select col, count(*) as stored, case when count(*) >= any_value(rows) then min(x) else least(min(x), 0.0) end as min_value,
 case when count(*) >= any_value(rows) then max(x) else greatest(max(x), 0.0) end as max_value, round(sum(x) / any_value(rows), 6) as mean_value,
 round(sqrt(greatest(sum(x * x) / any_value(rows) - power(sum(x) / any_value(rows), 2), 0)), 6) as stdev_pop from e, n group by col""")
def a15_sparse_moments_lineitem(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").count()
    return _round(B.sparse_moments(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_quantity", rows), "mean_value", "stdev_pop", digits=6)


@query("""select l_returnflag, strftime(min(l_shipdate), '%Y-%m-%dT%H:%M:%S+00:00') as min_date, strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%S+00:00') as max_date,
 round((epoch(max(l_shipdate)) - epoch(min(l_shipdate))) / 86400.0, 6) as span_days, round((epoch(max(l_shipdate)) - epoch(min(l_shipdate))) / 60.0, 6) as span_minutes
 from lineitem where l_shipdate is not null group by 1""")
def a16_date_stats_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return _round(B.date_stats(table(spark, d, "lineitem"), ["l_returnflag"], "l_shipdate"), "span_days", "span_minutes", digits=6)


@query("""select feed_no, load_no, round(100.0 * count(*) filter (boolean_field = 1) / count(boolean_field), 6) as true_percentage
 from test_types group by 1, 2""")
def a17_boolean_stats_test_types(spark: SparkSession, d: str) -> DataFrame:
    counts = B.cell_counts(table(spark, d, "test_types"), ["boolean_field"], ["feed_no", "load_no"])
    return _round(B.simple_stats(counts, ["feed_no", "load_no"]).select("feed_no", "load_no", "true_percentage"), "true_percentage", digits=6)


@query(
    " union all ".join(
        f"select '{c}' as col_name, round(100.0 * avg(case when {c} is null or lower({c}) in ('', 'null', 'nil') then 1 else 0 end), 6) as null_percentage, count(distinct case when lower({c}) not in ('', 'null', 'nil') then {c} end) as unique_count, min(octet_length(encode(case when lower({c}) not in ('', 'null', 'nil') then {c} end))) as min_length, max(octet_length(encode(case when lower({c}) not in ('', 'null', 'nil') then {c} end))) as max_length from pdf_metadata"
        for c in ("pdf_version", "title", "author", "creator")
    )
)
def a18_null_unique_pdf_metadata(spark: SparkSession, d: str) -> DataFrame:
    counts = B.cell_counts(table(spark, d, "pdf_metadata"), ["pdf_version", "title", "author", "creator"])
    return _round(B.simple_stats(counts, ["col_name"]).select("col_name", "null_percentage", "unique_count", "min_length", "max_length"), "null_percentage", digits=6)


@query("""select p_brand, min(octet_length(encode(p_name))) as min_length, max(octet_length(encode(p_name))) as max_length, round(avg(octet_length(encode(p_name))), 6) as avg_length from part where p_name is not null group by 1""")
def a20_text_lengths_part(spark: SparkSession, d: str) -> DataFrame:
    counts = B.cell_counts(table(spark, d, "part"), ["p_name"], ["p_brand"])
    return _round(B.simple_stats(counts, ["p_brand"]).select("p_brand", "min_length", "max_length", "avg_length"), "avg_length", digits=6)


_PROFILED = {
    "o_orderkey": "cast(o_orderkey as varchar)", "o_custkey": "cast(o_custkey as varchar)", "o_orderstatus": "o_orderstatus",
    "o_totalprice": "cast(cast(o_totalprice as decimal(18,2)) as varchar)", "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", "o_orderpriority": "o_orderpriority",
}
_CELLS = "with c as (" + " union all ".join(f"select {i} as col_idx, '{k}' as col_name, {v} as v from orders" for i, (k, v) in enumerate(_PROFILED.items())) + ")"
_PRIO = "case k when 'null' then 0 when 'boolean' then 1 when 'timestamp' then 2 when 'number' then 3 when 'date' then 4 else 5 end"
_TYPES = f"""t as (select col_idx, {_TYPE} as k, count(*) as n from c group by 1, 2),
 ty as (select col_idx, case when arg_max(k, (n, {_PRIO})) = 'boolean' and count(*) filter (k not in ('boolean', 'null')) > 0
 then arg_max(k, (n, {_PRIO})) filter (k <> 'boolean') else arg_max(k, (n, {_PRIO})) end as type from t group by 1)"""


def _orders_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))


@query(f"{_CELLS}, {_TYPES} select distinct c.col_idx, c.col_name, ty.type from c join ty using (col_idx)")
def a22_plurality_types_orders(spark: SparkSession, d: str) -> DataFrame:
    return B.inferred_types(B.cell_counts(_orders_text(spark, d), list(_PROFILED)), ["col_idx", "col_name"])


@query(f"""{_CELLS}, {_TYPES}, x as (select c.*, {_NUM} as num, {_NULL} as nul from c)
 select x.col_idx, col_name, ty.type, count(*) as row_count, round(100.0 * avg(nul::int), 6) as null_percentage,
 case when ty.type = 'string' then count(distinct v) filter (not nul) end as unique_count,
 case when ty.type = 'number' then min(num) end as min_value, case when ty.type = 'number' then max(num) end as max_value,
 case when ty.type = 'number' then round(avg(num), 4) end as mean_value, case when ty.type = 'number' then round(median(num), 4) end as median_value,
 case when ty.type = 'number' then round(list_sort(list(num))[(3 * count(num)) // 4 + 1] - list_sort(list(num))[count(num) // 4 + 1], 4) end as iqr,
 case when ty.type = 'number' then round(stddev_samp(num), 4) end as stdev,
 case when ty.type = 'date' then replace(min(v), ' ', 'T') || '+00:00' end as min_date, case when ty.type = 'date' then replace(max(v), ' ', 'T') || '+00:00' end as max_date
 from x join ty using (col_idx) group by 1, 2, 3""")
def a24_column_profile_orders(spark: SparkSession, d: str) -> DataFrame:
    p = B.column_profile(_orders_text(spark, d), list(_PROFILED))
    p = p.select("col_idx", "col_name", "type", "row_count", "null_percentage", "unique_count", "min_value", "max_value", "mean_value", "median_value", "iqr", "stdev", "min_date", "max_date")
    return _round(_round(p, "null_percentage", digits=6), "mean_value", "median_value", "iqr", "stdev")


_COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "outputs", "log_lines")


@query(" union all ".join(f"select '{t}' as tbl, count(*) as row_count from {t}" for t in _COUNTED))
def a25_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.row_counts({t: table(spark, d, t) for t in _COUNTED})


@query("""select vec_id, (i - 1) // 16 as plane, count(*) filter (isfinite(x)) as n_values, count(*) filter (isnan(x)) as nan_count, count(*) filter (isinf(x)) as inf_count, round(min(x), 6) as min_value, round(max(x), 6) as max_value, round(avg(x), 6) as mean_value, round(stddev_pop(x), 6) as stdev_pop
 from (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2""")
def a27_tensor_planes_embeddings(spark: SparkSession, d: str) -> DataFrame:
    df = B.plane_stats(table(spark, d, "embeddings"), ["vec_id"], "embedding", (4, 4, 4))
    return _round(df, "min_value", "max_value", "mean_value", "stdev_pop", digits=6).withColumn("plane", F.col("plane").cast("bigint"))


@query("select event_type as label, count(*) as label_count from events group by 1")
def a30_histogram_events(spark: SparkSession, d: str) -> DataFrame:
    return B.histogram(table(spark, d, "events"), "event_type")


@query("select source as label, count(*) as label_count from documents group by 1 order by 2 desc, 1 limit 5")
def t4_top_sources_documents(spark: SparkSession, d: str) -> DataFrame:
    return B.histogram(table(spark, d, "documents"), "source", 5)


@query("""with m as (select file_type, count(*) as n, sum(byte_count) // count(*) as mean from outputs where byte_count is not null group by 1),
 v as (select file_type, n, mean, sqrt(sum((byte_count - mean) * (byte_count - mean)) / n) / mean as cv from outputs join m using (file_type) where byte_count is not null group by file_type, n, mean)
 select file_type, n as file_count, cast(mean as bigint) as mean_bytes, round(case when mean > 0 then cv else 0 end, 6) as cv,
 case when n = 1 or file_type in ('Image', 'Audio') then 1 when mean < 100000 then 1 when mean < 1000000 then case when cv > 0.5 then 1 else 2 end when cv > 0.5 then 2 else 3 end as multiplier from v""")
def a33_size_cv_outputs(spark: SparkSession, d: str) -> DataFrame:
    return _round(P.adaptive_chunking(table(spark, d, "outputs"), "byte_count", ["file_type"]), "cv", digits=6)


@query("""with c as (select l_returnflag as g, l_extendedprice as x from lineitem where l_extendedprice is not null)
 select g, list_sort(list(x))[1 + count(*) // 10] as p10, list_sort(list(x))[1 + 9 * count(*) // 10] as p90 from c group by 1""")
def t3_order_statistics_lineitem(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return order_statistics(counts, ["g"], "x", "n", {"p10": F.floor(F.col("total") / 10), "p90": F.floor(9 * F.col("total") / 10)})


# --- scalars on cells, names and paths


_VALUES = "select creation_date as v from pdf_metadata union all select date_field from test_types union all select text_field from test_types union all select cast(boolean_field as varchar) from test_types union all select cast(integer_field as varchar) from test_types"


def _values(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "test_types")
    own = [t.select(F.col(c).cast("string").alias("v")) for c in ("date_field", "text_field", "boolean_field", "integer_field")]
    return reduce(DataFrame.unionByName, own, table(spark, d, "pdf_metadata").select(F.col("creation_date").alias("v")))


@query(f"select {_TYPE} as type, count(*) as n, count(distinct v) as kinds from ({_VALUES}) group by 1")
def f9_cell_types(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).groupBy(T.cell_type(F.col("v")).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("kinds"))


@query(f"select v, cast({_SECS} as bigint) as seconds, count(*) as n from ({_VALUES}) where {_SECS} is not null group by 1, 2")
def f4_unix_seconds(spark: SparkSession, d: str) -> DataFrame:
    s = _values(spark, d).select("v", T.unix_seconds(F.col("v")).alias("seconds"))
    return s.where("seconds is not null").groupBy("v", "seconds").agg(F.count(F.lit(1)).alias("n"))


@query(r"select file_id, line_no, count(*) as n from log_lines where regexp_matches(raw_line, '[1-3]\d{9}|4000000000|[1-3]\d{12}|4000000000000') group by 1, 2")
def f5_unix_time_in_log_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "log_lines").where(T.has_unix_time(F.col("raw_line"))).groupBy("file_id", "line_no").agg(F.count(F.lit(1)).alias("n"))


@query("select l_linenumber + 96 as i, '[POS_' || case when l_linenumber + 96 < 10 then '0' else '' end || (l_linenumber + 96) || ']' as placeholder, count(*) as n from lineitem group by 1, 2")
def f16_placeholders_lineitem(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("l_linenumber") + 96
    return table(spark, d, "lineitem").groupBy(i.alias("i"), X.placeholder("POS", i).alias("placeholder")).agg(F.count(F.lit(1)).alias("n"))


@query(r"select distinct file_id, '***/' || regexp_extract(source, '([^/\\]*)$', 1) as redacted from outputs where source is not null")
def f17_redact_outputs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "outputs").where("source is not null").select("file_id", P.redacted(F.col("source")).alias("redacted")).distinct()


@query("""select file_id, case when byte_count < 1024 then byte_count || ' B' when byte_count < 1048576 then printf('%.2f KB', floor(byte_count * 100 / 1024.0 + 0.5) / 100)
 when byte_count < 1073741824 then printf('%.2f MB', floor(byte_count * 100 / 1048576.0 + 0.5) / 100) else printf('%.2f GB', floor(byte_count * 100 / 1073741824.0 + 0.5) / 100) end as shown from (select distinct file_id, byte_count from outputs where byte_count is not null)""")
def f18_human_bytes_outputs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "outputs").where("byte_count is not null").select("file_id", "byte_count").distinct().select("file_id", P.human_bytes(F.col("byte_count")).alias("shown"))


_LINES = r"""case when text = '' then [] else string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) end"""


@query(rf"""with x as (select doc_id, text, {_LINES} as ls, (length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2 as crlf,
 length(text) - length(replace(text, chr(10), '')) as lf, length(text) - length(replace(text, chr(13), '')) as cr from (select distinct doc_id, text from documents where text is not null))
 select doc_id as key, octet_length(encode(text)) as byte_count, len(ls) as line_count,
 case when (crlf > 0)::int + (lf > crlf)::int + (cr > crlf)::int > 1 then 'mixed' when crlf > 0 then 'crlf' when lf > 0 then 'lf' when cr > 0 then 'cr' end as line_ending,
 coalesce(list_max(list_transform(ls, lambda s: octet_length(encode(s)))), 0) as max_line_length,
 len(list_filter(ls, lambda s: regexp_full_match(s, '[\t-\r \x{{85}}\p{{Z}}]*'))) as blank_line_count from x""")
def a35_line_stats_documents(spark: SparkSession, d: str) -> DataFrame:
    return M.line_stats(table(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text")


# The types of extensions as the reference's documentation lists them, for the SQL only: the operator has a list of its own.
_TYPED = """Log:log Json:json Text:txt Markdown:md Markdown:markdown Image:jpg Image:jpeg Image:png Image:gif Image:bmp Image:tiff Image:tif Image:webp Image:ico Image:svg
 Video:mp4 Video:avi Video:mkv Video:mov Video:wmv Video:flv Video:webm Video:m4v Video:3gp Video:ogv Audio:mp3 Audio:flac Audio:wav Audio:m4a Audio:aac Audio:ogg Audio:opus Audio:wma Audio:ape
 Audio:dsd Audio:dsf Audio:aif Audio:aiff Audio:aifc Csv:csv Csv:tsv Csv:tab Csv:psv Parquet:parquet ArrowIpc:arrow ArrowIpc:feather ArrowIpc:ipc Avro:avro Orc:orc Npy:npy Npz:npz Hdf5:h5 Hdf5:hdf5
 NetCdf:nc NetCdf:cdf Mtx:mtx Mat:mat Onnx:onnx Gguf:gguf Tflite:tflite Safetensors:safetensors Zarr:zarr Tetration:tet Pickle:pickle Html:html Html:htm Docx:docx Xlsx:xlsx Pptx:pptx
 Sqlite:db Sqlite:sqlite Sqlite:sqlite3 Toml:toml Toml:lock Ini:ini Ini:cfg Xml:xml Yaml:yaml Yaml:yml Zip:zip Archive:tar Archive:gz Archive:bz2 Archive:xz Archive:tgz Epub:epub Pdf:pdf"""
_EXT = f"x as (select split_part(p, ':', 1) as file_type, split_part(p, ':', 2) as ext from (select unnest(string_split_regex('{_TYPED}', '\\s+')) as p))"


@query(f"with {_EXT} select file_type, ext from x")
def sc8_extensions(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t, e) for t in P.EXTENSIONS for e in P.extensions_of(t)], "file_type string, ext string")


@query(f"""with {_EXT}, c as (select distinct event_type || ' ' || e || '_1' as codec from events, (select unnest(['MP3', 'h264', 'Flac', 'aac_latm', 'mp4v', 'pcm', 'vp9']) as e))
 select codec, exists(select 1 from x where x.file_type = 'Audio' and contains(lower(codec), ext)) as audio, exists(select 1 from x where x.file_type = 'Video' and contains(lower(codec), ext)) as video from c""")
def sc9_codecs_events(spark: SparkSession, d: str) -> DataFrame:
    names = F.explode(F.array(*[F.lit(x) for x in ("MP3", "h264", "Flac", "aac_latm", "mp4v", "pcm", "vp9")]))
    c = table(spark, d, "events").select("event_type").distinct().select("event_type", names.alias("e")).select(F.concat("event_type", F.lit(" "), "e", F.lit("_1")).alias("codec"))
    return c.select("codec", P.is_codec_of(F.col("codec"), "Audio").alias("audio"), P.is_codec_of(F.col("codec"), "Video").alias("video"))


_VARIANTS = "('', '.TAR.GZ', '.tgz', '.Xz', '.markdown', '.lock', '.3GP', '.cdf', '.pkl', '.none')"


@query(f"""with {_EXT}, s as (select distinct source || e as source from outputs, (select unnest([{_VARIANTS[1:-1]}]) as e) where source is not null),
 n as (select source, lower(regexp_extract(source, '^.+\\.([^./]*)$', 1)) as ext from s)
 select source, case when lower(source) like '%.tar.gz' or lower(source) like '%.tar.bz2' or lower(source) like '%.tar.xz' or lower(source) like '%.tgz' then 'Archive' else coalesce(x.file_type, 'Unknown') end as file_type
 from n left join x using (ext)""")
def sc7_classify_outputs(spark: SparkSession, d: str) -> DataFrame:
    ends = F.explode(F.array(*[F.lit(x.strip("' ")) for x in _VARIANTS[1:-1].split(",")]))
    own = table(spark, d, "outputs").where("source is not null").select("source").distinct().select("source", ends.alias("e")).select(F.concat("source", "e").alias("source"))
    return own.select("source", P.file_type(F.col("source")).alias("file_type"))


@query(f"""with {_EXT}, s as (select distinct source, lower(regexp_extract(source, '\\.([^./]*)$', 1)) as ext from outputs where source is not null) select source, x.file_type from s left join x using (ext)""")
def j11_types_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The lookup of SC7 alone: extension to type, null where the map has none."""
    own = table(spark, d, "outputs").where("source is not null").select("source").distinct()
    return own.select("source", F.nullif(P.file_type(F.col("source")), F.lit("Unknown")).alias("file_type"))


@query("""with l as (select unnest(['Log', 'JSON', 'Text', 'Markdown', 'Image', 'Video', 'Audio', 'CSV', 'PDF', 'DOCX', 'XLSX', 'SQLite', 'TOML', 'ZIP', 'XML', 'HTML', 'YAML', 'INI', 'PPTX', 'EPUB', 'Archive', 'Code', 'Parquet', 'Arrow IPC',
 'Avro', 'ORC', 'NPY', 'NPZ', 'HDF5', 'NetCDF', 'Matrix Market', 'MATLAB MAT', 'ONNX', 'GGUF', 'TFLite', 'Safetensors', 'Zarr', 'Tetration', 'Pickle', 'Unknown']) as label), f as (select distinct file_type as label from file_bodies where file_type is not null)
 select label, case when label in (select label from l) then label end as again from (select label from l union select label from f)""")
def sc15_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels, and what their type is called again: every label comes back, any other text gives null."""
    known = spark.createDataFrame([(t,) for t in P.LABELS], "t string").select(P.label(F.col("t")).alias("label"))
    every = known.union(table(spark, d, "file_bodies").where("file_type is not null").select("file_type")).distinct()
    return every.select("label", P.label(P.labelled(F.col("label"))).alias("again"))


_IGNORED = """with p as (select unnest(['/a/.DS_Store', '/b/Desktop.ini', '/c/EHThumbs.DB', '~$' || split_part(source, '/', -1), source || '.swp', source || '~', source || '.bak', source || '.TMP', '/h/.' || split_part(source, '/', -1), source]) as path from (select distinct source from outputs where source is not null)),
 n as (select path, regexp_extract(path, '([^/\\\\]*)$', 1) as name from p)"""


@query(f"""{_IGNORED} select distinct path, name like '.%' or lower(name) in ('.ds_store', 'thumbs.db', 'desktop.ini', 'ehthumbs.db') or starts_with(name, '~$')
 or suffix(name, '.swp') or suffix(name, '.swo') or suffix(name, '.tmp') or suffix(name, '~') as ignored from n""")
def sc6_ignored_paths(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "outputs").where("source is not null").select("source").distinct()
    name = P.base_name(F.col("source"))
    made = F.array(F.lit("/a/.DS_Store"), F.lit("/b/Desktop.ini"), F.lit("/c/EHThumbs.DB"), F.concat(F.lit("~$"), name), *[F.concat("source", F.lit(e)) for e in (".swp", "~", ".bak", ".TMP")], F.concat(F.lit("/h/."), name), F.col("source"))
    return s.select(F.explode(made).alias("path")).select("path", P.is_ignored(F.col("path")).alias("ignored")).distinct()


# --- tokens, n-grams, log and JSON templates


_TOKENS = f"list_filter(string_split_regex(raw_line, '{_WS}'), lambda t: t <> '')"


@query(f"""with l as (select file_id as key, {_TOKENS} as tok from log_lines where raw_line is not null),
 e as (select key, unnest(tok) as token, generate_subscripts(tok, 1) - 1 as pos from l) select key, pos, token, count(*) as n from e group by 1, 2, 3""")
def a1_positional_frequency_log_lines(spark: SparkSession, d: str) -> DataFrame:
    return M.positional_frequency(table(spark, d, "log_lines"), "file_id", "raw_line").withColumn("pos", F.col("pos").cast("bigint"))


_STATIC = f"""with l as (select file_id as key, line_no as ord, {_TOKENS} as tok from log_lines where raw_line is not null),
 e as (select key, unnest(tok) as token, generate_subscripts(tok, 1) - 1 as pos from l), c as (select key, count(*) as line_count from l group by 1),
 s as (select key, pos, max(token) as token from e join c using (key) group by key, pos, line_count having count(distinct token) = 1 and count(*) >= floor(line_count * 0.8))"""


@query(f"{_STATIC} select key, pos, token from s")
def a2_static_positions_log_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "log_lines").where("raw_line is not null")
    counts = lines.groupBy(F.col("file_id").alias("key")).agg(F.count(F.lit(1)).alias("line_count"))
    return M.static_positions(M.positional_frequency(lines, "file_id", "raw_line"), counts).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"""{_STATIC}, m as (select key, map(list(pos), list(token)) as static from s group by 1),
 p as (select l.key, list_reduce(list_prepend('', list_transform(tok, lambda t, i: coalesce(static[i - 1], '[POS_' || printf('%02d', i - 1) || ']'))), lambda a, b: case when a = '' then b else a || ' ' || b end) as pattern from l left join m on l.key = m.key)
 select key, pattern, count(*) as template_count from p group by 1, 2""")
def m1_log_templates_log_lines(spark: SparkSession, d: str) -> DataFrame:
    return M.log_templates(table(spark, d, "log_lines"), "file_id", "raw_line", "line_no")


@query()
def x1_log_examples_log_lines(spark: SparkSession, d: str) -> DataFrame:
    return M.log_examples(table(spark, d, "log_lines"), "file_id", "raw_line", "line_no")


@query("""with k as (select event_type as key, event_id as ord, unnest(json_keys(props)) as jkey, props from events where props is not null)
 select key, jkey, cast(json_extract(props, '$."' || jkey || '"') as varchar) as value, count(*) as n from k group by 1, 2, 3""")
def f26_json_values_events(spark: SparkSession, d: str) -> DataFrame:
    return M.json_pairs(table(spark, d, "events"), "event_type", "props", "event_id").groupBy("key", "jkey", "value").agg(F.count(F.lit(1)).alias("n"))


@query("""with k as (select event_type as key, event_id as ord, unnest(json_keys(props)) as jkey, props from events where props is not null),
 v as (select key, ord, jkey, cast(json_extract(props, '$."' || jkey || '"') as varchar) as value from k),
 n as (select event_type as key, count(*) as n_records from events where props is not null group by 1),
 f as (select key, jkey, value, count(*) as n from v group by 1, 2, 3), s as (select f.* from f join n using (key) where n >= floor(n_records * 0.8)),
 p as (select v.key, v.ord, '"' || v.jkey || '": ' || case when s.value is not null then v.value else '[VALUE]' end as part from v left join s on v.key = s.key and v.jkey = s.jkey and v.value = s.value),
 r as (select key, ord, '{' || string_agg(part, ', ' order by part) || '}' as pattern from p group by 1, 2)
 select key, pattern, count(*) as template_count from r group by 1, 2""")
def m2_json_templates_events(spark: SparkSession, d: str) -> DataFrame:
    return M.json_templates(table(spark, d, "events"), "event_type", "props", "event_id")


_BENCH = f"list_filter(string_split_regex(text, '{_WS}'), lambda t: t <> '')"
_GRAMS = f"""with t as (select item_id as key, {_BENCH} as tok from benchmark where text is not null),
 g as (select key, unnest(list_concat(""" + ", ".join(f"list_transform(range(1, len(tok) - {k} + 2), lambda i: list_aggregate(list_slice(tok, i, i + {k} - 1), 'string_agg', ' '))" for k in (2, 3, 4)) + ")) as ngram from t)"  # fmt: skip


@query(f"{_GRAMS} select key, ngram, count(*) as n from g group by 1, 2")
def a4_ngrams_benchmark(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "benchmark").where("text is not null").select("item_id", X.tokens(F.col("text")).alias("tok"))
    return M.ngram_counts(s, "item_id", "tok")


@query(f"{_GRAMS}, n as (select ngram, count(*) as n from g group by 1) select 1 as key, ngram, n from n where n >= floor((select count(*) from t) * 0.01)")
def a5_frequent_ngrams_benchmark(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "benchmark").where("text is not null").select(F.lit(1).alias("k"), X.tokens(F.col("text")).alias("tok"))
    return M.frequent_ngrams(M.ngram_counts(s, "k", "tok"), s.groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("n_sentences")))


_LINEWORDS = f"""with l as (select file_id as key, line_no as ord, list_transform({_TOKENS}, lambda t: lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) as w from (select distinct file_id, line_no, raw_line from log_lines where raw_line is not null)),
 e as (select key, ord, len(w) as len, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos, w from l), z as (select key, count(*) as total from l group by 1),
 n as (select key, pos, word, nullif(w[pos + 2], '') as next from e where word <> ''),
 p as (select key, pos, word, count(*) as n, count(distinct next) as variation from n join z using (key) group by key, pos, word, total
 having count(*) >= floor(greatest(total * 0.01, 2)) and count(distinct next) between 2 and 50)"""


def _line_sentences(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "log_lines").where("raw_line is not null").select("file_id", "line_no", "raw_line").distinct()
    return own.withColumn("tok", X.tokens(F.col("raw_line")))


@query(f"{_LINEWORDS} select key, pos, word, n, variation from p")
def a10_pivots_log_lines(spark: SparkSession, d: str) -> DataFrame:
    return M.pivots(_line_sentences(spark, d), "file_id", "tok").withColumn("pos", F.col("pos").cast("bigint"))


@query(f"""{_LINEWORDS}, h as (select e.key, e.ord, min(e.pos) as pos, max(e.len) as len from e join p using (key, pos, word) group by 1, 2),
 s as (select key, count(*) as c, coalesce(avg(case when pos > 0 then pos end), 0) as subj, coalesce(avg(case when len - pos - 1 > 0 then len - pos - 1 end), 0) as obj from h group by 1)
 select z.key, z.total as n_sentences, round(100.0 * coalesce(c, 0) / total, 6) as svo_structure_percent, round(coalesce(subj, 0), 6) as avg_subject_length, round(coalesce(obj, 0), 6) as avg_object_length from z left join s using (key)""")
def a11_svo_log_lines(spark: SparkSession, d: str) -> DataFrame:
    return _round(M.svo(_line_sentences(spark, d), "file_id", "line_no", "tok"), "svo_structure_percent", "avg_subject_length", "avg_object_length", digits=6)


@query(f"{_LINEWORDS}, r as (select *, row_number() over (partition by key order by n desc, pos, word) as rank from p) select key, pos, word, n, variation, rank from r where rank <= 10")
def t2_top_pivots_log_lines(spark: SparkSession, d: str) -> DataFrame:
    return M.top_pivots(M.pivots(_line_sentences(spark, d), "file_id", "tok").withColumn("pos", F.col("pos").cast("bigint"))).withColumn("rank", F.col("rank").cast("bigint"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text")).distinct()


@query()
def g3_sentences_documents(spark: SparkSession, d: str) -> DataFrame:
    return M.sentence_table(_texts(spark, d), "doc_id", "text").select("key", "sent_no", "sentence")


@query()
def f25_sentence_shapes_documents(spark: SparkSession, d: str) -> DataFrame:
    s = M.sentence_table(_texts(spark, d), "doc_id", "text")
    return s.groupBy(F.size("tokens").alias("word_count"), X.end_type(F.col("sentence")).alias("end_type")).agg(F.count(F.lit(1)).alias("n"))


@query()
def a12_footprint_documents(spark: SparkSession, d: str) -> DataFrame:
    return M.footprint(_texts(spark, d), "doc_id", "text")


@query()
def m3_text_templates_documents(spark: SparkSession, d: str) -> DataFrame:
    return M.text_templates(_texts(spark, d), "doc_id", "text").drop("examples")


@query()
def a32_compression_documents(spark: SparkSession, d: str) -> DataFrame:
    return R.mined(_texts(spark, d), "doc_id", "text", F.lit("Text")).select("key", "original_tokens", "compressed_tokens", "reduction_percent")


@query("""with p as (select file_id as key, template_pattern as pattern from (select distinct template_id, file_id, template_pattern from templates where template_pattern is not null)),
 u as (select key, sum(len(string_split(pattern, ' '))) as t from p group by 1), o as (select file_id as key, max(token_count) as original_tokens from outputs where token_count is not null group by 1)
 select o.key, original_tokens, coalesce(t, 0) + 50 as compressed_tokens, round(case when original_tokens > 0 then 100.0 * greatest(original_tokens - coalesce(t, 0) - 50, 0) / original_tokens else 0 end, 6) as reduction_percent
 from o left join u using (key)""")
def a31_compression_templates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "templates").where("template_pattern is not null").select("template_id", F.col("file_id").alias("key"), F.col("template_pattern").alias("pattern")).distinct()
    o = table(spark, d, "outputs").where("token_count is not null").groupBy(F.col("file_id").alias("key")).agg(F.max("token_count").alias("original_tokens"))
    return _round(M.compression(t, o), "reduction_percent", digits=6)


@query("""with e as (select distinct template_id, file_id as key, template_pattern as pattern, entry.key as placeholder, unnest(entry.value) as example
 from (select template_id, file_id, template_pattern, unnest(map_entries(template_examples)) as entry from templates where template_pattern is not null and template_examples is not null)),
 n as (select template_id, key, pattern, sum(n) as examples from (select template_id, key, pattern, placeholder, least(count(distinct example), 5) as n from e group by 1, 2, 3, 4) group by 1, 2, 3),
 p as (select distinct template_id, file_id as key, template_pattern as pattern from templates where template_pattern is not null),
 u as (select p.key, sum(len(string_split(p.pattern, ' ')) + coalesce(examples, 0)) as t from p left join n on p.template_id = n.template_id and p.key = n.key and p.pattern = n.pattern group by 1),
 o as (select file_id as key, max(token_count) as original_tokens from outputs where token_count is not null group by 1)
 select o.key, original_tokens, coalesce(t, 0) + 50 as compressed_tokens, round(case when original_tokens > 0 then 100.0 * greatest(original_tokens - coalesce(t, 0) - 50, 0) / original_tokens else 0 end, 6) as reduction_percent
 from o left join u using (key)""")
def a31_compression_with_examples_templates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "templates").where("template_pattern is not null")
    by = ["template_id", "key", "pattern"]
    lists = t.select("template_id", F.col("file_id").alias("key"), F.col("template_pattern").alias("pattern"), F.explode_outer("template_examples").alias("placeholder", "list"))
    counted = M.example_counts(lists.select(*by, "placeholder", F.explode_outer("list").alias("example")), by)
    o = table(spark, d, "outputs").where("token_count is not null").groupBy(F.col("file_id").alias("key")).agg(F.max("token_count").alias("original_tokens"))
    return _round(M.compression(counted, o), "reduction_percent", digits=6)


@query("""with e as (select distinct template_id, entry.key as placeholder, unnest(entry.value) as example from (select template_id, unnest(map_entries(template_examples)) as entry from templates where template_examples is not null)),
 n as (select template_id, placeholder, least(count(distinct example), 10) as n from e group by 1, 2) select template_id, round(avg(case when n <= 1 then 0 else least(n / 5.0, 1) end), 6) as entropy from n group by 1""")
def a13_entropy_templates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "templates").where("template_examples is not null").select("template_id", F.explode("template_examples").alias("placeholder", "list"))
    return _round(M.entropy(t.select("template_id", "placeholder", F.explode("list").alias("example")), ["template_id"]), "entropy", digits=6)


@query(r"""with h as (select distinct item_id as key, list_aggregate(list_slice(string_split(regexp_replace(replace(body, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)), 1, 5), 'string_agg', chr(10)) as t from file_bodies where body is not null),
 c as (select key, unnest([{'n': length(t) - length(replace(t, ',', '')), 'i': 0, 'm': ','}, {'n': length(t) - length(replace(t, ';', '')), 'i': -1, 'm': ';'}, {'n': length(t) - length(replace(t, chr(9), '')), 'i': -2, 'm': chr(9)}, {'n': length(t) - length(replace(t, '|', '')), 'i': -3, 'm': '|'}, {'n': length(t) - length(replace(t, ':', '')), 'i': -4, 'm': ':'}]) as x from h)
 select key, arg_max(x.m, (x.n, x.i)) as delimiter from c group by 1""")
def f21_delimiters_file_bodies(spark: SparkSession, d: str) -> DataFrame:
    return M.delimiter_vote(table(spark, d, "file_bodies").select("item_id", "body").distinct(), "item_id", "body")


@query()
def x_structural_patterns_log_lines(spark: SparkSession, d: str) -> DataFrame:
    return M.structural_patterns(_line_sentences(spark, d), "file_id", "line_no", "tok")


@query()
def x2_ngram_examples_documents(spark: SparkSession, d: str) -> DataFrame:
    return M.ngram_examples(M.text_patterns(_texts(spark, d), "doc_id", "text"))


@query()
def x3_position_examples_documents(spark: SparkSession, d: str) -> DataFrame:
    s = M.sentence_table(_texts(spark, d), "doc_id", "text").where(X.is_full_sentence(F.col("sentence")))
    shape = F.array_join(F.transform("tokens", lambda t, i: X.placeholder("WORD", i)), " ")
    return M.position_examples(s.withColumn("pattern", shape))


_CHARLINES = f"""with l as (select file_id as key, {_TOKENS} as tok, raw_line as s from log_lines where raw_line is not null)"""


@query(f"""{_CHARLINES}, g as (select key, 'words=' || len(tok) || ',end=' || case when suffix(rtrim(s), '?') then 'question' when suffix(rtrim(s), '!') then 'exclamation' else 'period' end as structure from l),
 n as (select key, count(*) as total from g group by 1) select key, structure, count(*) as n from g join n using (key) group by key, structure, total having count(*) >= floor(total * 0.01)""")
def a8_sentence_structures_log_lines(spark: SparkSession, d: str) -> DataFrame:
    return M.sentence_structures(table(spark, d, "log_lines").where("raw_line is not null"), "file_id", "raw_line")


# --- lookups and unions


@query("select distinct file_id, 'pdf' as kind from pdf_metadata union all select distinct file_id, 'tet' from tet_files union all select distinct file_id, 'log' from log_lines")
def u1_union_of_sources(spark: SparkSession, d: str) -> DataFrame:
    own = {k: table(spark, d, t).select("file_id").distinct() for t, k in (("pdf_metadata", "pdf"), ("tet_files", "tet"), ("log_lines", "log"))}
    return B.tagged_union(own, "kind")
