"""Queries of predicates, scalars, generators and window-like operators, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import shapes as S
from siftwork.functions import text as X
from siftwork.functions import typecheck as T
from siftwork.operators import mining as M
from siftwork.operators import tabular as B
from siftwork.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_WS = r"[\t-\r \x{85}\p{Z}]+"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@query("select null_field as v, (null_field is null or lower(null_field) in ('', 'null', 'nil')) as is_null, count(*) as n from test_types group by 1, 2")
def f3_null_like_test_types(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("null_field")
    return table(spark, d, "test_types").groupBy(v.alias("v"), T.is_null_like(v).alias("is_null")).agg(F.count(F.lit(1)).alias("n"))


@query("""select feed_no, bool_and(boolean_field is null or cast(boolean_field as varchar) in ('0', '1')) as all_boolean, count(*) filter (cast(boolean_field as varchar) = '1') as n_true from test_types group by 1""")
def f10_all_boolean_test_types(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("boolean_field").cast("string")
    return table(spark, d, "test_types").groupBy("feed_no").agg(F.bool_and(T.is_null_like(v) | T.is_boolean(v)).alias("all_boolean"), F.count_if(T.is_true(v)).alias("n_true"))


@query(r"select date_field, (regexp_matches(date_field, '^\d{4}-\d{2}-\d{2}(\s+\d{2}:\d{2}:\d{2}(\.\d+)?)?$') or regexp_matches(date_field, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:\d{2}|Z)?$') or regexp_matches(date_field, '^\d{1,2}[/-]\d{1,2}[/-]\d{4}$')) as is_date, count(*) as n from test_types where date_field is not null group by 1, 2")
def f7_dates_test_types(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("date_field")
    return table(spark, d, "test_types").where(v.isNotNull()).groupBy("date_field", T.is_date(v).alias("is_date")).agg(F.count(F.lit(1)).alias("n"))


_TIMES = """select distinct v from (select date_field as v from test_types union all select creation_date from pdf_metadata union all select modification_date from pdf_metadata
 union all select created_at from tet_files union all select event_at from tet_history) where v is not null"""


def _times(spark: SparkSession, d: str) -> DataFrame:
    parts = {"test_types": ("date_field",), "pdf_metadata": ("creation_date", "modification_date"), "tet_files": ("created_at",), "tet_history": ("event_at",)}
    each = [table(spark, d, t).select(F.col(c).alias("v")) for t, cs in parts.items() for c in cs]
    return reduce(DataFrame.unionByName, each).where("v is not null").distinct()


@query(rf"""with s as (select v, regexp_replace(regexp_replace(regexp_replace(trim(v, ' ' || chr(9) || chr(10) || chr(13)), '^\[+', ''), '\]+$', ''), '[,;:]+$', '') as s from ({_TIMES})),
 z as (select v, s, regexp_matches(s, '^\d{{4}}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([+-]\d\d:\d\d|[Zz])$') as zoned, regexp_matches(s, '^\d{{4}}[-/]\d\d?[-/]\d\d?([ T]\d\d?:\d\d:\d\d(\.\d+)?)?$') as plain from s),
 t as (select v, case when zoned then epoch(try_cast(upper(s) as timestamptz))
 when plain and not regexp_matches(s, '^[^ T]*/.*[.T]') and not regexp_matches(s, '-.*/|/.*-') then epoch(coalesce(try_strptime(replace(regexp_replace(s, '\.\d+$', ''), 'T', ' '), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%Y/%m/%d %H:%M:%S', '%Y/%m/%d'])))
 when regexp_matches(s, '^\d\d?/\d\d?/\d{{4}}$') then epoch(try_strptime(s, '%m/%d/%Y'))
 when regexp_matches(s, '^\d{{6}}$') then epoch(try_strptime(s[1:4] || case when s[5:6] < '69' then '20' else '19' end || s[5:6], '%d%m%Y'))
 when regexp_matches(s, '^[A-Za-z]{{3}}\s+[A-Za-z]{{3}}\s+\d\d? \d\d:\d\d:\d\d \d{{4}}$') then epoch(try_strptime(regexp_replace(s, '\s+', ' ', 'g'), '%a %b %d %H:%M:%S %Y'))
 when regexp_matches(s, '^[A-Za-z]{{3}}\s+\d\d?\s+\d\d:\d\d:\d\d(\.\d+)?$') then epoch(try_strptime(regexp_replace(regexp_replace(s, '\.\d+$', ''), '\s+', ' ', 'g') || ' 2026', '%b %d %H:%M:%S %Y')) end as e from z)
 select v, cast(floor(e) as bigint) as seconds from t""")
def f8_date_seconds_times(spark: SparkSession, d: str) -> DataFrame:
    return _times(spark, d).select("v", T.date_seconds(F.col("v"), 2026).alias("seconds"))


@query(f"select token, lower(regexp_replace(token, '[^\\p{{L}}\\p{{N}}]', '', 'g')) as norm, regexp_matches(token, '[\\p{{L}}\\p{{N}}]') as has_alnum, count(*) as n from (select unnest(list_filter(string_split_regex(raw_line, '{_WS}'), lambda t: t <> '')) as token from log_lines where raw_line is not null) group by 1, 2, 3")
def f15_normal_tokens_log_lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "log_lines").where("raw_line is not null").select(F.explode(X.tokens(F.col("raw_line"))).alias("token"))
    return t.groupBy("token", X.normal_token(F.col("token")).alias("norm"), F.col("token").rlike(r"[\p{IsAlphabetic}\p{N}]").alias("has_alnum")).agg(F.count(F.lit(1)).alias("n"))


@query("select template_pattern, len(list_filter(string_split(template_pattern, ' '), lambda w: not (starts_with(w, '[') and suffix(w, ']')))) = 0 as open, count(*) as n from templates where template_pattern is not null group by 1, 2")
def f13_all_placeholders_templates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("template_pattern")
    return table(spark, d, "templates").where(p.isNotNull()).groupBy(p, S.all_placeholders(p).alias("open")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""select item_id, s as sentence, len(list_filter(string_split_regex(s, '{_WS}'), lambda t: t <> '')) as words, length(s) as chars, contains(s, '"') or contains(s, '''') as quotes,
 case when suffix(s, '?') then 'question' when suffix(s, '!') then 'exclamation' else 'period' end as end_type,
 case regexp_extract(s, '(?s)([?!])[^?!]*$', 1) when '?' then 'question' when '!' then 'exclamation' else 'none' end as emphasis from (select distinct item_id, rtrim(text) as s from benchmark where text is not null)""")
def f24_sentence_stats_benchmark(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "benchmark").where("text is not null").select("item_id", F.rtrim("text").alias("sentence")).distinct()
    return own.select("item_id", "sentence", S.sentence_stats(F.col("sentence")).alias("s")).select("item_id", "sentence", "s.*")


@query("""select column_name, type_name, case when upper(type_name) like '%INT%' then 'INTEGER' when upper(type_name) like '%CHAR%' or upper(type_name) like '%CLOB%' or upper(type_name) like '%TEXT%' then 'TEXT'
 when type_name is null or type_name = '' or upper(type_name) like '%BLOB%' then 'BLOB' when upper(type_name) like '%REAL%' or upper(type_name) like '%FLOA%' or upper(type_name) like '%DOUB%' then 'REAL' else 'NUMERIC' end as affinity, count(*) as n from column_info group by 1, 2, 3""")
def f31_affinity_column_info(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "column_info").groupBy("column_name", "type_name", S.affinity(F.col("type_name")).alias("affinity")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""with v as (select distinct creation_date as v from pdf_metadata where regexp_full_match(creation_date, '(D:)?\d{8}(\d{2})?(\d{2})?(\d{2})?([+-]\d{2}''?(\d{2})?''?|Z.*)?')),
 g as (select v, regexp_replace(v, '^D:', '') as s from v)
 select v, substr(s, 1, 4) || '-' || substr(s, 5, 2) || '-' || substr(s, 7, 2) || 'T' || rpad(coalesce(nullif(regexp_extract(substr(s, 9), '^(\d+)', 1), ''), ''), 6, '0')[1:2] || ':' || rpad(regexp_extract(substr(s, 9), '^(\d*)', 1), 6, '0')[3:4] || ':' || rpad(regexp_extract(substr(s, 9), '^(\d*)', 1), 6, '0')[5:6]
 || case when regexp_matches(s, '[+-]') then regexp_extract(s, '([+-]\d{2})', 1) || ':' || coalesce(nullif(regexp_extract(s, '[+-]\d{2}''?(\d{2})', 1), ''), '00') else 'Z' end as iso from g""")
def f32_pdf_dates(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "pdf_metadata").select(F.col("creation_date").alias("v")).distinct()
    return v.select("v", S.iso_date(F.col("v")).alias("iso")).where("iso is not null")


@query("select vec_id, i - 1 as idx, (i - 1) // 16 as a, ((i - 1) // 4) % 4 as b, (i - 1) % 4 as c from (select vec_id, unnest(range(1, 65)) as i from embeddings)")
def f33_unravel_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "x"))
    p = S.unravel(F.col("idx"), (4, 4, 4))
    return e.select("vec_id", F.col("idx").cast("bigint").alias("idx"), *[F.get(p, F.lit(k)).alias(n) for k, n in enumerate("abc")])


@query("select vec_id, (i - 1) as idx, round(x::double, 6) as x from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) where (i - 1) % 5 = 0")
def g11_strided_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(S.strided(F.col("embedding"), 5)).alias("k", "x"))
    return e.select("vec_id", (F.col("k") * 5).cast("bigint").alias("idx"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query(f"select item_id as key, unnest(tok) as token, generate_subscripts(tok, 1) - 1 as pos from (select distinct item_id, list_filter(string_split_regex(text, '{_WS}'), lambda t: t <> '') as tok from benchmark where text is not null)")
def g2_tokens_benchmark(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").where("text is not null").select("item_id", "text").distinct()
    return b.select(F.col("item_id").alias("key"), F.posexplode(X.tokens(F.col("text"))).alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


@query("select file_type, column_name, count(*) as n, count(distinct value) as kinds from (select file_type, 'site_code' as column_name, site_code as value from outputs union all select file_type, 'is_binary', cast(is_binary as varchar) from outputs) group by 1, 2")
def g10_unpivot_outputs(spark: SparkSession, d: str) -> DataFrame:
    c = B.cells(table(spark, d, "outputs"), ["site_code", "is_binary"], ["file_type"])
    return c.groupBy("file_type", F.col("col_name").alias("column_name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("kinds"))


@query("select file_type, min(octet_length(encode(body))) as min_size, max(octet_length(encode(body))) as max_size, round(avg(octet_length(encode(body))), 4) as avg_size from file_bodies where body is not null group by 1")
def a21_blob_sizes_file_bodies(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "file_bodies").withColumn("body", F.encode("body", "UTF-8"))
    return B.blob_stats(own, ["file_type"], "body").withColumn("avg_size", F.round("avg_size", 4))


@query("""select l_returnflag, col_name, least(n, 1000) as unique_count, n > 1000 as capped from (select l_returnflag, 'l_partkey' as col_name, count(distinct l_partkey) as n from lineitem group by 1
 union all select l_returnflag, 'l_linestatus', count(distinct l_linestatus) from lineitem group by 1)""")
def a19_capped_distinct_lineitem(spark: SparkSession, d: str) -> DataFrame:
    counts = B.cell_counts(table(spark, d, "lineitem"), ["l_partkey", "l_linestatus"], ["l_returnflag"])
    return B.capped_distinct(counts, ["l_returnflag", "col_name"], 1000)


@query(f"""with t as (select item_id, unnest(tok) as token, generate_subscripts(tok, 1) as pos from (select distinct item_id, list_filter(string_split_regex(text, '{_WS}'), lambda t: t <> '') as tok from benchmark where text is not null)),
 n as (select item_id, pos, lower(regexp_replace(token, '[^\\p{{L}}\\p{{N}}]', '', 'g')) as word from t)
 select item_id as key, pos - 1 as pos, word, nullif(next, '') as next from (select item_id, pos, word, lead(word) over (partition by item_id order by pos) as next from n) where word <> ''""")
def w2_next_token_benchmark(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").where("text is not null").select("item_id", "text").distinct()
    return M.successors(b.select("item_id", X.tokens(F.col("text")).alias("tok")), "item_id", "tok").withColumn("pos", F.col("pos").cast("bigint"))


@query("select event_type, event_id, value, k from (select event_type, event_id, value, row_number() over (partition by event_type order by value desc, event_id) as k from events where value is not null) where k <= 3")
def w3_first_of_group_events(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").where("value is not null").select("event_type", "event_id", "value")
    return B.first_of_groups(own, ["event_type"], [F.desc("value"), "event_id"], 3).withColumn("k", F.col("k").cast("bigint"))


@query("""select time_bucket(interval '1 day', ts) as window_start, event_type as label, count(*) as n from events group by 1, 2""")
def st_windowed_counts_events(spark: SparkSession, d: str) -> DataFrame:
    from siftwork.streaming.files import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 day")


@query()
def f20_timestamp_presence_log_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "log_lines").where("raw_line is not null")
    return lines.groupBy("file_id").agg(F.bool_or(F.when(F.col("line_no") <= 50, S.timestamp_presence(F.col("raw_line")))).alias("has_timestamps"))


@query()
def f22_dialects_file_bodies(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "file_bodies").where("body is not null and file_type = 'Csv'").select("item_id", "body").distinct()
    return own.select("item_id", S.quote_mark(F.col("body")).alias("quote_character"), S.escape_mark(F.col("body")).alias("escape_character"))
