"""Profiles of tables: inferred types and statistics of every column.

A table is unpivoted into cells (one row per column and row, values as text) and at once pre-aggregated into column-value
counts, on which everything else works; the number of rows in a group never matters, only that of its distinct values, and
no task holds a group (order statistics come from `quality.order_statistics`).

Defined cases: a null cell, '', null and nil are null-like; an empty table gives no rows; a column with only nulls has
type null and null statistics; ties between types are settled by `typecheck.PRIORITY`, the later one first; extra columns
are profiled like the others, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwork.config import Config
from siftwork.functions import typecheck as T
from siftwork.functions.calendar import second_text, wall_micros
from siftwork.operators.quality import order_statistics


def cell_text(df: DataFrame, column: str) -> Column:
    """A cell as text, the same in every engine: fixed layouts for dates and times, plain digits for whole numbers."""
    c, kind = F.col(f"`{column}`"), dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if kind.startswith(("struct", "array", "map")):
        return F.to_json(c)
    return c.cast("string")


def cells(df: DataFrame, columns: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, col_idx (from 0), col_name and value of every cell."""
    keys = keys or []
    columns = columns or [c for c in df.columns if c not in keys]
    each = [F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("col_name"), cell_text(df, c).alias("value")) for i, c in enumerate(columns)]
    return df.select(*keys, F.inline(F.array(*each)))


def cell_counts(df: DataFrame, columns: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, col_idx, col_name, value, n."""
    return cells(df, columns, keys).groupBy(*(keys or []), "col_idx", "col_name", "value").agg(F.count(F.lit(1)).alias("n"))


def _kind_sums(prefix: str = "k_") -> list[Column]:
    """Rows of each kind of cell, over counts with columns value and n."""
    kind = T.cell_type(F.col("value"))
    return [F.coalesce(F.sum(F.when(kind == k, F.col("n"))), F.lit(0)).alias(prefix + k) for k in T.PRIORITY]


def _winner(prefix: str = "k_") -> Column:
    """The kind that most cells have, by the sums of `_kind_sums`."""
    each = lambda kinds: F.array_max(F.array(*[F.struct(F.col(prefix + k).alias("n"), F.lit(T.PRIORITY.index(k)).alias("p"), F.lit(k).alias("k")) for k in kinds]))["k"]
    mixed = reduce(lambda a, b: a + b, [F.col(prefix + k) for k in T.PRIORITY if k not in ("boolean", "null")]) > 0
    first = each(T.PRIORITY)
    return F.when((first == "boolean") & mixed, each([k for k in T.PRIORITY if k != "boolean"])).otherwise(first)


def inferred_types(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and type: the kind most cells have. A boolean winner gives way to the best other kind when some cell that
    isn't null is no boolean."""
    return counts.groupBy(*keys).agg(*_kind_sums()).select(*keys, _winner().alias("type"))


def _numbers(counts: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, x, n of the finite numbers. The tests name n, an aggregate of the counts, so that they stay above the shuffle of
    the counts and all users of these share it."""
    here = lambda c: F.when(F.col("n") > 0, c)
    return counts.select(*[here(F.col(k)).alias(k) for k in keys], here(value).alias("x"), "n").where(F.abs("x") < float("inf"))


def _moments(x: Column, n: Column) -> list[Column]:
    held = x.isNotNull()
    return [
        F.coalesce(F.sum(F.when(held, n)), F.lit(0)).alias("value_count"),
        F.min(x).alias("min_value"),
        F.max(x).alias("max_value"),
        (F.sum(x * n) / F.sum(F.when(held, n))).alias("mean_value"),
    ]


def _spread_and_order(numbers: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """base with median, iqr and sample deviation of the numbers (keys, x, n), of which base holds the mean."""
    total = F.col("total")
    ranks = {"m0": F.floor((total - 1) / 2), "m1": F.floor(total / 2), "q1": F.floor(total / 4), "q3": F.floor(3 * total / 4)}
    order = order_statistics(numbers, keys, "x", "n", ranks)
    squares = numbers.join(base.select(*keys, "mean_value"), keys).groupBy(*keys).agg(F.sum(F.pow(F.col("x") - F.col("mean_value"), 2) * F.col("n")).alias("ss"))
    return base.join(order, keys, "left").join(squares, keys, "left")


def _figures() -> dict[str, Column]:
    return {
        "min_value": F.col("min_value"),
        "max_value": F.col("max_value"),
        "mean_value": F.col("mean_value"),
        "median_value": (F.col("m0") + F.col("m1")) / 2,
        "value_range": F.col("max_value") - F.col("min_value"),
        "iqr": F.col("q3") - F.col("q1"),
        "stdev": F.when(F.col("value_count") > 1, F.sqrt(F.col("ss") / (F.col("value_count") - 1))),
    }


def numeric_stats(df: DataFrame, keys: list[str], value: str, n: str | None = None) -> DataFrame:
    """Count, min, max, mean, median (midpoint), range, iqr (s[3n/4] - s[n/4]) and sample deviation of the finite numbers.

    n: column with the weight of a row; without it, equal values are counted first. The deviation of one value is null;
    groups without a finite number are left out.
    """
    if not keys:
        raise ValueError("numeric_stats needs at least one key")
    own = df.select(*keys, F.col(value).cast("double").alias("value"), (F.col(n) if n else F.lit(1)).alias("w"))
    counts = own.groupBy(*keys, "value").agg(F.sum("w").alias("n"))
    numbers = _numbers(counts, keys, F.col("value"))
    base = numbers.groupBy(*keys).agg(*_moments(F.col("x"), F.col("n")))
    return _spread_and_order(numbers, base, keys).select(*keys, "value_count", *[c.alias(k) for k, c in _figures().items()])


def _simple() -> list[Column]:
    """Rows, null share, distincts, lengths in bytes, share of true values and dates, over counts with value and n."""
    v, n = F.col("value"), F.col("n")
    null = T.is_null_like(v)
    some = lambda cond, x=n: F.sum(F.when(cond, x))
    dated = v.rlike(r"\d[-/:]\d|[A-Za-z]{3}\s+\d")  # parsing is dear, so only what may be a date is parsed
    secs = F.coalesce(T.unix_seconds(v), F.when(dated, T.date_seconds(v)))
    return [
        F.sum("n").alias("row_count"),
        (100.0 * F.coalesce(some(null), F.lit(0)) / F.sum("n")).alias("null_percentage"),
        F.count(F.when(~null, 1)).alias("unique_count"),
        F.min(F.when(~null, F.octet_length(v))).alias("min_length"),
        F.max(F.when(~null, F.octet_length(v))).alias("max_length"),
        (some(~null, F.octet_length(v) * n) / some(~null)).alias("avg_length"),
        (100.0 * some(~null & T.is_true(v)) / some(~null)).alias("true_percentage"),
        F.min(F.when(~null, secs)).alias("min_seconds"),
        F.max(F.when(~null, secs)).alias("max_seconds"),
    ]


def simple_stats(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, null share, distincts, lengths in bytes, share of true values and dates of each column."""
    return counts.groupBy(*keys).agg(*_simple())


def capped_distinct(counts: DataFrame, keys: list[str], most: int = Config.max_csv_max_distinct_per_column) -> DataFrame:
    """keys and unique_count: different values that aren't null-like, reported up to ``most``; capped tells where it was cut."""
    n = F.count(F.when(~T.is_null_like(F.col("value")), 1))
    return counts.groupBy(*keys).agg(F.least(n, F.lit(most)).alias("unique_count"), (n > most).alias("capped"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """tbl and row_count of each table, an empty one too; only footers are read where the source has them."""
    each = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("tbl"), "row_count") for t, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def blob_stats(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Smallest, largest and mean size in bytes of the values that aren't null."""
    n = F.octet_length(column)
    return df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.avg(n).alias("avg_size"))


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """The rows of all parts, each with the name of its part; columns that a part lacks are null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(k)) for k, df in parts.items()])


def first_of_groups(df: DataFrame, keys: list[str], order: list, most: int, name: str = "k") -> DataFrame:
    """The first ``most`` rows of each group in an order, numbered from 1. Ties should be settled by the order."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most)


def column_profile(df: DataFrame, columns: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row per column: its inferred type, null share, and the statistics of that type; unique_count for text only.

    One pass counts the values of all columns; types, plain statistics and moments come from one aggregation of those counts.
    """
    by = [*(keys or []), "col_idx", "col_name"]
    counts = cell_counts(df, columns, keys)
    number = T.as_number(F.col("value"))
    finite = F.when(F.abs(number) < float("inf"), number)
    base = counts.groupBy(*by).agg(*_kind_sums(), *_simple(), *_moments(finite, F.col("n"))).withColumn("type", _winner())
    full = _spread_and_order(_numbers(counts, by, number), base, by)
    kind = F.col("type")
    of = lambda c, name, *kinds: F.when(kind.isin(*kinds), c).alias(name)
    dated = kind.isin("date", "timestamp")
    return full.select(
        *by,
        kind,
        "row_count",
        "null_percentage",
        of(F.col("unique_count"), "unique_count", "string"),
        *[of(c, k, "number") for k, c in _figures().items()],
        of(F.col("true_percentage"), "true_percentage", "boolean"),
        *[of(F.col(c), c, "string") for c in ("min_length", "max_length", "avg_length")],
        F.when(dated, second_text(F.col("min_seconds"))).alias("min_date"),
        F.when(dated, second_text(F.col("max_seconds"))).alias("max_date"),
        F.when(dated, (F.col("max_seconds") - F.col("min_seconds")) / 86400.0).alias("span_days"),
        F.when(dated, (F.col("max_seconds") - F.col("min_seconds")) / 60.0).alias("span_minutes"),
    )


def date_stats(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """First and last time, and the span between them in days and minutes."""
    us = wall_micros(df, column)
    s = F.call_function("div", us - F.pmod(us, F.lit(1_000_000)), F.lit(1_000_000))
    out = df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    show = lambda c: second_text(F.col(c))
    span = F.col("hi") - F.col("lo")
    return out.select(*keys, show("lo").alias("min_date"), show("hi").alias("max_date"), (span / 86400.0).alias("span_days"), (span / 60.0).alias("span_minutes"))


def histogram(df: DataFrame, label: str, top: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows per label, most frequent first, ties by label; with top, the report is cut there."""
    out = df.groupBy(*(keys or []), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("label_count"))
    out = out.orderBy(F.desc("label_count"), "label")
    return out.limit(top) if top else out


def sparse_moments(df: DataFrame, row: str, column: str, value: str, rows: int) -> DataFrame:
    """Moments of each column of a sparse matrix of ``rows`` rows whose other cells are 0: mean, population deviation and
    range. Several entries of a cell add up."""
    entry = df.where(F.col(value).isNotNull()).groupBy(F.col(column).alias("col"), F.col(row).alias("row")).agg(F.sum(value).alias("x"))
    x = F.col("x")
    stats = entry.groupBy("col").agg(F.count(F.lit(1)).alias("stored"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("x").alias("s"), F.sum(x * x).alias("ss"))
    full = F.col("stored") >= rows
    mean = F.col("s") / rows
    return stats.select(
        "col",
        "stored",
        F.when(full, F.col("lo")).otherwise(F.least("lo", F.lit(0.0))).alias("min_value"),
        F.when(full, F.col("hi")).otherwise(F.greatest("hi", F.lit(0.0))).alias("max_value"),
        mean.alias("mean_value"),
        F.sqrt(F.greatest(F.col("ss") / rows - mean * mean, F.lit(0.0))).alias("stdev_pop"),
    )


def plane_stats(df: DataFrame, keys: list[str], values: str, shape: tuple[int, int, int], axis: int | None = None, fortran: bool = False) -> DataFrame:
    """Statistics of each plane of a flattened rank-3 array along an axis: count, NaN and infinite counts, and min, max, mean and
    population deviation of the finite values. fortran: the first index runs fastest, as MATLAB stores it. The axis defaults to
    the one with the fewest planes, the first on a tie; of a cube to the one that memory is contiguous along."""
    d0, d1, d2 = shape
    if axis is None:
        axis = (2 if fortran else 0) if d0 == d1 == d2 else shape.index(min(shape))
    pos = F.col("pos")
    by_c = {0: F.floor(pos / (d1 * d2)), 1: F.floor(pos / d2) % d1, 2: pos % d2}
    by_f = {0: pos % d0, 1: F.floor(pos / d0) % d1, 2: F.floor(pos / (d0 * d1))}
    plane = (by_f if fortran else by_c)[axis].cast("int")
    flat = df.select(*keys, F.posexplode(values).alias("pos", "raw")).where(pos < d0 * d1 * d2)
    x = F.col("raw").cast("double")
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.when(finite, x)
    return flat.groupBy(*keys, plane.alias("plane")).agg(
        F.count(v).alias("n_values"),
        F.count_if(F.isnan(x)).alias("nan_count"),
        F.count_if(F.abs(x) == float("inf")).alias("inf_count"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.avg(v).alias("mean_value"),
        F.when(F.count(v) > 1, F.stddev_pop(v)).alias("stdev_pop"),
    )


def reported_planes(n: Column) -> Column:
    """How many planes are reported of n values along the axis: 32, three more a decade from 10,000 on, 64 at most."""
    return F.when(n < 1, 0).otherwise(F.least(32 + 3 * F.greatest(F.lit(0), F.floor(F.log10(n.cast("double"))) - 3), F.lit(64))).cast("int")
