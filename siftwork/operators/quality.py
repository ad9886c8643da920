"""Profile of every column of every load, and what changed against the load before.

The tables are unpivoted into column-value counts, one row per (table, feed, load, column, value), pre-aggregated before
the shuffle. Everything is derived from those counts: null shares, distinct counts, ranges, violations of the declared
form, value shares (half the sum of absolute differences against the load before), and order statistics.

A value is carried in the column of its type (``lv`` integers, ``dv`` doubles, ``sv`` text), so numbers are never turned
into text. A feed or value that holds a third of all rows is harmless: counts are combined before the shuffle and
spread by value, and order statistics are found by radix selection (`order_statistics`), never by sorting a group.
The tables are read once: all figures come from the same counts.

Defined cases: null is SQL null, or in text columns also '', 'null', 'nil' in any case; a column with only nulls has 0
distinct values, null range and median, and a distinct count per value of 0; NaN is a value like any other for counts
but takes no part in ranges or medians; rows without feed_no or load_no form a feed of their own without predecessor;
repeats inside a load count as delivered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

LOAD = ("tbl", "feed_no", "load_no", "column_name")
#: column_spec describes columns, so it grows with the schemas, not with the rows; it is read to the driver up to this.
MAX_SPEC_ROWS = 100_000


def declared(column_spec: DataFrame) -> list[Row]:
    """The declarations, one per (tbl, column_name); repeats are folded."""
    rows = column_spec.dropDuplicates(["tbl", "column_name"]).orderBy("tbl", "column_name").limit(MAX_SPEC_ROWS + 1).collect()
    if len(rows) > MAX_SPEC_ROWS:
        raise ValueError(f"column_spec declares more than {MAX_SPEC_ROWS} columns")
    return rows


def _cells(df: DataFrame, tbl: str, spec: list[Row], codes: dict) -> DataFrame | None:
    """code, feed_no, load_no, lv, dv, sv of each cell of the declared columns; a null cell has null in all three."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = []
    for c in (r.column_name for r in spec if r.tbl == tbl and r.column_name in kinds):
        v, kind = F.col(f"`{c}`"), kinds[c]
        none = [F.lit(None).cast(t) for t in ("bigint", "double", "string")]
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            none[0] = v.cast("bigint")
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            none[1] = v.cast("double")
        else:
            v = v.cast("string")
            none[2] = F.when(~F.lower(v).isin("", "null", "nil"), v)
        cells.append(F.struct(F.lit(codes[tbl, c]).alias("code"), none[0].alias("lv"), none[1].alias("dv"), none[2].alias("sv")))
    if not cells:
        return None
    return df.select("feed_no", "load_no", F.inline(F.array(*cells)))


def value_counts(tables: dict[str, DataFrame], spec: list[Row], codes: dict) -> DataFrame:
    """code, feed_no, load_no, lv, dv, sv, n: how often each value occurs in each declared column of each load.

    The one pass over the tables: profile, shares and order statistics all work on these counts. Their filters test an
    aggregate (`_of`), so that none is pushed below the shuffle and all of them read the same one.
    """
    parts = [p for p in (_cells(df, t, spec, codes) for t, df in tables.items()) if p is not None]
    if not parts:
        df = next(iter(tables.values()))
        return df.sparkSession.createDataFrame([], "code int, feed_no int, load_no int, lv bigint, dv double, sv string, n bigint")
    cells = reduce(DataFrame.unionByName, parts)
    return cells.groupBy("code", "feed_no", "load_no", "lv", "dv", "sv").agg(F.count(F.lit(1)).alias("n"))


def _of(counts: DataFrame, codes: list[int], *values: Column) -> DataFrame:
    """code, feed_no, load_no, the values and n of some columns' counts, of rows that belong to a load."""
    here = lambda c: F.when(F.col("n") > 0, c)  # noqa: E731 - n is an aggregate: nothing of this moves below it
    key = [here(F.col(c)).alias(c) for c in ("code", "feed_no", "load_no")]
    mine = here(F.col("code")).isin(codes) & here(F.col("feed_no")).isNotNull() & here(F.col("load_no")).isNotNull()
    return counts.where(mine).select(*key, *values, "n")


def number_counts(counts: DataFrame, codes: list[int]) -> DataFrame:
    """code, feed_no, load_no, x, n of the numbers in the given columns; NaN and rows without load are left out."""
    return _of(counts, codes, F.when(F.col("n") > 0, _number()).alias("x"))


def _number() -> Column:
    return F.coalesce(F.col("lv").cast("double"), F.when(~F.isnan("dv"), F.col("dv")))


def _violates(spec: list[Row], codes: dict) -> Column:
    """Whether sv isn't matched as a whole by the pattern declared for its column: a branch for each different pattern."""
    of: dict[str, list[int]] = {}
    for r in spec:
        if r.value_pattern is not None:
            of.setdefault(r.value_pattern, []).append(codes[r.tbl, r.column_name])
    out = F.when(F.lit(False), F.lit(False))
    for pattern, columns in of.items():
        out = out.when(F.col("code").isin(columns), ~F.col("sv").rlike(rf"\A(?:{pattern})\z"))
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def profile(counts: DataFrame, spec: list[Row], codes: dict) -> DataFrame:
    """One row per column and load: rows, nulls, distincts, range, lengths and violations."""
    x, n = _number(), F.col("n")
    some = F.coalesce(F.col("lv").isNotNull() | F.col("dv").isNotNull() | F.col("sv").isNotNull(), F.lit(False))
    size = F.octet_length("sv")
    return counts.groupBy("code", "feed_no", "load_no").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(some, n)), F.lit(0)).alias("value_count"),
        F.count(F.when(some, 1)).alias("unique_count"),
        F.min(x).alias("min_value"),
        F.max(x).alias("max_value"),
        (F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))).alias("mean_value"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
        (F.sum(size * n) / F.sum(F.when(size.isNotNull(), n))).alias("avg_length"),
        F.coalesce(F.sum(F.when(_violates(spec, codes), n)), F.lit(0)).alias("pattern_violations"),
    )


#: Distinct values of a bucket up to which it is put in order at once, parts into which a larger one is cut, and how often:
#: after the second cut fewer than 300,000 doubles are left between a bucket's ends.
BOUND, PARTS, CUTS = 65_536, 65_536, 2
#: Tasks over which the values of one bucket are spread.
SALT = 8


def _bucket(x: Column) -> Column:
    """An integer that sorts as the double does, four to a power of two: logarithms never change the order of two numbers.
    Kept small, so that the code generated for it and the counts below it is compiled."""
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(2000.0)) * 4) + 8192
    return F.coalesce((F.signum(x) * size).cast("bigint"), F.lit(0))


def _placed(h: Column, rank: Column) -> Column:
    """The bucket in h that holds a rank, and the rank inside it."""
    start = F.struct(rank.cast("bigint").alias("rank"), F.lit(None).cast(BUCKET).alias("b"))

    def step(acc: Column, b: Column) -> Column:
        here = F.struct(acc["rank"].alias("rank"), b.alias("b"))
        later = F.struct((acc["rank"] - b["n"]).alias("rank"), F.lit(None).cast(BUCKET).alias("b"))
        return F.when(acc["b"].isNotNull(), acc).when(acc["rank"] < b["n"], here).otherwise(later)

    return F.aggregate(h, start, step)


BUCKET = "struct<hi:bigint,n:bigint,kinds:bigint,lo:double,up:double>"


def _histogram(data: DataFrame, keys: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """keys, h and the carried columns: the buckets of each group in order. They are bounded in number, whatever the group's
    size, so they fit an array."""
    same = [F.max(c).alias(c) for c in carried]
    each = data.groupBy(*keys, "hi").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.min("x").alias("lo"), F.max("x").alias("up"), *same)
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("hi", "n", "kinds", "lo", "up"))).alias("h"), *same)


def order_statistics(counts: DataFrame, keys: list[str], value: str, n: str, ranks: dict[str, Column]) -> DataFrame:
    """keys and, for each name in ranks, the value at that rank (counted from 0) of the sorted values of its group.

    ranks: expressions over ``total``, the size of the group. Radix selection: values are put into buckets by magnitude,
    which sort as the values do. One pass counts the buckets and finds that of each rank
    and how many values lie before it. A bucket of more than BOUND distinct values is cut into PARTS even parts between its
    ends, CUTS times at most, and searched in the same way; what is left is put in order. Each pass combines before its
    shuffle, the values of a bucket are spread over SALT tasks while they are picked, and no task holds or sorts more than
    a bounded number of distinct values.
    """
    # the bucket is never null, or the optimiser would test it, and so compute it, for every raw value
    data = counts.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("x"), F.col(n).alias("n")).withColumn("hi", _bucket(F.col("x")))
    first = _histogram(data, keys).select(*keys, "h", F.aggregate("h", F.lit(0).cast("bigint"), lambda a, b: a + b["n"]).alias("total"))
    placed = F.array(*[F.struct(F.lit(name).alias("stat"), _placed(F.col("h"), rank).alias("at")) for name, rank in ranks.items()])
    hit = _hit(first.select(*keys, F.inline(placed)), keys).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    inside = data.withColumn("salt", F.pmod(F.hash("x"), F.lit(SALT))).join(hit, [*keys, "hi", "salt"]).drop("salt")
    by = list(keys)
    for cut in range(CUTS):
        large = F.col("kinds") > BOUND
        part = F.floor((F.col("x") - F.col("lo")) / (F.col("up") - F.col("lo")) * (PARTS - 1)).cast("bigint")
        by.append(f"b{cut}")  # ranks of one group may lie in several buckets
        data = inside.withColumnRenamed("hi", by[-1]).withColumn("hi", F.when(large, F.coalesce(part, F.lit(0))).otherwise(0))
        h = _histogram(data.where(large), by, ("w",))
        cutted = F.transform("w", lambda r: F.struct(r["stat"].alias("stat"), _placed(F.col("h"), r["rank"]).alias("at")))
        hit = _hit(h.select(*by, F.inline(cutted)), by).select(*by, "hi", *[F.col(c).alias(f"n_{c}") for c in ("kinds", "lo", "up", "w")])
        data = data.join(hit, [*by, "hi"], "left").where(~large | F.col("n_kinds").isNotNull())
        inside = data.select(*by, "hi", "x", "n", *[F.coalesce(f"n_{c}", c).alias(c) for c in ("kinds", "lo", "up", "w")])
    fine = W.partitionBy(*by, "hi").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum("n").over(fine), F.lit(0)))
    got = inside.select(*keys, "x", "n", "before", F.inline("w").alias("stat", "rank")).where("rank >= before and rank < before + n")
    return got.groupBy(*keys).agg(*[F.max(F.when(F.col("stat") == name, F.col("x"))).alias(name) for name in ranks])


def _hit(placed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hi: the buckets that hold wanted ranks, with the ranks (w, an entry a rank) and the bucket's size and ends."""
    b = placed.where("at.b is not null").groupBy(*keys, F.col("at.b.hi").alias("hi"))
    return b.agg(F.max("at.b.kinds").alias("kinds"), F.max("at.b.lo").alias("lo"), F.max("at.b.up").alias("up"), F.array_sort(F.collect_list(F.struct("stat", F.col("at.rank").alias("rank")))).alias("w"))


def quartiles(counts: DataFrame) -> DataFrame:
    """Median (mean of the middle two) and interquartile range v[3n/4] - v[n/4] of the numbers of each column and load."""
    total = F.col("total")
    ranks = {"m0": F.floor((total - 1) / 2), "m1": F.floor(total / 2), "q1": F.floor(total / 4), "q3": F.floor(3 * total / 4)}
    got = order_statistics(counts, ["code", "feed_no", "load_no"], "x", "n", ranks)
    return got.select("code", "feed_no", "load_no", ((F.col("m0") + F.col("m1")) / 2).alias("median_value"), (F.col("q3") - F.col("q1")).alias("iqr"))


def share_shift(counts: DataFrame, codes: list[int]) -> DataFrame:
    """Half the sum of absolute differences of value shares, and the population stability index, against the load before.

    counts: those of all columns; codes: the category ones. Each count adds its share to its own load and takes it from the
    next one, so the comparison is an aggregation, not a join of value lists. Loads without values, or whose predecessor has
    none, are left out. The index uses shares of at least 0.0001.
    """
    held = reduce(lambda a, b: a | b, [F.when(F.col("n") > 0, F.col(c)).isNotNull() for c in ("lv", "dv", "sv")])
    some = _of(counts.where(held), codes, "lv", "dv", "sv")
    total = some.groupBy("code", "feed_no", "load_no").agg(F.sum("n").alias("total"))
    own = some.join(total, ["code", "feed_no", "load_no"]).withColumn("share", F.col("n") / F.col("total"))
    pair = F.array(
        F.struct(F.col("load_no").alias("at"), F.col("share").alias("now"), F.lit(0.0).alias("old")),
        F.struct((F.col("load_no") + 1).alias("at"), F.lit(0.0).alias("now"), F.col("share").alias("old")),
    )
    each = own.select("code", "feed_no", "lv", "dv", "sv", F.inline(pair)).groupBy("code", "feed_no", "at", "lv", "dv", "sv").agg(F.sum("now").alias("now"), F.sum("old").alias("old"))
    p, q = F.greatest("now", F.lit(1e-4)), F.greatest("old", F.lit(1e-4))
    out = each.groupBy("code", "feed_no", F.col("at").alias("load_no")).agg(
        (F.sum(F.abs(F.col("now") - F.col("old"))) / 2).alias("shift"),
        F.sum((p - q) * F.log(p / q)).alias("stability_index"),
        F.sum("now").alias("has_now"),
        F.sum("old").alias("has_old"),
    )
    return out.where("has_now > 0.5 and has_old > 0.5").drop("has_now", "has_old")


def profiles(tables: dict[str, DataFrame], column_spec: DataFrame) -> DataFrame:
    """The full profile of each declared column in each load, with the figures of the load before as ``prev_…``."""
    spec = declared(column_spec)
    codes = {(r.tbl, r.column_name): i for i, r in enumerate(spec)}
    key = ["code", "feed_no", "load_no"]
    of = lambda kind: [codes[r.tbl, r.column_name] for r in spec if r.value_kind == kind]
    counts = value_counts(tables, spec, codes)
    base = profile(counts, spec, codes)
    numbers = quartiles(number_counts(counts, of("number")))
    shifts = share_shift(counts, of("category"))
    full = base.join(numbers, key, "left").join(shifts, key, "left")
    loads = W.partitionBy("code", "feed_no").orderBy("load_no")  # one row a load: profiles, not data
    follows = F.lag("load_no").over(loads) == F.col("load_no") - 1
    full = full.withColumns({f"prev_{c}": F.when(follows, F.lag(c).over(loads)) for c in ("row_count", "value_count", "unique_count", "median_value", "iqr")})
    names = ("tbl", "column_name", "value_kind", "low", "high")
    described = column_spec.sparkSession.createDataFrame([(i, r.tbl, r.column_name, r.value_kind, r.low, r.high) for i, r in enumerate(spec)], "code int, tbl string, column_name string, value_kind string, low double, high double")
    nulls = lambda p="": (F.col(f"{p}row_count") - F.col(f"{p}value_count")) / F.col(f"{p}row_count")
    full = full.join(F.broadcast(described), "code", "left")  # at most MAX_SPEC_ROWS rows
    return full.select(
        *names[:3],
        *[c for c in full.columns if c not in ("code", *names)],
        (nulls() * 100).alias("null_percentage"),
        (nulls("prev_") * 100).alias("prev_null_percentage"),
        *names[3:],
    )


def claims(column_info: DataFrame) -> DataFrame:
    """What is recorded about each column of each load, as ranges over all its rows; null claims nothing."""
    return column_info.groupBy(*LOAD).agg(
        F.min("null_percentage").alias("claim_null_low"),
        F.max("null_percentage").alias("claim_null_high"),
        F.min("unique_count").alias("claim_unique_low"),
        F.max("unique_count").alias("claim_unique_high"),
    )


def found(tables: dict[str, DataFrame], column_spec: DataFrame, column_info: DataFrame) -> DataFrame:
    """tbl, feed_no, load_no, column_name, issue: every issue of every declared column in every load."""
    p = profiles(tables, column_spec).join(claims(column_info), list(LOAD), "left")
    c, kind = F.col, F.col("value_kind")
    per_value = lambda pre: F.when(c(f"{pre}value_count") > 0, c(f"{pre}unique_count") / c(f"{pre}value_count")).otherwise(0.0)
    now, old = c("unique_count"), c("prev_unique_count")
    more = (now > 2 * old) & (per_value("") > 2 * per_value("prev_"))
    less = (2 * now < old) & (2 * per_value("") < per_value("prev_"))
    tests = {
        "null_rate": F.abs(c("null_percentage") - c("prev_null_percentage")) / 100 > 0.10,
        "distinct": old.isNotNull() & (more | less),
        "drift": ((kind == "category") & (c("shift") > 0.25)) | ((kind == "number") & (F.abs(c("median_value") - c("prev_median_value")) > 0.5 * c("prev_iqr"))),
        "range": (c("min_value") < c("low")) | (c("max_value") > c("high")),
        "pattern": c("pattern_violations") > 0,
        "stale": F.coalesce(F.greatest(F.abs(c("claim_null_low") - c("null_percentage")), F.abs(c("claim_null_high") - c("null_percentage"))) > 0.5, F.lit(False))
        | F.coalesce((c("claim_unique_low") != now) | (c("claim_unique_high") != now), F.lit(False)),
    }
    issues = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    return p.select(*LOAD, F.explode(issues).alias("issue"))
