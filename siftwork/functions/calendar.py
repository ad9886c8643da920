"""Calendar arithmetic on integer columns.

Everything here is a pure Catalyst expression over bigint columns, so it is independent of the session time zone and of
ANSI mode: an impossible date gives null instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def bind(df: DataFrame, **cols: Column) -> DataFrame:
    """df with columns added by a one-row generator.

    The optimiser merges neighbouring projections and so repeats an expression wherever its result is used; it doesn't
    merge across a generator. Each expression bound here is computed once a row, and generated methods stay small.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))))


def _div(a: Column, b: int) -> Column:
    """Whole-number division of bigints, without a detour through doubles."""
    return F.call_function("div", a, F.lit(b))


def wall_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a time column; one without zone means UTC, whatever the session's zone is."""
    c = F.col(f"`{column}`")
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    clock = (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return F.unix_date(c.cast("date")).cast("bigint") * DAY_US + clock


def is_leap(y: Column) -> Column:
    """True where the proleptic Gregorian year has 366 days."""
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def month_length(y: Column, m: Column) -> Column:
    """Days of month m in year y; null unless m is 1 to 12."""
    return (
        F.when(m.isin(1, 3, 5, 7, 8, 10, 12), 31)
        .when(m.isin(4, 6, 9, 11), 30)
        .when(m == 2, F.when(is_leap(y), 29).otherwise(28))
    )


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01, without any check of the ranges.

    The year is taken to begin in March, so that the leap day comes last and month offsets are linear.
    """
    z = F.when(m <= 2, y - 1).otherwise(y).cast("bigint")
    era = _div(z, 400)
    yoe = z - era * 400
    doy = _div((153 * ((m + 9) % 12) + 2).cast("bigint"), 5) + d - 1
    doe = yoe * 365 + _div(yoe, 4) - _div(yoe, 100) + doy
    return (era * 146097 + doe - 719468).cast("bigint")


def checked_days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01, or null where the date doesn't exist."""
    ok = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= month_length(y, m))
    return F.when(ok, days_from_civil(y, m, d))


def utc_text(us: Column) -> Column:
    """Microseconds since 1970 UTC as ``2024-03-09T07:05:01.250000Z``; null stays null."""
    rest = F.pmod(us, F.lit(DAY_US))
    sec = _div(rest, 1_000_000)
    return F.concat(
        F.date_from_unix_date(_div(us - rest, DAY_US).cast("int")).cast("string"),
        F.format_string("T%02d:%02d:%02d.%06dZ", _div(sec, 3600), _div(sec % 3600, 60), sec % 60, rest % 1_000_000),
    )


def second_text(seconds: Column) -> Column:
    """Seconds since 1970 UTC as ``2024-03-09T07:05:01+00:00``, whatever the session's zone is; null stays null."""
    rest = F.pmod(seconds, F.lit(86_400))
    days = F.date_from_unix_date(_div(seconds - rest, 86_400).cast("int")).cast("string")
    return F.concat(days, F.format_string("T%02d:%02d:%02d+00:00", _div(rest, 3600), _div(rest % 3600, 60), rest % 60))
