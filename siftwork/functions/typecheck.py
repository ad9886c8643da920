"""What a text cell looks like: null, boolean, timestamp, number, date or string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings and layouts that tell the types.
BOOLEANS = ("true", "false", "yes", "no", "1", "0", "y", "n")
TRUTHS = ("true", "yes", "1", "y")
NULLS = ("", "null", "nil")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"
DATES = (
    r"^\d{4}-\d{2}-\d{2}(\s+\d{2}:\d{2}:\d{2}(\.\d+)?)?$",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:\d{2}|Z)?$",
    r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}$",
)
#: Ties between types are settled in this order.
PRIORITY = ("null", "boolean", "timestamp", "number", "date", "string")


def is_null_like(v: Column) -> Column:
    """Null, empty, or null/nil in any case."""
    return v.isNull() | F.lower(v).isin(*NULLS)


def is_boolean(v: Column) -> Column:
    return F.lower(v).isin(*BOOLEANS)


def is_true(v: Column) -> Column:
    return F.lower(v).isin(*TRUTHS)


def as_number(v: Column) -> Column:
    """The double that the text is as a whole; null for blanks around it, suffixes and other text."""
    return F.when(v.rlike(NUMBER), v).try_cast("double")


def unix_seconds(v: Column) -> Column:
    """Seconds of a text that is a Unix time in seconds or milliseconds of the years 2001 to 2096."""
    x = as_number(v)
    return F.when(x.between(1e12, 4e12), F.floor(x / 1000)).when(x.between(1e9, 4e9), F.floor(x)).cast("bigint")


def has_unix_time(v: Column) -> Column:
    """Whether a run of 10 or 13 digits somewhere in the text is such a time."""
    return v.rlike(r"[1-3]\d{9}|4000000000|[1-3]\d{12}|4000000000000")


def is_number(v: Column) -> Column:
    return as_number(v).isNotNull() & unix_seconds(v).isNull()


def is_date(v: Column) -> Column:
    return v.rlike(DATES[0]) | v.rlike(DATES[1]) | v.rlike(DATES[2])


def cell_type(v: Column) -> Column:
    """The first kind that fits."""
    return (
        F.when(is_null_like(v), "null")
        .when(is_boolean(v), "boolean")
        .when(unix_seconds(v).isNotNull(), "timestamp")
        .when(as_number(v).isNotNull(), "number")
        .when(is_date(v), "date")
        .otherwise("string")
    )


def date_seconds(v: Column, year: int | None = None) -> Column:
    """Seconds since 1970 UTC of a date or time text; year, by default the current one, stands in where the text has none."""
    s = F.regexp_replace(F.regexp_replace(F.trim(v), r"^\[+|\]+$", ""), r"[,;:]+$", "")
    s = F.when(~F.lower(s).isin(*NULLS), s)
    iso = F.regexp_replace(s, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    zoned = s.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:\d{2}|[Zz])$")
    plain = iso.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}:\d{2}(\.\d+)?)?$")
    head = F.regexp_extract(iso, r"^(\d{4}-\d{1,2}-\d{1,2})(?:[ T](\d{1,2}:\d{2}:\d{2}))?", 0)
    naive = lambda t, fmt: F.unix_seconds(F.try_to_timestamp(F.concat(t, F.lit(" +0000")), F.lit(fmt + " xx")))
    both = F.regexp_replace(F.when(head.rlike("[ T]"), head).otherwise(F.concat(head, F.lit(" 00:00:00"))), "T", " ")
    us = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), s)
    asctime = F.regexp_extract(s, r"^[A-Za-z]{3}\s+([A-Za-z]{3})\s+(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})$", 0)
    asc = F.when(asctime != "", F.regexp_replace(asctime, r"^[A-Za-z]{3}\s+([A-Za-z]{3})\s+(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})$", "$1 $2 $3 $4"))
    sys_ = F.when(s.rlike(r"^[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(\.\d+)?$"), F.concat(F.regexp_replace(F.regexp_replace(s, r"\.\d+$", ""), r"\s+", " "), F.lit(" "), F.lit(str(year)) if year is not None else F.year(F.current_timestamp()).cast("string")))
    return F.coalesce(
        F.when(zoned, F.unix_seconds(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.upper(s), r"\.\d+", ""), r"^(.{10}).", "$1T"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))),
        F.when(plain, naive(both, "yyyy-M-d H:mm:ss")),
        F.when(us.isNotNull(), naive(F.concat(us, F.lit(" 00:00:00")), "M/d/yyyy HH:mm:ss")),
        F.when(asc.isNotNull(), naive(asc, "MMM d HH:mm:ss yyyy")),
        F.when(sys_.isNotNull(), naive(sys_, "MMM d HH:mm:ss yyyy")),
        F.when(s.rlike(r"^\d{6}$"), naive(F.concat(F.substring(s, 1, 4), F.when(F.substring(s, 5, 2) < "69", "20").otherwise("19"), F.substring(s, 5, 2), F.lit(" 00:00:00")), "ddMMyyyy HH:mm:ss")),
    )
