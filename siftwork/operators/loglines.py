"""Log lines of mixed layouts into entries with timestamp, level, component and message.

Lines are parsed on their own by `siftwork.functions.logscan` and shuffled once, by file and block of lines, so that a file
with a third of all rows is spread over many tasks. Inside a block, a running maximum attaches each line to the header
before it; what a block's first lines belong to is carried over from a summary with one row per block.

Defined cases: null, empty and blank lines belong to nothing; a repeated line counts once; lines before the first entry
of a file, or without file_id or line_no, belong to none; a byte-order mark in front of a line and CR at its end are not
part of it; where a stamp lacks its year and the file's scanned_at is unknown, ts_utc is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwork.functions.calendar import DAY_US, bind, checked_days, utc_text, wall_micros
from siftwork.functions.logscan import header

#: Lines of a file that form one block: what a single task holds of a file.
BLOCK = 50_000
_PARSED = "file_id bigint, line_no bigint, head boolean, us bigint, month_day int, log_level string, component string, message string"


def parse_lines(lines: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Header fields of each line that isn't blank; of continuation lines, file_id and line_no only."""
    none = (None, None, None, None, None)
    for batch in lines:
        files, numbers, out = [], [], []
        for f, n, s in zip(batch["file_id"].tolist(), batch["line_no"].tolist(), batch["raw_line"].tolist()):
            if s and s[0] == "\ufeff":
                s = s[1:]
            if not s or s.isspace():
                continue
            got = header(s.rstrip("\r\n"))
            files.append(f)
            numbers.append(n)
            out.append((True, *got) if got else (False, *none))
        cols = list(zip(*out)) if out else [[]] * 6
        yield pd.DataFrame(
            {
                "file_id": pd.Series(files, dtype="int64"),
                "line_no": pd.Series(numbers, dtype="int64"),
                "head": pd.Series(cols[0], dtype="bool"),
                "us": pd.Series(cols[1], dtype="Int64"),
                "month_day": pd.Series(cols[2], dtype="Int32"),
                "log_level": pd.Series(cols[3], dtype="object"),
                "component": pd.Series(cols[4], dtype="object"),
                "message": pd.Series(cols[5], dtype="object"),
            }
        )


def _year_before(month_day: Column, clock: Column, limit: Column) -> Column:
    """The latest instant with that month, day and time of day that isn't after limit; 29 February may be 8 years back."""
    y0 = F.year(F.date_from_unix_date(F.floor(limit / DAY_US).cast("int"))).cast("bigint")
    m, d = F.floor(month_day / 100).cast("bigint"), (month_day % 100).cast("bigint")
    years = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda back: checked_days(y0 - back, m, d) * DAY_US + clock)
    return F.array_max(F.filter(years, lambda at: at <= limit))


def parsed(log_lines: DataFrame) -> DataFrame:
    """Each line that isn't blank, with the fields of its header if it has one."""
    own = log_lines.where("file_id is not null and line_no is not null and raw_line is not null").select("file_id", "line_no", "raw_line")
    return own.mapInPandas(parse_lines, _PARSED)


def entries(log_lines: DataFrame, outputs: DataFrame) -> DataFrame:
    """file_id, first_line, last_line, ts_utc, log_level, component, message of each entry."""
    lines = parsed(log_lines).withColumn("block", F.floor(F.col("line_no") / BLOCK).cast("bigint"))
    # said here for both uses of part: the planner would say it for one of them, and parse the lines again for the other
    lines = lines.where("file_id is not null and block is not null")
    # lines before a block's first header come as first_line null
    in_block = W.partitionBy("file_id", "block").orderBy("line_no")
    lines = lines.withColumn("first_line", F.last(F.when(F.col("head"), F.col("line_no")), ignorenulls=True).over(in_block))
    fields = ("us", "month_day", "log_level", "component", "message")
    part = lines.groupBy("file_id", "block", "first_line").agg(F.max("line_no").alias("last_line"), *[F.max(F.when(F.col("head"), F.col(c))).alias(c) for c in fields])

    # the summary reads all columns of part, so that both uses are the same exchange and lines are parsed once
    used = F.coalesce(F.length("message"), F.length("component"), F.length("log_level"), F.col("us"), F.col("month_day"), F.lit(0)) > -(2**62)
    blocks = part.where(used).groupBy("file_id", "block").agg(F.max("first_line").alias("last_entry"), F.max(F.when(F.col("first_line").isNull(), F.col("last_line"))).alias("lead_last"))
    over_blocks = W.partitionBy("file_id").orderBy("block")
    blocks = blocks.withColumn("owner", F.last("last_entry", ignorenulls=True).over(over_blocks.rowsBetween(W.unboundedPreceding, -1)))
    carried = blocks.where("owner is not null and lead_last is not null").groupBy("file_id", F.col("owner").alias("last_entry")).agg(F.max("lead_last").alias("carried"))
    scanned = outputs.where("file_id is not null").groupBy("file_id").agg(F.max(wall_micros(outputs, "scanned_at")).alias("limit"))
    blocks = blocks.where("last_entry is not null").join(carried, ["file_id", "last_entry"], "left").join(scanned, "file_id", "left")
    blocks = blocks.select("file_id", "block", "last_entry", "carried", "limit")

    whole = part.where("first_line is not null").join(blocks, ["file_id", "block"])
    # only stamps without year need the search for it
    whole = bind(whole, at=F.when(F.col("month_day").isNull(), F.col("us")).otherwise(_year_before(F.col("month_day"), F.col("us"), F.col("limit"))))
    last = F.when(F.col("first_line") == F.col("last_entry"), F.greatest("last_line", "carried")).otherwise(F.col("last_line"))
    return whole.select("file_id", "first_line", last.alias("last_line"), utc_text(F.col("at")).alias("ts_utc"), *fields[2:])
