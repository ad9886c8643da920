"""Column statistics of the rows of one file: types by what most cells look like, and the figures of each type.

The same rules as `siftwork.functions.typecheck` and `siftwork.operators.tabular`, for rows that a task already holds: a
file's own, of which at most `sample_size` are looked at. Whole tables are profiled by `tabular.column_profile`.
"""

from __future__ import annotations

import csv
import io
import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from datetime import UTC, date, datetime, timedelta
from itertools import islice

from siftwork.config import Config
from siftwork.functions.typecheck import BOOLEANS, DATES, NULLS, NUMBER, PRIORITY, TRUTHS

_NUMBER = re.compile(NUMBER.replace("$|^", r"\Z|^").removesuffix("$") + r"\Z")
_DATES = [re.compile(p[:-1] + r"\Z") for p in DATES]
_ZONED = re.compile(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:\d{2}|[Zz])\Z")
_SYSLOG = re.compile(r"([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})(\.\d+)?\Z")
# Layouts of dates and times without zone.
LAYOUTS = ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d", "%m/%d/%Y", "%a %b %d %H:%M:%S %Y")
# How many rows are looked at.
FULL_ROWS, FULL_BYTES, SLIM_BYTES, SHRINK_FROM, SHRINK, LEAST_SHARE, WIDE = 500_000, 64 << 20, 2048, 100_000, 0.02, 0.03, 4000


def sample_size(file_bytes: int, rows: int | None, columns: int, base: int) -> int:
    """Rows to look at: all of a slim, small table; else the base, less 2 % a decade of size above 100 kB (3 % at least are
    kept), and less in proportion above 4,000 columns."""
    shrunk = base
    if base > 1 and file_bytes > SHRINK_FROM:
        decades = max(1, math.floor(math.log10(file_bytes / SHRINK_FROM)))
        shrunk = max(1, int(base * max(1 - SHRINK * decades, LEAST_SHARE)))
    if rows:
        small = file_bytes // rows <= SLIM_BYTES and file_bytes <= FULL_BYTES
        shrunk = rows if small and rows <= FULL_ROWS else min(shrunk, rows) if small else shrunk
    return max(1, shrunk * WIDE // max(columns, WIDE)) if shrunk > 1 else 1


def number(v: str) -> float | None:
    return float(v) if _NUMBER.match(v) else None


def unix_seconds(v: str) -> int | None:
    x = number(v)
    if x is None or math.isnan(x):
        return None
    return math.floor(x / 1000) if 1e12 <= x <= 4e12 else math.floor(x) if 1e9 <= x <= 4e9 else None


def date_seconds(v: str, year: int | None = None) -> int | None:
    """Seconds since 1970 UTC of a date or time text; year, by default the current one, stands in where it has none."""
    s = v.strip().lstrip("[").rstrip("]").rstrip(",;:")
    if s.lower() in NULLS:
        return None
    at = None
    if _ZONED.match(s):
        try:
            at = datetime.fromisoformat(re.sub(r"\.\d+", "", s.upper()).replace("Z", "+00:00"))
        except ValueError:
            return None
    elif re.fullmatch(r"\d{6}", s):
        try:
            at = datetime(int(s[4:]) + (2000 if s[4:] < "69" else 1900), int(s[2:4]), int(s[:2]), tzinfo=UTC)
        except ValueError:
            return None
    elif m := _SYSLOG.match(s):
        s, layouts = f"{m[1]} {m[2]} {m[3]} {year or datetime.now(UTC).year}", ("%b %d %H:%M:%S %Y",)
    else:
        s, layouts = re.sub(r"(\.\d{6})\d+", r"\1", s), LAYOUTS
    if at is None:
        for layout in layouts:
            try:
                at = datetime.strptime(s, layout).replace(tzinfo=UTC)
                break
            except ValueError:
                continue
    return None if at is None else math.floor((at - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(seconds=1))


def instant(v: str) -> int | None:
    """Seconds of a Unix time or of a date."""
    at = unix_seconds(v)
    return date_seconds(v) if at is None else at


def is_null(v: str) -> bool:
    return v.lower() in NULLS


def cell_type(v: str) -> str:
    """The first kind that fits."""
    low = v.lower()
    if low in NULLS:
        return "null"
    if low in BOOLEANS:
        return "boolean"
    if _NUMBER.match(v):
        return "timestamp" if unix_seconds(v) is not None else "number"
    return "date" if any(p.match(v) for p in _DATES) else "string"


def plurality(kinds: Counter) -> str:
    """The kind most cells have, the later of `PRIORITY` on a tie; a boolean winner gives way where some cell is no boolean."""
    best = lambda ks: max(ks, key=lambda k: (kinds[k], PRIORITY.index(k)))
    if not kinds:
        return "string"
    first = best(kinds)
    other = [k for k in kinds if k != "boolean"]
    return best(other) if first == "boolean" and any(k != "null" for k in other) else first


def numeric_stats(values: list[float]) -> dict | None:
    """Figures of the finite values: median in the middle, iqr s[3n/4] - s[n/4], sample deviation."""
    v = sorted(x for x in values if math.isfinite(x))
    n = len(v)
    if not n:
        return None
    mean = math.fsum(v) / n
    dev = math.sqrt(math.fsum((x - mean) ** 2 for x in v) / (n - 1)) if n > 1 else 0.0
    return {"min": v[0], "max": v[-1], "mean": mean, "median": (v[(n - 1) // 2] + v[n // 2]) / 2, "range": v[-1] - v[0], "iqr": v[3 * n // 4] - v[n // 4], "stdev": dev}


def date_stats(seconds: list[int]) -> dict | None:
    if not seconds:
        return None
    show = lambda s: (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=s)).isoformat()
    lo, hi = min(seconds), max(seconds)
    return {"min_date": show(lo), "max_date": show(hi), "span_days": (hi - lo) / 86400, "span_minutes": (hi - lo) / 60}


def boolean_stats(values: list[str]) -> dict | None:
    held = [v.lower() in TRUTHS for v in values if not is_null(v)]
    return {"true_percentage": 100.0 * sum(held) / len(held)} if held else None


def column_stats(name: str | None, values: list[str], most_distinct: int | None = None, physical: str | None = None) -> dict:
    """Type, null share and the figures of the type of one column; unique_count for text only."""
    kind = plurality(Counter(map(cell_type, values)))
    held = [v for v in values if not is_null(v)]
    out: dict = {"name": name, "type": kind, "physical_type": physical, "null_percentage": 100.0 * (len(values) - len(held)) / len(values) if values else None}
    if kind == "string":
        n = len(set(held))
        out["unique_count"] = n if most_distinct is None else min(n, most_distinct)
    elif kind == "number":
        out["numeric_stats"] = numeric_stats([x for x in map(number, held) if x is not None])
    elif kind in ("date", "timestamp"):
        out["date_stats"] = date_stats([s for s in map(instant, held) if s is not None])
    elif kind == "boolean":
        out["boolean_stats"] = boolean_stats(values)
    return {k: v for k, v in out.items() if v is not None}


def table_stats(rows: list[list[str]], names: list[str], most_distinct: int | None = None, physical: list[str] | None = None) -> list[dict]:
    """The columns of rows of texts; short rows are filled with empty cells, longer ones cut."""
    return [column_stats(n, [r[k] if k < len(r) else "" for r in rows], most_distinct, physical[k] if physical else None) for k, n in enumerate(names)]


def cell_text(v) -> str:
    """A value as text: empty for null, ISO for times, digits for numbers."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, datetime | date):
        return v.isoformat()
    if isinstance(v, bytes):
        return v.hex()
    if isinstance(v, dict | list | tuple):
        return json.dumps(v, default=str)
    return str(v)


# --- delimited text

# Delimiters of extensions, and the ones that are looked for, in the order that settles ties.
DELIMITER_OF = {"tsv": "\t", "tab": "\t", "psv": "|"}
DELIMITERS = (",", ";", "\t", "|", ":")


def delimiter(text: str, path: str = "") -> str:
    """By the extension, else the most frequent of the known ones in the first five lines; comma where there is none."""
    told = DELIMITER_OF.get(path.rsplit(".", 1)[-1].lower() if "." in path else "")
    if told:
        return told
    head = "\n".join(text.split("\n", 5)[:5])
    return max(DELIMITERS, key=lambda d: (head.count(d), -DELIMITERS.index(d)))


def quote_mark(text: str, sep: str) -> str | None:
    """The quote that is paired, or stands beside a delimiter, more often in the first ten lines; " on a tie, None if neither."""
    lines = text.split("\n", 10)[:10]
    score = lambda q: sum((x.count(q) // 2 if x.count(q) >= 2 and x.count(q) % 2 == 0 else 0) + (q + sep in x or sep + q in x) for x in lines)
    best = max(('"', "'"), key=score)
    return best if score(best) else None


def escape_mark(text: str, quote: str | None) -> str | None:
    """Backslash where it stands before a quote or itself in the first ten lines, else the quote where it is doubled."""
    lines = text.split("\n", 10)[:10]
    if any(e in x for x in lines for e in ('\\"', "\\'", "\\\\")):
        return "\\"
    return quote if quote and any(quote * 2 in x for x in lines) else None


def records(text: str, sep: str) -> Iterator[list[str]]:
    """Records of delimited text; blank lines are none, ragged ones keep their length."""
    csv.field_size_limit(1 << 30)
    return (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep, doublequote=True) if r)


def csv_summary(data: bytes, path: str = "", config: Config = Config()) -> dict:
    """Dialect, rows and column statistics of delimited text, the first record being the header; text that isn't UTF-8 is
    told by its encoding only."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return {"encoding": "Non-UTF-8"}
    sep = delimiter(text, path)
    each = records(text, sep)
    header = next(each, None)
    rows = sum(1 for _ in each)
    most = min(max(1, sample_size(len(data), rows, len(header) if header else WIDE, max(1, config.max_csv_scan_rows))), rows)
    some = list(islice(records(text, sep), 1, 1 + most))
    quote = quote_mark(text, sep)
    names = header or []
    return {
        "row_count": rows, "column_count": len(names), "stats_rows_sampled": len(some), "encoding": "UTF-8", "delimiter": "\\t" if sep == "\t" else sep, "quote_character": quote,
        "escape_character": escape_mark(text, quote), "has_header": True, "columns": table_stats(some, names, config.max_csv_max_distinct_per_column),
    }


# --- tables with a schema


def arrow_stats(schema, batches: Iterable, file_bytes: int, rows: int | None, config: Config) -> dict:
    """column_count, stats_rows_sampled and columns of a table given as Arrow batches, of which as many as needed are read."""
    names = [f.name for f in schema]
    most = sample_size(file_bytes, rows, len(names), config.max_tabular_sample_rows)
    some: list[list[str]] = []
    for b in batches:
        b = b.slice(0, most - len(some))
        some += [list(r) for r in zip(*[[cell_text(v) for v in c.to_pylist()] for c in b.columns])] if b.num_columns else []
        if len(some) >= most:
            break
    stats = table_stats(some, names, None, [str(f.type) for f in schema]) if some else [{"name": f.name, "physical_type": str(f.type)} for f in schema]
    return {"column_count": len(names), "stats_rows_sampled": len(some), "columns": stats}
