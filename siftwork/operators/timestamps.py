"""Time strings of mixed formats and zones into one UTC instant.

All formats are compiled into one regular expression, an alternation whose branches name their groups. A single
``regexp_replace`` rewrites a matching value into its components, separated by U+0001; the components are checked
against the calendar and put together by integer day arithmetic. Nothing leaves the JVM and no row is read twice.

Meaning of the values
---------------------
* an offset, a zone abbreviation (its usual fixed offset) or an IANA zone in the value counts; otherwise the given local
  zone applies, UTC where it is null or unknown;
* a local time that occurs twice is the first one, a skipped one is read with the offset before the change;
* plain numbers are seconds (9 to 11 digits), milliseconds (13) or microseconds (16) since 1970 UTC;
* all-digit dates that don't start with the year have the day first; missing time parts are zero; digits beyond
  microseconds are cut off;
* a value without a full, valid date, or with an impossible time, zone or offset, gives null, as do null and empty text.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.calendar import DAY_US, bind, checked_days, is_leap, utc_text

# Usual offsets of zone abbreviations, in minutes.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "IST": 330, "NPT": 345, "PKT": 300, "SGT": 480,
    "HKT": 480, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720,
    "NZDT": 780,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_MON = r"(?<N>jan|feb|mar|apr|may|june?|july?|aug|sept?|oct|nov|dec|january|february|march|april|august|september|october|november|december)\.?"
_DAYNAME = r"(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)[a-z]*\.?"
_ZONE = r"(?<z>[+-]\d{2}(?::?\d{2})?|[a-z]+/[a-z_+\-/0-9]+|[a-z]{1,5})"
_TIME = r"(?<h>\d{1,2}):(?<m>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d+))?)?"

#: name, pattern; the groups are Y M N D J h m s f P z E e, each branch gets its own names.
FORMATS = (
    ("epoch", r"(?<E>\d{9,11}|\d{13}|\d{16})(?:\.(?<e>\d+))?"),
    ("compact", r"(?:d:)?(?<Y>\d{4})(?<M>\d{2})(?<D>\d{2})(?:(?<h>\d{2})(?:(?<m>\d{2})(?:(?<s>\d{2}))?)?)?(?:(?<z>z(?:00'?(?:00'?)?)?|[+-]\d{2}(?:'?\d{2})?'?))?"),
    ("basic", r"(?<Y>\d{4})(?<M>\d{2})(?<D>\d{2})t(?<h>\d{2})(?<m>\d{2})(?:(?<s>\d{2})(?:[.,](?<f>\d+))?)?" + rf"(?:\s*{_ZONE})?"),
    ("ordinal", r"(?<Y>\d{4})-(?<J>\d{3})" + rf"(?:[t ]\s*{_TIME}(?:\s*{_ZONE})?)?"),
    ("year first", r"(?<Y>\d{4})[-/.](?<M>\d{1,2})[-/.](?<D>\d{1,2})" + rf"(?:(?:t|\s+){_TIME}(?:\s*{_ZONE})?)?"),
    ("day first", r"(?<D>\d{1,2})[-/.](?<M>\d{1,2})[-/.](?<Y>\d{4})" + rf"(?:(?:t|,?\s+){_TIME}(?:\s*(?<P>[ap])\.?m\.?)?(?:\s*{_ZONE})?)?"),
    ("ctime", rf"(?:{_DAYNAME},?\s+)?{_MON}\s+(?<D>\d{{1,2}})\s+{_TIME}(?:\s+{_ZONE})?\s+(?<Y>\d{{4}})"),
    ("mail", rf"(?:{_DAYNAME},?\s+)?(?<D>\d{{1,2}})[\s-]+{_MON}[\s-]+(?<Y>\d{{4}})(?:,?\s+{_TIME}(?:\s*{_ZONE})?)?"),
    ("month first", rf"(?:{_DAYNAME},?\s+)?{_MON}\s+(?<D>\d{{1,2}}),?\s+(?<Y>\d{{4}})" + rf"(?:,?\s+{_TIME}(?:\s*(?<P>[ap])\.?m\.?)?(?:\s*{_ZONE})?)?"),
)
PARTS = "Y M N D J h m s f P z E e".split()


def compiled(formats=FORMATS) -> tuple[str, str]:
    """The alternation, and the replacement that lists the parts of whichever branch matched."""
    branches, held = [], {p: [] for p in PARTS}
    for i, (_, pattern) in enumerate(formats):
        for p in PARTS:
            if f"(?<{p}>" in pattern:
                pattern = pattern.replace(f"(?<{p}>", f"(?<{p}{i}>")
                held[p].append(f"${{{p}{i}}}")
        branches.append(pattern)
    return r"(?is)\A(?:" + "|".join(branches) + r")\z", "\u0001".join("".join(held[p]) for p in PARTS)


def _zones() -> list[str]:
    return sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("posix", "right", "SystemV")))


def _num(text: Column) -> Column:
    return F.when(text != "", text).try_cast("bigint")


def _micros(text: Column) -> Column:
    return F.rpad(F.substring(text, 1, 6), 6, "0").try_cast("bigint")


def normalise(df: DataFrame, value: str, zone: str, out: str = "ts_us") -> DataFrame:
    """df with the instant that its column ``value`` denotes added as ``out``: microseconds since 1970 UTC, or null.

    zone: column with the IANA name for values that give no zone. Parts and numbers are bound by one-row generators, which
    the optimiser doesn't merge: every part is computed once a row and generated methods stay small.
    """
    pattern, parts = compiled()
    keep = [F.col(f"`{k}`") for k in df.columns if k != out]
    bound = lambda d, **cols: bind(d, **{f"__{k}": v for k, v in cols.items()})
    c = lambda name: F.col(f"__{name}")
    t = lambda name: F.col(f"__t{PARTS.index(name)}")
    clean = F.translate(F.regexp_replace(F.col(value), r"(?U)\A\s+|\s+\z", ""), "−‐‑–’\u00a0\u202f\u2009", "----'   ")
    d = bound(df, a=F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(parts)), "\u0001"))
    d = bound(d, **{f"t{i}": F.when(F.size(c("a")) == len(PARTS), F.get(c("a"), F.lit(i))) for i in range(len(PARTS))})

    h0, pm = F.coalesce(_num(t("h")), F.lit(0)), F.lower(t("P"))
    digits = F.regexp_replace(t("z"), "[^0-9]", "")
    by_name = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(t("N"), 1, 3)))
    zones, table = _zones(), F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])
    is_region = t("z").contains("/")
    d = bound(
        d,
        y=_num(t("Y")),
        mo=F.when(t("N") != "", by_name).otherwise(_num(t("M"))),
        da=_num(t("D")),
        jd=_num(t("J")),
        ho=F.when(pm == "", h0).when(h0.between(1, 12), h0 % 12 + F.when(pm == "p", 12).otherwise(0)).otherwise(99),
        mi=F.coalesce(_num(t("m")), F.lit(0)),
        se=F.coalesce(_num(t("s")), F.lit(0)),
        us=F.when(t("f") != "", _micros(t("f"))).otherwise(0),
        n=F.length(t("E")),
        epoch=_num(t("E")),
        part=F.when(t("e") != "", _micros(t("e"))).otherwise(0),
        oh=_num(F.substring(digits, 1, 2)),
        om=F.coalesce(_num(F.substring(digits, 3, 2)), F.lit(0)),
        named=F.when(t("z").rlike("(?i)^z"), 0).otherwise(F.try_element_at(table, F.upper(t("z")))),
        zone=F.when(is_region, F.when(t("z").isin(*zones), t("z"))).when(t("z") == "", F.coalesce(F.when(F.col(zone).isin(*zones, "UTC"), F.col(zone)), F.lit("UTC"))),
    )
    in_year = (c("jd") >= 1) & (c("jd") <= F.when(is_leap(c("y")), 366).otherwise(365))
    of_year = F.when(in_year, checked_days(c("y"), F.lit(1), F.lit(1)) + c("jd") - 1)
    signed = F.when((c("oh") <= 18) & (c("om") <= 59), (c("oh") * 60 + c("om")) * F.when(t("z").startswith("-"), -1).otherwise(1))
    d = bound(
        d,
        days=F.when(t("J") != "", of_year).otherwise(checked_days(c("y"), c("mo"), c("da"))),
        clock=F.when((c("ho") <= 23) & (c("mi") <= 59) & (c("se") <= 59), (c("ho") * 3600 + c("mi") * 60 + c("se")) * 1_000_000 + c("us")),
        minutes=F.when(t("z").rlike("^[+-]"), signed).otherwise(c("named")),
    )
    wall = c("days") * DAY_US + c("clock")
    at = F.when(c("zone").isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), c("zone"))))
    at = at.when(is_region, F.lit(None)).otherwise(wall - c("minutes") * 60_000_000)
    epoch = c("epoch") * F.when(c("n") <= 11, 1_000_000).when(c("n") == 13, 1000).otherwise(1) + F.when(c("n") <= 11, c("part")).otherwise(0)
    return d.select(*keep, F.when(t("E") != "", epoch).when(t("E") == "", at).cast("bigint").alias(out))


def file_zones(outputs: DataFrame, site: DataFrame) -> DataFrame:
    """file_id, tz_name: one row per file that has a site; repeats of a row are folded."""
    own = outputs.where("file_id is not null and site_code is not null").groupBy("file_id").agg(F.min("site_code").alias("site_code"))
    zones = site.where("site_code is not null").groupBy("site_code").agg(F.min("tz_name").alias("tz_name"))
    return own.join(zones, "site_code").select("file_id", "tz_name")


def found(pdf_metadata: DataFrame, tet_files: DataFrame, tet_history: DataFrame, outputs: DataFrame, site: DataFrame) -> DataFrame:
    """tbl, row_id, field, ts_utc of every value that denotes an instant; repeats are folded.

    Only the key, the file and the value are carried. The zone of the file is a left join; where one file holds a large
    share of the rows, AQE splits its partition, as neither side has more than one zone a file.
    """
    fields = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("creation_date", "modification_date")]
    )
    pdf = pdf_metadata.select("file_id", F.lit("pdf_metadata").alias("tbl"), F.col("pdf_id").alias("row_id"), F.explode(fields).alias("v"))
    pdf = pdf.select("file_id", "tbl", "row_id", "v.field", "v.value")
    one = lambda df, t, k, c, f="file_id": df.select(F.col(f).alias("file_id"), F.lit(t).alias("tbl"), F.col(k).alias("row_id"), F.lit(c).alias("field"), F.col(c).alias("value"))
    owner = tet_files.where("tet_id is not null").groupBy("tet_id").agg(F.min("file_id").alias("owner"))
    history = one(tet_history.join(owner, "tet_id", "left"), "tet_history", "history_id", "event_at", "owner")
    values = pdf.unionByName(one(tet_files, "tet_files", "tet_id", "created_at")).unionByName(history)
    values = values.where("value is not null and row_id is not null").dropDuplicates()
    zoned = values.join(file_zones(outputs, site), "file_id", "left")
    at = normalise(zoned, "value", "tz_name").where("ts_us is not null")
    return at.select("tbl", "row_id", "field", utc_text(F.col("ts_us")).alias("ts_utc")).dropDuplicates()
