"""Index arithmetic of arrays, dialects of delimited text, and small predicates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions import text as X
from siftwork.functions import typecheck as T


def unravel(index: Column, shape: tuple[int, int, int], fortran: bool = False) -> Column:
    """Place of a linear index in a rank-3 array, in C or Fortran order."""
    d0, d1, d2 = shape
    if fortran:
        parts = (index % d0, F.floor(index / d0) % d1, F.floor(index / (d0 * d1)))
    else:
        parts = (F.floor(index / (d1 * d2)), F.floor(index / d2) % d1, index % d2)
    return F.array(*[p.cast("bigint") for p in parts])


def evenly_spaced(n: Column, most: int) -> Column:
    """Up to ``most`` indices from 0 to n - 1, evenly spread, both ends included."""
    k = F.least(n, F.lit(most))
    step = F.when(k > 1, (n - 1) / (k - 1)).otherwise(F.lit(0.0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: F.floor(i * step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def table_dims(shape: Column) -> Column:
    """[rows, columns] of a shape: [1, 1] for a scalar, [n, 1] for a vector, null from rank 3 on."""
    one = F.lit(1).cast("bigint")
    n = F.size(shape)
    return F.when(n == 0, F.array(one, one)).when(n == 1, F.array(F.get(shape, F.lit(0)).cast("bigint"), one)).when(n == 2, shape.cast("array<bigint>"))


def strided(values: Column, stride: int) -> Column:
    """Every stride-th value, from the first."""
    return F.filter(values, lambda x, i: i % stride == 0)


def quote_mark(text: Column) -> Column:
    """The quote that opens or closes more cells in the first ten lines; " on a tie or where there is none."""
    head = F.array_join(F.slice(X.lines(text), 1, 10), "\n")
    score = lambda q: F.regexp_count(head, F.lit(rf"(?:^|[,;\t|\n]){q}|{q}(?=$|[,;\t|\n])"))
    return F.when(score("'") > score('"'), "'").otherwise('"')


def escape_mark(text: Column) -> Column:
    """Backslash where it stands before a quote in the first ten lines, else a doubled quote where there is one, else null."""
    head = F.array_join(F.slice(X.lines(text), 1, 10), "\n")
    return F.when(head.contains('\\"'), "\\").when(head.rlike(r'[^,;\t|\n]""|""[^,;\t|\n]'), '"')


def all_placeholders(pattern: Column) -> Column:
    return F.forall(F.split(pattern, " "), lambda w: w.startswith("[") & w.endswith("]"))


def sentence_stats(s: Column) -> Column:
    """words, chars, whether it has quotes, its end, and its emphasis: question or exclamation, whichever mark comes last."""
    quotes = s.contains('"') | s.contains("'")
    last = F.regexp_extract(s, r"(?s)([?!])[^?!]*$", 1)
    emphasis = F.when(last == "?", "question").when(last == "!", "exclamation").otherwise("none")
    return F.struct(F.size(X.tokens(s)).alias("words"), F.length(s).alias("chars"), quotes.alias("quotes"), X.end_type(s).alias("end_type"), emphasis.alias("emphasis"))


def affinity(declared: Column) -> Column:
    """Storage class that a declared column type means."""
    t = F.upper(F.coalesce(declared, F.lit("")))
    text = t.contains("CHAR") | t.contains("CLOB") | t.contains("TEXT")
    real = t.contains("REAL") | t.contains("FLOA") | t.contains("DOUB")
    return F.when(t.contains("INT"), "INTEGER").when(text, "TEXT").when((t == "") | t.contains("BLOB"), "BLOB").when(real, "REAL").otherwise("NUMERIC")


def iso_date(pdf: Column) -> Column:
    """A PDF date as ISO 8601 with the zone it gives, Z where it gives none; null for any other text."""
    p = r"^(?:D:)?(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?(\d{2})?(?:([+-])(\d{2})'?(\d{2})?'?|Z.*)?$"
    g = lambda k, other: F.coalesce(F.nullif(F.regexp_extract(pdf, p, k), F.lit("")), F.lit(other))
    zone = F.when(F.regexp_extract(pdf, p, 7) != "", F.concat(g(7, "+"), g(8, "00"), F.lit(":"), g(9, "00"))).otherwise("Z")
    return F.when(pdf.rlike(p), F.concat(g(1, ""), F.lit("-"), g(2, ""), F.lit("-"), g(3, ""), F.lit("T"), g(4, "00"), F.lit(":"), g(5, "00"), F.lit(":"), g(6, "00"), zone))


def timestamp_presence(line: Column) -> Column:
    """Whether a line holds a Unix time, or one to six words from one of its first six that are a date or time."""
    tok = X.tokens(line)
    runs = [F.array_join(F.slice(tok, i, k), " ") for i in range(1, 7) for k in range(1, 7)]
    # every date has one of these; the others needn't be parsed
    likely = F.filter(F.array_distinct(F.array(*runs)), lambda w: w.rlike(r"\d[/:-]\d|\d{6}"))
    return T.has_unix_time(line) | F.exists(likely, lambda w: T.date_seconds(w).isNotNull())
